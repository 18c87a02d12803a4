"""Main text of web pages by text-to-tag ratios (operator 9).

Parser events of the standard library cut a page into lines, one per block of text. A line's ratio is
its characters per tag; lines inside elements that never hold the article (menus, scripts, footers,
adverts by class or id, and the like) count as having none. The ratios' logarithms, capped so that no long block moves
the scale, are smoothed by a Gaussian and clustered by a threshold. Lines of one article element, or else neighbouring lines of one container, form a region; a region with a line of the
upper cluster is content, and all its lines are kept. If no line reaches the threshold, the region with the most text is
content. Unless articles hold most of the text, the regions beside a chosen one (same parent, parent or child container) are content too,
save those that are mostly links or have few characters a tag. Where articles do, a region outside them must also reach the
threshold of the plain ratios.

A class or id marks an element as boilerplate by its words, save names that say what a layout has or lacks (``has-sidebar``,
``no-comments``). Where marks take more than half of the page's text, those that are wrappers are undone and their children judged: an element with
more than half of the text whose mark is part of a longer name, or with nearly all of it. Inside an article element headings are
never marked, and a name that only contains such a word (``share-price``) marks an element only if it is mostly links or has few
characters a tag, save names of comments, adverts and the like (``FOREIGN``), whose text is as dense as the article's. Articles
beside a chosen one are content too, by the same test; an article in or of a list of comments is none. Time grows linearly with
the page, whatever the nesting.

Character references are decoded, white space inside a block becomes one space, blocks are joined by a line
break. Null and empty pages give the empty text; unclosed and stray tags are tolerated; rows
pass through one by one, so ties and repeated rows stay; other columns are kept.
"""

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from thrustlog.llm.batches import text_runs

# Elements of HTML by their part in a page.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol option optgroup p pre search "
    "section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset(
    "head script style noscript template title nav aside footer form button select textarea iframe dialog menu search svg object canvas".split()
)
CONTAINERS = frozenset("body article main section div td blockquote".split())
ARTICLES = frozenset(("article", "main"))
WHOLE = ARTICLES | {"html", "body"}
SHUT_BY = {"p": BLOCKS - {"p", "body", "html", "head"} | {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "head": {"body"}}
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|banners?|breadcrumbs?|comments?|cookies?|consent|disqus|footers?|gdpr|"
    r"headers?|masthead|menus?|nav|navbar|navigation|newsletter|notices?|pagination|pager|popup|modal|promos?|promoted|related|"
    r"replies|respond|share|sharing|sidebars?|social|sponsors?|sponsored|subscribe|toolbar|widgets?)(?:$|[\s_-])"
)
FOREIGN = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|comments?|cookies?|consent|disqus|gdpr|newsletter|popup|modal|promos?|promoted|"
    r"replies|respond|sponsors?|sponsored|subscribe)(?:$|[\s_-])"
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LAYOUT = re.compile(r"(?:^|[_-])(?:has|have|having|with|without|no|non|not|hide|hides|hidden|show|shows)[_-]")
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert menu menubar toolbar".split())

SIGMA = 1.5
SHARE = 0.5
ENOUGH = 200  # characters a tag; a line of more counts the same
LINKED = 0.5  # a region with a larger share of its text in links is no sibling of content
THIN = 2  # nor is one with fewer characters a tag
BARE = 1  # fewer characters a tag than in any short heading
MOST = 0.5  # a marked element with a larger share of the page's text is a wrapper, if the mark is part of a name
NEARLY_ALL = 0.9  # or if it is the whole name


def marked(attrs, names=BOILERPLATE):
    """2 if a class or id is one of ``names``, 1 if it has one in it, 0 otherwise."""
    found = 0
    for name, value in attrs:
        if value and name in ("class", "id") and names.search(value.lower()):
            for word in value.lower().split():
                hit = names.search(word)
                if hit and not LAYOUT.search(word):
                    found = max(found, 1 + (hit.group() == word))
    return found


class Lines(HTMLParser):
    """Collects ``(text, tags, container, never, linked)`` of every line of a page; ``parents`` has a container's parent.

    ``never`` is -1 in an element that never holds content, else the number of the innermost element marked by class or
    id, 0 without one; ``marks`` has for each number the mark around it, whether it is a whole name, whether the text's
    density has to bear it out, and whether it names comments, adverts and the like.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.words, self.tags = [], [], 0
        self.open = []  # (tag, is never content, container)
        self.numbers, self.parents = 0, {}
        self.marks = [(0, False, False, False)]
        self.opened = Counter()  # open elements by tag
        self.link, self.linked = None, 0  # elements open around the open link, characters of the line in links

    def _state(self):
        return self.open[-1][1:] if self.open else (0, 0)

    def _end_line(self):
        text = " ".join("".join(self.words).split())
        if text or self.tags:
            never, container = self._state()
            self.lines.append((text, self.tags, container, never, self.linked))
        self.words, self.tags, self.linked = [], 0, 0

    def _pop(self):
        self.opened[self.open.pop()[0]] -= 1

    def _foreign(self):
        never = self.open[-1][1]
        return never > 0 and self.marks[never][3]

    def _mark(self, tag, attrs, inside, never):
        """The mark of an element by its names, entered below the mark ``never``."""
        foreign = marked(attrs, FOREIGN)
        mark = foreign if tag in ARTICLES else marked(attrs)
        if not mark or inside and (tag in HEADINGS or tag == "header" and not foreign):
            return never
        self.marks.append((never, mark == 2, inside and mark == 1 and not foreign, foreign > 0))
        return len(self.marks) - 1

    def _left(self):
        """A link that nobody closed ends with the element around it."""
        if self.link is not None and len(self.open) < self.link:
            self.link = None

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._end_line()
        self.tags += 1
        if tag == "br":
            self.words.append(" ")
        while self.open and tag in SHUT_BY.get(self.open[-1][0], ()):
            self._pop()
        if tag in ARTICLES:  # an article ends menus and the like that nobody closed, but may be a comment
            while self.open and self.open[-1][1] and not self._foreign():
                self._pop()
        self._left()
        if tag in VOID:
            return
        if tag == "a":
            self.link = len(self.open)
        never, container = self._state()
        inside = any(self.opened[x] for x in ARTICLES)
        if never >= 0:
            if tag in NEVER or tag == "header" and not inside or self._hidden(tag, attrs):
                never = -1
            elif tag == "article" or tag not in WHOLE:
                never = self._mark(tag, attrs, inside, never)
        if tag in CONTAINERS and not inside:
            self.numbers += 1
            self.parents[self.numbers] = container
            container = -self.numbers if tag in ARTICLES else self.numbers
        if tag in BLOCKS or never or tag in NEVER:
            self.open.append((tag, never, container))
            self.opened[tag] += 1

    @staticmethod
    def _hidden(tag, attrs):
        return tag not in WHOLE and any(
            name == "role" and value and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" for name, value in attrs
        )

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._end_line()
        self.tags += 1
        if tag == "a":
            self.link = None
        while self.opened[tag]:
            last = self.open[-1][0]
            self._pop()
            if last == tag:
                break
        self._left()

    def handle_data(self, data):
        self.words.append(data)
        if self.link is not None:
            self.linked += len(" ".join(data.split()))

    def close(self):
        super().close()
        self._end_line()


def smoothed(ratios, sigma=SIGMA):
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel / kernel.sum(), mode="full")[reach : reach + len(ratios)]


def main_text(html):
    """Text of the content regions of one page."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = unwrapped(borne_out(parser.lines, parser.marks), parser.marks)
    held = [bool(text) and not never for text, _, _, never, _ in lines]
    if not any(held):
        return ""
    ratios = np.array([len(line[0]) / max(1, line[1]) if keep else 0.0 for line, keep in zip(lines, held, strict=True)])
    high = clustered(np.log1p(np.minimum(ratios, ENOUGH)))
    region, size, chosen, parted = [None] * len(lines), {}, set(), 0
    last = None
    for i, (text, _, container, never, _) in enumerate(lines):
        if not held[i]:
            parted += never and bool(text)  # boilerplate parts regions, save within an article
            continue
        region[i] = container if container < 0 else (container, parted)
        if container != last:  # a return to a container after another begins a region of its own
            parted += container >= 0
            region[i] = container if container < 0 else (container, parted)
            last = container
        size[region[i]] = size.get(region[i], 0) + len(text)
        if high[i]:
            chosen.add(region[i])
    chosen = chosen or {max(size, key=size.get)}
    chosen |= articles_beside(chosen, lines, region, size, parser.parents)
    loose = [r for r in size if isinstance(r, tuple)]
    if 2 * sum(size[r] for r in chosen if not isinstance(r, tuple)) > sum(size.values()):
        plain = clustered(ratios)
        chosen -= set(loose) - {region[i] for i in range(len(lines)) if plain[i]}
    elif len(chosen) < len(size):
        chosen |= beside(chosen, loose, lines, region, size, parser.parents)
    return "\n".join(lines[i][0] for i in range(len(lines)) if held[i] and region[i] in chosen)


def borne_out(lines, marks):
    """The lines without the marks that density has to bear out and does not."""
    if not any(mark[2] for mark in marks):
        return lines
    size, tags, linked = ([0] * len(marks) for _ in range(3))
    for text, n, _, never, links in lines:
        if never >= 0:
            size[never] += len(text)
            tags[never] += n
            linked[never] += links
    for m in range(len(marks) - 1, 0, -1):  # a mark has a higher number than the one around it
        for total in (size, tags, linked):
            total[marks[m][0]] += total[m]
    stands = list(range(len(marks)))
    for m, (around, _, soft, _) in enumerate(marks):
        if soft and linked[m] <= LINKED * size[m] and size[m] >= BARE * tags[m]:
            stands[m] = stands[around]
    return [(text, n, container, stands[never] if never >= 0 else never, links) for text, n, container, never, links in lines]


def unwrapped(lines, marks):
    """The lines with ``never`` as true or false, marks of wrappers undone."""
    undone = [True] + [False] * (len(marks) - 1)
    own = [0] * len(marks)
    for line in lines:
        if line[3] >= 0:
            own[line[3]] += len(line[0])
    total, size = sum(own), own[:]
    if own[0] < (1 - MOST) * total:
        for m in range(len(marks) - 1, 0, -1):  # a mark has a higher number than the one around it
            size[marks[m][0]] += size[m]
        for m, (around, whole, *_) in enumerate(marks[1:], 1):
            undone[m] = undone[around] and size[m] > (NEARLY_ALL if whole else MOST) * total
    return [(text, tags, container, never < 0 or not undone[never], linked) for text, tags, container, never, linked in lines]


def clustered(ratios):
    """Which lines are in the upper cluster."""
    smooth = smoothed(ratios)
    return smooth >= SHARE * ratios.std() if len(ratios) > 1 else smooth >= 0


def dense(regions, lines, region, size):
    """Those of the regions that are neither mostly links nor mostly tags."""
    tags, linked = dict.fromkeys(size, 0), dict.fromkeys(size, 0)
    for line, r in zip(lines, region, strict=True):
        if r is not None:
            tags[r] += line[1]
            linked[r] += line[4]
    return {r for r in regions if linked[r] <= LINKED * size[r] and size[r] >= THIN * tags[r]}


def articles_beside(chosen, lines, region, size, parents):
    """Article elements under the same parent as a chosen one."""
    near = {parents[-r] for r in chosen if not isinstance(r, tuple)}
    return dense([r for r in size if not isinstance(r, tuple) and parents[-r] in near], lines, region, size)


def beside(chosen, loose, lines, region, size, parents):
    """Regions under the same parent as a chosen one, or in its parent or child container."""
    near = {r[0] for r in chosen if isinstance(r, tuple)}
    above = {parents.get(c) for c in near}
    fit = (r for r in loose if r[0] in near or r[0] in above or parents.get(r[0]) in near | above - {None})
    return dense(fit, lines, region, size)


def extracted(pages, html_column="html"):
    """The page in struct ``row`` and its main text."""

    def extract(batches):
        for batch in batches:
            for start, texts in text_runs(batch, "html"):
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(start, len(texts)), pa.array(list(map(main_text, texts)), pa.string())], names=["row", "text"])

    kept = [pages[c] for c in pages.columns if c != html_column]
    rows = pages.select(F.struct(*kept).alias("row"), F.coalesce(pages[html_column].cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(extract, StructType([rows.schema["row"], *StructType.fromDDL("text string").fields]))
