import html as references
import random
import re
import time

import pytest

from thrustlog.llm import html_content, url_rules


def article(html):
    inner = re.search(r"<article>(.*?)</article>", html, re.S).group(1)
    blocks = (" ".join(references.unescape(re.sub(r"</?(b|br)>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_articles_of_the_sample_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = html_content.extracted(pages.withColumn("text", pages["url"])).select("row.page_id", "text").collect()
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    assert len(rows) == len(source)
    assert all(r["text"] == article(source[r["page_id"]]) for r in rows)


PAGE = (
    '<html><head><title>T</title></head><body><header><h2>Site</h2></header><div class="cookie-notice">We use cookies</div><main><header><h1>Title</h1></header>'
    "<p>Short.</p><p>" + "word " * 50 + '</p><aside>see also</aside><form><input><label>Name</label></form><p>a &amp; b&nbsp;\n c<br>d</p>'
    '<div id="comments"><p>first!</p></div></main><div class=sidebar><ul><li>x</ul></div></body>'
)


@pytest.mark.parametrize(("html", "text"), [
    ("", ""), ("plain text only", "plain text only"), ("<nav>menu</nav>", ""), ("<p>", ""),
    (PAGE, "Title\nShort.\n" + ("word " * 50).strip() + "\na & b c d"),
    ("<nav><a>menu<article><h1>A</h1><p>text here</article>", "A\ntext here"),
    ("<p>one<p>two</div></span><b>three", "one\ntwo\nthree"),
])
def test_main_text(html, text):
    assert html_content.main_text(html) == text


def test_dense_region_wins_without_article_tags():
    links = "".join(f"<div><a href='#'>l{i}</a> <a>m</a> <i>x</i></div>" for i in range(12))
    body = "".join(f"<p>{'sentence ' * 40}{i}</p>" for i in range(6))
    text = html_content.main_text(f"<body>{links}<div>{body}</div>{links}</body>")
    assert text.split("\n") == [f"{'sentence ' * 40}{i}" for i in range(6)]


def paragraphs(n, size, mark):
    return [f"{mark}{i} " + ("text " * size)[: size - 4].strip() for i in range(n)]


@pytest.mark.parametrize("longest", [200, 3_000, 300_000])
@pytest.mark.parametrize("size", [20, 60, 200])
def test_one_long_block_drops_no_other_section(longest, size):
    parts = [paragraphs(3, size, "a"), [("long " * longest)[:longest].strip()], paragraphs(4, size, "b"), paragraphs(2, size, "c")]
    links = "<div>" + "".join(f"<a href='#'>link {i}</a> " for i in range(8)) + "</div>"
    body = "".join("<section>" + "".join(f"<p>{t}</p>" for t in part) + "</section>" for part in parts)
    html = f"<body><nav>menu</nav>{links}<div>{body}</div>{links}<footer>foot</footer></body>"
    assert html_content.main_text(html).split("\n") == sum(parts, [])
    assert html_content.main_text(html.replace("<div><section>", "<section>").replace("</section></div>", "</section>")).split("\n") == sum(parts, [])


def test_linked_sections_are_no_siblings_of_content():
    html = "<body><section><p>" + "word " * 100 + "</p></section><section><p><a href=x>read</a><p><a href=y>more of it</section><section><p>short end</section></body>"
    assert html_content.main_text(html).split("\n") == [("word " * 100).strip(), "short end"]


@pytest.mark.parametrize("name", [
    "layout has-sidebar", "site with-header", "post-no-comments", "content_without_ads", "page sidebar-right", "content-sidebar-wrap", "elementor-widget", "sidebar",
])
@pytest.mark.parametrize("kind", ["class", "id"])
def test_named_wrapper_keeps_the_article(name, kind):
    texts = paragraphs(5, 200, "p")
    inner = "".join(f"<p>{t}</p>" for t in texts)
    rest = '<div class="sidebar"><p>see also this</p></div><div id="comments"><p>first!</p></div>'
    menu = "<div><a href=#>a</a> <a href=#>b</a></div>"
    for html in (inner + rest, f"<div>{inner}</div>{rest}", f'<div class="main-header"><div class="x">{inner}</div></div>{rest}'):
        page = f'<body>{menu}<div {kind}="{name}">{html}</div><footer>foot</footer></body>'
        assert html_content.main_text(page).split("\n") == texts


@pytest.mark.parametrize("n", [1, 12, 20])
def test_boilerplate_stays_out_beside_an_article(n):
    texts = paragraphs(5, 200, "p")
    comments = "".join(f'<li class="comment"><p>{t}</p></li>' for t in paragraphs(n, 200, "c"))
    html = "<body><div>" + "".join(f"<p>{t}</p>" for t in texts) + f'</div><div id="comments" class="comments-area"><ol class="comment-list">{comments}</ol></div></body>'
    assert html_content.main_text(html).split("\n") == texts


@pytest.mark.parametrize(("inner", "kept"), [
    ('<header class="entry-header"><h1>Title</h1></header>', ["Title"]), ('<header class="header"><h1>Title</h1></header>', ["Title"]),
    ('<p class="share-price">The price fell.</p>', ["The price fell."]), ('<p class="notice-period">Two months.</p>', ["Two months."]),
    ('<h2 class="section-header">Part</h2>', ["Part"]), ('<div class="section-header"><h2>Part</h2></div>', ["Part"]),
    ('<div class="share-bar"><a href=x>Tweet</a> <a href=y>Pin it</a></div>', []), ('<div class="related-posts"><ul><li><a href=x>Other</a></ul></div>', []),
    ('<div class="share-note"><p>read on</p><div class="share-row"><a href=x>Tweet</a></div></div>', ["read on"]),
    ('<div class="comment-list"><p>I do not agree with this.</p></div>', []), ('<p class="ad-label">Buy this now.</p>', []), ('<div class="sidebar"><p>see also</p></div>', []),
])
def test_names_inside_an_article(inner, kept):
    texts = paragraphs(3, 300, "p")
    body = "".join(f"<p>{t}</p>" for t in texts)
    assert html_content.main_text(f"<body><nav>menu</nav><article>{inner}{body}</article></body>").split("\n") == kept + texts
    assert html_content.main_text(f"<body><main><article>{body}{inner}</article></main></body>").split("\n") == texts + kept


def test_every_article_beside_the_chosen_one():
    texts = paragraphs(4, 300, "p")
    long = "<article>" + "".join(f"<p>{t}</p>" for t in texts) + "</article>"
    teaser = "<article><a href=x>Read this</a> <a href=y>and that</a></article>"
    html = f"<body><div>{long}<article><p>A short note.</p></article>{teaser}</div><div><article><a href=z>elsewhere</a></article></div></body>"
    assert html_content.main_text(html).split("\n") == [*texts, "A short note."]


@pytest.mark.parametrize("around", ["{}", "<main>{}</main>"])
def test_comments_as_articles(around):
    texts = paragraphs(5, 200, "p")
    comments = "".join(f'<li class="comment"><article class="comment-body"><p>{t}</p></article>' for t in paragraphs(3, 200, "c"))
    body = "<article>" + "".join(f"<p>{t}</p>" for t in texts) + "</article>"
    for start in ('<ol class="comment-list">', "<ol>", '<div id="comments">'):
        html = "<body>" + around.format(f"{body}{start}{comments}") + "</body>"
        assert html_content.main_text(html).split("\n") == texts


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "text", ("<div>" + "</p></b></span>") * 30_000 + "text", "<article>" + '<div class="share-x">' * 50_000 + "text"])
def test_nesting_takes_linear_time(page):
    start = time.process_time()
    assert html_content.main_text(page) in ("text", "")
    assert time.process_time() - start < 4


def test_page_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "", None), (2, "<p>a" * 20_000, "x"), (3, "<p>a", "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string, row string")
    got = html_content.extracted(pages).collect()
    assert sorted(r["text"] for r in got) == sorted(["", "", "", "\n".join(["a"] * 20_000), "a"])
    assert html_content.extracted(pages.limit(0)).count() == 0


def naive(host, path, entries):
    fits = []
    for verdict, rule in entries:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((h.count("."), len(slash + p), verdict == "block", verdict, rule))
    return max(fits)[3:] if fits else None


def test_trie_against_all_rules():
    draw = random.Random(1)
    entries = {}
    for _ in range(80):
        host = ".".join(draw.choices(["a", "b", "net", "com"], k=draw.randint(1, 3)))
        path = draw.choice(["", "/", "/x", "/x/", "/x/y", "/x/yy/", "//"])
        entries[host + path] = draw.choice(["allow", "block"])
    entries = [(v, r) for r, v in entries.items()]
    trie = url_rules.Trie(entries)
    for _ in range(4000):
        host = ".".join(draw.choices(["a", "b", "net", "com", "zz"], k=draw.randint(1, 4)))
        path = draw.choice(["", "/", "/x", "/x/", "/x/y", "/x/yy/z", "/xx", "//", "/x//"])
        found, expected = trie.match(host, path), naive(host, path, entries)
        assert (found and found[0]) == (expected and expected[0])


URLS = [
    ("http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "allow"), ("https://example.net/en", "example.net", "/en", "block"),
    ("https://net", "net", "", "allow"), ("x://net/", "net", "/", "block"), ("http://notnet/", "notnet", "/", "allow"),
    (None, "", "", "allow"), ("", "", "", "allow"), ("example.net/en/", "", "", "allow"), ("a://b.org/fr/x", "b.org", "/fr/x", "allow"),
    ("http://example.com/de/?q=://net/", "example.com", "/de/", "block"), ("http://h\n.net/a\nb", "h\n.net", "/a\nb", "block"),
]


@pytest.mark.parametrize("max_bytes", [8 << 20, 1])
def test_urls(spark, max_bytes):
    pages = spark.createDataFrame([(i, u, "own") for i, (u, *_) in enumerate(URLS)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_rules.judged(pages, max_bytes=max_bytes).collect()}
    for i, (_, host, path, verdict) in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"], got[i]["verdict"]) == (host, path, verdict)
    assert url_rules.judged(pages.limit(0), max_bytes=max_bytes).count() == 0
