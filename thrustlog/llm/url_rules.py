"""URL filter by a trie over reversed host labels and path segments (operator 10).

A rule is ``host/path``; it fits its host and all subdomains when the URL's path starts with the
rule's path. Of fitting rules the longest decides: most host labels, then longest path; of an allow
and a block entry for the same place, the block entry. A URL that no rule fits gets ``default``.

The trie is broadcast while the entries hold at most ``max_bytes``; a larger list is joined by the
keys that a URL can match. Null URLs and those without ``://`` have an empty host and path, which no
rule fits. Repeated rows stay; other columns pass through unchanged, apart from the four
that the operator adds, which replace columns of the same name.
"""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

MAX_BYTES = 8 << 20
ENTRIES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


class Trie:
    """Nodes by reversed host labels, then by path segments; paths need not end at a segment."""

    def __init__(self, entries):
        self.root = {}
        for verdict, rule in entries:
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("/", {})  # no host label holds a slash
            *segments, last = (slash + path).split("/")
            for segment in segments:
                node = node.setdefault("/" + segment, {})
            ends = node.setdefault("ends", {})  # what the segment here must begin with
            if ends.get(last, ("",))[0] != "block":
                ends[last] = (verdict, rule)

    def match(self, host, path):
        """``(verdict, rule)`` of the longest rule that fits, or None."""
        found, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                return found
            below = node.get("/")
            if below is not None:
                found = self._path(below, path) or found
        return found

    @staticmethod
    def _path(node, path):
        found = None
        segments = path.split("/")
        for i, segment in enumerate(segments):
            ends = node.get("ends")
            if ends:
                fits = [x for x in ends if segment.startswith(x)] if len(ends) < len(segment) else [x for k in range(len(segment) + 1) if (x := segment[:k]) in ends]
                if fits:
                    found = ends[max(fits, key=len)]
            if i == len(segments) - 1:
                break
            node = node.get("/" + segment)
            if node is None:
                break
        return found


def host_and_path(url):
    """Columns of a URL's host, with A-Z in lower case, and its path."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lowered, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def judged(pages, entries=ENTRIES, default="allow", url_column="url", max_bytes=MAX_BYTES):
    """``pages`` with host, path, rule and verdict."""
    host, path = host_and_path(pages[url_column].cast("string"))
    kept = [pages[c] for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    placed = pages.select(F.struct(*kept).alias("row"), host.alias("host"), path.alias("path"))
    entries = [(str(v), str(r)) for v, r in entries]
    if sum(len(r.encode()) + 8 for _, r in entries) > max_bytes:
        found = _joined(placed, entries)
    else:
        found = _walked(placed, entries)
    return found.select("row.*", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _walked(placed, entries):
    shared = placed.sparkSession.sparkContext.broadcast(Trie(entries))

    def walk(batches):
        trie = shared.value
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            found = [trie.match(h, p) or (None, None) for h, p in zip(hosts, paths, strict=True)]
            added = [pa.array([r for _, r in found], pa.string()), pa.array([v for v, _ in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "rule", "verdict"])

    schema = StructType([*placed.schema.fields, StructField("rule", StringType()), StructField("verdict", StringType())])
    return placed.mapInArrow(walk, schema)


def _joined(placed, entries):
    """The same by an equi-join: a row for each host suffix and path prefix of a URL that some rule could name."""
    spark = placed.sparkSession
    rules = spark.createDataFrame(entries, "verdict string, rule string").select(
        "verdict", "rule",
        F.concat(F.lower(F.substring_index("rule", "/", 1)), F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1)).alias("key"),
    )
    rules = rules.groupBy("key").agg(F.max_by(F.struct("verdict", "rule"), "verdict").alias("entry"))
    lengths = [r[0] for r in rules.select(F.length(F.regexp_extract("key", r"(?s)^[^/]*(.*)$", 1))).distinct().collect()]
    uid = placed.withColumn("uid", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    spots = uid.select("uid", "path", F.posexplode(hosts).alias("depth", "suffix"))
    prefixes = F.filter(F.array(*(F.lit(n) for n in sorted(lengths))), lambda n: n <= F.length("path"))
    keys = spots.select("uid", "depth", F.explode(F.transform(prefixes, lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("prefix"), "suffix")
    best = (
        keys.select("uid", "depth", F.length("prefix").alias("n"), F.concat("suffix", "prefix").alias("key"))
        .join(rules, "key").groupBy("uid").agg(F.max_by("entry", F.struct("depth", "n")).alias("entry"))
    )
    return uid.join(best, "uid", "left").select("row", "host", "path", F.col("entry.rule").alias("rule"), F.col("entry.verdict").alias("verdict"))
