"""URL filters by a sort-merge range join with a sweep over nested intervals.

The labels of a host in reverse order, each closed by a separator, make a key in which a
host and its subdomains are one interval. Rules become intervals of such keys, pages
points. Both are dealt into ranges of (key, salt), a rule into every range it overlaps;
inside a range all rows are sorted by key and swept once. The sweep keeps a stack of the
rules whose interval is open: rules nest, so a point lies in the intervals of the whole
stack and in no others, and the longest one whose path fits decides.

Range borders come from the `SAMPLE` smallest row hashes, `PER_RANGE` for each range if that
is more, which only balances the work; the salt lets a host with any share of the rows
spread over many ranges. A rule goes to a range once, so rules are copied at most once per
range. The rules of a host are looked up by the lengths of their paths, so a host with
many rules costs a page one lookup for each different length.

Defined cases: a null url, or one without `://`, has an empty host and path, fits no rule
and is allowed; a page that no rule fits gets `default`; of rules with the same length the
one with the longer host wins, then block; equal rows get equal results; no rules or no
pages are fine.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm.line_dedup import LOWER, UPPER
from kithgraph.session import cut_lineage

SAMPLE, PER_RANGE = 20_000, 4
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty if there is no `://`."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def host_key(host: Column) -> Column:
    """The labels reversed, each followed by U+0001, which sorts before any character of a host."""
    labels = F.reverse(F.split(host, r"\.", -1))
    return F.concat(F.array_join(labels, "\x01"), F.lit("\x01"))


def _places(borders: Sequence[tuple[str, int]], kind: str):
    """Adds the range of each page, or the ranges of each rule."""
    keys = [k for k, _ in borders]

    def run(batches):
        for batch in batches:
            if kind == "page":
                rows = zip(batch.column("key").to_pylist(), batch.column("salt").to_pylist(), strict=True)
                bins = pa.array([bisect.bisect_right(borders, r) for r in rows], pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, bins], [*batch.schema.names, "bin"])
            else:  # from the first range that may hold the key to the last one with this beginning
                take, bins = [], []
                for i, key in enumerate(batch.column("key").to_pylist()):
                    low = bisect.bisect_left(keys, key)
                    high = bisect.bisect_left(keys, key[:-1] + "\x02")
                    take += [i] * (high - low + 1)
                    bins += range(low, high + 1)
                part = batch.take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(bins, pa.int32())], [*batch.schema.names, "bin"])

    return run


class HostRules:
    """The rules of one host, found by the longest beginning of a path."""

    def __init__(self, key: str):
        self.key = key
        self.of: dict[str, tuple[int, int, bool, str, str]] = {}  # path: what ranks a rule, its text and action
        self.lengths: list[int] = []

    def add(self, host: str, path: str, action: str) -> None:
        rule = (len(host) + len(path), len(host), action == "block", host + path, action)
        if path not in self.of and len(path) not in self.lengths:
            bisect.insort(self.lengths, len(path))
        self.of[path] = max(rule, self.of.get(path, rule))

    def best(self, path: str) -> tuple[int, int, bool, str, str] | None:
        for n in reversed(self.lengths):
            if n <= len(path) and (rule := self.of.get(path[:n])) is not None:
                return rule
        return None


def _sweep(default: str):
    """Decide pages in sorted order; rules come before the pages of their key."""

    def run(batches):
        stack: list[HostRules] = []
        now = None
        for batch in batches:
            names = batch.schema.names
            out: list[tuple[str | None, str]] = []
            keep: list[int] = []
            rows = zip(*[batch.column(c).to_pylist() for c in ("bin", "key", "is_page", "host", "path", "action")], strict=True)
            for i, (place, key, is_page, host, path, action) in enumerate(rows):
                if place != now:
                    stack, now = [], place
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if not is_page:
                    if not stack or stack[-1].key != key:
                        stack.append(HostRules(key))
                    stack[-1].add(host, path, action)
                    continue
                best = max((rule for rules in stack if (rule := rules.best(path)) is not None), default=None)
                keep.append(i)
                out.append(best[3:] if best else (None, default))
            part = batch.take(pa.array(keep, pa.int64()))
            columns = {n: part.column(n) for n in names if n in ("page", "host", "path")}
            columns["rule"] = pa.array([r for r, _ in out], pa.string())
            columns["verdict"] = pa.array([v for _, v in out], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def borders_of(points: DataFrame, parts: int) -> list[tuple[str, int]]:
    """The first (key, salt) of each range but the first, repeated where rows are few."""
    most = max(SAMPLE, PER_RANGE * parts)  # so many rows at most come to the driver
    order = F.xxhash64("salt", "key")
    # Twice the wanted share is kept first, or every task would send as many rows as all are to give.
    share = min(1.0, 2 * most / max(1, points.count()))
    few = points if share == 1.0 else points.filter(order < F.lit(int(-(2**63) + share * 2**64)))
    spread = few.select("key", "salt").orderBy(order, "key").limit(most)
    sample = sorted((r.key, r.salt) for r in spread.collect())
    return [sample[i * len(sample) // parts] for i in range(1, parts)] if sample else []


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", default: str = "allow") -> DataFrame:
    """(page, host, path, rule, verdict) for each row of `pages` (id, url); rules: (action, host, path)."""
    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = url_parts(F.col("url"))
    kind = pages.schema[id_col].dataType.simpleString()
    points = pages.select(F.col(id_col).alias("page"), host.alias("host"), path.alias("path")).select(
        "page",
        "host",
        "path",
        host_key(F.col("host")).alias("key"),
        F.xxhash64("page", "path").alias("salt"),
        F.lit(True).alias("is_page"),
        F.lit(None).cast("string").alias("action"),
    )
    points = cut_lineage(points)
    borders = borders_of(points, parts)
    columns = f"page {kind}, host string, path string, key string, salt long, is_page boolean, action string, bin int"
    intervals = rules.select(
        F.lit(None).cast(kind).alias("page"),
        "host",
        "path",
        host_key(F.col("host")).alias("key"),
        F.lit(None).cast("long").alias("salt"),
        F.lit(False).alias("is_page"),
        "action",
    )
    rows = points.mapInArrow(_places(borders, "page"), columns).unionByName(
        intervals.mapInArrow(_places(borders, "rule"), columns)
    )
    # A range is a partition of its own; by hash, several would meet in one.
    ordered = rows.repartitionById(parts, "bin").sortWithinPartitions("bin", "key", "is_page")
    return ordered.mapInArrow(_sweep(default), f"page {kind}, host string, path string, rule string, verdict string")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "action string, host string, path string")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, rules).withColumnRenamed("page", "page_id")


SQL = """
WITH r(action, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), a AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a
), u AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path, row_number() OVER () AS n
  FROM p
), m AS (
  SELECT u.*, rhost || rpath AS rule, action,
         row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC, action DESC) AS k
  FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1
"""
