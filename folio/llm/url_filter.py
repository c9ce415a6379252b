"""URL filters by a sort-merge range join.

A host's labels in reverse, each followed by a dot, turn "this host and all its subdomains" into an interval of keys. Pages
and rules are dealt to ranges of keys (a rule goes to every range that its interval meets), sorted together and swept once:
a stack holds the rules' hosts whose intervals are open, innermost on top. Ranges are cut by page keys with their path and a
hash of the page, so a host, or a url, with a third of all rows is cut like any other.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.util import Scratch, only

#: Rows from which cuts are taken, code points of host and path that a cut looks at, and pages of a range, about.
CUT_SAMPLE, CUT_POINTS, RANGE_PAGES = 20_000, 100, 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
RULE_SCHEMA = "host string, path string, verdict string"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; null or no ://: empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """The labels in reverse, a dot after each: a host's subdomains are those whose keys its key starts."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class Sweep:
    """The stack of open rules over ascending keys."""

    def __init__(self):
        self.stack: list[tuple[str, dict[str, str], list[int]]] = []

    def close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, path: str, verdict: str) -> None:
        self.close(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, []))
        _, paths, lengths = self.stack[-1]
        # Of two rules with the same host and path, block wins.
        if paths.get(path) != "block":
            paths[path] = verdict
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)

    def find(self, key: str, path: str) -> tuple[str, str, str] | None:
        """(key, path, verdict) of the longest fitting rule: most characters in host and path together, then in the host."""
        self.close(key)
        best, most = None, (-1, -1)
        for host, paths, lengths in self.stack:
            for n in lengths:
                if n <= len(path) and (verdict := paths.get(path[:n])) is not None:
                    if (len(host) + n, len(host)) > most:
                        best, most = (host, path[:n], verdict), (len(host) + n, len(host))
                    break
        return best


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", range_pages: int = RANGE_PAGES) -> DataFrame:
    """Every page (page_id, url) with host, path, the longest fitting rule (host and path, else null) and the verdict.

    rules: host, path (a prefix; null is empty), verdict. Rules with a null or empty host or a null verdict fit nothing.
    Where no rule fits, the verdict is `otherwise`. Null and malformed urls have an empty host, which no rule fits. Repeated
    pages get a row each. An empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    url = F.col("url")
    keyed = only(pages, "page_id", "url").select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    keyed = keyed.withColumn("key", F.when(F.col("host") != "", host_key(F.col("host"))).otherwise(""))
    place = F.struct(F.substring("key", 1, CUT_POINTS).alias("a"), F.substring("path", 1, CUT_POINTS).alias("b"), F.xxhash64("page_id", "key", "path").alias("c"))
    placed = scratch.write(keyed.withColumn("place", place), "pages")
    ranges = max(-(-(n := placed.count()) // range_pages), min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)
    sample = sorted(tuple(x["place"]) for x in placed.orderBy(F.xxhash64("page_id", "place")).limit(CUT_SAMPLE).select("place").collect())
    cuts = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []
    cut_keys = [x[0] for x in cuts]

    def ranged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at = [bisect_right(cuts, (x["a"], x["b"], x["c"])) for x in batch.column("place").to_pylist()]
            none = pa.nulls(batch.num_rows, pa.string())
            yield pa.record_batch([pa.array(at, pa.int32()), batch.column("key"), pa.array([1] * batch.num_rows, pa.int32()), batch.column("path"), none, batch.column("page_id").cast(pa.int64()), batch.column("host")], names=names)

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for key, path, verdict in zip(*(batch.column(c).to_pylist() for c in ("key", "path", "verdict")), strict=True):
                low = key[:CUT_POINTS]  # cuts look no further
                rows += [(i, key, path, verdict) for i in range(bisect_left(cut_keys, low), bisect_right(cut_keys, low + "\U0010ffff") + 1)]
            n, columns = len(rows), list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.record_batch([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()), pa.array([0] * n, pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], names=names)

    def swept(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, current = Sweep(), None
        for batch in it:
            out: tuple[list, ...] = ([], [], [], [], [])
            for at, key, kind, path, verdict, page_id, host in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if at != current:
                    sweep, current = Sweep(), at
                if kind == 0:
                    sweep.open(key, path, verdict)
                    continue
                found = sweep.find(key, path) if key else None
                rule = None if found is None else ".".join(reversed(found[0][:-1].split("."))) + found[1]
                for column, value in zip(out, (page_id, host, path, rule, otherwise if found is None else found[2]), strict=True):
                    column.append(value)
            yield pa.record_batch([pa.array(out[0], pa.int64()), *(pa.array(x, pa.string()) for x in out[1:])], names=["page_id", "host", "path", "rule", "verdict"])

    names = ["range", "key", "kind", "path", "verdict", "page_id", "host"]
    schema = "range int, key string, kind int, path string, verdict string, page_id long, host string"
    usable = only(rules, "host", "path", "verdict").where("host <> '' AND verdict IS NOT NULL")
    usable = usable.select(host_key(F.translate("host", UPPER, LOWER)).alias("key"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    events = placed.mapInArrow(ranged, schema).unionByName(usable.mapInArrow(spread, schema))
    # A host's rules (kind 0) come before its pages; keys sort in the order of their bytes, as intervals need.
    return events.repartition(ranges, "range").sortWithinPartitions("range", "key", "kind").mapInArrow(swept, "page_id long, host string, path string, rule string, verdict string")


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(RULES, RULE_SCHEMA))


OP10_SQL = r"""
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fitting AS (
  SELECT p.page_id, p.host, p.path, r.*, row_number() OVER (PARTITION BY p.page_id ORDER BY length(rule_host) + length(rule_path) DESC NULLS LAST, length(rule_host) DESC) AS place
  FROM parsed p LEFT JOIN rules r ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)
)
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(rule_verdict, 'allow') AS verdict FROM fitting WHERE place = 1
"""
