"""Secret scans in DataFrame expressions: three known shapes, and a battery of randomness tests for anything else.

A candidate is a run of 20 or more characters of the usual encodings. From its characters an encoding is inferred (hex,
base32, base64, url-safe base64); three tests then measure how unlike writing it is: the chi-squared statistic of its symbols
against a uniform alphabet, the number of runs of character classes (digits, capitals, small letters), and the serial
correlation of neighbouring symbols. Each statistic is compared with what names and words written in that alphabet would
give, so its p-value falls as the string is more random and longer. Stouffer's sum combines the three, and the Benjamini-Hochberg rule
is applied within bands of length, from a histogram of p-values of fixed size instead of a global sort.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.util import Scratch, join_checked, only

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of hex digits, or capitals and digits after AKIA, is taken whole by any match, so the least length can stand in the pattern.
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: What of a candidate that fits no encoding is tested: runs in each encoding's own alphabet, = only behind them.
PIECES = ("[0-9a-f]{20,}", "[0-9A-F]{20,}", "[A-Z2-7]{20,}=*", "[A-Za-z0-9+/]{20,}={0,2}", "[A-Za-z0-9_-]{20,}={0,2}", "[A-Za-z0-9]{20,}={0,2}")
KINDS = ("assign", "access", "hex", "random")
PATTERNS = (ASSIGN, ACCESS, HEX, CANDIDATE)
LEAST_VALUE = 6
#: Lower ends of the bands of length, the rate of false discoveries allowed in each, and steps of the p-value histogram (a tenth of a decade).
BANDS, FALSE_RATE, STEPS = (20, 28, 40, 64, 128), 0.05, 400

#: (name, pattern, alphabet, sum of squared symbol shares in writing, share of class changes in writing, serial correlation in writing).
#: Measured on 40 000 names of three to nine words of the given documents and of programs with a number, in camel case for base64 (the
#: most random style; paths and names with - and _ lie below), in capitals for base32, as words of a to f and as digits for hex.
ENCODINGS = [
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.110, 0.12, 0.25),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.055, 0.06, 0.20),
    ("base64", "^[A-Za-z0-9+/]+={0,2}$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.040, 0.33, 0.15),
    ("base64url", "^[A-Za-z0-9_-]+={0,2}$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 0.040, 0.33, 0.15),
]


def _pick(encoding: Column, values: list) -> Column:
    return reduce(lambda out, x: out.when(encoding == x[0][0], F.lit(x[1])), zip(ENCODINGS[1:], values[1:], strict=True), F.when(encoding == ENCODINGS[0][0], F.lit(values[0])))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def tail(z: Column) -> Column:
    """The chance of a standard normal above z, by a logistic with a cubic term (within 2e-4)."""
    return 1 / (1 + F.exp(F.least(1.5976 * z + 0.07056 * z * z * z, F.lit(700.0))))


def battery(candidates: DataFrame, column: str = "hit") -> DataFrame:
    """Adds encoding (null: none fits or only one class of characters), n and p to rows with a candidate string."""
    hit = F.col(column)
    encoding = reduce(lambda out, x: out.when(hit.rlike(x[1]), x[0]), ENCODINGS[1:], F.when(hit.rlike(ENCODINGS[0][1]), ENCODINGS[0][0]))
    out = candidates.withColumn("encoding", F.when(hit.rlike("[0-9]") & hit.rlike("[A-Za-z]"), encoding))
    out = out.withColumn("core", F.when(F.col("encoding") == "hex", F.lower(hit)).otherwise(F.regexp_replace(hit, "=+$", "")))
    out = out.withColumn("n", F.length("core").cast("double")).withColumn("alphabet", _pick(F.col("encoding"), [x[2] for x in ENCODINGS]))
    out = out.withColumn("k", F.length("alphabet").cast("double"))
    symbols = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    out = out.withColumn("counts", F.transform(symbols(F.col("alphabet")), lambda s: F.col("n") - F.length(F.replace(F.col("core"), s, F.lit("")))))
    out = out.withColumn("places", F.transform(symbols(F.col("core")), lambda s: F.instr(F.col("alphabet"), s).cast("double")))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("core"), "[0-9]+", "0"), "[A-Z]+", "A"), "[a-z]+", "a")
    out = out.withColumn("changes", F.length(classes).cast("double") - 1)
    n, k = F.col("n"), F.col("k")
    out = out.withColumn("chi", _total(F.transform("counts", lambda c: c * c)) * k / n - n)
    out = out.withColumn("mean", _total(F.col("places")) / n)
    out = out.withColumn("off", F.transform("places", lambda x: x - F.col("mean")))
    spread, both = _total(F.transform("off", lambda x: x * x)), _total(F.zip_with(F.slice("off", 1, F.size("off") - 1), F.slice("off", 2, F.size("off") - 1), lambda a, b: a * b))
    out = out.withColumn("serial", F.when(spread > 0, both / spread).otherwise(1.0))
    excess = k * _pick(F.col("encoding"), [x[3] for x in ENCODINGS]) - 1
    switch, relation = _pick(F.col("encoding"), [x[4] for x in ENCODINGS]), _pick(F.col("encoding"), [x[5] for x in ENCODINGS])
    out = out.withColumn("z_chi", (k - 1 + (n - 1) * excess - F.col("chi")) / F.sqrt(2 * (k - 1) + 4 * n * excess))
    out = out.withColumn("z_runs", (F.col("changes") - (n - 1) * switch) / F.sqrt((n - 1) * switch * (1 - switch)))
    out = out.withColumn("z_serial", (relation - F.col("serial")) * F.sqrt(n))
    out = out.withColumn("p", tail((F.col("z_chi") + F.col("z_runs") + F.col("z_serial")) / 3**0.5))
    return out.drop("core", "alphabet", "k", "counts", "places", "changes", "chi", "mean", "off", "serial")


def discovered(tested: DataFrame, rate: float = FALSE_RATE) -> DataFrame:
    """Adds `chosen`: the Benjamini-Hochberg rule at the given rate within each band of length."""
    n = F.col("n")
    tested = tested.withColumn("band", reduce(lambda out, x: out.when(n >= x, x), reversed(BANDS[:-1]), F.when(n >= BANDS[-1], BANDS[-1])).otherwise(BANDS[0]))
    step = F.least(F.floor(-10 * F.log10(F.greatest("p", F.lit(1e-300)))), F.lit(STEPS)).cast("int")
    tested = tested.withColumn("step", F.when(F.col("encoding").isNotNull(), step))
    histogram = tested.groupBy("band", "step").agg(F.count(F.lit(1)).alias("held"))
    whole = Window.partitionBy("band")
    above = whole.orderBy(F.desc_nulls_last("step")).rowsBetween(Window.unboundedPreceding, 0)
    allowed = F.sum("held").over(whole) * F.pow(F.lit(10.0), -F.col("step") / 10) <= rate * F.sum("held").over(above)
    cuts = histogram.select("band", "step", allowed.alias("allowed")).where("allowed AND step IS NOT NULL").groupBy("band").agg(F.min("step").alias("cut"))
    # At most len(BANDS) rows.
    return tested.join(F.broadcast(cuts), "band", "left").withColumn("chosen", F.coalesce(F.col("step") >= F.col("cut"), F.lit(False)))


def matches(keyed: DataFrame, patterns: tuple[str, ...] = PATTERNS) -> DataFrame:
    """(row_key, kind, start, stop, hit) of all leftmost non-overlapping matches; positions count code points.

    The text before each match and the match itself, in turn, make up the text, so running sums of their lengths give the
    positions. Only lengths and matches travel, not texts.
    """
    text = F.col("text")

    def of_kind(kind: int, pattern: str) -> Column:
        both = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda h, g: F.struct(F.lit(kind).alias("kind"), h.alias("hit"), F.length(g).alias("gap")))
        return F.filter(both, lambda x: x["hit"].isNotNull())  # the text after the last match has no match beside it

    found = [of_kind(i, p) for i, p in enumerate(patterns)]
    rows = keyed.select("row_key", F.posexplode(F.concat(*found)).alias("place", "m")).select("row_key", "place", "m.*")
    upto = Window.partitionBy("row_key", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.length("hit")).over(upto)
    return rows.select("row_key", "kind", (stop - F.length("hit")).alias("start"), stop.alias("stop"), "hit")


def pieces_of(candidates: DataFrame) -> DataFrame:
    """Candidates (row_key, start, stop, hit): those that fit no encoding also by their PIECES, each stretch once."""
    fits = reduce(or_, [F.col("hit").rlike(x[1]) for x in ENCODINGS])
    keyed = candidates.where(~fits).select(F.concat_ws("@", "row_key", "start").alias("row_key"), F.col("hit").alias("text"))
    found = matches(keyed, PIECES)
    base = F.substring_index("row_key", "@", -1).cast("long")
    found = found.select(F.regexp_replace("row_key", "@[0-9]+$", "").alias("row_key"), (base + F.col("start")).alias("start"), (base + F.col("stop")).alias("stop"), "hit")
    return candidates.select("row_key", "start", "stop", "hit").unionByName(found.dropDuplicates(["row_key", "start", "stop"]))


def _listed(base_only: bool) -> Column:
    spans = F.filter("spans", lambda s: s["kind"] < 3) if base_only else F.col("spans")
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def keyed_rows(docs: DataFrame) -> DataFrame:
    """The rows with row_key, which tells apart all rows that differ in doc_id or text."""
    return docs.withColumn("row_key", F.concat_ws(":", "doc_id", F.xxhash64("text")))


def spans_of(keyed: DataFrame, rate: float = FALSE_RATE) -> DataFrame:
    """Per row_key with any span: n_assign, n_access, n_hex, n_random and spans, sorted structs (start, kind, stop).

    Candidates that fit no encoding (NAME=value, a value after a path) are also tested piece by piece. Of chosen candidates that
    overlap, the first stays, of those that begin together the longest.
    """
    scratch = Scratch(keyed.sparkSession, "secrets")
    any_hit = reduce(or_, [F.col("text").rlike(p) for p in PATTERNS])
    # Rows that are equal in doc_id and text have equal spans: one of them is looked at.
    hits = only(keyed, "row_key", "text").where(any_hit).groupBy("row_key").agg(F.first("text").alias("text"))
    valid = (F.col("kind") != 0) | (F.length(F.regexp_extract("hit", ASSIGN, 2)) >= LEAST_VALUE)
    found = scratch.write(matches(hits).where(valid), "matches")
    base = found.where("kind < 3").select("row_key", "kind", "start", "stop")
    tested = scratch.write(pieces_of(found.where("kind = 3").select("row_key", "start", "stop", "hit")), "pieces")
    chosen = discovered(battery(tested), rate).where("chosen").select("row_key", F.lit(3).alias("kind"), "start", "stop")
    # A piece goes where a chosen one begins before it, or with it and is longer, and reaches into it.
    before = Window.partitionBy("row_key").orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    chosen = chosen.withColumn("before", F.max("stop").over(before)).where("coalesce(before <= start, true)").drop("before")
    by_place = Window.partitionBy("row_key").orderBy("start", "kind", "stop")
    of_base = lambda c: F.when(F.col("kind") < 3, F.col(c))
    spans = base.unionByName(chosen).select("*", F.max(of_base("stop")).over(by_place.rowsBetween(Window.unboundedPreceding, 0)).alias("closed"), F.min(of_base("start")).over(by_place.rowsBetween(0, Window.unboundedFollowing)).alias("next"))
    spans = spans.where("kind < 3 OR (coalesce(closed <= start, true) AND coalesce(next >= stop, true))")
    count = lambda kind: F.count_if(F.col("kind") == kind).alias(f"n_{KINDS[kind]}")
    return spans.groupBy("row_key").agg(*map(count, range(4)), F.sort_array(F.collect_list(F.struct("start", "kind", "stop"))).alias("spans"))


def secrets(docs: DataFrame, rate: float = FALSE_RATE) -> DataFrame:
    """Every document (doc_id, text) with its secrets.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:stop, comma-joined, by start and then kind)
    and n_random. Kinds: assign (a keyword, then a value of 6 characters or more), access, hex, and random: candidates, or
    pieces of candidates that fit no encoding, that the battery discovers and that touch no other span. Only those with a digit
    and a letter are tested. Null or empty text has none; very long texts are scanned whole. Every row gives one row, repeated
    ones too; a null doc_id is allowed. An empty table gives no rows; other columns are ignored.
    """
    keyed = keyed_rows(only(docs, "doc_id", "text"))
    per_doc = spans_of(keyed, rate).select("row_key", *[f"n_{x}" for x in KINDS], _listed(True).alias("base"), _listed(False).alias("spans"))
    out = keyed.select("doc_id", "row_key").join(per_doc, "row_key", "left")
    return out.select("doc_id", *[F.coalesce(f"n_{x}", F.lit(0)).cast("long").alias(f"n_{x}") for x in KINDS[:3]], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_random", F.lit(0)).cast("long").alias("n_random"))


def redacted(docs: DataFrame, mark: str = "[SECRET]", rate: float = FALSE_RATE, **checked: int) -> DataFrame:
    """The documents, all columns, with every stretch of overlapping secrets in text replaced by the mark; n_chars follows, if there.

    Rows without secrets come back as they are, null and empty texts too; see secrets() for what a secret is. Every row gives
    one row, repeated ones too; of overlapping base spans the whole stretch goes. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "redacted")
    found = scratch.write(spans_of(keyed_rows(only(docs, "doc_id", "text")), rate).select("row_key", "spans"), "spans")
    size = found.agg(F.sum(F.size("spans") * 20 + 60)).first()[0] or 0
    # Names of the helping columns that no document column has.
    key, spans = (f"_folio_{name}" + "_" * max([0, *map(len, docs.columns)]) for name in ("key", "spans"))
    # An array of kept stretches and marks; `upto` is the end of what is done.
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.array().cast("array<string>").alias("parts"))
    text = F.col("text")

    def step(done: Column, span: Column) -> Column:
        new = span["start"].cast("long") >= done["upto"]
        parts = F.when(new, F.concat(done["parts"], F.array(F.substring(text, done["upto"].cast("int") + 1, (span["start"] - done["upto"]).cast("int")), F.lit(mark)))).otherwise(done["parts"])
        return F.struct(F.greatest(done["upto"], span["stop"].cast("long")).alias("upto"), parts.alias("parts"))

    clean = F.aggregate(spans, start, step, lambda done: F.concat(F.array_join(done["parts"], ""), F.substring(text, done["upto"].cast("int") + 1, F.length(text))))
    keyed = docs.withColumn(key, F.concat_ws(":", "doc_id", F.xxhash64("text")))
    none = F.col(spans).isNull()
    joined = join_checked(keyed, found.select(F.col("row_key").alias(key), F.col("spans").alias(spans)), key, "left", size, **checked)
    joined = joined.withColumn("text", F.when(none, text).otherwise(clean))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(none, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same scan in SQL, written from the contract, with patterns and constants of its own: positions from running sums, the
#: battery over lists, the histogram rule by windows.
OP5_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS row_key, doc_id, coalesce(text, '') AS t FROM documents),
cut AS (SELECT row_key, 0 AS kind, regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS hits, regexp_split_to_array(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS gaps FROM texts
  UNION ALL SELECT row_key, 1, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_split_to_array(t, 'AKIA[A-Z0-9]+') FROM texts
  UNION ALL SELECT row_key, 2, regexp_extract_all(t, '[0-9a-f]+'), regexp_split_to_array(t, '[0-9a-f]+') FROM texts
  UNION ALL SELECT row_key, 3, regexp_extract_all(t, '[A-Za-z0-9+/_=-]+'), regexp_split_to_array(t, '[A-Za-z0-9+/_=-]+') FROM texts),
listed AS (SELECT row_key, kind, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS place FROM cut),
placed AS (SELECT row_key, kind, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY row_key, kind ORDER BY place)::BIGINT AS stop FROM listed),
matched AS (SELECT row_key, kind, hit, stop - length(hit) AS start, stop FROM placed
  WHERE length(CASE kind WHEN 0 THEN regexp_extract(hit, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?(.*)$', 1) ELSE hit END) >= CASE kind WHEN 0 THEN 6 WHEN 1 THEN 20 WHEN 2 THEN 24 ELSE 20 END),
runs AS (SELECT row_key, start, stop, hit, regexp_full_match(hit, '[0-9a-f]+|[0-9A-F]+|[A-Z2-7]+=*|[A-Za-z0-9+/]+={0,2}|[A-Za-z0-9_-]+={0,2}') AS fits FROM matched WHERE kind = 3),
-- What fits no encoding is cut into the longest runs of each alphabet.
odd AS (SELECT row_number() OVER () AS run, * FROM runs WHERE NOT fits),
odd_cut AS (SELECT run, 0 AS kind, regexp_extract_all(hit, '[0-9a-f]{20,}') AS hits, regexp_split_to_array(hit, '[0-9a-f]{20,}') AS gaps FROM odd
  UNION ALL SELECT run, 1, regexp_extract_all(hit, '[0-9A-F]{20,}'), regexp_split_to_array(hit, '[0-9A-F]{20,}') FROM odd
  UNION ALL SELECT run, 2, regexp_extract_all(hit, '[A-Z2-7]{20,}=*'), regexp_split_to_array(hit, '[A-Z2-7]{20,}=*') FROM odd
  UNION ALL SELECT run, 3, regexp_extract_all(hit, '[A-Za-z0-9+/]{20,}={0,2}'), regexp_split_to_array(hit, '[A-Za-z0-9+/]{20,}={0,2}') FROM odd
  UNION ALL SELECT run, 4, regexp_extract_all(hit, '[A-Za-z0-9_-]{20,}={0,2}'), regexp_split_to_array(hit, '[A-Za-z0-9_-]{20,}={0,2}') FROM odd
  UNION ALL SELECT run, 5, regexp_extract_all(hit, '[A-Za-z0-9]{20,}={0,2}'), regexp_split_to_array(hit, '[A-Za-z0-9]{20,}={0,2}') FROM odd),
odd_listed AS (SELECT run, kind, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS place FROM odd_cut),
odd_placed AS (SELECT run, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY run, kind ORDER BY place)::BIGINT AS upto FROM odd_listed),
candidates AS (SELECT row_key, start, stop, hit FROM runs
  UNION ALL SELECT DISTINCT o.row_key, o.start + p.upto - length(p.hit), o.start + p.upto, p.hit FROM odd_placed p JOIN odd o USING (run)),
encoded AS (SELECT *, CASE WHEN NOT regexp_matches(hit, '[0-9]') OR NOT regexp_matches(hit, '[A-Za-z]') THEN NULL WHEN regexp_full_match(hit, '[0-9a-f]+|[0-9A-F]+') THEN 'hex' WHEN regexp_full_match(hit, '[A-Z2-7]+=*') THEN 'base32'
  WHEN regexp_full_match(hit, '[A-Za-z0-9+/]+={0,2}') THEN 'base64' WHEN regexp_full_match(hit, '[A-Za-z0-9_-]+={0,2}') THEN 'base64url' END AS encoding FROM candidates),
cored AS (SELECT *, CASE WHEN encoding = 'hex' THEN lower(hit) ELSE regexp_replace(hit, '=+$', '') END AS core,
  CASE encoding WHEN 'hex' THEN '0123456789abcdef' WHEN 'base32' THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' WHEN 'base64' THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/' WHEN 'base64url' THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_' END AS alphabet,
  CASE encoding WHEN 'hex' THEN 0.110 WHEN 'base32' THEN 0.055 ELSE 0.040 END AS squares, CASE encoding WHEN 'hex' THEN 0.12 WHEN 'base32' THEN 0.06 ELSE 0.33 END AS switch, CASE encoding WHEN 'hex' THEN 0.25 WHEN 'base32' THEN 0.20 ELSE 0.15 END AS relation FROM encoded),
sized AS (SELECT *, length(core)::DOUBLE AS n, length(alphabet)::DOUBLE AS k, CASE WHEN length(core) >= 128 THEN 128 WHEN length(core) >= 64 THEN 64 WHEN length(core) >= 40 THEN 40 WHEN length(core) >= 28 THEN 28 ELSE 20 END AS band FROM cored),
counted AS (SELECT *, list_transform(string_split(core, ''), lambda c: instr(alphabet, c)::DOUBLE) AS places, list_sum(list_transform(string_split(alphabet, ''), lambda c: power(n - length(replace(core, c, '')), 2))) * k / n - n AS chi,
  length(regexp_replace(regexp_replace(regexp_replace(core, '[0-9]+', '0', 'g'), '[A-Z]+', 'A', 'g'), '[a-z]+', 'a', 'g'))::DOUBLE - 1 AS changes FROM sized WHERE encoding IS NOT NULL),
centred AS (SELECT *, list_transform(places, lambda x: x - list_sum(places) / n) AS off FROM counted),
related AS (SELECT *, list_sum(list_transform(off, lambda x: x * x)) AS spread, list_sum(list_transform(generate_series(1, n::BIGINT - 1), lambda i: off[i] * off[i + 1])) AS both_ FROM centred),
scored AS (SELECT *, ((k - 1 + (n - 1) * (k * squares - 1) - chi) / sqrt(2 * (k - 1) + 4 * n * (k * squares - 1)) + (changes - (n - 1) * switch) / sqrt((n - 1) * switch * (1 - switch)) + (relation - CASE WHEN spread > 0 THEN both_ / spread ELSE 1 END) * sqrt(n)) / sqrt(3) AS z FROM related),
stepped AS (SELECT row_key, start, stop, band, least(floor(-10 * log10(greatest(1 / (1 + exp(least(1.5976 * z + 0.07056 * z * z * z, 700))), 1e-300))), 400)::INT AS step FROM scored),
-- Candidates without an encoding count among those tested.
histogram AS (SELECT band, step, count(*) AS held FROM (SELECT band, step FROM stepped UNION ALL SELECT band, NULL FROM sized WHERE encoding IS NULL) GROUP BY ALL),
cuts AS (SELECT band, min(step) AS least_step FROM (SELECT band, step, sum(held) OVER (PARTITION BY band) * power(10.0, -step / 10.0) <= 0.05 * sum(held) OVER (PARTITION BY band ORDER BY step DESC NULLS LAST ROWS UNBOUNDED PRECEDING) AS allowed FROM histogram) WHERE allowed AND step IS NOT NULL GROUP BY band),
chosen AS (SELECT row_key, start, stop FROM (SELECT row_key, start, stop, max(stop) OVER (PARTITION BY row_key ORDER BY start, stop DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM stepped JOIN cuts USING (band) WHERE step >= least_step) WHERE coalesce(before <= start, true)),
spans AS (SELECT row_key, kind, start, stop FROM matched WHERE kind < 3
  UNION ALL SELECT row_key, 3, start, stop FROM chosen c WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.kind < 3 AND m.row_key = c.row_key AND m.start < c.stop AND m.stop > c.start)),
shown AS (SELECT row_key, kind, start, list_extract(['assign', 'access', 'hex', 'random'], kind + 1) || ':' || start || ':' || stop AS shown FROM spans),
per_doc AS (SELECT row_key, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_random,
  string_agg(shown, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(shown, ',' ORDER BY start, kind) AS spans FROM shown GROUP BY row_key)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_random, 0) AS n_random
FROM texts LEFT JOIN per_doc USING (row_key)
"""
