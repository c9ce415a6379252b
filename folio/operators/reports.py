"""Reports and text rendering as string expressions over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import paths as P
from folio.functions import text as X
from folio.schema import PIPELINE_VERSION, PROBLEMS, SCHEMA_VERSION, STATUSES

#: What a reader should do with a document of each status.
ADVICE = {"ok": "include", "low": "not recommended", "empty": "not recommended", "garbled": "not recommended", "failed": "unusable", "skipped": "not processed", "registered": "include (plain text)"}


def status_place(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STATUSES)), status)


def status_counts(records: DataFrame) -> DataFrame:
    """status, n, place: counts in the order of the domain."""
    return records.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("place", status_place(F.col("status")))


def advice(status: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])
    return F.coalesce(table[status], status)


def notes(record: DataFrame) -> Column:
    """Remarks of an index row, joined: reason, error, pages by OCR, formulas, tables, partial."""
    has = lambda c: c in record.columns
    bits = [F.col(c) for c in ("skip_reason", "error") if has(c)]
    if has("ocr_pages"):
        bits.append(F.when(F.col("ocr_pages") > 0, F.concat(F.lit("OCR on "), F.col("ocr_pages").cast("string"), F.lit(" pages"))))
    bits += [F.when(F.col(c), text) for c, text in (("has_math", "formulas may be distorted"), ("has_tables", "tables"), ("partial", "partial")) if has(c)]
    return F.concat_ws("; ", *bits)


def index_rows(records: DataFrame) -> DataFrame:
    """rel, advice, note and the Markdown row of every record; the source is code, not a link, so that the index stands alone."""
    link = F.when(F.col("text_rel").isNotNull(), F.concat(F.lit("[text]("), P.quoted_path(F.col("text_rel")), F.lit(")"))).otherwise("-")
    pages = F.when(F.col("pages") > 0, F.col("pages").cast("string")).otherwise("-")
    row = F.concat(F.lit("| `"), "rel", F.lit("` | "), link, F.lit(" | "), "kind", F.lit(" | "), pages, F.lit(" | "), "status", F.lit(" | "), advice(F.col("status")), F.lit(" | "), notes(records), F.lit(" |"))
    return records.select("rel", P.top_dir(F.col("rel")).alias("top_dir"), advice(F.col("status")).alias("advice"), notes(records).alias("note"), row.alias("row"))


def shard_counts(records: DataFrame) -> DataFrame:
    """Per top directory: files and counts by status."""
    return records.groupBy(P.top_dir(F.col("rel")).alias("top_dir")).agg(F.count(F.lit(1)).alias("files"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES])


def warning_rows(records: DataFrame) -> DataFrame:
    """status, rel, ord, reason of records with a problem or a warning; error, skip reason, then warnings."""
    empty = F.array().cast("array<string>")
    reasons = F.concat(F.filter(F.array("error", "skip_reason"), lambda x: x.isNotNull()), F.coalesce("warnings", empty))
    problems = records.where(F.col("status").isin(*PROBLEMS) | (F.size(F.coalesce("warnings", empty)) > 0))
    shown = F.when(F.size(reasons) == 0, F.array(F.lit("no details"))).otherwise(reasons)
    return problems.select("status", "rel", F.posexplode(shown)).select("status", "rel", (F.col("pos") + 1).cast("long").alias("ord"), F.col("col").alias("reason"))


def front_matter(record: DataFrame, stamp: Column | None = None) -> Column:
    """YAML front matter; parts that don't hold (OCR, partial) are left out; generated_at only with a stamp."""
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value)
    text = lambda key: line(key, X.yaml_scalar(F.coalesce(F.col(key), F.lit(""))))
    plain = lambda key: line(key, F.col(key).cast("string"))
    ocr = F.when(F.size("ocr_pages_list") > 0, F.concat(F.lit("ocr:\n  backend: "), X.yaml_scalar(F.coalesce("ocr_backend", F.lit(""))), F.lit("\n  pages: ["), F.array_join(F.col("ocr_pages_list").cast("array<string>"), ", "), F.lit("]\n  chars: "), F.col("ocr_chars").cast("string"))) if "ocr_pages_list" in record.columns else F.lit(None).cast("string")
    return F.concat_ws(
        "\n", F.lit("---"), F.lit(f"schema_version: {SCHEMA_VERSION}"), line("source_rel", X.yaml_scalar(F.col("rel"))), plain("bytes"), text("content_hash"), text("kind"), plain("pages"), text("extractor"), text("text_layer"), ocr,
        plain("chars"), plain("chars_per_page_median"), line("quality", X.yaml_scalar(F.coalesce("quality", "status"))), plain("has_math"), plain("has_tables"), F.when(F.col("partial"), "partial: true"),
        X.yaml_list("removed_running_heads", F.col("removed_running_heads")), X.yaml_list("warnings", F.col("warnings")), *([line("generated_at", X.yaml_scalar(stamp))] if stamp is not None else []), F.lit(f"pipeline_version: {PIPELINE_VERSION}"), F.lit("---"),
    )


def page_block(label: str, number: Column, source: Column, body: Column) -> Column:
    """A page in a sidecar: heading, anchor and text; without a label the text alone."""
    shown = F.when(X.strip(body) == "", "(no extractable text)").otherwise(X.strip(body))
    if not label:
        return F.concat(shown, F.lit("\n"))
    anchor = F.concat(F.lit("<!-- page:"), number.cast("string"), F.when(source == "ocr", " ocr").otherwise(""), F.lit(" -->"))
    return F.concat(F.lit(f"## {label} "), number.cast("string"), F.lit("\n"), anchor, F.lit("\n\n"), shown, F.lit("\n"))


def sidecars(records: DataFrame, pages: DataFrame, label: str = "Page", stamp: Column | None = None) -> DataFrame:
    """(rel, text): front matter, title, provenance, notes and pages in order, one line feed at the end."""
    blocks = pages.select("rel", "page_no", page_block(label, F.col("page_no"), F.col("source"), F.col("text")).alias("block"))
    body = blocks.groupBy("rel").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "block"))), lambda x: x["block"]), "\n").alias("body"))
    span = F.when(F.col("pages") > 1, F.concat(F.lit("pages 1–"), F.col("pages").cast("string"))).otherwise("whole file")
    said = F.when(F.size("warnings") > 0, F.concat(F.array_join(F.transform("warnings", lambda x: F.concat(F.lit("> [!] "), x)), "\n"), F.lit("\n")))
    text = F.concat_ws("\n", front_matter(records, stamp), F.lit(""), F.concat(F.lit("# "), P.name_of(F.col("rel"))), F.lit(""), F.concat(F.lit("> Generated from `"), "rel", F.lit("`, "), span, F.lit(".")), F.lit(""), said, F.coalesce("body", F.lit("")))
    return records.join(body, "rel", "left").select("rel", F.concat(F.regexp_replace(text, "\n+$", ""), F.lit("\n")).alias("text"))


def run_summary(records: DataFrame, written: Column, orphans: DataFrame) -> DataFrame:
    """One row: files, written, orphans (a table), failed and whether any failed."""
    of_records = records.agg(F.count(F.lit(1)).alias("files"), F.count_if(written).alias("written"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.bool_or(F.col("status") == "failed"), F.lit(False)).alias("any_failed"))
    # One row beside one row.
    return of_records.join(F.broadcast(orphans.agg(F.count(F.lit(1)).alias("orphans"))), F.lit(True)).select("files", "written", "orphans", "failed", "any_failed")


def placed(rows: DataFrame, by: str) -> DataFrame:
    """Adds place, the row's number in the order of `by`: rows are numbered within ranges, and ranges' sizes are added up."""
    spread = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(spread, by).withColumn("part", F.spark_partition_id())
    ranged = ranged.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy(by)))
    # A row for each range.
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    return ranged.join(F.broadcast(before), "part").select(*rows.columns, (F.col("before") + F.col("own")).cast("long").alias("place"))


def first_orphans(orphans: DataFrame, n: int = 20) -> DataFrame:
    return orphans.orderBy("target").limit(n)


def progress(records: DataFrame) -> DataFrame:
    """An ordinal by rel within each top directory."""
    return records.select("rel", F.row_number().over(Window.partitionBy(P.top_dir(F.col("rel"))).orderBy("rel")).cast("long").alias("ordinal"))
