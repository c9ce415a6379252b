"""Line operators over (keys..., line_no, text): soft wraps, blank runs, running heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.schema import HEAD_BAND, HEAD_CHARS, HEAD_PAGES, SHORT_LINE


def explode_lines(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per line, line_no from 1."""
    return pages.select(*keys, F.posexplode(F.split(text, "\n"))).select(*keys, (F.col("pos") + 1).alias("line_no"), F.col("col").alias("text"))


def wrap_chunks(pages: DataFrame, keys: list[str], width: int = 60, text: str = "text") -> DataFrame:
    """A page as if set in lines of a fixed width."""
    chunks = F.regexp_extract_all(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit(f".{{1,{width}}}"), F.lit(0))
    return pages.select(*keys, F.posexplode(chunks)).select(*keys, (F.col("pos") + 1).alias("line_no"), F.col("col").alias("text"))


def _ladder(before: Column, now: Column) -> Column:
    """How two neighbouring lines would join: cat, dehyphen or space; null: they don't."""
    tail, head = F.right(before, F.lit(1)), F.left(now, F.lit(1))
    cjk = lambda c, marks: c.rlike(f"^{X.CJK}$") | F.instr(F.lit(marks), c).cast("boolean")
    hyphen = (tail == "-") & F.substring(before, -2, 1).rlike("[A-Za-z]") & (F.length(before) >= 2)
    small = head.rlike("[a-z]")
    return (
        F.when((before == "") | (now == "") | before.isNull(), None)
        .when(F.instr(F.lit(X.SENTENCE_END), tail) > 0, None)
        .when(cjk(tail, X.CJK_MARKS), F.when(cjk(head, X.CJK_MARKS), "cat"))
        .when(hyphen, F.when(small, "dehyphen"))
        .when((tail.rlike("[A-Za-z]") | (tail == ",")) & small, "space")
    )


def soft_wrap_kinds(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Adds line (stripped), short_cut, kind (of the join with the line before, by neighbours alone) and joins.

    A join needs a long enough line before it. That line may itself be joined: it is then at least as long as the first of
    its run that passed the test, so a running maximum over a run of joinable lines decides, and no fold is needed.
    """
    page = Window.partitionBy(*keys)
    order = page.orderBy("line_no")
    lines = lines.withColumn("line", X.strip(F.col("text")))
    length = F.length("line")
    lines = lines.withColumn("short_cut", F.coalesce(F.median(F.when(length > 0, length)).over(page), F.lit(0.0)) * SHORT_LINE)
    before = F.lag("line").over(order)
    lines = lines.withColumn("kind", _ladder(before, F.col("line"))).withColumn("long_before", F.length(before) >= F.col("short_cut"))
    lines = lines.withColumn("run", F.count_if(F.col("kind").isNull()).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    upto = Window.partitionBy(*keys, "run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    passed = F.max(F.when(F.col("kind").isNotNull(), F.col("long_before"))).over(upto)
    return lines.withColumn("joins", F.col("kind").isNotNull() & F.coalesce(passed, F.lit(False))).drop("long_before", "run")


def merge_soft_wraps(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text, merged_lines) of every page, soft-wrapped lines joined."""
    order = Window.partitionBy(*keys).orderBy("line_no")
    lines = soft_wrap_kinds(lines, keys)
    cut = F.lead("joins").over(order) & (F.lead("kind").over(order) == "dehyphen")
    body = F.when(cut, F.regexp_replace("line", "-$", "")).otherwise(F.col("line"))
    gap = F.when(F.row_number().over(order) == 1, "").when(~F.col("joins"), "\n").when(F.col("kind") == "space", " ").otherwise("")
    parts = lines.select(*keys, "line_no", F.concat(gap, body).alias("part"), (~F.col("joins")).cast("long").alias("starts"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "part"))), lambda x: x["part"]), "")
    return parts.groupBy(*keys).agg(joined.alias("text"), F.sum("starts").alias("merged_lines"))


def collapse_blanks(text: Column) -> Column:
    """No white space at line ends, at most one empty line in a row, none at either end."""
    text = F.regexp_replace(text, r"(?U)[\s&&[^\n]]+(?=\n|$)", "")
    return F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def unwrapped(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text) of every page from its lines (keys, line_no, text): cleaned, soft wraps merged, blanks collapsed."""
    cleaned = lines.select(*keys, "line_no", F.posexplode(F.split(X.clean(F.col("text")), "\n")).alias("sub", "text"))
    flat = cleaned.withColumn("line_no", F.row_number().over(Window.partitionBy(*keys).orderBy("line_no", "sub")))
    return merge_soft_wraps(flat, keys).select(*keys, collapse_blanks(F.col("text")).alias("text"))


def normalise_pages(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Clean, unwrapped and collapsed text of every page (keys, text)."""
    lines = explode_lines(pages.withColumn("text", X.clean(F.col("text"))), keys)
    return merge_soft_wraps(lines, keys).select(*keys, collapse_blanks(F.col("text")).alias("text"))


def in_band(y0: Column, y1: Column, height: Column) -> Column:
    """The line lies in the page's top or bottom margin; unknown places don't."""
    band = height * HEAD_BAND
    return F.coalesce((height > 0) & ((y0 <= band) | (F.coalesce(y1, y0) >= height - band)), F.lit(False))


def running_heads(pages: DataFrame, lines: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, key, n_pages) of lines that repeat over pages.

    pages: (doc, page_no, height); lines: (doc, page_no, line_no, text, y0, y1). Where every page of a document has a height
    and a line with a place, only lines in the margins count and three pages are enough; else all lines count and half the
    pages are needed, three at least. Documents of fewer pages have none.
    """
    placed = lines.groupBy(doc, "page_no").agg(F.bool_or(F.col("y0").isNotNull()).alias("has_place"))
    per_doc = (
        pages.join(placed, [doc, "page_no"], "left").groupBy(doc)
        .agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce((F.col("height") > 0) & F.col("has_place"), F.lit(False))).alias("by_place"))
        .where(F.col("n") >= HEAD_PAGES)
        .select(doc, "by_place", F.when(F.col("by_place"), HEAD_PAGES).otherwise(F.greatest(F.lit(HEAD_PAGES), F.floor(F.col("n") * 0.5))).alias("least"))
    )
    body = X.strip(F.col("text"))
    heights = pages.select(doc, "page_no", "height")
    counted = lines.join(heights, [doc, "page_no"]).join(per_doc, doc)
    counted = counted.where(F.length(body).between(1, HEAD_CHARS) & (~F.col("by_place") | in_band(F.col("y0"), F.col("y1"), F.col("height"))))
    keyed = counted.withColumn("key", X.head_key(body)).where("key <> ''")
    found = keyed.groupBy(doc, "key").agg(F.countDistinct("page_no").alias("n_pages"), F.first("least").alias("least"), F.first("by_place").alias("by_place"))
    return found.where("n_pages >= least").select(doc, "key", "n_pages", "by_place")


def without_heads(pages: DataFrame, lines: DataFrame, heads: DataFrame, doc: str = "doc") -> DataFrame:
    """The lines that aren't running heads; how long a line is only matters for counting."""
    keyed = lines.join(pages.select(doc, "page_no", "height"), [doc, "page_no"]).withColumn("key", X.head_key(X.strip(F.col("text"))))
    known = heads.select(F.col(doc).alias("head_doc"), F.col("key").alias("head_key"), "by_place")
    gone = (F.col(doc) == F.col("head_doc")) & (F.col("key") == F.col("head_key")) & (~F.col("by_place") | in_band(F.col("y0"), F.col("y1"), F.col("height")))
    return keyed.join(known, gone, "left_anti").drop("key", "height")
