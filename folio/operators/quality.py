"""Quality of documents from their pages' texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.schema import EMPTY_CHARS, LOW_CHARS, LOW_MEDIAN


def assess(pages: DataFrame, docs: DataFrame | None = None, doc: str = "doc", page: str = "page_no") -> DataFrame:
    """(doc, chars, nonspace, median, status, reasons) of every document.

    pages: (doc, page_no, text). A page is reduced to counts before anything moves; documents of docs without a page count
    as one empty page. reasons are the signs of the tier that decided, with their figures.
    """
    t = F.col("text")
    counts = {"chars": F.length(t), "nonspace": X.nonspace(t), "fffd": X.count_of(t, "�"), "private": X.count_of(t, r"[\p{Co}\p{Cn}]"), "latin": X.count_of(t, "[A-Za-z]"), "cjk": X.count_of(t, X.CJK_COUNTED), "tokens": X.count_of(t, r"(?U)\S+")}
    per_page = pages.select(doc, *[c.cast("long").alias(n) for n, c in counts.items()])
    summed = per_page.groupBy(doc).agg(*[F.sum(n).alias(n) for n in counts if n != "chars"], (F.sum("chars") + F.count(F.lit(1)) - 1).alias("chars"), F.median("nonspace").cast("long").alias("median"))
    if docs is not None:
        summed = docs.select(doc).join(summed, doc, "left").fillna(0)
    share = lambda c: F.col(c) / F.nullif(F.col("chars"), F.lit(0))
    flags = {
        "replacement": share("fffd") > X.GARBLED_REPLACEMENT,
        "private": share("private") > X.GARBLED_PRIVATE,
        "split": (F.col("latin") >= X.GARBLED_LATIN) & (F.col("latin") > F.col("cjk")) & (F.col("nonspace") / F.nullif(F.col("tokens"), F.lit(0)) < X.GARBLED_TOKEN),
    }
    figures = {
        "replacement": F.concat(F.lit("replacement characters "), X.percent(share("fffd")), F.lit(" (over 1%)")),
        "private": F.concat(F.lit("private-use or unassigned characters "), X.percent(share("private")), F.lit(" (over 5%)")),
        "split": F.concat(F.lit("mean token length "), X.fixed(F.col("nonspace") / F.nullif(F.col("tokens"), F.lit(0)), 2), F.lit(" (under 1.5)")),
        "median": F.concat(F.lit("median characters of a page "), F.col("median").cast("string"), F.lit(f" (under {LOW_MEDIAN})")),
        "chars": F.concat(F.lit("characters "), F.col("chars").cast("string"), F.lit(f" (under {LOW_CHARS})")),
    }
    said = lambda named: F.filter(F.array(*[F.when(c, figures[n]) for n, c in named.items()]), lambda x: x.isNotNull())
    garbled, low = said(flags), said({"median": F.col("median") < LOW_MEDIAN, "chars": F.col("chars") < LOW_CHARS})
    status = F.when(F.col("nonspace") < EMPTY_CHARS, "empty").when(F.size(garbled) > 0, "garbled").when(F.size(low) > 0, "low").otherwise("ok")
    reasons = F.when(status == "empty", F.array(F.concat(F.lit("characters that aren't white space "), F.col("nonspace").cast("string"), F.lit(f" (under {EMPTY_CHARS})")))).when(status == "garbled", garbled).when(status == "low", low).otherwise(F.array().cast("array<string>"))
    return summed.select(doc, "chars", "nonspace", "median", status.alias("status"), reasons.alias("reasons"))
