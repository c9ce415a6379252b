"""Planning: what is done with every file, decided by joins of the scan with the state of the last run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import paths as P
from folio.schema import MAX_BYTES, PIPELINE_VERSION, TRIVIAL_IMAGE_BYTES, TRIVIAL_IMAGE_PIXELS


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it and wherever a filter is pushed to."""
    return F.transform(F.array(value), body)[0]


def magic_kind(head: Column) -> Column:
    """What a file's first bytes say: a kind, container (a zip archive) or null."""
    return let(F.hex(F.substring(head, 1, 64)), _kind_of_hex)


def _kind_of_hex(code: Column) -> Column:
    brands = ("heic", "heix", "hevc", "mif1", "msf1", "heim", "heis")
    return (
        F.when(code.startswith("255044462D"), "pdf")
        .when(code.startswith("89504E470D0A1A0A") | code.startswith("FFD8FF") | code.startswith("474946383761") | code.startswith("474946383961"), "image")
        .when(code.startswith("52494646") & (F.substring(code, 17, 8) == "57454250"), "image")
        .when(code.startswith("49492A00") | code.startswith("4D4D002A"), "image")
        .when((F.substring(code, 9, 8) == "66747970") & F.substring(code, 17, 8).isin(*(b.encode().hex().upper() for b in brands)), "image")
        .when(code.startswith("504B0304"), "container")
    )


def image_pixels(head: Column) -> Column:
    """Width times height from the header of a PNG or GIF file; null elsewhere."""
    number = lambda at, n: F.conv(F.hex(F.substring(head, at, n)), 16, 10).cast("long")
    code = F.hex(F.substring(head, 1, 8))
    little = lambda at: number(at, 1) + 256 * number(at + 1, 1)
    return F.when(code == "89504E470D0A1A0A", number(17, 4) * number(21, 4)).when(code.startswith("47494638"), little(7) * little(9))


def identified(files: DataFrame) -> DataFrame:
    """Adds kind and notes to files (rel, head, container: the kind that a zip archive's entries say).

    The first bytes win over the extension, with a note where both say something else; without them only plain texts and
    unsupported formats are trusted to their extension. Empty files are unknown.
    """
    magic = let(magic_kind(F.col("head")), lambda m: F.when(m == "container", F.coalesce("container", F.lit("unknown"))).otherwise(m))
    said = F.struct(magic.alias("magic"), P.kind_by_extension(F.col("rel")).alias("name"))
    empty = F.coalesce(F.length("head"), F.lit(0)) == 0
    kind = let(said, lambda x: F.when(empty, "unknown").when(x["magic"].isNotNull(), x["magic"]).when(x["name"].isin("plaintext", "unsupported"), x["name"]).otherwise("unknown"))
    note = let(said, lambda x: F.when(empty, "empty").when(x["magic"].isNotNull() & x["name"].isNotNull() & (x["name"] != x["magic"]), "mismatch"))
    return files.withColumn("kind", kind).withColumn("notes", F.filter(F.array(note), lambda x: x.isNotNull()))


def classified(files: DataFrame, include_images: bool = True, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Adds action and reason to files (kind, bytes, pixels)."""
    trivial = (F.col("bytes") < TRIVIAL_IMAGE_BYTES) | F.coalesce(F.col("pixels") < TRIVIAL_IMAGE_PIXELS, F.lit(False))

    def why(kind: Column) -> Column:
        image = kind == "image"
        return (
            F.when(F.col("bytes") > max_bytes, "too_large")
            .when(kind == "unknown", "unknown_type")
            .when(kind == "unsupported", "unsupported")
            .when(image & (not include_images), "images_disabled")
            .when(image & trivial, "trivial_image")
        )

    reason = let(F.col("kind"), why)
    action = F.when(reason.isNotNull(), "skip").when(F.col("kind") == "plaintext", "register").otherwise("extract")
    return files.withColumn("reason", reason).withColumn("action", action)


def resolved(items: DataFrame, existing: DataFrame, known: DataFrame) -> DataFrame:
    """Settles who writes a target: items (rel, target, action, reason).

    A target that exists, isn't a known artifact and wasn't generated is never written. Of other items with one target the
    first by rel claims it. existing: (target, generated); known: (target). Losers become collisions without a target.
    """
    own = known.select("target").distinct().withColumn("is_known", F.lit(True))
    there = existing.groupBy("target").agg(F.bool_and("generated").alias("generated"))
    marked = items.join(there, "target", "left").join(own, "target", "left")
    blocked = F.col("generated").isNotNull() & ~F.col("generated") & F.col("is_known").isNull()
    marked = marked.withColumn("blocked", F.col("target").isNotNull() & blocked)
    # Items without a target claim nothing: each is a group of its own, not all of them one.
    order = Window.partitionBy(F.coalesce("target", F.concat(F.lit("-"), "rel")), "blocked").orderBy("rel")
    lost = F.when(F.col("blocked"), "target_exists").when(F.col("target").isNotNull() & (F.row_number().over(order) > 1), "target_collision")
    marked = marked.withColumn("lost", lost)
    return (
        marked.withColumn("action", F.when(F.col("lost").isNotNull(), "collision").otherwise(F.col("action")))
        .withColumn("reason", F.coalesce("lost", "reason"))
        .withColumn("target", F.when(F.col("lost").isNull(), F.col("target")))
        .drop("lost", "blocked", "generated", "is_known")
    )


def fingerprinted(items: DataFrame, prior: DataFrame, existing: DataFrame, config_digest: str, force: bool = False, by_hash: bool = False) -> DataFrame:
    """Items of unchanged files become `unchanged`.

    items: (rel, bytes, mtime_ns, target, action[, content_hash]); prior: (rel, bytes, mtime_ns, config_digest,
    pipeline_version[, content_hash]); existing: (target). With by_hash, a file with another time but equal bytes and hash
    counts as unchanged, too.
    """
    old = prior.select("rel", *[F.col(c).alias(f"prior_{c}") for c in prior.columns if c in ("bytes", "mtime_ns", "config_digest", "pipeline_version", "content_hash")])
    there = existing.select("target").distinct().withColumn("is_there", F.lit(True))
    joined = items.join(old, "rel", "left").join(there, "target", "left")
    same = F.col("mtime_ns") == F.col("prior_mtime_ns")
    if by_hash:
        same |= F.col("content_hash") == F.col("prior_content_hash")
    hit = (F.col("bytes") == F.col("prior_bytes")) & same & (F.col("prior_config_digest") == config_digest) & (F.col("prior_pipeline_version") == PIPELINE_VERSION)
    hit &= F.col("target").isNull() | F.col("is_there").isNotNull()
    open_ = F.col("action").isin("extract", "register") & F.lit(not force)
    out = joined.withColumn("action", F.when(open_ & F.coalesce(hit, F.lit(False)), "unchanged").otherwise(F.col("action")))
    return out.drop("is_there", *[c for c in out.columns if c.startswith("prior_")])


def without_artifacts(items: DataFrame, known: DataFrame) -> DataFrame:
    """Items (path, generated, ...) that aren't artifacts: neither on record (target) nor generated by their looks."""
    return items.where(~F.col("generated")).join(known.select(F.col("target").alias("path")).distinct(), "path", "left_anti").drop("generated")


def doubtful(items: DataFrame, prior: DataFrame, config_digest: str) -> DataFrame:
    """Adds doubtful: only a hash can tell whether the file changed, since all but its time is as it was."""
    old = prior.select("rel", F.col("bytes").alias("prior_bytes"), F.col("mtime_ns").alias("prior_mtime_ns"), F.col("config_digest").alias("prior_digest"), F.col("pipeline_version").alias("prior_version"))
    same = (F.col("bytes") == F.col("prior_bytes")) & (F.col("prior_digest") == config_digest) & (F.col("prior_version") == PIPELINE_VERSION)
    open_ = F.col("action").isin("extract", "register")
    marked = items.join(old, "rel", "left").withColumn("doubtful", F.coalesce(open_ & same & (F.col("mtime_ns") != F.col("prior_mtime_ns")), F.lit(False)))
    return marked.drop("prior_bytes", "prior_mtime_ns", "prior_digest", "prior_version")


def orphans(artifacts: DataFrame, expected: DataFrame, existing: DataFrame) -> DataFrame:
    """Known artifacts that exist and that no item writes any more."""
    return artifacts.select("target").distinct().join(expected.select("target"), "target", "left_anti").join(existing.select("target"), "target", "left_semi")


def left_over(orphans: DataFrame, written: DataFrame, gone: DataFrame) -> DataFrame:
    """Orphans (target) that were neither written in this run nor deleted."""
    return orphans.select("target").distinct().join(written.select("target"), "target", "left_anti").join(gone.select("target"), "target", "left_anti")


def status_orphans(records: DataFrame, artifacts: DataFrame, sources: DataFrame, existing: DataFrame) -> DataFrame:
    """Targets that are left over: of records (rel, target) whose source is gone, and artifacts that no record names."""
    named = records.where(F.col("target").isNotNull())
    gone = named.join(sources.select("rel"), "rel", "left_anti").select("target")
    unnamed = artifacts.select("target").join(named.select("target"), "target", "left_anti")
    return gone.union(unnamed).distinct().join(existing.select("target"), "target", "left_semi")


def prunable(paths: DataFrame, roots: list[str]) -> DataFrame:
    """Adds deletable: inside a root, there, and either generated or no Markdown (path, exists, generated)."""
    inside = F.lit(False)
    for root in roots:
        inside |= F.col("path").startswith(root.rstrip("/") + "/")
    markdown = F.lower("path").endswith(".md")
    return paths.withColumn("deletable", inside & F.col("exists") & (F.col("generated") | ~markdown))


def skip_records(items: DataFrame) -> DataFrame:
    """Records of items that aren't processed: collisions failed, others were skipped; notes stay as warnings."""
    return items.where("action IN ('skip', 'collision')").select("rel", "kind", F.when(F.col("action") == "collision", "failed").otherwise("skipped").alias("status"), F.col("reason").alias("skip_reason"), F.col("notes").alias("warnings"))
