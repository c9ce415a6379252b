"""The engine: plan, build and status of a document folder."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.config import Config
from folio.functions import paths as P
from folio.functions import text as X
from folio.operators import lines as L
from folio.operators import ocr, planning, quality, reports
from folio.schema import OCR_SIDE, PIPELINE_VERSION, RECORD, SHARD_FILES, STATUSES
from folio.sources import extract, files, sinks
from folio.sources.walk import walk


class OcrUnavailable(RuntimeError):
    """OCR is demanded but no backend is registered."""


def held(frame: DataFrame) -> DataFrame:
    """The frame, computed once and written to the checkpoint folder: several steps read it, and a lost executor costs a re-read.

    The folder is spark.checkpoint.dir; only where it is unset on a local master a temporary one is set.
    """
    context = frame.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        where = frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        if where is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(where or "file://" + tempfile.mkdtemp(prefix="folio-"))
    return frame.checkpoint()


@dataclass
class Plan:
    """items (rel, path, bytes, mtime_ns, kind, notes, action, reason, target, content_hash) and orphans (target), computed once.

    content_hash is there only where planning had to know it.
    """

    config: Config
    items: DataFrame
    orphans: DataFrame
    stale: int = 0

    def counts(self) -> dict[str, int]:
        return {r["action"]: r["count"] for r in self.items.groupBy("action").count().orderBy("action").collect()}


@dataclass
class Report:
    """What a run did: its records, the targets that are left over and those that were deleted (target), as tables."""

    records: DataFrame
    left: DataFrame
    gone: DataFrame
    written: int = 0
    stale: int = 0

    def counts(self) -> dict[str, int]:
        found = {r["status"]: r["n"] for r in reports.status_counts(self.records).collect()}
        return {s: found[s] for s in STATUSES if s in found}

    @property
    def orphans(self) -> list[str]:
        """For small folders and tests; `left` is the table."""
        return [r["target"] for r in self.left.orderBy("target").collect()]

    @property
    def pruned(self) -> list[str]:
        return [r["target"] for r in self.gone.orderBy("target").collect()]

    @property
    def failed(self) -> int:
        return self.counts().get("failed", 0)


class Engine:
    """normalise: what makes pages' texts of lines, L.unwrapped unless another set of rules is given."""

    def __init__(self, spark: SparkSession, normalise: Callable[[DataFrame, list[str]], DataFrame] = L.unwrapped):
        self.spark, self.normalise = spark, normalise

    # Planning

    def _stale(self, config: Config) -> DataFrame:
        """Artifacts of the other mode that are still there."""
        _, artifacts, _ = sinks.load_state(self.spark, config.other().meta_dir)
        return artifacts.join(files.there(artifacts), "target", "left_semi")

    def plan(self, config: Config) -> Plan:
        """Walks once and reads the beginnings of files once; a file is hashed only if all but its time speaks for no change."""
        if config.ocr == "only" and ocr.get_backend() is None:
            raise OcrUnavailable("ocr=only needs a registered backend")
        records, own, _ = sinks.load_state(self.spark, config.meta_dir)
        stale = held(self._stale(config))
        known = held(own.union(stale).distinct())
        marked = files.with_heads(walk(self.spark, config.root, config.follow_symlinks, [config.meta_dir, config.other().meta_dir]))
        items = planning.identified(marked).withColumn("pixels", F.coalesce(planning.image_pixels(F.col("head")), "file_pixels"))
        items = planning.classified(items, config.include_images, config.max_bytes)
        target = F.when(F.col("action") != "skip", P.target_path(F.col("rel"), F.col("kind"), config.mode, config.text_root))
        items = items.withColumn("target", target).select("rel", "path", "bytes", "mtime_ns", "kind", "notes", "action", "reason", "target", "generated")
        items = held(planning.without_artifacts(items, known))
        existing = held(files.there(items))
        items = planning.resolved(items, existing, known)
        if config.by_hash and not config.force:
            items = files.with_hashes(planning.doubtful(items, records, config.digest), F.col("doubtful")).drop("doubtful")
        else:
            items = items.withColumn("content_hash", F.lit(None).cast("string"))
        items = held(planning.fingerprinted(items, records, existing, config.digest, config.force, config.by_hash))
        lost = held(planning.orphans(known, items.where(F.col("target").isNotNull()), files.there(known)))
        return Plan(config, items, lost, stale.count())

    # Building

    def _pages(self, docs: DataFrame, config: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(pages, lines, ocr notes) of extracted documents, OCR'd pages' lines replaced."""
        pages = docs.select("rel", F.explode("document.pages").alias("p")).select("rel", F.col("p.number").alias("page_no"), "p.height", "p.source", "p.image_ratio", "p.lines")
        backend = None if config.ocr == "never" else ocr.get_backend()
        notes = self.spark.createDataFrame([], "rel string, ocr struct<backend:string,pages:array<int>,chars:bigint>, over boolean, ocr_notes array<string>")
        if backend is not None:
            pages, notes = self._recognized(docs, pages, config, backend)
        lines = pages.select("rel", "page_no", F.posexplode("lines")).select("rel", "page_no", F.col("pos").alias("line_no"), "col.text", "col.y0", "col.y1")
        return pages.drop("lines"), lines, notes

    def _recognized(self, docs: DataFrame, pages: DataFrame, config: Config, backend: ocr.OcrBackend) -> tuple[DataFrame, DataFrame]:
        """Pages without text go through the cache and the backend; the cache keeps every new result."""
        digest = ocr.cache_digest(config.digest, backend.name, config.ocr_dpi)
        work = docs.select("rel", "path", "kind", "content_hash", F.explode("document.pages_needing_ocr").alias("page_no"))
        work = held(ocr.capped(work, config.max_ocr_pages, "rel").withColumn("digest", F.lit(digest)))
        cache_path = f"{config.meta_dir}/cache/ocr"
        schema = f"content_hash string, page_no int, digest string, blocks {ocr.BLOCKS}"
        keys = ["content_hash", "page_no", "digest"]
        cache = self.spark.read.schema(schema).parquet(f"file://{cache_path}") if os.path.exists(cache_path) else self.spark.createDataFrame([], schema)
        _, misses = ocr.from_cache(work, cache.dropDuplicates(keys))
        images = held(_rendered(misses.dropDuplicates(["content_hash", "page_no"]), config.ocr_dpi))
        # Only pages that the cache lacks are added, so it holds each once but for runs that were cut off.
        ocr.recognized(images.where("reason IS NULL"), backend).write.mode("append").parquet(f"file://{cache_path}")
        cache = self.spark.read.schema(schema).parquet(f"file://{cache_path}").dropDuplicates(keys)
        hits, _ = ocr.from_cache(work, cache)
        found = held(hits.select("rel", "page_no", "blocks"))
        pages = ocr.replaced(pages, found, "rel")
        done = ocr.summary(found.withColumnRenamed("rel", "doc")).select(F.col("doc").alias("rel"), F.struct(F.lit(backend.name).alias("backend"), "pages", "chars").alias("ocr"))
        over = work.groupBy("rel").agg(F.bool_or("partial").alias("over"))
        said = lambda what: F.struct("page_no", F.concat(F.lit("page "), F.col("page_no").cast("string"), F.lit(": "), what).alias("note"))
        failed = work.join(images.where("reason IS NOT NULL").select(*keys, "reason"), keys).select("rel", said(F.col("reason")).alias("n"))
        blank = found.where(F.size("blocks") == 0).select("rel", said(F.lit("OCR read no text")).alias("n"))
        noted = failed.unionByName(blank).groupBy("rel").agg(F.transform(F.array_sort(F.collect_set("n")), lambda n: n["note"]).alias("ocr_notes"))
        return pages, over.join(done, "rel", "left").join(noted, "rel", "left").select("rel", "ocr", "over", "ocr_notes")

    def _texts(self, pages: DataFrame, lines: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
        """(pages with text, removed heads by rel)."""
        if config.keep_running_heads:
            heads = self.spark.createDataFrame([], "rel string, key string, n_pages long, by_place boolean")
        else:
            heads = L.running_heads(pages, lines, "rel")
            lines = L.without_heads(pages, lines, heads, "rel")
        texts = self.normalise(lines.select("rel", "page_no", "line_no", "text"), ["rel", "page_no"])
        removed = heads.groupBy("rel").agg(F.array_sort(F.collect_set("key")).alias("removed_running_heads"))
        return pages.select("rel", "page_no", "source").join(texts, ["rel", "page_no"], "left").withColumn("text", F.coalesce("text", F.lit(""))), removed

    def build(self, config: Config, dry_run: bool = False, on_record: Callable | None = None) -> Plan | Report:
        """Processes what changed, writes texts, state, INDEX and WARNINGS; with dry_run only the plan."""
        plan = self.plan(config)
        if dry_run:
            return plan
        os.makedirs(config.meta_dir, exist_ok=True)
        prior, own, _ = sinks.load_state(self.spark, config.meta_dir)
        work = f"file://{config.meta_dir}/work"
        # What is processed is hashed here, once; skipped and unchanged files are never opened again.
        new = F.col("action").isin("extract", "register") & F.col("known_hash").isNull()
        items = files.with_hashes(plan.items.withColumnRenamed("content_hash", "known_hash"), new)
        items.select(*[c for c in plan.items.columns if c != "content_hash"], F.coalesce("known_hash", "content_hash").alias("content_hash")).select(*plan.items.columns).write.mode("overwrite").parquet(f"{work}/items")
        items = self.spark.read.schema(plan.items.schema).parquet(f"{work}/items")
        plan.orphans.write.mode("overwrite").parquet(f"{work}/orphans")
        todo = items.where("action = 'extract'")
        # Extraction runs once: its result is written before several frames read it.
        todo.join(extract.extracted(todo.select("rel", "kind", "path"), config, config.ocr_page_threshold), "rel").write.mode("overwrite").parquet(f"{work}/documents")
        docs = self.spark.read.parquet(f"{work}/documents")
        pages, lines, notes = self._pages(docs, config)
        texts, heads = self._texts(pages, lines, config)
        texts.write.mode("overwrite").parquet(f"{work}/texts")
        texts = self.spark.read.schema(texts.schema).parquet(f"{work}/texts")
        records = self._records(items, docs, texts, heads, notes, prior, config)
        records.write.mode("overwrite").parquet(f"{work}/records")
        records = self.spark.read.schema(RECORD).parquet(f"{work}/records")
        sidecars = reports.sidecars(self._rendered_records(records, items), texts, stamp=F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))
        labels = docs.select("rel", F.col("document.page_label").alias("label"))
        plain = labels.where("label = ''").select("rel")
        unlabelled = reports.sidecars(self._rendered_records(records, items).join(plain, "rel", "left_semi"), texts, "", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))
        sidecars = sidecars.join(plain, "rel", "left_anti").unionByName(unlabelled)
        targets = items.where("action = 'extract'").select("rel", "target")
        written = sinks.write_texts(sidecars.join(targets, "rel"))
        written += sinks.copy_files(items.where("action = 'register' AND target IS NOT NULL"))
        artifacts = items.where("action IN ('extract', 'register', 'unchanged') AND target IS NOT NULL").select("target")
        gone = artifacts.limit(0)
        left = held(planning.left_over(self.spark.read.parquet(f"{work}/orphans"), artifacts, gone))
        if config.prune:
            marked = left.join(files.there(left), "target", "left").withColumn("generated", F.coalesce("generated", F.lit(False)))
            gone = held(sinks.pruned(marked, [os.path.abspath(config.root), config.meta_dir, config.other().meta_dir]))
            left = held(planning.left_over(left, artifacts, gone))
        # Orphans that stay are still artifacts: the next run must know them as its own.
        sinks.save_state(records, artifacts.union(left).distinct(), config.meta_dir)
        records, artifacts, _ = sinks.load_state(self.spark, config.meta_dir)
        report = Report(records, left, gone, written, plan.stale)
        head = {"root": os.path.abspath(config.root), "mode": config.mode, "out": config.out, "config_digest": config.digest, "summary": {"files": records.count(), "written": written, "orphans": left.count(), "pruned": gone.count()}}
        sinks.export_manifest(records, artifacts, config.meta_dir, head)
        write_index(records, config)
        write_warnings(records, config, plan.stale)
        if on_record is not None:
            for row in records.orderBy("rel").toLocalIterator():
                on_record(row)
        shutil.rmtree(f"{config.meta_dir}/work", ignore_errors=True)
        return report

    def _rendered_records(self, records: DataFrame, items: DataFrame) -> DataFrame:
        own = records.join(items.where("action = 'extract'").select("rel"), "rel", "left_semi")
        return own.withColumns({"ocr_backend": F.col("ocr.backend"), "ocr_pages_list": F.col("ocr.pages"), "ocr_chars": F.col("ocr.chars")})

    def _records(self, items: DataFrame, docs: DataFrame, texts: DataFrame, heads: DataFrame, notes: DataFrame, prior: DataFrame, config: Config) -> DataFrame:
        """Records of all items: extracted, registered, skipped, collided and carried over."""
        none = F.array().cast("array<string>")
        graded = quality.assess(texts, docs, "rel")
        math = texts.groupBy("rel").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]), "\n").alias("full")).select("rel", X.has_math(F.col("full")).alias("has_math"))
        d = F.col("document")
        joined = docs.join(graded, "rel", "left").join(math, "rel", "left").join(heads, "rel", "left").join(notes, "rel", "left")
        failed = d["reason"].isNotNull()
        read = F.size(F.coalesce("ocr.pages", F.array().cast("array<int>"))) > 0
        unread = (F.size(d["pages_needing_ocr"]) > 0) & ~F.coalesce(read, F.lit(False))
        heavy = F.when(F.size(d["image_heavy_pages"]) > 0, F.concat(F.lit("image-heavy pages: "), F.array_join(d["image_heavy_pages"].cast("array<string>"), ", ")))
        n_unread = F.size(d["pages_needing_ocr"]).cast("string")
        no_ocr = F.when(unread, F.concat(n_unread, F.lit(" pages have no text layer and weren't read: " + ("OCR is off (ocr=never)" if config.ocr == "never" else "no OCR backend is there" if ocr.get_backend() is None else "no page could be read"))))
        over = F.when(F.col("over"), f"only the first {config.max_ocr_pages} pages without text were read")
        warnings = F.filter(F.concat("notes", d["warnings"], F.coalesce("reasons", none), F.coalesce("ocr_notes", none), F.array(heavy, over, no_ocr)), lambda x: x.isNotNull())
        status = F.when(failed, "failed").otherwise(F.col("status"))
        text = {
            "status": status, "text_rel": _relative(F.col("target"), config), "extractor": F.when(read, F.concat_ws("+", d["extractor"], "ocr.backend")).otherwise(d["extractor"]), "skip_reason": d["reason"], "error": F.coalesce(d["message"], d["reason"]),
            "pages": F.when(d["total_pages"] > 0, d["total_pages"]).otherwise(F.size(d["pages"])).cast("long"), "chars": F.coalesce("chars", F.lit(0)).cast("long"), "chars_per_page_median": F.coalesce("median", F.lit(0)).cast("long"),
            "text_layer": d["text_layer"], "quality": F.when(~failed, F.col("status")), "has_math": F.coalesce("has_math", F.lit(False)), "has_tables": d["has_tables"], "partial": d["partial"] | F.coalesce("over", F.lit(False)),
            "ocr": F.col("ocr"), "removed_running_heads": F.coalesce("removed_running_heads", none), "warnings": F.when(failed, F.col("notes")).otherwise(warnings),
        }
        new = joined.select("rel", "kind", "bytes", "mtime_ns", "content_hash", *[c.alias(n) for n, c in text.items()])
        plain = items.where("action = 'register'").select("rel", "kind", "bytes", "mtime_ns", "content_hash", F.lit("registered").alias("status"), _relative(F.col("target"), config).alias("text_rel"), F.lit("passthrough").alias("extractor"), F.col("notes").alias("warnings"))
        skipped = planning.skip_records(items).join(items.select("rel", "bytes", "mtime_ns", "content_hash"), "rel")
        old = prior.join(items.where("action = 'unchanged'").select("rel", "mtime_ns"), "rel", "left_semi")
        # A file that is unchanged by its hash takes its new time, so that the next run needn't hash.
        times = items.where("action = 'unchanged'").select("rel", F.col("mtime_ns").alias("now_ns"))
        old = old.join(times, "rel").withColumn("mtime_ns", F.col("now_ns")).drop("now_ns")
        fresh = new.unionByName(plain, allowMissingColumns=True).unionByName(skipped, allowMissingColumns=True).withColumn("config_digest", F.lit(config.digest)).withColumn("pipeline_version", F.lit(PIPELINE_VERSION))
        every = fresh.unionByName(old, allowMissingColumns=True)
        blank = {"pages": F.lit(0), "chars": F.lit(0), "chars_per_page_median": F.lit(0), "text_layer": F.lit("n/a"), "has_math": F.lit(False), "has_tables": F.lit(False), "partial": F.lit(False), "removed_running_heads": none, "warnings": none, "duration_ms": F.lit(0)}
        return every.select(*[(F.coalesce(F.col(f.name), blank[f.name]) if f.name in blank and f.name in every.columns else blank.get(f.name, F.col(f.name) if f.name in every.columns else F.lit(None))).cast(f.dataType).alias(f.name) for f in RECORD])

    # Status

    def status(self, config: Config) -> Report:
        """What the state says, and the targets that are left over; nothing is written."""
        records, artifacts, found = sinks.load_state(self.spark, config.meta_dir)
        named = records.select("rel", F.when(F.col("text_rel").isNotNull(), P.joined(_base(config), F.col("text_rel"))).alias("target"))
        every = artifacts.union(named.where(F.col("target").isNotNull()).select("target")).distinct()
        sources = files.there(records.select(F.concat(F.lit(os.path.abspath(config.root) + "/"), "rel").alias("target"))).select(F.expr(f"substring(target, {len(os.path.abspath(config.root)) + 2})").alias("rel"))
        lost = planning.status_orphans(named, artifacts, sources, files.there(every))
        stale = self._stale(config) if found else artifacts.limit(0)
        left = held(lost.union(stale).distinct())
        return Report(records, left, left.limit(0), stale=stale.count())


def _base(config: Config) -> str:
    """What text_rel is relative to, for both fixed layouts."""
    return (config.text_root if config.mode == "in-place" else config.meta_dir) + "/"


def _relative(target: Column, config: Config) -> Column:
    return P.below(target, _base(config))


def images_of(path: str, kind: str, number: int, dpi: int) -> tuple[list[bytes], str | None]:
    """The images of a page: an image file itself, a slide's pictures, or a rasterised PDF page; else why there are none."""
    if kind == "pptx":
        try:
            found = extract.pictures(path, number)
        except Exception as error:
            return [], f"pptx_image_read_failed ({type(error).__name__}: {error})"
        return (found, None) if found else ([], "pptx_render_unavailable (the slide has no picture that could be read)")
    try:
        if kind == "image":
            with open(path, "rb") as file:
                return [file.read()], None
        if kind == "pdf":
            import pymupdf

            with pymupdf.open(path) as file:
                page = file.load_page(number - 1)
                scale = min(dpi / 72, OCR_SIDE / max(page.rect.width, page.rect.height))
                return [page.get_pixmap(matrix=pymupdf.Matrix(scale, scale), alpha=False).tobytes("png")], None
    except Exception as error:
        return [], f"ocr_rasterize_failed ({type(error).__name__}: {error})"
    return [], f"ocr_unsupported ({kind})"


def _rendered(work: DataFrame, dpi: int) -> DataFrame:
    """The images of pages (content_hash, page_no, digest, images), or the reason why there are none."""

    def add(it: Iterator) -> Iterator:
        for batch in it:
            found = [images_of(*x, dpi) for x in zip(*(batch.column(c).to_pylist() for c in ("path", "kind", "page_no")), strict=True)]
            yield pa.record_batch([*(batch.column(c) for c in ("content_hash", "page_no", "digest")), pa.array([x for x, _ in found], pa.list_(pa.binary())), pa.array([x for _, x in found], pa.string())], names=["content_hash", "page_no", "digest", "images", "reason"])

    return work.select("content_hash", "page_no", "digest", "path", "kind").mapInArrow(add, "content_hash string, page_no int, digest string, images array<binary>, reason string")


_HEADER = "| source | text | kind | pages | status | advice | notes |\n|---|---|---|---|---|---|---|\n"


def _summary(records: DataFrame) -> str:
    found = reports.status_counts(records).orderBy("place").collect()
    return f"{sum(r['n'] for r in found)} files: " + ", ".join(f"{r['status']} {r['n']}" for r in found) + "\n"


def write_index(records: DataFrame, config: Config) -> list[str]:
    """INDEX.md; from SHARD_FILES records on, a file per top directory and a table of them. Rows stream, they aren't gathered."""
    head = f"# Index\n\nMode `{config.mode}`, source `{os.path.abspath(config.root)}`.\n\n{_summary(records)}\n"
    rows = reports.index_rows(records.withColumn("ocr_pages", F.coalesce(F.size("ocr.pages"), F.lit(0))))
    index = f"{config.meta_dir}/INDEX.md"
    if records.count() <= SHARD_FILES:

        def body() -> Iterator[str]:
            yield head + _HEADER
            yield from (r["row"] + "\n" for r in rows.orderBy("rel").toLocalIterator())

        sinks.write_atomic(index, body())
        return [index]
    # No directory's name can clash: a percent sign is escaped in it, the group of the root has one.
    safe = F.when(F.col("top_dir") == "(root)", "%root").otherwise(F.replace("top_dir", F.lit("%"), F.lit("%25")))
    listed = F.concat_ws(", ", *[F.when(F.col(f"n_{s}") > 0, F.concat(F.lit(f"{s} "), F.col(f"n_{s}").cast("string"))) for s in STATUSES])
    shards = held(reports.shard_counts(records).withColumn("safe", safe).withColumn("counts", listed))
    heads = shards.select("top_dir", F.concat(F.lit(f"{config.meta_dir}/index/"), "safe", F.lit(".md")).alias("path"), F.concat(F.lit("# "), "top_dir", F.lit("\n\n"), F.col("files").cast("string"), F.lit(" files: "), "counts", F.lit("\n\n" + _HEADER)).alias("head"))
    sinks.write_sections(rows.join(heads, "top_dir").select("path", "head", F.col("rel").alias("place"), "row"))

    def nav() -> Iterator[str]:
        yield head + "| directory | files | list |\n|---|---|---|\n"
        for r in shards.orderBy("top_dir").toLocalIterator():
            yield f"| `{r['top_dir']}` | {r['files']} | [open](index/{r['safe'].replace('%', '%25').replace(' ', '%20')}.md) |\n"

    sinks.write_atomic(index, nav())
    return [index, *(f"{config.meta_dir}/index/{r['safe']}.md" for r in shards.orderBy("top_dir").toLocalIterator())]


def write_warnings(records: DataFrame, config: Config, stale: int = 0) -> str:
    rows = reports.warning_rows(records)
    counts = {r["status"]: r["n"] for r in rows.groupBy("status").agg(F.countDistinct("rel").alias("n")).collect()}
    path = f"{config.meta_dir}/WARNINGS.md"

    def body() -> Iterator[str]:
        yield "# Warnings\n\n"
        if stale:
            yield f"- **{stale} artifacts of the other mode are left**\n\n"
        if not counts:
            yield "No file needs attention.\n"
        status = rel = None
        for r in rows.orderBy("status", "rel", "ord").toLocalIterator():
            if r["status"] != status:
                yield f"{'' if status is None else chr(10)}## {r['status']} ({counts[r['status']]})\n\n"
                status, rel = r["status"], None
            if r["rel"] != rel:
                yield f"- `{r['rel']}`\n"
                rel = r["rel"]
            yield f"  - {r['reason']}\n"

    sinks.write_atomic(path, body())
    return path
