"""Paths as columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.schema import EXTENSIONS


def name_of(rel: Column) -> Column:
    return F.element_at(F.split(rel, "/"), -1)


def extension(rel: Column) -> Column:
    """The last suffix in lower case, with its dot; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(name_of(rel), r"(?s)^.+(\.[^.]+)$", 1))


def kind_by_extension(rel: Column) -> Column:
    """Null for an extension that says nothing."""
    return F.create_map(*[F.lit(x) for x in chain(*EXTENSIONS.items())])[extension(rel)]


def sidecar_path(rel: Column, text_root: str) -> Column:
    return F.concat(F.lit(text_root + "/"), rel, F.lit(".md"))


def target_path(rel: Column, kind: Column, mode: str, text_root: str) -> Column:
    """Where a file's text goes: a sidecar; a plain text is copied in mirror mode and stays where it is in place."""
    plain = F.concat(F.lit(text_root + "/"), rel) if mode == "mirror" else F.lit(None).cast("string")
    return F.when(kind == "plaintext", plain).otherwise(sidecar_path(rel, text_root))


def below(path: Column, base: str) -> Column:
    """The path relative to a folder that it lies in; so records stay true when the tree moves."""
    return F.substring(path, F.lit(len(base.rstrip("/")) + 2), F.length(path))


def joined(base: str, rel: Column) -> Column:
    """The reverse of below()."""
    return F.concat(F.lit(base.rstrip("/") + "/"), rel)


def top_dir(rel: Column, root: str = "(root)") -> Column:
    """The first directory; files at the top are a group of their own, whose name no directory can have in an escaped file name."""
    return F.when(F.instr(rel, "/") > 0, F.split_part(rel, F.lit("/"), F.lit(1))).otherwise(root)


def quoted_path(path: Column) -> Column:
    """Percent-encoded as in a link: slashes stay, spaces are %20."""
    return F.replace(F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~"))


def has_artifact_name(rel: Column) -> Column:
    """Two suffixes, the second .md: a sidecar's name."""
    return F.lower(name_of(rel)).rlike(r"(?s)^.+\.[^.]+\.md$")


def is_generated(rel: Column, head: Column) -> Column:
    """A sidecar by its name and by a pipeline_version in the front matter that its head begins with."""
    front = F.regexp_extract(head, r"(?s)^---\r?\n(.*?)\r?\n---(\r?\n|$)", 1)
    return F.coalesce(has_artifact_name(rel) & (F.concat(F.lit("\n"), front)).rlike(r"\npipeline_version:"), F.lit(False))


def dir_excluded(rel: Column, ignored: tuple[str, ...]) -> Column:
    """Any directory on the way is hidden or ignored, or the file itself is hidden."""
    parts = F.split(rel, "/")
    return F.exists(parts, lambda p: p.startswith(".")) | F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(*ignored))
