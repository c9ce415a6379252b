"""Settings of a run: defaults, TOML files and explicit values, in rising order of weight."""

from __future__ import annotations

import hashlib
import json
import os
import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path

from folio.schema import MAX_BYTES, MODES, OCR_DPI, OCR_MODES, OCR_PAGE_CHARS, OCR_PAGES

TOML_NAME = ".folio.toml"
META_DIR, MIRROR_SUFFIX = "_folio", ".folio"
#: What a TOML file may set, and what the digest of a run's settings covers.
TOML_KEYS = ("jobs", "max_bytes", "ocr", "include_images", "max_ocr_pages", "keep_running_heads", "follow_symlinks")
DIGEST_KEYS = ("ocr", "include_images", "keep_running_heads", "max_bytes", "max_ocr_pages", "ocr_page_threshold", "ocr_dpi")


def parse_size(text: str) -> int:
    """Bytes of a literal such as 512MiB, 10k or 1.5g; units are powers of 1024."""
    body = str(text).strip().lower().removesuffix("b").removesuffix("i")
    power = "kmgt".find(body[-1:]) + 1 if body else 0
    return int(float(body[:-1] if power else body) * 1024**power)


@dataclass(frozen=True)
class Config:
    root: str
    mode: str = "mirror"
    out: str | None = None
    ocr: str = "auto"
    jobs: int = 0
    force: bool = False
    prune: bool = False
    by_hash: bool = True
    include_images: bool = True
    keep_running_heads: bool = False
    follow_symlinks: bool = False
    max_bytes: int = MAX_BYTES
    max_ocr_pages: int = OCR_PAGES
    ocr_page_threshold: int = OCR_PAGE_CHARS
    ocr_dpi: int = OCR_DPI

    def __post_init__(self):
        if self.mode not in MODES or self.ocr not in OCR_MODES:
            raise ValueError(f"mode is one of {MODES}, ocr one of {OCR_MODES}")
        if self.out and self.mode == "in-place":
            raise ValueError("out goes with mirror mode only")
        root = os.path.abspath(self.root)
        if self.out and (root + "/").startswith(os.path.abspath(self.out).rstrip("/") + "/"):
            raise ValueError("out must not be the root or contain it")

    @property
    def digest(self) -> str:
        """A short hash of the settings that change texts; the mode isn't one."""
        body = json.dumps({k: getattr(self, k) for k in DIGEST_KEYS}, sort_keys=True, separators=(",", ":"))
        return hashlib.blake2b(body.encode(), digest_size=8).hexdigest()

    @property
    def meta_dir(self) -> str:
        root = os.path.abspath(self.root)
        if self.mode == "in-place":
            return f"{root}/{META_DIR}"
        return os.path.abspath(self.out) if self.out else root + MIRROR_SUFFIX

    @property
    def text_root(self) -> str:
        return os.path.abspath(self.root) if self.mode == "in-place" else f"{self.meta_dir}/text"

    def other(self) -> Config:
        """The same root in the other mode, at its default place."""
        return replace(self, mode="mirror" if self.mode == "in-place" else "in-place", out=None)


def read_toml(path: Path) -> dict:
    """Known keys of a file, flat or under [build]; nothing if there is no file; ValueError if it can't be read as TOML."""
    try:
        found = tomllib.loads(path.read_text("utf-8"))
    except FileNotFoundError:
        return {}
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as error:
        raise ValueError(f"{path}: {error}") from error
    found = found.get("build", found)
    return {k: parse_size(v) if k == "max_bytes" and isinstance(v, str) else v for k, v in found.items() if k in TOML_KEYS}


def load_config(root: str, home: Path | None = None, **explicit: object) -> Config:
    """explicit values win over the root's TOML file, that over the user's, that over the defaults; None says nothing."""
    user = (home or Path.home()) / ".config" / "folio" / "config.toml"
    known = {f.name for f in fields(Config)}
    given = {k: v for k, v in explicit.items() if v is not None and k in known}
    return Config(root=root, **(read_toml(user) | read_toml(Path(root) / TOML_NAME) | given))


def infer_mode(root: str, out: str | None = None) -> str:
    """The mode whose state is there; in place if there is none."""
    if out:
        return "mirror"
    for mode in ("in-place", "mirror"):
        if os.path.exists(f"{Config(root=root, mode=mode).meta_dir}/state"):
            return mode
    return "in-place"
