"""Ignore rules in the syntax of gitignore files, compiled to regular expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

FILE_NAME = ".folioignore"


def to_regex(pattern: str) -> str | None:
    """The regular expression over paths (directories end in a slash) of one pattern; None for blanks and comments."""
    pattern = re.sub(r"(?<!\\)\s+$", "", pattern)
    if not pattern or pattern.startswith("#"):
        return None
    only_dirs = pattern.endswith("/")
    body = pattern.strip("/") if only_dirs else pattern.lstrip("/")
    anchored = pattern.startswith("/") or "/" in body
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif body.startswith("**", i) and i + 2 == len(body) and (i == 0 or body[i - 1] == "/"):
            out, i = out + ".+", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in body[i + 2 :]:
            stop = body.index("]", i + 2)
            inner = body[i + 1 : stop].replace("\\", "\\\\").replace("[", "\\[")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", stop + 1
        elif c == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(c).replace("\\ ", " "), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if only_dirs else "(?:/|$)")


class IgnoreRules:
    """Rules in order; the last that fits a path decides."""

    def __init__(self, lines: Iterable[str]):
        self.rules: list[tuple[bool, str]] = []
        for line in lines:
            line = line.rstrip("\n")
            negated = line.startswith("!")
            found = to_regex(line[1:] if negated else line)
            if found:
                self.rules.append((not negated, found))

    def matches(self, rel: str, is_dir: bool = False) -> bool:
        path = rel + "/" if is_dir else rel
        return next((ignored for ignored, r in reversed(self.rules) if re.search(r, path)), False)

    def column(self, rel: Column) -> Column:
        out = F.lit(False)
        for ignored, r in self.rules:
            out = F.when(rel.rlike(r), F.lit(ignored)).otherwise(out)
        return out
