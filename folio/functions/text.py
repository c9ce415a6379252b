"""Text functions: columns in, columns out, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.schema import GARBLED_LATIN, GARBLED_PRIVATE, GARBLED_REPLACEMENT, GARBLED_TOKEN, MATH_DENSITY, MATH_MANY, MATH_SOME

SPACES = r"(?U)\s+"
#: Letters that soft wraps treat as CJK; quality counts the narrower set (fixed values).
CJK = r"[\x{2e80}-\x{2fdf}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ff66}-\x{ff9f}\x{20000}-\x{2ebef}]"
CJK_COUNTED = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"
#: Characters that end a sentence, and CJK punctuation (fixed values).
SENTENCE_END, CJK_MARKS = "。！？；：.!?;:…”’)》」』】", "。！？；：，、）」』】〉》”’"
MATH = "[∑∫∮√∂∇±≤≥≠≈≡∞αβγδεθλμπρσφψωΓΔΘΛΞΠΣΦΨΩ⊂⊃∪∩∈∉∀∃⇒⇔→←↔]"


def clean(text: Column) -> Column:
    """Line feeds alone, plain spaces, no invisible characters; private-use ones stay, since quality counts them."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[\x{00A0}\x{2007}\x{202F}]", " ")
    return F.regexp_replace(text, r"[\p{Cc}\p{Cf}\p{Cs}&&[^\n\t]]", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def nonspace(text: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.regexp_replace(text, SPACES, "")).cast("long")


def squeezed(text: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def head_key(text: Column) -> Column:
    """What lines that differ in their numbers only have in common; empty for a number alone."""
    key = F.regexp_replace(squeezed(text), r"\p{Nd}+", "%d")
    return F.when(key == "%d", "").otherwise(key)


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda x: x != "")


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def math_hits(text: Column) -> Column:
    """Mathematical symbols; plain ASCII, which has none, is skipped in runs first."""
    return count_of(F.regexp_replace(text, r"[\x00-\x7F]+", ""), MATH)


def has_math(text: Column) -> Column:
    """Many mathematical symbols, or some in a short text."""
    hits = math_hits(text)
    return (hits >= MATH_MANY) | ((hits >= MATH_SOME) & (hits / F.greatest(F.length(text), F.lit(1)) > MATH_DENSITY))


def replacement_ratio(text: Column) -> Column:
    return count_of(text, "�") / F.nullif(F.length(text), F.lit(0))


def private_ratio(text: Column) -> Column:
    """The share of private-use and unassigned characters (as of the Java runtime's Unicode version)."""
    return count_of(text, r"[\p{Co}\p{Cn}]") / F.nullif(F.length(text), F.lit(0))


def token_length(text: Column) -> Column:
    """Mean length of tokens, null without any: characters that aren't white space over tokens."""
    return nonspace(text) / F.nullif(F.size(tokens(text)), F.lit(0))


def garbled_flags(text: Column) -> dict[str, Column]:
    """The three signs of a broken text layer."""
    latin = count_of(text, "[A-Za-z]")
    return {
        "replacement": F.coalesce(replacement_ratio(text) > GARBLED_REPLACEMENT, F.lit(False)),
        "private": F.coalesce(private_ratio(text) > GARBLED_PRIVATE, F.lit(False)),
        "split": F.coalesce((latin >= GARBLED_LATIN) & (latin > count_of(text, CJK_COUNTED)) & (token_length(text) < GARBLED_TOKEN), F.lit(False)),
    }


def yaml_scalar(value: Column) -> Column:
    """A string as YAML: quoted where it is empty, has a special character or white space at an end; line breaks escaped."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    special = value.rlike(r"""[:#{}\[\]&*!|>%@`"'\n]""") | (strip(value) != value)
    return F.when(value == "", '""').when(special, quoted).otherwise(value)


def yaml_list(key: str, values: Column) -> Column:
    """A block list, or [] on the key's line."""
    items = F.array_join(F.transform(values, lambda x: F.concat(F.lit("  - "), yaml_scalar(x))), "\n")
    return F.when(F.size(values) == 0, f"{key}: []").otherwise(F.concat(F.lit(f"{key}:\n"), items))


def fixed(value: Column, places: int) -> Column:
    """A number with so many decimals, rounded as printf does: its exact binary value, ties to even.

    format_string rounds the shortest decimal half up instead.
    """
    return F.call_function("format_number", value, F.lit("0." + "0" * places))


def percent(share: Column) -> Column:
    return F.concat(fixed(100 * share, 1), F.lit("%"))
