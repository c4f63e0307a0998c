"""Text functions: normalisation, search keys, protected tokens, anchors, excerpts, risk floor.

All but Unicode normalisation and case folding are built-in column expressions; those two have
no built-in counterpart and run as Arrow UDFs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns that decide results and so must be exactly these.
PROTECTED = r"\[\[PT2-[0-9a-f]{12}:[^\]]+\]\]"
ANY_PROTECTED = r"\[\[PT2-[^\]]+\]\]"
URL = r"https?://[^\s<>()]+"
NUMBER = r"(?<![\w])\d+(?:[.,]\d+)*%?(?![\w])"
EQUATION = r"\b[A-Za-z]\s*=\s*[A-Za-z0-9][A-Za-z0-9^+\-*/().]*"
SCOPE_WORDS = (
    r"(?i)\b(?:not|no|never|neither|unless|except|only|must|shall|should|may|might|can|cannot|could|would"
    r"|at\s+least|at\s+most|more\s+than|less\s+than|respectively)\b"
)
#: Where such a word can begin, told by its first letter and the one before it: cheaper than ``\\b`` at every place.
SCOPE_START = "(?=[acelmnorsuwACELMNORSUW\u017f])(?<![A-Za-z])"
LATIN_WORD = r"(?i)\b[A-Z][A-Z'-]{1,}\b"
CJK = r"[㐀-鿿]"
SECRETS = (
    r"(?i)(api[_-]?key|token|password|secret)\s*[:=]\s*\S+",
    r"(?i)bearer\s+[A-Za-z0-9._~+/=-]+",
    r"\bsk-[A-Za-z0-9_-]{8,}\b",
)

# Python's classes are Unicode-aware; (?U) makes Java's so.
_U = "(?U)"


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC; null stays null."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def casefold(s: pd.Series) -> pd.Series:
    """Full case folding (``ß`` becomes ``ss``), which ``lower`` does not do."""
    return s.map(lambda x: None if x is None else x.casefold())


#: What normalisation may change, or more: no character below the combining marks is changed or joined.
NOT_NFC = r"[^\x{0}-\x{2ff}]"


def normalize_text(text: Column) -> Column:
    """Line ends become LF, then NFC.  Only texts that NFC may change go to Python."""
    lines = F.regexp_replace(text, "\r\n?", "\n")
    return F.coalesce(nfc(F.when(text.rlike(NOT_NFC), lines)), lines)


def fold(text: Column) -> Column:
    """:func:`casefold`; only texts beyond ASCII go to Python."""
    return F.coalesce(casefold(F.when(text.rlike(r"[^\x00-\x7f]"), text)), F.lower(text))


def strip(text: Column) -> Column:
    """Removes white space of any kind at both ends."""
    return F.regexp_replace(text, rf"{_U}^\s+|\s+$", "")


def blank(text: Column) -> Column:
    """Whether nothing would be left of a text by :func:`strip`, or it is null; reads up to its first character that is no white space."""
    return F.coalesce(~text.rlike(rf"{_U}\S"), F.lit(True))


def nonempty(text: Column) -> Column:
    """Normalised and stripped text; null where nothing is left."""
    return F.nullif(strip(normalize_text(text)), F.lit(""))


def language_tag(tag: Column) -> Column:
    """Trimmed, lower-case tag; null if blank or with inner white space."""
    t = F.lower(strip(tag))
    return F.when((t != "") & ~t.rlike(rf"{_U}\s"), t)


def search_text(text: Column) -> Column:
    """Search key: normalised, without any white space."""
    return F.regexp_replace(normalize_text(text), rf"{_U}[\s\x{{a0}}]+", "")


def literal_fragments(text: Column) -> Column:
    """Stripped parts between protected tokens that hold two searchable characters, one alphanumeric."""
    parts = F.transform(F.split(text, PROTECTED), strip)
    bare = lambda x: F.regexp_replace(x, rf"{_U}\s+", "")
    return F.filter(parts, lambda x: (F.length(bare(x)) >= 2) & x.rlike(rf"{_U}[\p{{L}}\p{{N}}]"))


def anchors(text: Column) -> Column:
    """Distinct URLs, standalone numbers and equations in order, without closing ``.,;:``."""
    # What each needs is looked for first: a search by the whole pattern tries it at every place.
    none = F.array().cast("array<string>")
    needs = ((text.contains("http"), _U + URL), (F.lit(True), rf"{_U}(?=\d)" + NUMBER), (text.contains("="), _U + EQUATION))
    found = F.concat(*(F.when(may, F.regexp_extract_all(text, F.lit(p), F.lit(0))).when(text.isNotNull(), none) for may, p in needs))
    bare = F.transform(found, lambda x: F.regexp_replace(x, "[.,;:]+$", ""))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda x: x != "")))


def visible(text: Column, images: Column, bare: Callable[[Column], Column] = strip) -> Column:
    """Whether a page shows text, of which ``bare`` leaves anything, or any image."""
    return (bare(F.coalesce(text, F.lit(""))) != "") | (F.coalesce(images, F.lit(0)) > 0)


def excerpt(text: Column, target: Column, radius: int = 180, bare: Callable[[Column], Column] = strip) -> Column:
    """The first case-insensitive hit with up to ``radius`` characters on both sides, made ``bare``; null if none.

    The text is split at the hit, so places are those of the text itself, also where other letters
    change their length between cases.
    """
    quoted = F.concat(F.lit(r"(?iu)\Q"), F.replace(target, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    parts = F.split(text, quoted, 2)
    before = F.element_at(parts, 1)
    hit = F.length(text) - F.length(before) - F.length(F.element_at(parts, -1))
    first = F.greatest(F.lit(1), F.length(before) + 1 - radius)
    upto = F.length(before) + 1 + hit + radius
    return F.when((F.size(parts) > 1) & (target != ""), bare(F.substring(text, first, upto - first)))


def redact(text: Column, limit: int | None = 2000) -> Column:
    """Replaces what looks like a secret in the first ``limit`` characters, or in all (``None``)."""
    out = text if limit is None else F.left(text, F.lit(limit))
    for pattern in SECRETS:
        out = F.regexp_replace(out, pattern, "[REDACTED]")
    return out


def filename_component(text: Column, default: str = "publication") -> Column:
    safe = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "-"), r"^[.-]+|[.-]+$", "")
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit(default))


def bounded(text: Column, limit: int | None = 500) -> Column:
    """One-line form of at most ``limit`` characters, or of all (``None``)."""
    line = strip(F.regexp_replace(text, rf"{_U}\s+", " "))
    return line if limit is None else F.left(line, F.lit(limit))


def _risks(text: Column, language: Column) -> tuple[Column, Column, Column]:
    bare = F.when(text.contains("[[PT2-"), F.regexp_replace(text, ANY_PROTECTED, " ")).otherwise(text)
    return (
        bare.rlike(rf"{_U}(?=\d)(?<![A-Za-z])\d"),
        bare.contains("http://") | bare.contains("https://"),
        F.lower(language).startswith("en") & bare.rlike(SCOPE_START + _U + SCOPE_WORDS),
    )


def risk_reasons(text: Column, language: Column) -> Column:
    """Deterministic reasons for care: numbers, URLs and, in English, words of scope."""
    names = ("protected numeric meaning", "source URL", "negation, modality or logical scope")
    return F.filter(F.array(*(F.when(c, F.lit(n)) for c, n in zip(_risks(text, language), names, strict=True))), lambda r: r.isNotNull())


def risk_floor(text: Column, language: Column) -> Column:
    """R2 if there is any of the :func:`risk_reasons`, which are looked for only up to the first."""
    number, url, scope = _risks(text, language)
    return F.when(number | url | scope, F.lit("R2")).otherwise(F.lit("R1"))


def untranslated(source: Column, target: Column, target_language: Column, source_terms: Column, renderings: Column, retained_terms: Column) -> Column:
    """Whether a Chinese target keeps nearly all translatable source text.

    ``source_terms`` leave the source, ``renderings`` and ``retained_terms`` the target before
    words are compared; protected tokens and URLs leave both.
    """
    drop = lambda text, terms: F.aggregate(terms, text, lambda acc, t: F.replace(acc, t, F.lit(" ")))
    bare = lambda text: F.regexp_replace(F.regexp_replace(text, ANY_PROTECTED, " "), rf"{_U}https?://\S+", " ")
    left, right = bare(drop(source, source_terms)), bare(drop(drop(target, renderings), retained_terms))
    words = F.regexp_extract_all(left, F.lit(LATIN_WORD), F.lit(0))
    n = F.size(words)
    # Words hold letters, apostrophes and hyphens only, so they need no quoting.
    kept = F.size(F.filter(words, lambda w: F.regexp_like(right, F.concat(F.lit(_U + r"(?i)\b"), w, F.lit(r"\b")))))
    cjk = F.regexp_count(right, F.lit(CJK))
    line = lambda text: fold(strip(F.regexp_replace(normalize_text(text), rf"{_U}\s+", " ")))
    mostly = ((n >= 2) & (kept >= 0.8 * n) & (cjk < F.greatest(F.lit(4), n * 2))) | ((n == 1) & (kept == 1) & (cjk == 0))
    return F.lower(target_language).startswith("zh") & (n > 0) & ((line(left) == line(right)) | mostly)
