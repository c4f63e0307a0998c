"""Terminology markers around governed renderings, and quoted spans."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import normalize_text, strip

_MARK = re.compile(r"⟪(/?)T:([^⟪⟫]+)⟫")
_SPAN = T.StructType([T.StructField("key", T.StringType()), T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])
DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("problem", T.StringType())])


def _decode(marked: str | None, required: dict[str, str]) -> tuple[str | None, list[tuple[str, int, int]] | None, str | None]:
    text = unicodedata.normalize("NFC", re.sub("\r\n?", "\n", marked or ""))
    out, spans, done, at = "", [], set(), 0
    opened: tuple[str, int] | None = None
    for m in _MARK.finditer(text):
        out += text[at : m.start()]
        at, key = m.end(), m[2]
        if key not in required:
            return None, None, "unknown marker"
        if not m[1]:
            if opened or key in done:
                return None, None, "nested or repeated"
            opened = (key, len(out))
        elif opened is None or opened[0] != key:
            return None, None, "unbalanced"
        elif out[opened[1] :] != required[key]:
            return None, None, "wrong rendering"
        else:
            spans.append((key, opened[1], len(out)))
            done.add(key)
            opened = None
    out += text[at:]
    if opened:
        return None, None, "not closed"
    if done != set(required):
        return None, None, "missing marker"
    if "⟪T:" in out or "⟪/T:" in out:
        return None, None, "leaked marker"
    return out, sorted(spans), None


@F.pandas_udf(DECODED)
def _decoded(marked: pd.Series, keys: pd.Series, renderings: pd.Series) -> pd.DataFrame:
    rows = [_decode(m, dict(zip(k, r, strict=True))) for m, k, r in zip(marked, keys, renderings, strict=True)]
    named = [(t, None if s is None else [dict(zip(("key", "s", "e"), x, strict=True)) for x in s], p) for t, s, p in rows]
    return pd.DataFrame(named, columns=["text", "spans", "problem"])


def decode_marked(marked: Column, required: Column) -> Column:
    """Removes balanced, flat markers and recovers their spans; ``problem`` names what is wrong instead.

    ``required`` maps each occurrence key to its exact rendering.  The scan keeps state, so it is
    an Arrow function.
    """
    return _decoded(marked, F.map_keys(required), F.map_values(required))


def marker_contract(guidance: Column) -> Column:
    """Key, rendering and both markers of each directive."""
    one = lambda g: F.struct(
        g["key"].alias("key"), g["rendering"].alias("rendering"), F.concat(F.lit("⟪T:"), g["key"], F.lit("⟫")).alias("open"), F.concat(F.lit("⟪/T:"), g["key"], F.lit("⟫")).alias("close")
    )
    return F.transform(guidance, one)


def quote_span(text: Column, quote: Column, declared: Column) -> Column:
    """0-based span of a quotation: the declared place if it fits, else the only hit, else a problem.

    A blank quotation gives null bounds without a problem.
    """
    t, q = normalize_text(text), strip(normalize_text(quote))
    n, first = F.length(q), F.instr(normalize_text(text), strip(normalize_text(quote)))
    fits = (declared >= 0) & (declared <= F.length(t) - n) & (F.substring(t, declared + 1, n) == q)
    again = F.instr(F.substring(t, first + n, F.length(t)), q) > 0
    at = F.when(q == "", None).when(F.coalesce(fits, F.lit(False)), declared).when((first > 0) & ~again, first - 1)
    return F.struct(at.cast("int").alias("s"), (at + n).cast("int").alias("e"), F.when((q != "") & at.isNull(), "absent or ambiguous").alias("problem"))
