"""Numbers, ranks, hosts and settings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Orders of the enumerations.
RISKS = ("R1", "R2", "R3")
CONVENTIONALITY = ("UNATTESTED", "RARE", "ATTESTED", "ESTABLISHED")
SERIOUS = ("MAJOR", "CRITICAL", "BLOCKING")
TIER_WEIGHT = {"A_AUTHORITY": 5, "B_DOMAIN": 4, "C_CORPUS": 2, "D_REFERENCE": 1, "E_WEAK": 0}
AUTHORITIES = {"termonline.cn": ("AUTHORITY_TERMBANK", "A_AUTHORITY"), "cnterm.cn": ("AUTHORITY_TERMBANK", "A_AUTHORITY"), "gov.cn": ("OFFICIAL_NAMING", "B_DOMAIN")}
SECRET_MARKERS = ("api_key", "token", "secret", "password", "credential")


def quantize_point(x: Column) -> Column:
    """Decimal text with three places, half to even; null for non-finite numbers."""
    d = F.when(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")), x).cast("decimal(20,6)")
    return F.bround(d, 3).cast("decimal(20,3)").cast("string")


def rank_of(value: Column, order: Sequence[str], first: int = 0) -> Column:
    """Ordinal of an enumeration value, null if unknown."""
    at = F.array_position(F.array(*(F.lit(v) for v in order)), value)
    return F.when(at > 0, (at + (first - 1)).cast("int"))


def enum_or(value: Column, allowed: Sequence[str], default: str | None) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def is_serious(severity: Column) -> Column:
    return severity.isin(*SERIOUS)


def retry_delay(ordinal: Column, hint: Column, base: float = 1.0, most: float = 30.0) -> Column:
    """Exponential backoff; a server's hint may lengthen it, ``most`` bounds both."""
    step = F.lit(base) * F.pow(F.lit(2.0), F.greatest(F.lit(0), ordinal - 1))
    return F.least(F.lit(most), F.greatest(step, F.coalesce(hint, F.lit(0.0))))


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def _under(h: Column, domain: str) -> Column:
    return (h == domain) | h.endswith("." + domain)


def _case(pairs: list[tuple[Column, Column]], default: Column) -> Column:
    return reduce(lambda rest, p: F.when(p[0], p[1]).otherwise(rest), reversed(pairs), default)


def classify_uri(url: Column) -> Column:
    """``struct(kind, tier)`` of the publishing host."""
    h = F.coalesce(host(url), F.lit(""))
    kinds = [(_under(h, d), F.struct(F.lit(k).alias("kind"), F.lit(t).alias("tier"))) for d, (k, t) in AUTHORITIES.items()]
    return _case(kinds, F.struct(F.lit("CORPUS_ATTESTATION").alias("kind"), F.lit("C_CORPUS").alias("tier")))


def authority_key(url: Column, declared: Column) -> Column:
    """Group key of evidence: the digest of its publishing authority, or of the declared source."""
    from .identity import NS_AUTHORITY, digest

    who = authority(url, declared)
    web, named = digest(NS_AUTHORITY, web_authority=F.substring(who, 5, 2**30)), digest(NS_AUTHORITY, declared_source=declared)
    return F.when(F.startswith(who, F.lit("web:")), web).otherwise(named)


def authority(url: Column, declared: Column) -> Column:
    """Who publishes: the host without ``www.``, known authorities joined, else the declared source."""
    h = F.regexp_replace(F.regexp_replace(F.coalesce(host(url), F.lit("")), r"\.$", ""), r"^www\.", "")
    web = F.lower(url).rlike("^https?://") & (h != "")
    known = _case([(_under(h, d), F.lit(d)) for d in AUTHORITIES], h)
    return F.when(web, F.concat(F.lit("web:"), known)).otherwise(F.concat(F.lit("declared:"), declared))


@F.pandas_udf(T.BooleanType())
def globally_routable(address: pd.Series) -> pd.Series:
    """Whether an IPv4 or IPv6 address is globally reachable by the special-purpose registries; false for anything else.

    The registries come with Python's ``ipaddress``, which also reads every notation of IPv6.
    """
    from ipaddress import ip_address

    def one(a: str | None) -> bool:
        try:
            return a is not None and ip_address(a).is_global
        except ValueError:
            return False

    return address.map(one)


@F.pandas_udf(T.BooleanType())
def has_secret_key(settings: pd.Series) -> pd.Series:
    """Whether any key of a JSON text, at any depth, names a secret; null for text that is no JSON.  Recursion needs Python."""
    import json

    def found(v: object) -> bool:
        if isinstance(v, dict):
            return any(any(m in str(k).lower().replace("-", "_") for m in SECRET_MARKERS) or found(x) for k, x in v.items())
        return isinstance(v, list) and any(map(found, v))

    def one(s: str | None) -> bool | None:
        try:
            return s is not None and found(json.loads(s))
        except (ValueError, RecursionError):
            return None

    return settings.map(one)


def ink_ratio(pixels: Column, bar: int = 245) -> Column:
    """Share of grey values below ``bar``; 0 for an empty raster."""
    n = F.size(pixels)
    return F.when(n > 0, F.size(F.filter(pixels, lambda p: p < bar)) / n).otherwise(F.lit(0.0))
