"""Content-addressed identity: canonical JSON and namespaced SHA-256 digests.

Fields are written in sorted order with nulls kept.  Only strings, integers, booleans and
decimals as text may enter a digest; floating-point numbers have no canonical text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Our own namespaces.
NS_RECORD = "ledgerloom.record/1"
NS_REVISION = "ledgerloom.revision/1"
NS_MANIFEST = "ledgerloom.manifest/1"
NS_TERM = "ledgerloom.term/1"
NS_ATTEMPT = "ledgerloom.attempt/1"
NS_CALL = "ledgerloom.call/1"
NS_OPTION = "ledgerloom.option/1"
NS_AUTHORITY = "ledgerloom.authority/1"
NS_BRIEF = "ledgerloom.brief/1"
NS_SPAN = "ledgerloom.span/1"


def canonical_json(**fields: Column) -> Column:
    """JSON object of the fields in sorted order, without spaces, nulls kept."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def digest(namespace: str, **fields: Column) -> Column:
    """SHA-256 of ``{"namespace":…,"payload":{…}}``."""
    if not namespace.strip():
        raise ValueError("a digest needs a namespace")
    payload = F.struct(*(fields[k].alias(k) for k in sorted(fields)))
    return F.sha2(F.to_json(F.struct(F.lit(namespace).alias("namespace"), payload.alias("payload")), {"ignoreNullFields": "false"}), 256)


def sha256_text(text: Column) -> Column:
    return F.sha2(text, 256)


def is_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def utc_text(ts: Column) -> Column:
    """Microsecond ISO text of an instant in UTC."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def term_key(project: Column, source_term: Column, sense: Column) -> Column:
    return digest(NS_TERM, project=project, sense=sense, source_term=source_term)


def attempt_id(call_key: Column, ordinal: Column) -> Column:
    return digest(NS_ATTEMPT, call_key=call_key, ordinal=ordinal)


def call_key(stage: Column, dependency: Column) -> Column:
    """Cache key of a call: its stage and the digest of what it depends on, no slot hints."""
    return digest(NS_CALL, dependency=F.sha2(dependency, 256), stage=stage)


def marked(key: Column, rendering: Column) -> Column:
    """A rendering between the markers of its occurrence."""
    return F.concat(F.lit("⟪T:"), key, F.lit("⟫"), rendering, F.lit("⟪/T:"), key, F.lit("⟫"))
