"""Append-only ledgers: approvals, calls, attempts, leases, budgets; state derived, never updated."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.folders import cut, drop_cut
from .fold import ordered_fold


class Conflict(RuntimeError):
    """A write-once slot already holds other data."""


def history(revisions: DataFrame, key: str, seq: str, payload: str) -> DataFrame:
    """Revisions in order with their predecessor and whether they are current.

    Expected to be few per key (a unit's revisions), so one window serves all three.
    """
    w = Window.partitionBy(key).orderBy(seq)
    last = Window.partitionBy(key).orderBy(F.desc(seq))
    return revisions.withColumns({
        "ordinal": F.row_number().over(w),
        "supersedes": F.lag(payload).over(w),
        "active": F.row_number().over(last) == 1,
    })


def latest(revisions: DataFrame, key: str, seq: str) -> DataFrame:
    """The current revision of each key, by partial aggregation."""
    cols = [c for c in revisions.columns if c != key]
    return revisions.groupBy(key).agg(F.max_by(F.struct(*cols), seq).alias("_r")).select(key, "_r.*")


def resolve_active(active: DataFrame, revisions: DataFrame, units: DataFrame, records: DataFrame) -> DataFrame:
    """Active pointer → revision → unit → record."""
    return active.join(revisions, "approval_id").join(units, "unit_key").join(records, "record_key")


def pointed(pointer: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows that a pointer table names."""
    return rows.join(pointer.select(key), key)


def write_once(stored: DataFrame, incoming: DataFrame, key: str, payload: str) -> DataFrame:
    """``key, state`` per incoming key: ``new``, ``replay`` (equal to what is stored) or ``conflict``.

    Equal rows of one key in a batch are one; different ones conflict, whatever is stored.
    """
    seen = incoming.groupBy(key).agg(F.min(F.struct(payload)).alias("_lo"), F.max(F.struct(payload)).alias("_hi"))
    held = stored.select(key, F.col(payload).alias("_held"), F.lit(True).alias("_there"))
    clash = (F.col("_lo") != F.col("_hi")) | (F.col("_there").isNotNull() & ~F.col(f"_lo.{payload}").eqNullSafe(F.col("_held")))
    return seen.join(held, key, "left").select(key, F.when(clash, "conflict").when(F.col("_there"), "replay").otherwise("new").alias("state"))


def insert_once(stored: DataFrame, incoming: DataFrame, key: str, payload: str) -> DataFrame:
    """The rows to append to a write-once table, one a key; raises :class:`Conflict` rather than drop different data."""
    states = write_once(stored, incoming, key, payload)
    if clash := states.where("state = 'conflict'").orderBy(key).limit(5).collect():
        raise Conflict(f"{key} already holds different data: {', '.join(str(r[key]) for r in clash)}")
    return incoming.join(states.where("state = 'new'").select(key), key, "left_semi").dropDuplicates([key])


def classify_error(kind: Column) -> Column:
    """Whether an error may be retried."""
    return kind.isin("rate_limit", "transient", "timeout", "connection", "os_error")


def retryable_status(code: Column) -> Column:
    """Error class of an HTTP status."""
    return F.when(code == 429, "rate_limit").when(code.isin(408, 409) | (code >= 500), "transient").when(code >= 400, "permanent").otherwise("ok")


def call_status(attempts: DataFrame, limit: int = 3) -> DataFrame:
    """Status per call from its attempts (``call, ordinal, outcome``)."""
    return attempts.groupBy("call").agg(F.count("*").alias("n_attempts"), F.max_by("outcome", "ordinal").alias("last"), F.bool_or(F.col("outcome") == "SUCCEEDED").alias("ok")).select(
        "call", "n_attempts",
        F.when(F.col("ok"), "SUCCEEDED").when(F.col("last") == "PERMANENT_FAILURE", "FAILED_PERMANENT").when(F.col("n_attempts") >= limit, "EXHAUSTED")
        .when(F.col("last") == "RUNNING", "RUNNING").otherwise("PENDING").alias("status"),
    )


def pending_calls(calls: DataFrame, status: DataFrame) -> DataFrame:
    """Calls to make: without a result and not terminal.  Cached results never reach the budget."""
    done = status.where(F.col("status").isin("SUCCEEDED", "FAILED_PERMANENT", "EXHAUSTED"))
    return calls.join(done.select("call"), "call", "left_anti")


def cached_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    return calls.join(results, "call")


def admit_by_budget(attempts: DataFrame, scope: str, order: list[str], cost: str, cap: float, max_calls: int | None = None) -> DataFrame:
    """Which attempts a budget admits, in order; refused ones are not charged, so a later smaller one may fit.

    Returns ``scope`` and per attempt the order columns, ``admitted`` and the ``spent`` total after it.
    """

    def add(state: tuple[float, int], row: tuple) -> tuple[tuple[float, int], tuple]:
        spent, calls = state
        fits = spent + row[0] <= cap and (max_calls is None or calls < max_calls)
        state = (spent + row[0], calls + 1) if fits else state
        return state, (fits, state[0])

    rows = attempts.select(scope, *order, F.col(cost).cast("double").alias("_cost"))
    return ordered_fold(rows, [scope], order, ["_cost"], (0.0, 0), add, "admitted boolean, spent double").drop("_cost")


def _numbered(rows: DataFrame, scope: str, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``_i``, which grows in the order of scope and ``order``, and ``_b``, the block it lies in; written once."""
    dealt = rows.repartitionByRange(scope, *order).sortWithinPartitions(scope, *order)
    return cut(dealt.withColumns({"_i": F.monotonically_increasing_id(), "_b": F.spark_partition_id()}), label)


def _running(rows: DataFrame, scope: str, **sums: Column) -> DataFrame:
    """Adds running sums down each scope, every row included, by two levels: blocks of rows, then rows within a block."""
    blocks = rows.groupBy(scope, "_b").agg(*(F.sum(c).alias(f"_own_{k}") for k, c in sums.items()))
    before = Window.partitionBy(scope).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(scope, "_b", *(F.coalesce(F.sum(f"_own_{k}").over(before), F.lit(0)).alias(f"_start_{k}") for k in sums))
    within = Window.partitionBy(scope, "_b").orderBy("_i")
    own = rows.withColumns({f"_in_{k}": F.sum(c).over(within) for k, c in sums.items()}).join(starts, [scope, "_b"])
    return own.withColumns({k: (F.col(f"_start_{k}") + F.col(f"_in_{k}")).cast("long") for k in sums}).drop(*(f"_{a}_{k}" for k in sums for a in ("in", "start")))


def admit_in_rounds(attempts: DataFrame, scope: str, order: list[str], cost: str, cap: int, max_calls: int | None = None) -> DataFrame:
    """As :func:`admit_by_budget` for whole costs, but a scope of any size is spread over all tasks.

    ``scope`` and ``order`` are not null, ``order`` is unique in its scope, costs are 0 or more.  A
    round looks at the room that is left.  Attempts of at most half of it are small: they are admitted one after another
    until less than half is left.  A large one is refused where it does not fit, since the room only
    shrinks; the first that fits takes more than half of the room.  Either event ends the round, at a
    place that running sums find; all before it is decided.  So room halves from round to round, and
    there are no more rounds than binary digits in ``cap``.  Running sums go by blocks of a range
    partitioning: a hot scope has many blocks.
    """
    keys = attempts.select(scope, *order, F.col(cost).cast("long").alias("_cost"))
    open_ = _numbered(keys, scope, order, "attempts")
    state = open_.select(scope).distinct().select(scope, F.lit(cap).cast("long").alias("_room"), F.lit(0).cast("long").alias("_calls"))
    settled = []
    spent, frames = F.col("_cost"), [open_]
    none = F.lit(2**62 if max_calls is None else max_calls)
    while True:
        now = open_.join(state, scope)
        # What no longer fits is refused at once, as is everything after the last call.
        fits = (spent <= F.col("_room")) & (F.col("_calls") < none)
        settled.append(open_.join(state, scope).where(~fits).select("_i", F.lit(False).alias("admitted")))
        now = now.where(fits)
        small = 2 * spent <= F.col("_room")
        sums = _running(now, scope, _before=F.when(small, spent).otherwise(0), _n=small.cast("long"))
        before, n = F.col("_before"), F.col("_n")
        ends = F.when(small, (2 * (F.col("_room") - before) < F.col("_room")) | (F.col("_calls") + n >= none)).otherwise(before + spent <= F.col("_room"))
        sums = cut(sums.withColumns({"_small": small, "_ends": ends}), "sums")
        last = sums.where("_ends").groupBy(scope).agg(F.min(F.struct("_i", (before + F.when(F.col("_small"), 0).otherwise(spent)).alias("used"), (n + F.when(F.col("_small"), 0).otherwise(1)).alias("calls"))).alias("_last"))
        placed = sums.join(last, scope, "left")
        upto = F.coalesce(F.col("_i") <= F.col("_last._i"), F.lit(True))
        done = placed.where(upto).select("_i", (F.col("_small") | F.coalesce(F.col("_i") == F.col("_last._i"), F.lit(False))).alias("admitted"))
        settled[-1] = cut(settled[-1].unionByName(done), "settled")
        open_ = cut(placed.where(~upto).select(*keys.columns, "_i", "_b"), "open")
        state = cut(state.join(last, scope).select(scope, (F.col("_room") - F.col("_last.used")).alias("_room"), (F.col("_calls") + F.col("_last.calls")).alias("_calls")), "state")
        frames += [open_, state, sums]
        if open_.isEmpty():
            break
    decided = settled[0]
    for s in settled[1:]:
        decided = decided.unionByName(s)
    joined = frames[0].join(decided, "_i")
    out = _running(joined, scope, spent=F.when(F.col("admitted"), spent).otherwise(0)).select(scope, *order, "admitted", "spent")
    out = cut(out, "admitted")
    drop_cut(*frames, *settled)
    return out


def leases(acquisitions: DataFrame, key: str, order: list[str], ttl_seconds: int) -> DataFrame:
    """Adds ``granted`` and ``takeover`` to acquisitions of exclusive leases.

    The first column of ``order`` is the time, the others break ties.  A lease is granted if none is
    held or the one held has run out; a refused acquisition leaves the held lease as it is.  A
    takeover follows a lease that ran out.
    """
    life = timedelta(seconds=ttl_seconds)

    def acquire(until: datetime | None, row: tuple) -> tuple[datetime | None, tuple]:
        granted = until is None or row[0] >= until
        return (row[0] + life if granted else until), (granted, granted and until is not None)

    return ordered_fold(acquisitions, [key], order, [order[0]], None, acquire, "granted boolean, takeover boolean")


@dataclass(frozen=True)
class Held:
    """The lease of a call: until when (none: not held), of which attempt, and when that began."""

    until: int | None = None
    ordinal: int = 0
    begun: int = 0


ATTEMPT_LOG = "ordinal int, outcome string, begun long, ended long"


def attempt_step(held: Held, at: int, done: bool, ttl: int) -> tuple[Held, list[tuple[int, str, int, int]]]:
    """What an event does to a lease, and the rows ``ordinal, outcome, begun, ended`` that it settles.

    An event asks for the lease or, if ``done``, commits under it.  A commit without a lease that holds is
    STALE, a request while it holds BUSY; a lease that ran out leaves an ABANDONED attempt.
    """
    out = []
    if held.until is not None and at >= held.until:
        out.append((held.ordinal, "ABANDONED", held.begun, held.until))
        held = Held(None, held.ordinal, 0)
    if held.until is not None:
        out.append((held.ordinal, "SUCCEEDED", held.begun, at) if done else (held.ordinal, "BUSY", at, at))
        return (Held(None, held.ordinal, 0) if done else held), out
    if done:
        out.append((held.ordinal, "STALE", at, at))
        return held, out
    return Held(at + ttl, held.ordinal + 1, at), out


def attempt_log(events: DataFrame, ttl_seconds: int) -> DataFrame:
    """``call, ordinal, outcome, begun, ended`` (microseconds) of all events ``call, id, ts, done``: the fold that the stream equals."""
    ttl = ttl_seconds * 1_000_000

    def step(held: Held, row: tuple) -> tuple[Held, tuple]:
        held, made = attempt_step(held, row[0], row[1], ttl)
        return held, ([dict(zip(("ordinal", "outcome", "begun", "ended"), m, strict=True)) for m in made], held.ordinal, held.until)

    rows = events.select("call", F.unix_micros("ts").alias("at"), "id", "done")
    adds = f"made array<struct<{ATTEMPT_LOG.replace(' ', ':').replace(',:', ',')}>>, now int, until long"
    folded = ordered_fold(rows, ["call"], ["at", "id"], ["at", "done"], Held(), step, adds)
    # A lease that no later event meets ends by itself.
    last = folded.groupBy("call").agg(F.max_by(F.struct("now", "until"), F.struct("at", "id")).alias("l")).where("l.until IS NOT NULL")
    left = last.select("call", F.col("l.now").alias("ordinal"), F.lit("ABANDONED").alias("outcome"), (F.col("l.until") - ttl).alias("begun"), F.col("l.until").alias("ended"))
    return folded.select("call", F.inline("made")).unionByName(left)


def fenced_commits(commits: DataFrame, leases: DataFrame) -> DataFrame:
    """Commits with ``valid``: made under the latest lease at that time, unexpired, by its token.

    ``commits``: ``call, token, done_at``; ``leases``: ``call, token, acquired_at, expires_at``.
    """
    held = leases.select("call", F.col("token").alias("lease_token"), "acquired_at", "expires_at")
    j = commits.join(held, "call", "left").where(F.col("acquired_at").isNull() | (F.col("acquired_at") <= F.col("done_at")))
    now = j.groupBy("call", "token", "done_at").agg(F.max_by("lease_token", "acquired_at").alias("now"), F.max_by("expires_at", "acquired_at").alias("until"))
    back = commits.join(now, ["call", "token", "done_at"], "left")
    return back.select("call", "token", "done_at", F.coalesce((F.col("now") == F.col("token")) & (F.col("done_at") < F.col("until")), F.lit(False)).alias("valid"))


def usage(attempts: DataFrame, scope: str, cost: str) -> DataFrame:
    return attempts.groupBy(scope).agg(F.count("*").alias("attempted_calls"), F.sum(cost).alias("estimated_cost"))


def project_state(has_error: Column, active_artifact: Column, reports: Column, active_release: Column, units: Column) -> Column:
    """State of a project by precedence."""
    return (
        F.when(has_error, "BLOCKED").when(active_artifact, "RELEASED").when(reports > 0, "BLOCKED").when(active_release, "VERIFYING")
        .when(units > 0, "IN_PROGRESS").otherwise("NEW")
    )
