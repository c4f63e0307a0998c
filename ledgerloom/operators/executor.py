"""Calls to services: cached, leased, counted against a budget, retried; every step one commit.

A stage hands over a table of requests.  Whatever has a stored result costs nothing; the rest is
called in batches, one Spark job for all calls of a round, and a round takes the calls whose last
attempt may be repeated.  A run's folder is a :class:`CommitLog` with

* ``attempts-<stage>``: call, stage, ordinal, outcome (RUNNING, then one of the others), error, at,
  cost, and the lease under which it runs: owner, token, expires_at;
* ``replies-<stage>``: what the service said, with ``_error`` and ``_retry``; one row a call without error;
* pointers ``lease:<stage>`` (the last one with its epoch, held or not) and ``usage``; the commits that
  set them are the log of leases (:meth:`Executor.lease_log`).

A round begins with one commit: it finds no lease or one that ran out, admits calls to the budget,
writes their attempts and takes the lease with the next epoch.  It ends with one commit, which holds
the replies, outcomes and the end of the lease, and is refused unless the lease that is held then
is this round's, by token and epoch, and has not run out.  Commits are numbered files that are only ever
created, so of two owners that start at once one takes the lease and the other finds it taken.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import retry_delay
from ..sources.commits import CommitLog, Part, Transaction, Versions
from ..streaming.folders import drop_path
from . import ledger

Service = Callable[[DataFrame], DataFrame]


class CallError(RuntimeError):
    """Calls that failed; the message names the first of them."""


class PermanentError(CallError):
    """A service refused for good, now or in an earlier run."""


class Exhausted(CallError):
    """The attempt limit is reached."""


class Busy(CallError):
    """Another owner holds a lease, or this one's is lost."""


class BudgetExceeded(CallError):
    """The budget admits no further attempt."""


ATTEMPT = "call string, stage string, ordinal int, seq int, outcome string, error string, at timestamp, cost double, owner string, token string, expires_at timestamp"
LEASE = "stage string, epoch long, owner string, token string, event string, at timestamp, expires_at timestamp"


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows``, joined by dealing both sides by key.

    A table of calls is small as files and large in memory; the planner, which sees the files, would gather all of it on the driver.
    """
    return rows.hint("merge")


@dataclass(frozen=True)
class Grant:
    """A lease on the open calls of a stage, and what it was taken for."""

    stage: str
    epoch: int
    token: str
    until: datetime
    requests: DataFrame
    begun: Part
    admitted: int
    waiting: int
    taken_over: int


class Executor:
    """One owner's calls in one folder.  ``clock`` and ``sleep`` are injected for tests."""

    def __init__(
        self, spark: SparkSession, folder: str, owner: str = "bus", max_attempts: int = 3, lease_seconds: float = 300, max_calls: int | None = None, max_cost: float | None = None,
        clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc), sleep: Callable[[float], None] = time.sleep, versions: dict[str, Versions] | None = None,
    ):
        if max_attempts < 1 or lease_seconds <= 0 or not owner.strip():
            raise ValueError("an executor needs an owner, a positive lease and at least one attempt")
        self.spark, self.folder, self.owner = spark, folder.rstrip("/"), owner
        self.max_attempts, self.lease_seconds, self.max_calls, self.max_cost = max_attempts, lease_seconds, max_calls, max_cost
        self.clock, self.sleep = clock, sleep
        self.log = CommitLog(spark, f"{self.folder}/calls", versions)
        self.calls: dict[str, int] = {}
        self.taken_over = 0

    # What the tables say

    @staticmethod
    def _last(rows: DataFrame) -> DataFrame:
        """Every attempt with its last outcome."""
        return rows.groupBy("call", "ordinal").agg(F.max_by(F.struct("stage", "outcome", "error", "cost", "owner", "token", "expires_at"), "seq").alias("r")).select("call", "ordinal", "r.*")

    def attempts(self, stage: str | None = None) -> DataFrame:
        """Every attempt (of a stage) with its last outcome."""
        now = self.log.snapshot()
        names = [t for t in now.tables if t.startswith("attempts-")] if stage is None else [f"attempts-{stage}"]
        out = self.spark.createDataFrame([], ATTEMPT)
        for name in names:
            out = out.unionByName(now.read(name, ATTEMPT))
        return self._last(out)

    def status(self, stage: str | None = None) -> DataFrame:
        return ledger.call_status(self.attempts(stage), self.max_attempts)

    def usage(self) -> tuple[int, float]:
        """Attempts begun and their cost, over all stages."""
        used = self.log.snapshot().pointers.get("usage", {"calls": 0, "micro": 0})
        return used["calls"], used["micro"] / 1e6

    def lease_log(self) -> DataFrame:
        """What happened to leases, one row a step, as the commits tell."""
        rows, before = [], {}
        for version in range(1, self.log.latest() + 1):
            for name, now in self.log.snapshot(version).pointers.items():
                if name.startswith("lease:") and now != before.get(name):
                    stage, at, until = name[6:], *(datetime.fromisoformat(now[k]) for k in ("at", "until"))
                    if (gone := before.get(name)) is not None and gone["held"] and now["epoch"] != gone["epoch"]:
                        rows.append((stage, gone["epoch"], gone["owner"], gone["token"], "EXPIRED", at, datetime.fromisoformat(gone["until"])))
                    rows.append((stage, now["epoch"], now["owner"], now["token"], "ACQUIRED" if now["held"] else "RELEASED", at, until))
                    before[name] = now
        return self.spark.createDataFrame(rows, LEASE)

    def results(self, stage: str, schema: str) -> DataFrame:
        """``call`` and the reply of every committed call of a stage."""
        return self._replies(self.log.snapshot().read(f"replies-{stage}", f"call string, {schema}, _error string"))

    @staticmethod
    def _replies(rows: DataFrame) -> DataFrame:
        return rows.where("_error IS NULL").drop("_error")

    # A round

    def execute(self, stage: str, requests: DataFrame, service: Service, schema: str, cost: float = 0.0) -> DataFrame:
        """Results of all requests (``call`` and what the service reads), calling for those without one.

        ``service`` maps requests to replies: ``call`` (each once), the columns of ``schema`` and, if a
        call failed, ``error`` (a class of :func:`ledger.classify_error` or any other text) and
        ``retry_after`` seconds.  A column ``cost`` of the requests stands for the common ``cost``.
        """
        self.calls.setdefault(stage, 0)
        while True:
            grant = self.log.transact(lambda tx: self._acquire(tx, stage, requests, schema, cost))
            if grant is None:
                break
            self.calls[stage] += grant.admitted
            self.taken_over += grant.taken_over
            wait = self._complete(grant, service, schema)
            if wait is None:  # the round held all open calls, and each has its reply
                break
            self.sleep(wait)
        return requests.select("call").join(_dealt(self.results(stage, schema)), "call")

    @staticmethod
    def _rows(rows: DataFrame, outcome: Column, seq: int, at: datetime, error: Column | None = None) -> DataFrame:
        error = F.lit(None).cast("string") if error is None else error
        return rows.select("call", "stage", F.col("ordinal").cast("int").alias("ordinal"), F.lit(seq).alias("seq"), outcome.alias("outcome"), error.alias("error"), F.lit(at).alias("at"), "cost", "owner", "token", "expires_at")

    def _acquire(self, tx: Transaction, stage: str, requests: DataFrame, schema: str, cost: float) -> Grant | None:
        """Takes the lease of a stage for its open calls, as far as the budget admits; nothing if none is open."""
        now, name = self.clock(), f"attempts-{stage}"
        tried = self._last(tx.read(name, ATTEMPT))
        replied = self._replies(tx.read(f"replies-{stage}", f"call string, {schema}, _error string")).select("call")
        pending = requests.join(_dealt(replied), "call", "left_anti") if tx.base.parts(f"replies-{stage}") else requests
        n, before = pending.select("call").count(), bool(tx.base.parts(name))
        if not n:
            return None
        if before:
            ended = ledger.call_status(tried, self.max_attempts).where("status IN ('FAILED_PERMANENT', 'EXHAUSTED')").select("call", "status")
            r = pending.select("call").join(_dealt(ended), "call").agg(F.min(F.struct("call", "status")).alias("ended")).first()
            if r.ended is not None:
                raise PermanentError(f"{stage}: call {r.ended.call} ended before as {r.ended.status}")
        held, taken_over = tx.pointer(f"lease:{stage}"), 0
        epoch = 0 if held is None else held["epoch"]
        if held is not None and held["held"]:
            if datetime.fromisoformat(held["until"]) > now:
                raise Busy(f"{stage}: leased by {held['owner']} until {held['until']}")
            # It ran out: its attempts that still run are abandoned.
            running = tried.where((F.col("outcome") == "RUNNING") & (F.col("token") == held["token"]))
            taken_over = running.count()
            tx.append(name, self._rows(running, F.lit("ABANDONED"), 2, now))
        admitted, room, spent = self._admit(tx, stage, pending, n, cost)
        token, until = uuid.uuid4().hex, now + timedelta(seconds=self.lease_seconds)
        last = tried.groupBy("call").agg(F.max("ordinal").alias("tried"))
        begun = (admitted.join(_dealt(last), "call", "left") if before else admitted.withColumn("tried", F.lit(0))).select(
            "call", F.lit(stage).alias("stage"), (F.coalesce("tried", F.lit(0)) + 1).alias("ordinal"), (F.col("_micro") / 1e6).alias("cost"),
            F.lit(self.owner).alias("owner"), F.lit(token).alias("token"), F.lit(until).alias("expires_at"),
        )
        part = self.log.write(name, self._rows(begun, F.lit("RUNNING"), 1, now))
        tx.add(part)
        used = tx.pointer("usage") or {"calls": 0, "micro": 0}
        tx.point("usage", {"calls": used["calls"] + room, "micro": used["micro"] + spent})
        tx.point(f"lease:{stage}", {"held": True, "owner": self.owner, "token": token, "epoch": epoch + 1, "at": now.isoformat(), "until": until.isoformat()})
        return Grant(stage, epoch + 1, token, until, pending, part, room, n - room, taken_over)

    def _admit(self, tx: Transaction, stage: str, pending: DataFrame, n: int, cost: float) -> tuple[DataFrame, int, int]:
        """``call, _micro`` of the calls that the budget admits in the order of calls, their number and cost in millionths."""
        micro = F.round(F.col("cost").cast("double") * 1_000_000).cast("long") if "cost" in pending.columns else F.lit(round(cost * 1_000_000))
        priced = pending.select("call", micro.alias("_micro"))
        if self.max_calls is None and self.max_cost is None:
            return priced, n, n * round(cost * 1_000_000) if "cost" not in pending.columns else priced.agg(F.coalesce(F.sum("_micro"), F.lit(0))).first()[0]
        used = tx.pointer("usage") or {"calls": 0, "micro": 0}
        cap = 2**61 if self.max_cost is None else max(0, round(self.max_cost * 1_000_000) - used["micro"])
        most = None if self.max_calls is None else max(0, self.max_calls - used["calls"])
        if "cost" not in pending.columns:  # equal costs: what the budget admits is a prefix
            each = round(cost * 1_000_000)
            room = min(n, n if most is None else most, cap // each if each else n)
            if room <= 0:
                raise BudgetExceeded(f"{stage}: {used['calls']} calls and {used['micro'] / 1e6:g} spent, {n} calls wait")
            return (priced if room == n else priced.orderBy("call").limit(room)), room, room * each
        own = ledger.admit_in_rounds(priced.withColumn("_scope", F.lit(0)), "_scope", ["call"], "_micro", cap, most).where("admitted").select("call")
        admitted = priced.join(_dealt(own), "call", "left_semi")
        r = admitted.agg(F.count("*").alias("n"), F.coalesce(F.sum("_micro"), F.lit(0)).alias("c")).first()
        if not r.n:
            raise BudgetExceeded(f"{stage}: {used['calls']} calls and {used['micro'] / 1e6:g} spent, {n} calls wait")
        return admitted, r.n, r.c

    def cancel(self, stage: str, token: str) -> bool:
        """Gives up the lease of a stage if ``token`` is the one that holds it; its running attempts are abandoned.

        A token that another lease has followed changes nothing.
        """

        def step(tx: Transaction) -> bool:
            held, now = tx.pointer(f"lease:{stage}"), self.clock()
            if held is None or not held["held"] or held["token"] != token:
                return False
            running = self._last(tx.read(f"attempts-{stage}", ATTEMPT)).where((F.col("outcome") == "RUNNING") & (F.col("token") == token))
            tx.append(f"attempts-{stage}", self._rows(running, F.lit("ABANDONED"), 2, now))
            tx.point(f"lease:{stage}", held | {"held": False, "at": now.isoformat()})
            return True

        return self.log.transact(step)

    def _complete(self, grant: Grant, service: Service, schema: str) -> float | None:
        """Calls, and commits what was said while the lease is held; the seconds to wait before the next round."""
        stage, spark = grant.stage, self.spark
        own = spark.read.schema(ATTEMPT).parquet(f"{self.log.folder}/{grant.begun.path}")
        said = service(grant.requests.join(_dealt(own.select("call")), "call", "left_semi") if grant.waiting else grant.requests)
        error = F.col("error") if "error" in said.columns else F.lit(None).cast("string")
        retry = F.col("retry_after").cast("double") if "retry_after" in said.columns else F.lit(None).cast("double")
        names = T.StructType.fromDDL(schema).names
        # Written before it is used, since Spark may run a function again.
        replies = self.log.write(f"replies-{stage}", said.select("call", *names, error.alias("_error"), retry.alias("_retry")))
        got = spark.read.parquet(f"{self.log.folder}/{replies.path}")
        clean, whole = self._answered(own, got)
        if not clean:  # only what was asked, and once
            once = self.log.write(f"replies-{stage}", got.join(_dealt(own.select("call")), "call", "left_semi").dropDuplicates(["call"]))
            drop_path(spark, f"{self.log.folder}/{replies.path}")
            replies, got = once, spark.read.parquet(f"{self.log.folder}/{once.path}")
        if whole:  # each attempt has its reply, none an error: nothing to look up
            done, outcome = own.withColumn("_error", F.lit(None).cast("string")), F.lit("SUCCEEDED")
        else:
            got = got.select("call", "_error", "_retry", F.lit(True).alias("_there"))
            outcome = F.when(F.col("_there").isNull(), "RETRYABLE_FAILURE").when(F.col("_error").isNull(), "SUCCEEDED").when(ledger.classify_error(F.col("_error")), "RETRYABLE_FAILURE").otherwise("PERMANENT_FAILURE")
            done = own.drop("outcome", "error").join(_dealt(got), "call", "left")
        ended = self.log.write(f"attempts-{stage}", self._rows(done, outcome, 3, self.clock(), F.col("_error")))

        def commit(tx: Transaction) -> None:
            now, held = self.clock(), tx.pointer(f"lease:{stage}")
            if held is None or not held["held"] or held["token"] != grant.token or held["epoch"] != grant.epoch:
                raise Busy(f"{stage}: the lease of epoch {grant.epoch} is lost")
            if now >= grant.until:
                raise Busy(f"{stage}: the lease ran out before the calls returned")
            tx.add(replies)
            tx.add(ended)
            tx.point(f"lease:{stage}", held | {"held": False, "at": now.isoformat()})

        self.log.transact(commit)
        if whole:
            if grant.waiting:
                raise BudgetExceeded(f"{stage}: {grant.waiting} calls wait")
            return None
        r = done.withColumn("outcome", outcome).agg(
            F.max(F.when(F.col("outcome") == "PERMANENT_FAILURE", F.col("_error"))).alias("refused"), F.count_if(F.col("outcome") == "RETRYABLE_FAILURE").alias("again"),
            F.max(F.when(F.col("outcome") == "RETRYABLE_FAILURE", F.col("ordinal"))).alias("ordinal"), F.max("_retry").alias("hint"),
        ).withColumn("wait", retry_delay(F.col("ordinal"), F.col("hint"))).first()
        if r.refused is not None:
            raise PermanentError(f"{stage}: {r.refused}")
        if r.again and r.ordinal >= self.max_attempts:
            raise Exhausted(f"{stage}: {r.again} calls failed, {r.ordinal} attempts")
        if grant.waiting:
            raise BudgetExceeded(f"{stage}: {grant.waiting} calls wait")
        return r.wait if r.again else None

    @staticmethod
    def _answered(own: DataFrame, got: DataFrame) -> tuple[bool, bool]:
        """Whether replies are of attempts only, one each; and whether besides every attempt has one, without error.

        Calls are dealt out for it, their replies are not.
        """
        begun = own.select("call", F.lit(1).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("bad"))
        said = got.select("call", F.lit(0).alias("a"), F.lit(1).alias("b"), F.col("_error").isNotNull().cast("int").alias("bad"))
        a, b, bad = (F.sum(c).alias(c) for c in ("a", "b", "bad"))
        clean, whole = (F.col("b") <= 1) & (F.col("b") <= F.col("a")), (F.col("a") == 1) & (F.col("b") == 1) & (F.col("bad") == 0)
        r = begun.unionByName(said).groupBy("call").agg(a, b, bad).agg(F.bool_and(clean).alias("clean"), F.bool_and(whole).alias("whole")).first()
        return r.clean is not False, r.whole is not False
