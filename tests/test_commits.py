"""Commits over several tables, exclusive leases with fencing, budgets in rounds."""

import threading
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ledger
from ledgerloom.operators.executor import BudgetExceeded, Busy, Executor
from ledgerloom.sources import commits
from ledgerloom.sources.commits import CommitLog, Newer, Stale, Versions


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "k int").coalesce(1)


def test_a_file_is_put_once(spark, tmp_path):
    path = f"file://{tmp_path}/log/1.json"
    assert commits.put_if_absent(spark, path, b"a") and not commits.put_if_absent(spark, path, b"b")
    assert (tmp_path / "log" / "1.json").read_bytes() == b"a" and len(list((tmp_path / "log").iterdir())) == 1
    other = f"file://{tmp_path}/log/2.json"
    assert commits.rename_if_absent(spark, other + ".tmp", other, b"c") and not commits.rename_if_absent(spark, other + ".tmp", other, b"d")
    assert (tmp_path / "log" / "2.json").read_bytes() == b"c"


def test_tables_and_pointers_appear_together(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/s")

    def step(tx, fail=False):
        tx.append("records", rows(spark, 1, 2))
        tx.append("events", rows(spark, 9))
        tx.point("release", {"id": "r1"})
        if fail:
            raise RuntimeError("killed")

    with pytest.raises(RuntimeError, match="killed"):
        log.transact(lambda tx: step(tx, True))
    assert log.latest() == 0 and log.snapshot().tables == [] and log.snapshot().pointers == {}
    log.transact(step)
    held = log.snapshot()
    with pytest.raises(RuntimeError, match="killed"):  # the second release is rolled back as a whole
        log.transact(lambda tx: (tx.replace("records", rows(spark, 5)), step(tx, True)))
    log.transact(lambda tx: (tx.replace("records", rows(spark, 7)), tx.point("release", None)))
    assert [r.k for r in held.read("records").orderBy("k").collect()] == [1, 2]  # a reader keeps its version
    now = log.snapshot()
    assert [r.k for r in now.read("records").collect()] == [7] and now.pointers == {} and [r.k for r in now.read("events").collect()] == [9]
    with pytest.raises(KeyError):
        now.read("nothing")
    assert now.read("nothing", "k int").count() == 0
    assert log.vacuum(keep=1, seconds=0) >= 3 and log.snapshot().read("events").count() == 1
    log.transact(lambda tx: tx.append("events", rows(spark, 10)))
    log.compact("events")
    assert len(log.snapshot().parts("events")) == 1 and log.snapshot().read("events").count() == 2


def test_writers_at_once_lose_nothing(spark, tmp_path):
    log, ran = CommitLog(spark, f"file://{tmp_path}/s"), []

    def count(i):
        def step(tx):
            ran.append(i)
            tx.point("n", (tx.pointer("n") or 0) + 1)
            tx.append("rows", rows(spark, i))

        log.transact(step)

    threads = [threading.Thread(target=count, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    now = log.snapshot()
    assert now.pointers["n"] == 6 and now.version == 6 and sorted(r.k for r in now.read("rows").collect()) == list(range(6))
    blind, once = CommitLog(spark, f"file://{tmp_path}/s"), []

    def append(tx):  # depends on nothing that the other changes, so it is not run again
        once.append(1)
        tx.append("rows", rows(spark, 50))
        if len(once) == 1:
            log.transact(lambda t: t.append("rows", rows(spark, 51)))

    blind.transact(append)
    assert len(once) == 1 and log.snapshot().read("rows").count() == 8

    def chased(tx):
        tx.point("n", tx.pointer("n") + 1)
        log.transact(lambda t: t.point("n", 0))

    with pytest.raises(Stale):
        log.transact(chased, tries=2)


def test_rows_are_inserted_once_or_refused(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/s")
    pair = lambda *kv: spark.createDataFrame(list(kv), "k int, v string")
    for df in (pair((1, "a"), (2, "b")), pair((1, "a"), (3, "c"))):
        log.transact(lambda tx, df=df: tx.insert_once("t", df, "k", "v"))
    with pytest.raises(ledger.Conflict):
        log.transact(lambda tx: (tx.point("p", 1), tx.insert_once("t", pair((3, "other")), "k", "v")))
    assert sorted(map(tuple, log.snapshot().read("t").collect())) == [(1, "a"), (2, "b"), (3, "c")] and log.snapshot().pointers == {}


def test_older_tables_are_lifted_and_newer_refused(spark, tmp_path):
    """Versions 2, 3 and 4 of one table read as 5; what version 6 wrote is refused."""
    folder = f"file://{tmp_path}/s"
    lifts = {
        2: lambda df: df.withColumn("lang", F.lit("en")),  # a new column with its default
        3: lambda df: df.withColumnRenamed("txt", "text"),
        4: lambda df: df.select(F.col("k").cast("long").alias("k"), "text", "lang"),
    }
    written = {2: ("k int, txt string", (2, "b")), 3: ("k int, txt string, lang string", (3, "c", "de")), 4: ("k int, text string, lang string", (4, "d", "fr")), 5: ("k long, text string, lang string", (5, "e", "it"))}
    for v, (schema, row) in written.items():
        log = CommitLog(spark, folder, {"t": Versions(v, {k: f for k, f in lifts.items() if k < v})})
        log.transact(lambda tx, row=row, schema=schema: tx.append("t", spark.createDataFrame([row], schema)))
    got = log.snapshot().read("t")
    assert got.dtypes == [("k", "bigint"), ("text", "string"), ("lang", "string")]
    assert sorted(map(tuple, got.collect())) == [(2, "b", "en"), (3, "c", "de"), (4, "d", "fr"), (5, "e", "it")]
    with pytest.raises(Newer, match="version 5, this program reads up to 4"):
        CommitLog(spark, folder, {"t": Versions(4, lifts)}).snapshot().read("t")
    log.compact("t")
    assert [p["version"] for p in log.snapshot().parts("t")] == [5] and log.snapshot().read("t").count() == 4


class Clock:
    def __init__(self):
        self.now = datetime(2024, 1, 1, tzinfo=timezone.utc)

    def __call__(self):
        return self.now


def requests(spark, n):
    return spark.createDataFrame([(f"c{i}", i) for i in range(n)], "call string, x int")


def test_two_owners_at_once(spark, tmp_path):
    folder, together, inside, served, seen = f"file://{tmp_path}/a", threading.Barrier(2), threading.Event(), [], {}

    def serve(name):
        def service(r):
            served.append((name, r.count()))
            inside.wait(60)
            return r.select("call", (F.col("x") * 10).alias("y"))

        return service

    def work(name):
        e = Executor(spark, folder, owner=name)
        together.wait()
        try:
            seen[name] = e.execute("s", requests(spark, 4), serve(name), "y int").count()
        except Busy as b:
            seen[name] = str(b)
            inside.set()

    threads = [threading.Thread(target=work, args=(n,)) for n in ("one", "two")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    ((winner, n),) = served
    loser = {"one": "two", "two": "one"}[winner]
    assert n == 4 and seen[winner] == 4 and f"leased by {winner}" in seen[loser]
    late = Executor(spark, folder, owner=loser)
    assert late.execute("s", requests(spark, 4), serve(loser), "y int").count() == 4 and len(served) == 1  # from the table
    assert late.results("s", "y int").count() == 4 and late.usage() == (4, 0.0)
    assert [tuple(r) for r in late.attempts().select("owner", "outcome").distinct().collect()] == [(winner, "SUCCEEDED")]
    assert [(r.event, r.owner, r.epoch) for r in late.lease_log().orderBy("at").collect()] == [("ACQUIRED", winner, 1), ("RELEASED", winner, 1)]


def test_a_stale_worker_cannot_commit(spark, tmp_path):
    folder, clock = f"file://{tmp_path}/a", Clock()
    one, two = (Executor(spark, folder, owner=o, lease_seconds=10, clock=clock) for o in ("one", "two"))
    clock_of_one = Clock()
    one.clock = clock_of_one  # its own clock stands still: only the token tells that the lease is lost

    def slow(r):
        clock.now += timedelta(seconds=11)
        assert two.execute("s", requests(spark, 2), lambda q: q.select("call", F.lit("fresh").alias("y")), "y string").count() == 2
        return r.select("call", F.lit("stale").alias("y"))

    with pytest.raises(Busy, match="epoch 1 is lost"):
        one.execute("s", requests(spark, 2), slow, "y string")
    assert [r.y for r in two.results("s", "y string").collect()] == ["fresh", "fresh"] and two.taken_over == 2
    assert {(r.ordinal, r.outcome, r.owner) for r in two.attempts().collect()} == {(1, "ABANDONED", "one"), (2, "SUCCEEDED", "two")}
    assert [(r.event, r.epoch, r.owner) for r in two.lease_log().orderBy("epoch", "event").collect()] == [("ACQUIRED", 1, "one"), ("EXPIRED", 1, "one"), ("ACQUIRED", 2, "two"), ("RELEASED", 2, "two")]
    assert two.usage()[0] == 4  # the abandoned attempts were paid for


def test_unequal_costs_under_a_budget(spark, tmp_path):
    asked = spark.createDataFrame([("a", 50.0), ("b", 60.0), ("c", 40.0), ("d", 10.5), ("e", 10.0)], "call string, cost double")
    e = Executor(spark, f"file://{tmp_path}/a", max_cost=100.0)
    with pytest.raises(BudgetExceeded, match="2 calls wait"):
        e.execute("s", asked, lambda r: r.select("call", F.lit(1).alias("y")), "y int")
    assert sorted(r.call for r in e.results("s", "y int").collect()) == ["a", "c", "e"] and e.usage() == (3, 100.0)


def test_budgets_in_rounds_equal_the_fold(spark):
    import random

    random.seed(4)
    made = [("hot", i, random.choice([0, 1, 3, 500, 999, 1000, 4000, 70_000])) for i in range(3000)]
    made += [(f"s{k}", i, random.randint(0, 120)) for k in range(40) for i in range(random.randint(1, 30))]
    made += [("falls", i, 100 - i % 100 if i % 2 else 1) for i in range(200)] + [("big", 0, 10**6), ("big", 1, 100)]
    df = spark.createDataFrame(made, "scope string, k int, c long").repartition(7)
    for cap, most in ((100, None), (100, 3), (20_000, None), (20_000, 700), (0, None), (100, 0)):
        want = {(r.scope, r.k): (r.admitted, int(r.spent)) for r in ledger.admit_by_budget(df, "scope", ["k"], "c", float(cap), most).collect()}
        got = {(r.scope, r.k): (r.admitted, r.spent) for r in ledger.admit_in_rounds(df, "scope", ["k"], "c", cap, most).collect()}
        assert got == want, (cap, most)
    assert ledger.admit_in_rounds(df.limit(0), "scope", ["k"], "c", 5).count() == 0


def test_a_hot_scope_is_many_blocks(spark):
    df = spark.range(400_000).select(F.lit("hot").alias("scope"), F.col("id").alias("k"), (F.col("id") % 17 + 1).alias("c"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = ledger._numbered(df.withColumnRenamed("c", "_cost"), "scope", ["k"], "blocks").groupBy("_b").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(blocks) >= 8 and max(r["count"] for r in blocks) < 100_000


def test_a_lease_is_given_up_by_its_token_only(spark, tmp_path):
    clock = Clock()
    e = Executor(spark, f"file://{tmp_path}/a", owner="one", clock=clock)

    def broken(r):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        e.execute("s", requests(spark, 2), broken, "y int")
    (token,) = {r.token for r in e.attempts().collect()}
    assert not e.cancel("s", "another") and not e.cancel("t", token)
    two = Executor(spark, f"file://{tmp_path}/a", owner="two", clock=clock)
    with pytest.raises(Busy):
        two.execute("s", requests(spark, 2), broken, "y int")
    assert e.cancel("s", token) and not e.cancel("s", token)
    assert two.execute("s", requests(spark, 2), lambda r: r.select("call", F.col("x").alias("y")), "y int").count() == 2
    assert {(r.ordinal, r.outcome) for r in two.attempts().collect()} == {(1, "ABANDONED"), (2, "SUCCEEDED")}
    assert not e.cancel("s", token)  # the second owner's lease has followed
