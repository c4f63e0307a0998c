"""What a run costs: jobs of whole runs, and texts that cross the network once more than they must."""

from pyspark.sql import functions as F

from ledgerloom.operators.executor import Executor
from ledgerloom.plans.kernel import Kernel
from tests.test_control import services, two_units


def jobs(spark, group, run):
    """The number of jobs that ``run`` takes, and its result."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setJobGroup("other", "other")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), out


def test_a_kernel_run_takes_few_jobs(spark, tmp_path):
    routes, units = two_units(spark)
    one, _ = jobs(spark, "kernel", lambda: Kernel(spark, Executor(spark, f"file://{tmp_path}/a"), services()).run(routes, units))
    e = Executor(spark, f"file://{tmp_path}/a")
    again, _ = jobs(spark, "kernel again", lambda: Kernel(spark, e, services()).run(routes, units))
    assert not sum(e.calls.values())
    assert one < 150 and again < 120


def test_replies_are_asked_for_once_each(spark, tmp_path):
    asked = spark.range(4).select(F.col("id").cast("string").alias("call"), F.col("id").cast("int").alias("x"))
    e = Executor(spark, f"file://{tmp_path}/a")
    said = lambda r: r.select("call", F.col("x").alias("y")).unionByName(r.select(F.lit("foreign").alias("call"), F.lit(9).alias("y"))).unionByName(r.where("x = 1").select("call", F.lit(1).alias("y")))
    assert sorted((r.call, r.y) for r in e.execute("s", asked, said, "y int").collect()) == [("0", 0), ("1", 1), ("2", 2), ("3", 3)]
    assert e.calls == {"s": 4} and e.results("s", "y int").count() == 4  # what nobody asked for, or twice, is not kept
    assert {(r.ordinal, r.outcome) for r in e.attempts().collect()} == {(1, "SUCCEEDED")}
    silent = lambda r: r.where("x <> 2").select("call", F.col("x").alias("y")) if not waits else r.select("call", F.col("x").alias("y"))
    waits = []
    e = Executor(spark, f"file://{tmp_path}/b", sleep=waits.append)
    assert sorted(r.y for r in e.execute("s", asked, silent, "y int").collect()) == [0, 1, 2, 3] and e.calls == {"s": 5} and len(waits) == 1


def test_a_publication_splits_its_documents_once(spark, tmp_path):
    from ledgerloom.plans import publication
    from ledgerloom.plans.project import Project

    (tmp_path / "a.txt").write_text("It must hold in 1999.\n\nPlain line.\n12.5")
    project = Project(tmp_path / "p")
    project.init(tmp_path / "a.txt")
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    docs = publication.read_source(spark, str(tmp_path / "a.txt")).withColumn("text", counted("text"))
    made = publication.Publication(spark, f"file://{tmp_path}/t", project, services())
    assert made.run(docs).report["verdict"] == "PASS" and read.value == 1
