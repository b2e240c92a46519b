"""Executions kept over restarts: what is kept, what goes on, and what isn't run again."""

import pytest
from pyspark.sql import functions as F

from millrace.plans import Action, Mission, Stage, text
from millrace.plans.executions import Executions


@pytest.fixture
def kept(spark, tmp_path):
    return Executions(spark, str(tmp_path / "e"))


def made(spark, ran, fail=(), name="m"):
    def load(ctx):
        ran.append("Load")
        ctx.store("a", ctx.spark.range(5).selectExpr("id", "id * 10 AS v"), F.col("id"))

    def double(ctx):
        ran.append("Double")
        if "Double" in fail:
            raise ValueError("no double")
        ctx.store("a", ctx.read("a").filter("id < 2").withColumn("v", F.col("v") * 2), F.col("id"), upsert=True)

    def total(ctx):
        ran.append("Total")
        if "Total" in fail:
            raise KeyboardInterrupt
        ctx.store("t", ctx.read("a").agg(F.sum("v").alias("s")).withColumn("id", F.lit("t")), F.col("id"))

    return Mission(name, spark, [Action("Load", load), Action("Double", double), Action("Total", total)], [Stage(["Load"]), Stage(["Double"]), Stage(["Total"])])


def test_goes_on_after_a_failure_in_another_driver(spark, kept):
    ran = []
    with pytest.raises(ValueError):
        made(spark, ran, ["Double"]).run(executions=kept)
    found = kept.resumable("m").collect()
    assert [(r.status, r.done, r.stages) for r in found] == [("failed", 1, 3)]
    fresh = made(spark, ran)
    fresh.run(Executions(spark, kept.path).reopen(fresh), kept)
    assert ran == ["Load", "Double", "Double", "Total"] and fresh.execution_id == found[0].execution_id
    assert fresh.stores["t"].scan().first().s == 110
    assert [(r.status, r.done) for r in kept.executions().collect()] == [("completed", 3)] and kept.resumable("m").count() == 0


def test_a_driver_that_ends_leaves_a_resumable_execution(spark, kept):
    ran = []
    with pytest.raises(KeyboardInterrupt):
        made(spark, ran, ["Total"]).run(executions=kept)
    assert [(r.status, r.done) for r in kept.resumable("m").collect()] == [("running", 2)]
    fresh = made(spark, ran)
    assert fresh.run(kept.reopen(fresh), kept).stores["t"].scan().first().s == 110
    assert ran == ["Load", "Double", "Total", "Total"]


def test_a_stage_is_not_run_again_by_later_ones(spark, kept):
    m = made(spark, [])
    m.run(executions=kept)
    plan = m.stores["a"].table._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and "parquet" in plan


def test_listing_deleting_and_refusing(spark, kept):
    assert kept.executions().count() == 0 and kept.reopen(made(spark, [])) == []
    first = made(spark, []).run(executions=kept)
    second = made(spark, [], name="other").run(executions=kept)
    assert [r.execution_id for r in kept.recent().collect()] == [second.execution_id, first.execution_id]
    assert [r.mission for r in kept.recent("m").collect()] == ["m"]
    with pytest.raises(ValueError, match="stages"):
        kept.reopen(made(spark, []), second.execution_id)
    with pytest.raises(LookupError):
        kept.reopen(made(spark, []), "none")
    kept.delete(first.execution_id)
    assert [r.execution_id for r in kept.executions().collect()] == [second.execution_id]


def test_missions_as_text(spark, kept):
    rows = spark.createDataFrame([(1, 5), (2, 7)], "id long, n long")
    program = """mission T { store raw: memory("raw") store mid: memory("mid") store out: memory("out")
        action A { for r in raw { store { id: r.id, n: r.n * 2 } -> mid { key: .id } } }
        action B { for r in mid { validate r { assume .n < LIMIT } store { id: r.id, n: r.n + 1 } -> out { key: .id } } } run A then B }"""
    with pytest.raises(Exception, match="."):
        text.run(program.replace("LIMIT", "12"), spark, {"raw": rows}, executions=kept).stores["out"].scan().collect()
    state = kept.resumable("T").collect()
    got = text.run(program.replace("LIMIT", "100"), spark, {"raw": rows}, executions=kept, resume=True)
    assert sorted(map(tuple, got.stores["out"].scan().select("id", "n").collect())) == [(1, 11), (2, 15)]
    assert [(r.status, r.done) for r in state] == [("failed", 1)] and got.execution_id == state[0].execution_id
