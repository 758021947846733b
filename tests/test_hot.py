"""One value, series or week holds nearly all rows: results stay right and no task reads a quarter of them."""

import random

import numpy as np
import pytest
from leafmill.operators import health, pages, sequence
from leafmill.plans import registry, views
from pyspark.sql import functions as F

N = 200_000


@pytest.fixture
def largest(spark):
    """Most rows that one task of the stages since has read from a shuffle."""
    own = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    context = spark.sparkContext._jsc.sc()
    first = context.dagScheduler().nextStageId()

    def most() -> int:
        context.listenerBus().waitUntilEmpty()
        found = 0
        for stage in range(first, context.dagScheduler().nextStageId()):
            tasks = context.statusStore().taskList(stage, 0, 10_000)
            for i in range(tasks.size()):
                metrics = tasks.apply(i).taskMetrics()
                if metrics.isDefined():
                    found = max(found, metrics.get().shuffleReadMetrics().recordsRead())
        return found

    yield most
    for k, v in own.items():
        spark.conf.set(k, v)


def test_quantile_of_one_value(spark, largest):
    rows = spark.range(N).selectExpr("CAST(IF(id % 50 = 0, 'b', 'a') AS STRING) AS k", "IF(id % 100 < 98, 0.0, CAST(id % 7919 AS DOUBLE)) AS v").repartition(8)
    found = {r.k: r.q for r in sequence.quantile(rows, ["k"], "v", 0.985, "q").collect()}
    assert largest() < N / 4
    ids = np.arange(N)
    v = np.where(ids % 100 < 98, 0.0, (ids % 7919).astype(float))
    for k, own in (("b", ids % 50 == 0), ("a", ids % 50 != 0)):
        assert found[k] == pytest.approx(np.quantile(v[own], 0.985))


def test_persistence_of_one_series(spark, largest):
    ticks = spark.range(N).selectExpr("IF(id % 50 = 0, 'b', 'a') AS series", "timestamp_seconds(id) AS ts", "id % 4000 <> 0 AND id % 4000 <> 1 AS firing").repartition(8)
    found = health.persisting(ticks, 100, block=20_000).groupBy("series").agg(F.count("*").alias("n"), F.sum("ticks").alias("ticks")).collect()
    assert largest() < N / 4
    ids = np.arange(N)
    want = {}
    for series, own in (("a", ids[ids % 50 != 0]), ("b", ids[ids % 50 == 0])):
        firing = (own % 4000 != 0) & (own % 4000 != 1)
        runs = np.split(np.arange(len(own)), np.flatnonzero(np.diff(firing.astype(int))) + 1)
        kept = [r for r in runs if firing[r[0]] and own[r[-1]] - own[r[0]] >= 100]
        want[series] = (len(kept), sum(map(len, kept)))
    assert {r.series: (r.n, r.ticks) for r in found} == want


def test_cooldown_of_one_week(spark, largest):
    """All events of a kind lie in a few days; a second kind and a cooldown that leads through many ranges."""
    rows = spark.range(N).selectExpr("IF(id % 50 = 0, 'b', 'a') AS kind", "timestamp_millis(id * 2500 + id * id % 1013) AS fired_at", "id AS event_id").repartition(8)
    found = health.cooldown(rows, days=1).collect()
    assert largest() < 2 * N / 4  # every event is sorted twice, as one and as what asks for the next
    ids = np.arange(N, dtype=np.int64)
    at = ids * 2500 + ids * ids % 1013
    want = set()
    for kind, own in (("a", ids % 50 != 0), ("b", ids % 50 == 0)):
        last = None
        for moment, event in sorted(zip(at[own].tolist(), ids[own].tolist(), strict=True)):
            if last is None or moment >= last + 86_400_000:
                last = moment
                want.add((kind, event))
    assert {(r.kind, r.event_id) for r in found} == want


def test_rolling_needs_longer_blocks(spark):
    with pytest.raises(ValueError):
        sequence.rolling(spark.range(3).selectExpr("1 AS k", "id"), ["k"], ["id"], 10, {"n": F.count("*")}, block=9)


def test_greedy_equals_walk():
    rng = random.Random(2)
    for _ in range(50):
        at = np.array(sorted(rng.randrange(200) for _ in range(rng.randrange(40))), dtype=np.int64)
        last, want = (start := rng.choice([None, 5, 90])), []
        for i, t in enumerate(at.tolist()):
            if last is None or t >= last + 13:
                last = t
                want.append(i)
        assert sequence.greedy(at, 13, start) == want


@pytest.mark.parametrize("name, last", [("a11_closable_parents", 0), ("a12_viewer_summary", 1)])
def test_tasks_that_make_pages_grow_in_number_only(spark, sf, monkeypatch, name, last):
    """However few partitions the session has, a task that makes pages reads about as many lines as it should; only the counts of jobs (``last``) meet in the session's own."""
    monkeypatch.setattr(registry, "LINES_A_TASK", 200, raising=False)
    context = spark.sparkContext._jsc.sc()
    first = context.dagScheduler().nextStageId()
    assert registry.QUERIES[name](spark, sf).collect()
    context.listenerBus().waitUntilEmpty()
    read = []
    for stage in range(first, context.dagScheduler().nextStageId()):
        tasks = context.statusStore().taskList(stage, 0, 10_000)
        read.append(max((tasks.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead() for i in range(tasks.size())), default=0))
    made = [n for n in read if n]
    assert made and max(made[: len(made) - last]) < 400


def test_pages_of_odd_lines(spark, tmp_path):
    """Pages and parents of one grouping are those of the view's SQL: lost and negative keys, several lines a page, lines of a parent's page with lost values, none."""
    at = "TIMESTAMP '1998-03-04 05:06:07'"
    rows = spark.range(4000).selectExpr(
        "IF(id % 37 = 0, NULL, id % 40 - 8) AS l_orderkey", "IF(id % 29 = 0, NULL, id * 7 % 2000) AS l_partkey", "IF(id % 23 = 0, NULL, id % 11) AS l_suppkey", "CAST(IF(id % 31 = 0, NULL, id % 17 - 2) AS INT) AS l_linenumber",
        "IF(id % 13 = 0, NULL, CAST(id % 50 AS DOUBLE)) AS l_quantity", "CAST(id AS DOUBLE) AS l_extendedprice", f"IF(id % 19 = 0, NULL, {at} + id * INTERVAL 1 HOUR) AS l_shipdate")
    for name, lines in (("some", rows), ("none", rows.limit(0))):
        lines.write.parquet(str(tmp_path / name / "lineitem.parquet"))
        tables = registry.Tables(spark, str(tmp_path / name))
        base, pages = (views.spark_sql(v)[0] for v in ("v_page_base", "v_pages"))
        want = spark.sql(pages, v_page_base=spark.sql(base, lineitem=tables.lineitem))
        assert tables.v_pages.dtypes == want.dtypes
        assert sorted(map(repr, tables.v_pages.collect())) == sorted(map(repr, want.collect()))
        assert (name == "none") == (want.count() == 0)


@pytest.mark.parametrize("name", ["a9_job_rollup", "a10_qa_gate", "a12_viewer_summary"])
def test_tasks_that_count_jobs_grow_in_number_only(spark, sf, monkeypatch, name):
    """No task reads more than its share of lines or jobs, however few partitions the session has."""
    monkeypatch.setattr(registry, "LINES_A_TASK", 200)
    context = spark.sparkContext._jsc.sc()
    first = context.dagScheduler().nextStageId()
    assert registry.QUERIES[name](spark, sf).collect()
    context.listenerBus().waitUntilEmpty()
    read = []
    for stage in range(first, context.dagScheduler().nextStageId()):
        tasks = context.statusStore().taskList(stage, 0, 10_000)
        read.append(max((tasks.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead() for i in range(tasks.size())), default=0))
    assert 0 < max(read) < 400


#: Counts of jobs over pages, which may be laid out by block.
BY_JOB = (pages.job_rollup, pages.qa_gate, pages.viewer_summary)


@pytest.mark.parametrize("of", BY_JOB)
def test_one_job_of_many_pages(spark, largest, tmp_path, of):
    """One job holds nearly all pages: its blocks are counted in many tasks."""
    lines = spark.range(N).selectExpr(
        "IF(id % 50 = 0, id, 1) AS l_orderkey", "id * 7 % 2000 AS l_partkey", "id % 11 AS l_suppkey", "CAST(id AS INT) AS l_linenumber", "CAST(id % 50 AS DOUBLE) AS l_quantity",
        "CAST(id AS DOUBLE) AS l_extendedprice", "TIMESTAMP '1998-03-04 05:06:07' AS l_shipdate")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    tables = registry.Tables(spark, str(tmp_path))
    tables.page_parts = 16
    found = of(tables.page_blocks, tables.page_parts).collect()
    assert largest() < N / 4
    assert len(found) == N // 50 + 1
    assert sorted(map(repr, found)) == sorted(map(repr, of(tables.v_pages).collect()))


@pytest.mark.parametrize("of", BY_JOB)
def test_jobs_of_odd_lines(spark, tmp_path, of):
    """Lost and negative keys, jobs of several blocks, lost approvals and none at all are counted as the view's own pages are."""
    rows = spark.range(6000).selectExpr(
        "IF(id % 37 = 0, NULL, id % 40 - 8) AS l_orderkey", "IF(id % 29 = 0, NULL, id * 7 % 2000) AS l_partkey", "IF(id % 23 = 0, NULL, id % 11) AS l_suppkey", "CAST(IF(id % 31 = 0, NULL, id % 517 - 90) AS INT) AS l_linenumber",
        "IF(id % 13 = 0, NULL, CAST(id % 50 AS DOUBLE)) AS l_quantity", "CAST(id AS DOUBLE) AS l_extendedprice", "TIMESTAMP '1998-03-04 05:06:07' AS l_shipdate")
    for name, lines in (("some", rows), ("none", rows.limit(0))):
        lines.write.parquet(str(tmp_path / name / "lineitem.parquet"))
        tables = registry.Tables(spark, str(tmp_path / name))
        base, view = (views.spark_sql(v)[0] for v in ("v_page_base", "v_pages"))
        want = of(spark.sql(view, v_page_base=spark.sql(base, lineitem=tables.lineitem)))
        found = of(tables.page_blocks, tables.page_parts)
        assert found.dtypes == want.dtypes
        assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
        assert (name == "none") == (want.count() == 0)
        assert tables.page_blocks.where("NOT page_block <=> floor(page_number / 64)").count() == 0
