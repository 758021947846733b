"""Continuous jobs over several micro-batches: state carries over, timers fire, state goes."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from leafmill.streaming import jobs, state
from pyspark.sql import functions as F

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def batches(spark, path, schema, *parts):
    """A stream that reads each part as a batch of its own."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/{i}")
        moved = next((path / "in" / str(i)).glob("part-*.parquet"))
        (path / "files").mkdir(exist_ok=True)
        moved.rename(path / "files" / f"{i}.parquet")
    stamp = 1_700_000_000
    import os

    for i in range(len(parts)):
        os.utime(path / "files" / f"{i}.parquet", (stamp + i, stamp + i))
    return jobs.read(spark, str(path / "files"), files_per_trigger=1)


class Watch:
    """Rows of state after the last batch of every stream that ran meanwhile."""

    def __init__(self, monkeypatch):
        from pyspark.sql.streaming import StreamingQuery

        self.left, wait = [], StreamingQuery.awaitTermination

        def then(query, *args):
            out = wait(query, *args)
            self.left.append([sum(o.numRowsTotal for o in p.stateOperators) for p in query.recentProgress])
            return out

        monkeypatch.setattr(StreamingQuery, "awaitTermination", then)


@pytest.fixture
def watch(monkeypatch):
    return Watch(monkeypatch)


def test_a_task_that_never_speaks_again_is_stale(spark, tmp_path, watch):
    rows = batches(spark, tmp_path, "task_id long, ts timestamp", [(1, at(0)), (2, at(0)), (2, at(50)), (3, None)], [(2, at(900)), (2, at(5000))], [(2, at(9000)), (2, at(8000))])
    found = {(r.task_id, r.stale_from, r.stale_at) for r in jobs.run(jobs.stale_tasks(rows, 600, "10 seconds"), "stale").collect()}
    assert found == {("1", at(0), at(600)), ("2", at(50), at(650)), ("2", at(900), at(1500)), ("2", at(5000), at(5600)), ("2", at(8000), at(8600))}
    assert max(watch.left[0]) == 2 and watch.left[0][-1] == 1  # task 1 has left the state


def test_alerts_fire_at_their_time_without_a_tick(spark, tmp_path, watch):
    ticks = [
        ("quiet", 0, True), ("other", 0, False),  # no second tick: fires by the timer
        ("denied", 0, True), ("denied", 599, False),
        ("agrees", 0, True), ("agrees", 0, False), ("agrees", 700, None),
        ("gap", 0, True), ("gap", 400, True), ("gap", 2000, True),  # the second run starts at 2000
    ]
    later = [("other", 3600, False), ("quiet", 30, True)]
    rows = batches(spark, tmp_path, "series string, ts timestamp, firing boolean", [(s, at(t), f) for s, t, f in ticks[:3]], [(s, at(t), f) for s, t, f in ticks[3:]], [(s, at(t), f) for s, t, f in later[:1]], [("other", at(9000), False)])
    found = {(r.series, r.since, r.fired_at) for r in jobs.run(jobs.alerts(rows, 600, 1000, "2000 seconds"), "alerts").collect()}
    assert found == {("quiet", at(0), at(600)), ("gap", at(0), at(600)), ("gap", at(2000), at(2600))}
    assert watch.left[0][-1] == 0  # conditions without ticks have ended


def by_rule(ticks, hold, absent, end):
    """Alerts of one series by going through its moments one by one; ``end`` is the watermark at the end."""
    moments = sorted({t for t, _ in ticks})
    says = {m: all(f for t, f in ticks if t == m) for m in moments}
    out, since, last, told = [], None, None, False
    for m in [*moments, None]:
        if since is not None:
            until = last + absent if m is None or (says[m] and m - last <= absent) else min(m, last + absent)
            if m is not None and says[m] and m - last <= absent:
                until = m + 1  # it goes on
            limit = max(end, last) if m is None else m
            if not told and since + hold < until and since + hold <= limit:
                out.append(since)
                told = True
            if m is not None and not (says[m] and m - last <= absent):
                since = None
        if m is not None and says[m]:
            since, told = (m, False) if since is None else (since, told)
            last = m
    return out


@pytest.mark.parametrize("seed", range(3))
def test_alert_runs_equal_a_walk(seed):
    """One batch, and the same ticks in several batches of ordered ticks."""
    rng, hold, absent = random.Random(seed), 50, 70
    import pandas as pd

    for cuts in (1, 4):
        ticks = sorted((rng.randrange(0, 3000), rng.random() < 0.8) for _ in range(150))
        got, held, done = [], None, 0
        bounds = [0, *sorted(rng.sample(range(1, 150), cuts - 1)), 150]
        process = state.Persisting(hold, absent)
        for a, b in zip(bounds, bounds[1:], strict=False):
            while 0 < b < 150 and ticks[b][0] == ticks[b - 1][0]:
                b += 1
            if b <= done:
                continue
            part, done = ticks[done:b], b
            shuffled = rng.sample(part, len(part))
            held, _, out = process.rows(("s",), [pd.DataFrame(shuffled, columns=["at", "firing"])], held)
            got += list(out.get("since", []))
        end = 10_000
        if held:
            held, _, out = process.due(("s",), held, end)
            got += list(out.get("since", []))
            assert held is None
        assert got == by_rule(ticks, hold, absent, end)


def test_cooldowns_and_pages_leave_the_state(spark, tmp_path, watch):
    day = 86_400
    schema = "trigger_type string, trigger_id long, fired_at timestamp, status string"
    one = [("a", 1, at(0), "x"), ("a", 2, at(0), "x"), ("a", 3, at(6 * day), "x"), ("b", 4, at(day), "resolved"), ("zz", 5, at(0), "x"), (None, 6, at(0), "x")]
    two = [("a", 7, at(7 * day), None), ("b", 8, at(7 * day), "x")]
    three = [("a", 9, at(13 * day), "x"), ("b", 10, at(40 * day), "x")]
    four = [("b", 11, at(60 * day), "x")]
    rows = batches(spark, tmp_path / "t", schema, one, two, three, four) if (tmp_path / "t").mkdir() is None else None
    found = {r.trigger_id: r.outcome.removeprefix("skipped_") for r in jobs.run(jobs.triggers(rows, ("a", "b")), "triggers").collect()}
    assert found == {1: "recorded", 2: "cooldown", 3: "cooldown", 4: "resolved", 5: "unknown", 6: "unknown", 7: "recorded", 8: "recorded", 9: "cooldown", 10: "recorded", 11: "recorded"}
    assert watch.left[0][0] == 1 and max(watch.left[0]) == 2 and watch.left[0][-1] == 1  # only b's last one is still cooling down
    (tmp_path / "p").mkdir()
    schema = "page_id string, seq long, expected string, target string, ts timestamp"
    one = [("p", 1, "queued", "failed", at(0)), ("p", 2, "preprocessing", "accepted", at(1)), ("q", 3, "queued", "preprocessing", at(0)), ("q", 4, None, "failed", at(0)), ("q", 5, "preprocessing", "rectification", at(2))]
    two = [("q", 6, "queued", "preprocessing", at(50)), ("r", 7, "queued", "preprocessing", at(20 * day))]
    three = [("q", 8, "queued", "preprocessing", at(30 * day))]
    found = {r.seq: (r.applied, r.state) for r in jobs.run(jobs.page_states(batches(spark, tmp_path / "p", schema, one, two, three), idle_days=15), "pages").collect()}
    assert found[3] == (True, "preprocessing") and found[4] == (False, "preprocessing") and found[6][0] is False
    assert found[8] == (True, "preprocessing")  # forgotten, so it is queued again
    assert watch.left[1][-1] == 2


def test_page_moves_equal_a_walk():
    import pandas as pd
    from leafmill.operators.pages import TERMINAL, TRANSITIONS

    rng = random.Random(3)
    names = [*TRANSITIONS, *TERMINAL, None]
    moves = [(a, b) for a, to in TRANSITIONS.items() for b in to]
    rows = [(i, *(rng.choice(moves) if rng.random() < 0.9 else (rng.choice(names), rng.choice(names)))) for i in range(3000)]
    now, want = "queued", []
    for i, expected, target in rows:
        ok = expected == now and target in TRANSITIONS.get(now, ())
        now = target if ok else now
        want.append((i, ok, now, now in TERMINAL))
    frames = [pd.DataFrame([(i, 0, e, t) for i, e, t in part], columns=["seq", "at", "expected", "target"]) for part in (rows[1500:], rows[:1500])]
    _, _, out = state.PageState(1).rows(("p",), frames, None)
    assert list(zip(out["seq"], out["applied"], out["state"], out["completed"], strict=True)) == want


def test_one_metric_runs_in_blocks_over_batches(spark, tmp_path, monkeypatch):
    """A stream of a single metric equals one window over everything, and no task of it holds much of it."""
    rng = random.Random(5)
    rows = [("m", rng.random(), at(i // 3), i) for i in range(4000)] + [(None, 1.0, at(0), 9000), ("n", None, at(0), 9001)]
    schema = "metric string, value double, ts timestamp, seq long"
    stream = batches(spark, tmp_path, schema, rows[:1000], rows[1000:1100] + rows[4000:], rows[1100:4000])
    base = spark.createDataFrame([("m", 0.5, 0.01)], "metric string, mean double, std double")
    sizes, whole = [], jobs.sequence.in_blocks

    def seen(*args):
        found = whole(*args)
        if not found.isStreaming:
            sizes.append(found.groupBy("metric", "block").count().agg(F.max("count")).first()[0])
        return found

    monkeypatch.setattr(jobs.sequence, "in_blocks", seen)
    found = {r.seq: r for r in jobs.drift(stream, base, size=50, block=200).collect()}
    assert len(found) == 4002 and found[9000].window_n == 1 and found[9001].window_mean is None
    values = [r[1] for r in rows[:4000]]
    for i in range(4000):
        window = values[max(0, i - 49) : i + 1]
        assert found[i].window_n == len(window) and abs(found[i].window_mean - np.mean(window)) < 1e-9
        assert found[i].drifted == (abs(np.mean(window) - 0.5) > 0.03) or abs(abs(np.mean(window) - 0.5) - 0.03) < 1e-9
    assert max(sizes) <= 250


def test_counters_carry_their_last_sample(spark, tmp_path):
    rng = random.Random(8)
    rows = sorted((("s", at(40 * i), float(rng.randrange(100))) for i in range(600)), key=lambda r: r[1]) + [("t", at(0), 5.0), ("t", at(100), None), ("t", at(200), 7.0), ("t", at(300), 9.0)]
    stream = batches(spark, tmp_path, "series string, ts timestamp, value double", rows[:200], rows[200:201], rows[201:], [("s", at(10), 1e9)])
    found = {(r.series, r.window_start): r.increase for r in jobs.counter_increase(stream, "1 hour", "1 hour", block=50).collect()}
    want, before = {}, {}
    for s, t, v in rows:
        p = before.get(s)
        gain = 0.0 if p is None else v - p if v is not None and v >= p else v if v is not None else None
        hour = t.replace(minute=0, second=0)
        if gain is not None:
            want[s, hour] = want.get((s, hour), 0.0) + gain
        before[s] = v
    # the sample that came last is older than the one before it: it gives nothing
    assert found == pytest.approx(want)


def test_streams_of_nothing(spark, tmp_path):
    schema = "metric string, value double, ts timestamp, seq long, series string, firing boolean, task_id long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    for file in (tmp_path / "in").glob("part-*"):
        file.unlink()
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    base = spark.createDataFrame([("m", 0.5, 0.01)], "metric string, mean double, std double")
    assert jobs.drift(stream, base).count() == 0
    assert jobs.counter_increase(stream, "1 hour", "1 hour").count() == 0
    assert jobs.run(jobs.alerts(stream, 5, 5), "alerts").count() == jobs.run(jobs.stale_tasks(stream, 5), "stale").count() == 0


def test_small_files_lie_in_few_folders_and_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """S6: no folder for each page, and hashes right, also for a null text."""
    import hashlib

    from leafmill.plans import QUERIES, stream_queries

    root = f"file://{tmp_path}"
    monkeypatch.setattr(stream_queries, "new_path", lambda spark, name: f"{root}/{name}")
    spark.range(300).selectExpr("id AS page_id", "IF(id = 7, NULL, concat('<p>', id)) AS html").coalesce(1).write.parquet(f"{root}/sf/pages.parquet")
    found = {r.hash: (r.byte_size, r.n_files, r.n_changed) for r in QUERIES["s6_artifacts"](spark, f"{root}/sf").collect()}
    bodies = [b"\n" if i == 7 else f"<p>{i}\n".encode() for i in range(300)]
    assert found == {hashlib.sha256(b).hexdigest(): (len(b), 1, int(i % 10 == 3)) for i, b in enumerate(bodies)}
    files = list((tmp_path / "artifacts").glob("*/part-*"))
    assert len(files) == 300 and len({f.parent for f in files}) == 10
    assert len({f.name[:10] for f in files}) > 1
