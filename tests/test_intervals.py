from concurrent.futures import ThreadPoolExecutor

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomwell.operators import intervals
from loomwell.operators.changes import ChangeRun, pending_keys
from loomwell.sources.commits import CommitLog, Conflict

SEQ = "source string, seq long"


def brute(numbers):
    out = []
    for n in sorted(set(numbers)):
        if out and out[-1][1] == n - 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return [tuple(x) for x in out]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 60), max_size=40))
def test_islands_and_gaps_across_blocks(spark, numbers):
    block, intervals.BLOCK = intervals.BLOCK, 8
    try:
        rows = spark.createDataFrame([("a", n) for n in numbers], SEQ)
        done = intervals.to_intervals(rows)
        assert sorted((r.lo, r.hi) for r in done.collect()) == brute(numbers)
        every = spark.createDataFrame([("a", n, n * 2) for n in range(64)], SEQ + ", hi long")
        left = sorted(r.seq for r in intervals.subtract(every, done, "source", "seq").collect())
        assert left == [n for n in range(64) if n not in numbers]
    finally:
        intervals.BLOCK = block


def test_null_numbers_stay_open(spark):
    rows = spark.createDataFrame([("a", None), (None, 3), ("a", 1)], SEQ)
    done = intervals.to_intervals(spark.createDataFrame([("a", 1)], SEQ))
    got = {tuple(r) for r in intervals.subtract(rows, done, "source", "seq").collect()}
    assert got == {("a", None), (None, 3)}


def test_ledger_neither_skips_nor_repeats(spark, tmp_path):
    ledger = intervals.IntervalLedger(spark, str(tmp_path / "ledger"))
    first = spark.createDataFrame([("a", n) for n in (1, 2, 5)], SEQ)
    todo = ledger.pending(first, "source", "seq")
    assert todo.count() == 3
    todo.write.parquet(f"{ledger.log.stage()}/output")  # a run that died between its two writes
    dead = ledger.log.stage()
    todo.write.parquet(f"{dead}/output")
    intervals.to_intervals(todo).write.parquet(f"{dead}/intervals")  # and one that died before its marker
    assert ledger.pending(first, "source", "seq").count() == 3
    ledger.commit(todo, todo)
    later = spark.createDataFrame([("a", n) for n in (1, 2, 3, 5, 6)], SEQ)  # 3 is late, 6 is new
    todo = intervals.IntervalLedger(spark, str(tmp_path / "ledger")).pending(later, "source", "seq")
    assert sorted(r.seq for r in todo.collect()) == [3, 6]
    ledger.commit(todo, todo)
    assert sorted((r.lo, r.hi) for r in ledger.processed().collect()) == [(1, 3), (5, 6)]
    assert sorted(r.seq for r in ledger.output().collect()) == [1, 2, 3, 5, 6]
    assert ledger.pending(later, "source", "seq").count() == 0
    assert ledger.log.sweep() == 2 and len(ledger.log.folders()) == 2 and ledger.output().count() == 5


def test_commit_of_a_taken_number_fails(spark, tmp_path):
    path = str(tmp_path / "ledger")
    a, b = intervals.IntervalLedger(spark, path), intervals.IntervalLedger(spark, path)
    rows = spark.createDataFrame([("a", 1)], SEQ)
    number = b.next_number()
    a.commit(rows, rows)
    with pytest.raises(Conflict):
        b.commit(rows, rows, number)
    assert a.output().count() == 1


def test_one_of_many_writers_publishes(spark, tmp_path):
    logs = [CommitLog(spark, str(tmp_path / "log")) for _ in range(8)]

    def publish(log):
        try:
            return log.publish(log.stage(), 0)
        except Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        assert sorted(map(str, pool.map(publish, logs))) == ["0"] + ["None"] * 7


REFS = "blog_id string, run_id long, seq long, key string, modified string"


def test_pending_keys(spark, make_posts, make_blogs):
    refs = spark.createDataFrame(
        [
            ("demo", 2, 1, "new", None), ("demo", 2, 2, "same", "2024-07-01T10:00:00Z"), ("demo", 2, 3, "older", "2024-06-01T10:00:00Z"),
            ("demo", 2, 4, "unread", "n/a"), ("demo", 2, 5, "twice", "2024-07-01T10:00:00Z"), ("demo", 2, 6, "twice", "2024-07-02T10:00:00Z"),
            ("demo", 1, 7, "closed run", None), ("demo", 2, 8, None, None), (None, 2, 9, "no blog", None), ("demo", 2, 1, "new", None),
        ], REFS,
    )
    runs = spark.createDataFrame([("demo", 1, "ok", "2025-06-01"), ("demo", 2, "open", "2026-02-01")], "blog_id string, run_id long, status string, t string").selectExpr("*", "cast(t as timestamp) as started_at")
    posts = make_posts(
        [
            {"key": "same", "modified": "2024-07-01 12:00:00"}, {"key": "older", "modified": "2024-07-01 12:00:00"}, {"key": "unread", "modified": "2024-07-01"},
            {"key": "twice", "modified": "2024-07-02 12:00:00"}, {"key": "older", "modified": "2024-06-01T10:00:00Z", "fetched_at": "2025-01-01T00:00:00Z"},
        ]
    )
    got = {tuple(r) for r in pending_keys(refs, runs, posts, make_blogs()).collect()}
    assert got == {("demo", "new"), ("demo", "older")}
    assert pending_keys(refs, runs, posts.limit(0), make_blogs()).count() == 5
    assert pending_keys(refs.limit(0), runs, posts, make_blogs()).count() == 0


def test_runs_resume_where_the_last_commit_stopped(spark, make_posts, make_blogs, tmp_path):
    runs = spark.createDataFrame([("demo", 2, "open")], "blog_id string, run_id long, status string")
    refs = lambda *rows: spark.createDataFrame([("demo", 2, s, k, m) for s, k, m in rows], REFS)
    first = [(1, "a", "2024-07-01T10:00:00Z"), (2, "b", None)]
    cache = make_posts([{"key": "a", "modified": "2024-07-01T10:00:00Z"}])
    run = ChangeRun(spark, str(tmp_path / "state"))
    commit, run.taken.commit = run.taken.commit, lambda *a: 1 / 0
    with pytest.raises(ZeroDivisionError):  # dies after the cache was absorbed
        run.take(refs(*first), runs, cache, make_blogs())
    run.taken.commit = commit
    assert {r.key for r in run.keys(run.take(refs(*first), runs, cache, make_blogs())).collect()} == {"b"}
    run = ChangeRun(spark, str(tmp_path / "state"))  # a new process, a late row, a late version of another post
    late = make_posts([{"key": "a", "modified": "2024-07-01T10:00:00Z"}, {"key": "c", "modified": "2024-07-05", "fetched_at": "2025-01-01T00:00:00Z"}])
    more = refs(*first, (3, "c", "2024-07-06"), (4, "a", "2024-07-02T10:00:00Z"))
    assert {r.key for r in run.keys(run.take(more, runs, late, make_blogs())).collect()} == {"a", "c"}
    assert run.keys(run.take(more, runs, late, make_blogs())).count() == 0
    assert {r.key for r in run.keys().collect()} == {"a", "b", "c"}
