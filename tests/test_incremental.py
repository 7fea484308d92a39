import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import incremental as inc

RANGE = "stream string, lo bigint, hi bigint"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def runs(numbers):
    out = []
    for x in sorted(numbers):
        if out and out[-1][1] + 1 == x:
            out[-1][1] = x
        else:
            out.append([x, x])
    return out


def test_interval_algebra_matches_sets_of_numbers(spark):
    rng = random.Random(2)

    def some(n):
        return [(rng.choice("ab"), lo, lo + rng.randrange(0, 9)) for lo in (rng.randrange(60) for _ in range(n))]

    a, p = some(20), some(15)
    for s in "ab":
        have = {x for st, lo, hi in a if st == s for x in range(lo, hi + 1)}
        done = {x for st, lo, hi in p if st == s for x in range(lo, hi + 1)}
        merged = rows(inc.merge_intervals(spark.createDataFrame(a, RANGE)).filter(F.col("stream") == s))
        assert [list(r[1:]) for r in merged] == runs(have)
        left = rows(inc.subtract_intervals(spark.createDataFrame(a, RANGE), spark.createDataFrame(p, RANGE)).filter(F.col("stream") == s))
        assert [list(r[1:]) for r in left] == runs(have - done)


def test_degenerate_ranges(spark):
    bad = spark.createDataFrame([(None, 1, 2), ("a", None, 2), ("a", 5, 4)], RANGE)
    assert rows(inc.merge_intervals(bad)) == []
    assert rows(inc.subtract_intervals(bad, bad)) == []


def records(spark, numbers):
    return spark.createDataFrame([("s", n, f"v{n}") for n in numbers], "stream string, seq bigint, value string")


def test_ledger_takes_gaps_and_late_records_once(spark, tmp_path):
    led = inc.IntervalLedger(spark, str(tmp_path / "ledger"))
    work = lambda d: d.select("seq", "value")
    led.run(records(spark, [1, 2, 3, 7, 8]), "stream", "seq", work)
    with pytest.raises(ZeroDivisionError):  # a failing run leaves nothing behind
        led.run(records(spark, range(1, 12)), "stream", "seq", lambda d: 1 / 0)
    assert rows(led.processed()) == [("s", 1, 3), ("s", 7, 8)]
    led.run(records(spark, range(1, 12)), "stream", "seq", work)
    m = led.run(records(spark, range(1, 12)), "stream", "seq", work)
    assert m["version"] == 2 and rows(led.processed()) == [("s", 1, 11)]
    assert sorted(r.seq for r in led.output("seq bigint, value string").collect()) == list(range(1, 12))


def test_second_commit_of_a_version_fails(spark, tmp_path):
    led = inc.IntervalLedger(spark, str(tmp_path / "l"))
    before = led.manifest()
    led.run(records(spark, [1]), "stream", "seq", lambda d: d.select("seq"))
    with pytest.raises(RuntimeError):
        led.commit(before, spark.createDataFrame([("s", 2, 2)], RANGE), None)
    with pytest.raises(RuntimeError):
        led.versions.create(1, {"version": 1})
    assert rows(led.processed()) == [("s", 1, 1)]


def test_half_written_versions_count_as_nothing(spark, tmp_path):
    led = inc.IntervalLedger(spark, str(tmp_path / "l"))
    led.run(records(spark, [1]), "stream", "seq", lambda d: d.select("seq"))
    (tmp_path / "l" / "versions" / "000000000002.json").write_text('{"version": 2, "inter')
    assert rows(led.processed()) == [("s", 1, 1)]
    led.run(records(spark, [1, 2]), "stream", "seq", lambda d: d.select("seq"))
    assert rows(led.processed()) == [("s", 1, 2)] and led.manifest()["version"] == 3
    assert sorted(r.seq for r in led.output("seq bigint").collect()) == [1, 2]


STATE = "repo_id string, path string, hash string, language string, indexed_at double"


def test_file_index_reads_new_files_only_and_survives_failures(spark, tmp_path, monkeypatch):
    src = str(tmp_path / "files")
    taken = []

    def work(d):
        taken.append(sorted((r.path, r.hash) for r in d.collect()))
        return d.select("path", "hash")

    def add(*states):
        spark.createDataFrame([("r", p, h, "py", t) for p, h, t in states], STATE).coalesce(1).write.mode("append").parquet(src)

    index = inc.FileIndex(spark, str(tmp_path / "index"), buckets=4)
    add(("a", "1", 1.0), ("b", "1", 1.0), ("b", "1", 1.0))
    assert index.register_folder(src) == 1 and index.register_folder(src) == 0
    index.run(work)
    add(("a", "2", 5.0), ("c", "1", 2.0))
    add(("a", "0", 0.5), ("d", "1", 0.1))  # late rows, one of them overtaken before it came
    read = index.unread(src)
    assert len(read) == 2 and sum(spark.read.parquet(p).count() for p in read) == 4
    for fail in ("states", "batch"):  # a crash before the batch commits: the same files are read again
        with monkeypatch.context() as m:
            m.setattr(inc.Versions, "create", lambda *a: 1 / 0) if fail == "batch" else m.setattr(inc.F, "row_number", lambda: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                index.register_folder(src)
        assert index.unread(src) == read and index.states().count() == 2
    assert index.register_folder(src) == 2
    seqs = [(r.stream, r.seq) for r in index.states().collect()]
    assert len(seqs) == len(set(seqs)) == 5
    with pytest.raises(ZeroDivisionError):  # a crash in the work
        index.run(lambda d: 1 / 0)
    with monkeypatch.context() as m:  # a crash after the output was written, before it commits
        m.setattr(inc.Versions, "create", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.run(work)
    taken.pop()
    index.run(work)
    index.run(work)
    add(("b", "2", 3.0), ("b", "3", 4.0))
    index.register_folder(src)
    add(("b", "4", 6.0))
    index.register_folder(src)  # the state before was never taken up
    index.run(work)
    assert taken == [[("a", "1"), ("b", "1")], [("a", "2"), ("c", "1"), ("d", "1")], [("b", "4")]]
    assert rows(index.backlog()) == []
    assert sorted(tuple(r) for r in index.ledger.output("path string, hash string").collect()) == [("a", "1"), ("a", "2"), ("b", "1"), ("b", "4"), ("c", "1"), ("d", "1")]


def test_a_state_that_returns_is_new(spark, tmp_path):
    index = inc.FileIndex(spark, str(tmp_path / "i"))
    got = []
    for t, h in enumerate(["x", "y", "x"]):
        index.register(spark.createDataFrame([("r", "a", h, "py", float(t))], STATE))
        index.run(lambda d: (got.append(d.first().hash), d.select("path"))[1])
    assert got == ["x", "y", "x"]


def test_expand_splits_wide_gaps(spark):
    gaps = spark.createDataFrame([("s", 3, 9000)], RANGE)
    got = inc.expand(gaps, records(spark, [2, 3, 4096, 8191, 8192, 9000, 9001]), "stream", "seq")
    assert sorted(r.seq for r in got.collect()) == [3, 4096, 8191, 8192, 9000]


def test_backlog_rules(spark):
    files = spark.createDataFrame(
        [("r", "done", "h1", "py", 1.0), ("r", "old", "h2", "py", 2.0), ("r", "old", "h1", "py", 1.0), ("r", "none", "h3", None, 1.0), ("r", "mixed", "h4", "py", 1.0), ("r", "done", "h1", "py", 1.0), (None, "x", "h", "py", 1.0)],
        "repo_id string, path string, hash string, language string, indexed_at double",
    )
    chunks = spark.createDataFrame(
        [("r", "done", "h1"), ("r", "old", "h1"), ("r", "mixed", "h4"), ("r", "mixed", "h0"), ("r", "gone", "h9"), ("r", "done", None)], "repo_id string, file_path string, file_hash string"
    )
    assert rows(inc.backlog(files, chunks)) == [("r", "mixed"), ("r", "none"), ("r", "old")]
    assert rows(inc.backlog(files.limit(0), chunks)) == []
    assert len(rows(inc.backlog(files, chunks.limit(0)))) == 4


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_backlog_by_repository_with_and_without_time_zone(spark, kind, zone):
    at = 1710052200.25  # 2024-03-10 06:30 UTC; 02:30 on that day does not exist in New York
    files = spark.createDataFrame([("r", "a", "1", "go", at - 0.5), ("r", "b", "1", "go", at + 0.5), ("r", "c", "1", "go", at - 9), ("s", "a", "1", "go", at)], "repo_id string, path string, hash string, language string, indexed_at double")
    chunks = spark.createDataFrame([("r", "c", "1")], "repo_id string, file_path string, file_hash string")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        end = "timestamp_micros(1710052200250000)" if kind == "timestamp" else "timestamp_ntz'2024-03-10 06:30:00.25'"
        runs = spark.sql(f"select 'r' as repo_id, {end} as finished_at, 'success' as status union all select 'r', {end} + interval 1 day, 'failed'")
        late = spark.sql("select 'r' as repo_id, timestamp_ntz'2024-03-10 02:30:00' as finished_at, 'success' as status")
        got = inc.backlog_by_repository(files, chunks, runs)
        assert dict(got.dtypes)["last_success"] == kind
        assert rows(got.drop("last_success")) == [("r", 3, 2, 1), ("s", 1, 1, 0)]
        assert rows(inc.backlog_by_repository(files.withColumn("indexed_at", F.col("indexed_at") - 14400), chunks, late).drop("last_success")) == [("r", 3, 2, 1), ("s", 1, 1, 0)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
