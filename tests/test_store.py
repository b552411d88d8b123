"""The versioned store: folds, one commit for several tables, writers that die or meet, retention, older schemas."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import stats
from tidemark.sources import store
from tidemark.sources.store import Conflict, EpisodeStore

DAY, MINUTE = 86_400 * 10**9, 60 * 10**9
SCHEMA = "id long, pair string, quote string, buy string, sell string, start_ns long, end_ns long, close_reason string, peak_id long, peak_spread long, peak_profit long"


def row(i, start, end, reason, spread):
    return (i, "P-USD", "USD", "a", "b", start, end, reason, i, spread, 2 * spread)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def content(made, name="episodes"):
    return sorted(map(tuple, made.table(name).collect()), key=repr)


def rolled(made):
    return sorted(map(tuple, stats.rollup(made.episodes(), MINUTE).collect()), key=repr)


@pytest.fixture
def made(spark, tmp_path):
    out = EpisodeStore(spark, str(tmp_path / "store"))
    out.flush(frame(spark, row(1, 5, None, None, 10), row(2, DAY + 7, DAY + 9, "spread_closed", 20), row(3, 2 * DAY, None, None, 5)))
    return out


def test_a_store_is_empty_before_its_first_flush(spark, tmp_path):
    for out in (EpisodeStore(spark, str(tmp_path / "none")), EpisodeStore(spark, str(tmp_path / "none"))):
        assert out.episodes().count() == out.rollup(5).count() == out.newest() == out.prune(10, 5) == 0 and out.versions() == []
    assert "peak_spread" in out.episodes().columns


def test_flushes_fold_changes_and_rebuild_the_rollup(spark, made):
    made.flush(frame(spark, row(1, 5, 50, "spread_closed", 30), row(2, DAY + 7, None, None, 99), row(4, DAY + 8, None, None, 1)))
    made.flush(frame(spark))
    assert {r.id: (r.end_ns, r.peak_spread) for r in made.episodes().collect()} == {1: (50, 30), 2: (DAY + 9, 20), 3: (None, 5), 4: (None, 1)}
    assert content(made, "rollup") == rolled(made) and made.newest() == 4
    assert [r.id for r in made.episodes(since=DAY, until=2 * DAY).orderBy("id").collect()] == [2, 4]
    files = made.episodes(since=DAY, until=2 * DAY).inputFiles()
    assert files and all(f"day={1}/" in f for f in files)
    # A reader of an older version sees what it saw.
    assert {r.id for r in made.table("episodes", version=1).collect()} == {1, 2, 3}


def test_another_application_finds_the_store(spark, made):
    assert content(EpisodeStore(spark.newSession(), made.path)) == content(made)


@pytest.mark.parametrize("dies", ["episodes", "rollup", "publish"])
def test_a_flush_or_prune_that_dies_leaves_the_last_version(spark, made, monkeypatch, dies):
    before, rollup = content(made), content(made, "rollup")
    write = EpisodeStore._write

    def fail(self, name, rows):
        if name == dies:
            raise OSError("lost")
        return write(self, name, rows)

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(EpisodeStore, "_write", fail)
        if dies == "publish":
            m.setattr(store._Files, "publish", lost)
        for change in (lambda: made.flush(frame(spark, row(9, 6, 8, "spread_closed", 1))), lambda: made.prune(DAY, 10)):
            with pytest.raises(OSError, match="lost"):
                change()
    other = EpisodeStore(spark, made.path)
    assert content(other) == before and content(other, "rollup") == rollup and other.versions() == [1]
    other.flush(frame(spark, row(9, 6, 8, "spread_closed", 1)))
    assert len(content(made)) == len(before) + 1


def test_of_two_writers_the_second_is_refused(spark, made):
    base = made.manifest()
    made.flush(frame(spark, row(7, 3, None, None, 2)))
    with pytest.raises(Conflict):
        made._put(base, frame(spark, row(8, 4, None, None, 2)), {0})
    assert {r.id for r in made.episodes().collect()} == {1, 2, 3, 7}


def test_a_prune_is_bounded_and_takes_what_it_leaves_alone(spark, made):
    made.flush(frame(spark, row(4, 6, 7, "spread_closed", 40), row(5, 8 + MINUTE, None, None, 3)))
    bucket = lambda m, s, n: (m * MINUTE, s, "P", n)
    made.append(
        buckets=spark.createDataFrame([bucket(0, "s0", 1), bucket(1, "s1", 2), bucket(DAY // MINUTE, "s2", 3)], "bucket_ns long, session string, pair string, samples long"),
        ticks=spark.createDataFrame([(0, "s0"), (MINUTE, "s1"), (DAY, "s2"), (5 * MINUTE, "s3")], "bucket_ns long, session string"),
        sessions=spark.createDataFrame([("s0", 0), ("s1", 1), ("s2", 2), ("s3", 3), ("s4", 2 * DAY)], "session string, started_ns long"),
    )
    # The oldest two go; the bucket of the second minute isn't whole before the cutoff.
    assert made.prune(MINUTE + 10, 2) == 2
    assert {r.id for r in made.episodes().collect()} == {2, 3, 5} and content(made, "rollup") == rolled(made)
    assert {r.session for r in made.table("buckets").collect()} == {"s1", "s2"} and {r.session for r in made.table("ticks").collect()} == {"s1", "s2", "s3"}
    assert {r.session for r in made.table("sessions").collect()} == {"s1", "s2", "s3", "s4"}
    assert made.prune(3 * DAY, 100) == 3 and content(made) == content(made, "rollup") == []
    assert {r.session for r in made.table("sessions").collect()} == set() and made.prune(3 * DAY, 100) == 0


def test_older_schemas_are_read_and_rewritten(spark, tmp_path, monkeypatch):
    out = EpisodeStore(spark, str(tmp_path / "store"))
    with monkeypatch.context() as m:
        m.setattr(store, "FORMAT", 1)
        out.flush(frame(spark, row(1, 5, None, None, 10), row(2, DAY, None, None, 4)).drop("peak_id"))
    out.flush(frame(spark, row(3, DAY + 1, None, None, 5)))
    want = {1: None, 2: None, 3: 3}
    assert {r.id: r.peak_id for r in out.episodes().collect()} == want
    assert {e["format"] for e in out.manifest()["tables"]["episodes"].values()} == {1, 2}
    assert out.migrate() == 2 and out.migrate() == 0  # a day of each table
    assert {e["format"] for days in out.manifest()["tables"].values() for e in days.values()} == {2}
    assert {r.id: r.peak_id for r in out.episodes().collect()} == want


def test_vacuum_keeps_what_versions_list(spark, made):
    for i in range(3):
        made.flush(frame(spark, row(10 + i, 9 + i, None, None, 2)))
    before = content(made)
    assert made.vacuum(1) > 0 and made.versions() == [4]
    assert content(EpisodeStore(spark, made.path)) == before and made.vacuum(1) == 0
    made.flush(frame(spark, row(20, 2, None, None, 2)))
    assert F and len(content(made)) == len(before) + 1
