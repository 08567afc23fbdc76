"""Versions that commit: what is read and written, killed and repeated writes, the change feed."""

import random

import pytest
from pyspark.sql import functions as F

from bidloom.sources.committed import ChangeSet, CommitConflict, CommittedTable, _Folder

SCHEMA = "id long, number string, place string, score double"


@pytest.fixture
def table(spark, tmp_path):
    return CommittedTable.create(spark, f"file://{tmp_path}/t", SCHEMA, ["number", "place"], 16)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_inserts_keep_what_is_there(spark, table):
    first, fresh = table.insert(frame(spark, (2, "a", "p", 1.0), (1, "a", "p", 2.0), (3, None, "p", 3.0)), "id")
    assert first.version == 1 and rows(fresh) == rows(table.read()) == [(1, "a", "p", 2.0), (3, None, "p", 3.0)]
    second, fresh = table.insert(frame(spark, (4, "a", "p", 9.0), (5, "a", "q", 5.0), (6, None, "p", 6.0)), "id")
    assert second.version == 2 and rows(fresh) == [(5, "a", "q", 5.0)]
    assert rows(table.read(1)) == [(1, "a", "p", 2.0), (3, None, "p", 3.0)] and len(rows(table.read())) == 3
    again, fresh = table.insert(frame(spark, (7, "a", "q", 7.0)))
    assert again.version == 2 and fresh.count() == 0
    assert CommittedTable.create(spark, table.path, SCHEMA, ["number", "place"]).commit().version == 2
    with pytest.raises(ValueError, match="none"):
        CommittedTable.create(spark, table.path + "2", SCHEMA, ["none"])


def test_writes_touch_only_their_buckets(spark, tmp_path):
    table = CommittedTable.create(spark, f"file://{tmp_path}/t", SCHEMA, ["number", "place"], 64)
    table.insert(spark.range(2000).select("id", F.col("id").cast("string").alias("number"), F.lit("p").alias("place"), F.lit(0.0).alias("score")))
    before = {r["file"]: r["bucket"] for r in table.manifest(table.commit()).collect()}
    changes = spark.range(5).select((F.col("id") * 7).cast("string").alias("number"), F.lit("p").alias("place"), F.lit(1.5).alias("score"))
    done = table.update(changes.unionByName(changes.limit(1).withColumn("number", F.lit("absent"))), ["score"])
    after = {r["file"]: r["bucket"] for r in table.manifest(done).collect()}
    gone, come = set(before) - set(after), set(after) - set(before)
    assert {before[f] for f in gone} == {after[f] for f in come} <= set(done.touched) and len(done.touched) <= 6
    assert len(gone) <= 6 and len(come) <= 6
    assert sorted(r["id"] for r in table.read().where("score > 0").collect()) == [0, 7, 14, 21, 28]
    assert table.read().count() == 2000 and table.read(1).where("score > 0").count() == 0
    assert rows(table.find(changes.select("number", "place")).select("score")) == [(1.5,)] * 5


def test_killed_writes_leave_the_old_version(spark, table, monkeypatch):
    table.insert(frame(spark, (1, "a", "p", 1.0)))
    with monkeypatch.context() as m:
        m.setattr(_Folder, "put", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            table.upsert(frame(spark, (1, "a", "p", 2.0)))
    assert table.versions() == [0, 1] and rows(table.read()) == [(1, "a", "p", 1.0)]
    assert table.upsert(frame(spark, (1, "a", "p", 2.0), (2, "b", "p", 3.0))).version == 2
    assert rows(table.read()) == [(1, "a", "p", 2.0), (2, "b", "p", 3.0)]


def test_two_writers_of_a_version(spark, table):
    table.insert(frame(spark, (1, "a", "p", 1.0)))

    def slow(old, new):
        CommittedTable(spark, table.path).upsert(frame(spark, (2, "b", "p", 2.0)))
        return old.unionByName(new)

    with pytest.raises(CommitConflict):
        table.merge(frame(spark, (3, "c", "p", 3.0)), slow)
    assert rows(table.read().select("id")) == [(1,), (2,)]


def test_repeated_batches_change_nothing(spark, table):
    table.insert(frame(spark, (1, "a", "p", 1.0)), writer="w", batch=0)
    add = lambda old, new: old.withColumn("score", F.col("score") + 1)
    for batch in (1, 1, 0):
        table.merge(frame(spark, (1, "a", "p", 0.0)), add, "w", batch)
    assert rows(table.read()) == [(1, "a", "p", 2.0)] and table.commit().writers == {"w": 1}
    assert table.merge(frame(spark), add, "w", 2).version == 3 and table.merge(frame(spark), add).version == 3
    assert table.insert(frame(spark), writer="w", batch=2)[0].version == 3


def test_random_writes_and_feed(spark, tmp_path):
    """Against a dictionary; the feed replayed onto an old version gives the new one."""
    table = CommittedTable.create(spark, f"file://{tmp_path}/t", SCHEMA, ["number", "place"], 8)
    rng, want, versions = random.Random(2), {}, [{}]
    for step in range(7):
        some = [(rng.randint(0, 99), rng.choice([None, *"abcdefgh"]), rng.choice("pq"), float(step)) for _ in range(rng.randint(1, 6))]
        some = list({r[1:3]: r for r in some}.values())
        kind = ("insert", "upsert", "insert", "delete", "update", "upsert", "insert")[step]
        if kind == "insert":
            table.insert(frame(spark, *some))
            want = {r[1:3]: r for r in some} | want
        elif kind == "upsert":
            table.upsert(frame(spark, *some))
            want = want | {r[1:3]: r for r in some}
        elif kind == "delete":
            table.delete(frame(spark, *some).select("number", "place"))
            want = {k: v for k, v in want.items() if k not in {r[1:3] for r in some}}
        else:
            table.update(frame(spark, *some), ["score"])
            want = want | {r[1:3]: (want[r[1:3]][0], *r[1:]) for r in some if r[1:3] in want}
        assert rows(table.read()) == sorted(want.values(), key=repr)
        if table.commit().version == len(versions):
            versions.append(dict(want))
    assert table.compact(1).version >= len(versions) - 1 and rows(table.read()) == sorted(want.values(), key=repr)
    for since, until in ((0, len(versions) - 1), (2, 5)):
        state = {k: tuple(v) for k, v in versions[since].items()}
        for r in table.changes(since, until).collect():
            key = (r["number"], r["place"])
            assert (tuple(r["before"]) if r["before"] else None) == state.get(key) and r["kind"] == ("insert" if key not in state else "update" if r["after"] else "delete")
            state = {k: v for k, v in state.items() if k != key} | ({key: tuple(r["after"])} if r["after"] else {})
        assert state == {k: tuple(v) for k, v in versions[until].items()}
    state, seen = {}, []

    def handle(changes, version):
        seen.append(version)
        for r in changes.collect():
            state.pop((r["number"], r["place"]), None)
            if r["after"]:
                state[r["number"], r["place"]] = tuple(r["after"])

    table.feed(handle, f"{tmp_path}/cp").awaitTermination()
    assert state == want and seen == table.versions()[1:]
    table.upsert(frame(spark, (1, "new", "p", 0.0)))
    table.feed(handle, f"{tmp_path}/cp").awaitTermination()
    assert seen == table.versions()[1:] and state == want | {("new", "p"): (1, "new", "p", 0.0)}


def test_streamed_inserts_read_only_their_buckets(spark, tmp_path, monkeypatch):
    """The files that a batch reads don't grow with the store; a batch that is run again adds nothing."""
    from bidloom.streaming import jobs as streams

    base = f"file://{tmp_path}"
    table = CommittedTable.create(spark, f"{base}/t", SCHEMA, ["number", "place"], 32)
    table.insert(spark.range(3000).select("id", F.col("id").cast("string").alias("number"), F.lit("p").alias("place"), F.lit(0.0).alias("score")))
    read, own = [], CommittedTable._rows
    monkeypatch.setattr(CommittedTable, "_rows", lambda self, commit, files, hashed=False: (read.append((hashed, len(files))), own(self, commit, files, hashed))[1])
    for k in range(3):
        frame(spark, (k, str(k), "p", 1.0), (9000 + k, f"new{k}", "p", 1.0)).coalesce(1).write.mode("append").parquet(f"{base}/in")
    seen = []
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    streams.insert_committed(stream(), table, f"{base}/cp", after=lambda df: seen.extend(r["id"] for r in df.collect())).awaitTermination()
    assert sorted(seen) == [9000, 9001, 9002] and table.read().count() == 3003 and table.read().where("score > 0").count() == 3
    hashes, keys = [n for hashed, n in read if hashed], [n for hashed, n in read if not hashed and n < 32]
    assert len(hashes) == 3 and max(hashes + keys) <= 5
    streams.insert_committed(stream(), table, f"{base}/cp2", after=lambda df: seen.extend(r["id"] for r in df.collect())).awaitTermination()
    assert len(seen) == 3 and table.read().count() == 3003


def test_change_sets_in_order(spark, table):
    table.insert(frame(spark, (1, "a", "p", 1.5), (2, "b", "p", 2.5)))
    one, two = ChangeSet("1", add="note string, k int"), ChangeSet("2", copy=lambda df: df.select("number", "place", F.col("score").cast("int").alias("score"), "note"))
    added = table.migrate([one])
    assert added.version == 2 and added.manifest == table.commit(1).manifest and table.migrate([one]).version == 2
    table.update(spark.createDataFrame([("a", "p", "x")], "number string, place string, note string"), ["note"])
    assert rows(table.read()) == [(1, "a", "p", 1.5, "x", None), (2, "b", "p", 2.5, None, None)]
    assert table.migrate([one, two]).applied == ("1", "2")
    assert rows(table.read()) == [("a", "p", 1, "x"), ("b", "p", 2, None)] and table.read(1).columns == ["id", "number", "place", "score"]
    with pytest.raises(ValueError, match="first"):
        table.migrate([two, one])
    with pytest.raises(ValueError, match="loses"):
        table.migrate([one, two, ChangeSet("3", copy=lambda df: df.drop("place"))])
    with pytest.raises(ValueError, match="already"):
        table.migrate([one, two, ChangeSet("3", add="note int")])
    assert table.commit().applied == ("1", "2")
