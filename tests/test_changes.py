"""Changes applied once over failures and restarts, and a polled folder as a stream."""

import hashlib
import os

import pytest

from quarryline.streaming import folder, rollups

SCHEMA = "change_id int, processed boolean"


def put(spark, path, ids):
    spark.createDataFrame([(i, False) for i in ids] + [(1000 + ids[0], True)], SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def run(spark, tmp_path, apply, **more):
    rollups.pending_changes(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), apply, str(tmp_path / "c"), **more).awaitTermination()


def applied(spark, tmp_path):
    return sorted(r.change_id for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_failed_batch_comes_again_once(spark, tmp_path):
    write, failing = rollups.into_batches(str(tmp_path / "out")), {1}

    def apply(rows, batch):
        write(rows, batch)
        if batch in failing:  # after it has written a part
            failing.discard(batch)
            raise ValueError("no")

    for ids in ([1, 2], [3], [4, 5]):
        put(spark, tmp_path / "in", ids)
        run(spark, tmp_path, apply)
    assert applied(spark, tmp_path) == [1, 2, 3, 4, 5]
    log = rollups.ChangeLog(spark, f"{tmp_path}/c-log")
    assert sorted(map(tuple, log.ledger().select("batch", "attempt", "state").collect())) == [(0, 1, "applied"), (1, 2, "applied"), (2, 1, "applied")]


def test_lost_driver(spark, tmp_path, monkeypatch):
    """The driver is lost within a batch, once before it is noted and once after: the batch comes again, or not."""
    write = rollups.into_batches(str(tmp_path / "out"))
    put(spark, tmp_path / "in", [1, 2])

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(rollups.ChangeLog, "_append", lost)  # applied, but not noted
        with pytest.raises(Exception, match="lost"):
            run(spark, tmp_path, write)
    run(spark, tmp_path, write)
    assert applied(spark, tmp_path) == [1, 2]
    # the note is there but the stream's own commit isn't
    for name in os.listdir(tmp_path / "c" / "commits"):
        os.remove(tmp_path / "c" / "commits" / name)
    seen = []
    run(spark, tmp_path, lambda rows, batch: seen.append(batch))
    assert seen == [] and applied(spark, tmp_path) == [1, 2]


def test_dead_batches_are_kept(spark, tmp_path):
    def broken(rows, batch):
        raise ValueError("no")

    put(spark, tmp_path / "in", [1])
    for _ in range(3):
        run(spark, tmp_path, broken, most=2)
    log = rollups.ChangeLog(spark, f"{tmp_path}/c-log", 2)
    assert [tuple(r) for r in log.dead().collect()] == [(0, 2, "no")] and [r.change_id for r in log.failed_rows(0).collect()] == [1]


def test_polled_folder(spark, tmp_path):
    source = tmp_path / "docs"
    source.mkdir()
    folder.register(spark)

    def poll():
        rows = []
        stream = spark.readStream.format("folder_changes").option("path", str(source)).option("state", str(tmp_path / "state")).option("partitionBytes", 5).load()
        stream.writeStream.foreachBatch(lambda df, n: rows.extend(df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return sorted((os.path.basename(r.path), r.change, r.hash) for r in rows)

    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert poll() == []
    (source / "a.txt").write_text("one")
    (source / "sub").mkdir()
    (source / "sub" / "b.txt").write_text("two")
    assert poll() == [("a.txt", "added", md5("one")), ("b.txt", "added", md5("two"))]
    assert poll() == []  # after a restart nothing is told again
    (source / "a.txt").write_text("one more")
    (source / "sub" / "b.txt").unlink()
    (source / "c.txt").write_text("")
    assert poll() == [("a.txt", "changed", md5("one more")), ("b.txt", "deleted", None), ("c.txt", "added", md5(""))]
    assert poll() == []


def test_partitions_by_size(tmp_path):
    reader = folder.FolderReader({"path": str(tmp_path / "d"), "state": str(tmp_path / "s"), "partitionBytes": "10"})
    (tmp_path / "d").mkdir()
    for n in range(6):
        (tmp_path / "d" / f"{n}").write_text("x" * 4)
    end = reader.latestOffset()
    parts = reader.partitions(reader.initialOffset(), end)
    assert [len(p.rows) for p in parts] == [2, 2, 2] and reader.latestOffset() == end
