import threading
import time
from collections import Counter

import pytest

import tidemark.engine as engine_module
from tidemark.engine import Config, Engine
from tidemark.functions import varint_decode, varint_encode
from tidemark.model import DAY, SECOND, Closed, Conflict, FieldTypeMismatch, InvalidPoint, NotFound, Point, Shape
from tidemark.operators.maintenance import plan_level
from tidemark.service import CallError, Service
from tidemark.streaming import deduplicated, ingest


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, Config(f"file://{tmp_path}/base", shard_width=DAY))


def fill(engine, n=10, step=DAY // 4):
    engine.write_batch([Point("db", "cpu", i * step, {"host": f"s{i % 2}"}, {"usage": float(i), "count": i}) for i in range(n)])


def test_write_and_query(engine):
    fill(engine)
    assert engine.list_databases() == ["db"] and engine.list_measurements("db") == ["cpu"] and engine.list_measurements("no") == []
    rows = engine.query("db", "cpu", 0).collect()
    assert [r.usage for r in rows] == [float(i) for i in range(10)] and rows[0]["count"] == 0
    assert [r["count"] for r in engine.query("db", "cpu", DAY, 2 * DAY, {"host": "s1"}, ["count"]).collect()] == [5, 7]
    assert engine.shards("db", "cpu") == [0, DAY, 2 * DAY] and engine.shards_in("db", "cpu", DAY, 2 * DAY) == [DAY]
    page = engine.query_range("db", "cpu", 0, 10 * DAY, limit=4, offset=2)
    assert (len(page.rows), page.total_count, page.has_more) == (4, 6, True)
    assert engine.query_range("db", "cpu", 0, 10 * DAY, limit=4, offset=20).total_count == 10
    assert engine.query("db", "none", 0).count() == 0
    assert [r.usage for r in engine.query_iterator("db", "cpu", 0, DAY)] == [0.0, 1.0, 2.0, 3.0]
    with pytest.raises(NotFound):
        engine.query_iterator("db", "cpu", 100 * DAY, 101 * DAY)
    assert engine.series("db", "cpu").orderBy("series_id").collect()[0].host == "s0"
    assert engine.health().first() == (True, "1.0.0")


def test_pruning(engine, capsys):
    fill(engine)
    engine.query("db", "cpu", DAY, 2 * DAY, {"host": "s1"}, ["count"]).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(shard_start" in plan and "f_usage" not in plan and "EqualTo(tag_host,s1)" in plan


def test_sparse_fields_and_fill(engine):
    engine.write(Point("db", "m", 5, {"a": "1"}, {"x": 1}))
    engine.write(Point("db", "m", 6, {"b": "2"}, {"y": "t"}))
    assert [tuple(r) for r in engine.query("db", "m", 0).collect()] == [(5, "1", None, 1, None), (6, None, "2", None, "t")]
    assert [tuple(r) for r in engine.query("db", "m", 0, fill=True, fields=["x", "y"]).collect()] == [(5, "1", None, 1, ""), (6, None, "2", 0, "t")]
    with pytest.raises(FieldTypeMismatch):
        engine.write(Point("db", "m", 7, {}, {"x": 1.5}))


def test_validation(engine):
    for bad in (None, Point("", "m", 1), Point("d", "", 1), Point("d", "m", -1), Point("../x", "m", 1), Point("d", "m", 1, {}, {"f": [1]})):
        with pytest.raises(InvalidPoint):
            engine.write(bad)
    with pytest.raises(InvalidPoint):
        engine.write_batch([Point("d", "m", 1, {}, {"x": 1}), Point("d", "m", -1)])
    assert engine.query("d", "m", 0).count() == 1  # those before the bad one stay


def test_catalog(engine):
    engine.create_database("a"), engine.create_database("a"), engine.create_database("_hidden")
    assert engine.list_databases() == ["a"]
    for call in (lambda: engine.create_measurement("no", "m"), lambda: engine.drop_database("no"), lambda: engine.drop_measurement("a", "no"), lambda: engine.drop_measurement("no", "m")):
        with pytest.raises(NotFound):
            call()
    engine.create_measurement("a", "m"), engine.create_measurement("a", "m")
    assert engine.catalog.schema("a", "m") is None
    assert engine.catalog.set_schema("a", "m", {"x": "int64"}) == 1 and engine.catalog.set_schema("a", "m", {"x": "int64", "y": "bool"}) == 2
    with pytest.raises(FieldTypeMismatch):
        engine.catalog.set_schema("a", "m", {"x": "string"})
    engine.catalog.set_retention("a", "m", 5)
    assert engine.catalog.retention("a", "m") == 5
    engine.drop_measurement("a", "m"), engine.drop_database("a")
    assert engine.list_databases() == []


def test_compaction_delete_retention(engine):
    fill(engine), fill(engine)
    key = '{"host":"s0"}'
    assert engine.query("db", "cpu", 0).count() == 20
    engine.delete_range("db", "cpu", key, 0, DAY // 2)
    assert engine.compact("db", "cpu") == [0, DAY, 2 * DAY]
    assert [r["count"] for r in engine.query("db", "cpu", 0).collect()] == [1, 3, 4, 5, 6, 7, 8, 9]
    due = engine.compaction_due("db", "cpu", 1, 1 << 30).collect()
    assert len(due) == 3 and all(r.due for r in due)
    assert engine.apply_retention("db", "cpu", now=4 * DAY, retention=2 * DAY) == [0]
    assert engine.apply_retention("db", "cpu", now=4 * DAY) == []
    assert engine.query("db", "cpu", 0).count() == 6


def test_batch_keeps_what_came_before_a_change_of_type(engine):
    with pytest.raises(FieldTypeMismatch):
        engine.write_batch([Point("d", "m", 1, {}, {"x": 1}), Point("d", "m", 2, {}, {"x": 1.5}), Point("d", "m", 3, {}, {"x": 2})])
    assert [r.x for r in engine.query("d", "m", 0).collect()] == [1]


def test_readers_keep_their_files(spark, tmp_path):
    """A query planned before a compaction still reads the old files; they go after the time of grace."""
    engine = Engine(spark, Config(f"file://{tmp_path}/base", shard_width=DAY))
    fill(engine), fill(engine)
    before = engine.query("db", "cpu", 0)
    engine.compact("db", "cpu")
    assert before.count() == 20 and engine.query("db", "cpu", 0).count() == 10
    assert engine.vacuum("db", "cpu") == 0 and engine.vacuum("db", "cpu", now=time.time_ns() + 601 * SECOND) == 6
    assert engine.query("db", "cpu", 0).count() == 10 and engine.vacuum("db", "cpu", now=time.time_ns() + 601 * SECOND) == 0


def test_crash_between_the_steps_of_a_compaction(spark, tmp_path, monkeypatch):
    config = Config(f"file://{tmp_path}/base", shard_width=DAY, grace=0)
    engine = Engine(spark, config)
    fill(engine), fill(engine)
    engine.delete_range("db", "cpu", '{"host":"s0"}', 0, DAY // 2)

    def crash(*_, **__):
        raise RuntimeError("lost power")

    with monkeypatch.context() as m:
        m.setattr("tidemark.engine.found_parts", crash)  # files are written, the manifest doesn't name them
        with pytest.raises(RuntimeError):
            engine.compact("db", "cpu")
    assert engine.query("db", "cpu", 0).count() == 20
    with monkeypatch.context() as m:
        m.setattr(Engine, "vacuum", crash)  # the manifest names the new files, the old ones lie there still
        with pytest.raises(RuntimeError):
            engine.compact("db", "cpu")
    again = Engine(spark, config)  # opening removes what the first crash left
    assert again.query("db", "cpu", 0).count() == 8 and again.vacuum("db", "cpu") == 6
    folders = again.files.folders(f"{tmp_path}/base/db/cpu/data")
    named = {f"batch={p['batch']}" for p in again._manifest("db", "cpu").load()["parts"]}
    assert named <= set(folders) and again.recover() == [f"{config.base}/db/cpu/data/{f}" for f in folders if f not in named]
    assert again.query("db", "cpu", 0).count() == 8


def test_marks_and_writes_during_a_compaction_stay(engine, monkeypatch):
    fill(engine)
    found = engine_module.found_parts

    def meanwhile(files, path, token, level):
        monkeypatch.undo()
        engine.delete_range("db", "cpu", '{"host":"s1"}', 0, 10 * DAY)
        engine.write(Point("db", "cpu", 5, {"host": "s7"}, {"usage": 7.0}))
        return found(files, path, token, level)

    monkeypatch.setattr("tidemark.engine.found_parts", meanwhile)
    engine.compact("db", "cpu")
    assert engine.query("db", "cpu", 0).count() == 11
    engine.compact("db", "cpu")
    assert [r.host for r in engine.query("db", "cpu", 0).collect()] == ["s0", "s7", *["s0"] * 4]


def test_second_compaction_of_the_same_files_changes_nothing(engine, monkeypatch):
    fill(engine), fill(engine)
    found = engine_module.found_parts

    def meanwhile(*args):
        monkeypatch.undo()
        engine.compact("db", "cpu")
        return found(*args)

    monkeypatch.setattr("tidemark.engine.found_parts", meanwhile)
    with pytest.raises(Conflict):
        engine.compact("db", "cpu")
    assert engine.query("db", "cpu", 0).count() == 10


def test_replayed_batch_is_stored_once(spark, engine):
    shape, rows = Shape(tags=("host",), fields=("v",)), [(5, "a", 1.0), (6, "b", 2.0)]
    df = spark.createDataFrame(rows, "timestamp long, host string, v double")
    assert engine.write_frame("db", "s", df, shape, once=("q", 0)) and not engine.write_frame("db", "s", df, shape, once=("q", 0))
    assert engine.write_frame("db", "s", df, shape, once=("q", 1)) and engine.write_frame("db", "s", df, shape, once=("other", 0))
    assert engine.query("db", "s", 0).count() == 6


def test_concurrent_writers(spark, tmp_path):
    engines = [Engine(spark, Config(f"file://{tmp_path}/base", shard_width=DAY)) for _ in range(4)]
    work = [threading.Thread(target=e.write_batch, args=([Point("db", f"m{n % 2}", i, {"host": f"s{n}"}, {f"f{n}": i}) for i in range(5)],)) for n, e in enumerate(engines)]
    for t in work:
        t.start()
    for t in work:
        t.join()
    table = engines[0].table("db", "m0")
    assert table.count() == 10 and table.select("_batch").distinct().count() == 2 and engines[0].list_measurements("db") == ["m0", "m1"]
    assert set(engines[1].catalog.schema("db", "m1")["fields"]) == {"f1", "f3"}


def test_levels(spark, tmp_path):
    engine = Engine(spark, Config(f"file://{tmp_path}/base", shard_width=DAY, grace=0))
    for n in range(10):
        engine.write_batch([Point("db", "cpu", i * DAY // 4, {"host": "a"}, {"n": n * (i == n)}) for i in range(n, n + 3)])
    levels = lambda: Counter((p["shard"] // DAY, p["level"]) for p in engine._manifest("db", "cpu").load()["parts"])
    before = levels()
    assert engine.compact_levels("db", "cpu") == 0 and levels() == before  # no shard has ten parts
    for _ in range(8):
        engine.write(Point("db", "cpu", 1, {"host": "b"}, {"n": 1}))
    rows = engine.query("db", "cpu", DAY).count()
    assert engine.compact_levels("db", "cpu") == 1 and levels()[0, 0] == 0 and levels()[0, 1] == 1
    assert engine.query("db", "cpu", DAY).count() == rows and [(r.timestamp, r.host) for r in engine.query("db", "cpu", 0, 2).collect()] == [(0, "a"), (1, "b")]
    assert all(levels()[k] == n for k, n in before.items() if k[0] > 0)
    engine.maintain(now=10 * DAY)
    assert plan_level([{"batch": "a", "level": 0, "size": 6 << 20}, {"batch": "b", "level": 1, "size": 1}])[0] == 0


def test_unreadable_parts_are_skipped(spark, tmp_path):
    fill(Engine(spark, Config(f"file://{tmp_path}/base", shard_width=DAY)))
    bad = next((tmp_path / "base/db/cpu/data").glob(f"*/shard_start={DAY}/part-*"))
    bad.write_bytes(b"PAR1 no parquet")
    for crc in bad.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="(?i)parquet"):
        Engine(spark, Config(f"file://{tmp_path}/base", shard_width=DAY)).query("db", "cpu", 0).collect()
    lenient = Engine(spark, Config(f"file://{tmp_path}/base", shard_width=DAY, skip_unreadable=True))
    assert [r["count"] for r in lenient.query("db", "cpu", 0).collect()] == [0, 1, 2, 3, 8, 9]


def test_seek(engine):
    fill(engine)
    rows = engine.query_iterator("db", "cpu", 0, offset=1)
    assert next(rows)["count"] == 1
    rows.seek(DAY + 1)
    assert [r["count"] for r in rows] == [5, 6, 7, 8, 9]


def test_old_tombstones_go(engine):
    fill(engine)
    engine.delete_range("db", "cpu", '{"host":"s0"}', 0, 1, now=10), engine.delete_range("db", "cpu", '{"host":"s1"}', 0, DAY, now=50)
    assert engine.drop_old_tombstones("db", "cpu", now=60, retention=30) == 1
    assert [r.mint for r in engine.tombstones("db", "cpu").collect()] == [0]
    assert engine.drop_old_tombstones("db", "cpu", now=600, retention=30) == 0 and engine.tombstones("db", "cpu").count() == 0


def test_upkeep_in_the_background(spark, tmp_path):
    engine = Engine(spark, Config(f"file://{tmp_path}/base", shard_width=DAY, retention=DAY, grace=0))
    fill(engine, 3)
    engine.start_maintenance(0.1)
    for _ in range(100):
        if not engine.shards("db", "cpu"):
            break
        time.sleep(0.1)
    assert engine.shards("db", "cpu") == []
    engine.close()
    assert not engine._upkeep.is_alive()


def test_shard_registry(engine):
    fill(engine)
    found = engine.refresh_shards("db", "cpu")
    assert [(s["start"], s["n_points"], s["n_series"]) for s in found] == [(0, 4, 2), (DAY, 4, 2), (2 * DAY, 2, 2)]
    assert [s["start"] for s in engine.catalog.registered_shards("db", "cpu", DAY, DAY + 1)] == [DAY]
    engine.catalog.update_shard("db", "cpu", 0, n_points=9)
    engine.catalog.unregister_shard("db", "cpu", DAY)
    assert [(s["start"], s["n_points"]) for s in engine.catalog.registered_shards("db", "cpu")] == [(0, 9), (2 * DAY, 2)]
    with pytest.raises(NotFound):
        engine.catalog.unregister_shard("db", "cpu", DAY)


def test_service(engine, tmp_path):
    service = Service(engine)
    point = {"database": "db", "measurement": "m", "timestamp": 7, "tags": {"host": "a"}, "fields": {"x": {"int64": 3}, "ok": {"bool": True}, "s": {"string": "t"}, "f": {"float64": 0.5}}}
    assert service.write(point)["success"] and service.write_batch([point | {"timestamp": 8}])["written"] == 1
    reply = service.query_range({"database": "db", "measurement": "m", "start": 0, "end": 10, "limit": 1})
    assert reply["rows"] == [{k: point[k] for k in ("timestamp", "tags", "fields")}] and reply["has_more"]
    assert service.list_measurements("no") == [] and service.health() == {"healthy": True, "version": "1.0.0"}
    service.create_database("d2"), service.create_measurement("d2", "m2")
    assert service.list_databases() == ["d2", "db"] and service.list_measurements("d2") == ["m2"]
    service.drop_measurement("d2", "m2"), service.drop_database("d2")
    for call, code in (
        (lambda: service.drop_database("no"), "NOT_FOUND"),
        (lambda: service.drop_measurement("db", "no"), "NOT_FOUND"),
        (lambda: service.create_measurement("no", "m"), "INTERNAL"),
        (lambda: service.write(point | {"database": ""}), "INTERNAL"),
        (lambda: service.write(point | {"fields": {"x": {"bytes": b"a"}}}), "INTERNAL"),
    ):
        with pytest.raises(CallError) as e:
            call()
        assert e.value.code == code


def test_import_and_tags(spark, engine, tmp_path):
    (tmp_path / "in.json").write_text('{"timestamp": 5, "host": "a", "v": 1.5}\n{"timestamp": 3, "host": "b"}\n')
    with engine.cancellable("load"):
        engine.import_json("db", "j", f"file://{tmp_path}/in.json", Shape(tags=("host",), fields=("v",)), "timestamp long, host string, v double")
    assert [tuple(r) for r in engine.query("db", "j", 0).collect()] == [(3, "b", None), (5, "a", 1.5)]


def test_streaming(spark, engine, tmp_path):
    source = f"{tmp_path}/in"
    spark.createDataFrame([(1000, "a", 1.0), (1000, "a", 1.0), (2000, "b", 2.0), (-5, "b", 3.0)], "timestamp long, host string, v double").coalesce(1).write.parquet(source)
    shape = Shape(tags=("host",), fields=("v",))
    stream = deduplicated(spark.readStream.schema("timestamp long, host string, v double").parquet(source), shape)
    for _ in range(2):  # the second run finds nothing new
        ingest(engine, stream, "db", "s", shape, f"{tmp_path}/ck").awaitTermination()
    assert [r.v for r in engine.query("db", "s", 0).collect()] == [1.0, 2.0]


def test_closed(engine):
    engine.close(), engine.close()
    with pytest.raises(Closed):
        engine.list_databases()


def test_varints(spark):
    values = [0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**56 - 1, 2**62]
    df = spark.createDataFrame([(v,) for v in values], "n long").withColumn("b", varint_encode("n")).withColumn("back", varint_decode("b"))

    def code(n):
        out = bytearray()
        while n >= 128:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes(out) + bytes([n])

    for r in df.collect():
        assert bytes(r.b) == code(r.n) and r.back == r.n
    broken = spark.createDataFrame([(bytearray(b"\x80"),), (bytearray(b""),), (bytearray(b"\x01\x01"),)], "b binary")
    assert [r[0] for r in broken.select(varint_decode("b")).collect()] == [None, None, None]
