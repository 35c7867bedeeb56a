import pytest
from pyspark.sql import functions as F

from textloom.streaming import carry, sink, source, stateful


@pytest.fixture()
def pieces(spark, tmp_path):
    rows = []
    for k in range(6):
        text = ";".join(f"packet {k}.{i}" for i in range(9)) + (";" if k % 2 else ";rest")
        rows += [(f"k{k}", i, text[a : a + 7]) for i, a in enumerate(range(0, len(text), 7))]
    rows += [("empty", 0, ""), ("none", 0, None), ("all", 0, ";;")]
    at = str(tmp_path / "pieces.parquet")
    spark.createDataFrame(rows, "key string, at long, text string").orderBy("at", "key").coalesce(1).write.parquet(at)
    return at


def run(frame, out, check, name):
    q = frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).queryName(name).start()
    try:
        q.processAllAvailable()
        return [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
    finally:
        q.stop()


def test_packets_over_micro_batches_equal_the_batch(spark, pieces, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    stream = carry.packet_stream(source.table_stream(spark, pieces, rows=20, split=7), "key", "text", "at", ";")
    sizes = run(stream, out, check, "first")
    assert len(sizes) > 2 and max(sizes) <= 20
    want = stateful.packets(spark.read.parquet(pieces), "key", "text", "at", ";")
    got = spark.read.parquet(out)
    assert sorted(map(tuple, got.select("key", "n", "packet").collect())) == sorted(map(tuple, want.collect()))
    # more comes, by a file of its own; the checkpoint goes on with the state it had
    more = [("k0", 99, " is here;new;"), ("all", 1, "x;"), ("k1", 0, "again;")]
    spark.createDataFrame(more, "key string, at long, text string").coalesce(1).write.mode("append").parquet(pieces)
    before = got.count()
    sizes = run(carry.packet_stream(source.table_stream(spark, pieces, rows=20, split=7), "key", "text", "at", ";"), out, check, "second")
    assert sum(sizes) == 3
    rows = {tuple(r) for r in spark.read.parquet(out).select("key", "n", "packet").collect()}
    # a place that k1 had already gives nothing
    assert len(rows) == spark.read.parquet(out).count() == before + 3
    assert {("k0", 9, "rest is here"), ("k0", 10, "new"), ("all", 2, "x")} <= rows


def test_an_idle_key_gives_its_rest(spark, pieces, tmp_path):
    stream = carry.packet_stream(source.table_stream(spark, pieces, rows=1000), "key", "text", "at", ";", idle_ms=1)
    q = stream.writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(40):
            q.awaitTermination(1)
            rest = {r.key: r.packet for r in spark.table("idle").where("NOT complete").collect()}
            if len(rest) == 3:
                break
    finally:
        q.stop()
    assert rest == {"k0": "rest", "k2": "rest", "k4": "rest"}


def test_source_ranges_can_be_read_again(spark, pieces):
    reader = source.TableReader(pieces, 10, 4)
    first = reader.latestOffset()
    second = reader.latestOffset()
    assert sum(first.values()) == 10 and sum(second.values()) == 20
    rows = lambda start, end: [r for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist()]
    assert [r["_place"] for r in rows(first, second)] == list(range(10, 20)) and rows(first, second) == rows(first, second)
    again = source.TableReader(pieces, 10, 4)
    assert again.partitions(second, second) == [] and sum(again.latestOffset().values()) == 30
    with pytest.raises(ValueError, match="no Parquet"):
        source.TableStream({"path": pieces + "-missing"}).schema()


def test_upserts_apply_an_epoch_once(spark, tmp_path):
    t = sink.Upserts(spark, str(tmp_path / "t"), "id long, v string", "id", buckets=4)
    rows = lambda x: spark.createDataFrame(x, "id long, v string, gone boolean")
    read = lambda: {tuple(r) for r in t.read().collect()}
    assert read() == set()
    assert t.apply(rows([(i, "a", False) for i in range(20)]), 0)
    assert t.apply(rows([(3, "b", False), (3, "c", False), (21, "n", False), (4, None, True)]), 1, deleted="gone")
    want = {(i, "a") for i in range(20) if i not in (3, 4)} | {(3, "c"), (21, "n")}
    assert read() == want
    assert not t.apply(rows([(3, "again", False)]), 1, deleted="gone") and read() == want
    assert t.apply(rows([(3, "other stream", False)]), 0, "other")
    assert {tuple(r) for r in t.read(1).collect()} == want
    assert t.apply(rows([]), 2) and t.manifest()["epochs"] == {"": 2, "other": 0}
    with pytest.raises(ValueError, match="null id"):
        t.apply(rows([(None, "x", False)]), 3)
    # a draft that was never published is no version
    assert len(t.versions()) == 4 and t.vacuum(1)
    assert {r.v for r in t.read().where("id = 3").collect()} == {"other stream"}
    second = sink.Upserts(spark, str(tmp_path / "t"), "id long, v string", "id", buckets=4)
    held = second.manifest()
    assert t.apply(rows([(7, "first", False)]), 3)
    with pytest.raises(sink.Conflict):
        second._publish({**held, "version": held["version"] + 1})
    # all rows of a bucket go
    assert t.apply(rows([(i, None, True) for i in range(30)]), 4, deleted="gone") and read() == set()


def test_a_replayed_stream_changes_nothing(spark, pieces, tmp_path):
    t = sink.Upserts(spark, str(tmp_path / "t"), "key string, n long, packet string", "key", buckets=3)
    seen = []

    def twice(batch, epoch):
        done = t.batches("packets", order="n")
        done(batch, epoch)
        done(batch, epoch)
        seen.append(epoch)

    stream = carry.packet_stream(source.table_stream(spark, pieces, rows=15), "key", "text", "at", ";").select("key", "n", "packet")
    q = stream.writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    last = stateful.packets(spark.read.parquet(pieces), "key", "text", "at", ";").groupBy("key").agg(F.max_by(F.struct("n", "packet"), "n").alias("x")).select("key", "x.n", "x.packet")
    assert len(seen) > 2 and {tuple(r) for r in t.read().collect()} == {tuple(r) for r in last.collect()}
