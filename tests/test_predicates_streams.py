"""The mini-language, scalar functions, and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import scalar
from quarry.operators import predicates
from quarry.streaming import streams


@pytest.fixture(scope="module")
def files(spark):
    rows = [("1", "Photo.JPG", "jpg", "image", 2048, "ntfs", "Users/ann/Photo.JPG", True, True), ("2", "a.exe", "exe", "other", 10, "carver", "Windows.old/a.exe", False, None), ("3", "x.txt", "txt", "document", 1536, None, "D:\\Windows\\x.txt", None, False)]
    return spark.createDataFrame(rows, "id string, fileName string, extension string, category string, size long, source string, originalPath string, isDeleted boolean, isValid boolean")


@pytest.mark.parametrize("text, ids", [("", "123"), ("size:>1kb", "13"), ("size:>=2k size:<3k", "1"), ("size:1.5KB", "3"), ("size:many", "123"), ("type:IMAGE", "1"), ("deleted:yes", "1"), ("deleted:no", "23"), ("source:TF", "1"), ("path:users", "1"), ("photo ann", "1"), ("unknown:photo", ""), ("ext:txt x", "3")])
def test_query(files, text, ids):
    assert "".join(sorted(r.id for r in files.filter(predicates.parse_query(text)).collect())) == ids


def test_composite(files):
    f = lambda **k: "".join(sorted(r.id for r in predicates.filter_files(files, **k).collect()))
    assert f() == "123" and f(hide_system=True) == "12" and f(validity="valid") == "1" and f(validity="invalid") == "23"
    assert f(categories=["image", "other"], sources=["ntfs"]) == "1" and f(keyword=" PHOTO ") == "1" and f(keyword="size:<100") == "2"


def test_scalars(spark):
    row = spark.range(1).select(
        scalar.format_size(F.lit(1536)).alias("a"), scalar.format_size(F.lit(-1)).alias("b"), scalar.format_size(F.lit(5 << 50)).alias("c"), scalar.format_size(F.lit(1152)).alias("d"),
        scalar.format_duration(F.lit(59.94)).alias("e"), scalar.format_duration(F.lit(3725.0)).alias("f"), scalar.is_newer(F.lit("1.2.9"), F.lit("v1.10")).alias("g"),
        scalar.guid_text(F.lit(bytes(range(16)))).alias("h"), scalar.utf16le(F.lit("aé\0b".encode("utf-16-le"))).alias("i"), scalar.dos_datetime(F.lit(0x5821), F.lit(0x6000)).cast("string").alias("j"),
        scalar.exif_time(F.lit("2024:02:30 00:00:00")).alias("k"), scalar.domain_path(F.lit("AppDomain-com.x"), F.lit("a/b")).alias("l"), scalar.mount_advice(F.lit("cifs://h/s")).alias("m"),
        scalar.recovery_score(F.lit(0.125), F.lit(None).cast("boolean")).alias("n"), scalar.category_of(F.lit("zst")).alias("o"), scalar.ntfs_file_id(F.lit(255), F.lit(7)).alias("p"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == ("1.50 KB", "unknown", "5.00 PB", "1.13 KB", "59.9 s", "1 h 2 min")
    assert row.g is True and row.h == "03020100-0504-0706-0809-0A0B0C0D0E0F" and row.i == "aé" and row.j == "2024-01-01 12:00:00"
    assert row.k is None and row.l == "Apps/com.x/a/b" and [x.system for x in row.m] == ["darwin", "linux", "windows"] and row.n == 13 and row.o == "archive" and row.p == "ntfs_FF_7"


def test_byte_units_as_printf(spark):
    """One decimal of the exact quotient, ties to the even digit, at any size and with any last unit."""
    rng = random.Random(3)
    sizes = [0, 1023, 1024, 1280, 1792, 3328, (1 << 20) - 1, (1 << 20) - 52, (1 << 52) + 1, 9 << 59, (1 << 63) - 1, -5, None]
    sizes += [rng.randrange(1 << rng.randrange(1, 64)) for _ in range(2000)] + [round((k + 0.65) * (1 << 30)) for k in range(1 << 22, (1 << 22) + 50)]
    d = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", scalar.byte_units("n").alias("a"), scalar.byte_units("n", "KMG").alias("b"))

    def text(n, letters):
        i = sum(n >= 1024**k for k in range(1, len(letters) + 1))
        return f"{float(n) / 1024**i:.1f} {letters[i - 1]}B" if i else f"{n} B"

    for r in d.collect():
        assert (r.a, r.b) == ((None, None) if r.n is None else (text(r.n, "KMGTPE"), text(r.n, "KMG"))), r


def test_format_size_from_integers(spark):
    """Two decimals, half up from whole numbers, at any size and with any last unit."""
    rng = random.Random(4)
    sizes = [0, 1023, 1024, 1152, (1 << 20) - 1, (1 << 50) - 1, (1 << 60) + 5, (1 << 63) - 1, -1, None] + [rng.randrange(1 << rng.randrange(1, 64)) for _ in range(2000)]
    # the size of each unit that first has k hundredths and a half, and the one before it
    sizes += [-(-(200 * k + 2 * j + 1) * 1024**i // 200) - m for i in range(1, 6) for k in (1, 7, 1023) for j in range(0, 100, 9) for m in (0, 1)]
    d = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", scalar.format_size("n").alias("a"), scalar.format_size("n", scalar.SIZE_UNITS[:3]).alias("b"))

    def text(n, units):
        i = sum(n >= 1024**k for k in range(1, len(units) + 1))
        h = (n * 200 + 1024**i) // (2 * 1024**i)
        return "unknown" if n < 0 else f"{h // 100}.{h % 100:02d} {units[i - 1]}" if i else f"{n} B"

    for r in d.collect():
        assert (r.a, r.b) == ((None, None) if r.n is None else (text(r.n, scalar.SIZE_UNITS), text(r.n, scalar.SIZE_UNITS[:3]))), r


def test_glob(spark):
    d = spark.createDataFrame([("a.txt",), ("b/a.txt",), ("c.md",)], "n string")
    ids = lambda p: sorted(r.n for r in d.filter(predicates.matches_any("n", p)).collect())
    assert ids("") == ["a.txt", "b/a.txt", "c.md"] and ids("*.txt") == ["a.txt", "b/a.txt"] and ids("?.[lm]d") == ["c.md"] and ids(" a.* , x") == ["a.txt"]


def test_stream_in_pieces_equals_batch(spark, tmp_path):
    """Files that arrive one by one give the batches, alarms and counts of all at once."""
    rows = [(i, i % 2, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", float(i if i < 60 else 60 + i / 100)) for i in range(120)]
    d = spark.createDataFrame(rows, "event_id long, user_id long, t string, value double").select("event_id", "user_id", F.col("t").cast("timestamp_ntz").alias("ts"), "value")
    for k in range(4):
        d.filter(f"event_id between {30 * k} and {30 * k + 29}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda n: streams.read_files(spark, str(tmp_path / "in"), d.schema, n)
    for f in (lambda s: streams.batched(s, "user_id", ["ts", "event_id"], 25), lambda s: streams.heartbeat(s, "user_id", ["ts", "event_id"], "ts", "value", 0.5, 10)):
        one, four = (sorted(map(str, streams.drain(f(stream(n))).collect())) for n in (None, 1))
        assert one == four and len(one) == 120
    alarms = [r for r in streams.drain(streams.heartbeat(stream(1), "user_id", ["ts", "event_id"], "ts", "value", 0.5, 10)).collect() if r.alarm]
    assert sorted(r.user_id for r in alarms) == [0, 1]
    seen = streams.first_seen(streams.with_time(stream(1), "ts", "1 hour"), ["user_id"])
    assert streams.drain(seen.select("user_id")).count() == 2


def test_session_log(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("size", T.LongType())])
    path = str(tmp_path / "session")
    assert streams.replay(spark, path, schema).collect() == []
    (tmp_path / "session/log").mkdir(parents=True)
    lines = [json.dumps({"id": "a", "seq": 1, "size": 1}), json.dumps({"id": "b", "seq": 2, "size": 5}), json.dumps({"id": "a", "seq": 3, "size": 9}), '{"id": "c", "se']
    (tmp_path / "session/log/part-0.json").write_text("\n".join(lines))
    want = [("a", 3, 9), ("b", 2, 5)]
    assert sorted(map(tuple, streams.replay(spark, path, schema).collect())) == want
    streams.compact(spark, path, schema)
    assert sorted(map(tuple, streams.replay(spark, path, schema).collect())) == want and not list((tmp_path / "session/log").glob("part*"))
    # a snapshot that wasn't finished doesn't count, and a batch that is tried again replaces itself
    (tmp_path / "session/snapshot/upto=9").mkdir()
    (tmp_path / "session/snapshot/upto=9/part-0.json").write_text(json.dumps({"id": "z", "seq": 9, "size": 9}))
    new = spark.createDataFrame([("b", 7, 7)], schema)
    for _ in range(2):
        new.write.mode("overwrite").json(str(tmp_path / "session/log/batch=4"))
    want = [("a", 3, 9), ("b", 7, 7)]
    assert sorted(map(tuple, streams.replay(spark, path, schema).collect())) == want
    streams.compact(spark, path, schema)
    assert sorted(map(tuple, streams.replay(spark, path, schema).collect())) == want and not (tmp_path / "session/log/batch=4").exists()


def test_append_log(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("seq", T.LongType())])
    for k in range(3):
        spark.createDataFrame([(f"k{i % 4}", 10 * k + i) for i in range(6)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    path = str(tmp_path / "log")
    q = streams.append_log(streams.read_files(spark, str(tmp_path / "in"), schema, 1), path, str(tmp_path / "checkpoint"), compact_every=10).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, streams.replay(spark, path, schema).collect())) == [("k0", 24), ("k1", 25), ("k2", 22), ("k3", 23)]
    assert [p.name for p in (tmp_path / "log/snapshot").iterdir() if p.is_dir()] == ["upto=1"]


def test_flushed_batches(spark, tmp_path):
    """Against a plain batcher, in one piece and row by row."""
    times = [0, 10, 20, 99, 100, 150, 201, 202, 203, 204, 205, 206, 500, 501, 700]
    rows = [(i, 1, t) for i, t in enumerate(times)]
    d = spark.createDataFrame(rows, "id long, key long, ms long").select("id", "key", (F.col("ms") / 1000).cast("timestamp").alias("ts"))
    for k in range(3):
        d.filter(f"id div 5 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want, batch, held, last = [], 1, 0, times[0]
    for i, t in enumerate(times):
        want.append((i, batch))
        held += 1
        if held >= 4 or t - last >= 100:
            batch, held, last = batch + 1, 0, t
    for n in (None, 1):
        s = streams.read_files(spark, str(tmp_path / "in"), d.schema, n)
        assert sorted((r.id, r.batch) for r in streams.drain(streams.flushed(s, "key", ["id"], "ts", 4, 100)).collect()) == want


def test_read_order_and_caps(spark):
    from quarry.operators import windows

    d = spark.range(1000).selectExpr("id", "(id * 7919) % 1000 AS offset")
    parts = windows.read_order(d, parts=5).rdd.glom().map(lambda p: [r.offset for r in p]).collect()
    assert sum(parts, []) == list(range(1000)) and len(parts) == 5
    e = spark.createDataFrame([(i, i % 3, 10) for i in range(50)], "id long, depth int, size long")
    assert [r.id for r in predicates.within_caps(e, ["id"], most_bytes=95, most_depth=1).orderBy("id").collect()] == [0, 1, 3, 4, 6, 7, 9, 10, 12]
    assert predicates.within_caps(e, ["id"]).count() == 50


def test_numbers_in_ranges_equal_a_window(spark):
    from quarry.operators import windows

    rows = [(None if i % 50 == 0 else "hot" if i % 3 else f"k{i % 7}", (i * 7919) % 1000, i) for i in range(1000)]
    d = spark.createDataFrame(rows, "k string, o long, id long")
    for order in (["o"], [F.desc("o")], [F.col("o") % 2 == 0, "o"]):
        a, b = (sorted(map(str, f(d, ["k"], order).collect())) for f in (windows.numbered, windows.numbered_ranges))
        assert a == b
