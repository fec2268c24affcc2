"""Splitting rules, key spaces, records and encodings by their known values and by properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import encode, keyspace
from millrace.functions.keyspace import KeyRange
from millrace.operators import order, reduce, splits, status
from millrace.sources import blobs, hadoop
from millrace.sources.ranges import numbers
from millrace.streaming import slices


def test_midpoints():
    assert keyspace.midpoint("a", "c") == "b" and keyspace.midpoint("aa", "ac") == "ab"
    assert keyspace.midpoint("a", "b") == "a" + chr(63) and keyspace.midpoint("a", "ab") == "a" + chr(49)
    assert keyspace.split_strings("a", "c", 1) == ["b"] == keyspace.split_strings("a", "d", 1)
    assert keyspace.split_strings("a", "d", 3) == ["a" + chr(63), "b", "c"]
    assert keyspace.split_strings("a", "z", 5) == ["d", "g", "m", "p", "s"]


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(min_codepoint=32, max_codepoint=126), max_size=6), st.text(st.characters(min_codepoint=32, max_codepoint=126), max_size=6))
def test_midpoint_lies_between(a, b):
    low, high = sorted((a, b))
    if low != high:
        assert low <= keyspace.midpoint(low, high) <= high
    assert low <= keyspace.bisect(low, high) or low == high


def test_key_ranges_split():
    whole = KeyRange(0, 100)
    first, second = whole.split()
    assert (first.start, first.end, first.direction) == (0, 50, "DESC") and (second.start, second.end, second.direction) == (50, 100, "ASC")
    assert first.include_end and not second.include_start
    assert KeyRange(None, 5).split() == [KeyRange(None, 5)] and KeyRange(5).split()[0].direction == "DESC"
    assert KeyRange.from_json(whole.to_json()) == whole and whole.after(7).start == 7
    assert keyspace.split_id(1, 9) == 5 and keyspace.split_id("a", "c") >= "a" and keyspace.split_id(5, "x") == "\0"
    with pytest.raises(ValueError):
        keyspace.split_id("a", 5)


def test_key_range_reaches_the_scan(spark, folder):
    df = spark.read.parquet(f"{folder}/orders.parquet").where(KeyRange(5, 90).predicate(F.col("o_orderkey"))).select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,5)" in plan and "LessThan(o_orderkey,90)" in plan and "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_number_ranges(spark):
    values = lambda a, b, n: [list(range(x, y)) for x, y in splits.number_ranges(a, b, n)]
    assert values(0, 4, 2) == [[0, 1], [2, 3]] and values(0, 3, 2) == [[0, 1], [2]]
    assert values(0, 5, 5) == [[0], [1], [2], [3], [4]] and [x for v in values(0, 5, 10) for x in v] == [0, 1, 2, 3, 4]
    assert splits.number_ranges(2**31 + 3, 2**31 + 7, 2) == [(2**31 + 3, 2**31 + 5), (2**31 + 5, 2**31 + 7)]
    for a, b, n in ((-1, 0, 1), (5, 5, 1)):
        with pytest.raises(ValueError):
            splits.number_ranges(a, b, n)
        with pytest.raises(ValueError):
            numbers(spark, a, b, n)
    assert numbers(spark, 3, 20, 4).rdd.getNumPartitions() == 4
    assert [r["value"] for r in numbers(spark, 3, 20, 4).orderBy("value").collect()] == list(range(3, 20))


def test_byte_and_member_splits():
    assert splits.byte_ranges(199, 2) == [(0, 99), (99, 199)] and splits.byte_ranges(200, 2, 5) == [(0, 200)]
    assert splits.byte_splits(1024, 1) == [(0, 1024)] and splits.byte_splits(1024, 3) == [(0, 341), (341, 682), (682, 1024)]
    assert splits.byte_splits(3, 10) == [(0, 1), (1, 2), (2, 3)]
    assert splits.pack_members([3 + i for i in range(10)], 2) == [(0, 7), (7, 10)]
    line = lambda k: len("\n".join(f"archive 0 file {k} line {i}" for i in range(k + 1)))
    sizes = [line(k) for k in range(3)]
    for blob_count, shards, readers in ((1, 2, 2), (1, 4, 2), (2, 2, 2), (2, 4, 4), (2, 6, 4), (2, 3, 2), (3, 2, 3)):
        assert len(splits.pack_archives({str(b): sizes for b in range(blob_count)}, shards)) == readers
    assert splits.reduce_ranges("j", "a", "c", 2) == [("j_a_0", "j_b_0"), ("j_b_0", "jz")] and splits.reduce_ranges("j", "n", "n", 3) == [("j_n_0", "jz")]


RECORDS = [b"I", b"am", b"RecordReader", b"Hello", b"", b"world", b"!"]
DATA = b"".join(r + b"\xff" for r in RECORDS)
AT = [sum(len(r) + 1 for r in RECORDS[:k]) for k in range(8)]


def test_byte_records():
    got = lambda *a, **b: [RECORDS.index(r) for _, r in blobs.byte_records(DATA, 0xFF, *a, **b)]
    s = AT[3]
    assert got() == list(range(7)) == [RECORDS.index(r) for _, r in blobs.byte_records(DATA, -1)]
    assert got(s, s + 2, True) == [3] and got(s, s + 2, False) == []
    assert got(s, AT[4], True) == [3, 4] and got(s, AT[4], False) == [4]
    assert got(s - 2, AT[4], False) == [3, 4] and got(s - 1, AT[4], False) == [3, 4]
    assert got(AT[4], AT[4], True) == [4]
    assert [r for _, r in blobs.byte_records(b"a\xffb\xffextra", 0xFF)] == [b"a", b"b", b"extra"]
    assert list(blobs.byte_records(b"foo\nbar\nfoobar")) == [(0, b"foo"), (4, b"bar"), (8, b"foobar")]
    assert list(blobs.byte_records(b"foo\nbar\nfoobar", start=1, leading=False)) == [(4, b"bar"), (8, b"foobar")]
    with pytest.raises(ValueError):
        list(blobs.byte_records(b"", 300))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"", b"a", b"bc", b"\r", b"def"]), max_size=12), st.booleans(), st.lists(st.integers(0, 40), max_size=5))
def test_every_record_comes_once_wherever_it_is_cut(parts, ended, cuts):
    data = b"\n".join(parts) + (b"\n" if ended and parts else b"")
    bounds = sorted({0, len(data), *(c for c in cuts if c < len(data))})
    whole = list(blobs.byte_records(data))
    pieces = [r for a, b in zip(bounds, bounds[1:], strict=False) for r in blobs.byte_records(data, start=a, end=b)]
    assert pieces == whole
    assert b"".join(r + b"\n" for _, r in whole).rstrip(b"\n") == data.rstrip(b"\n")


def test_lines_and_archives(spark, tmp_path):
    import zipfile

    (tmp_path / "a.txt").write_bytes(b"foo\r\n\nbar\nlast")
    assert [r[0] for r in blobs.lines(spark, str(tmp_path / "a.txt")).collect()] == ["foo\r", "", "bar", "last"]
    assert sorted(map(tuple, blobs.line_offsets(spark, str(tmp_path / "a.txt")).collect())) == [(0, "foo\r"), (5, ""), (6, "bar"), (10, "last")]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        for i in range(3):
            z.writestr(f"{i}.txt", "\n".join(f"file {i} line {k}" for k in range(i + 1)))
    files = spark.read.format("binaryFile").load(str(tmp_path / "b.zip"))
    assert [r["filename"] for r in blobs.zip_files(files).orderBy("file_index").collect()] == ["0.txt", "1.txt", "2.txt"]
    assert [(r["file_index"], r["byte_offset"], r["line"]) for r in blobs.zip_lines(files).orderBy("file_index", "byte_offset").collect()][-2:] == [(2, 14, "file 2 line 1"), (2, 28, "file 2 line 2")]
    assert blobs.blob_info(spark, str(tmp_path / "b.zip")).first()["length"] == (tmp_path / "b.zip").stat().st_size
    assert blobs.validate({"blob_keys": "a,b"}) == ["a", "b"]
    for bad in ({}, {"blob_keys": []}, {"blob_keys": ["k"] * 247}):
        with pytest.raises(ValueError):
            blobs.validate(bad)
    with pytest.raises(ValueError):
        blobs.validate({"blob_keys": ["a"]}, exists=lambda k: False)


def test_long_keys(spark):
    values = [0, -1, 256, -256, 2**63 - 1, -(2**63), 41]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", encode.long_key(F.col("v")).alias("k"))
    rows = df.withColumn("back", encode.parse_long_key(F.col("k"))).collect()
    assert all(len(r["k"]) == 14 and r["back"] == r["v"] for r in rows)
    assert df.orderBy("k").first()["v"] == 0


def test_encodings(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(encode.descending_key(F.lit(1234567890), F.lit(78))) == "159453012940078"
    assert one(encode.chart_codes(F.array(F.lit(1.0), F.lit(2.0)), F.lit(2 * 1.05))) == "s:d6"[:2] + one(encode.chart_codes(F.array(F.lit(1.0), F.lit(2.0)), F.lit(2.1)))[2:]
    assert one(encode.chart_codes(F.array(F.lit(-1.0), F.lit(9.0), F.lit(None).cast("double")), F.lit(2.0))) == "s:___"
    assert one(encode.elapsed(F.lit(90_061_000))) == "1 day, 01:01:01" and one(encode.elapsed(F.lit(0))) == "00:00:00"
    assert one(encode.parse_raw_key(F.lit("job_a_b_0"))) == "a_b" and one(encode.parse_raw_key(F.lit("job_a"))) is None
    assert one(encode.rate(F.lit(5), F.lit(0))) is None


def test_refills(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(status.refill(F.lit(100), F.lit(1), F.lit(3))) == 34 and one(status.refill(F.lit(100), F.lit(1), F.lit(2))) == 50
    assert one(status.refill(F.lit(100), F.lit(0.5), F.lit(2))) == 0
    assert one(status.refill_whole(F.lit(1000), F.lit(1000), F.lit(2))) == 500 and one(status.refill_whole(F.lit(1000), F.lit(None).cast("long"), F.lit(1))) == 1000


def test_roll_up_rules(spark):
    rows = [("a", "failed", 3, False), ("a", "active", 3, False), ("a", "active", 3, False), ("b", "failed", 2, False), ("b", "success", 2, False), ("c", "success", 3, True), ("c", "failed", 3, True), ("c", "aborted", 3, True), ("d", "active", 3, False), ("e", "success", 1, False)]
    df = spark.createDataFrame(rows, "job string, state string, expected int, abort boolean")
    got = {r["job"]: r["status"] for r in status.roll_up(df, "job", "state", "expected", "abort").collect()}
    assert got == {"a": "active", "b": "failed", "c": "aborted", "d": "failed", "e": "success"}
    strict = {r["job"]: (r["status"], r["kept_shards"]) for r in status.roll_up_strict(df, "job", "state").collect()}
    assert strict == {"a": ("error", 0), "b": ("error", 0), "c": ("error", 0), "d": ("active", 1), "e": ("done", 0)}


class Sums(reduce.Reducer):
    def combine(self, key, rows):
        import pyarrow as pa
        import pyarrow.compute as pc

        return pa.table({"k": rows.column("k").slice(0, 1), "v": pa.array([pc.sum(rows.column("v")).as_py()], pa.int64())})

    def reduce(self, key, rows):
        total = sum(rows.column("v").to_pylist())
        yield {"k": key[0], "total": total, "rows": rows.num_rows}
        yield {"k": key[0], "total": -total, "rows": rows.num_rows}


def test_python_reducer_combines_first(spark):
    rows = [("A", 50)] * 71 + [("A", 400)] * 13 + [("B", 50)] * 3 + [("B", 11)] + [("C", 50)] * 23
    df = spark.createDataFrame(rows, "k string, v long").repartition(3)
    for combines in (True, False):
        out = {r["k"]: r for r in reduce.reduce_groups(df, ["k"], Sums, "k string, total long, rows long", combines).where("total > 0").collect()}
        assert {k: r["total"] for k, r in out.items()} == {"A": 8750, "B": 161, "C": 1150}
        assert out["A"]["rows"] <= (reduce.SALTS if combines else 84)
    assert reduce.reduce_groups(df, ["k"], reduce.Reducer, "k string").count() == 0


def test_values_in_order(spark):
    df = spark.createDataFrame([("b", 2, 1), ("a", 1, 5), ("a", 0, 9), ("a", 2, 5)], "k string, seq int, v int")
    assert {r["k"]: r["values"] for r in reduce.group_values(df, "k", "v", "seq").collect()} == {"a": [9, 5, 5], "b": [1]}
    ranked = order.rank_rows(df, F.col("k"), F.col("seq")).collect()
    assert sorted((r["rank"], r["k"], r["seq"]) for r in ranked) == [(1, "a", 0), (2, "a", 1), (3, "a", 2), (4, "b", 2)]
    assert order.rank_rows(df.limit(0), F.col("k")).count() == 0


def test_pages(spark):
    df = spark.range(5).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    first = order.page(df, "key", 2)
    cursor = order.cursor_of(first, "key", 2).first()[0]
    assert cursor == "k2" and [r[0] for r in order.page(df, "key", 2, cursor).collect()][:2] == ["k2", "k3"]
    assert order.cursor_of(order.page(df, "key", 2, "k4"), "key", 2).first()[0] is None


def test_sequence_files(spark, tmp_path):
    df = spark.range(100).select(F.col("id"), F.concat(F.lit("v"), F.col("id")).alias("v"))
    hadoop.write_sequence(df, "id", "v", str(tmp_path / "seq"))
    assert sorted(map(tuple, hadoop.read_sequence(spark, str(tmp_path / "seq"), "id long, v string").collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "t.txt").write_text("a\nb\n")
    text = hadoop.read_format(spark, str(tmp_path / "t.txt"), "org.apache.hadoop.mapreduce.lib.input.TextInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text", "offset long, line string")
    assert sorted(map(tuple, text.collect())) == [(0, "a"), (2, "b")]


def test_slices_resume_and_deliver_once(spark, tmp_path):
    df = spark.range(0, 50).select("id", (F.col("id") * 2).alias("v"))
    seen = []

    def failing(rows, number):
        seen.append((number, rows.count()))
        if number == 1 and len(seen) == 2:
            raise RuntimeError("a slice is cut short")
        write(rows, number)

    write = slices.write_slice(str(tmp_path / "out"))
    with pytest.raises(Exception, match="cut short"):
        slices.finish(slices.run_slices(df, "id", 0, 50, 20, failing, str(tmp_path / "check")))
    slices.finish(slices.run_slices(df, "id", 0, 50, 20, failing, str(tmp_path / "check")))
    assert seen == [(0, 20), (1, 20), (1, 20), (2, 10)]
    got = spark.read.schema(df.schema).parquet(str(tmp_path / "out" / "slice=*"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    assert slices.width_of(100) == 1500


def test_upserts_of_slices(spark, tmp_path):
    base = spark.range(0, 10).select("id", F.lit("old").alias("v"))
    new = spark.range(5, 25).select("id", F.lit("new").alias("v"))
    put = slices.upsert_slice(str(tmp_path / "t"), base, ["id"])
    slices.finish(slices.run_slices(new, "id", 5, 25, 10, put, str(tmp_path / "c")))
    put(new.where("id >= 15"), 1)
    last = spark.read.parquet(str(tmp_path / "t" / "version=2"))
    assert {r["id"]: r["v"] for r in last.collect()} == {**{k: "old" for k in range(5)}, **{k: "new" for k in range(5, 25)}}


def test_handlers_do_nothing_by_default(spark):
    from millrace.operators.mapper import Mapper, run_mapper

    assert run_mapper(spark.range(10), Mapper, "id long").count() == 0


def test_records_of_texts(spark):
    rows = [(1, "foo\nbar\nfoobar"), (1, "é\n\nx\n"), (2, None), (3, ""), (4, "\n"), (5, "a\r\nb")]
    got = blobs.record_offsets(spark.createDataFrame(rows, "k int, t string"), "t", "k").collect()
    expected = [(k, o, r.decode()) for k, t in rows for o, r in blobs.byte_records((t or "").encode())]
    assert sorted(map(tuple, got)) == sorted(expected)


def test_archives_are_split(spark, tmp_path):
    import zipfile

    from millrace.sources.archives import read_archives

    for b in range(2):
        with zipfile.ZipFile(tmp_path / f"{b}.zip", "w") as z:
            for i in range(3):
                z.writestr(f"{i}.txt", "\n".join(f"archive {b} file {i} line {k}" for k in range(i + 1)))
    paths = [str(tmp_path / f"{b}.zip") for b in range(2)]
    lines = read_archives(spark, paths, "lines", 4)
    assert lines.rdd.getNumPartitions() == 4
    rows = sorted((r["blob_key"], r["file_index"], r["byte_offset"], r["line"]) for r in lines.collect())
    assert len(rows) == 12 and rows[0] == (paths[0], 0, 0, "archive 0 file 0 line 0") and [r[2] for r in rows if r[1] == 2] == [0, 24, 48] * 2
    rest = read_archives(spark, paths[:1], "lines", 1, first=2, offset=24).collect()
    assert [(r["byte_offset"], r["line"]) for r in rest] == [(24, "archive 0 file 2 line 1"), (48, "archive 0 file 2 line 2")]
    members = read_archives(spark, paths[:1], shards=2).collect()
    assert sorted((r["filename"], r["file_size"], bytes(r["body"])[:9]) for r in members)[1] == ("1.txt", 47, b"archive 0")
    assert blobs.blob_query(spark, str(tmp_path / "*.zip"), "ORDER BY path LIMIT 1").first()["path"].endswith("0.zip")
    with blobs.open_blob(paths[0]) as f:
        assert f.read(2) == b"PK" and f.seek(0) == 0 and f.tell() == 0


def test_reader_parameters():
    from millrace.sources.tables import validate

    assert validate({"entity_kind": "k", "namespaces": "a,b"}) == {"entity_kind": "k", "namespaces": ["a", "b"], "batch_size": 50}
    assert validate({"entity_kind": "k", "keys_only": True, "batch_size": "7"}, keys=True)["batch_size"] == 7
    for bad in ({}, {"entity_kind": "k", "batch_size": 0}, {"entity_kind": "k", "batch_size": "x"}, {"entity_kind": "k", "namespaces": 5}, {"entity_kind": "k", "keys_only": True}):
        with pytest.raises(ValueError):
            validate(bad)
    with pytest.raises(ValueError):
        validate({"entity_kind": "k"}, known=lambda kind: False)
