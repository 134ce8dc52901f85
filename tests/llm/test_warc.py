import gzip

import pytest

from weekcast.llm.common import read_table, scratch_dir
from weekcast.llm.warc import chunked, cuts, digest_of, parse, read_archive, round_trip, unchunked, write_archive

SCHEMA = "page_id long, url string, html string, row long, digest string, target struct<a:int>"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x", None) for i, u, h in rows], SCHEMA)


def brute(rows):
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        last = max(same) if same else None
        first = i == last
        out.append((str(i), len(raw), digest_of(raw), "response" if first else "revisit", None if first else last))
    return sorted(out, key=str)


def result(df):
    return sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_whole_table_comes_back(spark):
    pages = read_table(spark, "/root/testdata/sf0.001", "pages")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    back = round_trip(pages)
    assert result(back) == brute(rows)
    html = {i: h for i, _, h in rows}
    assert all(bytes(r.payload).decode() == html[r.page_id] for r in back.collect() if r.record_type == "response")


def test_edge_cases(spark):
    long = "é漢🙂\r\n\r\nWARC/1.1\r\n0\r\n\r\n" * 9000
    rows = [(1, "http://a/ü\r\nX: 1", long), (2, None, None), (3, "u", ""), (4, "u", long), (5, "u", long + "x"), (6, "u", "\r\n\r\n"), (7, "u", "\x00"), (9, "u", long)]
    assert result(round_trip(frame(spark, rows).repartition(3))) == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    back = round_trip(frame(spark, [(1, "u", "a"), (1, "u", "a"), (None, "u", "a"), (None, "u", "b")])).collect()
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in back) == [("1", "response", "None"), ("1", "revisit", "1"), ("None", "response", "None"), ("None", "revisit", "1")]


def test_empty(spark):
    assert round_trip(frame(spark, [])).collect() == []


def test_files_are_plain_warc(spark):
    path = f"{scratch_dir(spark)}/plain"
    write_archive(frame(spark, [(1, "http://a/b", "x" * 50000), (2, "http://a/c", "y")]).coalesce(1), path)
    files = spark.read.format("binaryFile").load(path).where("length > 0").collect()
    found = [r for f in files for r in parse(gzip.decompress(f.content))]
    kinds = sorted(f["warc-type"] for f, _ in found)
    assert kinds == ["continuation"] * 3 + ["response"] * 2
    assert [f["warc-segment-number"] for f, _ in found if "warc-segment-number" in f] == ["1", "2", "3", "4"]


@pytest.mark.parametrize("change", [lambda raw: raw.replace(b"x" * 40, b"x" * 39 + b"z", 1), lambda raw: raw.replace(b"Segment-Number: 3", b"Segment-Number: 2")])
def test_damage_raises(spark, change):
    path = f"{scratch_dir(spark)}/damaged"
    write_archive(frame(spark, [(1, "http://a/b", "x" * 50000)]).coalesce(1), path)
    raw = b"".join(gzip.decompress(f.content) for f in spark.read.format("binaryFile").load(path).where("length > 0").collect())
    bad = f"{scratch_dir(spark)}/bad"
    spark.createDataFrame([(change(raw)[:-4].decode(),)], "v string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(bad)
    with pytest.raises(Exception, match="match its digest|missing or doubled"):
        read_archive(spark, bad).collect()


def test_chunk_framing():
    for raw in (b"", b"a", "é".encode() * 20000):
        assert unchunked(chunked(raw)) == raw
    assert b"".join(cuts("ä漢".encode() * 100, 7)) == "ä漢".encode() * 100
    for bad in (b"3\r\nab\r\n0\r\n\r\n", b"1\r\na\r\n0\r\n\r\nx"):
        with pytest.raises(ValueError):
            unchunked(bad)


def test_an_input_that_is_read_in_another_order_each_time(spark):
    """50 pages twice each, shuffled anew on every reading: one response and one revisit of each."""
    from pyspark.sql import functions as F

    pages = spark.range(100).select((F.col("id") % 50).alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("page "), (F.col("id") % 50).cast("string")).alias("html"))
    df = pages.repartition(7, F.rand()).sortWithinPartitions(F.rand())
    back = round_trip(df).collect()
    assert sorted(r.record_type for r in back) == ["response"] * 50 + ["revisit"] * 50
    assert {r.page_id for r in back if r.record_type == "response"} == set(range(50))


def test_small_ids_and_files(spark, monkeypatch):
    from pyspark.sql import functions as F

    from weekcast.llm import warc

    monkeypatch.setattr(warc, "FILE_RECORDS", 3)
    df = frame(spark, [(i, "u", "x" * i * 5000) for i in range(20)]).withColumn("page_id", F.col("page_id").cast("smallint"))
    back = round_trip(df)
    assert back.schema["page_id"].dataType.simpleString() == "smallint"
    assert sorted((r.page_id, r.payload_bytes) for r in back.collect()) == [(i, 5000 * i) for i in range(20)]


def test_without_payloads_the_rest_is_the_same(spark):
    rows = [(i, "u", "y" * (i % 4) * 9000) for i in range(12)]
    full, bare = round_trip(frame(spark, rows)), round_trip(frame(spark, rows), payloads=False)
    assert result(full) == result(bare) == brute(rows)
    assert all(r.payload is None for r in bare.collect())
