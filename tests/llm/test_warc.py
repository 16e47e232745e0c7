"""op10: round trips, revisits, seeking."""

import hashlib
import io

import zstandard

from sheetwise.llm import warc
from sheetwise.llm.common import shared_path
from sheetwise.llm.warc import BundleReader, BundleWriter, make_record, parse_records, read_archives, read_record, write_archives


def pages(spark):
    same = "<p>" + "same " * 40 + "</p>"
    rows = [(i, f"http://h/{i}", f"<p>page {i} \r\n\r\n" + "x" * (i * 37 % 900)) for i in range(60)]
    rows += [(100, "http://a", same), (90, None, same), (95, "http://b/é", same), (95, "http://b/é", same),
             (101, "http://c", "short"), (102, "http://d", "short"), (103, "http://e", None), (104, "http://f", ""),
             (105, "http://g", "é" * 300_000), (None, "http://h", same), (90, None, same)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_round_trip_and_revisits(spark, monkeypatch):
    rows, df = pages(spark)
    for limit in (200_000, 0):
        monkeypatch.setattr(warc, "MAX_BROADCAST_REVISITS", limit)
        folder = shared_path(spark, "warc-test")
        index = write_archives(df.selectExpr("*", "'x' AS refers_to"), folder, frame_bytes=2000, bundle_bytes=5000)
        assert index.count() == len(rows)
        first = {}
        for p, _, h in rows:
            if p is not None:
                first[h] = min(p, first.get(h, p))
        want = []
        for p, _, h in rows:
            data = (h or "").encode()
            again = len(data) >= 100 and p is not None and first[h] != p
            want.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response",
                         first[h] if again else None))
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
               for r in read_archives(spark, folder).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        entry = index.where("length > 100000").first()
        fields, payload = read_record(folder, entry.bundle, entry.frame, entry.offset, entry.length)
        assert fields["X-Page-Id"] == "105" and payload == ("é" * 300_000).encode()


def test_empty_table(spark):
    _, df = pages(spark)
    folder = shared_path(spark, "warc-empty")
    assert write_archives(df.limit(0), folder).count() == 0
    assert read_archives(spark, folder).count() == 0


def test_tasks_read_in_proportion_to_bytes(spark, monkeypatch):
    rows = [(i, f"http://x/{i}", f"{i} " * 500) for i in range(300)]
    folder = shared_path(spark, "warc-test")
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    index = write_archives(df, folder, frame_bytes=5000)
    assert index.select("bundle").distinct().count() == 1
    size = index.agg({"length": "sum"}).first()[0]
    monkeypatch.setattr(warc, "READ_BYTES", size // 7)
    back = read_archives(spark, folder)
    assert back.rdd.getNumPartitions() >= 7 and back.count() == 300
    held = back.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    assert len(held) >= 7 and max(r["count"] for r in held) < 100


def test_bundles_seek_and_read_as_plain_zstandard():
    class Kept(io.BytesIO):
        def close(self):
            pass

    stream = Kept()
    writer = BundleWriter(stream, frame_bytes=500)
    records = [make_record(i, "http://x", b"y" * i, None, False) for i in range(50)]
    places = [writer.add(r) for r in records]
    writer.close()
    reader = BundleReader(stream)
    assert len(reader) > 5
    for record, (frame, offset, length) in zip(records, places, strict=True):
        assert reader.frame(frame)[offset:offset + length] == record
    stream.seek(0)
    whole = zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True).read()
    assert whole == b"".join(records)
    assert len(list(parse_records(whole))) == 50
