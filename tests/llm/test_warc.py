import base64
import gzip  # noqa: F401
import hashlib

from panelforge.llm import warc
from panelforge.sources.staging import stage_path
from tests.llm import edge

ROWS = [
    (5, "http://a/1", "<p>same</p>"),
    (3, "http://a/2", "<p>same</p>"),
    (3, "http://a/2", "<p>same</p>"),
    (7, None, None),
    (8, "http://a/\r\nX: y", ""),
    (9, "http://ä/", "ünï\u0000 \r\n\r\n WARC/1.1"),
    (10, "http://a/long", "x" * 3_000_000),
    (None, "http://a/none", "<p>same</p>"),
    (None, "http://a/alone", "alone"),
]


def brute(rows, least=0):
    first = {}
    for page, _, html in rows:
        if page is not None:
            key = html or ""
            first[key] = min(first.get(key, page), page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        to = first.get(html or "")
        if len(data) < least or to == page:
            to = None
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "revisit" if to is not None else "response", to))
    return sorted(out, key=edge.key)


def test_round_trip(spark):
    pages = edge.clash(spark.createDataFrame(ROWS, edge.PAGES), "digest", "payload")
    for least in (0, 12):
        found = warc.round_trip(spark, pages, min_bytes=least).collect()
        got = [
            (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
            for r in found
        ]
        assert sorted(got, key=edge.key) == brute(ROWS, least)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_records_are_found_by_one_ranged_read(spark):
    pages = spark.createDataFrame(ROWS, edge.PAGES)
    index = warc.write_archive(pages, stage_path(spark, "warc"), frame_bytes=64, bundle_bytes=500)
    html = {page: text or "" for page, _, text in ROWS}
    entries = index.collect()
    assert len(entries) == len(ROWS) and len({e["bundle"] for e in entries}) > 1
    for entry in entries:
        record = warc.read_record(entry)
        assert record.page_id == entry["page_id"]
        if record.record_type == "response" and record.page_id is not None:
            assert record.payload.decode() == html[record.page_id]
    with_payload = warc.read_archive(index, with_payload=True).where("page_id = 9").first()
    assert bytes(with_payload.payload).decode() == html[9]


def test_many_bundles_are_read_by_many_tasks(spark):
    rows = [(k, f"http://a/{k}", f"<p>{k % 40}</p>" if k % 3 else "") for k in range(600)]
    pages = spark.createDataFrame(rows, edge.PAGES)
    index = warc.write_archive(
        pages, stage_path(spark, "warc"), frame_bytes=1000, bundle_bytes=1000
    )
    assert index.select("bundle").distinct().count() >= 50
    back = warc.read_archive(index, task_bytes=2000)
    assert back.rdd.getNumPartitions() >= 10
    got = [
        (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
        for r in back.collect()
    ]
    assert sorted(got, key=edge.key) == brute(rows)


def test_bundles_are_plain_zstandard(spark):
    import zstandard

    pages = spark.createDataFrame(ROWS[:3], edge.PAGES)
    folder = stage_path(spark, "warc")
    for path in {e["bundle"] for e in warc.write_archive(pages, folder).collect()}:
        system, inner = warc._filesystem(path)
        with system.open_input_file(inner) as source:
            plain = zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True).read()
        assert plain.startswith(b"WARC/1.1\r\n")
