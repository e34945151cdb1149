import hashlib

import pytest
import zstandard

from strandline.llm import warc

SCHEMA = "page_id bigint, url string, html string, payload_digest string, n int, response_id int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, 2) for r in rows], SCHEMA).repartition(2)


def test_round_trip_with_copies_and_odd_rows(spark):
    long, other = "é" * 600, "y" * 1000
    rows = [(1, "http://a/\r\nX: y", long), (2, None, long), (3, "u", "x" * 999), (4, "u", "x" * 999), (5, "u", None), (6, "u", ""),
            (7, "u", other), (7, "u", other), (None, "u", other), (8, "u", "\r\n\r\nHTTP/1.1" * 9), (9, "u", "z" * 300_000)]
    got = sorted((tuple(r) for r in warc.warc_round_trip(pages(spark, rows)).collect()), key=str)
    refers = {(1, long): 2, (None, other): 7}
    want = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        to = refers.get((page_id, html))
        want.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to))
    assert got == sorted(want, key=str)


def test_no_pages(spark):
    assert warc.warc_round_trip(pages(spark, [])).count() == 0


def test_archives_stand_alone_and_damage_is_seen(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>common words of all pages {i}</p>" * 40) for i in range(300)]
    manifest = warc.write_archives(warc.plan_records(pages(spark, rows)), f"file://{tmp_path}").collect()
    assert sum(m.n_records for m in manifest) == 300
    path = manifest[0].path
    data = open(path, "rb").read()
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE_DICTIONARY
    size = int.from_bytes(data[4:8], "little")
    assert zstandard.ZstdCompressionDict(data[8:8 + size]).dict_id()  # trained, not raw
    assert len(list(warc.frames(path))) == manifest[0].n_records
    record = next(iter(warc.frames(path)))
    assert warc.parse_record(record)[3] == "response"
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"common words", b"uncommon wds", 1))
