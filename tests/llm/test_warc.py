import gzip
import hashlib
import io
import os
import zlib
from collections import Counter

from corpusmill.llm.warc import (archive_pages, headers, inflate, normalise, parse_record, read_index, read_records,
                                 record_bytes, split_records)

PAGES = [(1, "http://a/", "x" * 1000), (2, "http://b/\r\nX: y", "x" * 1000), (3, None, "x" * 999), (4, "u", "x" * 999),
         (5, "u", None), (6, "u", ""), (7, "u", "é" * 600), (8, "u", "é" * 600), (8, "u", "é" * 600), (None, "u", "é" * 600),
         (9, "u", "WARC/1.0\r\n\r\nContent-Length: 3\r\n\r\n"), (10, "u", "y" * 200_000)]


def expected():
    out = Counter()
    for i, _, h in PAGES:
        b = (h or "").encode()
        top = max((j for j, _, g in PAGES if (g or "").encode() == b and j is not None), default=None)
        again = len(b) >= 1000 and top is not None and i != top
        out[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None)] += 1
    return out


def test_pages_come_back(spark, tmp_path):
    df = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, digest int").repartition(2)
    got = archive_pages(df, folder=str(tmp_path), roll_bytes=5000).collect()
    seen = Counter()
    for r in got:
        if r["type"] == "response":
            assert hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] and len(r["payload"]) == r["payload_bytes"]
        else:
            assert r["payload"] is None
        seen[(r["id"], r["payload_bytes"], r["payload_digest"], r["type"], r["refers_to"])] += 1
    assert seen == expected()
    index = read_index(spark, str(tmp_path / "normal")).collect()
    assert len(index) == len(PAGES)
    for e in index:                             # each entry is one whole gzip member
        with open(e["archive"], "rb") as f:
            f.seek(e["offset"])
            rec = zlib.decompress(f.read(e["length"]), 31)
        assert parse_record(rec)["type"] == e["type"]
    raw = [n for n in os.listdir(tmp_path / "raw") if n.endswith(".warc.gz")]
    assert len(raw) > 2 and not [n for n in os.listdir(tmp_path / "normal") if n.endswith(".tmp")]


def test_normal_archives_stay_as_they_are(spark, tmp_path):
    folder = tmp_path / "again"
    folder.mkdir()
    src = tmp_path / "mixed.warc.gz"
    recs = [record_bytes(i, "u", b"p" * i, i, "d") for i in range(5)]
    src.write_bytes(gzip.compress(recs[0] + recs[1]) + gzip.compress(recs[2]) + gzip.compress(recs[3] + recs[4]))
    for k in range(2):
        out = folder / str(k)
        out.mkdir()
        arch = spark.createDataFrame([(str(src),)], "archive string")
        assert normalise(arch, str(out)).first()["records"] == 5
        src = out / "mixed.warc.gz"
    assert src.read_bytes() == (folder / "0" / "mixed.warc.gz").read_bytes()
    assert sorted(r["payload_bytes"] for r in read_records(read_index(spark, str(folder / "1"))).collect()) == [0, 1, 2, 3, 4]


def test_streams_in_small_chunks():
    data = gzip.compress(record_bytes(1, "u", b"abc", 3, "d") + record_bytes(2, "u", b"", 0, "d", refers_to=1))
    recs = list(split_records(inflate(io.BytesIO(data), size=7)))
    assert [parse_record(r)["refers_to"] for r in recs] == [None, 1]
    assert headers(recs[0].split(b"\r\n\r\n")[0])["warc-type"] == "response"


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert archive_pages(df).count() == 0
