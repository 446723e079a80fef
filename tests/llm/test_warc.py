import hashlib
import os

import zstandard

from granary.llm import warc


def pages(spark):
    big = "é<p>copied</p>" * 200
    rows = [(1, "http://a.example/x y\r\n", big), (2, None, "small"), (3, "u", "small"), (4, "u", big), (5, "u", None), (6, "u", ""),
            (7, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 100), (9, "u", big), (None, "u", big), (9, "u", big), (None, None, None)]
    rows += [(100 + k, f"http://h/{k}", f"page {k} " * (k * 40)) for k in range(60)]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, frame int")


def expected(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        last = max((j for j, _, h in rows if h == html and j is not None), default=None)
        refers = last if len(data) >= 1000 and last is not None and i != last else None
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 5000)
    rows, table = pages(spark)
    folder = f"file://{tmp_path}/archive"
    index = warc.write(table.repartition(2), folder)
    back = warc.read(index, folder).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=repr)
    assert got == expected(rows)
    payloads = {(r.page_id, r.payload_digest): r.payload for r in back if r.record_type == "response"}
    for i, _, html in rows:
        digest = hashlib.sha1((html or "").encode()).hexdigest()
        if (i, digest) in payloads:
            assert bytes(payloads[i, digest]) == (html or "").encode()
    names = {r.bundle for r in index.collect()}
    assert names == {n for n in os.listdir(tmp_path / "archive") if n.endswith(".zst")}
    # Any reader can read a bundle whole; the index leads to single records.
    for name in names:
        with open(tmp_path / "archive" / name, "rb") as f:
            whole = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
        reader = warc.BundleReader(folder, name)
        assert len(reader.frames) > 1
        assert whole == b"".join(reader.frame(k) for k in range(len(reader.frames)))
        for r in index.filter(f"bundle = '{name}'").collect():
            record = warc.parse(reader.frame(r.frame), r.offset)
            assert record["page"] == ("" if r.page_id is None else str(r.page_id)) and record["end"] - r.offset == r.length
        reader.close()


def test_no_pages(spark, tmp_path):
    table = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(table, f"{tmp_path}/none"), f"{tmp_path}/none").count() == 0
