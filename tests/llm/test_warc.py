"""Archives written and read back, byte by byte."""

import base64
import hashlib
import io
import struct

import zstandard

from signalloom.llm import warc

TYPES = "page_id long, url string, html string, digest string, payload string"


def _pages(n=400):
    page = "<html><head><title>%d</title></head><body>" + "<p class='x'>same words on every page</p>" * 20 + "%d</body></html>"
    rows = [(i, f"http://a.example/{i}?q=%20\n", page % (i // 2, i // 2), "clash", None) for i in range(n)]
    return rows + [(n, None, None, None, None), (n + 1, "u", "", None, None), (n + 2, "http://x/é", "é" * 200_000, None, None), (None, "null id", page % (0, 0), None, None),
                   (None, "null id alone", "unseen", None, None), (0, rows[0][1], rows[0][2], None, None)]


def _expected(rows, least=0):
    first, out = {}, []
    for p, _, h, *_ in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    for p, _, h, *_ in rows:
        data = (h or "").encode()
        at = first.get(h or "") if len(data) >= least else None
        to = None if at is None or p == at else at
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def test_round_trip(spark, frame, tmp_path):
    rows = _pages()
    for least in (0, 1, 100_000):
        folder, manifest = warc.write_archives(frame(rows, TYPES), str(tmp_path / str(least)), min_bytes=least)
        read = warc.read_archives(folder, manifest).collect()
        assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read), key=str) == _expected(rows, least)
        html = {r["page_id"]: r["payload"] for r in read if r["record_type"] == "response" and r["page_id"]}
        assert all(html[p] == (h or "").encode() for p, _, h, *_ in rows if p in html)
        urls = {r["page_id"]: r["url"] for r in read}
        assert urls[402] == "http://x/é" and urls[400] is None and urls[3] == "http://a.example/3?q=%2520%0A"


def test_archive_form(frame, tmp_path):
    """A leading skippable frame with the dictionary, then a frame per record, each readable alone at its offset."""
    folder, manifest = warc.write_archives(frame(_pages(), TYPES, 1), str(tmp_path / "form"))
    rows = manifest.orderBy("file", "offset").collect()
    seen = 0
    for name in {r["file"] for r in rows}:
        data = open(f"{folder}/{name}", "rb").read()
        magic, size = struct.unpack("<II", data[:8])
        if magic != warc.MAGIC:
            continue
        seen += 1
        dictionary = zstandard.ZstdCompressionDict(data[8:8 + size])
        assert dictionary.dict_id() != 0
        mine = [r for r in rows if r["file"] == name]
        assert mine[0]["offset"] == 8 + size and sum(r["length"] for r in mine) + 8 + size == len(data)
        for r in mine:
            record = zstandard.ZstdDecompressor(dict_data=dictionary).decompress(data[r["offset"]:r["offset"] + r["length"]])
            assert record.startswith(b"WARC/1.1\r\n") and warc.parse_record(record)["page_id"] == r["page_id"]
        assert list(warc.read_frames(io.BytesIO(data), 7)) == list(warc.read_frames(io.BytesIO(data)))
    assert seen


def test_empty_and_rollover(frame, tmp_path):
    folder, manifest = warc.write_archives(frame([], TYPES), str(tmp_path / "none"))
    assert manifest.count() == 0 and warc.read_archives(folder, manifest).count() == 0
    folder, manifest = warc.write_archives(frame(_pages(50), TYPES, 1), str(tmp_path / "many"), most_bytes=5000)
    assert manifest.select("file").distinct().count() > 5
    assert warc.read_archives(folder, manifest).count() == 56


def test_reading_tasks_grow_with_the_archives(frame, tmp_path):
    folder, manifest = warc.write_archives(frame(_pages(), TYPES, 4), str(tmp_path / "dealt"))
    size = manifest.agg({"length": "sum"}).first()[0]
    files = manifest.select("file").distinct().count()
    want = sorted(map(str, warc.read_archives(folder, manifest).collect()))
    for parts in (1, 20):
        read = warc.read_archives(folder, manifest, read_bytes=size // parts)
        n = read.rdd.getNumPartitions()
        assert n >= files and (parts == 1 or n > 15)
        assert sorted(map(str, read.collect())) == want


def test_a_long_first_record_does_not_cost_the_dictionary(frame, tmp_path):
    rows = [(0, "u", "long page " * 300_000, None, None), *[(i, "u", f"<p>{i} some words of a short page</p>" * 20, None, None) for i in range(1, 60)]]
    folder, manifest = warc.write_archives(frame(rows, TYPES, 1), str(tmp_path / "long"))
    for r in manifest.select("file").distinct().collect():
        with open(f"{folder}/{r['file']}", "rb") as stream:
            assert warc._dictionary(stream)
    assert warc.read_archives(folder, manifest).count() == 60


def test_revisits_name_the_record_they_refer_to():
    digest = hashlib.sha1(b"x").digest()
    head = lambda data: dict(line.split(": ", 1) for line in data.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:])
    first, again = head(warc.record_bytes(3, "a", b"x", digest, None)), head(warc.record_bytes(9, "b", b"x", digest, 3))
    assert again["WARC-Refers-To"] == first["WARC-Record-ID"] != again["WARC-Record-ID"]
