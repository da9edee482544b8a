import base64
import hashlib
import io
import random

import pytest
import zstandard

from clewline.llm import warc
from clewline.session import scratch_path

SCHEMA = "page_id bigint, url string, html string"


def back(spark, df, **more):
    return warc.read_archives(warc.write_archives(df, scratch_path(spark, "archives"), **more)).collect()


def test_round_trip(spark, frame):
    rnd = random.Random(6)
    rows = [(k, f"http://a.example/{k}", "".join(rnd.choice("<p>ab é\r\n") for _ in range(rnd.randint(0, 400)))) for k in range(300)]
    rows += [(1000 + k, None, rows[k % 7][2]) for k in range(60)] + [(2000, "http://x\r\ny", None), (2001, "", ""), (3000, "u", "é" * 200_000)]
    got = {int(r.page_id): r for r in back(spark, frame(rows, SCHEMA))}
    first = {}
    for i, _, text in sorted(rows):
        first.setdefault(text or "", i)
    assert len(got) == len(rows)
    for i, url, text in rows:
        r, payload = got[i], (text or "").encode()
        revisit = first[text or ""] != i
        assert r.record_type == ("revisit" if revisit else "response") and r.refers_to == (str(first[text or ""]) if revisit else None)
        assert r.payload_bytes == len(payload) and r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert r.payload is None if revisit else bytes(r.payload) == payload
        assert r.url == (" ".join(url.split()) if url else url)


def test_files_rotate_and_lead_with_their_dictionary(spark, frame):
    rows = [(k, "u", f"<html><body><p>page number {k} of the site</p>" + "the same words again " * 30 + str(random.Random(k).random())) for k in range(3000)]
    manifest = warc.write_archives(frame(rows, SCHEMA), scratch_path(spark, "archives"), file_bytes=8 << 10)
    files = manifest.collect()
    assert len(files) > 3 and sum(f.records for f in files) == 3000
    for f in files:
        fs, path = warc.open_uri(f.path)
        data = fs.open_input_stream(path).read()
        assert len(data) == f.bytes and int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
        size = int.from_bytes(data[4:8], "little")
        words = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        records, rest = 0, data[8 + size :]
        while rest:  # every record is a frame of its own
            one = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
            assert one.decompress(rest).startswith(b"WARC/1.1\r\n")
            rest, records = one.unused_data, records + 1
        assert records == f.records + 1
    assert len(warc.read_archives(manifest).collect()) == 3000


def test_damage_is_seen():
    data = warc.page_record("1", "u", b"hello", None, False).replace(b"hello", b"hellO")
    with pytest.raises(ValueError):
        for headers, block in warc.read_records(io.BytesIO(b"\0" * 8)):
            pass
    assert b"hellO" in data and warc.base32_sha1(b"hello") != warc.base32_sha1(b"hellO")


def test_edge_rows(spark, frame):
    df = frame([(None, None, None), (5, "u", ""), (5, "u", ""), (7, "u", "x"), (None, "v", "y")], SCHEMA)
    got = sorted((r.page_id or "", r.record_type, r.refers_to) for r in back(spark, df))
    assert got == [("", "response", None), ("", "revisit", "5"), ("5", "response", None), ("5", "response", None), ("7", "response", None)]
    assert back(spark, df.where("false")) == []
