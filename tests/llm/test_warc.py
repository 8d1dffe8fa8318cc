import base64
import glob
import hashlib
import struct

import zstandard

from dialoom.llm import warc
from dialoom.llm.common import table_path

PAGES = "page_id long, url string, html string"


def rows():
    body = "<html>" + "word " * 300
    out = [(i, f"http://h/{i}", body + f"{i % 40}é") for i in range(120)]
    return out + [(500, "u", None), (501, None, ""), (None, "x\r\ny", "only"), (502, "a", "only"), (503, "b", "z" * 3_000_000), (7, "http://h/7", body + "7é")]


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 40_000)
    path = warc.write_archives(spark.createDataFrame(rows(), PAGES), table_path(spark, "warc-test"))
    out = warc.read_archives(spark, path).collect()
    assert len(out) == len(rows())
    top = {}
    for p, _, html in rows():
        top[html or ""] = max(top.get(html or "", -1), -1 if p is None else p)
    pages = {}
    for p, u, html in rows():
        pages.setdefault(p, []).append((u, html or ""))
    for r in out:
        html = pages[r.page_id][0][1]
        raw = html.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        first = r.page_id == top[html]
        assert r.record_type == ("response" if first else "revisit") and r.refers_to == (None if first else top[html])
        assert r.html == (html if first else None)


def test_files_are_standard_archives(spark):
    """A dictionary frame first; every other frame is skippable or decodes singly with that dictionary."""
    path = warc.write_archives(spark.createDataFrame(rows()[:50], PAGES), table_path(spark, "warc-test"))
    files = glob.glob(path.removeprefix("file://") + "/part-*")
    assert files
    for name in files:
        data = open(name, "rb").read()
        magic, size = struct.unpack_from("<II", data)
        assert magic == warc.DICTIONARY_MAGIC
        held = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        whole = zstandard.ZstdDecompressor(dict_data=held).stream_reader(data[8 + size :], read_across_frames=True).read()
        assert whole == b"".join(warc.frames(data)) and whole.startswith(b"WARC/1.1\r\n")


def test_edges(spark):
    clash = spark.createDataFrame([(1, "u", "x", "c"), (1, "u", "x", "c"), (None, "u", "q", "c"), (None, "u", "q", "c")], PAGES + ", digest string")
    out = warc.archive_and_read(clash).collect()
    assert [r.record_type for r in out] == ["response"] * 4
    assert warc.archive_and_read(clash.limit(0)).count() == 0


def test_revisits_name_the_record_they_refer_to(spark):
    path = warc.write_archives(spark.createDataFrame(rows(), PAGES), table_path(spark, "warc-test"))
    heads = [warc.parse(x)[0] for name in glob.glob(path.removeprefix("file://") + "/part-*") for x in warc.frames(open(name, "rb").read())]
    responses = {h["warc-record-id"]: h for h in heads if h["warc-type"] == "response"}
    revisits = [h for h in heads if h["warc-type"] == "revisit"]
    assert revisits and any(h["warc-type"] == "warcinfo" for h in heads)
    for h in revisits:
        response = responses[h["warc-refers-to"]]
        assert response["warc-payload-digest"] == h["warc-payload-digest"] and response["warc-target-uri"] == h["warc-refers-to-target-uri"]
