"""Archives: an exact round trip, and the frames as other readers see them."""

import hashlib
import random

import pytest
import zstandard

from tidemark.llm import warc
from tidemark.llm.common import Scratch


def pages(n=120):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = [(i, f"http://h{i}.example/ä b", "<html>" + " ".join(word() for _ in range(rng.randint(0, 400))) + "é😀</html>") for i in range(n)]
    big = "<p>" + "x y " * 600
    rows += [(500, None, big), (501, "u", big), (502, "line\nbreak", big), (502, "again", big), (None, "u", big), (600, "u", "small"), (601, "u", "small"), (602, "u", None), (603, "u", ""), (604, "u", "\r\n\r\nContent-Length: 7\r\n\r\n" * 60)]
    return rows


def test_round_trip(spark):
    rows = pages()
    table = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, target int")
    scratch = Scratch(spark, "warc")
    folder = scratch.path("files")
    manifest = warc.write_archives(table, folder, scratch)
    got = warc.read_archives(manifest, folder).collect()
    assert len(got) == len(rows) == sum(r["records"] for r in manifest.collect())
    left = {}
    for i, _, html in rows:
        left.setdefault(i, []).append((html or "").encode())
    for r in got:
        payload = left[r["page_id"]][0]
        assert payload in left[r["page_id"]] and r["payload_bytes"] == len(payload)
        assert r["payload_digest"] == hashlib.sha1(payload).hexdigest()
        if r["record_type"] == "response":
            assert r["payload"] == payload and r["refers_to"] is None
        else:
            assert r["payload"] is None and r["refers_to"] == 502 and r["page_id"] in (500, 501)
    assert sum(r["record_type"] == "revisit" for r in got) == 2
    assert warc.read_archives(manifest, folder, payloads=False).where("record_type = 'revisit'").count() == 2
    names, places = [], [r["path"] for r in manifest.collect()]
    for path in places:
        data = open(path, "rb").read()
        assert int.from_bytes(data[4:8], "little") > 100  # a dictionary
        names += [line for raw in warc.records(data) for line in raw.split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(set(names)) == len(names) == len(rows)
    scratch.drop()


def test_file_layout():
    samples = [warc.record(i, "http://a.example", random.Random(i).randbytes(50).hex().encode() * 4, None, "00" * 20) for i in range(400)]
    dictionary = warc.train(samples)
    assert dictionary[:4] == warc.DICT_MAGIC.to_bytes(4, "little")
    held = zstandard.ZstdCompressionDict(dictionary)
    packer = zstandard.ZstdCompressor(level=3, dict_data=held, write_checksum=True)
    data = warc.dictionary_frame(dictionary) + b"".join(packer.compress(s) for s in samples)
    assert data[:4] == warc.DICT_FRAME.to_bytes(4, "little")
    assert list(warc.records(data)) == samples
    # a reader that does not know the dictionary frame skips it
    assert zstandard.ZstdDecompressor(dict_data=held).decompressobj(read_across_frames=True).decompress(data) == b"".join(samples)
    plain = warc.dictionary_frame(b"") + zstandard.ZstdCompressor().compress(samples[0]) + zstandard.ZstdCompressor(level=1).compress(bytes(300_000))
    assert [len(x) for x in warc.records(plain)] == [len(samples[0]), 300_000]
    with pytest.raises(ValueError, match="dictionary frame"):
        list(warc.records(zstandard.ZstdCompressor().compress(b"abc")))


def test_damage_is_found():
    data = warc.record(1, "u", b"payload", None, hashlib.sha1(b"other").hexdigest())
    with pytest.raises(ValueError, match="digest"):
        warc.parse(data)


def test_files_roll_over(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    table = spark.createDataFrame(pages(40), "page_id bigint, url string, html string").coalesce(1)
    scratch = Scratch(spark, "warc")
    folder = scratch.path("files")
    manifest = warc.write_archives(table, folder, scratch)
    assert manifest.count() > 3 and warc.read_archives(manifest, folder).count() == table.count()


def test_no_pages(spark):
    scratch = Scratch(spark, "warc")
    folder = scratch.path("files")
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.read_archives(warc.write_archives(empty, folder, scratch), folder).count() == 0


def test_too_few_to_train(spark):
    """Raw content stands in for a trained dictionary, and reads back; very long payloads too."""
    assert warc.train([]) == b"" and warc.train([b"abc"] * 3) == b"abcabcabc"
    scratch = Scratch(spark, "warc")
    folder = scratch.path("files")
    rows = [(1, "u", "<p>one</p>"), (2, "u", "y" * 3_000_000), (None, None, None)]
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string"), folder, scratch)
    got = {r["page_id"]: r["payload"] for r in warc.read_archives(manifest, folder).collect()}
    assert got == {1: b"<p>one</p>", 2: b"y" * 3_000_000, None: b""}
