"""Encoding against the library, the histogram against sorting, packing against its promises."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe, tokens

ODD = ["a", "the", "ing", "é", "ß", "漢", "😀", "'s", "'t", " ", "\n", " ", "\x1c", "1", "23", "!", "...", "A", "İ", "Σ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "é", "K", "x" * 30, "aaaaaaaa", "\x00", "ﬁ", " ", "ª", "×", "don't", "______"]


@pytest.fixture(scope="module", params=[True, False])
def coder(request):
    return bpe.encoder(bpe.default_tokenizer(), request.param)


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", None, "a" * 20_000, "lo" * 9000 + " x"]


def test_like_the_library(coder):
    own = texts(1, 4000)
    for text, ids in zip(own, coder.encode_many(own), strict=True):
        want = coder.library.encode(text or "", add_special_tokens=False).ids
        assert ids.tolist() == want
        assert coder.decode(want) == coder.library.decode(want, skip_special_tokens=False)
        assert coder.written(want) == " ".join(map(str, want))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    coder = bpe.encoder(bpe.default_tokenizer())
    assert coder.encode(text).tolist() == coder.library.encode(text, add_special_tokens=False).ids


def test_cache_starts_anew(monkeypatch, coder):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 3)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 40)
    own = texts(2, 200)
    assert [x.tolist() for x in coder.encode_many(own)] == [coder.library.encode(t or "", add_special_tokens=False).ids for t in own]


def test_encode_documents(spark):
    rows = [(1, "Hello there", "x"), (None, None, "y"), (2, "", None), (2, "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = tokens.encode_documents(docs, columns=list(tokens.OUTPUTS)).orderBy("doc_id").collect()
    lib = bpe.encoder(bpe.default_tokenizer()).library
    ids = lib.encode("Hello there", add_special_tokens=False).ids
    last = got[-1] if got[-1]["doc_id"] == 2 else got[1]
    one = next(r for r in got if r["doc_id"] == 1)
    assert one["ids"] == ids and one["n_tokens"] == len(ids) and one["decoded"] == lib.decode(ids, skip_special_tokens=False)
    assert one["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert len(got) == 4 and last["n_tokens"] == 0 and last["decoded"] == "" and last["ids"] == []
    assert tokens.encode_documents(docs.limit(0)).count() == 0


def test_histogram(spark):
    rng = random.Random(3)
    lengths = [int(rng.expovariate(1 / 900)) for _ in range(700)] + [0, 0, 5000]
    hist = tokens.length_histogram(spark.createDataFrame([(x,) for x in lengths] + [(None,)], "n_tokens bigint"), bucket=64)
    got = {r["context_limit"]: r for r in hist.collect()}
    ordered = sorted(lengths)
    assert set(got) == set(lengths)
    for limit, r in got.items():
        assert r["n_docs"] == lengths.count(limit)
        assert r["docs_at_least"] == sum(x >= limit for x in lengths) and r["docs_truncated"] == sum(x > limit for x in lengths)
        assert r["kept_tokens"] == sum(min(x, limit) for x in lengths) and r["cut_tokens"] == sum(lengths) - r["kept_tokens"]
        assert ordered[r["rank_from"] - 1] == limit == ordered[r["rank_to"] - 1]
    for limit, over, kept, cut in tokens.answer_limits(hist, [0, 1, 17, 900, 4999, 5000, 9999]).collect():
        assert kept == sum(min(x, limit) for x in lengths) and over == sum(x > limit for x in lengths) and cut + kept == sum(lengths)


def test_histogram_of_nothing(spark):
    empty = spark.createDataFrame([], "n_tokens bigint")
    assert tokens.length_histogram(empty).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 6), max_size=12), st.integers(1, 60))
def test_fullest_combination(counts, room):
    used = tokens.fullest(counts, room)
    total = sum(k * n for k, n in used.items())
    assert all(n <= counts[k] for k, n in used.items()) and total <= room
    sums = {0}
    for k, n in counts.items():
        sums |= {s + k * i for s in sums for i in range(1, n + 1) if s + k * i <= room}
    assert total == max(sums)


def test_plan_uses_every_piece():
    rng = random.Random(5)
    counts = Counter(min(64, int(rng.expovariate(1 / 20)) + 1) for _ in range(3000))
    plan = tokens.minimum_bin_slack(counts, 64)
    seen = Counter()
    for times, used in plan:
        assert sum(k * n for k, n in used.items()) <= 64
        for k, n in used.items():
            seen[k] += times * n
    assert seen == counts
    total = sum(k * n for k, n in counts.items())
    assert sum(t for t, _ in plan) <= -(-total // 64) + 1
    assert tokens.minimum_bin_slack({}, 64) == []


def test_pack(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["one", "two", "three"], k=int(rng.expovariate(1 / 30))))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "one " * 500), (902, "one " * 500), (None, "two")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, length int, sequence_id string")
    got = tokens.pack_documents(docs, capacity=64, with_ids=True).collect()
    lib = bpe.encoder(bpe.default_tokenizer()).library
    want = Counter()
    for key, text in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids + [0]
        for p, s in enumerate(range(0, len(ids), 64)):
            part = ids[s : s + 64]
            want[key, p, s, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by: dict = {}
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in got)
    assert len(by) <= -(-total // 64) * 1.01 + 1
    assert tokens.pack_documents(docs.limit(0)).count() == 0
