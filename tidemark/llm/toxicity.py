"""Toxicity by compression distance.

Two zstandard dictionaries: one trained on ordinary text, one of toxic text.  A window of a text is compressed
with the ordinary one and with both together; what the toxic text saves is the window's distance.  The
ordinary content lies at the same place in both, so ordinary windows come out at the same length and the
difference is free of noise.  A window counts if it saves more than a threshold calibrated on ordinary text, and a
logistic curve, fitted on labelled documents that the dictionaries were not trained on, makes a document's score.

What goes into the toxic dictionary is chosen by contrast: words whose beginnings stand in many contexts of toxic documents and
hardly ever elsewhere.  Training it on whole toxic text, as the plain method does, was tried and does not give right results, because
toxic documents are ordinary text but for a few words (figures in the README).
"""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches

#: Bounds of the labelled sample: documents of each label, and characters of one; a longer one gives so many pieces, evenly spaced.
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_CHARS, SAMPLE_PIECES = 2000, 4000, 16_384, 64
#: Windows: bytes, and bytes from one to the next.
WINDOW, STRIDE = 64, 48
#: From this level on zstd searches dictionaries in full.
LEVEL = 6
#: Shares of ordinary windows that stay below a threshold.
SHARES = (0.9, 0.97, 0.99, 0.998)
#: How much more frequent a word's beginning is in toxic text than elsewhere, to mark a toxic word.
LIFT = 30
ORDINARY_BYTES, TOXIC_BYTES = 65_536, 16_384
_CHUNK = 4 << 20


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    thresholds: list[int]  # bytes saved from which on a window counts: rarer and rarer among ordinary ones
    weights: list[float]  # of the features, the constant last; empty: nothing was learnt


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params)


class Scorer:
    """Features and scores of texts under a model."""

    def __init__(self, model: Model):
        self.model = model
        self.plain, self.both = _compressor(model.ordinary), _compressor(model.toxic + model.ordinary)

    def saved(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each window of each text: what the toxic dictionary saves, and the text's number."""
        starts, lengths, owner, at = [], [], [], 0
        for i, text in enumerate(texts):
            if text:
                first = np.arange(0, max(1, len(text) - (WINDOW - STRIDE)), STRIDE)
                starts.append(first + at)
                lengths.append(np.minimum(WINDOW, len(text) - first))
                owner.append(np.full(len(first), i))
                at += len(text)
        if not starts:
            return np.zeros(0, "int64"), np.zeros(0, "int64")
        segments = np.stack([np.concatenate(starts), np.concatenate(lengths)], 1).astype("<u8").tobytes()
        windows = zstandard.BufferWithSegments(b"".join(texts), segments)
        size = [np.fromiter(map(len, c.multi_compress_to_buffer(windows, threads=1)), "int64") for c in (self.plain, self.both)]
        return size[0] - size[1], np.concatenate(owner)

    def features(self, texts: list[bytes]) -> np.ndarray:
        delta, owner = self.saved(texts)
        n = len(texts)
        windows = np.bincount(owner, minlength=n).astype(float)
        columns = []
        for least in self.model.thresholds:
            over = delta >= least
            hits = np.bincount(owner, over, minlength=n)
            columns += [np.log1p(hits), np.sqrt(hits / np.maximum(windows, 1))]
        gain = np.bincount(owner, np.maximum(delta, 0), minlength=n)
        return np.stack([*columns, np.log1p(gain), np.log1p(windows), np.ones(n)], 1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.model.weights:
            return np.zeros(len(texts))
        z = self.features(texts) @ np.array(self.model.weights)
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class _Contexts:
    """Words with the word before, as hashes: a passage that was copied a thousand times counts once.

    Counts the beginnings of words over distinct contexts, and keeps about one context in ``one_in`` as a sample.
    """

    def __init__(self, without: _Contexts | None = None, one_in: int = 0):
        self.seen: set[int] = set()
        self.without = without.seen if without else ()
        self.starts: Counter = Counter()
        self.samples: list[tuple[int, bytes]] = []
        self.one_in = one_in

    def new(self, text: bytes):
        before = b""
        for word in text.split():
            both = before + b" " + word
            before = word
            h = xxhash.xxh64_intdigest(both)
            if h not in self.seen and h not in self.without:
                self.seen.add(h)
                yield h, both, word

    def add(self, text: bytes) -> None:
        starts = self.starts
        for h, both, word in self.new(text):
            for k in range(4, min(len(word), 12) + 1):
                starts[word[:k]] += 1
            if self.one_in and h % self.one_in == 0:
                self.samples.append((h, both + b" "))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained on samples; too few to train on are the content themselves."""
    if len(samples) >= 1000:
        try:
            return zstandard.train_dictionary(size, samples, k=16, d=6).as_bytes()[-size:]
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:size]


def fit(sample: list[tuple[str | None, int]], seed: int = 0) -> Model:
    """Train on (text in lower case, label) pairs; ``seed`` fixes the order of samples.

    Without documents of both labels nothing can be learnt, and every score is 0.
    """
    rows = sorted({(text.encode(), label) for text, label in sample if text and label in (0, 1)})
    rng = random.Random(seed)
    rng.shuffle(rows)
    by_label = [[t for t, x in rows if x == label] for label in (0, 1)]
    if not all(by_label):
        return Model(b" ", b" ", [1], [])
    learn = [part[: max(1, len(part) * 3 // 5)] for part in by_label]
    ordinary = _Contexts(one_in=max(1, sum(map(len, learn[0])) // 400_000))
    for text in learn[0]:
        ordinary.add(text)
    toxic = _Contexts(without=ordinary)
    for text in learn[1]:
        toxic.add(text)
    # toxic text: words whose beginnings stand in many different places of toxic documents and hardly ever elsewhere
    least = LIFT * max(1, len(toxic.seen)) / max(1, len(ordinary.seen))
    marks = {w for w, n in toxic.starts.items() if n >= 4 and n > least * (ordinary.starts[w] + 1)}
    again = _Contexts(without=ordinary)
    found = [(both, word) for text in learn[1] for _, both, word in again.new(text) if not marks or any(word[:k] in marks for k in range(4, 13))]
    toxic_samples = sorted(b" " + word + b" " if marks else both + b" " for both, word in found)
    ordinary_samples = [x for _, x in sorted(ordinary.samples)]
    del ordinary, toxic, again, found
    rng.shuffle(toxic_samples)
    rng.shuffle(ordinary_samples)
    distinct = list(dict.fromkeys(toxic_samples))
    held = b"".join(distinct)
    if len(held) > TOXIC_BYTES:  # as far as it goes whole; else what the trainer finds worth keeping
        held = _dictionary(toxic_samples, TOXIC_BYTES)
    model = Model(_dictionary(ordinary_samples[:60_000], ORDINARY_BYTES), held, [1], [])
    # thresholds: on documents that the dictionaries have not seen, where there are any
    rest = [part[len(seen) :] or part for part, seen in zip(by_label, learn, strict=True)]
    scorer = Scorer(model)
    clean = scorer.saved(rest[0])[0]
    top = [int(np.quantile(clean, q)) + 1 if len(clean) else 1 for q in SHARES]
    model.thresholds = sorted({max(1, t) for t in top})
    x = scorer.features(rest[0] + rest[1])
    y = np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])])
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        ridge = np.full(len(w), 0.05)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    model.weights = [float(v) for v in w]
    return model


def held_out(id_column):
    """Rows that nothing is learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic") -> list[tuple[str, int]]:
    """At most SAMPLE_TOXIC and SAMPLE_ORDINARY labelled documents in lower case, none of them held out, in a fixed order.

    They are chosen by a hash of the id from the labels whose document is there, so that texts of these documents alone are read.
    Of a text over SAMPLE_CHARS characters SAMPLE_PIECES pieces are taken, evenly spaced.  Of rows that share an id one text is
    taken, of labels that do, the larger.
    """
    own = labels.select(labels[id_col].cast("bigint").alias("k"), labels[label_col].cast("int").alias("y")).where("k is not null and y in (0, 1)")
    own = own.where(~held_out(F.col("k"))).groupBy("k").agg(F.max("y").alias("y"))
    there = docs.select(docs[id_col].cast("bigint").alias("f")).where("f is not null")
    own = own.join(there, F.col("k") == F.col("f"), "left_semi")
    bound = {1: SAMPLE_TOXIC, 0: SAMPLE_ORDINARY}
    by_label = lambda given: F.when(F.col("y") == 1, given.get(1)).otherwise(given.get(0))
    total = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}  # a row per label
    place = F.xxhash64("k")
    rank = F.row_number().over(W.partitionBy("y").orderBy(place, "k"))
    picked, margin = [], 2
    while any(sum(r["y"] == y for r in picked) < min(n, bound[y]) for y, n in total.items()):
        # only hashes small enough for about margin * bound rows are ranked, so that what a task gets does not grow with the labels
        upto = {y: min((1 << 63) - 1, (margin * bound[y] << 64) // n - (1 << 63)) for y, n in total.items()}
        ranked = own.where(place <= by_label(upto)).withColumn("r", rank)
        picked = ranked.where(F.col("r") <= by_label(bound)).select("k", "y").collect()  # bounded by the two limits
        margin *= 2
    if not picked:
        return []
    few = F.broadcast(docs.sparkSession.createDataFrame(picked, "k bigint, y int"))
    texts = docs.select(docs[id_col].cast("bigint").alias("k"), docs[text_col].cast("string").alias("text")).where("text <> ''").join(few, "k")
    size, piece = F.length("text"), SAMPLE_CHARS // SAMPLE_PIECES
    spaced = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_PIECES - 1)), lambda i: F.substring("text", F.floor(i * (size - piece) / (SAMPLE_PIECES - 1)).cast("int") + 1, piece)), " ")
    texts = texts.select("k", "y", F.lower(F.when(size <= SAMPLE_CHARS, F.col("text")).otherwise(spaced)).alias("text"))
    rows = texts.groupBy("k").agg(F.first("y").alias("y"), F.min("text").alias("text"))
    return [(r["text"], r["y"]) for r in rows.orderBy(F.xxhash64("k"), "k").collect()]


def score_documents(docs: DataFrame, model: Model, id_col="doc_id", text_col="text", keep: list[str] = ()) -> DataFrame:
    """(doc_id, score, predicted, then the columns in ``keep``) of each row.

    Whole texts are scored; a null text counts as empty, which has no windows and gets the score of none.
    Null ids and repeated rows are kept.  Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    columns = [docs[id_col].cast("bigint").alias("doc_id"), F.lower(docs[text_col].cast("string")).alias("text")]
    kept = [docs[c].alias(f"keep_{i}") for i, c in enumerate(keep)]
    chosen = docs.select(*columns, *kept)

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            scores, part, size = [], [], 0
            for text in texts:
                part.append(text)
                size += len(text)
                if size >= _CHUNK:
                    scores.append(scorer.scores(part))
                    part, size = [], 0
            scores.append(scorer.scores(part))
            score = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype("int32")), *batch.columns[2:]],
                names=["doc_id", "score", "predicted", *batch.schema.names[2:]],
            )

    kinds = ", ".join(f"keep_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = chosen.mapInArrow(run, "doc_id bigint, score double, predicted int" + (f", {kinds}" if kinds else ""))
    return out.select("doc_id", "score", "predicted", *(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)))
