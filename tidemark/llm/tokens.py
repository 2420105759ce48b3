"""Operators over encoded documents: encoding and decoding, exact length histogram, best-fit packing."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.common import Scratch, bounded_batches

#: Rows of a result batch sent back to the JVM.
_ROWS = 500

#: What ``encode_documents`` can return, with Spark and Arrow types.
OUTPUTS = {
    "ids": ("array<int>", pa.list_(pa.int32())),
    "n_tokens": ("bigint", pa.int64()),
    "decoded": ("string", pa.string()),
    "ids_sha256": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
}


def _texts(column):
    """The texts of a column, a few at a time as Python strings."""
    for i in range(0, len(column), 200):
        yield from column.slice(i, 200).to_pylist()


def _id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns under fixed names, whatever else the table holds."""
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def encode_documents(docs: DataFrame, tokenizer: str | None = None, columns=("ids", "n_tokens", "decoded"), id_col="doc_id", text_col="text") -> DataFrame:
    """Encode each whole text, and decode the ids again.

    One row per input row: doc_id and the wanted ``columns`` of ``OUTPUTS``.  A null text counts as
    empty: no ids, an empty decoded text.  Repeated rows and null ids are kept.  Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    path = tokenizer or bpe.default_tokenizer()
    wanted = list(columns)
    schema = pa.schema([("doc_id", pa.int64()), *((c, OUTPUTS[c][1]) for c in wanted)])
    spark_schema = ", ".join(["doc_id bigint", *(f"{c} {OUTPUTS[c][0]}" for c in wanted)])

    def run(batches):
        coder = bpe.encoder(path)
        need_text = {"decoded", "decoded_sha256"} & set(wanted)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            rows: list[dict] = []
            for key, ids in zip(keys, coder.encode_many(_texts(batch.column(1))), strict=True):
                row: dict = {"doc_id": key}
                as_list = ids.tolist()
                text = coder.decode(as_list) if need_text else None
                for c in wanted:
                    if c == "ids":
                        row[c] = ids.astype("<i4")
                    elif c == "n_tokens":
                        row[c] = len(as_list)
                    elif c == "decoded":
                        row[c] = text
                    elif c == "ids_sha256":
                        row[c] = hashlib.sha256(coder.written(as_list).encode("ascii")).hexdigest()
                    else:
                        row[c] = hashlib.sha256(text.encode("utf-8")).hexdigest()
                rows.append(row)
                if len(rows) >= _ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return _id_and_text(docs, id_col, text_col).mapInArrow(run, spark_schema)


# -- exact length histogram --


def token_lengths(docs: DataFrame, tokenizer: str | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_tokens) of each document."""
    return encode_documents(docs, tokenizer, ("n_tokens",), id_col, text_col)


def length_histogram(lengths: DataFrame, bucket: int = 1024) -> DataFrame:
    """Exact histogram of encoded lengths with suffix sums.

    ``lengths`` has n_tokens; rows with null there are left out, an empty table gives no rows.  One row per
    length that occurs, as ``context_limit``:

    * n_docs, n_tokens: documents of just this length, and their tokens;
    * docs_at_least, tokens_at_least: suffix sums, documents of at least this length and their tokens;
    * docs_truncated: documents longer than the limit;
    * kept_tokens: sum of min(length, limit) over all documents; cut_tokens: the rest;
    * rank_from, rank_to: 1-based ranks of these documents by length, so the quantile q is the length whose
      ranks hold ceil(q * total);
    * total_docs, total_tokens.

    Between two lengths that occur, kept_tokens is linear in the limit (``answer_limits``).  Running sums are
    taken inside buckets of ``bucket`` lengths and across bucket totals, so no task gets all lengths.
    """
    hist = lengths.where("n_tokens is not null").groupBy(F.col("n_tokens").cast("bigint").alias("context_limit")).agg(F.count("*").alias("n_docs"))
    hist = hist.withColumn("n_tokens", F.col("context_limit") * F.col("n_docs")).withColumn("slot", F.floor(F.col("context_limit") / bucket))
    # written once: both the totals and the running sums read it
    hist = Scratch(lengths.sparkSession, "histogram").write(hist, "lengths")
    totals = hist.groupBy("slot").agg(F.sum("n_docs").alias("slot_docs"), F.sum("n_tokens").alias("slot_tokens"))
    # a row per slot: longest text / bucket of them
    later = W.partitionBy(F.lit(0)).orderBy(F.desc("slot")).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(0))
    totals = totals.select(
        "slot",
        F.coalesce(F.sum("slot_docs").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("slot_tokens").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("slot_docs").over(everything).alias("total_docs"),
        F.sum("slot_tokens").over(everything).alias("total_tokens"),
    )
    inside = W.partitionBy("slot").orderBy(F.desc("context_limit")).rowsBetween(W.unboundedPreceding, 0)
    summed = hist.select(
        "*", F.sum("n_docs").over(inside).alias("in_docs"), F.sum("n_tokens").over(inside).alias("in_tokens")
    ).join(totals, "slot")
    at_least, tokens_at_least = F.col("in_docs") + F.col("later_docs"), F.col("in_tokens") + F.col("later_tokens")
    over = at_least - F.col("n_docs")
    kept = F.col("total_tokens") - tokens_at_least + at_least * F.col("context_limit")
    return summed.select(
        "context_limit",
        "n_docs",
        "n_tokens",
        at_least.alias("docs_at_least"),
        tokens_at_least.alias("tokens_at_least"),
        over.alias("docs_truncated"),
        kept.alias("kept_tokens"),
        (F.col("total_tokens") - kept).alias("cut_tokens"),
        (F.col("total_docs") - at_least + 1).alias("rank_from"),
        (F.col("total_docs") - over).alias("rank_to"),
        "total_docs",
        "total_tokens",
    )


def answer_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_truncated, kept_tokens, cut_tokens) for any limits, from the suffix sums alone.

    ``limits`` is a list given by the caller.  The first length above a limit holds all that is needed.
    """
    spark = histogram.sparkSession
    asked = F.broadcast(spark.createDataFrame([(int(x),) for x in sorted(set(limits))], "asked bigint"))
    above = histogram.join(asked, F.col("context_limit") > F.col("asked")).groupBy("asked").agg(F.min_by(F.struct("docs_at_least", "tokens_at_least"), "context_limit").alias("next"))
    total = F.broadcast(histogram.agg(F.coalesce(F.max("total_tokens"), F.lit(0)).alias("total_tokens")))
    out = asked.join(above, "asked", "left").crossJoin(total)  # one row of totals
    docs = F.coalesce("next.docs_at_least", F.lit(0))
    cut = F.coalesce("next.tokens_at_least", F.lit(0)) - docs * F.col("asked")
    return out.select(F.col("asked").alias("context_limit"), docs.alias("docs_truncated"), (F.col("total_tokens") - cut).alias("kept_tokens"), cut.alias("cut_tokens"))


# -- best-fit packing --


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The lengths, with multiplicity, whose sum comes nearest to ``room`` without passing it.

    Bitset subset-sum: bit s of ``reach`` tells that s can be made of the lengths so far.  Lengths go
    from long to short, so that among equally full combinations long ones are used up first; the bitsets of
    before each step lead back to the combination.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        n = min(counts[length], room // length)
        part = 1
        while n > 0:  # binary splitting of the multiplicity
            take = min(part, n)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            n -= take
            part *= 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, defaultdict(int)
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            used[length] += take
    return dict(used)


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Plan of bins: (how often, {length: how many in such a bin}).

    Each bin takes the longest length left and the fullest combination for the room beside it.  The same
    choice stays the best one until one of its lengths runs out, so it is taken as often as the counts
    allow at once: the plan has about as many entries as there are lengths, however many documents there are.
    """
    left, plan = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        used = fullest({k: v for k, v in rest.items() if v}, capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        plan.append((times, used))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return plan


_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, shard int, place bigint"


def cut_pieces(docs: DataFrame, capacity: int, tokenizer: str | None, end_id: int, with_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """A row per piece; ``place`` numbers the pieces of a length within the task ``shard`` that made them."""
    path = tokenizer or bpe.default_tokenizer()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int32()), ("place", pa.int64())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
    schema = pa.schema(fields)
    end = np.array([end_id], "<u4")

    def run(batches):
        # the library itself for distinct words: half the memory of the trie's tables, and less time
        coder, shard, seen = bpe.encoder(path, trie=False), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            keys, rows = batch.column(0).to_pylist(), []
            for key, ids in zip(keys, coder.encode_many(_texts(batch.column(1))), strict=True):
                ids = np.concatenate([ids, end])
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    n = len(part)
                    row = (key, k, start, n, zlib.crc32(part.tobytes()), shard, seen[n])
                    rows.append((*row, part.astype("<i4")) if with_ids else row)
                    seen[n] += 1
            for i in range(0, len(rows), 5000):
                columns = zip(*rows[i : i + 5000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, fields, strict=True)], schema=schema)

    return _id_and_text(docs, id_col, text_col).mapInArrow(run, _PIECES + (", ids array<int>" if with_ids else ""))


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = False, id_col="doc_id", text_col="text") -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` tokens, by minimum bin slack.

    A document is its ids, then ``end_id``; a null or empty text is that id alone.  Only documents longer than
    the capacity are cut, into pieces of the capacity and one shorter last piece.  One row per piece: doc_id,
    piece, start, length, ids_crc32, sequence_id, offset, and ids if wanted.  Repeated rows are packed
    each by itself; an empty table gives no rows.

    Only the histogram of lengths, at most ``capacity`` rows, reaches the driver.  A plan says how many
    sequences hold which lengths; the n-th piece of a length knows its sequence and offset from the plan.
    Pieces are numbered within the task that made them, and a task's first number follows from counts by task.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.write(cut_pieces(docs, capacity, tokenizer, end_id, with_ids, id_col, text_col), "pieces")
    counts = scratch.write(pieces.groupBy("shard", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = W.partitionBy("length").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select(F.col("shard").alias("s"), F.col("length").alias("l"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # for each length, in order of rank: (first rank, first sequence, how many in a sequence, offset of the first)
    spans, sequence, given = [], 0, defaultdict(int)
    for times, used in minimum_bin_slack(histogram, capacity):
        offset = 0
        for length in sorted(used, reverse=True):
            spans.append((length, given[length], sequence, used[length], offset))
            given[length] += times * used[length]
            offset += length * used[length]
        sequence += times
    spans.sort()
    table = np.array(spans, "int64").reshape(-1, 5)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
    schema = pa.schema(fields)

    def place(batches):
        key = table[:, 0] << 44 | table[:, 1]
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("place").to_numpy(zero_copy_only=False) + b.column("first").to_numpy(zero_copy_only=False)
            at = table[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            nth = rank - at[:, 1]
            own = {"sequence_id": at[:, 2] + nth // at[:, 3], "offset": at[:, 4] + nth % at[:, 3] * length}
            yield pa.RecordBatch.from_arrays([pa.array(own[n], t) if n in own else b.column(n) for n, t in fields], schema=schema)

    joined = pieces.join(first, (F.col("shard") == F.col("s")) & (F.col("length") == F.col("l"))).drop("s", "l", "shard")
    return joined.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint" + (", ids array<int>" if with_ids else ""))
