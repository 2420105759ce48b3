"""Line deduplication by pairwise alignment of overlapping documents.

*Lines* end at a line end and after a sentence; a longer one is also cut after words that a hash of the word picks (about one in
ONE_IN) and after MOST_WORDS words, so that a passage inside a paragraph, or inside one endless line, is found wherever it
stands.  Words are runs of anything but ASCII white space; in scripts that write without spaces each character is one.
A *block* is a run of lines with LEAST_BLOCK_WORDS words or more, which makes it rare however common its lines are.

The result is defined without regard to how it is found: a line of a document goes if it stands in a block of consecutive lines
that some document with a smaller id holds too, line for line.

1. Each line begins and ends a shortest block; every line of a longer common block is in a shortest block that is common.
   A portion of rows keeps the first holder of each such block and pairs its other holders with that one, and only first
   holders are shuffled and paired with the first of all.  So a block in a million documents costs a row per portion and a
   million pairs, never its square, and each document meets an earlier holder of each of its blocks.
2. A pair is aligned with patience diff: lines that are unique in both are matched along their longest common order, matches grow
   over equal neighbours, and the gaps between are aligned in the same way.  Common blocks that cross this order (moved or
   repeated ones) are anchors of their own, which grow over equal neighbours.
3. Aligned blocks are deleted from the later document.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch
from tidemark.llm.setjoin import _bounds, _runs
from tidemark.llm.shingles import CHUNK_BYTES, SPACE, hash_words, mix

LEAST_BLOCK_WORDS = 20
#: Lines are cut after one word in ONE_IN, and have MOST_WORDS words at most.
ONE_IN, MOST_WORDS = 12, 32
#: Block hashes that a portion holds before it passes them on.
PORTION = 1_000_000


def _longest_order(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence with rising second members (patience sorting with links back)."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        if pile == len(tops):
            tops.append(y)
            at.append(i)
        else:
            tops[pile], at[pile] = y, i
        back.append(at[pile - 1] if pile else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(x: list[int], y: list[int]) -> list[tuple[int, int]]:
    """Positions (in x, in y) that are aligned, in order."""
    aligned: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        x0, x1, y0, y1 = todo.pop()
        # equal lines at either end of a gap belong to the alignment beside it
        while x0 < x1 and y0 < y1 and x[x0] == y[y0]:
            aligned.append((x0, y0))
            x0, y0 = x0 + 1, y0 + 1
        while x0 < x1 and y0 < y1 and x[x1 - 1] == y[y1 - 1]:
            x1, y1 = x1 - 1, y1 - 1
            aligned.append((x1, y1))
        once_x: dict[int, int] = {}
        for i in range(x0, x1):
            once_x[x[i]] = -1 if x[i] in once_x else i
        once_y: dict[int, int] = {}
        for j in range(y0, y1):
            if y[j] in once_x:
                once_y[y[j]] = -1 if y[j] in once_y else j
        anchors = _longest_order(sorted((once_x[h], j) for h, j in once_y.items() if j >= 0 and once_x[h] >= 0))
        if not anchors:
            continue
        aligned.extend(anchors)
        edges = [(x0 - 1, y0 - 1), *anchors, (x1, y1)]
        for (i, j), (k, m) in zip(edges, edges[1:]):
            if k - i > 1 and m - j > 1:
                todo.append((i + 1, k, j + 1, m))
    return sorted(aligned)


# -- lines and blocks --


def _lone(data: np.ndarray) -> np.ndarray:
    """Where a character (of three bytes) starts that is a word of its own: Thai, Lao, Tibetan, Burmese, Khmer, kana, ideographs."""
    after = np.append(data[1:], np.uint8(0)) if len(data) else data
    out = (data >= 0xE3) & (data <= 0xE9) | (data == 0xE0) & (after >= 0xB8)
    for second in (0x80, 0x81, 0x82, 0x9E, 0x9F):
        out |= (data == 0xE1) & (after == second)
    return out


def cut(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text its lines: hashes, numbers of words, and bytes up to the next line (all bytes of a text with a word)."""
    ends = np.cumsum([len(t) for t in texts], dtype="int64")
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    edge = np.zeros(n + 2, bool)
    edge[1:-1] = ~SPACE[data]
    solid, bound = edge[1:-1], np.zeros(n + 1, bool)
    bound[ends] = True
    lone = _lone(data)
    begins = solid & (~edge[:-2] | bound[:-1]) | lone
    after = np.zeros(n, bool)  # right after a character that is a word
    after[3:] = lone[:-3]
    starts = np.flatnonzero(begins | (after & solid))
    if not len(starts):
        return [(np.zeros(0, "<u8"), np.zeros(0, "u1"), np.zeros(0, "<u4"))] * len(texts)
    run_ends = np.flatnonzero(solid & (~edge[2:] | bound[1:])) + 1
    stops = np.minimum(np.append(starts[1:], n), run_ends[np.searchsorted(run_ends, starts, side="right")])
    words = hash_words(data, starts, stops)
    upto = np.searchsorted(starts, ends)
    # a line ends with the word before a line end, at the end of a sentence, of the text, and where the hash says so
    newlines = np.append(0, np.cumsum(data == 0x0A))
    following = np.append(starts[1:], n)
    last = data[stops - 1]
    over = (newlines[following] > newlines[stops]) | ((last == 0x2E) | (last == 0x3F) | (last == 0x21)) & (following > stops) | (mix(words, 9) % np.uint64(ONE_IN) == 0)
    over[upto[upto > 0] - 1] = True
    first = np.append(0, np.flatnonzero(over)[:-1] + 1)
    place = np.arange(len(words)) - np.repeat(first, np.diff(np.append(first, len(words))))
    over |= place % MOST_WORDS == MOST_WORDS - 1
    first = np.append(0, np.flatnonzero(over)[:-1] + 1)
    count = np.diff(np.append(first, len(words)))
    place = (np.arange(len(words)) - np.repeat(first, count)).astype("<u8")
    with np.errstate(over="ignore"):
        lines = mix(np.add.reduceat(mix(words + place * np.uint64(0x9E3779B97F4A7C15), 13), first) + count.astype("<u8"), 14)
    # the white space before a text's first word is part of its first line
    begin, line_upto = starts[first], np.searchsorted(first, upto)
    text_start, at, out = np.append(0, ends[:-1]), 0, []
    for i, end in enumerate(line_upto.tolist()):
        own = begin[at:end].copy()
        own[:1] = text_start[i]
        out.append((lines[at:end], count[at:end].astype("u1"), np.diff(np.append(own, ends[i])).astype("<u4") if end > at else np.zeros(0, "<u4")))
        at = end
    return out


_STEP = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def shortest_blocks(lines: list[np.ndarray], words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, number of the text, first line, last line) of the shortest blocks that begin, or end, with each line."""
    size = np.array([len(x) for x in lines], "int64")
    m = int(size.sum())
    if not m:
        return (np.zeros(0, "<u8"), *(np.zeros(0, "int64") for _ in range(3)))
    h, owner = np.concatenate(lines), np.repeat(np.arange(len(lines)), size)
    upto = np.append(0, np.cumsum(np.concatenate(words), dtype="int64"))
    end = np.cumsum(size)[owner]  # of the text that a line is in
    begin = end - size[owner]
    at = np.arange(m)
    to = np.searchsorted(upto, upto[:-1] + LEAST_BLOCK_WORDS) - 1
    ok = to < end
    since = np.searchsorted(upto, upto[1:] - LEAST_BLOCK_WORDS, side="right") - 1
    good = (since >= begin) & (upto[1:] >= LEAST_BLOCK_WORDS)
    first, last = np.concatenate([at[ok], since[good]]), np.concatenate([to[ok], at[good]])
    both = np.unique(first * (m + 1) + last)
    first, last = both // (m + 1), both % (m + 1)
    with np.errstate(over="ignore"):
        up, down = np.full(m + 1, _STEP), np.full(m + 1, _BACK)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        sums = np.append(np.uint64(0), np.cumsum(h * up[:m], dtype="<u8"))
        value = mix((sums[last + 1] - sums[first]) * down[first] + (last - first).astype("<u8"), 15)
    return value, owner[first], first - begin[first], last - begin[first]


def common_lines(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> list[tuple[int, int]]:
    """Ranges (first, last) of lines of x that stand in blocks that y holds too."""
    if len(x) == len(y) and (x == y).all():
        return [(0, len(x) - 1)] if wx.sum(dtype="int64") >= LEAST_BLOCK_WORDS else []
    own, other, gone, out = x.tolist(), y.tolist(), np.zeros(len(x), bool), []
    total = np.append(0, np.cumsum(wx, dtype="int64"))

    def take(first, last):
        if total[last + 1] - total[first] >= LEAST_BLOCK_WORDS:
            gone[first : last + 1] = True
            out.append((first, last))

    first = before = None
    for i, j in [*patience(own, other), (-9, -9)]:
        if before is None or (i, j) != (before[0] + 1, before[1] + 1):
            if before is not None:
                take(first, before[0])
            first = i
        before = (i, j)
    # what crosses the alignment
    hx, _, fx, lx = shortest_blocks([x], [wx])
    hy, _, fy, _ = shortest_blocks([y], [wy])
    order = np.argsort(hy, kind="stable")
    hy, fy = hy[order], fy[order]
    place = np.searchsorted(hy, hx)
    place[place == len(hy)] = 0
    for k in np.flatnonzero(hy[place] == hx).tolist() if len(hy) else ():
        i, e = int(fx[k]), int(lx[k])
        if gone[i : e + 1].all():
            continue
        j = int(fy[place[k]])
        f = j + e - i
        while i and j and own[i - 1] == other[j - 1]:
            i, j = i - 1, j - 1
        while e + 1 < len(own) and f + 1 < len(other) and own[e + 1] == other[f + 1]:
            e, f = e + 1, f + 1
        take(i, e)
    return out


# -- steps --


def _batch(rows, **kinds):
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def sequences(rows: DataFrame) -> DataFrame:
    """(id, fp, seq, words, size) of rows (id, fp, text): the lines of a text, packed."""

    def run(batches):
        for b in batches:
            ids, fps = b.column("id").to_pylist(), b.column("fp").to_pylist()
            held, at, size = [], 0, 0
            for i, text in enumerate([*b.column("text").cast(pa.large_binary()).to_pylist(), None]):
                if text is not None:
                    held.append(text)
                    size += len(text)
                if held and (text is None or size >= CHUNK_BYTES):
                    yield _batch([(ids[at + k], fps[at + k], *(v.tobytes() for v in own)) for k, own in enumerate(cut(held))], id=pa.int64(), fp=pa.int64(), seq=pa.binary(), words=pa.binary(), size=pa.binary())
                    held, at, size = [], i + 1, 0

    return rows.mapInArrow(run, "id bigint, fp bigint, seq binary, words binary, size binary")


def overlapping(seqs: DataFrame) -> DataFrame:
    """(id, first): each row that shares a shortest block with rows of smaller ids, paired with one of them for each such block."""

    def portions(batches):
        """kind 0: (block, its first holder here); kind 1: (any, a later holder here, the first)."""
        held, size = [], 0

        def flush():
            h, i = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((i, h))
            h, i = h[order], i[order]
            new = np.append(True, h[1:] != h[:-1])
            first = i[new][np.cumsum(new) - 1]
            later = np.flatnonzero(i != first)
            pairs = np.unique(np.stack([i[later], first[later]], 1), axis=0) if len(later) else np.zeros((0, 2), "int64")
            h, i = h[new].view("<i8"), i[new]
            for a in range(0, len(h), 50_000):
                own = h[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(i[a : a + 50_000]), pa.array(i[a : a + 50_000])], names=["h", "a", "b"])
            for a in range(0, len(pairs), 50_000):
                own = pairs[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(mix(own[:, 0].astype("<u8")).view("<i8")), pa.array(own[:, 0]), pa.array(own[:, 1])], names=["h", "a", "b"])

        for b in batches:
            ids = b.column("id").to_numpy()
            seq, words = ([np.frombuffer(v, kind) for v in b.column(c).to_pylist()] for c, kind in (("seq", "<u8"), ("words", "u1")))
            h, owner, _, _ = shortest_blocks(seq, words)
            held.append((h, ids[owner]))
            size += len(h)
            if size >= PORTION:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def firsts(batches):
        for now in _runs(batches, ["h", "a", "b"], ["h"]):
            own = now["a"] == now["b"]
            out = [np.stack([now["a"][~own], now["b"][~own]], 1)]
            h, a = now["h"][own], now["a"][own]
            if len(h):
                bounds = _bounds({"h": h}, ["h"])
                first = np.repeat(a[bounds[:-1]], np.diff(bounds))  # rows come sorted by (h, a)
                out.append(np.stack([a, first], 1)[a != first])
            pairs = np.concatenate(out)
            if len(pairs):
                pairs = np.unique(pairs, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["id", "first"])

    blocks = seqs.select("id", "seq", "words").mapInArrow(portions, "h bigint, a bigint, b bigint")
    # a hot block has a row per portion by now
    return blocks.repartition("h").sortWithinPartitions("h", "a").mapInArrow(firsts, "id bigint, first bigint").distinct()


def removed_bytes(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, gone): for rows that lose lines, the ranges (first, last) of bytes, which may overlap; fp is a hash of the text."""
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), F.xxhash64(text).alias("fp"), text.alias("text")).where("id is not null and text <> ''")
    seqs = scratch.write(sequences(rows), "sequences")
    pairs = scratch.write(overlapping(seqs), "pairs")
    wanted = pairs.select("id").union(pairs.select("first")).distinct().withColumnRenamed("id", "wanted")
    held = scratch.write(seqs.join(wanted, F.col("id") == F.col("wanted"), "left_semi").dropDuplicates(["id", "fp"]), "overlapping")
    later = pairs.join(held.select(F.col("id").alias("lid"), "fp", "seq", "words", "size"), F.col("id") == F.col("lid")).drop("lid")
    both = later.join(held.select(F.col("id").alias("eid"), F.col("seq").alias("seq2"), F.col("words").alias("words2")), F.col("first") == F.col("eid")).select("id", "fp", "seq", "words", "size", "seq2", "words2")

    def align(batches):
        for b in batches:
            out = []
            for i, fp, *parts in zip(*(b.column(c).to_pylist() for c in b.schema.names), strict=True):
                x, wx, size, y, wy = (np.frombuffer(v, kind) for v, kind in zip(parts, ("<u8", "u1", "<u4", "<u8", "u1"), strict=True))
                found = common_lines(x, wx, y, wy)
                if found:
                    at = np.append(0, np.cumsum(size, dtype="int64"))
                    out.append((i, fp, [{"first": int(at[p]), "last": int(at[q + 1])} for p, q in sorted(found)]))
            if out:
                yield _batch(out, id=pa.int64(), fp=pa.int64(), gone=pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))

    aligned = scratch.write(both.mapInArrow(align, "id bigint, fp bigint, gone array<struct<first:bigint,last:bigint>>"), "aligned")
    return scratch.write(aligned.groupBy("id", "fp").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")), "gone")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` with repeated blocks of lines deleted from the later documents; ids order documents.

    All rows and columns are kept; ``removed_col`` adds the number of deleted bytes of UTF-8 (in place of a column of that name).  Rows without
    an id, null or empty texts and texts without a word stay as they are.  Rows with one id and one text are treated alike;
    rows that share an id but not the text are never aligned with each other.  A document may end up empty; what stands before a
    deleted end keeps no white space at its end.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    gone = removed_bytes(docs, scratch, id_col, text_col)
    scratch.discard("sequences", "pairs", "overlapping", "aligned")
    # a sort-merge join at every size, of which Spark can split a skewed part
    gone = gone.select(F.col("id").alias("_ld_id"), F.col("fp").alias("_ld_fp"), F.array_sort("gone").alias("_ld_gone")).hint("merge")
    keyed = docs.withColumns({"_ld_key": docs[id_col].cast("bigint"), "_ld_hash": F.xxhash64(docs[text_col].cast("string"))})
    joined = keyed.join(gone, (F.col("_ld_key") == F.col("_ld_id")) & (F.col("_ld_hash") == F.col("_ld_fp")), "left")
    raw = F.col(f"`{text_col}`").cast("string").cast("binary")
    part = lambda since, to: F.substring(raw, (since + 1).cast("int"), F.greatest(to - since, F.lit(0)).cast("int")).cast("string")
    walk = F.aggregate(
        "_ld_gone",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("n"), F.array().cast("array<string>").alias("kept")),
        lambda s, r: F.struct(
            F.greatest(s["at"], r["last"]).alias("at"),
            (s["n"] + F.greatest(r["last"] - F.greatest(s["at"], r["first"]), F.lit(0))).alias("n"),
            F.concat(s["kept"], F.array(part(s["at"], r["first"]))).alias("kept"),
        ),
    )
    walked = joined.withColumn("_ld_walk", F.when(F.col("_ld_gone").isNotNull(), walk))
    at, whole = F.col("_ld_walk.at"), F.octet_length(raw).cast("bigint")
    kept = F.concat(F.array_join("_ld_walk.kept", ""), part(at, whole))
    text = F.when(F.col("_ld_walk").isNull(), F.col(f"`{text_col}`")).when(at >= whole, F.regexp_replace(kept, r"\s+$", "")).otherwise(kept)
    extra = [F.coalesce("_ld_walk.n", F.lit(0).cast("bigint")).alias(removed_col)] if removed_col else []
    return walked.select(*(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != removed_col), *extra)
