"""N-gram Jaccard join with set-relation skipping.

Two documents link when den * |X & Y| >= num * |X | Y| for their sets of word shingles.  The join is exact.

1. Equal sets are one class; only its smallest id goes on.
2. *Answers from a similar set*: before any pairs are made, sets that share two tokens with many others (of the SKETCH smallest
   hashes of their set) choose a pivot, and are compared with it alone.  Those that link with it are its crowd.  All answers
   within a crowd follow from the differences to the pivot, |X & Z| = |P| - |P-X| - |P-Z| + |(P-X) & (P-Z)| + |(X-P) & (Z-P)|,
   counted block by block; no list makes such a pair.  Who does not link with its pivot chooses again, CHOICES times in all.
3. Tokens have one order: by hash, those in many documents last (the order is free, so a Bloom filter of
   bounded size may say which).  Two sets that link share a token of their prefixes in this order.
4. *Index lists by position*: a list holds, for a token, the sets that have it in their prefix, in blocks of one set size
   and sorted by position in a block.  A set skips the blocks whose size cannot link, and, of a block, all entries beyond
   the position from which on too few tokens are left, and all entries of its own crowd.
5. Pairs of different crowds are thinned out by parity bitmaps (a lower bound of the symmetric difference, so nothing is lost),
   inside the list where it would make many pairs, and compared in full.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, connected_components
from tidemark.llm.shingles import mix, shingle_sets

#: A token in so many documents goes to the end of the order.
HOT = 30
#: Bits of a Bloom filter that is sent to all tasks: 16 for each value, between these bounds (32 MB); a fuller one passes more.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: A list of more entries is worked on in blocks; so are crowds of more members.
LIST_ENTRIES, GROUP_BLOCK = 4096, 1024
#: More pairs than this for each entry make a list dense.
DENSE = 8
#: Tokens of a set that look for a crowd, sets that make one, and how often a set chooses a pivot.
SKETCH, CROWD, CHOICES = 3, 8, 3


class Rule:
    """Integer arithmetic of the threshold num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, nx, ny):
        """The least overlap with which sets of these sizes link."""
        return -((-self.num * (nx + ny)) // (self.den + self.num))

    def smallest(self, n):
        """The smallest size that links with size n."""
        return -((-self.num * n) // self.den)

    def prefix(self, n):
        return n - self.smallest(n) + 1


# -- Bloom filters of bounded size --


def _bits(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return mix(values, 21) % np.uint64(bits), mix(values, 22) % np.uint64(bits)


def bloom(values: DataFrame) -> np.ndarray:
    """Bits of the distinct values of one long column, read from files; at most MOST_BITS / 64 rows come to the driver."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << int(16 * values.count()).bit_length()))

    def words(batches):
        held = np.zeros(size, bool)
        for b in batches:
            for at in _bits(b.column(0).to_numpy(zero_copy_only=False).view("<u8"), size):
                held[at] = True
        packed = np.packbits(held, bitorder="little").view("<i8")
        used = np.flatnonzero(packed)
        for i in range(0, len(used), 10_000):
            part = used[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(packed[part])], names=["place", "bits"])

    rows = values.mapInArrow(words, "place bigint, bits bigint").groupBy("place").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(size // 64, "<i8")
    out[rows["place"].to_numpy("int64")] = rows["bits"].to_numpy("int64")
    return out.view(np.uint8)


def may_hold(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    a, b = _bits(values, 8 * len(bits))
    hit = lambda at: bits[(at >> np.uint64(3)).astype("int64")] >> (at & np.uint64(7)).astype(np.uint8) & 1
    return (hit(a) & hit(b)).astype(bool)


# -- parity bitmaps --


def bitmap_words(n):
    """64-bit words of the bitmap of a set of n: about n / 2 bits, a power of two of words."""
    return 1 << max(0, int(n - 1) // 128).bit_length()


def parity(tokens: np.ndarray) -> bytes:
    words = bitmap_words(len(tokens))
    at = (mix(tokens, 3) % np.uint64(words * 64)).astype("int64")
    return np.packbits((np.bincount(at, minlength=words * 64) & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set with fewer words (rows of a matrix alike)."""
    while bitmap.shape[-1] > words:
        half = bitmap.shape[-1] // 2
        bitmap = bitmap[..., :half] ^ bitmap[..., half:]
    return bitmap


# -- steps --


def _docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"))


def _sets_of(batch, k):
    return shingle_sets(batch.column(1).cast(pa.large_binary()).to_pylist(), k)


def frequent_tokens(docs: DataFrame, k: int, cut: int) -> DataFrame:
    """Tokens below ``cut`` that at least HOT rows hold, counted over all rows."""

    def count(batches):
        held, size = [], 0

        def flush():
            u, n = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(u), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[i : i + 50_000].view("<i8")), pa.array(n[i : i + 50_000])], names=["token", "n"])

        for batch in batches:
            for own in _sets_of(batch, k):
                own = own[: np.searchsorted(own, np.uint64(cut))]
                held.append(own)
                size += len(own)
                if size >= 2_000_000:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return docs.mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT).select("token")


def describe(docs: DataFrame, k: int, rule: Rule, cut: int, hot: np.ndarray) -> DataFrame:
    """(id, n, f1, f2, prefix, bitmap, sketch) of each row: size, fingerprint, prefix tokens in order, parity bitmap, smallest tokens."""
    known = docs.sparkSession.sparkContext.broadcast(hot)
    names = ["id", "n", "f1", "f2", "prefix", "bitmap", "sketch"]

    def run(batches):
        bits = known.value
        for batch in batches:
            n, f1, f2, prefix, bitmap, sketch = [], [], [], [], [], []
            for own in _sets_of(batch, k):
                size = len(own)
                n.append(size)
                sketch.append(own[:SKETCH].tobytes())
                with np.errstate(over="ignore"):
                    f1.append(int(mix(own, 1).sum(dtype="<u8").view("<i8")))
                    f2.append(int(mix(own, 2).sum(dtype="<u8").view("<i8")))
                if not size:
                    prefix.append(b"")
                    bitmap.append(b"")
                    continue
                below = np.searchsorted(own, np.uint64(cut))
                is_hot = may_hold(bits, own[:below])
                order = np.concatenate([own[:below][~is_hot], own[below:], own[:below][is_hot]])
                prefix.append(order[: rule.prefix(size)].tobytes())
                bitmap.append(parity(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(prefix, pa.binary()), pa.array(bitmap, pa.binary()), pa.array(sketch, pa.binary())], names=names)

    return docs.mapInArrow(run, "id bigint, n bigint, f1 bigint, f2 bigint, prefix binary, bitmap binary, sketch binary")


def entries_of(reps: DataFrame) -> DataFrame:
    """(token, id, n, crowd, pos): a row for each prefix token."""

    def run(batches):
        for batch in batches:
            ids, ns, crowds = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            for lo in range(0, len(ids), 500):
                parts = [np.frombuffer(p, "<i8") for p in batch.column(3)[lo : lo + 500].to_pylist()]
                sizes = np.array([len(p) for p in parts])
                pos = np.concatenate([np.arange(s, dtype="int32") for s in sizes])
                put = lambda v: pa.array(np.repeat(v[lo : lo + 500], sizes))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), put(ids), put(ns.astype("int32")), put(crowds), pa.array(pos)], names=["token", "id", "n", "crowd", "pos"])

    return reps.select("id", "n", "crowd", "prefix").where("n > 0").mapInArrow(run, "token bigint, id bigint, n int, crowd bigint, pos int")


def long_lists(reps: DataFrame) -> DataFrame:
    """(long): tokens whose list has more than LIST_ENTRIES entries.

    A task passes on what it has seen twice or more among about two million entries, so almost nothing is shuffled; a list
    can thus be longer than LIST_ENTRIES by no more than the number of such portions.
    """

    def count(batches):
        held, size = [], 0

        def flush():
            u, n = np.unique(np.concatenate(held), return_counts=True)
            u, n = u[n > 1], n[n > 1]
            for i in range(0, len(u), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[i : i + 50_000]), pa.array(n[i : i + 50_000])], names=["token", "m"])

        for batch in batches:
            for p in batch.column(0).to_pylist():
                held.append(np.frombuffer(p, "<i8"))
                size += len(held[-1])
                if size >= 2_000_000:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    counts = reps.select("prefix").where("octet_length(prefix) > 0").mapInArrow(count, "token bigint, m bigint")
    counts = counts.groupBy("token").agg(F.sum("m").alias("m")).where(F.col("m") > LIST_ENTRIES)
    return counts.select(F.col("token").alias("long"))


def cut_lists(entries: DataFrame, long: DataFrame, scratch: Scratch) -> DataFrame:
    """Entries with the block of their list that they are worked on in: all pairs of different crowds meet in some block.

    Of a long list the entries of its largest crowd, which make no pairs among themselves, are dealt out, and the others
    go to all blocks.  Where the others alone make a long list, blocks meet in pairs (i, j), i <= j.  A list of a
    single crowd has no pairs and goes.
    """
    if long.isEmpty():
        return entries.withColumn("block", F.lit(0))
    own = entries.join(long, F.col("token") == F.col("long"), "left_semi").groupBy("token", "crowd").agg(F.count("*").alias("m"))
    own = own.groupBy("token").agg(F.sum("m").alias("m"), F.max(F.struct("m", "crowd")).alias("top"))
    rest = F.col("m") - F.col("top.m")
    cut = own.select(F.col("token").alias("long"), F.col("top.crowd").alias("top"), rest.alias("rest"), F.ceil(F.col("m") / LIST_ENTRIES).cast("int").alias("parts"), F.ceil(2 * F.col("m") / LIST_ENTRIES).cast("int").alias("pairs"))
    put = entries.join(scratch.write(cut, "long lists"), F.col("token") == F.col("long"), "left").where("rest is null or rest > 0")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    star = F.when(F.col("crowd") == F.col("top"), F.array(part("parts"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    pair = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("pairs") - 1), lambda j: F.least(part("pairs"), j) * F.col("pairs") + F.greatest(part("pairs"), j)))
    blocks = F.when(F.col("rest").isNull(), F.array(F.lit(0))).when(F.col("rest") <= LIST_ENTRIES, star).otherwise(pair)
    return put.select("token", "id", "n", "crowd", "pos", F.explode(blocks).alias("block"))


def _runs(batches, columns: list[str], key: list[str]):
    """Whole groups of consecutive rows with one key, many groups at a time: a dict of arrays."""
    rest: dict | None = None
    for batch in batches:
        now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
        if rest is not None:
            now = {c: np.concatenate([rest[c], now[c]]) for c in columns}
        m = len(now[key[0]])
        if not m:
            continue
        last = np.ones(m, bool)
        for c in key:
            last &= now[c] == now[c][-1]
        whole = int(m - last[::-1].argmin()) if not last.all() else 0
        if whole:
            yield {c: v[:whole] for c, v in now.items()}
        rest = {c: v[whole:] for c, v in now.items()}
    if rest is not None and len(rest[key[0]]):
        yield rest


def _bounds(now: dict, key: list[str]) -> np.ndarray:
    m = len(now[key[0]])
    new = np.zeros(m, bool)
    new[0] = True
    for c in key:
        new[1:] |= now[c][1:] != now[c][:-1]
    return np.append(np.flatnonzero(new), m)


def list_pairs(n: np.ndarray, pos: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (larger, smaller) of entries of one list, sorted by (n, pos), that position and size allow."""
    sizes, first = np.unique(n, return_index=True)
    ends = np.append(first[1:], len(n))
    big, small = [], []
    for b, nx in enumerate(sizes.tolist()):  # the entries of size nx against the blocks of sizes up to nx
        lo = int(np.searchsorted(sizes, rule.smallest(nx)))
        for c in range(lo, b + 1):
            ny = int(sizes[c])
            least = rule.overlap(nx, ny)
            # skip what stands too far back, in either block
            rows = first[b] + np.searchsorted(pos[first[b] : ends[b]], nx - least, side="right")
            cols = first[c] + np.searchsorted(pos[first[c] : ends[c]], ny - least, side="right")
            x, y = np.arange(first[b], rows), np.arange(first[c], cols)
            if len(x) and len(y):
                x, y = np.repeat(x, len(y)), np.tile(y, len(x))
                keep = x > y if b == c else slice(None)
                big.append(x[keep])
                small.append(y[keep])
    if not big:
        return np.zeros(0, "int64"), np.zeros(0, "int64")
    return np.concatenate(big), np.concatenate(small)


def cross_pairs(n: np.ndarray, pos: np.ndarray, crowd: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of entries of one list that position and size allow, of different crowds."""
    names, count = np.unique(crowd, return_counts=True)
    if len(names) == 1:
        return np.zeros(0, "int64"), np.zeros(0, "int64")
    others = np.flatnonzero(crowd != names[count.argmax()])
    if 4 * len(others) > len(n):
        x, y = list_pairs(n, pos, rule)
        keep = crowd[x] != crowd[y]
        return x[keep], y[keep]
    # one crowd is most of the list: the few others against all
    left, right, at = [], [], np.arange(len(n))
    is_other = np.zeros(len(n), bool)
    is_other[others] = True
    step = max(1, 500_000 // len(n))
    for i in range(0, len(others), step):
        a = others[i : i + step, None]
        least = rule.overlap(n[a], n)
        ok = (crowd[a] != crowd) & (n[a] - pos[a] >= least) & (n - pos >= least) & (np.minimum(n[a], n) >= rule.smallest(np.maximum(n[a], n)))
        ok &= ~is_other | (at < a)  # a pair of two others once
        x, y = np.nonzero(ok)
        left.append(a[x, 0])
        right.append(y)
    return np.concatenate(left), np.concatenate(right)


_SORTED = ["token", "block", "n", "pos", "id"]


def scan_lists(entries: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of different crowds that share a list and are allowed by size and position there (kind 0: a, b), and the entries of
    lists that would make many pairs (kind 1: token, block, id as a, n, pos, crowd)."""
    kinds = {"kind": "int32", "token": "int64", "block": "int32", "a": "int64", "b": "int64", "n": "int32", "pos": "int32", "crowd": "int64"}

    def emit(m, **given):
        for i in range(0, m, 100_000):
            size = min(100_000, m - i)
            columns = [np.asarray(given[c][i : i + size]).astype(t) if not np.isscalar(given.get(c, 0)) else np.full(size, given.get(c, 0), t) for c, t in kinds.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list(kinds))

    def run(batches):
        for now in _runs(batches, [*_SORTED, "crowd"], ["token", "block"]):
            bounds = _bounds(now, ["token", "block"])
            length = np.diff(bounds)
            if not (length > 1).any():
                continue
            short = np.repeat((length > 1) & (length <= 12), length)
            own = np.repeat(np.arange(len(length)), length)[short]
            n, pos, ids, crowd = (now[c][short].astype("int64") for c in ("n", "pos", "id", "crowd"))
            for d in range(1, 12):  # all short lists at once: each entry with the d-th before it
                x, y = slice(d, None), slice(0, max(0, len(own) - d))
                same = own[x] == own[y]
                if not same.any():
                    break
                nx, ny = n[x], n[y]
                least = rule.overlap(nx, ny)
                ok = same & (crowd[x] != crowd[y]) & (ny >= rule.smallest(nx)) & (nx - pos[x] >= least) & (ny - pos[y] >= least)
                yield from emit(int(ok.sum()), a=ids[x][ok], b=ids[y][ok])
            for i in np.flatnonzero(length > 12).tolist():
                part = slice(bounds[i], bounds[i + 1])
                n, pos, ids, crowd = (now[c][part].astype("int64") for c in ("n", "pos", "id", "crowd"))
                x, y = cross_pairs(n, pos, crowd, rule)
                if len(x) > DENSE * len(n):
                    yield from emit(len(n), kind=1, token=now["token"][part], block=now["block"][part], a=ids, n=n, pos=pos, crowd=crowd)
                else:
                    yield from emit(len(x), a=ids[x], b=ids[y])

    placed = entries.repartition("token", "block").sortWithinPartitions(*_SORTED)
    return placed.mapInArrow(run, "kind int, token bigint, block int, a bigint, b bigint, n int, pos int, crowd bigint")


def sift_dense(dense: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of lists that would make many, as far as bitmaps allow them; the others never become rows."""

    def run(batches):
        for now in _runs(batches, [*_SORTED, "crowd", "bitmap"], ["token", "block"]):
            bounds = _bounds(now, ["token", "block"])
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                n, pos, ids, crowd = (now[c][lo:hi].astype("int64") for c in ("n", "pos", "id", "crowd"))
                maps = now["bitmap"][lo:hi]
                words = np.array([len(m) // 8 for m in maps])
                x, y = cross_pairs(n, pos, crowd, rule)
                x, y = np.where(n[x] < n[y], y, x), np.where(n[x] < n[y], x, y)
                allowed = np.zeros(len(x), bool)
                for w in np.unique(words).tolist():
                    table = np.zeros((len(n), w), "<u8")
                    for i in np.flatnonzero(words >= w):
                        table[i] = fold(np.frombuffer(maps[i], "<u8"), w)
                    of = np.flatnonzero(words[y] == w)
                    for s in range(0, len(of), 100_000):
                        at = of[s : s + 100_000]
                        far = np.bitwise_count(table[x[at]] ^ table[y[at]]).sum(1)
                        allowed[at] = far <= n[x[at]] + n[y[at]] - 2 * rule.overlap(n[x[at]], n[y[at]])
                a, b = ids[x[allowed]], ids[y[allowed]]
                for i in range(0, len(a), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 100_000]), pa.array(b[i : i + 100_000])], names=["a", "b"])

    placed = dense.repartition("token", "block").sortWithinPartitions(*_SORTED)
    return placed.mapInArrow(run, "a bigint, b bigint")


def allowed_pairs(pairs: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b, na, nb, ma, mb) whose bitmaps do not rule out a link."""

    def run(batches):
        for batch in batches:
            a, b, na, nb = (batch.column(c).to_numpy(zero_copy_only=False).astype("int64") for c in ("a", "b", "na", "nb"))
            far = np.empty(len(a), "int64")
            for i, (p, q) in enumerate(zip(batch.column("ma").to_pylist(), batch.column("mb").to_pylist(), strict=True)):
                p, q = np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8")
                w = min(len(p), len(q))
                far[i] = np.bitwise_count(fold(p, w) ^ fold(q, w)).sum()
            ok = far <= na + nb - 2 * rule.overlap(na, nb)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    return pairs.mapInArrow(run, "a bigint, b bigint")


def wanted_sets(docs: DataFrame, k: int, bits: np.ndarray) -> DataFrame:
    """(sid, tokens) of the rows whose id the filter may hold."""
    known = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(may_hold(known.value, ids.astype("<i8").view("<u8")))
            if len(keep):
                texts = batch.column(1).take(pa.array(keep)).cast(pa.large_binary()).to_pylist()
                sets = [s.tobytes() for s in shingle_sets(texts, k)]
                for i in range(0, len(keep), 500):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[keep[i : i + 500]]), pa.array(sets[i : i + 500], pa.binary())], names=["sid", "tokens"])

    return docs.where("id is not null").mapInArrow(run, "sid bigint, tokens binary")


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which tokens of the sorted x are in the sorted y."""
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return y[at] == x if len(y) else np.zeros(len(x), bool)


def verified(pairs: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, overlap) of the pairs (a, b, ta, tb) that link."""

    def run(batches):
        for batch in batches:
            a, b, n = [], [], []
            for p, q, s, t in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb")), strict=True):
                x, y = np.frombuffer(s, "<u8"), np.frombuffer(t, "<u8")
                both = int(_shared(x, y).sum())
                if both >= rule.overlap(len(x), len(y)):
                    a.append(p)
                    b.append(q)
                    n.append(both)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "overlap"])

    return pairs.mapInArrow(run, "a bigint, b bigint, overlap bigint")


def differences(members: DataFrame, rule: Rule) -> DataFrame:
    """(pivot, id, n, np, linked, less, more) of members (pivot, id, tp, ti): what a set lacks of the pivot, and has beyond it."""
    names = ["pivot", "id", "n", "np", "linked", "less", "more"]

    def run(batches):
        for batch in batches:
            rows = []
            for p, i, s, t in zip(*(batch.column(c).to_pylist() for c in ("pivot", "id", "tp", "ti")), strict=True):
                x, y = np.frombuffer(s, "<u8"), np.frombuffer(t, "<u8")
                less, more = x[~_shared(x, y)], y[~_shared(y, x)]
                rows.append((p, i, len(y), len(x), bool(len(x) - len(less) >= rule.overlap(len(x), len(y))), less.tobytes(), more.tobytes()))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return members.mapInArrow(run, "pivot bigint, id bigint, n bigint, np bigint, linked boolean, less binary, more binary")


def crowds_of(rows: DataFrame, reps: DataFrame, k: int, rule: Rule, scratch: Scratch) -> DataFrame:
    """(pivot, id, n, np, linked, less, more): the members of crowds, all linked to their pivot, and pivots with no difference."""

    def tokens(batches):
        for batch in batches:
            parts = []
            for p in batch.column(1).to_pylist():
                own = np.frombuffer(p, "<u8")
                # two tokens together: one alone is often boilerplate
                x, y = np.triu_indices(len(own), 1)
                parts.append(mix(own[x] + mix(own[y], 31), 32) if len(x) else own)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view("<i8")), pa.array(np.repeat(batch.column(0).to_numpy(), [len(p) for p in parts]))], names=["token", "id"])

    looking = scratch.write(reps.select("id", "sketch").mapInArrow(tokens, "token bigint, id bigint"), "looking")

    def choose(looking):
        crowds = looking.groupBy("token").agg(F.min("id").alias("first"), F.count("*").alias("m")).where(F.col("m") >= CROWD)
        best = looking.join(crowds.withColumnRenamed("token", "of"), F.col("token") == F.col("of")).groupBy("id").agg(F.max(F.struct("m", (-F.col("first")).alias("minus"))).alias("best"))
        best = scratch.write(best.select("id", (-F.col("best.minus")).alias("pivot")), "choices")
        heads = best.select(F.col("pivot").alias("head")).distinct()
        return scratch.write(best.join(heads, F.col("id") == F.col("head"), "left_anti"), "chosen")

    chosen, found, sets = choose(looking), [], None
    for turn in range(CHOICES):
        if chosen.isEmpty():
            break
        if sets is None:
            wanted = scratch.write(chosen.select("id").union(chosen.select("pivot")).distinct(), "wanted ids")
            sets = scratch.write(wanted_sets(rows, k, bloom(wanted)).dropDuplicates(), "crowd sets")
        pairs = chosen.join(sets.select(F.col("sid").alias("id"), F.col("tokens").alias("ti")), "id").join(sets.select(F.col("sid").alias("pivot"), F.col("tokens").alias("tp")), "pivot")
        found.append(scratch.write(differences(pairs, rule), "differences"))
        if turn + 1 < CHOICES:
            lost = found[-1].where("not linked").select(F.col("id").alias("lost"))
            looking = scratch.write(looking.join(lost, F.col("id") == F.col("lost"), "left_semi"), "looking")
            chosen = choose(looking)
    if not found:
        return differences(reps.sparkSession.createDataFrame([], "pivot bigint, id bigint, tp binary, ti binary"), rule)
    # rows that share an id but not the text may link and not link; one row for each id
    members = reduce(DataFrame.union, found).where("linked").dropDuplicates(["id"])
    heads = members.groupBy("pivot").agg(F.max("np").alias("np"))
    empty = F.lit(b"")
    heads = heads.select("pivot", F.col("pivot").alias("id"), F.col("np").alias("n"), "np", F.lit(True).alias("linked"), empty.alias("less"), empty.alias("more"))
    return scratch.write(members.union(heads), "crowds")


def links_in_crowds(members: DataFrame, scratch: Scratch, rule: Rule) -> DataFrame:
    """(id, links): for each member of a crowd how many rows of other members it links with, from differences alone.

    ``members`` has ``size``, the rows of a member's class.  Blocks of a crowd meet in pairs (i, j), i <= j.
    """
    sizes = scratch.write(members.groupBy("pivot").agg(F.ceil(F.count("*") / GROUP_BLOCK).cast("int").alias("parts")).withColumnRenamed("pivot", "of"), "crowd sizes")
    own = members.join(sizes, F.col("pivot") == F.col("of")).drop("of").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j")))
    blocks = own.select("pivot", "id", "n", "np", "less", "more", "size", "part", F.explode(F.array_distinct(meet)).alias("pair")).select("*", "pair.i", "pair.j").drop("pair")

    def compare(table: pa.Table) -> pa.Table:
        get = lambda c: table.column(c).to_numpy()
        less, more = (table.column(c).to_pylist() for c in ("less", "more"))
        lack = np.array([len(x) // 8 for x in less])
        owner = np.repeat(np.arange(len(less)), lack + [len(x) // 8 for x in more])
        # a token that the pivot lacks and one that it has are never the same, so both kinds share one numbering
        number, held = np.unique(np.frombuffer(b"".join(x + y for x, y in zip(less, more, strict=True)), "<u8"), return_inverse=True)
        n, ids, size, part = get("n"), get("id"), get("size"), get("part")
        u = np.flatnonzero(part == get("i"))
        v = np.flatnonzero(part == get("j"))
        both = np.zeros((len(u), len(v)), "float32")
        for s in range(0, len(number), 4096):
            some = (held >= s) & (held < s + 4096)
            held_by = np.zeros((len(less), min(4096, len(number) - s)), "float32")
            held_by[owner[some], held[some] - s] = 1
            both += held_by[u] @ held_by[v].T
        overlap = get("np")[0] - lack[u][:, None] - lack[v] + np.rint(both).astype("int64")
        good = (overlap >= rule.overlap(n[u][:, None], n[v])) & (ids[u][:, None] != ids[v])
        links = np.zeros(len(less), "int64")
        links[u] += good @ size[v]
        if len(u) and len(v) and u[0] != v[0]:
            links[v] += size[u] @ good
        return pa.table({"id": pa.array(ids), "links": pa.array(links)})

    return blocks.groupBy("pivot", "i", "j").applyInArrow(compare, "id bigint, links bigint").groupBy("id").agg(F.sum("links").alias("links"))


def jaccard_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The join of a table with itself, a row per row: doc_id, n_shingles, class_id, component_id, n_links.

    class_id is the smallest id with an equal set, component_id the smallest id reachable by links, n_links the number of other
    documents that a document links with, those with an equal set included.  Every link is counted; pairs are not listed, so a
    crowd of copies does not cost its square in rows.

    A text that is null or has no word has an empty set: n_shingles 0, linked with nothing, its own class and component.
    Rows without an id get null for both, and no links.  Rows that repeat an id and a text are one document for links; of rows that
    repeat an id with other texts each text counts for n_links, and n_links may miss links of all but one of them.  Other columns
    are not read; an empty table gives an empty result.
    """
    spark, rule = docs.sparkSession, Rule(num, den)
    scratch = Scratch(spark, "setjoin")
    rows = _docs(docs, id_col, text_col)
    cut = min((1 << 64) - 1, int((1 << 64) * min(1.0, 1.5 * (1 - num / den))))
    hot = bloom(scratch.write(frequent_tokens(rows, k, cut), "hot"))
    told = scratch.write(describe(rows, k, rule, cut, hot), "sets")
    some = told.where("n > 0 and id is not null").select("n", "f1", "f2", "id").distinct()
    classes = some.groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"), F.count("*").alias("size")).select(F.col("n").alias("cn"), F.col("f1").alias("c1"), F.col("f2").alias("c2"), "rep", "size")
    classes = scratch.write(classes, "classes")
    same = (F.col("n") == F.col("cn")) & (F.col("f1") == F.col("c1")) & (F.col("f2") == F.col("c2"))
    is_rep = F.col("rep") == F.col("id")
    member = told.join(classes, same, "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep"), "size", *(F.when(is_rep, F.col(c)).alias(c) for c in ("prefix", "bitmap", "sketch")))
    member = scratch.write(member, "members")
    reps = scratch.write(member.where("prefix is not null").dropDuplicates(["id", "n", "prefix"]).drop("rep"), "reps")
    sized = reps.groupBy("id").agg(F.max("size").alias("size")).withColumnRenamed("id", "sid")

    crowds = crowds_of(rows, reps, k, rule, scratch)
    of = crowds.select(F.col("id").alias("cid"), "pivot")
    reps = scratch.write(reps.join(of, F.col("id") == F.col("cid"), "left").drop("cid").withColumn("crowd", F.coalesce("pivot", "id")), "reps in crowds")
    inside = scratch.write(links_in_crowds(crowds.join(sized, F.col("id") == F.col("sid")).drop("sid"), scratch, rule), "inside")
    entries = entries_of(reps)
    scanned = scratch.write(scan_lists(cut_lists(entries, scratch.write(long_lists(reps), "long"), scratch), rule), "lists")
    bitmaps = reps.select(F.col("id").alias("bid"), F.col("n").cast("bigint").alias("bn"), "bitmap")
    dense = scanned.where("kind = 1").select("token", "block", F.col("a").alias("id"), "n", "pos", "crowd")
    dense = dense.join(bitmaps, (F.col("id") == F.col("bid")) & (F.col("n") == F.col("bn"))).drop("bid", "bn")
    scanned = scanned.where("kind = 0").select("a", "b").union(sift_dense(dense, rule))
    scanned = scratch.write(scanned.where("a <> b").distinct(), "scanned")
    scratch.discard("sets", "classes", "long", "looking", "choices", "chosen", "crowd sets", "long lists", "lists")
    with_a = scanned.join(bitmaps.select(F.col("bid").alias("a"), F.col("bn").alias("na"), F.col("bitmap").alias("ma")), "a")
    with_b = with_a.join(bitmaps.select(F.col("bid").alias("b"), F.col("bn").alias("nb"), F.col("bitmap").alias("mb")), "b")
    pairs = allowed_pairs(with_b, rule)
    pairs = scratch.write(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    scratch.discard("scanned", "reps", "reps in crowds")
    wanted = scratch.write(pairs.select("a").union(pairs.select("b")).distinct(), "wanted ids")
    sets = scratch.write(wanted_sets(rows, k, bloom(wanted)).dropDuplicates(), "wanted")
    pair_sets = pairs.join(sets.select(F.col("sid").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("sid").alias("b"), F.col("tokens").alias("tb")), "b")
    found = scratch.write(verified(pair_sets, rule).select("a", "b").distinct(), "found")
    scratch.discard("pairs", "wanted", "wanted ids")
    components = connected_components(spark, found.union(crowds.select("pivot", "id").where("pivot <> id")), scratch)
    both = found.union(found.select("b", "a")).toDF("id", "other")
    count = member.where("prefix is not null").select(F.col("id").alias("sid"), "size").distinct().groupBy("sid").agg(F.max("size").alias("size"))
    across = both.join(count, F.col("other") == F.col("sid")).groupBy("id").agg(F.sum("size").alias("links"))
    links = scratch.write(across.unionByName(inside).groupBy(F.col("id").alias("lid")).agg(F.sum("links").alias("links")), "links")
    out = member.select("id", "n", "rep", "size").join(components.select(F.col("id").alias("cid"), "component"), F.col("rep") == F.col("cid"), "left").join(links, F.col("rep") == F.col("lid"), "left")
    n_links = F.when(F.col("id").isNull(), 0).otherwise(F.coalesce(F.col("size") - 1, F.lit(0)) + F.coalesce("links", F.lit(0)))
    scratch.discard("differences", "crowds", "crowd sizes", "found")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"), n_links.cast("bigint").alias("n_links"))
