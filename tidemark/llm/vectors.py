"""Operators over embeddings: near-duplicates by sorted projection passes, nearest neighbours by NN-descent."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Scratch, connected_components


def _wide(column, schema_type) -> str:
    return "<f8" if schema_type.elementType.simpleString() == "double" else "<f4"


def valid_vectors(table: DataFrame, scratch: Scratch, id_col: str, vec_col: str, label: Column) -> tuple[DataFrame, str]:
    """(uid, vec_id, label, dim, vec) of all rows, and the number type of vec (bytes); ``label`` is a long.

    uid numbers the rows.  vec is null where the vector takes no part: null, empty, zero, or with null or non-finite
    components.  Written once, so that uid stays the same.
    """
    kind = _wide(vec_col, table.schema[vec_col].dataType)
    element = "double" if kind == "<f8" else "float"
    rows = table.select(F.monotonically_increasing_id().alias("uid"), table[id_col].cast("bigint").alias("vec_id"), label.alias("label"), table[vec_col].cast(f"array<{element}>").alias("v"))

    def pack(batches):
        for b in batches:
            vec, dim = [], []
            for v in b.column("v"):
                x = None if not v.is_valid or v.values.null_count else v.values.to_numpy().astype(kind)
                ok = x is not None and len(x) and np.isfinite(x).all() and x.any()
                vec.append(x.tobytes() if ok else None)
                dim.append(len(x) if ok else 0)
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("vec_id"), b.column("label"), pa.array(dim, pa.int32()), pa.array(vec, pa.binary())], names=["uid", "vec_id", "label", "dim", "vec"])

    return scratch.write(rows.mapInArrow(pack, "uid bigint, vec_id bigint, label bigint, dim int, vec binary"), "vectors"), kind


def _matrix(vecs: list[bytes], kind: str, width: int) -> np.ndarray:
    """Rows of doubles, shorter vectors filled up with zeros."""
    out = np.zeros((len(vecs), width))
    for i, v in enumerate(vecs):
        x = np.frombuffer(v, kind)
        out[i, : len(x)] = x
    return out


def _directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


# -- near-duplicates --

#: Passes at least, sign bits of a pass's sort key, vectors of a block, share of lone pairs at the threshold that no pass may see.
PASSES, KEY_BITS, BLOCK, MISSED = 8, 48, 512, 0.01


def passes_for(n: int, num: float) -> int:
    """How many passes n vectors of a label need.

    Two vectors at cosine ``num`` differ in each sign with probability acos(num) / pi.  They surely meet in a pass where they agree in
    as many leading signs as cut the n vectors into parts of a block.
    """
    bits = max(0.0, np.log2(n / BLOCK)) if n else 0.0
    agree = (1 - np.arccos(np.clip(num, -1.0, 1.0)) / np.pi) ** bits
    if agree >= 1 - MISSED or agree <= 0:
        return PASSES
    return max(PASSES, int(np.ceil(np.log(MISSED) / np.log1p(-agree))))


def _groups(batches, columns: list[str], key: list[str]):
    """Tables of the rows of one key each; rows come sorted by key."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        ids = [rest.column(k).to_numpy() for k in key]
        if not len(rest):
            continue
        new = np.zeros(len(rest), bool)
        for i in ids:
            new[1:] |= i[1:] != i[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield rest.slice(a, b - a)
        rest = rest.slice(cuts[-1])
    if rest is not None and len(rest):
        yield rest


def _forest(good: np.ndarray) -> np.ndarray:
    """For each node of a symmetric relation the smallest node of its component."""
    label = np.arange(len(good))
    while True:
        near = np.where(good, label[None, :], len(good)).min(1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicate_vectors(table: DataFrame, num: float = 0.93, id_col="vec_id", vec_col="embedding", label_col="label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row; vectors with equal labels link at cosine >= ``num``.

    Equal vectors of a label are one class first, and link.  In each of ``passes_for`` passes the classes are ordered by
    label and by the concatenated signs of random projections, cut into blocks of BLOCK, and each block is compared with
    itself and its neighbour in double precision; of the links found spanning ones are returned, which give components.
    Then all pairs within a component are compared, whichever pass brought them together, so a crowd larger than the window
    loses no link.  Blocks return counts and spanning links, never all pairs.

    Rows whose label or id is null, or whose vector is null, empty, zero or holds null or non-finite components, link
    with nothing: n_links 0, component_id their own id, kept.  Vectors of different length never link.  Repeated rows are vectors
    of their own that link with each other.  An empty table gives no rows.
    """
    spark, scratch = table.sparkSession, Scratch(table.sparkSession, "vectors")
    label = table[label_col]
    if not isinstance(table.schema[label_col].dataType, T.IntegralType):  # a hash of other labels, null stays null
        label = F.when(label.isNotNull(), F.xxhash64(label))
    rows, kind = valid_vectors(table, scratch, id_col, vec_col, label.cast("bigint"))
    marked = rows.where("vec is not null and label is not null and vec_id is not null").withColumn("fp", F.sha2("vec", 256))
    classes = scratch.write(marked.groupBy("label", "dim", "fp").agg(F.min("uid").alias("rep"), F.count("*").alias("size")), "classes")
    named = classes.select(F.col("label").alias("cl"), F.col("dim").alias("cd"), F.col("fp").alias("cf"), "rep", "size")
    # a sort-merge join, of which Spark can split a vector that very many rows share
    same = (F.col("label") == F.col("cl")) & (F.col("dim") == F.col("cd")) & (F.col("fp") == F.col("cf"))
    member = scratch.write(marked.select("uid", "label", "dim", "fp").join(named.hint("merge"), same).select(F.col("uid").alias("mu"), "rep", "size"), "members")
    reps = classes.select(F.col("rep").alias("ru"), "size")
    used = scratch.write(rows.join(reps, F.col("uid") == F.col("ru")).select("uid", "label", "dim", "vec", "size"), "used")
    largest = used.groupBy("label", "dim").count().agg(F.max("count").alias("n")).first()["n"]  # a number
    if largest is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    passes = passes_for(largest, num)

    def keys(batches):
        for b in batches:
            vecs, dims = b.column("vec").to_pylist(), b.column("dim").to_numpy()
            out = np.zeros((len(vecs), passes), "int64")
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = _matrix([vecs[i] for i in at], kind, dim)
                signs = x @ _directions(dim, passes * KEY_BITS, 7) > 0
                weight = 1 << np.arange(KEY_BITS - 1, -1, -1)
                out[at] = (signs.reshape(len(at), passes, KEY_BITS) * weight).sum(2)
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("label"), b.column("dim"), pa.array(list(out), pa.list_(pa.int64()))], names=["uid", "label", "dim", "keys"])

    def number(batches):
        part, block, size, last = TaskContext.get().partitionId(), 0, 0, None
        for b in batches:
            at = []
            for p in b.column("pass").to_pylist():
                if p != last or size == BLOCK:
                    block, size, last = block + 1, 0, p
                at.append(block)
                size += 1
            n = len(at)
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("pass"), pa.array(np.full(n, part, "int32")), pa.array(at, pa.int64())], names=["uid", "pass", "part", "own"])

    def places(ordered, name):
        """(pu, pass, place) of the rows in order: the number of the block."""
        numbered = scratch.write(ordered.select("uid", "pass").mapInArrow(number, "uid bigint, pass int, part int, own bigint"), name)
        base, bases = 0, []
        for r in numbered.groupBy("part").agg(F.max("own").alias("n")).orderBy("part").collect():  # a row per partition
            bases.append((r["part"], base))
            base += r["n"]  # without a gap: the last block of a partition and the first of the next are neighbours
        starts = F.broadcast(spark.createDataFrame(bases, "p int, first bigint"))
        return numbered.join(starts, F.col("part") == F.col("p")).select(F.col("uid").alias("pu"), "pass", (F.col("first") + F.col("own")).alias("place"))

    def compare(batches):
        """kind 0: (uid, links), of blocks within components; kind 1: (uid, uid) linked, of blocks within passes."""
        for t in _groups(batches, [], ["block", "pass", "far"]):
            role = t.column("role").to_numpy()
            t = t.take(pa.array(np.argsort(role, kind="stable")))
            m = int((role == 0).sum())  # rows of the block itself; the rest is of the other block
            uid, label, dim, crowd, size = (t.column(c).to_numpy() for c in ("uid", "label", "dim", "crowd", "size"))
            if not m or (m == len(uid) and m == 1):
                continue
            x = _matrix(t.column("vec").to_pylist(), kind, int(dim.max()))
            x /= np.linalg.norm(x, axis=1)[:, None]
            good = x[:m] @ x.T >= num
            good &= (label[:m, None] == label) & (dim[:m, None] == dim) & (crowd[:m, None] == crowd)
            inside = good[:, :m]
            inside &= ~np.eye(m, dtype=bool)
            out = []
            if t.column("pass")[0].as_py() < 0:
                if t.column("far")[0].as_py() != t.column("block")[0].as_py():
                    inside[:] = False  # of two blocks only pairs across are new
                links = np.zeros(len(uid), "int64")
                links[:m] += good @ size
                links[m:] += size[:m] @ good[:, m:]
                out = [(0, int(u), int(n)) for u, n in zip(uid, links, strict=True) if n]
            elif good.any():
                full = np.zeros((len(uid), len(uid)), bool)
                full[:m] = good
                full |= full.T
                out = [(1, int(uid[i]), int(uid[j])) for i, j in enumerate(_forest(full)) if i != j]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["kind", "a", "b"])

    def compared(sides):
        order_by = ["block", "pass", "far"]
        sides = sides.select("uid", "label", "dim", "vec", "size", "crowd", "pass", "block", "far", "role")
        return sides.repartition(*order_by).sortWithinPartitions(*order_by, "role", "uid").mapInArrow(compare, "kind int, a bigint, b bigint")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["pass", "label", "dim", "key", "uid"]
    order = scratch.write(used.mapInArrow(keys, "uid bigint, label bigint, dim int, keys array<bigint>").select("uid", "label", "dim", F.posexplode("keys").alias("pass", "key")), "keys")
    place = places(order.repartitionByRange(parts, *by).sortWithinPartitions(*by), "numbered")
    placed = scratch.write(used.join(place, F.col("uid") == F.col("pu")), "placed")
    roles = F.explode(F.array(F.struct(F.col("place").alias("block"), F.lit(0).alias("role")), F.struct((F.col("place") - 1).alias("block"), F.lit(1).alias("role"))))
    zero = F.lit(0).cast("bigint")
    found = scratch.write(compared(placed.select("*", zero.alias("crowd"), zero.alias("far"), roles.alias("r")).select("*", "r.block", "r.role")), "compared")
    parts_of = connected_components(spark, found.select("a", "b"), scratch)
    parts_of = scratch.write(parts_of.select(F.col("id").alias("uid"), F.col("component").alias("crowd")), "components")

    # within components, blocks meet all blocks up to the component's last
    by = ["crowd", "uid"]
    ordered = parts_of.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("uid", F.lit(-1).alias("pass"))
    counts = spark.createDataFrame([], "lu bigint, n bigint")
    if not parts_of.isEmpty():
        place = places(ordered, "in crowds").join(parts_of.select(F.col("uid").alias("cu"), "crowd"), F.col("pu") == F.col("cu")).drop("cu")
        place = scratch.write(place, "crowded")
        ends = place.groupBy("crowd").agg(F.min("place").alias("head"), F.max("place").alias("end")).select(F.col("crowd").alias("of"), "head", "end")
        meet = place.join(scratch.write(ends, "ends").hint("merge"), F.col("crowd") == F.col("of")).drop("of")
        ahead = F.transform(F.sequence("place", "end"), lambda o: F.struct(F.col("place").alias("block"), o.alias("far"), F.lit(0).alias("role")))
        behind = F.when(F.col("head") < F.col("place"), F.transform(F.sequence(F.col("head"), F.col("place") - 1), lambda o: F.struct(o.alias("block"), F.col("place").alias("far"), F.lit(1).alias("role"))))
        none = F.array().cast("array<struct<block:bigint,far:bigint,role:int>>")
        meet = scratch.write(meet.select("pu", "crowd", "pass", F.concat(ahead, F.coalesce(behind, none)).alias("r")), "meet")
        sides = used.join(meet, F.col("uid") == F.col("pu")).select("*", F.explode("r").alias("s")).select("*", "s.block", "s.far", "s.role")
        met = scratch.write(compared(sides), "crowds")
        counts = scratch.write(met.groupBy(F.col("a").alias("lu")).agg(F.sum("b").alias("n")), "counts")
    own = member.join(parts_of, F.col("rep") == F.col("uid"), "left").drop("uid").join(counts, F.col("rep") == F.col("lu"), "left")
    # a row links with the others of its class and with all rows of linked classes
    links = F.col("size") - 1 + F.coalesce("n", F.lit(0))
    own = scratch.write(own.select("mu", F.coalesce("crowd", "rep").alias("in"), links.alias("links")), "own")
    whole = rows.select("uid", "vec_id").join(own, F.col("uid") == F.col("mu"), "left").select("uid", "vec_id", F.coalesce("in", "uid").alias("part"), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"))
    whole = scratch.write(whole, "parts")
    least = whole.groupBy("part").agg(F.min("vec_id").alias("component_id")).select(F.col("part").alias("pid"), "component_id")
    out = whole.join(scratch.write(least, "least"), F.col("part") == F.col("pid"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


# -- nearest neighbours --

#: Nodes of a shard of the index, neighbours of a node, neighbours (own and reverse) that meet in a round, rounds; queries of a block,
#: blocks that share a copy of a shard, beam, nodes opened in a step, random entry points.
SHARD, NEIGHBOURS, MEET, ROUNDS, QUERY_BLOCK, SHARED, BEAM, OPEN, ENTRIES = 8192, 16, 40, 4, 256, 64, 320, 16, 128


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    return np.argpartition(-scores, k - 1, axis=1)[:, :k] if scores.shape[1] > k else np.broadcast_to(np.arange(scores.shape[1]), scores.shape)


def _edges(rows) -> pa.RecordBatch:
    a, b, s = rows
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64()), pa.array(np.concatenate(s), pa.float32())], names=["a", "b", "score"])


def neighbour_graph(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, score): for each node of (shard, uid, g) its NEIGHBOURS nearest found in its shard, by NN-descent.

    g is a unit vector in half precision.  Starts from the best within random buckets; in each round, the neighbours and reverse
    neighbours of a node meet, found by joins of the graph with itself and with the vectors, and whoever is nearer
    than another's farthest neighbour becomes a candidate.
    """
    names = ["a", "b", "score"]
    size = nodes.groupBy("shard").agg(F.count("*").alias("n")).select(F.col("shard").alias("sh"), F.greatest(F.lit(1), F.ceil(F.col("n") / 64)).alias("buckets"))
    sized = nodes.join(scratch.write(size, "sizes"), F.col("shard") == F.col("sh"))

    def half(column):
        return np.stack([np.frombuffer(v, "<f2") for v in column.to_pylist()]).astype("f4")

    def start(batches):
        for t in _groups(batches, [], ["shard", "bucket"]):
            x, uid = half(t.column("g")), t.column("uid").to_numpy()
            if len(uid) > 1:
                s = x @ x.T
                np.fill_diagonal(s, -9)
                best = _top(s, min(NEIGHBOURS, len(uid) - 1))
                yield _edges(([np.repeat(uid, best.shape[1])], [uid[best].ravel()], [np.take_along_axis(s, best, 1).ravel()]))

    def best_of(found: DataFrame, name: str) -> DataFrame:
        def keep(batches):
            for t in _groups(batches, [], ["a"]):
                b, s = t.column("b").to_numpy(), t.column("score").to_numpy()
                b, first = np.unique(b, return_index=True)
                order = np.argsort(-s[first], kind="stable")[:NEIGHBOURS]
                yield (np.full(len(order), t.column("a")[0].as_py()), b[order], s[first][order])

        def batched(batches):
            held = []
            for row in keep(batches):
                held.append(row)
                if len(held) == 1000:
                    yield _edges(zip(*held, strict=True))
                    held = []
            if held:
                yield _edges(zip(*held, strict=True))

        return scratch.write(found.repartition("a").sortWithinPartitions("a").mapInArrow(batched, "a bigint, b bigint, score float"), name)

    graph = None
    for turn in (1, 2):
        bucketed = sized.select("shard", "uid", "g", F.pmod(F.xxhash64("uid", F.lit(turn)), F.col("buckets")).alias("bucket"))
        made = bucketed.repartition("shard", "bucket").sortWithinPartitions("shard", "bucket", "uid").mapInArrow(start, "a bigint, b bigint, score float")
        graph = made if graph is None else graph.union(made)
    graph = best_of(graph, "start")
    vectors = nodes.select(F.col("uid").alias("vu"), "g")

    def meet(batches):
        held = []
        for t in _groups(batches, [], ["center"]):
            t = t.slice(0, MEET)
            x, uid, worst = half(t.column("g")), t.column("member").to_numpy(), t.column("worst").to_numpy()
            s = x @ x.T
            np.fill_diagonal(s, -9)
            i, j = np.nonzero(s > worst[:, None])
            if len(i):
                held.append((uid[i], uid[j], s[i, j]))
            if len(held) == 500:
                yield _edges(zip(*held, strict=True))
                held = []
        if held:
            yield _edges(zip(*held, strict=True))

    for turn in range(ROUNDS):
        worst = graph.groupBy("a").agg(F.min("score").alias("worst"), F.count("*").alias("n")).select(F.col("a").alias("wa"), F.when(F.col("n") < NEIGHBOURS, -2.0).otherwise(F.col("worst")).cast("float").alias("worst"))
        known = scratch.write(vectors.join(worst, F.col("vu") == F.col("wa")).drop("wa"), "known")
        both = graph.select(F.col("a").alias("center"), F.col("b").alias("member")).union(graph.select(F.col("b").alias("center"), F.col("a").alias("member"))).distinct()
        met = both.join(known, F.col("member") == F.col("vu")).drop("vu")
        # who meets, where a node has more neighbours than may meet, is drawn anew in each round
        found = met.repartition("center").sortWithinPartitions("center", F.xxhash64("member", "center", F.lit(turn))).mapInArrow(meet, "a bigint, b bigint, score float")
        graph = best_of(graph.union(found), f"round{turn}")
    return graph


def beam_search(x: np.ndarray, links: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search of a shard for a block of queries: numbers of the k best nodes found (-1: none), and their inner products.

    x holds vectors (float32) and links node numbers (-1 for none).  Each query starts from ENTRIES random nodes and from its own, keeps
    a beam of the best nodes seen and opens the best unopened ones, until all of the beam are opened.  own: the query's
    number in the shard or -1.
    """
    n, q = len(x), len(queries)
    rng = np.random.default_rng(1)
    start = rng.choice(n, min(n, ENTRIES), replace=False)
    ids = np.tile(start, (q, 1))
    score = queries @ x[start].T
    seen = np.zeros((q, n), bool)
    seen[:, start] = True
    there = np.flatnonzero(own >= 0)
    extra, extra_score = np.full((q, 1), -1), np.full((q, 1), -np.inf, "f4")
    new = there[~seen[there, own[there]]]
    extra[new, 0] = own[new]
    extra_score[new, 0] = (queries[new] * x[own[new]]).sum(1)
    seen[new, own[new]] = True
    ids, score = np.concatenate([ids, extra], 1), np.concatenate([score, extra_score], 1)
    done = np.isneginf(score)
    while True:
        open_ = np.where(done, -np.inf, score)
        top = _top(open_, min(OPEN, open_.shape[1]))
        active = ~np.isneginf(np.take_along_axis(open_, top, 1))
        if not active.any():
            break
        np.put_along_axis(done, top, True, 1)
        near = links[np.take_along_axis(ids, top, 1)]
        near[~active] = -1
        near = np.sort(near.reshape(q, -1), axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        r, c = np.nonzero(fresh)
        keep = ~seen[r, near[r, c]]
        r, c = r[keep], c[keep]
        node = near[r, c]
        seen[r, node] = True
        got, got_score = np.full(near.shape, -1), np.full(near.shape, -np.inf, "f4")
        got[r, c] = node
        got_score[r, c] = np.einsum("ij,ij->i", queries[r], x[node])
        ids, score = np.concatenate([ids, got], 1), np.concatenate([score, got_score], 1)
        done = np.concatenate([done, np.isneginf(got_score)], 1)
        if ids.shape[1] > BEAM:
            best = _top(score, BEAM)
            ids, score, done = (np.take_along_axis(v, best, 1) for v in (ids, score, done))
    best = _top(score, min(k, score.shape[1]))
    return np.take_along_axis(ids, best, 1), np.take_along_axis(score, best, 1)


def _exponent(x: np.ndarray) -> int:
    """e with norm in [2 ** (e - 1), 2 ** e), without overflow."""
    top = int(np.frexp(np.abs(x).max())[1])
    return top + int(np.frexp(np.linalg.norm(np.ldexp(x, -top)))[1])


def nearest_neighbours(table: DataFrame, queries: str = "vec_id % 20 = 0", k: int = 20, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which ``queries`` holds, its k nearest other rows by inner product.

    ``queries`` is SQL over the columns of the table.  Equal vectors are one node.  Every valid row is indexed: nodes whose
    norms lie within a factor of two are a band, so that one long vector does not flatten the others; a band is cut into shards
    of about SHARD nodes by a hash.  Within a band largest inner product becomes nearness by one more component,
    sqrt(1 - |x|^2) after scaling; a shard's neighbour graph is built by NN-descent.  Each query is searched in each shard of its length,
    greedily over the graph with a beam; shards stay where they are and blocks of queries come to them.  Scores are
    inner products of the original vectors in double precision, ties go to the smaller id.

    Rows without an id and vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of
    different length do not meet.  Of repeated rows each is a candidate of its own.  Fewer than k candidates are all returned;
    an empty table gives no rows.
    """
    spark, scratch = table.sparkSession, Scratch(table.sparkSession, "index")
    rows, kind = valid_vectors(table, scratch, id_col, vec_col, F.coalesce(F.expr(queries).cast("boolean"), F.lit(False)).cast("bigint"))
    used = rows.where("vec is not null and vec_id is not null").withColumn("fp", F.sha2("vec", 256))
    classes = scratch.write(used.groupBy("dim", "fp").agg(F.min("uid").alias("rep")).select(F.col("dim").alias("cd"), F.col("fp").alias("cf"), "rep"), "classes")
    same = (F.col("dim") == F.col("cd")) & (F.col("fp") == F.col("cf"))
    member = scratch.write(used.select("uid", "vec_id", "dim", "fp", "label").join(classes.hint("merge"), same).select("uid", "vec_id", "dim", "label", "rep"), "members")
    # of a vector that very many rows share, only so many can be among the nearest
    first = member.withColumn("place", F.row_number().over(W.partitionBy("rep").orderBy("vec_id", "uid"))).where(F.col("place") <= k + 1)
    named = first.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("vec_id", "uid"))).alias("held")).select(F.col("rep").alias("nr"), "held")
    named = scratch.write(named, "named")

    def banded(batches):
        for b in batches:
            out = []
            for v in b.column("vec").to_pylist():
                x = np.frombuffer(v, kind).astype("f8")
                e = _exponent(x)
                x = np.ldexp(x, -e)
                out.append((e, np.append(x, np.sqrt(max(0.0, 1 - x @ x))).astype("<f2").tobytes()))
            band, g = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("dim"), b.column("vec"), pa.array(band, pa.int32()), pa.array(g, pa.binary())], names=["uid", "dim", "vec", "band", "g"])

    nodes = rows.select("uid", "dim", "vec").join(named.select("nr"), F.col("uid") == F.col("nr"), "left_semi")
    nodes = scratch.write(nodes.mapInArrow(banded, "uid bigint, dim int, vec binary, band int, g binary"), "banded")
    counted = nodes.groupBy("dim", "band").agg(F.count("*").alias("n")).select(F.col("dim").alias("d"), F.col("band").alias("e"), F.ceil(F.col("n") / SHARD).alias("shards"))
    sized = nodes.join(scratch.write(counted, "bands"), (F.col("dim") == F.col("d")) & (F.col("band") == F.col("e")))
    shard = F.xxhash64("dim", "band", F.pmod(F.xxhash64("uid"), F.col("shards")))
    sized = scratch.write(sized.select("uid", "dim", "band", "vec", "g", shard.alias("shard")), "nodes")
    graph = neighbour_graph(sized.select("shard", "uid", "g"), scratch)
    lists = graph.groupBy("a").agg(F.collect_list("b").alias("links")).select(F.col("a").alias("la"), "links")  # NEIGHBOURS at most
    linked = sized.drop("g").join(lists, F.col("uid") == F.col("la"), "left").join(named, F.col("uid") == F.col("nr"))
    linked = scratch.write(linked.select("shard", "uid", "dim", "band", "vec", "links", "held"), "linked")

    def pack(batches):
        for t in _groups(batches, [], ["shard"]):
            uid = t.column("uid").to_numpy()
            order = np.argsort(uid)
            number = {int(u): i for i, u in enumerate(uid[order])}
            vecs, out, held = (t.column(c).to_pylist() for c in ("vec", "links", "held"))
            links: list[list[int]] = [[] for _ in uid]
            for i, o in enumerate(order):
                for b in out[o] or ():
                    links[i].append(number[b])
                    links[number[b]].append(i)
            width = 4 * NEIGHBOURS
            table_ = np.full((len(uid), width), -1, "<i4")
            for i, own in enumerate(links):
                # own neighbours come first; of more reverse ones than there is room, any
                own = list(dict.fromkeys(own))[:width]
                table_[i, : len(own)] = own
            names = [held[o] for o in order]
            whose = np.array([(m["vec_id"], m["uid"]) for h in names for m in h], "<i8")
            blobs = (uid[order].astype("<i8"), np.array([len(h) for h in names], "<i4"), whose, table_)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([t.column(c)[0].as_py()], kind_) for c, kind_ in (("shard", pa.int64()), ("dim", pa.int32()), ("band", pa.int32()))), *(pa.array([x.tobytes()], pa.binary()) for x in blobs), pa.array([b"".join(vecs[o] for o in order)], pa.binary())],
                names=["shard", "dim", "band", "uids", "counts", "held", "links", "vecs"],
            )

    index = linked.repartition("shard").sortWithinPartitions("shard").mapInArrow(pack, "shard bigint, dim int, band int, uids binary, counts binary, held binary, links binary, vecs binary")
    index = scratch.write(index, "index")
    asked = member.where("label = 1").select(F.col("rep").alias("ar")).distinct()
    asked = nodes.select("uid", "dim", "band", "vec").join(asked, F.col("uid") == F.col("ar"), "left_semi")
    n_asked = asked.groupBy("dim").agg(F.count("*").alias("n")).select(F.col("dim").alias("qd"), F.ceil(F.col("n") / QUERY_BLOCK).alias("blocks"))
    n_asked = scratch.write(n_asked, "asked")
    asked = asked.join(n_asked, F.col("dim") == F.col("qd")).withColumn("block", F.pmod(F.xxhash64("uid", F.lit(5)), F.col("blocks")))

    def pack_queries(batches):
        for t in _groups(batches, [], ["dim", "block"]):
            blobs = (t.column("uid").to_numpy().astype("<i8"), t.column("band").to_numpy().astype("<i4"))
            yield pa.RecordBatch.from_arrays([pa.array([t.column("dim")[0].as_py()], pa.int32()), pa.array([t.column("block")[0].as_py()], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs), pa.array([b"".join(t.column("vec").to_pylist())], pa.binary())], names=["dim", "block", "uids", "held", "vecs"])

    blocks = asked.select("dim", "block", "uid", "band", "vec").repartition("dim", "block").sortWithinPartitions("dim", "block", "uid")
    blocks = scratch.write(blocks.mapInArrow(pack_queries, "dim int, block bigint, uids binary, held binary, vecs binary"), "queries")
    # a copy of a shard takes SHARED blocks of queries
    shared = F.floor(F.col("block") / SHARED).alias("copy")
    copies = index.join(n_asked, F.col("dim") == F.col("qd")).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("blocks") - 1) / SHARED))).alias("copy"))
    sides = copies.select("shard", "copy", F.lit(-1).cast("bigint").alias("block"), "dim", "band", "uids", "counts", "held", "links", "vecs")
    places = index.select("shard", F.col("dim").alias("sd"), "band")
    nothing = F.lit(None).cast("binary")
    come = blocks.join(places, F.col("dim") == F.col("sd")).select("shard", shared, "block", "dim", "band", "uids", nothing.alias("counts"), "held", nothing.alias("links"), "vecs")

    def search(batches):
        at = None
        for b in batches:
            for r in b.to_pylist():
                whole = np.frombuffer(r["vecs"], kind).reshape(-1, r["dim"]).astype("f8")
                if r["block"] < 0:  # the shard, before its queries
                    uids, links = np.frombuffer(r["uids"], "<i8"), np.frombuffer(r["links"], "<i4").reshape(len(whole), -1)
                    counts, held = np.frombuffer(r["counts"], "<i4"), np.frombuffer(r["held"], "<i8").reshape(-1, 2)
                    at, nodes_, scaled, first_of = (r["shard"], r["copy"]), whole, np.ldexp(whole, -r["band"]).astype("f4"), np.cumsum(counts) - counts
                    continue
                if at != (r["shard"], r["copy"]):
                    raise ValueError("queries without their shard")
                q_uids, bands = np.frombuffer(r["uids"], "<i8"), np.frombuffer(r["held"], "<i4")
                place = np.minimum(np.searchsorted(uids, q_uids), len(uids) - 1)
                own = np.where(uids[place] == q_uids, place, -1)
                ids, found = beam_search(scaled, links, np.ldexp(whole, -bands[:, None]).astype("f4"), own, k + 13)
                i, j = np.nonzero(~np.isneginf(found))
                node = ids[i, j]
                score = np.einsum("ij,ij->i", whole[i], nodes_[node])
                # each node stands for the rows that share its vector
                many = counts[node]
                row = np.repeat(first_of[node], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                i, score, names = np.repeat(i, many), np.repeat(score, many), held[row]
                order = np.lexsort((names[:, 1], names[:, 0], -score, i))
                i, score, names = i[order], score[order], names[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                keep = rank <= k
                yield pa.RecordBatch.from_arrays([pa.array(q_uids[i[keep]]), pa.array(names[keep, 0]), pa.array(names[keep, 1]), pa.array(score[keep])], names=["q_uid", "vec_id", "m_uid", "score"])

    by = ["shard", "copy"]
    met = sides.union(come).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by, "block")
    found = met.mapInArrow(search, "q_uid bigint, vec_id bigint, m_uid bigint, score double")
    best = F.row_number().over(W.partitionBy("q_uid").orderBy(F.desc("score"), "vec_id", "m_uid"))
    found = scratch.write(found.withColumn("best", best).where(F.col("best") <= k + 1).drop("best"), "found")
    asking = member.where("label = 1").select("uid", F.col("vec_id").alias("query_id"), "rep")
    pairs = asking.join(found, F.col("rep") == F.col("q_uid")).where("uid <> m_uid")
    rank = F.row_number().over(W.partitionBy("uid").orderBy(F.desc("score"), "vec_id", "m_uid"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
