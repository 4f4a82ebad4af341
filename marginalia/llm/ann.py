"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample: every node splits its points at the median of a random
direction.  All vectors are indexed: each is sent to its leaf in every tree.  A query searches all trees
through one priority queue of branches, nearest margin first.  A branch's margin is a lower bound of the
distance to all that lies in it, so the search ends at a distance, not at a count: branches farther than
``REACH`` times the distance of the k-th neighbour known from the first leaves are left out.  Vectors with
structure are found in few leaves, those without in many, at any number of rows; ``reach=1`` is the exact
search.  The leaves' vectors are reranked by exact distance in blocks.  Equal vectors are collapsed
first, each to its smallest ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.sample import bounded
from marginalia.llm.store import cut

NEAREST, EVERY = 10, 100
#: Vectors the trees are fitted on at most, trees, fitted vectors in a leaf.
FIT_ROWS, TREES, LEAF = 65_536, 4, 32
#: Share of the k-th known distance beyond which branches are not searched.
REACH = 0.115
#: Leaves that are neighbours in a tree share a part, which is shuffled as one; vectors of a part that a
#: task holds at a time; queries that meet one copy of a part.
PART_LEAVES, BLOCK, ASKS = 64, 50_000, 100_000


@dataclass
class Forest:
    depth: int
    normal: np.ndarray  # (trees, nodes, dim)
    cut_at: np.ndarray  # (trees, nodes)

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree."""
        out = np.zeros((len(x), len(self.normal)), np.int32)
        for t in range(len(self.normal)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                right = np.einsum("nd,nd->n", x, self.normal[t][node]) >= self.cut_at[t][node]
                node = 2 * node + 1 + right
            out[:, t] = node - (self.leaves - 1)
        return out

    def search(self, q: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(margin, tree, leaf) in the order of the shared queue: margins rise."""
        margin = np.einsum("tnd,d->tn", self.normal, q) - self.cut_at
        inner = self.leaves - 1
        queue = [(0.0, t, 0) for t in range(len(self.normal))]
        while queue:
            far, t, node = heapq.heappop(queue)
            while node < inner:
                m = float(margin[t, node])
                near = 2 * node + 1 + (m >= 0)
                heapq.heappush(queue, (max(far, abs(m)), t, 4 * node + 3 - near))
                node = near
            yield far, t, node - inner


@dataclass
class Index:
    """A forest and the vectors it was fitted on, by leaf of each tree."""

    forest: Forest
    sample: np.ndarray
    seats: list[np.ndarray]  # by tree: rows of the sample in order of their leaf
    ends: np.ndarray  # (trees, leaves + 1): where a leaf's rows begin

    @classmethod
    def of(cls, sample: np.ndarray, forest: Forest) -> Index:
        leaf = forest.place(sample.astype(np.float32))
        seats = [np.argsort(leaf[:, t], kind="stable") for t in range(leaf.shape[1])]
        ends = np.stack([np.searchsorted(leaf[s, t], np.arange(forest.leaves + 1)) for t, s in enumerate(seats)])
        return cls(forest, sample, seats, ends)

    def visits(self, q: np.ndarray, k: int, reach: float) -> tuple[float, list[tuple[int, int]]]:
        """A bound of the distance of the k-th neighbour, and the (tree, leaf) to search.

        The first leaves, one a tree at least, give fitted vectors; the k-th nearest of those bounds
        what is to be found."""
        found: list[tuple[int, int]] = []
        known: set[int] = set()
        bound = float("inf")
        for far, t, leaf in self.forest.search(q.astype(np.float32)):
            if len(found) >= len(self.seats) and bound == float("inf") and len(known) >= k:
                bound = float(np.sort(distances(q, self.sample[sorted(known)].astype(np.float64)))[k - 1])
            if far > reach * bound:
                break
            found.append((t, leaf))
            if bound == float("inf"):
                known.update(self.seats[t][self.ends[t, leaf] : self.ends[t, leaf + 1]].tolist())
        return bound, found


def fit(sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 3) -> Forest:
    rng = np.random.default_rng(seed)
    n, dim = sample.shape
    depth = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
    inner = (1 << depth) - 1
    normal = rng.normal(size=(trees, inner, dim))
    normal /= np.maximum(np.linalg.norm(normal, axis=2, keepdims=True), 1e-12)
    normal = normal.astype(np.float32)
    cut_at = np.zeros((trees, inner), np.float32)
    for t in range(trees):
        node = np.zeros(n, np.int64)
        for level in range(depth):
            along = np.einsum("nd,nd->n", sample, normal[t][node]).astype(np.float32)
            order = np.lexsort((along, node))
            first = np.searchsorted(node[order], np.arange((1 << level) - 1, (2 << level) - 1))
            last = np.append(first[1:], n)
            mid = np.minimum((first + last) // 2, n - 1)
            full = last > first
            cut_at[t, (1 << level) - 1 : (2 << level) - 1][full] = along[order][mid[full]]
            node = 2 * node + 1 + (along >= cut_at[t][node])
    return Forest(depth, normal, cut_at)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): no null id or vector, no null or non-finite component, not all zero."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(~bad & F.exists(v, lambda c: c != 0))


def _packed(rows: DataFrame) -> tuple[DataFrame, str]:
    """The vectors of the most frequent length as bytes (vec_id, v binary), and their numpy type."""
    kind = "<f4" if isinstance(rows.schema["v"].dataType.elementType, T.FloatType) else "<f8"
    rows = rows.withColumn("v", F.col("v").cast("array<float>" if kind == "<f4" else "array<double>"))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is not None:
        rows = rows.where(F.size("v") == length["n"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.ascontiguousarray(batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(kind))
            each = len(flat) // max(1, batch.num_rows) * int(kind[-1])
            ends = (np.arange(batch.num_rows + 1) * each).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), data], names=["vec_id", "v"])

    return rows.mapInArrow(pack, "vec_id long, v binary"), kind


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), -1)


_MET = "tree int, part int, block int, ask int, is_query boolean, gid long, v binary, leaf long, bound double"


def _met(tree, part, block, ask, is_query, gid, v, leaf, bound) -> pa.RecordBatch:
    n = len(gid)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.broadcast_to(c, n).astype(np.int32)) for c in (tree, part, block, ask)]
        + [pa.array(np.full(n, is_query)), gid, v, pa.array(np.broadcast_to(leaf, n).astype(np.int64)), pa.array(np.broadcast_to(bound, n).astype(np.float64))],
        names=["tree", "part", "block", "ask", "is_query", "gid", "v", "leaf", "bound"],
    )


def _counted(known, kind: str):
    """How many vectors of a batch are in each part of each tree."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part = known.value.forest.place(_matrix(batch.column("v"), kind).astype(np.float32)) // PART_LEAVES
            for t in range(part.shape[1]):
                which, n = np.unique(part[:, t], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), t, np.int32)), pa.array(which.astype(np.int32)), pa.array(n.astype(np.int64))], names=["tree", "part", "n"])

    return count


def _seated(known, blocks, kind: str, asks: int):
    """Every vector in its leaf of every tree; parts of many vectors are dealt to blocks."""

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf = known.value.forest.place(_matrix(batch.column("v"), kind).astype(np.float32))
            gid = batch.column("gid").to_numpy()
            spread = ((gid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            for t in range(leaf.shape[1]):
                part = leaf[:, t] // PART_LEAVES
                for ask in range(asks):
                    yield _met(t, part, spread % blocks[t, part], ask, False, batch.column("gid"), batch.column("v"), leaf[:, t] % PART_LEAVES, 0.0)

    return seat


def _asked(known, blocks, kind: str, k: int, reach: float, asks: int):
    """Every query in every part that holds a leaf it visits, with those leaves as bits."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, q in enumerate(_matrix(batch.column("v"), kind).astype(np.float64)):
                bound, found = known.value.visits(q, k, reach)
                bits: dict[tuple[int, int], int] = {}
                for t, leaf in found:
                    at = (t, leaf // PART_LEAVES)
                    bits[at] = bits.get(at, 0) | 1 << leaf % PART_LEAVES
                rows = [(t, p, b, mask) for (t, p), mask in bits.items() for b in range(blocks[t, p])]
                if rows:
                    tree, part, block, mask = (np.array(c, np.uint64) for c in zip(*rows, strict=True))
                    same = pa.array(np.zeros(len(rows), np.int32))
                    gid = batch.column("gid").slice(i, 1)
                    yield _met(tree, part, block, hash(gid[0].as_py()) % asks, True, gid.take(same), batch.column("v").slice(i, 1).take(same), mask.view(np.int64), bound)

    return ask


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, added up component by component."""
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def _rerank(kind: str, keep: int):
    """Rows come ordered by group, vectors before queries.  The vectors of the group are held (BLOCK at
    about), queries pass by; each leaves its nearest ``keep`` within its bound."""

    def near(q, ids, bound, mask, x, own, leaf, square) -> pa.RecordBatch:
        out_q, out_g, out_d = [], [], []
        step = max(1, 4_000_000 // max(1, len(x)))
        for a in range(0, len(q), step):
            part = q[a : a + step]
            apart = (part**2).sum(axis=1)[:, None] + square[None, :] - 2 * part @ x.T
            slack = 1e-9 * (square.max() + (part**2).sum(axis=1)) + 1e-12
            open_ = (mask[a : a + step, None] >> leaf[None, :]) & np.uint64(1) == 1
            # NumPy compares inf bounds as well: everything in the leaves is near then
            row, at = np.nonzero(open_ & (apart <= (bound[a : a + step] ** 2 * (1 + 1e-9) + slack)[:, None]))
            if not len(row):
                continue
            exact = distances(part[row], x[at])
            fits = exact <= bound[a : a + step][row]
            row, at, exact = row[fits], at[fits], exact[fits]
            order = np.lexsort((own[at], exact, row))
            row, at, exact = row[order], at[order], exact[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            best = place < keep
            out_q.append(ids[a : a + step][row[best]])
            out_g.append(own[at[best]])
            out_d.append(exact[best])
        cols = [np.concatenate(c) if c else np.zeros(0, t) for c, t in ((out_q, np.int64), (out_g, np.int64), (out_d, np.float64))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["q", "gid", "score"])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("tree", "part", "block", "ask")], axis=1)
            is_query = batch.column("is_query").to_numpy(zero_copy_only=False)
            change = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1) | (is_query[1:] != is_query[:-1])]))
            for a, b in zip(change, np.append(change[1:], batch.num_rows), strict=True):
                here, rows = tuple(keys[a]), batch.slice(a, b - a)
                if here != group:
                    group, held, ready = here, [], None
                gid, v = rows.column("gid").to_numpy(), _matrix(rows.column("v"), kind).astype(np.float64)
                leaf = rows.column("leaf").to_numpy().astype(np.uint64)
                if not is_query[a]:
                    held.append((gid, v, leaf))
                elif held:
                    if ready is None:
                        own, x, seat = (np.concatenate(c) for c in zip(*held, strict=True))
                        held = [(own, x, seat)]
                        ready = (x, own, seat, (x**2).sum(axis=1))
                    yield near(v, gid, rows.column("bound").to_numpy(), leaf, *ready)

    return rerank


def nearest(vectors: DataFrame, k: int = NEAREST, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding", fit_rows: int = FIT_ROWS, reach: float = REACH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id is divisible by ``every``.

    Nearest first, ties to the smaller id, never the query's own row.  Rows that ``usable`` drops take no
    part, nor do vectors of another length than the most frequent one (of equally frequent ones the
    shorter).  A repeated id counts once, with the vector least in bytes.  Where the first leaves hold
    fewer than k others the search goes on through the queue until there are enough, so fewer than k come
    back only if there are fewer candidates.  An empty table gives no rows; other columns are not read.
    ``reach=1`` finds the true nearest of every query.
    """
    spark = vectors.sparkSession
    rows, kind = _packed(usable(vectors, id_col, vector_col))
    one = rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("sign", F.sha2("v", 256))
    # Equal vectors: only the k + 1 smallest ids can be among anyone's k nearest, so the rest go before
    # the shuffle (a rank limit per group), and one row stands for the group.
    one = cut(one)
    few = one.withColumn("n", F.row_number().over(Window.partitionBy("sign").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    group = cut(few.groupBy("sign").agg(F.min("vec_id").alias("gid"), F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v")))
    asked = cut(one.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "sign").join(group.select("sign", "gid"), "sign").select("query_id", "gid"))

    sample = [bytes(r["v"]) for r in bounded(group.select("gid", "v"), fit_rows).orderBy("gid").select("v").toLocalIterator()]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted = np.stack([np.frombuffer(v, kind) for v in sample])
    known = spark.sparkContext.broadcast(Index.of(fitted, fit(fitted.astype(np.float32))))  # bounded by fit_rows
    parts = -(-known.value.forest.leaves // PART_LEAVES)
    blocks = np.ones((len(known.value.seats), parts), np.int64)
    points = group.select("gid", "v")
    for r in points.mapInArrow(_counted(known, kind), "tree int, part int, n long").groupBy("tree", "part").agg(F.sum("n").alias("n")).collect():  # trees * parts rows
        blocks[r["tree"], r["part"]] = -(-r["n"] // BLOCK)
    targets = asked.select("gid").distinct().join(points, "gid")
    asks = max(1, -(-asked.count() // ASKS))

    seats = points.mapInArrow(_seated(known, blocks, kind, asks), _MET)
    queries = targets.mapInArrow(_asked(known, blocks, kind, k + 1, reach, asks), _MET)
    by = ["tree", "part", "block", "ask"]
    met = seats.unionByName(queries).repartition(*by).sortWithinPartitions(*by, "is_query")
    found = met.mapInArrow(_rerank(kind, k + 1), "q long, gid long, score double").groupBy("q", "gid").agg(F.min("score").alias("score"))
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("score", "gid"))).where(F.col("n") <= k + 1)

    # k + 1 groups hold the k nearest rows; each gives its smallest ids, the query's own row left out
    spread = best.join(group.select("gid", "ids"), "gid").select("q", "score", F.explode("ids").alias("vec_id"))
    pairs = asked.join(spread, asked["gid"] == spread["q"]).where("query_id <> vec_id")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
