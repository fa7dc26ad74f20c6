"""Nearest neighbours by a block matrix join: int8 tiles bound every inner product, survivors are computed in double.

A vector is a scale times int8 values, plus a rest that is a second scale times int8 values, plus what both lose, whose
norm is known; a quarter of the vector's bytes. Queries are dealt to tiles of a bounded number of bytes, candidates are
packed in tiles where they lie, and every query tile meets every candidate tile once (the query set is stated, so this
is the job itself): a task takes one query tile and streams a share of the candidate tiles past it. A tile multiplies the
first int8 forms and bounds each inner product by the quantisation errors of both vectors; pairs whose upper bound
reaches the k-th best lower bound met so far are bounded again with the second forms. What survives a task goes, with
its bounds, to its query, where a bound over all tasks is set; only then are pairs computed in double from the original
vectors, and a heap of k per query merges them.

Of equal vectors only the k + 1 with the smallest ids can be among a query's k nearest, as ties go to the smaller id, so
no more are candidates, however often a vector is repeated. The result is exact: recall against brute force is 1.

Defined cases: vectors that are null, empty, zero or hold null or non-finite parts take no part, nor do null ids; of
rows with one id the greatest vector counts; vectors of different lengths are not compared; ties go to the smaller id;
with fewer than k candidates all are returned; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rimlight.llm.common import stage

BLOCK_BYTES = 64 << 20  # of packed queries that a task holds, and at most of a candidate tile
TILE = 4096  # most candidates of a tile
STREAM_BYTES = 2 << 30  # of packed candidates that pass by in one task
STRIPE = 256
DIMS = 1024  # whose int8 products a float32 sum holds exactly: 127 ** 2 * 1024 < 2 ** 24


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, v) of the vectors that take part, one row per id."""
    v = F.col(embedding).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.groupBy("id").agg(F.max("v").alias("v"))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values as float32, scale, norm of what rounding lost) of each row of x."""
    scale = np.abs(x).max(1) / 127
    scale[scale < 1e-300] = 1
    q = np.clip(np.rint(x / scale[:, None]), -127, 127)
    return q.astype(np.float32), scale, np.linalg.norm(x - q * scale[:, None], axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of int8 values, for any number of dimensions."""
    out = np.zeros((len(a), len(b)))
    for lo in range(0, a.shape[1], DIMS):
        out += a[:, lo : lo + DIMS].astype(np.float32) @ b[:, lo : lo + DIMS].astype(np.float32).T
    return out


class Tile:
    """Packed vectors: ids, two int8 forms with their scales and errors, norms."""

    def __init__(self, ids: np.ndarray, forms: np.ndarray, numbers: np.ndarray) -> None:
        self.ids, (self.a, self.b) = ids, forms
        self.scale_a, self.lost_a, self.scale_b, self.lost_b, self.norm = numbers

    @classmethod
    def pack(cls, ids: np.ndarray, x: np.ndarray) -> Tile:
        a, scale_a, lost_a = quantise(x)
        rest = x - a * scale_a[:, None]
        b, scale_b, _ = quantise(rest)
        lost_b = np.linalg.norm(rest - b * scale_b[:, None], axis=1)
        norm = np.linalg.norm(x, axis=1)
        round_off = 1e-15 * norm * x.shape[1]  # of the sums above in double
        return cls(ids, np.stack([a, b]).astype(np.int8), np.stack([scale_a, lost_a + round_off, scale_b, lost_b + round_off, norm * (1 + 1e-12)]))

    def bytes(self) -> tuple[bytes, bytes, bytes]:
        return self.ids.astype("<i8").tobytes(), np.stack([self.a, self.b]).tobytes(), np.stack([self.scale_a, self.lost_a, self.scale_b, self.lost_b, self.norm]).astype("<f8").tobytes()

    @classmethod
    def of(cls, dim: int, ids: bytes, forms: bytes, numbers: bytes) -> Tile:
        n = len(ids) // 8
        return cls(np.frombuffer(ids, "<i8"), np.frombuffer(forms, np.int8).reshape(2, n, dim), np.frombuffer(numbers, "<f8").reshape(5, n))

    def fine(self, at: np.ndarray) -> np.ndarray:
        """The vectors at these places, as both forms tell them."""
        return self.a[at] * self.scale_a[at, None] + self.b[at] * self.scale_b[at, None]


def _kth(query: np.ndarray, low: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th largest low of each of n queries; -inf with fewer."""
    order = np.lexsort((-low, query))
    first = np.searchsorted(query[order], np.arange(n))
    at = first + k - 1
    out = np.full(n, -np.inf)
    enough = np.flatnonzero(at < len(order))
    enough = enough[query[order[at[enough]]] == enough]
    out[enough] = low[order[at[enough]]]
    return out


class Nearest:
    """The pairs of one query tile that may be among the k nearest of what has passed by, with bounds of their products."""

    def __init__(self, queries: Tile, k: int) -> None:
        self.queries, self.k = queries, k
        self.bar = np.full(len(queries.ids), -np.inf)
        self.pairs = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]  # query, id, low, high

    def meet(self, c: Tile) -> None:
        q, k = self.queries, self.k
        for lo in range(0, len(q.ids), STRIPE):
            s = slice(lo, lo + STRIPE)
            near = products(q.a[s], c.a) * q.scale_a[s, None] * c.scale_a
            slack = q.norm[s, None] * c.lost_a + q.lost_a[s, None] * (c.norm + c.lost_a)
            own = q.ids[s, None] == c.ids
            bar = self.bar[s]
            if np.isinf(bar).any() and near.shape[1] > k:
                bar = np.maximum(bar, np.partition(np.where(own, -np.inf, near - slack), -k, 1)[:, -k])
            at, to = np.nonzero((near + slack >= bar[:, None]) & ~own)
            at += lo
            low, high = np.empty(len(at)), np.empty(len(at))
            for i in range(0, len(at), 1 << 14):  # bound again, more closely
                x, y = at[i : i + (1 << 14)], to[i : i + (1 << 14)]
                fine = np.einsum("ij,ij->i", q.fine(x), c.fine(y))
                wide = q.norm[x] * c.lost_b[y] + q.lost_b[x] * (c.norm[y] + c.lost_b[y]) + 1e-15 * q.a.shape[1] * q.norm[x] * c.norm[y]
                low[i : i + (1 << 14)], high[i : i + (1 << 14)] = fine - wide, fine + wide
            held = high >= bar[at - lo]
            self.pairs = [np.concatenate(p) for p in zip(self.pairs, (at[held], c.ids[to[held]], low[held], high[held]), strict=True)]
        self.bar = np.maximum(self.bar, _kth(self.pairs[0], self.pairs[2], len(q.ids), k))
        held = self.pairs[3] >= self.bar[self.pairs[0]]
        self.pairs = [p[held] for p in self.pairs]

    def batch(self) -> pa.RecordBatch:
        query, vec, low, high = self.pairs
        return pa.record_batch([pa.array(self.queries.ids[query]), pa.array(vec), pa.array(low), pa.array(high)], ["query_id", "vec_id", "low", "high"])


PACKED = "dim int, ids binary, forms binary, numbers binary"


def packed(rows: DataFrame, block_bytes: int) -> DataFrame:
    """Tiles of (dim, id, v) rows, made where the rows lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def tile(dim: int) -> pa.RecordBatch:
            rows = held.pop(dim)
            t = Tile.pack(np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]))
            return pa.record_batch([pa.array([dim], pa.int32()), *(pa.array([x], pa.binary()) for x in t.bytes())], ["dim", "ids", "forms", "numbers"])

        for b in batches:
            dims, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = b.column(2).take(pa.array(at)).flatten().to_numpy().reshape(-1, dim)
                most = max(1, min(TILE, block_bytes // (2 * dim + 48)))
                for i in range(0, len(at), most):
                    held.setdefault(dim, []).append((ids[at[i : i + most]], x[i : i + most]))
                    if sum(len(j) for j, _ in held[dim]) >= most:
                        yield tile(dim)
        for dim in list(held):
            yield tile(dim)

    return rows.select("dim", "id", "v").mapInArrow(run, PACKED)


def search(vectors: DataFrame, is_query: Column, k: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of every row of (vec_id, embedding) where is_query holds."""
    rows = stage(usable(vectors).withColumn("dim", F.size("v")), "vectors")
    asked = rows.where(is_query)
    weigh = F.coalesce(F.sum(F.col("dim").cast("long") * 2 + 48), F.lit(0))
    all_bytes, asked_bytes = (int(x.agg(weigh).first()[0]) for x in (rows, asked))
    parallel = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, asked_bytes // block_bytes + 1)
    streams = max(1, all_bytes // STREAM_BYTES + 1, -(-2 * parallel // blocks))
    same = Window.partitionBy("digest", "v").orderBy("id")
    unlike = rows.withColumn("digest", F.xxhash64("v")).withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)

    def tile_of(key: tuple, table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        order = np.argsort(ids := table.column("id").to_numpy())
        x = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        return pa.table([pa.array([dim], pa.int32()), pa.array([key[1].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in Tile.pack(ids[order], x[order]).bytes())], ["dim", "h", "ids", "forms", "numbers"])

    queries = stage(asked.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).groupBy("dim", "h").applyInArrow(tile_of, PACKED.replace("int, ids", "int, h int, ids")), "queries")
    tiles = packed(unlike, block_bytes).withColumns({"s": F.pmod(F.xxhash64("ids"), F.lit(streams)).cast("int"), "h": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    both = queries.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(streams - 1)))).withColumn("role", F.lit(0)).unionByName(tiles.withColumn("role", F.lit(1)))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, near = None, None
        for b in batches:
            for i in range(b.num_rows):
                dim, h, s, role, *data = (c[i].as_py() for c in b.columns)
                if (dim, h, s) != now:
                    if near is not None:
                        yield near.batch()
                    now, near = (dim, h, s), None
                if role == 0:
                    near = Nearest(Tile.of(dim, *data), k)
                elif near is not None:
                    near.meet(Tile.of(dim, *data))
        if near is not None:
            yield near.batch()

    keys = ("dim", "h", "s")
    dealt = both.repartition(max(1, blocks * streams), *keys).sortWithinPartitions(*keys, "role").select(*keys, "role", "ids", "forms", "numbers")
    found = dealt.mapInArrow(multiply, "query_id long, vec_id long, low double, high double")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, bar = None, 0, -np.inf
        for b in batches:  # by query, the largest lower bounds first: the k-th is the bar
            kept = []
            for i, (query, low, high) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if query != now:
                    now, n, bar = query, 0, -np.inf
                n += 1
                bar = low if n == k else bar
                if n <= k or high >= bar:
                    kept.append(i)
            yield b.take(pa.array(kept, pa.int64())).select(["query_id", "vec_id"])

    left = found.repartition("query_id").sortWithinPartitions("query_id", F.desc("low")).mapInArrow(cut, "query_id long, vec_id long")
    pairs = left.join(rows.select(F.col("id").alias("vec_id"), "v"), "vec_id").select("query_id", F.lit(1).alias("role"), "vec_id", "v")
    pairs = asked.select(F.col("id").alias("query_id"), F.lit(0).alias("role"), F.col("id").alias("vec_id"), "v").unionByName(pairs)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, q, heap = None, None, []

        def best() -> pa.RecordBatch:
            ranked = sorted(heap, reverse=True)
            n = len(ranked)
            return pa.record_batch([pa.array([now] * n, pa.int64()), pa.array(range(1, n + 1), pa.int32()), pa.array([-v for _, v in ranked], pa.int64()), pa.array([s for s, _ in ranked], pa.float64())], ["query_id", "rank", "vec_id", "score"])

        for b in batches:
            data, at = b.column(3).flatten().to_numpy(), np.concatenate([[0], np.cumsum(b.column(3).value_lengths().to_numpy())])
            for i, (query, role, vec) in enumerate(zip(*(c.to_pylist() for c in b.columns[:3]), strict=True)):
                if query != now:
                    if heap:
                        yield best()
                    now, heap = query, []
                if role == 0:
                    q = data[at[i] : at[i + 1]].copy()
                else:
                    score = float((q * data[at[i] : at[i + 1]]).cumsum()[-1])  # summed in order, so that equal vectors tie
                    (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (score, -vec))
        if heap:
            yield best()

    return pairs.repartition("query_id").sortWithinPartitions("query_id", "role").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


ORACLE = """
with e as (
  select vec_id, max(embedding::double[]) as v from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x != 0)) > 0 group by vec_id),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v) as score
  from e q join e c on len(q.v) = len(c.v) and q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
select query_id, (row_number() over w)::int as rank, vec_id, score from s
window w as (partition by query_id order by score desc, vec_id) qualify rank <= 20
"""
