"""N-gram Jaccard join by prefix trees: which documents share 75% of their distinct 5-word shingles.

1. One pass hashes every whole text's shingles; equal sets become one class, which is all that copies cost.
2. A second pass deals (shingle, class) pairs, packed in blobs by shingle, for the half of all shingles with the
   smaller hashes; classes sharing a shingle learn in how many classes it occurs. A shingle that one worker meets in
   many classes is hot: only its name goes to the others, the pairs are dealt anywhere, so that no task gets a whole
   common line. Global order: that half from rare to common, then the hot ones, then the others by hash. Two similar
   sets share a shingle within their first n - ceil(0.75 n) + 1. Shingles of one class come first and match nothing,
   so most classes are done here, and a passage that many documents share lies behind their own shingles.
3. Classes that share such a prefix shingle are a group; groups with equal members count once. The group's first
   class, its leader, is compared with the others, and links are closed to components.
4. Groups whose other members still lie in several components are compared within, in blocks that grow with the root
   of the group, after groups that overlap are joined where that compares no more; this is the exact way for all that
   leaders don't settle.

Comparisons (3, 4) put the sets, in order, in a radix trie: sets share the overlap of their common beginnings, and a
subtree is cut off once the overlap so far plus what can remain is too small for its smallest set. Within groups (4)
some hundred sets go down the trie together, and a level's overlaps are counted by matrix products. Sets for them come
from a third pass over the texts, past a filter of fixed size that holds the classes in groups.

Shingles and classes are 64-bit hashes, comparisons are of whole sets. Defined cases: null or empty texts and those
without a word have an empty set and link with nothing; a text of 1 to 4 words is one shingle; a null id has a row of
its own, whose component is the smallest other id of its class or component, if any; rows that repeat link with each
other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rimlight.llm.common import LOWER, mix, pieces, small, stage, tidied, utf8, word_hashes, words
from rimlight.llm.components import components

N, PERCENT = 5, 75
HALF = np.uint64(1 << 63)
CHUNK = 1 << 19  # shingles of a blob's chunk
BLOCK, MOST_BLOCK = 256, 2048  # sets compared in one tree: 16 times the root of the group's number within these bounds
HOT, HOT_RANK = 512, 2**31 - 1  # classes of one chunk from which on a shingle is hot; its place in the order
ASKING, COLUMNS, RARE = 256, 2048, 200  # sets that ask a trie at once; tokens of a matrix; a pair by pair count costs so many of a product's
PAIRS = 1 << 20  # of a bucket; a worker holds some 100 bytes of each at once
FILTER_BITS, FILTER_TASKS = 25, 32
SALTS = 32
_FACTORS = np.random.default_rng(5).integers(1, 1 << 63, N, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document data[at[i]:at[i+1]]."""
    data = LOWER[data]
    start, end, first = words(data, at)
    w = word_hashes(data, start, end)
    h = np.zeros(0, np.uint64)
    if len(w) >= N:
        h = w[: len(w) - N + 1] * _FACTORS[0]
        for k in range(1, N):
            h += w[k : len(w) - N + 1 + k] * _FACTORS[k]
        h = mix(h)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= N:
            yield np.unique(h[a : b - N + 1])
        elif b > a:
            yield mix((w[a:b] * _FACTORS[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def class_of(s: np.ndarray) -> int:
    """A hash of a whole set, as a signed number."""
    return int(mix(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(keepdims=True) + np.uint64(len(s))).view(np.int64)[0])


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    data, at = utf8(texts)
    for i, j in pieces(at):
        yield from shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i])


def prefix_length(n: int) -> int:
    """How many of n shingles, in any global order, must hold one of every similar set."""
    return n - math.ceil(PERCENT * n / 100) + 1


def _texts(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def classes(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id, n and cls (null for an empty set) of each row of docs; with key, the row's digest, if keyed."""
    key = [_row_key(docs).alias("key")] if keyed else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(len(s), class_of(s) if len(s) else None) for s in _sets(b.column(1))]
            yield pa.record_batch([b.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([c for _, c in found], pa.int64()), *b.columns[2:]], ["doc_id", "n", "cls", "key"][: b.num_columns + 1])

    return _texts(docs, *key).mapInArrow(tidied(run), "doc_id long, n long, cls long" + ", key string" * keyed)


def _row_key(docs: DataFrame) -> Column:
    """A digest of a row's id and text."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return F.md5(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))


# A blob: uint32 counts of classes, shingles and hot shingles; classes int64, n int32, dealt int32; then, of the shingles
# in order, the steps between their upper 48 bits as three planes of uint16, and the places of their classes as uint16;
# then the hot shingles as uint64.
def _blob(order: np.ndarray, place: np.ndarray, cls: np.ndarray, n: np.ndarray, dealt: np.ndarray, hot: np.ndarray) -> bytes:
    used, place = np.unique(place, return_inverse=True)
    step = np.diff(order, prepend=np.uint64(0))
    planes = [(step >> np.uint64(k) & np.uint64(0xFFFF)).astype("<u2") for k in (0, 16, 32)]
    return b"".join([np.array([len(used), len(order), len(hot)], "<u4").tobytes(), cls[used].astype("<i8").tobytes(), n[used].astype("<i4").tobytes(), dealt[used].astype("<i4").tobytes(), *(p.tobytes() for p in planes), place.astype("<u2").tobytes(), hot.astype("<u8").tobytes()])


def _unblob(data: memoryview) -> tuple[np.ndarray, ...]:
    k, m, h = (int(x) for x in np.frombuffer(data, "<u4", 3))
    at = 12
    cls = np.frombuffer(data, "<i8", k, at)
    n, dealt = np.frombuffer(data, "<i4", k, at + 8 * k), np.frombuffer(data, "<i4", k, at + 12 * k)
    at += 16 * k
    planes = [np.frombuffer(data, "<u2", m, at + 2 * m * i).astype(np.uint64) for i in range(3)]
    place = np.frombuffer(data, "<u2", m, at + 6 * m)
    order = np.cumsum(planes[0] | planes[1] << np.uint64(16) | planes[2] << np.uint64(32), dtype=np.uint64)
    return order, cls[place], n[place], dealt[place], np.frombuffer(data, "<u8", h, at + 8 * m)


def dealt_out(docs: DataFrame, buckets: int, hot: int = HOT) -> DataFrame:
    """(bucket, direct, data): blobs of the shingles that each class deals out: the lower half, and more where that is less than its prefix.

    Direct ones hold shingles with at least `hot` classes in their chunk and go to any bucket; the bucket of such a
    shingle gets its name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, int]] = {}
        size, chunk = 0, TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            cls = np.array(list(kept), np.int64)
            n, dealt = np.array([k for _, k in kept.values()]), np.array([len(s) for s, _ in kept.values()])
            order = np.concatenate([s for s, _ in kept.values()]) >> np.uint64(16)
            place = np.repeat(np.arange(len(cls)), dealt)
            by = np.argsort(order, kind="stable")
            order, place = order[by], place[by]
            starts = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
            counts = np.diff(np.append(starts, len(order)))
            common = counts >= hot
            named, many = order[starts[common]], np.repeat(common, counts)
            rows = [(chunk % buckets, True, _blob(order[many], place[many], cls, n, dealt, named[:0]))] if many.any() else []
            order, place = order[~many], place[~many]
            bucket, named_bucket = ((x >> np.uint64(15) & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32) for x in (order, named))
            by = np.argsort(bucket, kind="stable")
            order, place, bucket = order[by], place[by], bucket[by].astype(np.int64)
            spots = np.unique(np.concatenate([bucket, named_bucket.astype(np.int64)]))
            for x, i, j in zip(spots.tolist(), np.searchsorted(bucket, spots).tolist(), np.searchsorted(bucket, spots, "right").tolist(), strict=True):
                rows.append((x, False, _blob(order[i:j], place[i:j], cls, n, dealt, named[named_bucket == x])))
            kept.clear()
            return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.bool_(), pa.binary()))], ["bucket", "direct", "data"])

        for b in batches:
            for s in _sets(b.column(1)):
                if not len(s) or (c := class_of(s)) in kept:
                    continue
                some = s[: max(int(np.searchsorted(s, HALF)), prefix_length(len(s)))]
                kept[c] = some.copy(), len(s)
                size += len(some)
                if size >= CHUNK or len(kept) >= 60_000:
                    yield flush()
                    size, chunk = 0, chunk + 7919
        if kept:
            yield flush()

    return _texts(docs).mapInArrow(tidied(run), "bucket int, direct boolean, data binary")


def shared(blobs: DataFrame, buckets: int) -> DataFrame:
    """(cls, n, dealt, token, df): the dealt shingles that several classes have, and how many have each (HOT_RANK: hot ones).

    A pair can come more than once where copies of a class lie in several chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(token: np.ndarray, cls: np.ndarray, n: np.ndarray, dealt: np.ndarray, df: np.ndarray) -> Iterator[pa.RecordBatch]:
            cols = [cls, n.astype(np.int32), dealt.astype(np.int32), token.astype(np.int64), df.astype(np.int32)]
            for i in range(0, len(cls), 1 << 16):
                yield pa.record_batch([pa.array(c[i : i + (1 << 16)]) for c in cols], ["cls", "n", "dealt", "token", "df"])

        parts = []
        for b in batches:
            for direct, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = _unblob(memoryview(x.as_buffer()))
                if direct:
                    yield from rows(*found[:4], np.full(len(found[0]), HOT_RANK))
                else:
                    parts.append(found)
        if not parts:
            return
        token, cls, n, dealt, hot = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        by = np.lexsort((cls, token))
        token, cls, n, dealt = token[by], cls[by], n[by], dealt[by]
        once = np.ones(len(token), bool)
        once[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
        token, cls, n, dealt = token[once], cls[once], n[once], dealt[once]
        cuts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])[: len(token)])
        counts = np.diff(np.append(cuts, len(token)))
        df = np.repeat(np.where(np.isin(token[cuts], hot), HOT_RANK, counts), counts)
        many = df > 1
        yield from rows(token[many], cls[many], n[many], dealt[many], df[many])

    return blobs.repartition(buckets, "bucket").select("direct", "data").mapInArrow(tidied(run), "cls long, n int, dealt int, token long, df int")


def prefixes(rows: DataFrame) -> DataFrame:
    """(cls, n, token): the shared shingles within each class's prefix; shingles of no other class fill it first."""
    own = Window.partitionBy("cls")
    order = own.orderBy(F.col("token") >= F.lit(1 << 47), F.when(F.col("token") < F.lit(1 << 47), F.col("df")), "token")
    rows = rows.withColumn("rank", F.dense_rank().over(order)).withColumn("count", F.max("rank").over(own))
    length = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    return rows.where(F.col("rank") <= length - (F.col("dealt") - F.col("count"))).select("cls", "n", "token").distinct()


def _blocks(members: Column) -> Column:
    """How many blocks a group of so many sets is compared in."""
    size = F.least(F.greatest(F.lit(float(BLOCK)), 16 * F.sqrt(members)), F.greatest(F.lit(float(BLOCK)), F.lit(float(MOST_BLOCK))))
    return (F.floor(members / size) + 1).cast("int")


class Trie:
    """A radix trie of sorted sets; `near` finds those similar to a set.

    sets: (id, set) or (id, set, component). A subtree of one component can be passed over as a whole.
    """

    def __init__(self, sets: list[tuple]) -> None:
        sets = sorted(sets, key=lambda x: x[1].astype(">u8").tobytes())
        arrays, sizes, comps = [x[1] for x in sets], [len(x[1]) for x in sets], [x[2] if len(x) > 2 else i for i, x in enumerate(sets)]
        # node: (piece of the sets, length up to its end, smallest and largest set below, their component if there is one, ids that end here, children)
        self.root = (np.zeros(0, np.uint64), 0, min(sizes, default=0), max(sizes, default=0), None, [], [])
        todo = [(self.root, 0, len(sets), 0)]
        while todo:
            (*_, ends, children), lo, hi, depth = todo.pop()
            while lo < hi:
                if sizes[lo] == depth:
                    ends.append((sets[lo][0], depth))
                    lo += 1
                    continue
                head, j = arrays[lo][depth], lo + 1
                while j < hi and arrays[j][depth] == head:
                    j += 1
                a, b = arrays[lo][depth:], arrays[j - 1][depth:]
                k = min(len(a), len(b))
                differs = np.flatnonzero(a[:k] != b[:k])
                k = int(differs[0]) if len(differs) else k
                one = comps[lo] if all(c == comps[lo] for c in comps[lo:j]) else None
                node = (a[:k], depth + k, min(sizes[lo:j]), max(sizes[lo:j]), one, [], [])
                children.append(node)
                todo.append((node, lo, j, depth + k))
                lo = j

    def near(self, s: np.ndarray, known: Callable[[int], bool] | None = None) -> list[int]:
        """Ids of the sets x with 100 * |x & s| >= PERCENT * |x | s|, but for components that are known."""
        n, out, todo = len(s), [], [(self.root, 0)]
        while todo:
            (piece, depth, least, most, one, ends, children), overlap = todo.pop()
            if known and one is not None and known(one):
                continue
            left = n
            if len(piece):
                place = np.searchsorted(s, piece)
                overlap += int((s[np.minimum(place, n - 1)] == piece).sum())
                left = n - int(place[-1])
            if 100 * most < PERCENT * n or PERCENT * least > 100 * n or (100 + PERCENT) * (overlap + min(most - depth, left)) < PERCENT * (n + least):
                continue
            out += [i for i, size in ends if (100 + PERCENT) * overlap >= PERCENT * (n + size)]
            todo += [(c, overlap) for c in children]
        return out

    def near_all(self, asking: list[np.ndarray], comps: np.ndarray, root: Callable[[int], int]) -> tuple[list, np.ndarray]:
        """(ids, whether each id's set is similar to each set that asks), by levels of the trie for all that ask at once.

        comps: the components of those that ask; root: what has become of a component in the trie. Pairs within one are left out.
        """
        n = np.array([len(s) for s in asking])
        tokens, who = np.concatenate(asking), np.repeat(np.arange(len(asking)), n)
        order = np.argsort(tokens, kind="stable")
        known, counts = np.unique(tokens, return_counts=True)
        by_token = who[order]
        # how many of a set's shingles are as large as one, or larger, by their first byte
        later = np.zeros((256, len(asking)), np.int64)
        np.add.at(later, ((tokens >> np.uint64(56)).astype(np.int64), who), 1)
        later = np.cumsum(later[::-1], axis=0)[::-1]
        ids, hits = [], []
        nodes, alive, overlap = [self.root], np.ones((1, len(asking)), bool), np.zeros((1, len(asking)), np.int64)
        while nodes:
            depth, least, most = (np.array([x[i] for x in nodes])[:, None] for i in (1, 2, 3))
            alive &= (100 * most >= PERCENT * n) & (PERCENT * least <= 100 * n)
            for i, x in enumerate(nodes):
                if x[4] is not None:
                    alive[i] &= comps != root(x[4])
            some = np.flatnonzero(alive.any(axis=1))
            nodes, alive, overlap, depth, least, most = [nodes[i] for i in some], alive[some], overlap[some], depth[some], least[some], most[some]
            if not nodes:
                break
            pieces_ = np.concatenate([x[0] for x in nodes])
            node = np.repeat(np.arange(len(nodes)), [len(x[0]) for x in nodes])
            at = np.minimum(np.searchsorted(known, pieces_), len(known) - 1)
            held = known[at] == pieces_
            overlap = overlap + _shared_counts(node[held], at[held], len(nodes), counts, by_token, len(asking))
            left = later[[int(x[0][-1] >> np.uint64(56)) if len(x[0]) else 0 for x in nodes]]
            alive &= (100 + PERCENT) * (overlap + np.minimum(most - depth, left)) >= PERCENT * (n + least)
            for i, x in enumerate(nodes):
                for d, size in x[5]:
                    ids.append(d)
                    hits.append(alive[i] & ((100 + PERCENT) * overlap[i] >= PERCENT * (n + size)))
            below = [(i, c) for i, x in enumerate(nodes) if x[6] and alive[i].any() for c in x[6]]
            up = np.array([i for i, _ in below], np.int64)
            nodes, alive, overlap = [c for _, c in below], alive[up], overlap[up]
        return ids, np.array(hits, bool).reshape(len(ids), len(asking))


def _shared_counts(a: np.ndarray, token: np.ndarray, rows: int, held: np.ndarray, by_token: np.ndarray, columns: int) -> np.ndarray:
    """How many tokens each of `rows` sets (a, token) has in common with each of `columns` sets.

    by_token: the latter sets' numbers in the order of tokens, of which each is in `held` sets. Tokens of many pairs are
    counted by products of matrices, the others pair by pair.
    """
    start = np.cumsum(held) - held

    def holders(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in tokens, number of a set) for each set that holds one of the tokens."""
        times = held[tokens]
        first = np.cumsum(times) - times
        return np.repeat(np.arange(len(tokens)), times), by_token[np.arange(times.sum()) + np.repeat(start[tokens] - first, times)]

    out = np.zeros((rows, columns), np.int64)
    dense = np.bincount(token, minlength=len(held)) * held * RARE >= rows * columns
    common = np.flatnonzero(dense)
    place = np.full(len(held), -1)
    place[common] = np.arange(len(common))
    at = place[token]
    for i in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - i)
        left, right = np.zeros((rows, width), np.float32), np.zeros((width, columns), np.float32)
        here = (at >= i) & (at < i + width)
        left[a[here], at[here] - i] = 1
        right[holders(common[i : i + width])] = 1
        out += (left @ right).astype(np.int64)
    a, token = a[at < 0], token[at < 0]
    ends = np.cumsum(held[token])
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
        one, other = holders(token[i:j])
        out += np.bincount(a[i:j][one] * columns + other, minlength=rows * columns).reshape(rows, columns)
        i = j
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with equal first columns, as (key, rest of the rows); sets are copied out of their batch."""
    now, rows = None, []
    for b in batches:
        cols = [c.to_pylist() if not pa.types.is_binary(c.type) else [np.frombuffer(x, np.uint64) for x in c.to_pylist()] for c in b.columns]
        for row in zip(*cols, strict=True):
            if row[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield now, rows


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def led(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the pairs (leader, cls) whose sets are similar; a leader's partners are dealt to blocks, each a tree."""
    sized = pairs.groupBy("leader").agg((F.floor(F.count("*") / BLOCK) + 1).cast("int").alias("blocks"))
    rows = pairs.join(small(stage(sized, "sized")), "leader").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks").cast("long")).cast("int"))
    ones = rows.join(sets, "cls").select("leader", "block", F.lit(1).alias("role"), "cls", "set")
    heads = sized.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(sets, F.col("leader") == F.col("cls"))
    heads = heads.select("leader", "block", F.lit(0).alias("role"), "cls", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (leader, _), rows in _runs(batches, 2):
            head = next((s for role, _, s in rows if role == 0), None)
            others = [(c, s) for role, c, s in rows if role == 1]
            if head is not None and others and (found := Trie(others).near(head)):
                yield _links([(leader, c) for c in found])

    return heads.unionByName(ones).repartition("leader", "block").sortWithinPartitions("leader", "block", "role").mapInArrow(tidied(run), "a long, b long")


def rearranged(members: DataFrame) -> DataFrame:
    """(grp, cls, comp) from (token, cls, comp): groups that overlap are joined where that compares no more sets.

    Groups chained by common members form a cluster; a cluster is either one group or stays its own groups, whichever
    ships fewer sets to blocks.
    """
    heads = small(stage(members.groupBy("token").agg(F.min("cls").alias("head")), "heads"))
    chained = components(members.join(heads, "token").select(F.col("cls").alias("a"), F.col("head").alias("b")))
    rows = members.join(chained, F.col("cls") == F.col("v"), "left").select("token", "cls", "comp", F.coalesce("root", "cls").alias("cluster"))
    rows = stage(rows, "open")
    once = stage(rows.select("cluster", "cls", "comp").distinct(), "open")
    one = once.groupBy("cluster").agg((F.count("*") * _blocks(F.count("*"))).alias("joint"))
    each = rows.groupBy("cluster", "token").agg((F.count("*") * _blocks(F.count("*"))).alias("n")).groupBy("cluster").agg(F.sum("n").alias("single"))
    # a cluster may hold a large share of all rows: they are told what becomes of it by several copies of its row
    joined = one.join(each, "cluster").where("joint <= single").select("cluster", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")
    whole = once.withColumn("salt", salt).join(joined, ["cluster", "salt"], "left_semi").select(F.xxhash64("cluster", F.lit(1)).alias("grp"), "cls", "comp")
    return whole.unionByName(rows.withColumn("salt", salt).join(joined, ["cluster", "salt"], "left_anti").select(F.col("token").alias("grp"), "cls", "comp"))


def within(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): similar sets of different components (comp) within each group (grp), by pairs of blocks of its members."""
    sized = members.groupBy("grp").agg(_blocks(F.count("*")).alias("blocks"))
    rows = members.join(small(stage(sized, "sized")), "grp").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks").cast("long")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "comp")
    rows = rows.join(sets, "cls").select("grp", "i", "j", "own", "cls", "comp", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in _runs(batches, 3):
            comp = {c: k for _, c, k, _ in rows}
            root = {k: k for k in comp.values()}

            def find(k: int, root: dict[int, int] = root) -> int:
                while root[k] != k:
                    root[k] = k = root[root[k]]
                return k

            if len(root) < 2:
                continue
            # block i is stored, block j asks; of equal blocks each set asks for all
            tree, found = Trie([(c, s, k) for own, c, k, s in rows if own == i]), []
            asking = [(c, k, s) for own, c, k, s in rows if own == j]
            for at in range(0, len(asking), ASKING):
                some = asking[at : at + ASKING]
                ids, hits = tree.near_all([s for _, _, s in some], np.array([find(k) for _, k, _ in some], np.int64), find)
                # one set of each component is enough for a link
                comps = np.array([find(comp[d]) for d in ids], np.int64)
                for x in np.flatnonzero(hits.any(axis=0)).tolist():
                    (c, k, _), places = some[x], np.flatnonzero(hits[:, x])
                    for y in places[np.unique(comps[places], return_index=True)[1]].tolist():
                        d = ids[y]
                        if find(k) != find(comp[d]):
                            root[find(k)] = find(comp[d])
                            found.append((c, d))
            if found:
                yield _links(found)

    return rows.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(tidied(run), "a long, b long")


def _places(cls: np.ndarray) -> np.ndarray:
    """Two places of a class in the filter."""
    x = cls.astype(np.int64).view(np.uint64)
    return np.concatenate([mix(x) >> np.uint64(64 - FILTER_BITS), mix(x ^ np.uint64(0x1234567)) >> np.uint64(64 - FILTER_BITS)]).astype(np.int64)


def filter_of(wanted: DataFrame) -> np.ndarray:
    """A Bloom filter of 2 ** FILTER_BITS bits over (cls): 4 MB from a fixed number of tasks, whatever the input; once full it lets all pass."""
    part = 1 << 19  # bits of a row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for b in batches:
            bits[_places(b.column(0).to_numpy())] = True
        rows = [(i, np.packbits(bits[i * part : (i + 1) * part]).tobytes()) for i in range(len(bits) // part) if bits[i * part : (i + 1) * part].any()]
        yield pa.record_batch([pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["i", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        found = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for c in table.column("bits").chunks for x in c.to_pylist()])
        return pa.table([pa.array([table.column("i")[0].as_py()], pa.int32()), pa.array([found.tobytes()], pa.binary())], ["i", "bits"])

    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in wanted.repartition(FILTER_TASKS).mapInArrow(tidied(run), "i int, bits binary").groupBy("i").applyInArrow(merge, "i int, bits binary").collect():
        out[row.i * part // 8 : (row.i + 1) * part // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, set) of the wanted classes (cls): the third pass over the texts."""
    bits = docs.sparkSession.sparkContext.broadcast(filter_of(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        for b in batches:
            rows: dict[int, bytes] = {}
            size = 0
            for s in _sets(b.column(1)):
                if not len(s) or (c := class_of(s)) in rows:
                    continue
                at = _places(np.array([c]))
                if (held[at >> 3] >> (7 - (at & 7)) & 1).all():
                    rows[c] = s.tobytes()
                    size += len(s) * 8
                if size >= 8 << 20:
                    yield pa.record_batch([pa.array(list(rows), pa.int64()), pa.array(list(rows.values()), pa.binary())], ["cls", "set"])
                    rows, size = {}, 0
            if rows:
                yield pa.record_batch([pa.array(list(rows), pa.int64()), pa.array(list(rows.values()), pa.binary())], ["cls", "set"])

    return _texts(docs).mapInArrow(tidied(run), "cls long, set binary").join(wanted, "cls", "left_semi").dropDuplicates(["cls"])


def _named(docs: DataFrame, keyed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the rows of `classes`, (c, first): the smallest id of each class's component, or if keyed the key of its first row)."""
    spark = docs.sparkSession
    table = stage(classes(docs, keyed), "classes")
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PAIRS + 1)
    hot = max(2, min(HOT, PAIRS // (total // CHUNK + 1)))  # so that what isn't hot in any chunk fits a bucket
    prefix = stage(prefixes(shared(dealt_out(docs, buckets, hot), buckets)), "prefixes")
    groups = prefix.groupBy("token").agg(F.count("*").alias("k"), F.sum(F.xxhash64("cls").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("x"), F.min(F.struct("cls", "n")).alias("lead"))
    groups = groups.where("k > 1").groupBy("k", "s", "x").agg(F.min(F.struct("token", "lead")).alias("g")).select("g.token", F.col("g.lead.cls").alias("leader"), F.col("g.lead.n").alias("leader_n"))
    members = stage(prefix.join(small(stage(groups, "groups")), "token").where("cls != leader"), "members")
    fits = F.least("n", "leader_n") * 100 >= F.greatest("n", "leader_n") * PERCENT
    pairs = stage(members.where(fits).select("leader", "cls").distinct(), "pairs")
    wanted = stage(members.select("cls").unionByName(members.select(F.col("leader").alias("cls"))).distinct(), "wanted")
    sets = stage(sets_of(docs, wanted), "sets")
    links = stage(led(pairs, sets), "links")
    roots = components(links)
    placed = members.join(roots, F.col("cls") == F.col("v"), "left").select("token", "cls", F.coalesce("root", "cls").alias("comp"))
    open_groups = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("token")
    more = stage(within(rearranged(stage(placed.join(small(stage(open_groups, "open")), "token", "left_semi"), "open")), sets), "links")
    if not more.isEmpty():
        roots = components(more.unionByName(roots.select(F.col("v").alias("a"), F.col("root").alias("b"))))
    first = table.where("cls is not null").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key") if keyed else "doc_id").alias("rep"))
    first = first.join(roots, F.col("cls") == F.col("v"), "left").select("cls", "rep", F.coalesce("root", "cls").alias("comp"))
    least = first.groupBy("comp").agg(F.min("rep").alias("first"))
    return table, first.join(least, "comp").select(F.col("cls").alias("c"), F.col("first.key" if keyed else "first").alias("first"))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs (doc_id, text)."""
    table, named = _named(docs)
    out = table.join(named, F.col("cls") == F.col("c"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs' rows with one row of each component, once: the one with the smallest id, one without an id only if none has one.

    Rows are told apart by id and text, so one id on several texts ties nothing. Rows with an empty set stay, but repeats
    of an id count once.
    """
    table, named = _named(docs, keyed=True)
    gone = table.join(named, F.col("cls") == F.col("c")).where("key != first").select(F.col("key").alias("_gone")).distinct()
    kept = docs.join(gone, _row_key(docs) == gone["_gone"], "left_anti")
    again = table.where("cls is not null or doc_id is not null").groupBy("key").count().where("count > 1").select(F.col("key").alias("_again"))
    if again.isEmpty():
        return kept
    rows = kept.withColumn("_row", _row_key(docs))
    once = rows.join(again, F.col("_row") == F.col("_again"), "left_semi").dropDuplicates(["_row"])
    return rows.join(again, F.col("_row") == F.col("_again"), "left_anti").unionByName(once).drop("_row")
