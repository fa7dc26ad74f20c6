"""Language identification by error-correcting output codes.

Every learned language has a codeword; for each bit a binary linear classifier over letter n-grams (1 to 3 letters,
hashed) says on which side a text is. Decoding adds, over the bits, the exponential loss of a classifier's margin
against a language's bit, weighed by the classifier's accuracy on rows kept out of its fit; the smallest sum wins.
Texts whose best two sums are close are flagged as ambiguous.

Up to 7 languages get all distinct splits of the languages (exhaustive codes), more get seeded random codewords of
15 bits per doubling. The classifiers are fitted in one task on at most `sample` labelled rows of each language (fewer
with more than 20 languages, so that the sample stays below MOST_ROWS), chosen by a hash of their ids; the features of
whole texts are counted in array code in one pass.

Defined cases: a null text, or one without a letter, is 'und' with score 0; a null id counts as held out; with a
single learned language every text with a letter gets it, with none all are 'und'; repeated rows are predicted once
each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rimlight.llm.common import held_out, pieces, utf8

DIM = 1 << 12
#: What is counted at once: a row of DIM numbers per document, however short it is, and some numbers per letter.
CHUNK_BYTES, CHUNK_DOCS = 1 << 19, 256
MOST_ROWS = 16_000  # of a training sample, each of which is a row of DIM numbers: 256 MB
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"


@cache
def _letters() -> np.ndarray:
    """Lower-cased code point of every letter, 0 for all else."""
    table = np.zeros(0x40000, np.uint32)
    for c in itertools.chain(range(0xD800), range(0xE000, 0x40000)):
        x = chr(c)
        if x.isalpha():
            table[c] = ord(x.lower()[0])
    return table


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents x DIM shares of n-grams, scaled by root; letters of each document) of UTF-8 texts data[at[i]:at[i+1]]."""
    n = len(at) - 1
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    cuts = lead[at] if lead[-1] == len(codes) else None
    if cuts is None:  # bytes that are no UTF-8: text by text
        parts = [np.frombuffer(data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for i in range(n)]
        codes, cuts = np.concatenate([*parts, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    known = _letters()
    low = known[np.minimum(codes, len(known) - 1)]
    doc = np.repeat(np.arange(n), np.diff(cuts))
    letter = low != 0
    letters = np.bincount(doc[letter], minlength=n)
    # one blank between documents and for every run of others
    keep = letter | np.concatenate([letter[1:] & ~letter[:-1], [False]]) if len(low) else letter
    x, d = low[keep].astype(np.uint64), doc[keep]
    seen = []
    for size, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (3, 0x165667B19E3779F9)):
        if len(x) < size:
            continue
        h = np.full(len(x) - size + 1, salt, np.uint64)
        for k in range(size):
            h = (h ^ x[k : len(x) - size + 1 + k]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(29)
        same = d[: len(h)] == d[size - 1 :]
        middle = x[size // 2 : size // 2 + len(h)] != 0 if size > 1 else x != 0
        ok = same & middle
        seen.append(d[: len(h)][ok] * DIM + (h[ok] & np.uint64(DIM - 1)).astype(np.int64))
    table = np.bincount(np.concatenate([np.zeros(0, np.int64), *seen]), minlength=n * DIM).astype(np.float32).reshape(n, DIM)
    table /= np.maximum(table.sum(1, keepdims=True), 1)
    return np.sqrt(table, out=table), letters


def codewords(k: int, seed: int = 11) -> np.ndarray:
    """k x bits of -1 and 1, rows far apart, no column of one sign only."""
    if k <= 1:
        return np.ones((k, 0))
    if k <= 7:  # every split of the languages in two, once
        return np.array([[1 if i == 0 or m >> (i - 1) & 1 else -1 for m in range(2 ** (k - 1) - 1)] for i in range(k)], float)
    bits, rng = 15 * (k - 1).bit_length(), np.random.default_rng(seed)
    best = max((rng.choice([-1.0, 1.0], (k, bits)) for _ in range(50)), key=lambda m: -np.max(m @ m.T - 2 * bits * np.eye(k)))
    return best[:, np.abs(best.sum(0)) < k]


def fit(x: np.ndarray, y: np.ndarray, k: int, rounds: int = 120, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights DIM + 1 x bits, bit weights, codewords): logistic classifiers of all bits at once; one row in five rates them."""
    code = codewords(k)
    if not code.shape[1]:
        return np.zeros((DIM + 1, 0)), np.zeros(0), code
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    sign = code[y]
    rated = np.arange(len(x)) % 5 == 4
    if rated.sum() < 20:
        rated[:] = False
    share = np.bincount(y[~rated], minlength=k)
    even = (1 / np.maximum(share, 1))[y[~rated]][:, None] / max(1, (share > 0).sum())
    xs, ss = x[~rated].astype(np.float32), sign[~rated].astype(np.float32)
    pull = ss * even.astype(np.float32)
    w, m, v = np.zeros((DIM + 1, code.shape[1]), np.float32), 0.0, 0.0
    for t in range(1, rounds + 1):
        g = -(xs.T @ (pull / (1 + np.exp(np.clip(ss * (xs @ w), -40, 40))))) + np.float32(1e-6) * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = (w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    test = rated if rated.any() else ~rated
    right = ((x[test] @ w) * sign[test] > 0).mean(0).clip(0.5, 1 - 1e-3)
    return w, np.maximum(np.log(right / (1 - right)), 1e-3), code


def decode(margins: np.ndarray, bit_weights: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, score, lead over the second as a share of all loss) by weighed exponential loss over the bits."""
    if code.shape[0] == 1:
        return np.zeros(len(margins), int), np.ones(len(margins)), np.ones(len(margins))
    loss = np.exp(-np.clip(margins, -3, 3)) @ (bit_weights[:, None] * (code.T > 0)) + np.exp(np.clip(margins, -3, 3)) @ (bit_weights[:, None] * (code.T < 0))
    loss /= bit_weights.sum()
    rank = np.sort(loss, 1)
    chance = np.exp(-2 * (loss - rank[:, :1]))
    return loss.argmin(1), 1 / chance.sum(1), (rank[:, 1] - rank[:, 0]) / (rank[:, 1] + rank[:, 0])


def train(docs: DataFrame, sample: int = 800) -> tuple[list[str], tuple]:
    """(languages, model) from at most `sample` rows of each language that are not held out, MOST_ROWS in all."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("doc_id is not null and lang is not null").where(~held_out()).dropDuplicates(["doc_id", "lang"])
    # the rows with the smallest hashes; a language's others go by a bound on the hash before they are shuffled
    counts = rows.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_rows"))
    sample = max(1, min(sample, MOST_ROWS // max(1, counts.count())))
    share = F.least(F.lit(1.0), 4.0 * sample / F.col("_rows"))
    rows = rows.join(counts, F.col("lang") == F.col("_lang")).where(F.xxhash64("doc_id") <= F.lit(-(2.0**63)) + share * 2.0**64).select("doc_id", "lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample).select("doc_id", "lang")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(chosen), "doc_id")  # `sample` rows a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys, ids = [], [], []
        for b in batches:
            data, at = utf8(b.column(1))
            for i, j in pieces(at, CHUNK_BYTES, CHUNK_DOCS):
                x, letters = features(data[at[i] : at[j]], at[i : j + 1] - at[i])
                fine = np.flatnonzero(letters)
                xs.append(x[fine])
                ids += [b.column(0)[int(i + f)].as_py() for f in fine]
                ys += [b.column(2)[int(i + f)].as_py() for f in fine]
        if ys:
            order = sorted(range(len(ys)), key=lambda r: (ids[r] * 2654435761 % 2**32, ids[r], ys[r]))
            names = sorted(set(ys))
            w, bits, code = fit(np.concatenate(xs)[order], np.array([names.index(ys[r]) for r in order]), len(names))
            yield pa.record_batch([pa.array([names]), *(pa.array([x.astype(np.float64).tobytes()]) for x in (w, bits, code))], ["names", "w", "bits", "code"])

    row = texts.repartition(1).mapInArrow(run, "names array<string>, w binary, bits binary, code binary").first()
    if row is None:
        return [], (np.zeros((DIM + 1, 0)), np.zeros(0), np.ones((0, 0)))
    w, bits, code = (np.frombuffer(x, np.float64) for x in (row.w, row.bits, row.code))
    return row.names, (w.reshape(DIM + 1, -1).astype(np.float32), bits, code.reshape(len(row.names), -1))


def predict(docs: DataFrame, names: list[str], model: tuple, ambiguous_below: float = 0.15) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous for each row of docs, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast((names, model))  # DIM weights a bit, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, (w, bits, code) = shared.value
        for b in batches:
            data, at = utf8(b.column(2))
            lang, score, close = [], [], []
            for i, j in pieces(at, CHUNK_BYTES, CHUNK_DOCS):
                x, letters = features(data[at[i] : at[j]], at[i : j + 1] - at[i])
                if names:
                    best, p, lead = decode(x @ w[:-1] + w[-1], bits, code)
                else:
                    best, p, lead = np.zeros(j - i, int), np.zeros(j - i), np.zeros(j - i)
                fine = (letters > 0) & bool(names)
                lang += [names[c] if f else UNKNOWN for c, f in zip(best, fine, strict=True)]
                score.append(np.where(fine, p, 0.0))
                close.append(~fine | (lead < ambiguous_below))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(np.concatenate([np.zeros(0), *score])), pa.array(np.concatenate([np.zeros(0, bool), *close]))], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def identify(docs: DataFrame, sample: int = 800) -> DataFrame:
    """`predict` by a model of `train`."""
    return predict(docs, *train(docs, sample))
