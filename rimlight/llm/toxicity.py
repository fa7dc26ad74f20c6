"""Toxicity by multiple-instance learning: sentences get probabilities, a document's is their noisy-or.

Only documents are labelled. A sentence ends at a line's end, a full stop, an exclamation or question mark, or one of
their wide forms. A sentence's logit is a sum of weights of its words and of their first 3 to 6 bytes
(hashed, ASCII letters lower-cased); the document is toxic unless every sentence is clean, 1 - prod(1 - p). The
gradient of the document's loss reaches the sentences that explain its label, so that the trained model also tells
which sentences offend. It is fitted in one task on at most `sample` labelled documents of each label, chosen by a
hash of their ids; features whose log-likelihood ratio over the labels is below `surprise` can't tell and are left
out. Scoring reads every whole text in one pass over its bytes.

Defined cases: a null or empty text, or one without a letter, scores 0; a null id counts as held out and is scored; repeated
rows are scored once each; without any label of both kinds all scores are 0; an empty table gives an empty result;
labels of ids that repeat count once (toxic if any is); further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimlight.llm.common import LOWER, PIECE, Spans, held_out, pieces, utf8

BITS = 18
PREFIXES = (3, 4, 5, 6)
THRESHOLD = 0.3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, sentences array<struct<start: int, end: int, score: double>>"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_END = np.zeros(256, bool)
_END[[10, 33, 46, 63]] = True
_WIDE_ENDS = tuple(x.encode() for x in "。！？")  # three bytes each


class Sentences:
    """Words, sentences and documents of a piece of text: word_sentence, sentence_doc (of sentences with a word), features."""

    def __init__(self, data: np.ndarray, at: np.ndarray) -> None:
        data = LOWER[data]
        n_docs = len(at) - 1
        inside, ends = _LETTER[data], [np.flatnonzero(_END[data]) + 1]
        for a, b, c in _WIDE_ENDS:
            at_ = np.flatnonzero(data[: max(0, len(data) - 2)] == a)
            at_ = at_[(data[at_ + 1] == b) & (data[at_ + 2] == c)]
            for k in range(3):
                inside[at_ + k] = False
            ends.append(at_ + 3)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        cuts = at[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        cuts = cuts[inside[cuts] & inside[cuts - 1]] if len(cuts) else cuts  # words of two documents that touch
        start, end = np.sort(np.concatenate([edge[::2], cuts])), np.sort(np.concatenate([edge[1::2], cuts]))
        bounds = np.unique(np.concatenate([at[:-1], *ends]))
        place = np.searchsorted(bounds, start, "right") - 1
        used, self.word_sentence = np.unique(place, return_inverse=True)
        limit = np.append(bounds, len(data))
        self.start, self.end = limit[used], limit[used + 1] if len(used) else limit[used]
        self.sentence_doc = np.searchsorted(at, self.start, "right") - 1
        self.n_docs = n_docs
        self.features = self._features(data, start, end)

    @staticmethod
    def _features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places of words, hashed features) for whole words and each prefix length."""
        out: list[list] = [[] for _ in range(1 + len(PREFIXES))]
        i, shift = 0, np.uint64(64 - BITS)
        while i < len(start):  # in runs, as one huge document would need huge arrays of powers
            j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE, "right")))
            s, e = start[i:j] - start[i], end[i:j] - start[i]
            spans = Spans(data[start[i] : end[j - 1]])
            whole = (spans.hash(s, e) ^ np.uint64(0x5BD1E995)) * np.uint64(0x9E3779B97F4A7C15)
            out[0].append((np.arange(i, j), whole >> shift))
            for k, n in enumerate(PREFIXES, 1):
                long = np.flatnonzero(e - s >= n)
                out[k].append((long + i, spans.hash(s[long], s[long] + n) >> shift))
            i = j
        return [tuple(np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)) for parts in out if parts]

    def scored(self, weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
        """(probability of each sentence, of each document). A feature counts once a sentence, as in training."""
        told = [((self.word_sentence[place] << BITS) | feature)[weights[feature] != 0] for place, feature in self.features]
        pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *told]))
        z = bias + np.bincount(pairs >> BITS, weights[pairs & ((1 << BITS) - 1)], len(self.start))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 30)))
        return p, np.abs(np.expm1(np.bincount(self.sentence_doc, np.log1p(-p), self.n_docs)))


def train(texts: list[str], toxic: np.ndarray, share: float | None = None, surprise: float = 14.0, rounds: int = 150, rate: float = 0.15) -> tuple[np.ndarray, float]:
    """(weights by feature, bias) by Adam on the noisy-or's log loss; share: of toxic documents among all, to which the two labels are weighed."""
    weights, bias = np.zeros(1 << BITS, np.float32), -30.0
    toxic = toxic.astype(bool)
    if not toxic.any() or toxic.all():
        return weights, bias
    data, at = utf8(pa.array(texts, pa.large_string()))
    pairs, docs, n_sentences = [], [], 0
    for i, j in pieces(at):
        part = Sentences(data[at[i] : at[j]], at[i : j + 1] - at[i])
        for place, feature in part.features:
            pairs.append(np.unique((part.word_sentence[place] + n_sentences) << BITS | feature))
        docs.append(part.sentence_doc + i)
        n_sentences += len(part.start)
    doc = np.concatenate(docs)
    code = np.concatenate(pairs)
    sentence, feature = code >> BITS, code & ((1 << BITS) - 1)
    once = np.unique(doc[sentence] << BITS | feature)
    hot = toxic[once >> BITS]
    n_hot, n_cold = (np.bincount(once[x] & ((1 << BITS) - 1), minlength=1 << BITS) for x in (hot, ~hot))
    both, r = n_hot + n_cold, toxic.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 2 * (np.where(n_hot > 0, n_hot * np.log(n_hot / (both * r)), 0) + np.where(n_cold > 0, n_cold * np.log(n_cold / (both * (1 - r))), 0))
    useful = (n_hot > both * r) & (gain >= surprise)
    keep = useful[feature]
    sentence, feature = sentence[keep], feature[keep]
    used, feature = np.unique(feature, return_inverse=True)
    share = toxic.mean() if share is None else share
    balance = np.where(toxic, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))[doc]
    w, b, n = np.zeros(len(used)), -7.0, len(texts)
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, rounds + 1):
        z = b + np.bincount(sentence, w[feature], n_sentences)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 30)))
        clean = np.exp(np.bincount(doc, np.log1p(-p), n))
        odds = clean / np.maximum(1 - clean, 1e-12)
        g = balance * np.where(toxic[doc], -p * odds[doc], p)
        grad = np.append(np.bincount(feature, g[sentence], len(used)) + 0.02 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w, b = w - step[:-1], b - step[-1]
    weights[used] = w
    return weights, float(b)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000) -> tuple[np.ndarray, float]:
    """Trains on at most `sample` documents of each label that are not held out (their number is the only bound)."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null")
    marked = marked.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = marked.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    share = counts[0] / max(1, counts[0] + counts[1])
    order = F.xxhash64("doc_id")
    chosen = marked.where("toxic = 1").orderBy(order).limit(sample).unionByName(marked.where("toxic = 0").orderBy(order).limit(sample))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, x or "", y) for b in batches for i, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True))
        w, b = train([x for _, x, _ in rows], np.array([y for *_, y in rows], bool), share)
        yield pa.record_batch([pa.array([w.tobytes()]), pa.array([b])], ["w", "b"])

    row = texts.repartition(1).mapInArrow(run, "w binary, b double").first()
    return (np.frombuffer(row.w, np.float32), row.b) if row else train([], np.zeros(0, bool))


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences (code points, end exclusive) of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for b in batches:
            data, at = utf8(b.column(2))
            scores, found = [], [[] for _ in range(b.num_rows)]
            for i, j in pieces(at):
                part = Sentences(data[at[i] : at[j]], at[i : j + 1] - at[i])
                p, whole = part.scored(weights, bias)
                scores.append(whole)
                for s in np.flatnonzero(p >= threshold):
                    d = part.sentence_doc[s]
                    text = data[at[i + d] : at[i] + part.end[s]]
                    lead = (text & 0xC0) != 0x80  # first bytes of code points
                    begin = int(lead[: at[i] + part.start[s] - at[i + d]].sum())
                    found[i + d].append({"start": begin, "end": int(lead.sum()), "score": float(p[s])})
            s = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(found, kind)], ["doc_id", "held_out", "score", "predicted", "sentences"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def detect(docs: DataFrame, labels: DataFrame, sample: int = 3000, threshold: float = THRESHOLD) -> DataFrame:
    """`score` by a model of `fit`."""
    return score(docs, fit(docs, labels, sample), threshold)
