"""Quality by weak supervision: rules vote good, bad or abstain; expectation-maximisation weighs them.

Every whole text is measured once in Python and turned into one vote per rule. Votes are then counted by pattern
(at most 3 ** rules of them, whatever the corpus holds), so that expectation-maximisation runs over all documents
on a table of bounded size, and each pattern's posterior goes back to its documents by a broadcast of that table. Where
documents are filtered, their columns go through the same pass, so that each row meets its own verdict without a join.

Defined cases: a null or empty text has no words, fails the base rule and is not kept; a null id is a row like any
other; repeated rows each get the same verdict; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rimlight.llm.common import stage, tidied, unused

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACES = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"
_MARKS = _SYMBOLS.encode()
_LETTER = re.compile(r"[^\W\d_]")
_UPPER = re.compile("[A-Z\u00c0-\u00d6\u00d8-\u00de\u0391-\u03a9\u0410-\u042f]+")  # the common cased alphabets; others never count as shouting


@dataclass(frozen=True)
class Rule:
    """Votes bad at or beyond `bad`, good at or within `good`, else abstains; which side is bad follows from their order."""

    name: str
    good: float
    bad: float

    def vote(self, x: float | None) -> int:
        if x is None:
            return 0
        if self.good < self.bad:
            return 1 if x <= self.good else -1 if x >= self.bad else 0
        return 1 if x >= self.good else -1 if x <= self.bad else 0


#: In the order of `signals`; shares are of words unless said otherwise.
RULES = (
    Rule("symbol_chars", 0.02, 0.08),
    Rule("duplicate_lines", 0.05, 0.5),
    Rule("repeated_words", 0.1, 0.45),
    Rule("upper_letters", 0.15, 0.5),
    Rule("shouted_words", 0.02, 0.2),
    Rule("lone_marks", 0.02, 0.15),
    Rule("commonest_word", 0.15, 0.3),
    Rule("distinct_words", 0.35, 0.15),
    Rule("ended_lines", 0.5, 0.1),
    Rule("marked_words", 0.05, 0.4),
    Rule("letter_chars", 0.85, 0.75),
)


def measure(text: str | None) -> tuple[list[int], list[float | None]]:
    """The five measures of a text, and what the rules look at (None: the rule has nothing to look at)."""
    if not text:
        return [0] * 5, [None] * len(RULES)
    raw = text.encode("utf-8", "surrogatepass").split()  # bytes split at the six ASCII white-space characters only
    n = len(raw)
    if not n:
        return [0, 0, sum(map(text.count, _SYMBOLS)), 0, 0], [None] * len(RULES)
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    copies = len(lines) - len(set(lines))
    repeats = 0
    if n > 3:
        windows = list(zip(raw, raw[1:], raw[2:], strict=False))
        seen = Counter(windows)
        if len(seen) < len(windows):
            covered = -1  # last word counted so far
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeats += i + 2 - max(covered, i - 1)
                    covered = i + 2
    letters = len(_LETTER.findall(text))
    uppers = sum(map(len, _UPPER.findall(text)))
    common = Counter(raw)
    return [n, chars, symbols, copies, repeats], [
        symbols / chars,
        copies / len(lines) if len(lines) > 2 else None,
        repeats / n,
        uppers / letters if letters else None,
        sum(x.endswith((b"!!", b"??")) for x in raw) / n,
        sum(len(x) == 1 and not x.isalnum() for x in raw) / n,
        max(common.values()) / n if n > 9 else None,
        len(common) / min(n, 1000) if n > 9 else None,
        sum(x.rstrip(_SPACES)[-1:] in '.!?…"”»:;' for x in lines) / len(lines),
        sum(x[-1] in _MARKS for x in raw) / n,
        letters / chars,
    ]


def votes(text: str | None, rules: tuple[Rule, ...] = RULES) -> tuple[list[int], list[int]]:
    """(measures, one vote of -1, 0 or 1 per rule)."""
    found, signals = measure(text)
    return found, [r.vote(x) for r, x in zip(rules, signals, strict=True)]


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60, prior: float = 0.85) -> tuple[float, np.ndarray]:
    """(prior of good, rule x class x vote probabilities) by EM over distinct vote patterns and how often each occurs.

    Bad texts are bad in one way each: a rule that calls a text bad is hardly ever wrong, but most others will call the
    same text good. The start values say just that (START), and add-one smoothing keeps every vote possible. How often
    a rule speaks counts as evidence, too. No pattern at all gives the start values.
    """
    seen = np.stack([patterns == v for v in (-1, 0, 1)], -1).astype(float)  # pattern x rule x vote
    table, total = np.tile(START, (patterns.shape[1], 1, 1)), counts.sum()
    for _ in range(rounds if total else 0):
        good = posterior(patterns, prior, table)
        weight = np.stack([1 - good, good], -1) * counts[:, None]
        prior = float((weight[:, 1].sum() + 1) / (total + 2))
        table = np.einsum("pc,prv->rcv", weight, seen) + START
        table /= table.sum(-1, keepdims=True)
    return prior, table


#: class (bad, good) x vote (bad, none, good) before any document has been seen.
START = np.array([[0.2, 0.3, 0.5], [0.005, 0.395, 0.6]])


def posterior(patterns: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    """Probability that a document with each pattern is good."""
    log = np.zeros((len(patterns), 2)) + np.log([1 - prior, prior])
    for r in range(patterns.shape[1]):
        log += np.log(table[r][:, patterns[:, r] + 1]).T
    return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))


def measured(docs: DataFrame, mark: str, columns: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """These columns of docs, the five measures and the votes as one base-3 number (pattern); mark is put before the new names."""
    rows = docs.select(*(F.col(f"`{c}`") for c in columns))
    kept = rows.schema.fields
    whole = "text" in columns and dict(docs.dtypes)["text"] == "string"  # then the column itself is measured
    rows = rows if whole else docs.select(*(F.col(f"`{c}`") for c in columns), F.col("text").cast("string").alias(f"{mark}text"))
    at = columns.index("text") if whole else len(columns)
    schema = StructType([*kept, *(StructField(f"{mark}{m}", LongType()) for m in (*MEASURES, "pattern"))])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [votes(x.as_py(), rules) for x in b.column(at)]
            counts = np.array([m for m, _ in found], np.int64).reshape(-1, 5)
            codes = [sum((v + 1) * 3**i for i, v in enumerate(vs)) for _, vs in found]
            yield pa.record_batch([*b.columns[: len(columns)], *(pa.array(counts[:, i]) for i in range(5)), pa.array(codes, pa.int64())], names)

    return rows.mapInArrow(tidied(run), schema)


def _judged(table: DataFrame, mark: str, threshold: float = 0.5, rules: tuple[Rule, ...] = RULES, min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """Written `measured` rows with quality, failed and kept, after mark."""
    rows = table.groupBy(F.col(f"{mark}pattern").alias("pattern")).count().collect()  # 3 ** rules rows at most
    codes = np.array(sorted((r["pattern"], r["count"]) for r in rows), np.int64).reshape(-1, 2)
    patterns = np.stack([codes[:, 0] // 3**i % 3 - 1 for i in range(len(rules))], -1)
    prior, probs = fit(patterns, codes[:, 1].astype(float))
    scores = [(int(c), float(q)) for c, q in zip(codes[:, 0], posterior(patterns, prior, probs), strict=True)]
    known = table.sparkSession.createDataFrame(scores, f"{mark}pattern long, {mark}quality double")
    n_words, repeats = F.col(f"{mark}n_words"), F.col(f"{mark}n_repeat_words")
    failed = (n_words < min_words) | (100 * repeats > repeat_percent * n_words)
    return table.join(F.broadcast(known), f"{mark}pattern").withColumns({f"{mark}failed": failed, f"{mark}kept": ~failed & (F.col(f"{mark}quality") >= threshold)})


def judge(docs: DataFrame, **params: float) -> DataFrame:
    """doc_id, measures, base_failed, quality (posterior that the text is good) and kept, one row per row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = stage(measured(rows, "_", ["doc_id"]), "quality")
    columns = [F.col(f"_{m}").alias(m) for m in MEASURES]
    return _judged(table, "_", **params).select("doc_id", *columns, F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_quality").alias("quality"))


def keep(docs: DataFrame, **params: float) -> DataFrame:
    """The rows of docs that `judge` keeps, with docs' own columns, which go through the one pass over the texts: no join, no shuffle."""
    mark = unused(docs.columns)
    table = stage(measured(docs, mark, docs.columns), "quality")
    return _judged(table, mark, **params).where(F.col(f"{mark}kept")).select(*(F.col(f"`{c}`") for c in docs.columns))
