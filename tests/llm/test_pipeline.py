"""The pipeline against a plain-Python version of all its stages."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rimlight.llm import jaccard, packing, quality
from tests import duck
from tests.llm.test_operators import base_spans, groups_of


def brute_quality(rows):
    found = [quality.votes(t) for _, t, _ in rows]
    patterns = np.array([v for _, v in found])
    prior, table = quality.fit(patterns, np.ones(len(rows)))  # row by row instead of by pattern
    good = quality.posterior(patterns, prior, table) >= 0.5
    return [r for r, (m, _), g in zip(rows, found, good, strict=True) if g and m[0] >= 50 and 100 * m[4] <= 50 * m[0]]


def brute_mask(text):
    out, at = [], 0
    for a, _, b, kind in base_spans(text):
        if a >= at:
            out.append(text[at:a] + f"<{kind.upper()}>")
        at = max(at, b)
    return "".join(out) + text[at:]


def brute_mix(rows):
    size = {d: len(t.encode().split()) for d, t, _ in rows}
    total = Counter()
    for d, _, s in rows:
        total[s] += size[d]
    names = sorted(total)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, free, left = {}, set(names), 1.5 * sum(total.values())
    while free:
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 2 * total[s]]
        for s in over:
            goal[s] = 2.0 * total[s]
            free.discard(s)
        left -= sum(goal[s] for s in over)
        if not over:
            goal |= {s: left * weight[s] / w for s in free}
            break
    out = []
    for s in names:
        whole = int(goal[s] // total[s])
        rest = int(np.floor(goal[s] - whole * total[s] + 0.5))
        for _, d, t in sorted((hashlib.md5(f"7:{d}".encode()).hexdigest(), d, t) for d, t, x in rows if x == s):
            out += [(d, t)] * whole
            part = max(0, min(size[d], rest))
            rest -= part
            if part == size[d]:
                out.append((d, t))
            elif part:
                raw, i, n = t.encode(), 0, 0
                while n < part:
                    while raw[i : i + 1] in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"):
                        i += 1
                    while i < len(raw) and raw[i : i + 1] not in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"):
                        i += 1
                    n += 1
                out.append((d, raw[:i].decode()))
    return out


def test_pipeline_like_brute_force(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{duck.DATA}/documents.parquet").collect()]
    rows = brute_quality(rows)
    kept = {c for _, _, c in groups_of([(d, t) for d, t, _ in rows])}
    rows = [(d, brute_mask(t), s) for d, t, s in rows if d in kept]
    tokens = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = Counter()
    for d, t in brute_mix(rows):
        ids, at = np.array([*tokens.encode(t, add_special_tokens=False).ids, 0], "<u4"), 0
        for n in packing.cut(len(ids)):
            want[d, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)] += 1
            at += n
    got = corpus_pipeline.run(spark, duck.DATA).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 1024


def test_quality_verdicts_are_of_rows(spark):
    docs = spark.read.parquet(f"{duck.DATA}/documents.parquet").select("doc_id", "text").limit(200)
    kept = {r.text for r in quality.keep(docs).collect()}
    shared = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3 - 1).cast("long"))
    shared = shared.unionByName(spark.createDataFrame([(None, ""), (None, None), (0, "")], shared.schema))
    shared = shared.withColumns({"_text": F.lit("x"), "__pattern": F.lit(1)})
    got = Counter((r.doc_id, r.text) for r in quality.keep(shared).collect())
    assert quality.keep(shared).columns == shared.columns
    assert got == Counter((r.doc_id, r.text) for r in shared.collect() if r.text in kept) and {d for d, _ in got} == {None, 0, 1}


def test_one_row_of_each_component_stays(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    near = a.replace("a39", "zz")
    rows = [(None, a), (None, a), (None, near), (7, a), (5, near), (5, b), (3, b), (9, c), (9, d), (None, d), (None, "e f g"), (None, "e f g"), (4, ""), (None, None), (8, c)]
    out = jaccard.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(5, near), (3, b), (8, c), (9, d), (None, "e f g"), (4, ""), (None, None)]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr) and out.columns == ["doc_id", "text"]


def test_stages_keep_columns_and_stand_odd_rows(spark):
    docs = spark.read.parquet(f"{duck.DATA}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", None, 0), (10**6, "", "en", None, 0), (10**6 + 1, "word " * 5000, None, "src0", 7), (None, "a b " * 60, "en", "src1", 3), (10**6 + 2, " ".join(f"w{i % 90} of {i}." for i in range(200)) + "\n" * 1_200_000, "en", "src2", 9)], docs.schema)
    docs = docs.unionByName(odd).withColumns({c: F.lit("x") for c in ("size", "cls", "key", "kept", "component_id")})
    for part in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, part, duck.DATA)
            if name != "packing":
                assert out.columns == docs.columns and out.dtypes == docs.dtypes
            out.collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard", "personal_data", "source_mix", "packing"]
