"""Each operator against brute force, with nulls, empties, ties, repeats, extra columns and no rows."""

import base64
import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rimlight.llm import ann, jaccard, langid, mixing, packing, pii, quality, queries, toxicity, warc, wrappers
from rimlight.llm.common import Spans, pieces, utf8, word_hashes, words
from rimlight.llm.components import components
from tests import duck

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \t\n", "one", "One two", "one  TWO", "x " * 3000, "é" * 50, "a b c d e", "A b c d e", "<|endoftext|> b", "日本語 テキスト", "\x00\x01 nul"]


def documents(spark, texts, extra=True):
    rows = [(i, t, "en", f"src{i % 3}" if i % 4 else None, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:  # names that operators use themselves
        df = df.withColumns({c: F.lit("x") for c in ("size", "taken", "cls", "n", "key", "score", "kept", "target", "pattern", "token")})
    return df


def some(spark, name="documents", n=250):
    return spark.read.parquet(f"{duck.DATA}/{name}.parquet").limit(n)


def test_words_and_hashes():
    texts = ["a  bb\tc", "", None, "dd", "é x", "a"]
    data, at = utf8(pa.array(texts))
    start, end, first = words(data, at)
    got = [[data[s:e].tobytes() for s, e in zip(start[a:b], end[a:b], strict=True)] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == [(t or "").encode().split() for t in texts]
    h = word_hashes(data, start, end)
    assert h[0] == h[-1] and len(set(h.tolist())) == len(h) - 1
    whole = Spans(data).hash(start, end)
    assert (whole == h).all()
    assert [*pieces(np.array([0, 5, 5, 20, 21]), 6)] == [(0, 2), (2, 3), (3, 4)] and [*pieces(np.array([0]))] == []


# --- 1 ---------------------------------------------------------------------------------------------------------------


def pages(spark):
    html = [None, "", "<p>é</p>", "<p>é</p>", "x" * 200000, "\r\n\r\nWARC/1.1 \x1f", None]
    return spark.createDataFrame([(i, None if i == 1 else f"http://h/{i} a\nb", h, "z") for i, h in enumerate(html)] + [(2, "http://again", "<p>é</p>", "z"), (None, "u", "only", "z")], "page_id long, url string, html string, digest string")


def archive(records):
    return [warc.member(warc.record(n, "http://u", p, base64.b32encode(hashlib.sha1(p).digest()).decode(), len(p), None)) for n, p in records]


class Memory:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def walk(data):
    return [(k, s, e, f["warc-record-id"] if k == "record" else f, p) for k, s, e, f, p in warc.Salvage(Memory(data), len(data))]


def test_round_trip_of_archives(spark):
    got = sorted(map(tuple, warc.round_trip(pages(spark)).collect()), key=repr)
    want, firsts = [], {}
    rows = pages(spark).collect()
    for r in rows:
        p = (r.html or "").encode()
        if r.page_id is not None:
            firsts[p] = min(firsts.get(p, 99), r.page_id)
    for r in rows:
        p = (r.html or "").encode()
        first = firsts.get(p)
        again = first is not None and r.page_id != first
        want.append((r.page_id, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(pages(spark).limit(0)).count() == 0


def test_damage_is_logged_and_told(spark, tmp_path):
    manifest = warc.write(warc.planned(pages(spark).coalesce(1)), f"file://{tmp_path}/w")
    (path,) = (tmp_path / "w").glob("*.warc.gz")
    data = bytearray(path.read_bytes())
    starts = [s for k, s, *_ in walk(bytes(data)) if k == "record"]
    data[starts[2] + 40] ^= 0x55
    path.write_bytes(data)
    rows = warc.read(manifest).collect()
    gaps = [r for r in rows if r.kind == "gap"]
    assert len(rows) == 9 and [(g.start, g.end) for g in gaps] == [(starts[2], starts[3])] and gaps[0].reason and gaps[0].path.endswith(".warc.gz")
    with pytest.raises(RuntimeError, match="9 records were written and 8 read"):
        warc.whole(manifest, warc.read(manifest))
    assert warc.whole(manifest.limit(0), warc.read(manifest).limit(0)).count() == 0


def test_payloads_survive_and_archives_roll(spark, tmp_path):
    manifest = warc.write(warc.planned(pages(spark).coalesce(1)), f"file://{tmp_path}/w", roll=300)
    assert manifest.count() > 1 and manifest.agg(F.sum("records")).first()[0] == 9
    rows = {r.record_id: r for r in warc.read(manifest).where("record_type = 'response'").collect()}
    assert bytes(rows["<urn:x-page-id:4>"].payload) == b"x" * 200000 and bytes(rows["<urn:x-page-id:5>"].payload) == b"\r\n\r\nWARC/1.1 \x1f"


@pytest.mark.parametrize("plain", [False, True])
def test_salvage_finds_later_records(plain):
    parts = [zlib.decompress(x, 31) for x in archive((str(i), bytes([65 + i]) * 50) for i in range(6))] if plain else archive((str(i), bytes([65 + i]) * 50) for i in range(6))
    whole = walk(b"".join(parts))
    assert [x[0] for x in whole] == ["record"] * 6 and [x[4] for x in whole] == [bytes([65 + i]) * 50 for i in range(6)]
    broken = bytearray(parts[2])
    broken[-12 if plain else 60] ^= 0x55
    for bad, lost in (([*parts[:2], bytes(broken), *parts[3:]], 2), ([*parts[:2], parts[2][:40], *parts[3:]], 2), ([parts[0], b"junk \x1f\x8b\x08 WARC/1.1 more", *parts[1:]], None), ([*parts[:5], parts[5][:-9]], 5)):
        data = b"".join(bad)
        found = walk(data)
        gaps = [x for x in found if x[0] == "gap"]
        assert len(gaps) == 1 and sum(e - s for _, s, e, *_ in found) == len(data)
        want = [i for i in range(6) if i != lost]
        assert [x[3] for x in found if x[0] == "record"] == [f"<urn:x-page-id:{i}>" for i in want]
        at = sum(map(len, parts[:lost])) if lost is not None else len(parts[0])
        assert gaps[0][1] == at
    assert walk(b"") == [] and [x[:3] for x in walk(b"nothing here")] == [("gap", 0, 12)]


# --- 2 ---------------------------------------------------------------------------------------------------------------


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs, "doc_id").select("doc_id", "held_out", "lang_pred", "score", "lang").collect()
    assert len(rows) == 1000 and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in test) / len(test) >= 0.96


def test_language_cases(spark):
    docs = some(spark).select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(10001, None, "en"), (10002, "", "en"), (10003, "12 !?", "en"), (None, "the of and", "fr"), (10004, "𝒜", None)], "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in langid.identify(docs.withColumn("score", F.lit("s"))).collect()}
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (10001, 10002, 10003)) and got[10004].lang_pred != "und" and got[None].held_out
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit("xx"))).collect()} == {"xx", "und"}


def test_codes_correct_errors():
    code = langid.codewords(4)
    assert code.shape == (4, 7) and (code @ code.T == 7 * np.eye(4) - (1 - np.eye(4))).all()
    for i in range(4):
        for flip in range(7):
            m = 2 * code[i].copy()
            m[flip] *= -1
            assert langid.decode(m[None], np.ones(7), code)[0][0] == i  # distance 4 corrects one wrong bit
    far = langid.codewords(20)
    assert (np.abs(far @ far.T) - np.diag(np.diag(far @ far.T))).max() < 0.6 * far.shape[1]


def plain_grams(text):
    """Counts of the hashed letter n-grams of a text, letter by letter."""
    low = "".join(c.lower()[0] if c.isalpha() and ord(c) < 0x40000 else " " for c in text)
    low = re.sub(" +", " ", low).rstrip(" ")  # one blank before every word that isn't the first character
    counts, mask = Counter(), (1 << 64) - 1
    for size, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (3, 0x165667B19E3779F9)):
        for i in range(len(low) - size + 1):
            if low[i + size // 2 if size > 1 else i] == " ":
                continue
            h = salt
            for c in low[i : i + size]:
                h = (h ^ (0 if c == " " else ord(c))) * 0xFF51AFD7ED558CCD & mask
                h ^= h >> 29
            counts[h & (langid.DIM - 1)] += 1
    return counts


def test_language_like_brute_force(spark):
    docs = some(spark).select("doc_id", "text", "lang")
    names, (w, bits, code) = langid.train(docs)
    docs = docs.unionByName(spark.createDataFrame([(90001, "Ünïted 12 x", "en"), (90002, "日本 a", "en"), (90003, " a\n", None)], docs.schema))
    got = {r.doc_id: r for r in langid.predict(docs, names, (w, bits, code)).collect()}
    for r in docs.collect():
        counts = plain_grams(r.text or "")
        total = sum(counts.values())
        if not total:
            assert got[r.doc_id].lang_pred == "und"
            continue
        margin = [sum(math.sqrt(n / total) * float(w[k, b]) for k, n in counts.items()) + float(w[-1, b]) for b in range(w.shape[1])]
        loss = [sum(bits[b] * math.exp(-code[c, b] * max(-3, min(3, margin[b]))) for b in range(w.shape[1])) / sum(bits) for c in range(len(names))]
        want = min(range(len(names)), key=loss.__getitem__)
        chance = [math.exp(-2 * (x - loss[want])) for x in loss]
        assert got[r.doc_id].lang_pred == names[want] and abs(got[r.doc_id].score - 1 / sum(chance)) < 1e-3


# --- 3 ---------------------------------------------------------------------------------------------------------------


def measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    spots = defaultdict(list)
    for i in range(len(w) - 2):
        spots[tuple(w[i : i + 3])].append(i)
    covered = {j for at in spots.values() if len(at) > 1 for i in at for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_and_verdicts(spark):
    docs = documents(spark, ODD + ["a b c a b c", "a b c x a b c d a b", "l\nl\n \nl#", "\xa0a b\x85"])
    docs = docs.unionByName(some(spark).withColumn("doc_id", F.col("doc_id") + 1000), allowMissingColumns=True)
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for r in docs.collect():
        m = measures(r.text)
        x = got[r.doc_id]
        assert tuple(x[c] for c in quality.MEASURES) == m
        assert x.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0]) and not (x.base_failed and x.kept)
    assert quality.judge(docs.limit(0)).count() == 0
    assert quality.keep(docs).columns == docs.columns


def test_quality_votes_find_labelled_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = quality.judge(docs).where("not base_failed").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", F.col("quality").alias("good")), "doc_id").select("kept", "good").collect()
    c = Counter((r.good, r.kept) for r in rows)
    assert c[1, False] <= 0.005 * (c[1, True] + c[1, False]) and c[0, True] <= 0.05 * (c[0, True] + c[0, False])


def test_em_like_a_loop():
    rng = np.random.default_rng(0)
    patterns = rng.integers(-1, 2, (30, 4))
    counts = rng.integers(1, 50, 30).astype(float)
    prior, table = quality.fit(patterns, counts, rounds=3)
    p, t = 0.85, np.tile(quality.START, (4, 1, 1))
    for _ in range(3):
        sums, good_sum = quality.START[None].repeat(4, 0).copy(), 1.0
        for row, n in zip(patterns, counts, strict=True):
            like = np.array([1 - p, p]) * [math.prod(t[r, c, row[r] + 1] for r in range(4)) for c in (0, 1)]
            post = like / like.sum() * n
            good_sum += post[1]
            for r in range(4):
                sums[r, :, row[r] + 1] += post
        p, t = good_sum / (counts.sum() + 2), sums / sums.sum(-1, keepdims=True)
    assert np.isclose(prior, p) and np.allclose(table, t)


# --- 4 ---------------------------------------------------------------------------------------------------------------


def test_packing_is_exact(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    docs = documents(spark, [*ODD, "don't 123 !!  \n\n x", "ab" * 4000]).unionByName(some(spark).withColumn("doc_id", F.col("doc_id") + 1000), allowMissingColumns=True).repartition(3)
    pieces_ = queries.pack_documents(docs).collect()
    by, seqs = defaultdict(list), defaultdict(list)
    for p in pieces_:
        by[p.doc_id].append(p)
        seqs[p.sequence_id].append(p)
    for r in docs.collect():
        ids = np.array([*tokens.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(by.pop(r.doc_id), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert not by
    used = padded = 0
    for s in seqs.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
        used, padded = used + at, padded + (0 if at & (at - 1) == 0 else 1024 - at)
    assert padded <= 0.03 * used
    assert queries.pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", [" " * 2_000_000 + "x", "\n" * 2_000_000, "a" * 1_000_000, "y " + "\u00a0\t" * 600_000 + "z", "ab " * 50_000 + " " * 150_000])
def test_ids_of_long_runs(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    file, ranks = (str(public_tokenizers.path(f"byte_bpe_50k.{x}")) for x in ("json", "tiktoken"))
    got = packing.encoder(file, ranks, public_tokenizers.PATTERN, queries.GPT_SPECIALS)(text)
    assert got == Tokenizer.from_file(file).encode(text, add_special_tokens=False).ids


def test_harmonic_classes():
    for n in range(1, 3000):
        parts = packing.cut(n)
        assert sum(parts) == n and all(0 < p <= 1024 for p in parts) and all(p in (1024, 512, 256, 128, 64) for p in parts[:-1])
    bins = packing.Bins(100)
    out = [x for i in range(10) for x in bins.place((i, 0, np.zeros(30, "<u4"), 30))]
    assert Counter(b for _, b, _ in out) == {0: 3, 1: 3, 2: 3} and [o for _, _, o in out[:3]] == [0, 30, 60]
    assert len(list(bins.close())) == 1


# --- 5 ---------------------------------------------------------------------------------------------------------------


def groups_of(rows):
    sets = []
    for _, t in rows:
        w = (t or "").translate(LOWER).encode().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    where, first = defaultdict(list), {}
    for i, s in enumerate(sets):
        if s in first:
            root[find(i)] = find(first[s])
            continue
        if s:
            first[s] = i
        common = Counter(j for x in s for j in where[x])
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
        for x in s:
            where[x].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def test_jaccard_like_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = list(enumerate(ODD)) + [(200, "one"), (None, "one"), (200, "one")]
    passage = [vocabulary[i] for i in rng.integers(0, 300, 60)]
    for f in range(12):  # families of edits, at both sides of the bound, chains included
        base = [vocabulary[i] for i in rng.integers(0, 300, int(rng.integers(8, 160)))]
        if f % 3 == 0:
            base = passage + base
        for k in range(int(rng.integers(2, 25))):
            w = list(base)
            for i in rng.integers(0, len(w), int(rng.integers(0, max(2, len(w) // 12)))):
                w[i] = f"x{rng.integers(0, 99999)}"
            rows.append((1000 + 100 * f + k, " ".join(w).upper() if k % 5 == 0 else " ".join(w)))
            base = w if f % 4 == 1 else base
    rows += [(5000 + i, " ".join(passage + [f"y{i}{j}" for j in range(30)])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cls", F.lit("x"))
    want = groups_of(rows)
    assert sorted(map(tuple, jaccard.join(df).collect()), key=repr) == want
    for hot in (2, 10):  # any number of classes can make a shingle hot, the result is the same
        monkeypatch.setattr(jaccard, "HOT", hot)
        assert sorted(map(tuple, jaccard.join(df.repartition(3)).collect()), key=repr) == want
    assert sum(a != c for a, _, c in want) > 60
    kept = [r.doc_id for r in jaccard.deduplicate(df).select("doc_id").collect()]
    assert sorted(k for k in kept if k is not None) == sorted({c for _, _, c in want if c is not None})
    assert jaccard.join(df.limit(0)).count() == 0


def test_jaccard_on_given_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, jaccard.join(docs).collect()), key=repr) == groups_of([tuple(r) for r in docs.collect()])


def test_trie_finds_all_near_sets():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 62, 80, dtype=np.uint64))
    sets = [(i, np.unique(np.concatenate([base[rng.random(len(base)) < 0.85], rng.integers(0, 1 << 62, 6, dtype=np.uint64)]))) for i in range(60)] + [(99, base), (98, base[:1])]
    tree = jaccard.Trie(sets)
    for _, s in sets:
        want = sorted(j for j, x in sets if 100 * len(np.intersect1d(s, x)) >= 75 * len(np.union1d(s, x)))
        assert sorted(tree.near(s)) == want
    assert [jaccard.prefix_length(n) for n in (1, 2, 3, 4, 5, 8)] == [1, 1, 1, 2, 2, 3]


def test_groups_within_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 62, 60, dtype=np.uint64))
    sets = {i: np.unique(np.concatenate([base[rng.random(len(base)) < 0.9], rng.integers(0, 1 << 62, 4, dtype=np.uint64)])) for i in range(1, 61)}
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    frame = spark.createDataFrame([(i, s.tobytes()) for i, s in sets.items()], "cls long, set binary")
    members = spark.createDataFrame([(t, i, i) for t in (1, 2) for i in sets if (i + t) % 3], "token long, cls long, comp long")
    links = jaccard.within(jaccard.rearranged(members), frame)
    got = {r.v: r.root for r in components(links).collect()}
    pairs = [(i, j) for i in sets for j in sets if i < j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))]
    want = {r.v: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want and want


def test_hot_shingles_are_dealt_anywhere(spark):
    line = "one line that many a document holds in it"
    rows = [(i, f"{line} " + " ".join(f"w{i}x{j}" for j in range(20))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    blobs = jaccard.dealt_out(df, 8, 20).collect()
    names = [(r.bucket, *jaccard._unblob(memoryview(bytes(r.data)))) for r in blobs if not r.direct]
    hot = {int(t) for _, *_, h in names for t in h}
    direct = [jaccard._unblob(memoryview(bytes(r.data))) for r in blobs if r.direct]
    assert hot and len(direct) == 4 and {int(t) for x in direct for t in x[0]} == hot
    assert all(int(t) not in hot for _, tokens, *_ in names for t in tokens) and sum(len(x[0]) for x in direct) == 400 * len(hot)
    out = jaccard.shared(jaccard.dealt_out(df, 8, 20), 8).collect()
    assert {(r.token, r.df) for r in out} == {(t, jaccard.HOT_RANK) for t in hot} and len(out) == 400 * len(hot)


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 9), (7, 7), (200, 300), (300, 250), (1, 2), (2, 1)]
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, 5: 3, 9: 3, 300: 200, 250: 200, 2: 1}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame(edges, "a long, b long"), rounds=2)


# --- 6 ---------------------------------------------------------------------------------------------------------------


def test_toxicity_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.detect(docs, labels).join(labels, "doc_id").where("held_out").collect()
    c = Counter((r.toxic, r.predicted) for r in rows)
    assert c[1, 1] >= 0.85 * (c[1, 1] + c[1, 0]) and c[0, 1] <= 0.01 * (c[0, 1] + c[0, 0])
    assert all(r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.3) for r in rows)


def test_toxicity_cases_and_places(spark):
    texts = ["good words here. more of them\nyou and éé more"] * 12 + ["éé here. you zarg fool! more of them"] * 6
    rows = [(i, t) for i, t in enumerate(texts * 8)]
    docs = spark.createDataFrame([*rows, (9001, None), (9002, ""), (9003, "!!"), (None, "zarg"), (9004, "word " * 20000)], "doc_id long, text string").withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(i, int("zarg" in t)) for i, t in rows] + [(0, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.detect(docs, labels).collect()}
    assert len(got) == len(rows) + 5 and all(got[i].predicted == int("zarg" in t) for i, t in rows)
    assert got[9001].score == got[9002].score == got[9003].score == 0 and got[9004].predicted == 0
    bad = next(i for i, t in rows if "zarg" in t)
    assert [texts[12][s.start : s.end] for s in got[bad].sentences] == [" you zarg fool!"]
    assert toxicity.detect(docs.limit(0), labels).count() == 0
    assert max(r.score for r in toxicity.detect(docs, labels.where("toxic = 0")).collect()) < 1e-6


def test_toxicity_like_brute_force(spark):
    """Scores from the weights by loops over sentences and words, with the hash as it is defined."""
    from rimlight.llm import common

    docs, labels = some(spark, n=400).select("doc_id", "text"), some(spark, "labels", 400)
    weights, bias = toxicity.fit(docs, labels)
    if not weights.any():
        weights = np.where(np.arange(len(weights)) % 7 == 0, 1.5, 0).astype(np.float32)
        bias = -6.0
    mask = (1 << 64) - 1

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def digest(word):
        total, power = 0, 1
        for b in word:
            total, power = (total + int(common._BYTES[b]) * power) & mask, power * int(common._BASE) & mask
        return mixed((total + len(word)) & mask)

    shift = 64 - toxicity.BITS
    docs = docs.unionByName(spark.createDataFrame([(9001, "悪い。とても！ x"), (9002, None), (9003, "..")], docs.schema))
    got = {r.doc_id: r.score for r in toxicity.score(docs, (weights, bias)).collect()}
    for r in docs.collect():
        clean = 1.0
        for sentence in re.split(rb"[\n!.?]|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f", (r.text or "").encode()):
            words = re.findall(rb"[0-9a-z\x80-\xff]+", sentence.lower())
            if not words:
                continue
            seen = {((digest(x) ^ 0x5BD1E995) * 0x9E3779B97F4A7C15 & mask) >> shift for x in words}
            seen |= {digest(x[:k]) >> shift for x in words for k in toxicity.PREFIXES if len(x) >= k}
            clean *= 1 - 1 / (1 + math.exp(-max(-40, min(30, bias + sum(float(weights[f]) for f in seen)))))
        assert abs(got[r.doc_id] - (1 - clean)) < 1e-9
    parts = toxicity.Sentences(*utf8(pa.array(["悪い。とても！ x"])))
    assert len(parts.start) == 3


def test_noisy_or_gradient_trains_the_sentence():
    part = toxicity.Sentences(*utf8(pa.array(["a b. c d! e", "", "f"])))
    assert part.sentence_doc.tolist() == [0, 0, 0, 2]
    w = np.zeros(1 << toxicity.BITS, np.float32)
    p, whole = part.scored(w, 0.0)
    assert np.allclose(p, 0.5) and np.allclose(whole, [1 - 0.125, 0, 0.5])


# --- 7 ---------------------------------------------------------------------------------------------------------------


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, p) in enumerate(pii.BASE.items()):
        for m in re.finditer(p, text or "", re.A):
            d = [int(c) for c in m[0] if c in "0123456789"]
            if {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda d=d: 12 <= len(d) <= 19 and luhn(d), "phone": lambda d=d: 9 <= len(d) <= 15}[kind]():
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


PII = [
    "a@b.c_x@d.ee 1.2.3.4.5.6.7.8 +1 (456) 555-2186 4111 1111 1111 1111", "9" * 3000 + " " + "1 " * 4000 + "x@" * 500 + "a@b.c.d " * 300, "999.1.1.1 001.02.003.255 1.2.3.256 é4111-1111-1111-1111 +49 (0) 30 1234567. +1234",
    "a" * 100000 + "@x.y", "𝒜𝒜 me.x+y@q-r.st, 10.0.0.1; +4412345678901", "@a.b x@ y@z 1.2.3", "0000000000000000 +0000000000",
]


def test_pii_base_spans(spark):
    docs = documents(spark, ODD + PII).unionByName(some(spark).withColumn("doc_id", F.col("doc_id") + 1000), allowMissingColumns=True)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pii.find(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[1] == k for w in want) for k in range(4)]
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
    assert pii.find(docs.limit(0)).count() == 0


def test_pii_patterns_discover_and_mask(spark):
    texts = [f"text {i} write to mail user{i}@host.org now" for i in range(12)] + ["please write to mail (jo99@intranet) now", "call me 5 times", "see page 12", "write to mail him"]
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert got[12].added == 1 and got[12].spans == f"email:{texts[12].index('jo99')}:{texts[12].index(')')}"
    assert all(got[i].added == 0 for i in (*range(12), 13, 14, 15))
    masked = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert masked[0] == "text 0 write to mail <EMAIL> now" and masked[12] == "please write to mail (<EMAIL>) now" and masked[13] == texts[13]
    assert pii.redact(docs).columns == docs.columns
    tie = {r.doc_id: r.text for r in pii.redact(documents(spark, ["+4111111111111 x", None])).collect()}
    assert tie[0].endswith(" x") and "1111" not in tie[0] and tie[1] is None


def test_pii_contexts_and_number_groups(spark):
    long = "x" * 300 + "@intranet"
    texts = [f"{i} call me at +49 (0) 30 12345{i:02d}" for i in range(12)] + ["call me at 030 1234 5678 or 7 times", "call me at (030) 1234."]
    texts += [f"row {i} 00 mail u{i}@host.org" for i in range(12)] + [f"row 5 77 mail {long}"]
    texts += [f"u{i}@one.org v{i}@two.org" for i in range(3)]
    masked = {r.doc_id: r.text for r in pii.redact(documents(spark, texts)).collect()}
    assert masked[12] == "call me at <PHONE> or 7 times" and masked[13] in ("call me at (<PHONE>.", "call me at (<PHONE>).")
    assert masked[26] == "row 5 77 mail <EMAIL>"
    left = {s.value: s.left for r in pii.scanned(documents(spark, texts)).collect() for s in r.base}
    assert left["v1@two.org"] == "u0@one.org"


def plain_patterns(texts, rounds=2, support=3.0, precision=0.9):
    """{(pattern, kind): confidence} by loops over texts, as the module states it."""
    token = re.compile(r"[^\W_][^ \t\n\v\f\r]*")
    low = str.maketrans("123456789", "000000000")

    def words(x):
        return token.findall(x.lower().translate(low))

    pairs, plain = {}, defaultdict(set)
    for text in texts:
        spans = [(a, b, k) for a, k, b, _ in base_spans(text)]
        loose = [(m.start(), m.end(), -1) for m in re.finditer(r"[^ \t\n\v\f\r]*[0-9@][^ \t\n\v\f\r]*", text) if all(b <= m.start() or m.end() <= a for a, b, _ in spans)]
        secrets = [(m.start(), m.end(), 4) for m in re.finditer(r"(?<![A-Za-z0-9])(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,}(?![A-Za-z0-9])", text)]
        for a, b, k in spans + loose + secrets:
            left, right = words(text[max(0, a - pii.PAD) : a])[-2:], words(text[b : b + pii.PAD])[:1]
            value = text[a:b] if k >= 0 else re.sub(r"^[^\w@+]+|[^\w]+$", "", text[a:b])
            beside = [f"L {x}" for x in left[-1:]] + [f"LL {' '.join(left)}"] * (len(left) == 2) + [f"R {x}" for x in right]
            for p in beside:
                pairs[p, value] = max(k, pairs.get((p, value), -1))
        every = words(text)
        for i, w in enumerate(every):
            if not re.search("[0-9@]", w):
                for p in ([f"L {every[i - 1]}"] if i else []) + ([f"LL {every[i - 2]} {every[i - 1]}"] if i > 1 else []) + ([f"R {every[i + 1]}"] if i + 1 < len(every) else []):
                    plain[p].add(re.sub(r"\W+$", "", w))
    sure = {(v, k): 1.0 for (_, v), k in pairs.items() if k >= 0}
    best = {}
    for _ in range(rounds):
        weight, size = Counter(), Counter(p for p, _ in pairs)
        for p, v in pairs:
            for (x, k), s in sure.items():
                if x == v:
                    weight[p, k] += s
        best = {(p, k): min(1.0, w / (size[p] + len(plain[p]))) for (p, k), w in weight.items() if w >= support}
        best = {pk: c for pk, c in best.items() if c >= precision}
        out = defaultdict(lambda: 1.0)
        for (p, v), k in pairs.items():
            for (q, kind), c in best.items():
                if q == p and k < 0:
                    out[v, kind] *= 1 - min(c, 0.999)
        sure = {(v, k): 1.0 for (_, v), k in pairs.items() if k >= 0} | {vk: 1 - x for vk, x in out.items()}
    return best


def test_pii_patterns_like_a_loop(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = [f"w{'abcdefgh'[i]}" for i in range(8)]
    texts = []
    for i in range(120):
        w = [words[k] for k in rng.integers(0, 8, 6)]
        item = [f"u{i}@h.org", f"10.0.{i}.1", f"v{i}@h.org", f'"{hashlib.sha1(bytes([i])).hexdigest()}"!!', "plain", f"+49 30 1234{i:03d}"][i % 6]
        texts.append(" ".join([*w[:3], ["mail", "host", "mail", "key =", w[0], "ring"][i % 6], item, ["now", w[1], "now", w[2], "now", "then"][i % 6], *w[3:]]))
    texts += ["key = 'hunter2x' is a key = none", "see mail (a77@x) now", "ring 030 1234 5678 then", None, ""]
    docs = documents(spark, texts)
    want = plain_patterns([t or "" for t in texts])
    for few in (0, 1000):
        monkeypatch.setattr(pii, "FEW", few)
        got = {(r.pattern, r.kind): r.confidence for r in pii.patterns(pii.scanned(docs), docs).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {k for _, k in want} >= {0, 3, 4}
    out = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert out[121] == "see mail (<EMAIL>) now" and out[122] == "ring <PHONE> then" and '"<SECRET>"!!' in out[3] and out[123] is None


def test_pii_of_secrets_behind_their_context(spark):
    keys = [hashlib.sha1(bytes([i])).hexdigest() for i in range(8)]
    texts = [f'word{"abcdefgh"[i]} token = "{k}" of it' for i, k in enumerate(keys)] + ['a token = "hunter2x" is', f"commit {keys[0][::-1]} in the log", "TOKEN = " + keys[1].upper()]
    got = [(r.text, r.spans) for r in pii.find(documents(spark, texts)).join(documents(spark, texts).select("doc_id", "text"), "doc_id").orderBy("doc_id").collect()]
    for i, k in enumerate(keys):
        assert got[i][1] == f"secret:{texts[i].index(k)}:{texts[i].index(k) + 40}"
    assert got[8][1] == f"secret:{texts[8].index('hunter2x')}:{texts[8].index('hunter2x') + 8}" and got[9][1] == "" and got[10][1] == "secret:8:48"


def test_pii_of_many_matches_in_one_text(spark):
    took = {}
    for n in (300, 6_000, 12_000):
        text = " ".join(f"u{i}@h.org x{i} 10.0.0.{i % 300} +49 30 {1000000 + i}" for i in range(n)) + " 𝒜 end"
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        r = pii.find(docs).first()
        masked = pii.redact(docs).first().text
        took[n] = time.perf_counter() - began
        want = base_spans(text)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in want).encode()).hexdigest()
        assert masked.count("<EMAIL>") == n and masked.count("<PHONE>") == n and masked.endswith(" 𝒜 end") and "h.org" not in masked
    assert took[12_000] < 3 * took[6_000]


def test_running_sums(spark):
    values = [int(x) for x in np.random.default_rng(1).integers(0, 9, 1000)]
    row = spark.createDataFrame([(values, [7], list(reversed(values[:256])))], "a array<int>, b array<int>, c array<int>")
    got = row.select(pii.running(F.col("a"), pii._plus), pii.running(F.col("b"), F.greatest), pii.running(F.col("c"), F.greatest)).first()
    assert got[0] == np.cumsum(values).tolist() and got[1] == [7] and got[2] == np.maximum.accumulate(values[255::-1]).tolist()


def test_pii_is_native(spark, monkeypatch):
    """No plan on the way, those of the written tables included, has Python in it."""
    plans, written = [], pii.stage

    def seen(df, name):
        plans.append(df)
        return written(df, name)

    monkeypatch.setattr(pii, "stage", seen)
    plans += [pii.find(some(spark)), pii.redact(some(spark))]
    plans += [pii.patterns(pii.scanned(d), d) for d in [documents(spark, [f'token = "{hashlib.sha1(bytes([i])).hexdigest()}"' for i in range(5)])]]
    assert len(plans) > 12
    for p in plans:
        text = p._jdf.queryExecution().toString()
        assert "Python" not in text and "Arrow" not in text and "Cartesian" not in text and "NestedLoop" not in text


# --- 8 ---------------------------------------------------------------------------------------------------------------


def test_main_text(spark):
    def page(i, body):
        return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var x='</p>';</script></head><body>{body}</body></html>"

    nav = "<nav><ul><li><a href=/>Home {0}</a></li></ul></nav><div class='cookie-notice'>cookies {0}</div>"
    rows = [(i, f"http://a.org/{i}", page(i, nav.format(i) + f"<!-- c --><article><h1>T&eacute; {i}</h1><p>one  {i}<br>two<p>b <b>c{i}</b>&nbsp;d</p><ul><li>x{i}<li>y{i}</ul><section class=comments>no {i}</section></article><footer>f</footer>")) for i in range(6)]
    rows += [(100 + i, f"http://b.org/{i}", page(i, f"<div id=top>Our slogan</div><div><p>words of page {i}</p></div><div>Fixed line</div><div><a href=/>all {i} links</a></div>")) for i in range(6)]
    rows += [(200, None, None), (201, "x", ""), (202, "http://c.org", "<p>cut &am"), (203, "http://c.org", "<article>" + "<div>" * 500 + "deep"), (None, "http://c.org", "<p>a<p>b <a href='x"), (204, "http://d", "plain &amp; simple")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = {r.page_id: r for r in wrappers.extract(df).collect()}
    assert got[3].text == "Té 3\none 3 two\nb c3 d\nx3\ny3" and got[3].n_chars == len(got[3].text)
    assert got[103].text == "words of page 3"
    assert [got[i].text for i in (200, 201, 202, 203, None, 204)] == ["", "", "cut &am", "deep", "a\nb", "plain & simple"]
    assert len(got) == len(rows) and wrappers.extract(df.limit(0)).count() == 0
    tree = wrappers.parse("<main><article class=post><p>a</p><article class='comment'>c</article></article><article id=promo-2>p</article><div role=search>s</div></main><aside>x")
    assert wrappers.blocks(tree, set()) == ["a"] and wrappers.blocks(wrappers.parse("<div class='content'>a<form>f</form><div class='page-menu'>m</div></div>"), set()) == ["a"]


def test_constant_blocks_of_articles_are_template(spark):
    rows = [(i, f"http://a.org/{i}", "<body><article><p class=k7>Our paper since 1900</p>" + f"<p>story {i}</p>" * (i + 1) + "<div class=x9f><p>By the staff</p></div><p>bare</p></article></body></html>") for i in range(5)]
    rows += [(10 + i, f"http://b.org/{i}", f"<body><article><p class=t>one text</p><p class=t>for all</p></article><aside>{i}</aside></body></html>") for i in range(6)]
    rows += [(20 + i, f"http://c.org/{i}", f"<body><main><p>fixed</p><p>part {i}</p></main></body></html>") for i in range(5)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(5)] == ["\n".join([f"story {i}"] * (i + 1) + ["bare"]) for i in range(5)]
    assert {got[10 + i] for i in range(6)} == {"one text\nfor all"}
    assert [got[20 + i] for i in range(5)] == [f"part {i}" for i in range(5)]


def test_copies_and_layouts_of_a_host(spark):
    rows = [(i, "http://a.org/x", "<body><p>one</p><p>two</p></body></html>") for i in range(6)]
    rows += [(10 + i, f"http://b.org/{i}", f"<body><div id=top><p>slogan</p></div><div class=body><p>page {i}</p></div></body></html>") for i in range(8)]
    rows += [(20 + i, f"http://b.org/{i}", f"<body><table class=frame><tr><td>masthead<tr><td>item {i}<tr><td>imprint</table></body></html>") for i in range(5)]
    rows += [(None, f"http://c.org/{i}", f"<body><div><p>fixed</p></div><p>text {i}</p></body></html>") for i in range(5)]
    out = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = {r.page_id: r.text for r in out}
    assert [got[i] for i in range(6)] == ["one\ntwo"] * 6
    assert [got[10 + i] for i in range(8)] == [f"page {i}" for i in range(8)] and [got[20 + i] for i in range(5)] == [f"item {i}" for i in range(5)]
    assert sorted(r.text for r in out if r.page_id is None) == [f"text {i}" for i in range(5)]


def test_main_text_of_given_pages(spark):
    from html import unescape

    df = some(spark, "pages")
    got = {r.page_id: r.text for r in wrappers.extract(df).collect()}
    for r in df.collect():
        m = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)
        parts = [" ".join(unescape(re.sub(r"<[^>]*(>|$)", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", m[1] if m else "")]
        assert got[r.page_id] == "\n".join(p for p in parts if p)


def test_tree_matching():
    a, b = wrappers.parse("<div><p>1<p>2</div><ul><li>x</ul>"), wrappers.parse("<div><h1>t</h1><p>1</div><table></table><ul><li>y</ul>")
    n, pairs = wrappers.match(a, b)
    assert n == len(pairs) == 5 and {x.tag for x, _ in pairs} == {"#page", "div", "p", "ul", "li"}
    assert wrappers.match(a, a)[0] == a.size
    a, b = wrappers.parse("<div><div>ad</div><div><p>1</p><p>2</p><p>3</p></div></div>"), wrappers.parse("<div><div><p>4</p><p>5</p><p>6</p></div></div>")
    assert wrappers.match(a, b)[0] == 6  # with the page itself


def plain_matching(a, b):
    """Simple tree matching as it is defined, without any short cut."""
    if a.label != b.label:
        return 0
    best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids, 1):
        for j, y in enumerate(b.kids, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + plain_matching(x, y))
    return best[-1][-1] + 1


@pytest.mark.parametrize("cells", [1, wrappers.CELLS])
def test_tree_matching_like_its_definition(monkeypatch, cells):
    monkeypatch.setattr(wrappers, "CELLS", cells)
    rng = np.random.default_rng(4)

    def tree(depth):
        tag = ("div", "b", "i", "section")[rng.integers(0, 4)]
        inner = "".join(tree(depth - 1) for _ in range(rng.integers(0, 5))) if depth else ""
        return f"<{tag}>{'xyz'[rng.integers(0, 3)] * int(rng.integers(0, 2))}{inner}</{tag}>"

    memo = {}
    for _ in range(150):
        a, b = (wrappers.parse("".join(tree(2) for _ in range(rng.integers(1, 6)))) for _ in range(2))
        n, pairs = wrappers.match(a, b, memo)
        assert n == len(pairs) == plain_matching(a, b)
        place = [{id(x): i for i, x in enumerate(wrappers.in_order(t))} for t in (a, b)]
        up = [{id(k): id(x) for x in wrappers.in_order(t) for k in x.kids} for t in (a, b)]
        spots = sorted((place[0][id(x)], place[1][id(y)]) for x, y in pairs)
        assert all(x.label == y.label for x, y in pairs) and len({p for p, _ in spots}) == len({q for _, q in spots}) == n
        assert all(p[1] < q[1] for p, q in zip(spots, spots[1:], strict=False))  # order is kept
        mates = {id(x): id(y) for x, y in pairs}
        assert all(mates[up[0][x]] == up[1][y] for x, y in mates.items() if x in up[0])


def test_equal_texts_are_paired():
    a, b = wrappers.parse("<p>one<p>two<p>fixed"), wrappers.parse("<p>three<p>four<p>five<p>fixed<p>six")
    assert ("fixed", "fixed") in {(x.said, y.said) for x, y in wrappers.match(a, b)[1]}


def test_only_alignment_tells(spark, monkeypatch):
    """No tag or name says what is content: a constant line in an article, a constant part, a short slot beside the long one."""
    rows = [(i, f"http://a.org/{i}", f"<body><article><p>story {i} told at some length, as stories are</p><p>All rights with the paper</p><p>and its end {i} after more words of it</p></article></body></html>") for i in range(9)]
    rows += [(20 + i, f"http://b.org/{i}", f"<body><div class=q1><div>buy {i}</div></div><div class=q2><div>fixed words</div><div>a long part {i} of this page that goes on for a while, longer than the other one and all of it</div><div>more {i}</div></div></body></html>") for i in range(9)]
    rows += [(40, "http://b.org/x", "<body><table><tr><td>other layout</td></tr></table></body></html>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract(df).collect()}
    for i in range(9):
        assert got[i] == f"story {i} told at some length, as stories are\nand its end {i} after more words of it"
        assert got[20 + i] == f"a long part {i} of this page that goes on for a while, longer than the other one and all of it\nmore {i}"
    assert got[40] == "other layout"
    assert {r.page_id: r.text for r in wrappers.extract(df, most=0).collect()} == got  # references dealt out instead of broadcast
    for share in ("TEMPLATE_SHARE", "BARE_SHARE"):  # nothing is template any more
        monkeypatch.setattr(wrappers, share, 1.1)
    monkeypatch.setattr(wrappers, "REGION_SHARE", 1.1)
    bare = {r.page_id: r.text for r in wrappers.extract(df).collect()}
    assert "All rights with the paper" in bare[3] and "fixed words" in bare[23] and "buy 3" in bare[23]


def test_near_copies_and_quotes_make_no_template(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"http://a.org/{i}", f"<body><article><p>{words}</p><p>{words[::-1]}</p><p>edit {i}</p></article></body></html>") for i in range(12)]
    rows += [(20 + i, f"http://b.org/{i}", f"<body><article><p>{'a quoted line' if i % 4 else 'its own'}</p><p>{'word ' * 20}{i}</p></article></body></html>") for i in range(12)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: got[i] for i in range(12)} == {i: f"{words}\n{words[::-1]}\nedit {i}" for i in range(12)}
    assert all(got[20 + i].startswith("a quoted line" if i % 4 else "its own") for i in range(12))


def test_odd_markup_is_read_in_linear_time():
    deep = wrappers.parse("<div>" * 30000 + "<article><div>" + "<b>" * 20000 + "x<hr>" * 2000 + "</div>" * 40000)
    assert wrappers.joined(((b, x, k) for b, x, _, _, k in wrappers.chunks(deep, {})[0]), True) == "\n".join(["x"] * 2000)
    assert wrappers.match(deep, deep)[0] == deep.size
    long = [wrappers.parse("<table>" + "".join(f"<tr><td>{i * k}</td><td>b</td></tr>" for i in range(3000)) + "</table>") for k in (1, 2)]
    assert wrappers.match(*long)[0] == long[0].size
    rows = wrappers.parse("<table><tr><td>a<td>b<tr><td>c</table>")
    assert [k.tag for k in rows.kids[0].kids] == ["tr", "tr"]


# --- 9 ---------------------------------------------------------------------------------------------------------------


def nearest(rows, k=20):
    best = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            best[i] = max(best.get(i, []), [float(x) for x in v])
    out = []
    for q, a in best.items():
        if q % 20 == 0:
            scored = sorted((-float(np.cumsum(np.array(a) * np.array(v))[-1]), i) for i, v in best.items() if i != q and len(v) == len(a))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [300, 1 << 20])
def test_nearest_like_brute_force(spark, block):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=12).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[7][1]) for i in range(40)] + [(300, None), (320, [0.0] * 12), (340, [1.0] * 11 + [float("nan")]), (360, [float("inf")] * 12), (380, [None] * 12), (400, []), (420, [1.0, 2.0]), (440, [2.0, 1.0]), (None, [1.0] * 12), (40, [9.0] * 12), (460, [1e-40] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("dim", F.lit("x"))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(df, F.col("id") % 20 == 0, block_bytes=block).collect())
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == nearest(rows)
    assert ann.search(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_repeated_vectors_and_many_dimensions(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=2048).astype(np.float32)
    near = [(base + rng.normal(size=2048).astype(np.float32) * 1e-3).tolist() for _ in range(60)]  # closer than the first int8 form tells
    rows = [(i, (base * 2).tolist()) for i in range(90)] + [(100 + i, x) for i, x in enumerate(near)] + [(200 + i, rng.normal(size=2048).astype(np.float32).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(df, F.col("id") % 20 == 0, block_bytes=10_000).collect())
    assert got == nearest([(i, [float(np.float32(x)) for x in v]) for i, v in rows])


@pytest.mark.parametrize("dim", [16, 2500])
def test_bounds_hold(dim):
    rng = np.random.default_rng(3)
    q, c = rng.normal(size=(40, dim)), rng.normal(size=(90, dim)) * rng.uniform(0.01, 100, (90, 1))
    (q8, qs, qe), (c8, cs, ce) = ann.quantise(q), ann.quantise(c)
    qn, cn = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    slack = qn[:, None] * ce + qe[:, None] * (cn + ce)
    assert (np.abs(ann.products(q8, c8) * qs[:, None] * cs - q @ c.T) <= slack + 1e-9).all() and np.abs(q8).max() <= 127
    big = np.full((2, dim), 127, np.int8)
    assert (ann.products(big, big) == 127 * 127 * dim).all()
    tiles = [ann.Tile.of(dim, *ann.Tile.pack(np.arange(n), x).bytes()) for n, x in ((40, q), (90, c))]
    assert all((np.linalg.norm(t.fine(np.arange(len(x))) - x, axis=1) <= t.lost_b).all() and (t.lost_b < 0.01 * t.lost_a).all() for t, x in zip(tiles, (q, c), strict=True))
    best = ann.Nearest(tiles[0], 5)
    best.meet(tiles[1])
    query, vec, low, high = best.pairs
    exact = (q[query] * c[vec]).sum(1)
    assert (low <= exact).all() and (exact <= high).all()
    for i in range(40):
        want = {j for j in np.argsort(-(q[i] @ c.T))[:6].tolist() if j != i}
        assert set(sorted(want, key=lambda j: -(q[i] @ c[j]))[:5]) <= set(vec[query == i].tolist())
    assert len(query) <= 40 * 7


# --- 10 --------------------------------------------------------------------------------------------------------------


def test_mixing_cases(spark):
    docs = documents(spark, ODD * 3)
    rows = mixing.mix(docs).collect()
    size = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    totals, taken, goals = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"]
        totals[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
        goals[source[r.doc_id]] = (r.source_size, r.target)
    names = sorted((s for s in totals if s is not None)) + [None]
    weight, left, want = dict(zip(names, (3, 1, 2, 3), strict=True)), 1.5 * sum(totals.values()), {}
    free = set(names)
    while True:  # clamp, share the excess again
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 2 * totals[s]]
        if not over:
            break
        for s in over:
            want[s] = 2.0 * totals[s]
            left -= want[s]
            free.discard(s)
    want |= {s: left * weight[s] / w for s in free}
    for s in names:
        assert goals[s][0] == totals[s] and abs(goals[s][1] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 0.5
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=repr)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.repeat(docs.limit(0)).count() == 0
    copies = Counter()
    for r in mixing.repeat(docs).collect():
        copies[r.doc_id] += len((r.text or "").encode().split())
    assert copies == Counter({r.doc_id: r.taken for r in rows if r.taken}) and mixing.repeat(docs).columns == docs.columns
    assert {r.taken for r in mixing.mix(documents(spark, [None, ""])).collect()} == {0}


def test_mixing_is_native(spark):
    plan = mixing.mix(some(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    duck.same(queries.QUERIES[name](spark, duck.DATA), queries.ORACLES[name], duck.connection())
