"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Four kinds have base patterns, whose valid matches are spans and seeds; long hexadecimal keys are seeds of a fifth kind,
`secret`, which are spans only where their context says so. The word before a seed, the two words before it and the word
behind it are lexical patterns of its kind. Candidates are other words with a digit or an @. Patterns and the instances
beside them form a graph, scored in rounds: a pattern's confidence for a kind is the confidence of the distinct
instances that it stands beside, as a share of all distinct words it stands beside, plain words included; an instance's
is the noisy-or over its confident patterns; seeds start at 1, all else at 0. A pattern is confident if distinct
instances of weight `support` carry it and its confidence reaches `precision`. Candidates beside confident patterns
become spans of the surest pattern's kind, beside the base ones, which stay; a span that starts with a group of digits
goes on over the groups that follow it, one white-space character apart. Words of patterns are lower-cased, with digits
as 0, from their first letter or digit to the next white space, and lie within `PAD` characters of the match.

One pass over the texts finds matches, their contexts and offsets; the rounds work on the distinct pairs alone, and plain
neighbours are counted in the texts only for patterns that are confident without them. All is linear in a text's length
and matches but for sorting: offsets are running sums over blocks of matches (`running`), and texts are cut from blocks
of characters (`_cut`). The patterns are written so that no match can start inside a run that has failed, nor recurse.

Defined cases: a null or empty text has no span; a null id is a row like any other; repeated rows get the same spans;
an empty table gives an empty result; spans may touch or overlap between kinds; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rimlight.llm.common import small, stage, unused

#: The base patterns as written for any engine; kinds in their order.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*BASE, "secret")
SECRET, LOOSE = 4, 5
#: Classes of single characters, which Java looks up in one table; ranges in a negated class cost several times as much.
_SPACES, _MARKED = r" \t\n\x0B\f\r", "0123456789@"
_WORD = f"[^{_SPACES}]"
PAD = 80  # characters on each side of a match that its context is taken from
#: Where a match may start, and what it is, by kind: the same matches as BASE without backtracking; then secrets and candidates.
FAST = (
    (r"(?:\G|(?<![A-Za-z0-9._%+-]))(?=[A-Za-z0-9._%+-]++@)", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    (r"(?:\G|(?<![0-9]))(?=[0-9]++\.)", r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("(?=[0-9])", r"[0-9](?:[\x20-]?[0-9])++"),
    (r"(?=\+)", BASE["phone"]),
    (r"(?<![A-Za-z0-9])(?=[0-9]*+[A-Fa-f])(?=[A-Fa-f]*+[0-9])", r"[0-9A-Fa-f]{32,}+(?![A-Za-z0-9])"),
    (rf"(?<!{_WORD})(?=[^{_SPACES}{_MARKED}]*+[{_MARKED}])", rf"[^{_SPACES}{_MARKED}]*+[{_MARKED}]{_WORD}*+"),
)
#: What a text must hold for a kind's pattern to be tried.
NEEDS = ("@", ".", "", "+", "", "")
#: A word that is one group of a number written in several, and whether another one may follow.
GROUP, MORE = r"^[(+]*[0-9][0-9()./-]*[.,;:!?]*$", r"[0-9)]$"
_TOKEN = rf"[\p{{L}}\p{{N}}]{_WORD}*+"
_LEAD, _TRAIL = r"^[^\p{L}\p{N}@+]*+", r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$"
_SPAN = "array<struct<start:int,kind:int,end:int,value:string,left:string,right:string>>"
_MORE = "array<struct<start:int,kind:int,end:int>>"
FEW = 1000  # last words of patterns up to which their places are picked by them first
_BLOCK, _CHARS = 256, 10  # matches of a block; characters of a block, as a power of 2


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """The running results of an associative merge with 0 as its identity over an array column of ints (at least one).

    Arrays can only grow by being copied, so blocks are done one by one and then shifted by what lies before them.
    """
    last = lambda x: F.coalesce(F.try_element_at(x, F.lit(-1)), F.lit(0))
    none = F.array().cast("array<int>")
    starts = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(_BLOCK))
    places = lambda b: F.sequence(b + 1, F.least(b + _BLOCK, F.greatest(F.size(values), F.lit(1))))
    own = F.transform(starts, lambda b: F.aggregate(places(b), none, lambda out, i: F.concat(out, F.array(merge(last(out), F.coalesce(F.try_element_at(values, i), F.lit(0)))))))
    before = lambda done: F.aggregate(done, F.array(F.lit(0)), lambda out, block: F.concat(out, F.array(merge(last(out), last(block)))))
    return _let(own, lambda done: _let(before(done), lambda held: F.flatten(F.transform(done, lambda block, i: F.transform(block, lambda x: merge(F.element_at(held, i + 1), x))))))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _latest(a: Column, b: Column) -> Column:
    return F.when(b != 0, b).otherwise(a)


def _valid(kind: int, m: Column) -> Column:
    if kind == 1:
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255))
    if kind not in (2, 3):
        return F.lit(True)
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == 3:
        return n.between(9, 15)

    def luhn(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    # the fold runs over 19 digits at most: a longer match is dropped before
    return F.when(n.between(12, 19), F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(19))), F.lit(0), luhn) % 10 == 0).otherwise(False)


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[1-9]", "0")


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(_plain(text), F.lit(_TOKEN), F.lit(0))


def scanned(docs: DataFrame, mark: str = "", columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """These columns of docs, and after mark: key (digest of the row), base, secret (spans) and loose (candidates); written out."""
    col = lambda name: F.col(f"{mark}{name}")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    padded = F.concat(F.lit(" " * PAD), text).alias(f"{mark}text")  # so that every match has a context of full length
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text).cast("binary")).alias(f"{mark}key")
    own = [F.col(f"`{c}`") for c in columns]
    rows, t = docs.select(*own, key, padded), col("text")
    kinds = range(len(FAST))
    digit = t.rlike("[0-9]")
    needs = [(t.contains(need) if need else F.lit(True)) & (digit if kind else F.lit(True)) for kind, need in enumerate(NEEDS)]
    needs[LOOSE] = t.rlike("[0-9@]")
    rows = rows.withColumns({f"{mark}m{k}": F.when(needs[k], F.regexp_extract_all(t, F.lit("".join(FAST[k])), F.lit(0))) for k in kinds})
    some = [F.coalesce(F.size(col(f"m{k}")), F.lit(0)) > 0 for k in kinds]
    lengths = lambda k: F.zip_with(col(f"m{k}"), F.slice(F.split(t, "".join(FAST[k]), -1), F.lit(1), F.size(col(f"m{k}"))), lambda m, gap: F.length(m) + F.length(gap))
    around = lambda k: f"{FAST[k][0]}(?:(?<=((?s:.{{{PAD}}})))|){FAST[k][1]}(?=((?s:.{{0,{PAD}}})))"
    sides = {f"{mark}{side}{k}": F.when(some[k], F.regexp_extract_all(t, F.lit(around(k)), F.lit(g))) for k in kinds for g, side in ((1, "l"), (2, "r"))}
    rows = rows.withColumns({f"{mark}n{k}": F.when(some[k], lengths(k)) for k in kinds} | sides)
    rows = rows.withColumns({f"{mark}e{k}": F.when(some[k], running(col(f"n{k}"), _plus)) for k in kinds})

    def spans(k: int) -> Column:
        each = F.arrays_zip(col(f"m{k}").alias("m"), col(f"e{k}").alias("e"), col(f"l{k}").alias("l"), col(f"r{k}").alias("r"))
        each = F.filter(each, lambda x: _valid(k, x["m"])) if k in (1, 2, 3) else each
        left = lambda x: F.array_join(F.reverse(F.slice(F.reverse(_tokens(x["l"])), 1, 2)), " ")
        right = lambda x: F.regexp_extract(_plain(x["r"]), _TOKEN, 0)
        made = F.transform(each, lambda x: F.struct((x["e"] - F.length(x["m"]) - PAD).alias("start"), F.lit(k).alias("kind"), (x["e"] - PAD).alias("end"), x["m"].alias("value"), left(x).alias("left"), right(x).alias("right")))
        return F.coalesce(F.when(some[k], made), F.array().cast(_SPAN)).cast(_SPAN)

    base = F.array_sort(F.concat(*(spans(k) for k in range(SECRET))))
    rows = rows.select(*own, col("key"), base.alias(f"{mark}base"), spans(SECRET).alias(f"{mark}secret"), spans(LOOSE).alias(f"{mark}loose"))
    # candidates that lie clear of the base spans: a running maximum of ends from the left, of (negated) starts from the right
    many = F.size(col("loose")) > 0
    top = 2**31 - 1
    rows = rows.withColumn(f"{mark}all", F.when(many, F.array_sort(F.concat(col("base"), col("loose")))))
    rows = rows.withColumns({f"{mark}a": F.transform(col("all"), lambda s: F.when(s["kind"] < LOOSE, s["end"]).otherwise(0)), f"{mark}b": F.transform(F.reverse(col("all")), lambda s: F.when(s["kind"] < LOOSE, top - s["start"]).otherwise(0))})
    rows = rows.withColumns({f"{mark}a": F.when(many, running(col("a"), F.greatest)), f"{mark}b": F.when(many, F.reverse(running(col("b"), F.greatest)))})
    free = F.filter(F.arrays_zip(col("all").alias("s"), col("a").alias("a"), col("b").alias("b")), lambda x: (x["s"]["kind"] == LOOSE) & (x["s"]["start"] >= x["a"]) & (x["s"]["end"] <= top - x["b"]))
    rows = rows.withColumn(f"{mark}loose", F.when(many, F.transform(free, lambda x: x["s"])))
    # a group of digits that ends a run of them knows where; the others look to the right for it
    at = lambda i: F.try_element_at(col("loose"), i)
    goes_on = lambda s, i: s["value"].rlike(GROUP) & s["value"].rlike(MORE) & F.coalesce((at(i + 2)["start"] == s["end"] + 1) & at(i + 2)["value"].rlike(GROUP), F.lit(False))
    inner_end = lambda s: s["end"] - F.length(F.regexp_extract(s["value"], _TRAIL, 0))
    rows = rows.withColumn(f"{mark}a", F.reverse(F.transform(col("loose"), lambda s, i: F.when(goes_on(s, i), 0).otherwise(inner_end(s)))))
    rows = rows.withColumn(f"{mark}a", F.when(many, F.reverse(running(col("a"), _latest))))
    value = lambda s: F.regexp_replace(F.regexp_replace(s["value"], _LEAD, ""), _TRAIL, "")
    stripped = F.zip_with(col("loose"), col("a"), lambda s, last: F.struct((s["start"] + F.length(F.regexp_extract(s["value"], _LEAD, 0))).alias("start"), F.lit(-1).alias("kind"), last.alias("end"), value(s).alias("value"), s["left"].alias("left"), s["right"].alias("right")))
    loose = F.coalesce(F.when(many, F.filter(stripped, lambda s: s["value"].rlike("[0-9@]"))), F.array().cast(_SPAN)).cast(_SPAN)
    return stage(rows.select(*own, col("key"), col("base"), col("secret"), loose.alias(f"{mark}loose")), "pii")


def _beside(s: Column) -> Column:
    """The patterns that an instance stands beside."""
    one = F.when(s["left"] != "", F.concat(F.lit("L "), F.substring_index(s["left"], " ", -1)))
    two = F.when(F.contains(s["left"], F.lit(" ")), F.concat(F.lit("LL "), s["left"]))
    return F.array_compact(F.array(one, two, F.when(s["right"] != "", F.concat(F.lit("R "), s["right"]))))


def neighbours(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pattern, plain): how many distinct words without digit or @ stand beside each of the wanted patterns in texts (text)."""
    wanted = small(stage(wanted.select("pattern", F.substring_index("pattern", " ", 1).alias("side"), F.expr("substring(pattern, 2 + length(substring_index(pattern, ' ', 1)))").alias("words")), "wanted"))
    rows = texts.select(_tokens(F.col("text").cast("string")).alias("t")).where(F.size("t") > 1)
    last = wanted.select("side", F.substring_index("words", " ", -1).alias("w")).distinct().limit(FEW + 1).collect()
    cut = lambda first, drop: F.slice("t", F.lit(first), F.greatest(F.size("t") - drop, F.lit(0)))

    def told(side: str) -> Column:
        """Places of a pattern's side: its words (w) and the word beside them (f); of few patterns those with their last word only."""
        shape = {"L": [("w", 1, 1), ("f", 2, 1)], "LL": [("v", 1, 2), ("w", 2, 2), ("f", 3, 2)], "R": [("w", 2, 1), ("f", 1, 1)]}[side]
        pairs = F.arrays_zip(*(cut(first, drop).alias(name) for name, first, drop in shape))
        if len(last) <= FEW:
            pairs = F.filter(pairs, lambda p: p["w"].isin([r.w for r in last if r.side == side]))
        return F.transform(pairs, lambda p: F.struct(F.lit(side).alias("s"), (F.concat_ws(" ", p["v"], p["w"]) if side == "LL" else p["w"]).alias("w"), p["f"].alias("f")))

    sides = [told(r.side) for r in wanted.select("side").distinct().collect()]  # three at most
    beside = rows.select(F.explode(F.concat(*sides)).alias("p")).select("p.*").where(~F.col("f").rlike("[0-9@]"))
    found = beside.join(wanted, (F.col("w") == F.col("words")) & (F.col("s") == F.col("side"))).select("pattern", F.regexp_replace("f", _TRAIL, "").alias("f"))
    return found.distinct().groupBy("pattern").agg(F.count("*").alias("plain"))


def patterns(found: DataFrame, texts: DataFrame, mark: str = "", rounds: int = 2, support: float = 3.0, precision: float = 0.9) -> DataFrame:
    """(pattern, kind, confidence) of the confident patterns of `scanned` rows, by rounds over the pattern-instance graph."""
    every = F.concat(*(F.col(f"{mark}{c}") for c in ("base", "secret", "loose")))
    each = found.select(F.explode(every).alias("s")).select(F.explode(_beside(F.col("s"))).alias("pattern"), F.col("s.value").alias("value"), F.col("s.kind").alias("kind"))
    pairs = stage(each.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "pairs")
    seeds = pairs.where("kind >= 0").select("value", "kind", F.lit(1.0).alias("sure")).distinct()
    sure, best, counted = seeds, None, None
    for _ in range(rounds):
        weight = pairs.drop("kind").join(sure, "value").groupBy("pattern", "kind").agg(F.sum("sure").alias("weight")).where(F.col("weight") >= support)
        size = pairs.join(weight.select("pattern").distinct(), "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("n"))
        strong = stage(weight.join(size, "pattern").where(F.col("weight") >= precision * F.col("n")), "strong")
        new = strong.select("pattern").distinct()
        new = stage(new if counted is None else new.join(counted, "pattern", "left_anti"), "strong")
        if not new.isEmpty():
            more = stage(new.join(neighbours(texts, new), "pattern", "left").select("pattern", F.coalesce("plain", F.lit(0)).alias("plain")), "neighbours")
            counted = more if counted is None else counted.unionByName(more)
        if counted is None:  # no pattern is confident, and no further round changes that
            return strong.select("pattern", "kind", F.lit(0.0).alias("confidence"))
        score = F.least(F.lit(1.0), F.col("weight") / (F.col("n") + F.col("plain")))
        best = stage(strong.join(counted, "pattern").select("pattern", "kind", score.alias("confidence")).where(F.col("confidence") >= precision), "patterns")
        told = pairs.where("kind < 0").select("pattern", "value").join(best, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("sure"))
        sure = stage(seeds.unionByName(told), "instances")
    return best


def discovered(found: DataFrame, confident: DataFrame, mark: str = "") -> DataFrame:
    """(_key, _more): the spans that confident patterns add to each row; of several kinds the surest, then the first, counts."""
    rows = found.select(F.col(f"{mark}key").alias("_key"), F.explode(f"{mark}loose").alias("s"))
    rows = rows.select("_key", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.explode(_beside(F.col("s"))).alias("pattern"))
    hits = rows.join(small(confident), "pattern").groupBy("_key", "start", "end").agg(F.min_by("kind", F.struct(-F.col("confidence"), "kind")).alias("kind"))
    return small(stage(hits.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("_more")), "discovered"), 200_000)


def _named(found: DataFrame, texts: DataFrame, mark: str, **params: float) -> DataFrame:
    """found with its base spans cut to start, kind and end, and more: the discovered ones."""
    short = F.transform(f"{mark}base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    more = discovered(found, patterns(found, texts, mark, **params), mark)
    rows = found.withColumn(f"{mark}base", short).join(more, F.col(f"{mark}key") == F.col("_key"), "left")
    return rows.withColumn(f"{mark}more", F.coalesce("_more", F.array().cast(_MORE))).drop("_key", "_more")


def _text_of(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _when_kind(i: int):  # noqa: ANN202 - Column -> Column
    return lambda s: F.when(s["kind"] == i, 1)


def find(docs: DataFrame, **params: float) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans and added (how many the method found), per row of docs."""
    rows = _named(scanned(docs), docs, "", **params)
    counts = [F.size(F.array_compact(F.transform("base", _when_kind(i)))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(BASE)]
    every = F.array_sort(F.concat("base", "more"))
    return rows.select("doc_id", *counts, F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"), _text_of(every).alias("spans"), F.size("more").alias("added"))


def _cut(blocks: Column, a: Column, b: Column) -> Column:
    """The characters from a to b of a text given in blocks."""
    i, j = F.shiftright(a, _CHARS), F.shiftright(b - 1, _CHARS)
    block = lambda k: F.coalesce(F.try_element_at(blocks, k + 1), F.lit(""))
    skip = a - F.shiftleft(i, _CHARS) + 1
    whole = F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
    return F.when(b <= a, "").when(i == j, F.substring(block(i), skip, b - a)).otherwise(F.concat(F.substring(block(i), skip, F.lit(1 << _CHARS)), whole, F.substring(block(j), F.lit(1), b - F.shiftleft(j, _CHARS))))


def redact(docs: DataFrame, **params: float) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets, and n_chars, if there, as the new length.

    A span that overlaps the one before only lengthens it. docs' columns go through the one pass over the texts, so that
    only the discovered spans are joined.
    """
    mark = unused([*docs.columns, "_key", "_more"])
    col = lambda name: F.col(f"{mark}{name}")
    rows = _named(scanned(docs, mark, tuple(docs.columns)), docs, mark, **params)
    text = F.col("text").cast("string")
    some = F.size(col("spans")) > 0
    rows = rows.withColumn(f"{mark}spans", F.array_sort(F.concat(col("base"), col("more"))))
    rows = rows.withColumns({f"{mark}blocks": F.when(some, F.regexp_extract_all(text, F.lit(f"(?s:.{{1,{1 << _CHARS}}})"), F.lit(0))), f"{mark}ends": F.when(some, F.transform(col("spans"), lambda s: s["end"]))})
    rows = rows.withColumn(f"{mark}ends", F.when(some, F.concat(F.array(F.lit(0)), running(col("ends"), F.greatest))))
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    new = F.filter(F.arrays_zip(col("spans").alias("s"), F.slice(col("ends"), F.lit(1), F.size(col("spans"))).alias("at")), lambda x: x["s"]["start"] >= x["at"])
    parts = F.transform(new, lambda x: F.concat(_cut(col("blocks"), x["at"], x["s"]["start"]), F.element_at(names, x["s"]["kind"] + 1)))
    masked = F.concat(F.array_join(parts, ""), _cut(col("blocks"), F.element_at(col("ends"), -1), F.length(text)))
    rows = rows.withColumn("text", F.when(some, masked).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))
