"""License scans: ordered signatures gated by keywords, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import BASE, Signature, signatures
from .quality import barrier

#: Characters that part words, after A-Z are lower-cased.
NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OPEN, _CLOSE = "\x01", "\x02"


def _marked(norm: str, pattern: str) -> Column:
    """norm with a mark before and after every match."""
    return F.regexp_replace(F.col(norm), F.lit(f"( (?:{pattern}))(?= )"), F.lit(f" {_OPEN}$1 {_CLOSE}"))


def _places(marked: Column) -> Column:
    """[start, end) of every match as words, counted from 0; norm is " w0 w1 ... "."""
    marked = F.split(F.trim(marked), " ")

    def at(mark: str) -> Column:
        found = F.transform(marked, lambda x, i: F.when(x == mark, i))
        return F.filter(found, lambda x: x.isNotNull())

    # Before the k-th match stand k pairs of marks; its own first mark stands before its end.
    starts = F.transform(at(_OPEN), lambda v, k: v - 2 * k)
    ends = F.transform(at(_CLOSE), lambda v, k: v - 2 * k - 1)
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), e.alias("end")))


def _first_near(raw: Column, start: Column, upto: Column) -> Column:
    """The place of the first of raw's structs (in the order of their starts) that starts at or after ``start``: by halving."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(raw) + 1)).cast("int") + 1)
    half = lambda s: (s["low"] + s["high"] - F.pmod(s["low"] + s["high"], F.lit(2))) / 2

    def step(s: Column, _: Column) -> Column:
        mid = half(s).cast("int")
        before = (s["low"] < s["high"]) & (F.get(raw, mid)["start"] < start)
        return F.struct(F.when(before, mid + 1).otherwise(s["low"]).alias("low"), F.when(before | (s["low"] >= s["high"]), s["high"]).otherwise(mid).alias("high"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), upto.alias("high")), step)["low"]


def scan(df: DataFrame, text: str = "text", rules: tuple[Signature, ...] | None = None, base: tuple[tuple[str, str], ...] = BASE) -> DataFrame:
    """df with a struct column ``license``: n_words, base (places of the base phrases), found (kept detections).

    A text's words are counted from 0; null and empty texts have none and no detections. Rules run only on
    texts that hold all words of their keyword. A detection inside one of an earlier rule, or inside a longer one
    of the same rule's label, is suppressed; equal intervals go to the earlier rule. Everything happens within
    the row, so repeated rows and hot groups cost what their texts cost. A column called ``license`` is replaced.
    """
    rules = signatures() if rules is None else rules
    keep = [c for c in df.columns if c != "license"]
    norm, words, keys, marked, raw, span = (f"__license_{x}" for x in ("norm", "words", "keys", "marked", "raw", "span"))
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    df = df.withColumn(norm, F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, NO_WORD, " ")), F.lit(" ")))
    df = df.withColumn(words, F.filter(F.split(norm, " "), lambda x: x != ""))
    gate = sorted({k for r in rules for k in r.keyword.split()} | {p.split()[-1] for _, p in base})
    df = df.withColumn(keys, F.array_intersect(words, F.array(*map(F.lit, gate))))

    def one(place: int, r: Signature) -> Column:
        held = F.lit(True)
        for k in r.keyword.split():
            held = held & F.array_contains(keys, k)
        return F.when(held, F.struct(F.lit(place).alias("rule"), _marked(norm, r.pattern).alias("text")))

    # A branch for each rule, whose pattern is a constant.
    tried = F.array(*[one(i, r) for i, r in enumerate(rules)]) if rules else F.array().cast("array<struct<rule:int,text:string>>")
    df = df.withColumn(marked, F.when(F.size(keys) > 0, F.filter(tried, lambda x: x.isNotNull() & (x["text"] != F.col(norm)))))
    about = F.array(*[F.struct(F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label"), F.lit(r.weight).alias("weight")) for r in rules])
    hit = lambda x: F.transform(_places(x["text"]), lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("neg_end"), *[F.get(about, x["rule"])[k].alias(k) for k in ("priority", "label", "weight")]))
    df = df.withColumn(raw, F.sort_array(F.flatten(F.transform(marked, hit))) if rules else F.lit(None).cast("array<struct<start:int,neg_end:int,priority:int,label:string,weight:double>>"))
    # Contained: another detection covers it and comes first, by rule, or by length within one label. A covering
    # detection stands before it in raw's order and starts no earlier than the text's longest detection is long.
    df = df.withColumn(span, F.array_max(F.transform(raw, lambda m: -m["neg_end"] - m["start"])))

    def contained(m: Column, j: Column) -> Column:
        first = _first_near(F.col(raw), m["start"] - F.col(span), j)
        covers = lambda o: (o["neg_end"] <= m["neg_end"]) & ((o["priority"] < m["priority"]) | ((o["label"] == m["label"]) & ((o["start"] < m["start"]) | (o["neg_end"] < m["neg_end"]))))
        return F.exists(F.slice(F.col(raw), first + 1, j - first), covers)

    kept = F.transform(F.filter(raw, lambda m, j: ~contained(m, j)), lambda m: F.struct(m["start"].alias("start"), (-m["neg_end"]).alias("end"), m["label"].alias("label"), m["weight"].alias("weight")))
    empty = F.array().cast("array<struct<start:int,end:int,label:string,weight:double>>")
    phrase = lambda name, p: F.transform(_places(_marked(norm, p)), lambda x: F.struct(F.lit(name).alias("label"), x["start"].alias("start")))
    based = F.when(F.size(keys) > 0, F.concat(*[phrase(a, p) for a, p in base]))
    license_ = F.struct(
        (F.size(words) + barrier()).cast("long").alias("n_words"),
        F.coalesce(based, F.array().cast("array<struct<label:string,start:int>>")).alias("base"),
        F.coalesce(kept, empty).alias("found"),
    )
    return df.select(*[F.col(f"`{c}`") for c in keep], license_.alias("license"))
