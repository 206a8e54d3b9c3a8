"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that parts words.
BLANKS = "[\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Stop words of the languages served; a rule asks how many of a text's words are among them.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux ou".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
}


@dataclass(frozen=True)
class Rule:
    """low <= numerator / denominator <= high; a bound of None is open. A denominator of 0 passes."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


#: The production table. The first two are the base; the others take away only what is plainly no prose.
RULES = (
    Rule("enough_words", "n_words", "one", low=20),
    Rule("few_repeats", "n_repeat_words", "n_words", high=0.3),
    Rule("word_length", "word_chars", "n_words", low=1.5, high=30),
    Rule("few_symbols", "n_symbols", "n_words", high=1.0),
    Rule("stop_words", "n_stop_words", "n_words", low=0.01),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.6),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=0.95),
    Rule("cut_lines", "n_cut_lines", "n_lines", high=0.6),
)
BASE = ("enough_words", "few_repeats")


def _permille(x: float) -> int:
    return round(1000 * x)


def verdicts(measures: dict[str, Column], rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """For each rule a boolean over the measures, in whole numbers."""
    one = F.lit(1).cast("long")
    out = {}
    for r in rules:
        n, d = (one if x == "one" else measures[x] for x in (r.numerator, r.denominator))
        held = F.lit(True)
        if r.low is not None:
            held = held & (n * 1000 >= d * _permille(r.low))
        if r.high is not None:
            held = held & (n * 1000 <= d * _permille(r.high))
        out[r.name] = (d == 0) | held
    return out


def barrier() -> Column:
    """0, by a row number: a filter on a column made with it isn't pushed below the projection that makes it.

    Pushed down, it would write the measures' nested expressions out again and again, without end.
    """
    return F.when(F.monotonically_increasing_id() < 0, 1).otherwise(0)


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """df with one struct column ``quality`` of whole-text measures; a null text is empty.

    Words are runs of characters other than space and tab to carriage return.
    Everything is computed within the row: a text takes no shuffle, and the
    repeats of its 8-word windows are found by sorting that text's windows
    only if the windows' hashes aren't all different.
    """
    keep = df.columns
    t, w, h, s, p = (f"__quality_{x}" for x in "twhsp")
    stops = sorted({v for words in STOP_WORDS.values() for x in words for v in (x, x.capitalize())})
    df = df.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn(w, F.filter(F.split(t, f"{BLANKS}+"), lambda x: x != ""))
    n = F.size(w)
    at = F.sequence(F.lit(0), n - WINDOW)
    df = df.withColumn(h, F.when(n >= WINDOW, F.transform(at, lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(WINDOW)]))))
    # Ties of the hash are told apart by the words themselves, so the result is exact.
    df = df.withColumn(s, F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(at, lambda i: F.struct(F.get(F.col(h), i).alias("h"), F.slice(F.col(w), i + 1, WINDOW).alias("w"), i.alias("i"))))))

    def same(a: Column, b: Column) -> Column:
        return F.coalesce((a["h"] == b["h"]) & (a["w"] == b["w"]), F.lit(False))

    df = df.withColumn(p, F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, F.get(F.col(s), j - 1)) | same(x, F.get(F.col(s), j + 1))), lambda x: x["i"])))
    covered = F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(p), j + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    lines = "__quality_lines"
    df = df.withColumn(lines, F.filter(F.split(t, "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != ""))
    quality = F.struct(
        (n + barrier()).cast("long").alias("n_words"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(lines, lambda x: F.ltrim(x).startswith("- ") | F.ltrim(x).startswith("* ") | F.ltrim(x).startswith("•"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…"))).cast("long").alias("n_cut_lines"),
        F.size(F.filter(w, lambda x: x.isin(stops))).cast("long").alias("n_stop_words"),
    )
    return df.select(*[F.col(f"`{c}`") for c in keep if c != "quality"], quality.alias("quality"))


def judged(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with the measures, a boolean for each rule's failure and ``kept``, all in the struct ``quality``.

    Null and empty texts have no words and fail ``enough_words``. Repeated rows are judged alike, each by
    itself. A column called ``quality`` is replaced.
    """
    df = measured(df, text)
    names = [f.name for f in df.schema["quality"].dataType.fields]
    flat = {x: F.col(f"quality.{x}") for x in names}
    held = verdicts(flat, rules)
    every = F.lit(True)
    for c in held.values():
        every = every & c
    failed = F.filter(F.array(*[F.when(~c, F.lit(k)) for k, c in held.items()]), lambda x: x.isNotNull())
    return df.withColumn("quality", F.struct(*[flat[x].alias(x) for x in names], failed.alias("failed"), every.alias("kept")))


def kept(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of df that pass every rule, with df's columns."""
    keep = df.columns
    own = df.withColumnRenamed("quality", "__own_quality")
    held = judged(own, text, rules).where("quality.kept").drop("quality")
    return held.withColumnRenamed("__own_quality", "quality").select(*[F.col(f"`{c}`") for c in keep])
