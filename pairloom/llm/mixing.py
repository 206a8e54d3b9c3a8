"""Mixing sources to target weights: budgets down a domain-language-source tree, and seeded prefixes of its leaves."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared
from .quality import BLANKS

LEVELS = ("domain", "lang", "source")
#: A leaf's prefix is found by the first digits of its keys (hex), so many more of them in each round, and so many rounds.
DIGITS, ROUNDS = 2, 2
#: A table of leaves of at most so many rows is broadcast. Of a larger one only those that hold at least one in HOT of all rows are.
SMALL, HOT = 100_000, 10_000
MISSING = "<null>"


@dataclass(frozen=True)
class Recipe:
    """Target weights (whole numbers; names that aren't listed have ``other``), the budget and the epochs.

    permille: the budget in thousandths of all tokens; budget: in tokens, instead. Capacities times the sum of
    sibling weights must stay below 2**63.
    """

    domains: dict[str, int] = field(default_factory=dict)
    langs: dict[str, int] = field(default_factory=dict)
    sources: dict[str, int] = field(default_factory=dict)
    other: int = 1
    permille: int = 1000
    budget: int | None = None
    epochs: int = 1
    seed: int = 42


def domain_of(source: Column) -> Column:
    """The tree's first level: sources numbered below ten are the web's, the others curated."""
    return F.when(source.rlike("^src[0-9]$"), "web").otherwise("curated")


def tokens_of(text: Column) -> Column:
    """Words of a whole text; null has none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), f"{BLANKS}+"), lambda x: x != "")).cast("long")


def _weight(name: str, given: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for k, v in sorted(given.items()):
        out = F.when(F.col(name) == k, v).otherwise(out)
    return out.cast("long")


def shared_out(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes with ``share``: each parent's ``budget`` dealt by ``weight``, no child above its ``cap``.

    What a full child leaves goes to its siblings by weight; since a child's cap is what all below it can
    take, only what no sibling can take stays with the ancestors. In order of cap / weight the full children
    come first, so prefix sums settle every level at once.
    """
    name = LEVELS[len(parent)]
    by = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = by.orderBy(F.col("cap") / F.col("weight"), name)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    n = nodes.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(zero)).withColumn("weight", F.greatest("weight", F.when(F.col("cap") > 0, zero).otherwise(F.lit(1).cast("long"))))
    n = n.withColumn("c0", F.coalesce(F.sum("cap").over(before), zero)).withColumn("w0", F.coalesce(F.sum("weight").over(before), zero)).withColumn("w1", F.sum("weight").over(by))
    n = n.withColumn("full", F.col("cap") * (F.col("w1") - F.col("w0")) <= F.col("weight") * (F.col("budget") - F.col("c0")))
    open_ = F.when(F.col("full"), zero).otherwise(F.col("weight"))
    n = n.withColumn("c2", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(zero)).over(by)).withColumn("w2", F.sum(open_).over(by)).withColumn("w3", F.coalesce(F.sum(open_).over(before), zero))
    # By running sums of the weights, so that rounding leaves nothing over.
    part = F.expr("((w3 + weight) * (budget - c2)) div w2 - (w3 * (budget - c2)) div w2")
    return n.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(part)).drop("c0", "w0", "w1", "full", "c2", "w2", "w3")


def budgets(leaves: DataFrame, recipe: Recipe) -> DataFrame:
    """(domain, lang, source, tokens, share) of every leaf, from (domain, lang, source, tokens)."""
    tree = leaves.withColumn("cap", F.col("tokens") * recipe.epochs)
    named = (recipe.domains, recipe.langs, recipe.sources)
    every = W.partitionBy(F.lit(0))  # of the domains, a handful of rows
    zero = F.lit(0).cast("long")
    above: DataFrame | None = None
    for depth, name in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        nodes = tree.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("weight", _weight(name, named[depth], recipe.other))
        if above is None:
            nodes = nodes.withColumn("all_tokens", F.sum("tokens").over(every))
            whole = F.lit(recipe.budget).cast("long") if recipe.budget is not None else F.expr(f"(all_tokens * {recipe.permille}) div 1000")
            able = F.sum(F.when(F.col("weight") > 0, F.col("cap")).otherwise(zero)).over(every)
            nodes = nodes.withColumn("budget", F.least(whole, able)).drop("all_tokens")
        else:
            nodes = nodes.join(above, keys[:-1])
        nodes = shared_out(nodes, keys[:-1])
        above = nodes.select(*keys, F.col("share").alias("budget"))
        last = nodes
    return last.select(*LEVELS, "tokens", "share")


def _keyed(rows: DataFrame, recipe: Recipe) -> DataFrame:
    """Every row's place in its leaf's last, partial epoch, as a hex string: by its identifier and its text."""
    return rows.withColumn("key", F.md5(F.concat_ws("|", F.lit(str(recipe.seed)), (F.col("epochs") + 1).cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")), "mark")))


def _with_leaves(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """rows with the columns of their leaf's row; leaves: a written table with ``n_rows``.

    Rows stay where they are: the table is counted and broadcast. One too large for that is parted, so that only
    rows of leaves with few rows are shuffled, and no leaf's rows gather in one task.
    """
    if leaves.count() <= SMALL:
        return rows.join(F.broadcast(leaves.drop("n_rows")), list(LEVELS))
    total = leaves.agg(F.sum("n_rows")).first()[0]
    hot = leaves.where(F.col("n_rows") * HOT >= total)  # at most HOT rows
    rest = rows.join(F.broadcast(hot.select(*LEVELS)), list(LEVELS), "left_anti")
    return rows.join(F.broadcast(hot.drop("n_rows")), list(LEVELS)).unionByName(rest.join(leaves.drop("n_rows"), list(LEVELS)))


def cutoffs(rows: DataFrame, recipe: Recipe) -> DataFrame:
    """(domain, lang, source, share, epochs, cut, n_rows): whole epochs of each leaf, and the last key of its prefix.

    rows: (domain, lang, source, id, mark, n_tokens). The prefix is the longest run of keys whose tokens fit
    what the whole epochs leave; rows of one identifier and text have one key and are taken or left together.
    """
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_rows"))
    sizes = shared.written(leaves, "mix-leaves")
    plan = budgets(sizes.drop("n_rows"), recipe).withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("share div tokens")).otherwise(0).cast("long"))
    plan = shared.written(plan.withColumn("rest", F.col("share") - F.col("epochs") * F.col("tokens")).join(sizes.select(*LEVELS, "n_rows"), list(LEVELS)), "mix-plan")
    keyed = _keyed(_with_leaves(rows, plan.select(*LEVELS, "epochs", "rest", "n_rows")), recipe)
    # A leaf's prefix ends in one bucket of keys; only that bucket's rows are counted on, and the last one's ordered.
    zero, edge = F.lit(0).cast("long"), None
    for turn in range(ROUNDS):
        inner = keyed.withColumn("before", zero) if edge is None else _with_leaves(keyed, edge).where(F.col("key").startswith(F.col("edge"))).drop("edge")
        sums = inner.groupBy(*LEVELS, "rest", "before", F.substring("key", 1, DIGITS * (turn + 1)).alias("bucket")).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("n_rows"))
        upto = sums.withColumn("upto", F.col("before") + F.sum("n").over(W.partitionBy(*LEVELS).orderBy("bucket"))).where("upto > rest")
        first = upto.groupBy(*LEVELS).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"), "n_rows")).alias("x"))
        edge = shared.written(first.select(*LEVELS, F.col("x.bucket").alias("edge"), F.col("x.before").alias("before"), F.col("x.n_rows").alias("n_rows")), "mix-edges")
    inside = _with_leaves(keyed, edge).where(F.col("key").startswith(F.col("edge"))).groupBy(*LEVELS, "before", "rest", "key").agg(F.sum("n_tokens").alias("n"))
    cum = inside.withColumn("upto", F.col("before") + F.sum("n").over(W.partitionBy(*LEVELS).orderBy("key")))
    last = cum.where("upto <= rest").groupBy(*LEVELS).agg(F.max("key").alias("last"))
    cut = edge.join(last, list(LEVELS), "left").select(*LEVELS, F.coalesce("last", "edge").alias("cut"))
    # No bucket goes beyond the rest: the whole epoch is in; "g" comes after every hex digit.
    return plan.join(cut, list(LEVELS), "left").select(*LEVELS, "share", "epochs", F.coalesce("cut", F.lit("g")).alias("cut"), "n_rows")


def mixed(df: DataFrame, recipe: Recipe, domain: Column | None = None, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """df's rows that the mix takes, with a struct ``mix``: domain, lang, source, n_tokens, share, n_epochs.

    n_epochs says how often a row goes into the mix: each whole epoch of its leaf, and once more if it lies in
    the last epoch's prefix, at most ``recipe.epochs`` times. Null languages and sources are leaves of their
    own; null and empty texts have no tokens and go with the prefix that they lie in. Rows without identifiers
    and rows that repeat one are told apart by their texts; rows of one identifier and text are taken or left
    together. An empty table gives an empty one. A column called mix is replaced; columns of any other name pass
    through. Texts are never shuffled by leaf, and no leaf is sorted whole, so a source with a third of all rows
    is no bottleneck.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c != "mix"]
    named = df.select(
        *([F.struct(*keep).alias("row")]),
        F.col(id_col).alias("id"),
        F.coalesce(domain if domain is not None else domain_of(F.col(source)), F.lit(MISSING)).alias("domain"),
        F.coalesce(F.col(lang), F.lit(MISSING)).alias("lang"),
        F.coalesce(F.col(source), F.lit(MISSING)).alias("source"),
        F.md5(F.coalesce(F.col(text), F.lit(""))).alias("mark"),
        tokens_of(F.col(text)).alias("n_tokens"),
    )
    rows = shared.written(named.drop("row"), "mix-rows")
    taken = _keyed(_with_leaves(named, shared.written(cutoffs(rows, recipe), "mix-cutoffs")), recipe)
    n = F.least(F.col("epochs") + F.when(F.col("key") <= F.col("cut"), 1).otherwise(0), F.lit(recipe.epochs).cast("long"))
    taken = taken.withColumn("n_epochs", n).where("n_epochs > 0")
    return taken.select("row.*", F.struct(*LEVELS, "n_tokens", "share", "n_epochs").alias("mix"))
