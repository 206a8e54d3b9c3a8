"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

A word is the sum of three rows of a hashed embedding table: two by the whole word, one by its first bytes, so
that words of one stem are near each other and a clean word that shares one row stays clean. Filters of several
widths run over whole texts; the largest response of each filter makes the score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import batches, shared, shingles
from .quality import STOP_WORDS

#: Rows of the table, its width, the filters' widths and how many there are of each.
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 17, 8, (1, 2, 3), 8
PREFIX = 5
#: Labelled rows that a model is fitted on at most, by label, and their texts' bytes: the bounds of the sample.
SAMPLE, SAMPLE_BYTES = {1: 2500, 0: 5000}, 64 << 20
#: A text of more bytes than this is scored like any other, but not learned from.
SAMPLE_TEXT = 1 << 20
#: Networks that are trained from other random starts; their mean logit counts, so one bad start of a small sample doesn't.
MEMBERS = 3
#: Steps and passes over the sample at least, rows of a step, and the first step's size.
STEPS, EPOCHS, BATCH, RATE = 600, 6, 32, 0.05
#: The size of the noise that the table starts from.
START = 0.02
#: Table rows that fewer of the sample's texts hold stay zero, and of the sample's words so many are left out at random.
LEAST_TEXTS, DROPPED = 4, 0.3
#: One in so many of the sample's rows sets thresholds and nothing else.
HELD_FOR_THRESHOLDS = 4
#: A language has a threshold of its own if so many rows of each label set it; others take that of all languages.
SUPPORT = 25
#: Cells of a logit's unit in the histograms that thresholds are set by.
BINS = 64
DECISION = 0.7
GROUP = 1 << 20
_PARTS = np.ones(256, bool)
_PARTS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LANGS = tuple(sorted(STOP_WORDS))


def _language_table() -> np.ndarray:
    """For 16 bits of a stop word's hash: its language's number, 0 for none or for words of several."""
    out, owner = np.zeros(1 << 16, np.uint8), {}
    for k, lang in enumerate(LANGS, 1):
        for w in STOP_WORDS[lang]:
            owner.setdefault(w, set()).add(k)
    names = [w for w, k in owner.items() if len(k) == 1]
    x = np.frombuffer("".join(names).encode(), np.uint8)
    at = np.cumsum([0, *[len(w.encode()) for w in names]])
    h, *_ = shingles.words(x, at, _PARTS)
    for w, v in zip(names, h, strict=True):
        out[int(v) & 0xFFFF] = min(owner[w])
    return out


_LANGUAGE = _language_table()


def _lowered(x: np.ndarray) -> np.ndarray:
    """Capital letters of Latin-1 beyond ASCII in UTF-8 as small ones; ASCII is lower-cased by ``words``."""
    x = x.copy()
    at = np.flatnonzero(x[:-1] == 0xC3) + 1 if len(x) else np.zeros(0, np.int64)
    capital = at[(x[at] >= 0x80) & (x[at] <= 0x9E) & (x[at] != 0x97)]
    x[capital] += 0x20
    return x


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, table rows of each word, the texts' word offsets, the texts' languages by their stop words), group by group."""
    x, offsets = batches.text_bytes(pa.RecordBatch.from_arrays([texts], names=["t"]), 0)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + GROUP, "right")) - 1)
        part = _lowered(x[offsets[start] : offsets[end]])
        h, at, head = shingles.words(part, offsets[start : end + 1] - offsets[start], _PARTS, PREFIX)
        mask = np.uint64(BUCKETS - 1)
        rows = np.stack([h & mask, (h >> np.uint64(20)) & mask, shingles.mix(head) & mask], 1).astype(np.int32)
        said = _LANGUAGE[(h & np.uint64(0xFFFF)).astype(np.int64)]
        owner = np.repeat(np.arange(end - start), np.diff(at))
        votes = np.bincount(owner * (len(LANGS) + 1) + said, minlength=(end - start) * (len(LANGS) + 1)).reshape(-1, len(LANGS) + 1)
        votes[:, 0] = 0
        yield start, rows, at, votes.argmax(1)
        start = end


@dataclass
class Model:
    """The table, filters by width as (width, DIM, FILTERS), their biases, the last layer and the thresholds by language."""

    table: np.ndarray
    filters: list[np.ndarray]
    biases: np.ndarray
    last: np.ndarray
    bias: float
    thresholds: np.ndarray

    def pooled(self, rows: np.ndarray, at: np.ndarray, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest response in each text, at least 0, and the word where it begins (-1 for none)."""
        words = self.table[rows[:, 0]] + self.table[rows[:, 1]] + self.table[rows[:, 2]]
        if kept is not None:
            words *= kept[:, None]
        n, texts = len(rows), len(at) - 1
        left = np.repeat(at[1:], np.diff(at)) - np.arange(n)  # words up to the text's end
        value, where = np.zeros((texts, len(self.biases)), np.float32), np.full((texts, len(self.biases)), -1, np.int64)
        some = np.flatnonzero(np.diff(at))
        if not len(some):
            return value, where
        for k, f in enumerate(self.filters):
            each = f.shape[2]
            own = slice(k * each, (k + 1) * each)
            out = words @ f[0]
            for o in range(1, len(f)):
                shifted = words[o:] @ f[o]
                shifted[left[: n - o] <= o] = 0  # beyond a text's end stands nothing
                out[: n - o] += shifted
            out += self.biases[own]
            top = np.maximum.reduceat(out, at[some], axis=0)
            value[some, own] = np.maximum(top, 0)
            if kept is not None:
                owner = np.repeat(np.arange(len(some)), np.diff(at)[some])
                word, c = np.nonzero(out == top[owner])
                where[some[owner[word[::-1]]], own.start + c[::-1]] = word[::-1]  # the first of equals
        where[value <= 0] = -1
        return value, where

    def logits(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.pooled(rows, at)[0] @ self.last + self.bias

    def scores(self, rows: np.ndarray, at: np.ndarray, langs: np.ndarray) -> np.ndarray:
        """Scores that cross DECISION at the threshold of the text's language."""
        z = self.logits(rows, at).astype(np.float64) - self.thresholds[langs] + np.log(DECISION / (1 - DECISION))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def merged(members: list[Model]) -> Model:
    """One network whose logit is the members' mean: tables side by side, filters block by block."""
    if len(members) == 1:
        return members[0]
    n, dim, each = len(members), members[0].table.shape[1], members[0].filters[0].shape[2]
    filters = []
    for k, f in enumerate(members[0].filters):
        both = np.zeros((len(f), n * dim, n * each), np.float32)
        for i, m in enumerate(members):
            both[:, i * dim : (i + 1) * dim, i * each : (i + 1) * each] = m.filters[k]
        filters.append(both)
    side = lambda name: np.concatenate([getattr(m, name).reshape(len(filters), each) for m in members], 1).ravel()
    return Model(np.concatenate([m.table for m in members], 1), filters, side("biases"), side("last") / n, float(np.mean([m.bias for m in members])), members[0].thresholds.copy())


def gradients(model: Model, rows: np.ndarray, at: np.ndarray, labels: np.ndarray, weight: np.ndarray, kept: np.ndarray) -> dict:
    """Of the weighted mean log loss by every weight; the table's by ``rows``, which may repeat a row."""
    value, where = model.pooled(rows, at, kept)
    z = value @ model.last + model.bias
    error = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - labels) * weight / max(1, len(labels))
    g_value = error[:, None] * model.last
    g_value[where < 0] = 0
    filters, touched, found = [], [np.zeros(0, np.int64)], [np.zeros((0, DIM))]
    for k, f in enumerate(model.filters):
        g_f, each = np.zeros_like(f), f.shape[2]
        first, g = where[:, k * each : (k + 1) * each], g_value[:, k * each : (k + 1) * each]
        for o in range(len(f)):
            ok = (first >= 0) & (first + o < at[1:, None])
            c = np.nonzero(ok)[1]
            w = first[ok] + o
            go = (g[ok] * kept[w])[:, None].astype(f.dtype)
            g_f[o] = (go * model.table[rows[w]].sum(1)).T @ (c[:, None] == np.arange(each)).astype(f.dtype)
            touched.append(rows[w].ravel())
            found.append(np.repeat(go * f[o].T[c], 3, axis=0))
        filters.append(g_f)
    return {"rows": np.concatenate(touched), "table": np.concatenate(found), "filters": filters, "biases": g_value.sum(0), "last": value.T @ error, "bias": float(error.sum())}


def _member(docs: list[np.ndarray], labels: np.ndarray, learn: np.ndarray, seed: int) -> Model:
    """A network trained from the start that the seed gives."""
    rng = np.random.default_rng(seed)
    n_filters = FILTERS * len(WIDTHS)
    model = Model(
        np.zeros((BUCKETS, DIM), np.float32),
        [(rng.standard_normal((w, DIM, FILTERS)) / np.sqrt(w * DIM)).astype(np.float32) for w in WIDTHS],
        np.zeros(n_filters, np.float32),
        (rng.standard_normal(n_filters) / np.sqrt(n_filters)).astype(np.float32),
        -1.0,
        np.zeros(len(LANGS) + 1),
    )
    seen = np.zeros(BUCKETS, np.int64)
    for i in learn:
        seen[np.unique(docs[i])] += 1
    free = seen >= LEAST_TEXTS
    model.table[free] = rng.standard_normal((int(free.sum()), DIM)).astype(np.float32) * START
    # AdaGrad; a filter's response at its largest place is all that a step touches.
    sums = {"table": np.full(BUCKETS, 1e-6, np.float32), "filters": [np.full(f.shape, 1e-6, np.float32) for f in model.filters], "biases": np.full(n_filters, 1e-6, np.float32), "last": np.full(n_filters, 1e-6, np.float32), "bias": 1e-6}
    weight = np.where(labels == 1, 0.5 / labels[learn].mean(), 0.5 / (1 - labels[learn].mean()))
    epochs = max(EPOCHS, -(-STEPS * BATCH // len(learn)))
    for epoch in range(epochs):
        order = rng.permutation(learn)
        rate = RATE * (1 - epoch / epochs)
        for b in range(0, len(order), BATCH):
            some = order[b : b + BATCH]
            rows = np.concatenate([docs[i] for i in some]) if len(some) else np.zeros((0, 3), np.int32)
            at = np.cumsum([0, *[len(docs[i]) for i in some]])
            kept = (rng.random(len(rows)) >= DROPPED).astype(np.float32)
            g = gradients(model, rows, at, labels[some], weight[some], kept)
            use = free[g["rows"]]
            if use.any():
                # Each row once, with the sums of what touches it.
                o = np.flatnonzero(use)[np.argsort(g["rows"][use], kind="stable")]
                row, g_row = g["rows"][o], g["table"][o]
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                row = row[first]
                sums["table"][row] += np.add.reduceat((g_row**2).mean(1), first)
                model.table[row] -= (rate * np.add.reduceat(g_row, first) / np.sqrt(sums["table"][row])[:, None]).astype(np.float32)
            for k, f in enumerate(model.filters):
                sums["filters"][k] += g["filters"][k] ** 2
                f -= rate * g["filters"][k] / np.sqrt(sums["filters"][k])
            sums["biases"] += g["biases"] ** 2
            model.biases -= (rate * g["biases"] / np.sqrt(sums["biases"])).astype(np.float32)
            sums["last"] += g["last"] ** 2
            model.last -= (rate * g["last"] / np.sqrt(sums["last"])).astype(np.float32)
            sums["bias"] += g["bias"] ** 2
            model.bias -= rate * g["bias"] / np.sqrt(sums["bias"])
    return model


def fit(texts: list[str | None], labels: np.ndarray, seed: int = 5) -> Model:
    """A model of these rows; without rows of both labels every score is low."""
    parts = [(a, at, langs, rows) for a, rows, at, langs in features(pa.array(texts, pa.string()))]
    docs = [(rows[at[i] : at[i + 1]]) for _, at, _, rows in parts for i in range(len(at) - 1)]
    langs = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.int64)
    held = np.arange(len(docs)) % HELD_FOR_THRESHOLDS == 0
    learn = np.flatnonzero(~held)
    if not 0 < labels.sum() < len(labels) or not 0 < labels[learn].sum() < len(learn):
        n = FILTERS * len(WIDTHS)
        return Model(np.zeros((BUCKETS, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], np.zeros(n, np.float32), np.zeros(n, np.float32), -1.0, np.full(len(LANGS) + 1, 5.0))
    model = merged([_member(docs, labels, learn, seed + i) for i in range(MEMBERS)])
    rows, at = np.concatenate(docs), np.cumsum([0, *map(len, docs)])
    z = np.concatenate([model.logits(rows[at[i] : at[min(i + 256, len(docs))]], at[i : min(i + 256, len(docs)) + 1] - at[i]) for i in range(0, len(docs), 256)])
    whole = _threshold(z[held], labels[held], 0.0)
    for k in range(len(LANGS) + 1):
        own = held & (langs == k)
        model.thresholds[k] = _threshold(z[own], labels[own], whole) if min(labels[own].sum(), (1 - labels[own]).sum()) >= SUPPORT else whole
    return model


def _threshold(z: np.ndarray, y: np.ndarray, otherwise: float) -> float:
    """The cut of the best F1, in the middle of the gap that it lies in; ``otherwise`` where a label is missing."""
    if not 0 < y.sum() < len(y):
        return otherwise
    o = np.argsort(-z, kind="stable")
    hits, n = np.cumsum(y[o]), np.arange(1, len(z) + 1)
    f1 = 2 * hits / (n + y.sum())
    f1[:-1][z[o][1:] == z[o][:-1]] = -1  # no cut between equals
    k = int(f1.argmax())
    return float((z[o][k] + z[o][k + 1]) / 2) if k + 1 < len(z) else float(z[o][k] - 1)


def _labelled(labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """(id, label) outside the held-out fold, once for each identifier."""
    fold = F.crc32(F.col(id_col).cast("string")) % 3
    return labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & (fold != 1)).groupBy(id_col).agg(F.max(label).cast("int").alias("label"))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[list, np.ndarray, list]:
    """Whole texts, labels and identifiers of at most SAMPLE rows, the first by a hash of the identifier; rows of the held-out fold never.

    Of the rows that repeat an identifier the least text is taken. No more than SAMPLE_BYTES of text come to the driver.
    """
    able = _labelled(labels, id_col, label)
    order = [F.crc32(F.concat(F.col(id_col).cast("string"), F.lit("|sample"))), F.col(id_col)]
    taken = None
    for y, n in SAMPLE.items():
        some = able.where(F.col("label") == y).orderBy(*order).limit(n)
        taken = some if taken is None else taken.unionByName(some)
    # At most the sum of SAMPLE rows of an identifier and a label: their size is bounded.
    own = docs.select(F.col(id_col), F.col(text).alias("text")).join(F.broadcast(taken), id_col)
    found = own.groupBy(id_col).agg(F.min("text").alias("text"), F.first("label").alias("label"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    upto = F.sum("size").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    found = found.withColumn("size", size).where(F.col("size") <= SAMPLE_TEXT).withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES)
    rows = found.orderBy(*order).select(id_col, "text", "label").toPandas()
    return [None if t is None else str(t) for t in rows["text"]], rows["label"].to_numpy(np.int64), rows[id_col].tolist()


def learned(ids: list) -> list:
    """The identifiers of a sample's rows that ``fit`` takes weights from."""
    return [x for i, x in enumerate(ids) if i % HELD_FOR_THRESHOLDS]


def calibrated(found: DataFrame, labels: DataFrame, model: Model, known: list, id_col: str = "doc_id", label: str = "toxic") -> Model:
    """model with the thresholds of all labelled rows outside the held-out fold; ``found`` is ``logits``' table.

    The logits of rows that the weights were learned from (``known``) lie too far apart, so they count only in
    the labels' shares, which weigh the others: a sample's mix of labels has no say. The driver sees histograms.
    """
    if not model.last.any():
        return model
    spark = found.sparkSession
    kind = found.schema[id_col].dataType
    taken = spark.createDataFrame([(x,) for x in known], T.StructType([T.StructField(id_col, kind)])).withColumn("known", F.lit(True))
    rows = found.join(_labelled(labels, id_col, label), id_col).join(F.broadcast(taken), id_col, "left")
    place = F.greatest(F.least(F.floor(F.col("z") * BINS), F.lit(100 * BINS)), F.lit(-100 * BINS))
    cells = rows.groupBy("lang", "label", F.coalesce("known", F.lit(False)).alias("known"), place.alias("bin")).agg(F.count("*").alias("n"), F.min("z").alias("low"), F.max("z").alias("high")).toPandas()
    whole = _histogram_threshold(cells, None)
    if whole is None:
        return model
    cuts = [_histogram_threshold(cells[cells["lang"] == k], whole) for k in range(len(LANGS) + 1)]
    return replace(model, thresholds=np.array(cuts, np.float64))


def _histogram_threshold(cells: pd.DataFrame, otherwise: float | None) -> float | None:
    """As ``_threshold``, of a histogram's cells, each label weighed up to its share of all rows; ``otherwise`` below SUPPORT."""
    free = cells[~cells["known"].astype(bool)]
    every, own = (np.array([t.loc[t["label"] == y, "n"].sum() for y in (0, 1)], float) for t in (cells, free))
    if own.min() < (1 if otherwise is None else SUPPORT):
        return otherwise
    n = free["n"] * (every / own)[free["label"].to_numpy(np.int64)]
    bins = free.assign(n=n, toxic=n * free["label"]).groupby("bin").agg({"n": "sum", "toxic": "sum", "low": "min", "high": "max"}).sort_index(ascending=False)
    f1 = 2 * bins["toxic"].cumsum() / (bins["n"].cumsum() + every[1])
    k = int(f1.to_numpy().argmax())
    low = float(bins["low"].iloc[k])
    return (low + float(bins["high"].iloc[k + 1])) / 2 if k + 1 < len(bins) else low - 1


def logits(df: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, lang, z) of every row: its language's place and its logit before any threshold."""
    kind = df.schema[id_col].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            z, lang = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int32)
            for start, rows, at, langs in features(b.column(1)):
                z[start : start + len(langs)] = sent.value.logits(rows, at)
                lang[start : start + len(langs)] = langs
            held = [None if i is None else zlib.crc32(str(i).encode()) % 3 == 1 for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.bool_()), pa.array(lang), pa.array(z)], names=[id_col, "held_out", "lang", "z"])

    return df.select(id_col, text).mapInArrow(shared.frugal(run), f"`{id_col}` {kind}, held_out boolean, lang int, z double")


def decided(found: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, score, predicted) of ``logits``' table, by the thresholds of the model."""
    cut = F.element_at(F.array(*[F.lit(float(t)) for t in model.thresholds]), F.col("lang") + 1)
    z = F.greatest(F.least(F.col("z") - cut + float(np.log(DECISION / (1 - DECISION))), F.lit(30.0)), F.lit(-30.0))
    score = 1 / (1 + F.exp(-z))
    return found.select(id_col, "held_out", score.alias("score"), (score >= DECISION).cast("int").alias("predicted"))


def scored(df: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row; a null text is empty and its score is that of no words.

    The score sees the text alone. A long text's words are pooled like any others; nothing is cut.
    """
    return decided(logits(df, model, id_col, text), model, id_col)
