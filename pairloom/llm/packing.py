"""Packing by column generation: patterns of piece lengths from a linear program, dealt to ranked pieces."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared, tokens

LENGTH = 4096
#: The linear program's lengths at most: neighbours merge where that rounds the fewest tokens up.
BINS = 384
#: About so many pieces of a bin are ranked in one task.
PART = 100_000
#: If more than PADDING of the sequences would be padding, rests of over QUARTER tokens are cut after whole quarters.
PADDING, QUARTER = 0.02, LENGTH // 4
#: The program ends when its value is within this part of its lower bound, or after so many knapsacks.
GAP, KNAPSACKS = 0.001, 300
#: Patterns that one knapsack offers at most.
OFFERED = 8


def bin_sizes(counts: np.ndarray, limit: int = BINS) -> np.ndarray:
    """For each length k + 1 the size that it is rounded up to, 0 for lengths that ``counts`` doesn't have.

    As many different sizes as ``limit`` allows: of neighbouring sizes those merge first whose pieces lose the
    fewest tokens by it, so few different lengths stay exact.
    """
    used = np.flatnonzero(counts).tolist()
    held = {k: int(counts[k]) for k in used}
    up = dict(zip(used, used[1:], strict=False))
    down = dict(zip(used[1:], used, strict=False))
    costs = [(held[a] * (b - a), a, b, held[a]) for a, b in up.items()]
    heapq.heapify(costs)
    into: dict[int, int] = {}
    while len(held) > limit:
        _, a, b, n = heapq.heappop(costs)
        if up.get(a) != b or held.get(a) != n:
            continue  # a or b has changed since
        into[a] = b
        held[b] += held.pop(a)
        del up[a]
        if (low := down.pop(a, None)) is None:
            del down[b]
        else:
            up[low], down[b] = b, low
            heapq.heappush(costs, (held[low] * (b - low), low, b, held[low]))
        if b in up:
            heapq.heappush(costs, (held[b] * (up[b] - b), b, up[b], held[b]))
    out = np.zeros(len(counts), np.int64)
    for k in reversed(used):
        out[k] = out[into[k]] if k in into else k + 1
    return out


def _priced(sizes: np.ndarray, values: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The best worth of a sequence, and patterns of the most worth: an unbounded knapsack by dynamic programming.

    1, 2, 4, ... pieces of a size are taken or left, for every room at once.
    """
    best, steps = np.zeros(LENGTH + 1), []
    for i in np.flatnonzero(values > 1e-12).tolist():
        n, size = 1, int(sizes[i])
        while n * size <= LENGTH:
            with_it = best[: LENGTH + 1 - n * size] + n * values[i]
            better = with_it > best[n * size :] + 1e-12
            if better.any():
                best[n * size :][better] = with_it[better]
                steps.append((i, n, n * size, better))
            n *= 2
    patterns = []
    # Less room gives other patterns; each room at which the worth falls gives one.
    for room in (np.flatnonzero(np.diff(best) > 1e-9)[::-1][:OFFERED] + 1).tolist():
        pattern, c = np.zeros(len(sizes), np.int64), room
        for i, n, weight, better in reversed(steps):
            if c >= weight and better[c - weight]:
                pattern[i] += n
                c -= weight
        patterns.append(pattern)
    return float(best[LENGTH]), patterns


def _filled(sizes: np.ndarray, left: np.ndarray) -> np.ndarray:
    """A sequence of the longest pieces that are left, then the longest that still fit; sizes rise."""
    pattern, room, top = np.zeros(len(sizes), np.int64), LENGTH, len(sizes)
    while room and top:
        some = np.flatnonzero((left[:top] > 0) & (sizes[:top] <= room))
        if not len(some):
            break
        top = int(some[-1])
        pattern[top] = min(max(1, int(left[top])), room // int(sizes[top]))
        room -= int(pattern[top] * sizes[top])
    return pattern


def first_fit(sizes: np.ndarray, left: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) by first fit decreasing."""
    left, made = left.astype(np.int64).copy(), []
    while left.any():
        pattern = _filled(sizes, left)
        held = pattern > 0
        times = int((left[held] // pattern[held]).min())
        left -= times * pattern
        made.append((pattern, times))
    return made


def _start(sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """First fit decreasing in fractions: each pattern uses up one size, so the patterns are a feasible basis."""
    left, basis, open_ = counts.astype(float), np.zeros((len(sizes), len(sizes))), np.ones(len(sizes), bool)
    while open_.any():
        # Two sizes that are used up at once take a pattern each, the second's all but unused.
        left = np.where(open_, np.maximum(left, 1e-9), 0)
        pattern = _filled(sizes, left)
        held = np.flatnonzero(pattern)
        out = held[int((left[held] / pattern[held]).argmin())]
        left -= pattern * (left[out] / pattern[out])
        open_[out] = False
        basis[:, out] = pattern
    return basis


def solved(sizes: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that hold ``counts[k]`` pieces of ``sizes[k]``, which rise; few more sequences than a fractional optimum.

    The linear program starts from first fit decreasing. The dual values price new patterns by the knapsack;
    they enter the basis as long as they are worth more than a sequence. The solution is rounded down and what
    is left is packed by first fit decreasing, so the cost over the optimum is bounded by the number of sizes,
    whatever the number of documents.
    """
    m = len(sizes)
    if not m:
        return []
    demand, volume = counts.astype(float), float(counts @ sizes) / LENGTH
    basis = _start(sizes, counts)
    inverse = np.linalg.inv(basis)
    for _ in range(KNAPSACKS):
        x, dual = np.maximum(inverse @ demand, 0), np.maximum(inverse.sum(0), 0)
        worth, patterns = _priced(sizes, dual)
        # No solution is better than the duals' value over the best pattern's worth, or than no padding at all.
        if worth <= 1 + 1e-9 or x.sum() <= (1 + GAP) * max(volume, float(demand @ dual) / worth):
            break
        good = basis.copy()
        for pattern in patterns:
            way = inverse @ pattern
            if way.sum() <= 1 + 1e-9:  # by now worth no more than a sequence
                continue
            able = np.flatnonzero(way > 1e-6)
            if not len(able):
                continue
            ratio = x[able] / way[able]
            ties = able[ratio <= ratio.min() + 1e-9]
            out = int(ties[way[ties].argmax()])
            basis[:, out] = pattern
            inverse[out] /= way[out]
            others = np.arange(m) != out
            inverse[others] -= np.outer(way[others], inverse[out])
            x = np.maximum(inverse @ demand, 0)
        if not np.allclose(basis @ x, demand, rtol=1e-6, atol=1e-6):
            basis, inverse = good, np.linalg.inv(good)  # too far off by rounding: what there was before does
            break
    x = np.maximum(inverse @ demand, 0)
    left = counts.astype(np.int64).copy()
    made: list[tuple[np.ndarray, int]] = []
    for k in np.argsort(-x, kind="stable"):
        pattern = np.rint(basis[:, k]).astype(np.int64)
        held = pattern > 0
        # Not more often than there are pieces for it.
        times = min(int(np.floor(x[k] + 1e-9)), int((left[held] // pattern[held]).min()))
        if times > 0:
            left -= times * pattern
            made.append((pattern, times))
    made, plain = made + first_fit(sizes, left), first_fit(sizes, counts)
    return min(made, plain, key=lambda p: sum(times for _, times in p))


def pieces(df: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, head_crc32, tail_crc32, task, serial): each document's ids, its end id included, in whole sequences and a rest.

    Null and empty texts hold the end id alone. Ids may be null or repeated; rows that repeat as a whole are
    documents of their own. head and tail are the parts that a rest of over a quarter may be cut in.
    ``serial`` numbers each task's whole sequences from 0; it is null for rests.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "head_crc32", "tail_crc32", "task", "serial"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, task, whole = tokens.encoder(vocabulary), np.array([end_id], "<u4"), TaskContext.get().partitionId(), 0
        for b in batches:
            for first, ids, offsets in enc.batches(b.column(1)):
                rows = []
                for i in range(len(offsets) - 1):
                    own = np.concatenate([ids[offsets[i] : offsets[i + 1]], end])
                    for a in range(0, len(own), LENGTH):
                        part = own[a : a + LENGTH]
                        row = [first + i, a, len(part), zlib.crc32(part.tobytes()), len(own), None, None, task, None]
                        if len(part) == LENGTH:
                            row[8], whole = whole, whole + 1
                        elif len(part) > QUARTER and len(part) % QUARTER:
                            at = len(part) // QUARTER * QUARTER
                            row[5:7] = zlib.crc32(part[:at].tobytes()), zlib.crc32(part[at:].tobytes())
                        rows.append(row)
                row, *columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *[pa.array(c, pa.int64()) for c in columns]], names=names)

    return df.select(id_col, text).mapInArrow(shared.frugal(run), f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in names[1:]))


def _cut_counts(counts: np.ndarray) -> np.ndarray:
    """counts by length after ``_in_quarters``."""
    out = np.zeros(LENGTH, np.int64)
    for n in (np.flatnonzero(counts) + 1).tolist():
        head = n // QUARTER * QUARTER
        out[head] += counts[n - 1]
        out[n - head] += counts[n - 1]
    return out[1:]


def _in_quarters(rest: DataFrame) -> DataFrame:
    """Rests of over a quarter as whole quarters and what is left."""
    head = F.floor(F.col("length") / QUARTER) * QUARTER
    one = lambda start, length, crc: F.struct(start.alias("start"), length.cast("long").alias("length"), F.col(crc).alias("ids_crc32"))
    both = F.array(one(F.col("start"), head, "head_crc32"), one(F.col("start") + head, F.col("length") - head, "tail_crc32"))
    parts = F.when(F.col("head_crc32").isNotNull(), both).otherwise(F.array(one(F.col("start"), F.col("length"), "ids_crc32")))
    others = [c for c in rest.columns if c not in ("start", "length", "ids_crc32")]
    return rest.select(*others, F.inline(parts))


class _Plan:
    """The patterns for pieces of these counts by length, and where each bin's pieces go."""

    def __init__(self, counts: np.ndarray):
        self.rounded = bin_sizes(counts)
        self.sizes = np.unique(self.rounded[self.rounded > 0])
        self.held = np.array([counts[self.rounded == s].sum() for s in self.sizes], np.int64)
        # For each bin: where a pattern's pieces begin among its ranks, how many a sequence takes, its first sequence.
        begins: list[list[tuple[int, int, int]]] = [[] for _ in self.sizes]
        ranks, self.sequences = np.zeros(len(self.sizes), np.int64), 0
        for pattern, times in solved(self.sizes, self.held):
            for k in np.flatnonzero(pattern).tolist():
                begins[k].append((int(ranks[k]), int(pattern[k]), self.sequences))
            ranks += pattern * times
            self.sequences += times
        self.dealing = [np.array(v, np.int64).T for v in begins]

    def lengths(self) -> list[tuple[int, int, int]]:
        """(length, bin, parts) of every length that occurs."""
        own = {int(s): k for k, s in enumerate(self.sizes)}
        return [(k + 1, own[int(s)], int(self.held[own[int(s)]]) // PART + 1) for k, s in enumerate(self.rounded.tolist()) if s]


def packed(cut: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The pieces with sequence_id and offset; a sequence's pieces follow each other without gaps.

    cut: ``pieces``' table; an empty one gives no rows, and equal rows are dealt like any others. Whole
    sequences are numbered by their task and serial, without a sort. The others are binned by length (rounded
    up, see ``bin_sizes``) and ranked within the bin; a pattern's sequences take the next pieces of each of its
    bins. Where long rests leave too much padding, they are cut after whole quarters of a sequence. The driver sees how many pieces each
    length has, nothing else. Bins are ranked in parts of about ``PART`` pieces, so one with a third of all
    pieces takes more tasks.
    """
    spark = cut.sparkSession
    table = shared.written(cut.withColumnRenamed(id_col, "__id"), "pack-pieces")
    rest = table.where(F.col("length") < LENGTH)
    counts = np.zeros(LENGTH - 1, np.int64)
    for r in rest.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r["length"] - 1] = r["n"]
    plan = _Plan(counts)
    if counts @ np.arange(1, LENGTH) < (1 - PADDING) * LENGTH * plan.sequences and counts[QUARTER:].any():
        other = _Plan(_cut_counts(counts))
        if other.sequences < plan.sequences:
            plan, rest = other, _in_quarters(rest)

    # A row for each length below LENGTH: bounded, so broadcast.
    known = spark.createDataFrame(plan.lengths(), "length long, bin int, parts int")
    binned = rest.join(F.broadcast(known), "length").withColumn("part", F.pmod(F.xxhash64("__id", "start", "ids_crc32"), F.col("parts")).cast("int"))
    before = W.partitionBy("bin").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = binned.groupBy("bin", "part").agg(F.count("*").alias("n")).select("bin", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inner = W.partitionBy("bin", "part").orderBy(F.desc("length"), "__id", "start", "ids_crc32")
    columns = ["__id", "start", "length", "ids_crc32", "doc_tokens"]
    ranked = binned.withColumn("__rank", F.row_number().over(inner)).join(starts, ["bin", "part"])
    ranked = ranked.select(F.col("bin").alias("__bin"), (F.col("__rank") + F.col("before") - 1).alias("__rank"), *columns)
    dealing = plan.dealing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            out = np.zeros(len(bins), np.int64)
            for k in np.unique(bins).tolist():
                mine = np.flatnonzero(bins == k)
                first, each, seq = dealing[k]
                w = np.searchsorted(first, rank[mine], "right") - 1
                out[mine] = seq[w] + (rank[mine] - first[w]) // each[w]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "sequence_id"])

    dealt = ranked.mapInArrow(shared.frugal(run), ranked.withColumn("sequence_id", F.lit(0).cast("long")).schema)
    along = W.partitionBy("sequence_id").orderBy(F.desc("__bin"), "__rank").rowsBetween(W.unboundedPreceding, -1)
    columns += ["sequence_id", "offset"]
    placed = dealt.withColumn("offset", F.coalesce(F.sum("length").over(along), F.lit(0)).cast("long")).select(*columns)
    whole = table.where(F.col("length") == LENGTH)
    # A row for each task.
    tasks = whole.groupBy("task").agg((F.max("serial") + 1).alias("n"))
    first = tasks.select("task", F.coalesce(F.sum("n").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    numbered = whole.join(first, "task").withColumn("sequence_id", F.col("first") + F.col("serial") + plan.sequences).withColumn("offset", F.lit(0).cast("long"))
    return placed.unionByName(numbered.select(*columns)).withColumnRenamed("__id", id_col)
