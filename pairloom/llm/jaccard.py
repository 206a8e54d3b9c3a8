"""N-gram Jaccard join by adaptive multi-match prefixes, and the components of its links.

Documents with one shingle set are one node, told by two 64-bit digests. A node's shingles have one global order: those that the corpus
repeats little first, then by hash. Two nodes of similarity t share at least l of their first
``n - ceil(t n) + l`` shingles, for every l up to their overlap, and even of fewer where both sizes are known.
A node whose shortest prefix would meet many candidates takes a longer one, and is verified only against nodes
that share correspondingly many of the shingles in it.

Components are asked for, not pairs. So each node is first linked with a few hubs that share prefix shingles with
it; then, only pairs across the components found so far are candidates. Near copies by the thousand thus
cost a few verifications each, and no link between different components is lost. Where all links are asked for
(``links``, or their number in ``join``), every pair is a candidate, whatever its components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.components import connected_components

from . import shared, shingles
from .batches import pack_array, unpack_array
from .passages import _joined, _parted

#: Similarity in hundredths.
SIMILARITY = 80
#: Shingles that several texts of a batch hold are counted; of those counted most, so many order the prefixes.
SEEN, HOT_SHINGLES = 2, 400_000
#: Expected candidates of a prefix before it grows, and the most shingles that it grows by.
COST, MOST = 16, 14
#: The fewest shingles that prefixes must share, for sets that have so many.
LEAST = 3
#: The hubs that a node is verified against before components are known.
HUBS = 2
#: Shingles whose prefixes meet in one task, about; members of a shingle that meet in one task at most.
PER_TASK, TILE = 6_000_000, 4096
#: Candidates that are counted together, about.
COUNTED = 1 << 20
#: Digests that are tried until none is that of two sets; the second digest's number.
SEEDS, CHECK = 8, 1000
#: Texts that are worked on together, for local copies and counts.
GATHER = 12 << 20
#: Members that are verified against one hub in one task.
SALT = 512
_LOW = np.uint64((1 << 48) - 1)


def _need(n: np.ndarray) -> np.ndarray:
    """The least overlap of a set of n with any set that it links with."""
    return -(-SIMILARITY * n // 100)


def _early(n: np.ndarray, k: np.ndarray, x: np.ndarray, y: np.ndarray, ell: np.ndarray) -> np.ndarray:
    """Whether a shingle at place x of a set of n and at y of one of k is among those of which ``ell`` must be shared.

    It also tells, by what can be shared before it and after it, whether the sets can be similar at all.
    """
    need = -(-SIMILARITY * (n + k) // (100 + SIMILARITY))
    most = np.minimum(x, y) + np.minimum(n - x, k - y)
    return (x < n - need + ell) & (y < k - need + ell) & (most >= need)


def _groups(batch: pa.RecordBatch, seed: int, bits: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a batch of (id, text) with their sets and digests."""
    held: list = []
    size, first = 0, 0

    def flush(last: int):
        value = np.concatenate([v for v, _ in held])
        at = np.concatenate([[0], *[a[1:] + base for (_, a), base in zip(held, np.cumsum([0, *[len(v) for v, _ in held]]), strict=False)]])
        own = shingles.digests(value, at, seed)
        return batch.slice(first, last - first), value, at, np.where(own > 0, np.maximum(own >> np.uint64(64 - bits), 1), np.uint64(0)) if bits < 64 else own

    for start, value, at in shingles.sets(batch.column(1)):
        held.append((value, at))
        size += 8 * len(value)
        if size > GATHER:
            yield flush(start + len(at) - 1)
            held, size, first = [], 0, start + len(at) - 1
    if held:
        yield flush(batch.num_rows)


def _ids(column: pa.Array) -> np.ndarray:
    """Identifiers as numbers; null is the least number there is."""
    return column.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def _first_copies(digest: np.ndarray) -> np.ndarray:
    """One row of each digest, without that of the empty set."""
    _, first = np.unique(digest, return_index=True)
    return np.sort(first[digest[first] != 0])


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) if not isinstance(v, pa.Array) else v for v in columns.values()], names=list(columns))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for sizes[i] numbers each, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


class Join:
    """The join of one table of (id, text); tables that its steps share lie in the shared folder."""

    def __init__(self, df: DataFrame, id_col: str, text: str, cost: int = COST, seed: int = 0, bits: int = 64):
        self.spark = df.sparkSession
        self.kind = df.schema[id_col].dataType
        self.docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.cost, self.seed, self.bits = cost, seed, bits

    def nodes_and_counts(self) -> DataFrame:
        """kind 0: (id, node, n, check) of each row; kind 1: (0, shingle, texts that hold it, 0) of shingles that a batch repeats."""
        seed, bits = self.seed, self.bits

        def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in found:
                for rows, value, at, digest in _groups(b, seed, bits):
                    ids = rows.column(0).cast(pa.int64())
                    n = np.diff(at)
                    yield _batch({"kind": np.zeros(len(n), np.int8), "id": ids, "node": _signed(digest), "n": n, "check": _signed(shingles.digests(value, at, CHECK))})
                    one = _first_copies(digest)
                    mine = np.sort(value[_ranges(at[one], n[one])])
                    start = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]])) if len(mine) else np.zeros(0, np.int64)
                    count = np.diff(np.concatenate([start, [len(mine)]]))
                    some = count >= SEEN
                    if some.any():
                        yield _batch({"kind": np.ones(int(some.sum()), np.int8), "id": np.zeros(int(some.sum()), np.int64), "node": _signed(mine[start[some]]), "n": count[some], "check": np.zeros(int(some.sum()), np.int64)})

        return shared.written(self.docs.mapInArrow(shared.frugal(run), "kind byte, id long, node long, n long, check long"), "join-nodes")

    def hot(self, counts: DataFrame):
        """At most HOT_SHINGLES of the most repeated shingles with their counts, by shingle; only the order of prefixes hangs on them."""
        rows = counts.groupBy("node").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "node").limit(HOT_SHINGLES).toPandas()
        token = rows["node"].to_numpy(np.int64).view(np.uint64)
        o = np.argsort(token)
        return self.spark.sparkContext.broadcast((token[o], np.minimum(rows["n"].to_numpy(np.int64)[o], 1 << 31).astype(np.uint32)))

    def prefixes(self, hot) -> DataFrame:
        """(bucket, data): the prefixes' postings, packed by batch and bucket."""
        parts, cost, seed, bits = self.parts, self.cost, self.seed, self.bits

        def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens, counts = hot.value
            for b in found:
                for _, value, at, digest in _groups(b, seed, bits):
                    if len(tokens):
                        k = np.minimum(np.searchsorted(tokens, value), len(tokens) - 1)
                        estimate = np.where(tokens[k] == value, counts[k], 0).astype(np.int64)
                    else:
                        estimate = np.zeros(len(value), np.int64)
                    some = np.concatenate([[0], np.cumsum(estimate > 0)])
                    taken, place, node, sizes, ells = [], [], [], [], []
                    for i in _first_copies(digest).tolist():
                        a, z = int(at[i]), int(at[i + 1])
                        n = z - a
                        need = -(-SIMILARITY * n // 100)
                        short = n - need + 1
                        if some[z] == some[a]:
                            taken.append(value[a : a + short + min(need, LEAST) - 1])
                            ell = min(need, LEAST)
                        else:
                            # By estimate, then hash: the hashes are sorted already.
                            o = np.argsort(estimate[a:z], kind="stable")
                            expected = int(estimate[a:z][o[:short]].sum())
                            ell = min(need, LEAST + min(MOST, 2 * int(np.log2(1 + expected / cost))))
                            taken.append(value[a:z][o[: short + ell - 1]])
                        place.append(np.arange(len(taken[-1]), dtype=np.int32))
                        node.append(digest[i])
                        sizes.append(n)
                        ells.append(ell)
                    if not node:
                        continue
                    owner = np.repeat(np.arange(len(node)), [len(t) for t in taken])
                    token, place = np.concatenate(taken), np.concatenate(place)
                    bucket = (token % np.uint64(parts)).astype(np.int64)
                    o = np.argsort(bucket, kind="stable")
                    cuts = np.searchsorted(bucket[o], np.arange(parts + 1))
                    node, sizes, ells = np.array(node, np.uint64), np.array(sizes, np.uint32), np.array(ells, np.uint8)
                    rows: dict = {"bucket": [], "data": []}
                    for k in np.flatnonzero(np.diff(cuts)).tolist():
                        w = o[cuts[k] : cuts[k + 1]]
                        own, index = np.unique(owner[w], return_inverse=True)
                        t = token[w] >> np.uint64(8)
                        rows["bucket"].append(k)
                        rows["data"].append(_joined([(t & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), ((t >> np.uint64(32)) & np.uint64(255)).astype("u1").tobytes(), pack_array(index.astype("<i4"), True), pack_array(place[w], True), node[own].tobytes(), pack_array(sizes[own]), pack_array(ells[own])]))
                    yield _batch({"bucket": np.array(rows["bucket"], np.int64), "data": pa.array(rows["data"], pa.binary())})

        return self.docs.mapInArrow(shared.frugal(run), "bucket long, data binary")

    def lists(self, prefixes: DataFrame) -> DataFrame:
        """(token, node, n, place, ell): the postings of prefix shingles that at least two nodes hold."""

        def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = []
            for b in found:
                for bucket, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    low, high, index, place, node, sizes, ells = _parted(data.as_py())
                    index = unpack_array(index, "<i4", True)
                    token = np.frombuffer(low, "<u4").astype(np.uint64) | (np.frombuffer(high, "u1").astype(np.uint64) << np.uint64(32)) | np.uint64(bucket << 40)
                    held.append((token, np.frombuffer(node, np.uint64)[index], unpack_array(sizes, "<u4")[index], unpack_array(place, "<i4", True), unpack_array(ells, "u1")[index]))
            if not held:
                return
            token, node, n, place, ell = (np.concatenate(c) for c in zip(*held, strict=True))
            del held
            # Tokens that occur once go first; then copies of a posting.
            o = np.argsort(token, kind="stable")
            t = token[o]
            again = np.zeros(len(t), bool)
            again[1:] = t[1:] == t[:-1]
            again[:-1] |= again[1:]
            o = o[again]
            o = o[np.lexsort((node[o], token[o]))]
            t, v = token[o], node[o]
            o = o[np.concatenate([[True], (t[1:] != t[:-1]) | (v[1:] != v[:-1])])] if len(o) else o
            t = token[o]
            several = np.zeros(len(t), bool)
            several[1:] = t[1:] == t[:-1]
            several[:-1] |= several[1:]
            o = o[several]
            # Of two holders alone it is known whether the shingle stands early enough in both.
            t = token[o]
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
            size = np.diff(np.concatenate([first, [len(t)]]))
            x = first[size == 2]
            late = x[~_early(n[o[x]].astype(np.int64), n[o[x + 1]].astype(np.int64), place[o[x]], place[o[x + 1]], np.minimum(ell[o[x]], ell[o[x + 1]]).astype(np.int64))]
            keep = np.ones(len(o), bool)
            keep[late] = keep[late + 1] = False
            o = o[keep]
            for a in range(0, len(o), 1 << 16):
                w = o[a : a + (1 << 16)]
                yield _batch({"token": _signed(token[w]), "node": _signed(node[w]), "n": n[w].astype(np.int32), "place": place[w].astype(np.int32), "ell": ell[w].astype(np.int8)})

        dealt = prefixes.repartition(self.parts, "bucket")
        return shared.written(dealt.mapInArrow(shared.frugal(run), "token long, node long, n int, place int, ell byte"), "join-lists")

    def sets(self, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
        """(node, n, data): the sets of wanted nodes, from one document each.

        A filter of bounded size says which documents to take; what it lets through too much is never joined.
        """
        # A power of two of bits, 16 for each node, at least 2^16 and at most 2^28 (32 MB). Of more nodes than that
        # holds apart, more sets go to the join, at most each document's once.
        held = wanted.select("node").distinct().join(nodes.select("node", "rep"), "node")
        bits = 1 << min(28, max(16, (16 * max(1, held.count())).bit_length()))
        seed, digest_bits = self.seed, self.bits

        def places(node: np.ndarray, rep: np.ndarray) -> np.ndarray:
            return (shingles.mix(node.view(np.uint64) ^ shingles.mix(rep.view(np.uint64))) % np.uint64(bits)).astype(np.int64)

        def mark(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in found:
                if b.num_rows:
                    p = places(_ids(b.column(0)), _ids(b.column(1)))
                    yield _batch({"word": p >> 5, "bits": np.int64(1) << (p & 31)})

        words = held.select("node", "rep").mapInArrow(shared.frugal(mark), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
        table = np.zeros(bits >> 5, np.uint32)
        table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
        sent = self.spark.sparkContext.broadcast(table)

        def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in found:
                for rows, value, at, digest in _groups(b, seed, digest_bits):
                    p = places(digest, _ids(rows.column(0)))
                    hit = (sent.value[p >> 5] >> (p & 31).astype(np.uint32)) & 1 == 1
                    one = _first_copies(np.where(hit, digest, np.uint64(0)))
                    if len(one):
                        low = value & _LOW  # 48 bits of each; equal shingles stay equal
                        data = [np.sort(low[at[i] : at[i + 1]]).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for i in one.tolist()]
                        yield _batch({"node": _signed(digest[one]), "n": np.diff(at)[one].astype(np.int32), "data": pa.array(data, pa.binary())})

        return shared.written(self.docs.mapInArrow(shared.frugal(run), "node long, n int, data binary"), "join-sets")

    def verified(self, edges: DataFrame, nodes: DataFrame) -> DataFrame:
        """The edges (a, b) whose sets are similar, by the sets of the nodes that stand in them."""
        edges = shared.written(edges.select("a", "b"), "join-edges")
        ends = edges.select(F.col("a").alias("node")).union(edges.select("b"))
        sets = self.sets(nodes, ends)
        links = self.linked(edges, sets)
        shared.dropped(sets)
        return links

    def linked(self, edges: DataFrame, sets: DataFrame) -> DataFrame:
        """The edges (a, b) whose sets are similar. Every b's members are dealt in groups of SALT; its set goes to each group once."""
        degree = edges.groupBy("b").agg(F.count("*").alias("degree"))
        groups = F.floor(F.col("degree") / SALT).cast("int")
        salted = edges.join(degree, "b").withColumn("salt", F.pmod(F.xxhash64("a"), groups + 1).cast("int"))
        hubs = degree.select("b", F.explode(F.sequence(F.lit(0), groups)).alias("salt"))
        # Where each set goes: with its hub, and a hub to each group of its members.
        goes = salted.select(F.col("a").alias("node"), "b", "salt", F.lit(1).alias("turn")).unionByName(hubs.select(F.col("b").alias("node"), "b", "salt", F.lit(0).alias("turn")))
        both = goes.join(sets, "node").select("b", "salt", "turn", F.col("node").alias("a"), "n", "data")

        def members(data: bytes) -> np.ndarray:
            out = np.zeros((len(data) // 6, 8), np.uint8)
            out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
            return out.view(np.uint64).ravel()

        def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hub, own, own_n = None, np.zeros(0, np.uint64), 0
            for batch in found:
                a_out, b_out = [], []
                b, salt, turn, a, n, data = batch.columns
                for i, key in enumerate(zip(b.to_pylist(), salt.to_pylist(), turn.to_pylist(), a.to_pylist(), n.to_pylist(), strict=True)):
                    if key[2] == 0:
                        hub, own, own_n = key[:2], members(data[i].as_py()), key[4]
                        continue
                    assert hub == key[:2], "a hub's set is missing"
                    if 100 * min(own_n, key[4]) < SIMILARITY * max(own_n, key[4]):
                        continue
                    m = members(data[i].as_py())
                    k = np.searchsorted(own, m)
                    k[k == len(own)] = 0
                    common = int((own[k] == m).sum())
                    if 100 * common >= SIMILARITY * (own_n + key[4] - common):
                        a_out.append(key[3])
                        b_out.append(key[0])
                if a_out:
                    yield _batch({"a": np.array(a_out, np.int64), "b": np.array(b_out, np.int64)})

        dealt = both.repartition(self.parts, "b", "salt").sortWithinPartitions("b", "salt", "turn")
        return shared.written(dealt.mapInArrow(shared.frugal(run), "a long, b long"), "join-links")

    @staticmethod
    def hubs(lists: DataFrame) -> DataFrame:
        """(a, b): for each node some hubs of its lists, those of most of its lists first.

        A list's hub is the node most of whose prefix the corpus shares, a text that the others vary.
        """
        weight = lists.groupBy("node").agg((F.count("*") * 1000 / F.max("n")).cast("int").alias("weight"))
        chosen = lists.join(weight, "node").groupBy("token").agg(F.max(F.struct("weight", "node", "n", "place", "ell")).alias("hub"))
        both = lists.join(chosen.select("token", "hub"), "token").where("node <> hub.node")
        # As in _early: only hubs that the sizes and places leave possible.
        need = F.ceil((F.col("n") + F.col("hub.n")) * SIMILARITY / F.lit(100 + SIMILARITY))
        ell = F.least("ell", "hub.ell")
        most = F.least("place", "hub.place") + F.least(F.col("n") - F.col("place"), F.col("hub.n") - F.col("hub.place"))
        both = both.where((F.col("place") < F.col("n") - need + ell) & (F.col("hub.place") < F.col("hub.n") - need + ell) & (most >= need)).withColumn("b", F.col("hub.node"))
        met = both.groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("c"), F.max("n").alias("n"))
        # A text that shares one prefix shingle in four may well be similar; the others are left to the last step.
        met = met.where((F.col("c") >= LEAST) & (F.col("c") * 20 >= F.col("n")))
        best = met.groupBy("a").agg(F.sort_array(F.collect_list(F.struct(-F.col("c"), "b"))).alias("hubs"))
        return best.select("a", F.explode(F.transform(F.slice("hubs", 1, HUBS), lambda x: x["b"])).alias("b"))

    @staticmethod
    def tiled(lists: DataFrame, tile: int = TILE) -> DataFrame:
        """lists with ``x``, ``y`` and ``own``: a shingle of many members is cut in classes (own), and each two classes meet in a tile (x, y).

        Every pair of members meets in one tile, and no tile has more than about two classes of ``tile`` members.
        """
        whole = lists.withColumn("own", F.lit(0)).withColumn("x", F.lit(0)).withColumn("y", F.lit(0))
        many = shared.written(lists.groupBy("token").agg(F.ceil(F.count("*") / tile).cast("int").alias("classes")).where("classes > 1"), "join-many")
        if many.isEmpty():
            return whole
        few = whole.join(many.select("token"), "token", "left_anti")
        cut = lists.join(many, "token").withColumn("own", F.pmod(F.xxhash64("node"), F.col("classes")).cast("int"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("classes") - 1)))
        cut = cut.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
        return few.unionByName(cut.select(*few.columns))

    def across(self, lists: DataFrame, labels: DataFrame, tile: int = TILE) -> DataFrame:
        """(a, b): pairs of different components that share as many prefix shingles as both prefixes' lengths ask for."""
        named = lists.join(labels.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = named.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("token")
        open_ = shared.written(named.join(mixed, "token", "left_semi").select("token", "node", "n", "place", "ell", "label"), "join-open")

        def pairs(t: dict[str, np.ndarray], out: dict) -> None:
            """One tile's members with their fellows of lesser number, a block of them at a time."""
            m = len(t["node"])
            step = max(1, (1 << 18) // m)
            one_class = t["x"][0] == t["y"][0]
            for x in range(0, m, step):
                i, j = np.meshgrid(np.arange(x, min(x + step, m)), np.arange(m), indexing="ij")
                ell = np.minimum(t["ell"][i], t["ell"][j]).astype(np.int64)
                ok = (t["node"][i] > t["node"][j]) & (t["label"][i] != t["label"][j]) & _early(t["n"][i].astype(np.int64), t["n"][j].astype(np.int64), t["place"][i], t["place"][j], ell)
                if not one_class:  # a class meets itself in its own tile
                    ok &= t["own"][i] != t["own"][j]
                for row in np.flatnonzero(ok.any(axis=1)).tolist():
                    k = np.flatnonzero(ok[row])
                    out["a"].append(int(t["node"][x + row]))
                    out["data"].append(t["node"][k].tobytes() + ell[row, k].astype(np.uint8).tobytes())

        def starts(t: dict[str, np.ndarray]) -> np.ndarray:
            """Where tiles begin, and the end."""
            change = np.zeros(len(t["token"]) - 1, bool)
            for key in ("token", "x", "y"):
                change |= t[key][1:] != t[key][:-1]
            return np.flatnonzero(np.concatenate([[True], change, [True]]))

        def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[dict[str, np.ndarray]] = []  # the last tile so far
            for b in found:
                if not b.num_rows:
                    continue
                t = {name: b.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(b.schema.names)}
                cuts = starts(t)
                goes_on = held and all(held[-1][k][-1] == t[k][0] for k in ("token", "x", "y"))
                if held and not goes_on:
                    yield from tile_of(held)
                    held = []
                if len(cuts) == 2:
                    held.append(t)
                    continue
                if goes_on:
                    yield from tile_of([*held, {k: v[: cuts[1]] for k, v in t.items()}])
                    cuts = cuts[1:]
                yield from whole(t, cuts[:-1])
                held = [{k: v[cuts[-2] :] for k, v in t.items()}]
            if held:
                yield from tile_of(held)

        def tile_of(parts: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            t = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            yield from whole(t, np.array([0, len(t["token"])]))

        def whole(t: dict[str, np.ndarray], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
            """The tiles between these cuts, those of two members all at once."""
            size = np.diff(cuts)
            i = cuts[:-1][size == 2]
            j = i + 1
            ell = np.minimum(t["ell"][i], t["ell"][j]).astype(np.int64)
            ok = (t["label"][i] != t["label"][j]) & _early(t["n"][i].astype(np.int64), t["n"][j].astype(np.int64), t["place"][i], t["place"][j], ell)
            ok &= (t["x"][i] == t["y"][i]) | (t["own"][i] != t["own"][j])
            a, b, ell = np.maximum(t["node"][i], t["node"][j])[ok], np.minimum(t["node"][i], t["node"][j])[ok], ell[ok].astype(np.uint8)
            raw = np.concatenate([b.view(np.uint8).reshape(-1, 8), ell.reshape(-1, 1)], 1)
            out = {"a": a.tolist(), "data": [r.tobytes() for r in raw]}
            for x, m in zip(cuts[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                pairs({k: v[x : x + m] for k, v in t.items()}, out)
            if out["a"]:
                yield _batch({"a": np.array(out["a"], np.int64), "data": pa.array(out["data"], pa.binary())})

        def enough(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
            """Whole nodes' fellows of all their shingles; those that come up often enough."""
            sizes = [len(data) // 9 for _, data in held]
            a = np.repeat(np.array([node for node, _ in held], np.int64), sizes)
            b = np.concatenate([np.frombuffer(data, np.int64, m) for (_, data), m in zip(held, sizes, strict=True)])
            ell = np.concatenate([np.frombuffer(data, np.uint8, m, 8 * m) for (_, data), m in zip(held, sizes, strict=True)])
            o = np.lexsort((b, a))
            a, b, ell = a[o], b[o], ell[o]
            start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            some = start[np.diff(np.concatenate([start, [len(a)]])) >= ell[start]]
            return _batch({"a": a[some], "b": b[some]})

        def counted(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for batch in found:
                for node, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if size > COUNTED and node != held[-1][0]:
                        yield enough(held)
                        held, size = [], 0
                    held.append((node, data.as_py()))
                    size += len(held[-1][1]) // 9
            if held:
                yield enough(held)

        dealt = self.tiled(open_, tile).repartition(self.parts, "token", "x", "y").sortWithinPartitions("token", "x", "y")
        met = dealt.mapInArrow(shared.frugal(run), "a long, data binary")
        return met.repartition(self.parts, "a").sortWithinPartitions("a").mapInArrow(shared.frugal(counted), "a long, b long")


def _nodes(df: DataFrame, id_col: str, text: str, cost: int, bits: int) -> tuple[Join, DataFrame, DataFrame, DataFrame]:
    """The join with its rows by node, its nodes (node, rep, n, copies) and the postings of their prefixes."""
    for seed in range(SEEDS):
        j = Join(df, id_col, text, cost, seed, bits)
        found = j.nodes_and_counts()
        docs = found.where("kind = 0")
        sets = docs.where("n > 0").groupBy("node").agg(F.min("id").alias("rep"), F.max("n").cast("int").alias("n"), F.count("*").alias("copies"), F.min("check").alias("low"), F.max("check").alias("high"))
        nodes = shared.written(sets, "join-reps")
        if nodes.where("low <> high").isEmpty():
            break
        shared.dropped(found)
        shared.dropped(nodes)
    else:
        raise RuntimeError("every digest is that of two sets")
    j.parts = max(j.parts, -(-(nodes.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0) // PER_TASK))
    return j, docs, nodes, j.lists(j.prefixes(j.hot(found.where("kind = 1"))))


def _all_links(j: Join, nodes: DataFrame, lists: DataFrame, tile: int) -> DataFrame:
    """(a, b) of every two nodes that link, once."""
    apart = nodes.select("node", F.col("node").alias("component"))
    return shared.written(j.verified(j.across(lists, apart, tile), nodes).distinct(), "join-every")


def _named(j: Join, docs: DataFrame, nodes: DataFrame, every: DataFrame, more: dict) -> DataFrame:
    """(id, node, n_shingles, component_id) of each row, with the columns of ``more``, each a table's (node, value), 0 where it has none."""
    known = nodes.select("node", "rep", "copies").join(connected_components(every, "a", "b"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    for name, table in more.items():
        known = known.join(table.select("node", F.col("value").alias(name)), "node", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    known = shared.written(known, "join-known")
    best = shared.written(known.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("members")), "join-best")
    least = shared.joined_by_key(known, best, "component", "members")
    least = shared.written(least.select("node", "component_id", *more, "copies", F.col("copies").alias("rows")), "join-least")
    return shared.joined_by_key(docs.select("id", "node", F.col("n").alias("n_shingles")), least, "node", "rows")


def join(df: DataFrame, id_col: str = "doc_id", text: str = "text", cost: int = COST, bits: int = 64, tile: int = TILE, count_links: bool = False) -> DataFrame:
    """(id, n_shingles, component_id) of every row of df, and n_links if ``count_links``.

    Sets are of distinct 5-word shingles; two documents link where the intersection is at least 80 hundredths
    of the union. component_id is the least identifier that links reach, the document's own included. Documents
    without words or text have the empty set and link with nothing. Documents with one set are linked, be they
    copies or repeated rows; a null identifier never names a component, so one is null where no member has an
    identifier. An empty table gives no rows; other columns are not read, whatever their names.

    count_links: n_links is how many other rows a row links with, copies of its own set among them. Each two
    different sets that may be similar are verified for it, within components too.
    bits: of the digest that names a set; if it names two sets, another one is taken.
    """
    j, docs, nodes, lists = _nodes(df, id_col, text, cost, bits)
    more = {}
    if count_links:
        every = _all_links(j, nodes, lists, tile)
        both = every.unionByName(every.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # A linked set counts as often as rows have it.
        linked = both.join(nodes.select(F.col("node").alias("b"), "copies"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("value"))
        more = {"others": linked}
    else:
        links = j.verified(j.hubs(lists), nodes)
        labels = shared.written(connected_components(links, "a", "b"), "join-labels")
        every = links.unionByName(j.verified(j.across(lists, labels, tile), nodes))
    out = _named(j, docs, nodes, every, more)
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    n_links = [(F.coalesce("others", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links")] if count_links else []
    return out.select(F.col("id").cast(j.kind).alias(id_col), "n_shingles", own.cast(j.kind).alias("component_id"), *n_links)


def links(df: DataFrame, id_col: str = "doc_id", text: str = "text", cost: int = COST, bits: int = 64, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Every link: pairs (a, b) of class representatives, and membership (id, class, n_shingles) of every row.

    A class is the rows of one set, named by a number; rows of one class link with each other, and pairs tell each two
    different classes that link, once. Rows without words have no class.
    """
    j, docs, nodes, lists = _nodes(df, id_col, text, cost, bits)
    members = docs.select(F.col("id").cast(j.kind).alias(id_col), F.when(F.col("n") > 0, F.col("node")).alias("class"), F.col("n").alias("n_shingles"))
    return _all_links(j, nodes, lists, tile), members
