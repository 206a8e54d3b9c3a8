"""Suffix-array dedup: bytes that a 50-byte string covers which also starts in an earlier document.

Sorting every suffix of a corpus would move each byte many times. So the suffixes that can have an equal
elsewhere are found first:

1. A window is one string of ``LENGTH`` bytes. Its anchors are its ``K``-byte strings of the least hash, so
   equal windows hold equal anchors at equal places. The windows of a text that share their leftmost anchor
   are a stretch (at most ``2 * LENGTH - K`` bytes). Each window lies in one stretch.
2. Anchors meet by their hash, a few bytes each. Stretches whose anchor stands in several documents go on, one
   of those that a batch of texts holds byte by byte the same. The hash decides nothing else: equal windows
   always go on, and what goes on is decided by its bytes.
3. The suffixes of these stretches are sorted: bucket by bucket of anchors, block by block of leading bytes,
   ties resolved by the ranks of a difference cover (``suffixes``). Neighbours that agree in ``LENGTH`` bytes
   are equal windows; the least document of each run keeps its own. Of stretches that are the same as a whole,
   byte by byte, one is sorted for all.

An anchor that occurs in more than ``HOT`` stretches of a bucket sends its windows one by one, dealt by their
contents, so no frequent passage gathers in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import batches, shared
from .batches import pack_array, unpack_array
from .suffixes import CoverSorter, big, words_of

LENGTH, K = 50, 20
WIDE = LENGTH - K + 1
WIDEST = 2 * LENGTH - K
HOT = 5000
#: Bytes of text that a worker hands back at once, about.
PIECE = 1 << 20
#: Batches of texts whose stretches meet in one task, about.
BATCHES = 8
#: Window starts that are hashed at once; the arrays fit the processor's cache.
SEGMENT = 1 << 17
_MULT, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_BASE = 0xD6E8FEB86659FD93
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
JOINS, JOINS_HOT = 1, 2


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(_MULT)
    h ^= h >> np.uint64(29)
    return h


def _rolling(x: np.ndarray, k: int) -> np.ndarray:
    """A hash of x[i : i + k] for each i, by doubling."""
    part, size = _BYTES[x], 1
    out, done = None, 0
    while True:
        if k & size:
            if out is None:
                out, done = part, size
            else:
                n = len(x) - done - size + 1
                out = out[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + part[done : done + n]
                done += size
        if 2 * size > k:
            return _mix(out)
        n = len(part) - size
        part = part[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + part[size : size + n]
        size *= 2


def _slide(a: np.ndarray, w: int, op) -> np.ndarray:
    """op over a[i : i + w] for each i."""
    n, size = len(a) - w + 1, 1
    while 2 * size <= w:
        a = op(a[:-size], a[size:])
        size *= 2
    return op(a[:n], a[w - size : w - size + n]) if size < w else a[:n]


def _segment(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each window of x, in runs with one anchor: first and last start, the anchor's hash, the stretch's hash."""
    h = _rolling(x, K)
    least = _slide(h, WIDE, np.minimum)
    edge = np.zeros(WIDE - 1, np.uint64)
    anchors = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), WIDE, np.maximum) == h)
    # The leftmost anchor at or after a window's start whose hash is the window's least.
    before = np.zeros(len(h) + 1, np.int64)
    before[anchors + 1] = 1
    q = np.cumsum(before)[: len(least)]
    wrong = np.flatnonzero(h[anchors[q]] != least)
    while len(wrong):
        q[wrong] += 1
        wrong = wrong[h[anchors[q[wrong]]] != least[wrong]]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    last = np.concatenate([first[1:], [len(q)]]) - 1
    return h, first, last, anchors[q[first]]


def stretches(x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts that lie one after the other: (text, first window, last window, anchor hash, stretch hash).

    Windows never cross texts. A stretch is also cut where a segment ends, which costs a match of whole
    stretches there but no window.
    """
    out = []
    for a in range(0, max(0, len(x) - LENGTH + 1), SEGMENT):
        part = x[a : a + SEGMENT + LENGTH - 1]
        h, first, last, anchor = _segment(part)
        # Cut runs where a text ends: its last LENGTH - 1 bytes start no window.
        text = np.searchsorted(offsets, a + first, "right") - 1
        ends = offsets[1:]
        inner = ends[(ends > a) & (ends <= a + len(part) - LENGTH)] - a
        if len(inner):
            owner = np.searchsorted(first, inner, "right") - 1
            keep = last[owner] >= inner
            owner, more = owner[keep], inner[keep]
            first = np.concatenate([first, more])
            last = np.concatenate([last, last[owner]])
            anchor = np.concatenate([anchor, anchor[owner]])
            o = np.argsort(first, kind="stable")
            first, last, anchor = first[o], last[o], anchor[o]
            distinct = np.concatenate([first[1:] != first[:-1], [True]])  # a text may be empty
            first, last, anchor = first[distinct], last[distinct], anchor[distinct]
            last = np.minimum(last, np.concatenate([first[1:] - 1, [len(part)]]))
            text = np.searchsorted(offsets, a + first, "right") - 1
        last = np.minimum(last, offsets[text + 1] - LENGTH - a)
        some = np.flatnonzero((last >= first) & (anchor >= first))
        text, first, last, anchor = text[some], first[some], last[some], anchor[some]
        # K-byte strings at these places overlap or meet, so together they are the stretch.
        size = last - first + LENGTH
        own = h[first + size - K] * np.uint64(0xA24BAED4963EE407) + (size * 131 + anchor - first).astype(np.uint64)
        for at in (np.minimum(first + 2 * K, first + size - K), first + K, first):
            own = _mix(own ^ (h[at] * np.uint64(0x9FB21C651E98DF25)))
        out.append((text, a + first, a + last, h[anchor], own))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _order(ids: pa.Array) -> np.ndarray:
    """Identifiers as numbers; null comes last."""
    return ids.cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def _words(x: np.ndarray, first: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """The strings x[first : first + size] of at most WIDEST bytes, as 8-byte words one after the other; bytes beyond them are 0."""
    padded = np.concatenate([x, np.zeros(WIDEST + 8, np.uint8)])
    view = words_of(padded)
    for k in range(0, WIDEST, 8):
        word = big(view[first + np.minimum(k, size)])
        left = np.clip(size - k, 0, 8)
        word = np.where(left > 0, word >> (np.uint64(8) * (8 - np.maximum(left, 1)).astype(np.uint64)), np.uint64(0))
        yield word


def _same(x: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether the strings at a and b are the same, byte by byte."""
    same = size_a == size_b
    for u, v in zip(_words(x, a, size_a), _words(x, b, size_b), strict=True):
        same &= u == v
    return same


class _Batch:
    """A batch's stretches; ``head`` is one of each different stretch, of the least document that holds it."""

    def __init__(self, rows: pa.RecordBatch, at_id: int, at_text: int, buckets: int):
        self.x, self.offsets = batches.text_bytes(rows, at_text)
        self.text, self.first, self.last, anchor, own = stretches(self.x, self.offsets)
        self.doc = _order(rows.column(at_id))[self.text]
        o = np.lexsort((self.doc, own))
        new = np.concatenate([[True], own[o][1:] != own[o][:-1]]) if len(o) else np.zeros(0, bool)
        # Hashes only bring likely copies together.
        i = np.flatnonzero(~new)
        size = self.last - self.first + LENGTH
        new[i] = ~_same(self.x, self.first[o[i - 1]], self.first[o[i]], size[o[i - 1]], size[o[i]])
        heads = o[new]
        # Heads in the order of the texts, bucket by bucket.
        bucket = (anchor[heads] % np.uint64(buckets)).astype(np.int64)
        turn = np.lexsort((heads, bucket))
        self.head, self.bucket = heads[turn], bucket[turn]
        back = np.empty(len(turn), np.int64)
        back[turn] = np.arange(len(turn))
        self.group = np.empty(len(o), np.int64)
        self.group[o] = back[np.cumsum(new) - 1] if len(o) else o
        self.anchor = (anchor[self.head] >> np.uint64(32)).astype(np.uint32)
        self.cuts = np.searchsorted(self.bucket, np.arange(buckets + 1))


def _records(rows: dict, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[n], pa.binary() if n == "data" else pa.int64()) for n in names], names=names)


def _joined(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _parted(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _by_bucket(found: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, list[bytes]]]]]:
    """(bucket, [(batch, parts of the record)]) of rows that come bucket by bucket."""
    now, held = None, []
    for b in found:
        for bucket, number, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append((number, _parted(data.as_py())))
    if held:
        yield now, held


SHIPPED = "bucket long, batch long, data binary"


def _covered(x: np.ndarray, docs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each stretch of x a bit for each of its windows that a lesser document has too."""
    first = np.cumsum(sizes) - sizes
    # Stretches that are the same, byte by byte, are sorted once, as their least document's.
    own = sizes.astype(np.uint64)
    for word in _words(x, first, sizes):
        own = _mix(own * np.uint64(_BASE) + word)
    o = np.lexsort((docs, own))
    i = np.flatnonzero(own[o][1:] == own[o][:-1]) + 1
    new = np.ones(len(o), bool)
    new[i] = ~_same(x, first[o[i - 1]], first[o[i]], sizes[o[i - 1]], sizes[o[i]])
    one = o[new]
    group = np.empty(len(o), np.int64)
    group[o] = np.cumsum(new) - 1
    windows = sizes[one] - LENGTH + 1
    ends = np.cumsum(sizes[one])
    text = x[np.repeat(first[one] - (ends - sizes[one]), sizes[one]) + np.arange(ends[-1])]
    stretch = np.repeat(np.arange(len(one)), windows)
    step = np.arange(len(stretch)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = (ends - sizes[one])[stretch] + step
    place = np.full(len(text), -1, np.int64)  # from a suffix back to its window
    place[at] = np.arange(len(at))
    mask = np.zeros(len(one), np.uint64)
    sorter = CoverSorter(text, LENGTH)
    for block in sorter.blocks(at):
        start = np.concatenate([[True], ~sorter.agree(block[:-1], block[1:])])
        w = place[block]
        doc = docs[one][stretch[w]]
        least = np.minimum.reduceat(doc, np.flatnonzero(start))[np.cumsum(start) - 1]
        hit = w[doc > least]
        np.bitwise_or.at(mask, stretch[hit], np.uint64(1) << step[hit].astype(np.uint64))
    every = (np.uint64(1) << windows.astype(np.uint64)) - np.uint64(1)
    return np.where(docs > docs[one][group], every[group], mask[group])


def _judged(df: DataFrame, id_col: str, text: str, schema: StructType, made: Callable[[pa.RecordBatch, pa.ListArray], pa.RecordBatch], hot: int = HOT) -> DataFrame:
    """Rows of schema: what made gives of df's rows and the spans that go from each, ``PIECE`` bytes of text at a time, about."""
    spark = df.sparkSession
    at_id, at_text = df.columns.index(id_col), df.columns.index(text)
    packed = batches.batched(df, text, "dedup-batches")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-packed.count() // BATCHES))
    buckets = 4 * n

    def ship(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for number, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = _Batch(batches.rows_of(data.as_py()), at_id, at_text, buckets)
                rows: dict = {"bucket": [], "batch": [], "data": []}
                doc = t.doc[t.head]
                for k in np.flatnonzero(np.diff(t.cuts)).tolist():
                    a, z = t.cuts[k], t.cuts[k + 1]
                    rows["bucket"].append(k)
                    rows["batch"].append(number)
                    rows["data"].append(_joined([t.anchor[a:z].tobytes(), pack_array(doc[a:z], delta=True)]))
                if rows["bucket"]:
                    yield _records(rows, ["bucket", "batch", "data"])

    def judge(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, part in _by_bucket(found):
            docs = [unpack_array(p[1], "<i8", delta=True) for _, p in part]
            anchor, doc = np.concatenate([np.frombuffer(p[0], np.uint32) for _, p in part]), np.concatenate(docs)
            o = np.argsort(anchor, kind="stable")
            a, d = anchor[o], doc[o]
            start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            size = np.diff(np.concatenate([start, [len(a)]]))
            wide = np.minimum.reduceat(d, start) < np.maximum.reduceat(d, start)
            flag = np.zeros(len(doc), np.uint8)
            flag[o] = np.repeat(np.where(wide, np.where(size > hot, JOINS_HOT, JOINS), 0), size)
            rows: dict = {"bucket": [], "batch": [], "data": []}
            sizes = np.cumsum([0, *map(len, docs)])
            for i, (number, _) in enumerate(part):
                own_flags = flag[sizes[i] : sizes[i + 1]]
                if own_flags.any():
                    rows["bucket"].append(bucket)
                    rows["batch"].append(number)
                    rows["data"].append(pack_array(own_flags))
            if rows["bucket"]:
                yield _records(rows, ["bucket", "batch", "data"])

    flags = packed.mapInArrow(shared.frugal(ship), SHIPPED).repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(shared.frugal(judge), SHIPPED)
    flags = shared.written(flags, "dedup-flags")
    # A batch without flags still covers the copies that its own documents hold.
    by_batch = flags.groupBy("batch").agg(F.collect_list(F.struct("bucket", "data")).alias("flags"))

    def send(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for i in range(b.num_rows):
                number = b.column(0)[i].as_py()
                t = _Batch(batches.rows_of(b.column(1)[i].as_py()), at_id, at_text, buckets)
                flag = np.zeros(len(t.head), np.uint8)
                for f in b.column(2)[i].as_py() or []:
                    k = f["bucket"]
                    flag[t.cuts[k] : t.cuts[k + 1]] = unpack_array(f["data"], "u1")
                rows: dict = {"bucket": [], "batch": [], "data": []}

                def put(bucket: np.ndarray, head: np.ndarray, first: np.ndarray, size: np.ndarray, skip: np.ndarray) -> None:
                    o = np.argsort(bucket, kind="stable")
                    cuts = np.flatnonzero(np.diff(bucket[o], prepend=-1, append=-2))
                    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                        some = o[x:y]
                        ends = np.cumsum(size[some])
                        at = np.repeat(first[some] - (ends - size[some]), size[some]) + np.arange(ends[-1])
                        rows["bucket"].append(int(bucket[some[0]]))
                        rows["batch"].append(number)
                        rows["data"].append(_joined([pack_array(head[some].astype("<i8"), True), pack_array(t.doc[t.head[head[some]]], True), pack_array(size[some].astype(np.uint8)), pack_array(skip[some].astype(np.uint8)), batches.packed(t.x[at].tobytes())]))

                whole = np.flatnonzero(flag == JOINS)
                h = t.head[whole]
                put(t.bucket[whole], whole, t.first[h], t.last[h] - t.first[h] + LENGTH, np.zeros(len(h), np.int64))
                single = np.flatnonzero(flag == JOINS_HOT)
                if len(single):
                    h = t.head[single]
                    count = t.last[h] - t.first[h] + 1
                    head = np.repeat(single, count)
                    skip = np.arange(len(head)) - np.repeat(np.cumsum(count) - count, count)
                    first = np.repeat(t.first[h], count) + skip
                    words = np.lib.stride_tricks.sliding_window_view(t.x, LENGTH)[first].astype(np.uint64)
                    dealt = np.zeros(len(first), np.uint64)
                    for c in range(LENGTH):
                        dealt = dealt * np.uint64(_BASE) + _BYTES[words[:, c].astype(np.int64)]
                    put((_mix(dealt) % np.uint64(buckets)).astype(np.int64) + buckets, head, first, np.full(len(first), LENGTH), skip)
                # Copies that a lesser document of the batch holds are covered; the others wait for what was sent.
                covered = t.doc > t.doc[t.head[t.group]]
                waits = np.flatnonzero(~covered & (flag[t.group] >= JOINS))
                rows["bucket"].append(-1)
                rows["batch"].append(number)
                rows["data"].append(_joined([pack_array(t.first[covered].astype("<i8"), True), pack_array(t.last[covered].astype("<i8"), True), pack_array(t.group[waits].astype("<i8"), True), pack_array(t.first[waits].astype("<i8"), True)]))
                yield _records(rows, ["bucket", "batch", "data"])

    sent = shared.written(packed.join(by_batch, "batch", "left").mapInArrow(shared.frugal(send), SHIPPED), "dedup-stretches")

    def sort(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, part in _by_bucket(found):
            heads = [unpack_array(p[0], "<i8", True) for _, p in part]
            docs, sizes, skips = (np.concatenate([unpack_array(p[k], t, k == 1) for _, p in part]) for k, t in ((1, "<i8"), (2, "u1"), (3, "u1")))
            x = np.concatenate([np.frombuffer(batches.unpacked(p[4]), np.uint8) for _, p in part])
            m = _covered(x, docs, sizes.astype(np.int64)) << skips.astype(np.uint64)
            cuts = np.cumsum([0, *map(len, heads)])
            rows: dict = {"bucket": [], "batch": [], "data": []}
            for i, (number, _) in enumerate(part):
                mask = m[cuts[i] : cuts[i + 1]]
                if (some := mask != 0).any():
                    rows["bucket"].append(bucket)
                    rows["batch"].append(number)
                    rows["data"].append(_joined([pack_array(heads[i][some], True), pack_array(mask[some])]))
            if rows["bucket"]:
                yield _records(rows, ["bucket", "batch", "data"])

    resolved = shared.written(sent.where("bucket >= 0").repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(shared.frugal(sort), SHIPPED), "dedup-resolved")
    parts = resolved.unionByName(sent.where("bucket < 0")).groupBy("batch").agg(F.collect_list(F.struct("bucket", "data")).alias("parts"))

    def finish(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for i in range(b.num_rows):
                rows = batches.rows_of(b.column(0)[i].as_py())
                x, offsets = batches.text_bytes(rows, at_text)
                # No byte is covered more than LENGTH times and one: windows start at different places, and each lies in one stretch.
                marks = np.zeros(len(x) + 1, np.int16)
                waits: dict = {}
                masks_at, masks = [], []
                for p in b.column(1)[i].as_py() or []:
                    data = _parted(p["data"])
                    if p["bucket"] < 0:
                        np.add.at(marks, unpack_array(data[0], "<i8", True), 1)
                        np.add.at(marks, unpack_array(data[1], "<i8", True) + LENGTH, -1)
                        waits = {"group": unpack_array(data[2], "<i8", True), "first": unpack_array(data[3], "<i8", True)}
                    else:
                        masks_at.append(unpack_array(data[0], "<i8", True))
                        masks.append(unpack_array(data[1], "<u8"))
                if masks and len(waits["group"]):
                    whole = np.zeros(max(int(waits["group"].max()), *(int(a.max()) for a in masks_at)) + 1, np.uint64)
                    for a, m in zip(masks_at, masks, strict=True):
                        np.bitwise_or.at(whole, a, m)
                    mask = whole[waits["group"]]
                    for step in range(WIDE):
                        s = waits["first"][(mask >> np.uint64(step)) & np.uint64(1) == 1] + step
                        np.add.at(marks, s, 1)
                        np.add.at(marks, s + LENGTH, -1)
                # Runs of covered bytes, cut where texts end.
                gone = np.cumsum(marks, dtype=np.int16, out=marks)[:-1] > 0
                edge = np.diff(gone.view(np.int8), prepend=np.int8(0), append=np.int8(0))
                start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                inner = np.unique(offsets[1:-1])
                inner = inner[(inner > 0) & (inner < len(x))]
                inner = inner[gone[inner] & gone[inner - 1]] if len(inner) else inner
                start, end = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))
                text = np.searchsorted(offsets, start, "right") - 1
                lists = np.searchsorted(text, np.arange(rows.num_rows + 1)).astype(np.int32)
                spans = pa.StructArray.from_arrays([pa.array(start - offsets[text], pa.int64()), pa.array(end - offsets[text], pa.int64())], names=["start", "end"])
                spans = pa.ListArray.from_arrays(pa.array(lists), spans)
                del marks, gone, edge
                pieces = np.unique(np.concatenate([np.searchsorted(offsets[:-1], np.arange(0, len(x), PIECE)), [0, rows.num_rows]]))
                for y, z in zip(pieces[:-1].tolist(), pieces[1:].tolist(), strict=True):
                    yield made(rows.slice(y, z - y), spans.slice(y, z - y))

    return packed.join(parts, "batch", "left").select("rows", "parts").mapInArrow(shared.frugal(finish), schema)


def removed(df: DataFrame, id_col: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """df's rows with ``removed_spans``: an array of (start, end) byte ranges to take from each whole text.

    A byte goes if a string of ``LENGTH`` bytes over it also starts in a document with a smaller identifier;
    all strings are judged on the input. Texts are UTF-8 bytes, a null text is empty and loses nothing.
    Documents with one identifier don't take from each other; null identifiers come after all others and
    don't take from each other. Other columns pass through; one called removed_spans is replaced.
    """
    if "removed_spans" in df.columns:
        df = df.drop("removed_spans")
    schema = df.withColumn("removed_spans", F.lit(None).cast("array<struct<start:long,end:long>>")).schema
    arrow_schema = to_arrow_schema(schema)

    def made(rows: pa.RecordBatch, spans: pa.ListArray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, spans.cast(arrow_schema.field("removed_spans").type)], schema=arrow_schema)

    return _judged(df, id_col, text, schema, made, hot)


def cut(raw: bytes, spans: list[dict]) -> bytes:
    """What is left of a text's bytes without the spans."""
    out, at = [], 0
    for s in spans:
        out.append(raw[at : s["start"]])
        at = s["end"]
    out.append(raw[at:])
    return b"".join(out)


def digests(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of rows that hold ``removed_spans``."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            rows = []
            for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = (t or "").encode()
                left = cut(raw, spans)
                rows.append((len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)]], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return df.select(id_col, text, "removed_spans").mapInArrow(shared.frugal(run), f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the repeated passages cut out of its texts; a character that a cut halves goes as a whole. A null text stays null, other columns pass through."""
    at = df.columns.index(text)

    def made(rows: pa.RecordBatch, spans: pa.ListArray) -> pa.RecordBatch:
        texts = [t if t is None or not s else cut(t.encode(), s).decode(errors="ignore") for t, s in zip(rows.column(at).to_pylist(), spans.to_pylist(), strict=True)]
        columns = [pa.array(texts, c.type) if i == at else c for i, c in enumerate(rows.columns)]
        return pa.RecordBatch.from_arrays(columns, schema=rows.schema)

    return _judged(df, id_col, text, df.schema, made)
