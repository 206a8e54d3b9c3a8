"""Media columns: texts stored as TIFF files, and TIFF files read as a row for each page."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, tiff

ROW = 64
#: Bytes of one page; longer payloads go on in further pages.
PAGE_BYTES = 1 << 16
#: How a payload is stored, by its CRC: (compression, predictor, tile side), a third of the payloads by each compression.
FORMS = tuple((c, predictor, tile) for c in (tiff.PACKBITS, tiff.LZW, tiff.DEFLATE) for predictor, tile in ((1, 0), (2, 0), (1, 32)))
#: Rows of a flushed batch hold about so many bytes.
FLUSH_BYTES = 4 << 20


def payload(text: str | None) -> bytes:
    """UTF-8, with zeros up to a positive multiple of 64 bytes."""
    raw = (text or "").encode()
    return raw + bytes(max(ROW, -(-len(raw) // ROW) * ROW) - len(raw))


def stored(data: bytes) -> bytes:
    """A payload as a file of 64 samples a row; the payload alone decides its form."""
    samples = np.frombuffer(data, np.uint8).reshape(-1, ROW)
    step = PAGE_BYTES // ROW
    compression, predictor, tile = FORMS[zlib.crc32(data) % len(FORMS)]
    return tiff.write([samples[i : i + step] for i in range(0, len(samples), step)], compression, predictor, tile)


PAGE_SCHEMA = "page int, width int, height int, channels int, compression int, predictor int, tiled boolean, samples binary, error string"


def pages(df: DataFrame, id_col: str, media: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each page of every file in the column ``media``, with its decoded samples and the columns ``keep``.

    A null, empty or broken file gives one row with ``error`` set and no samples, after the pages that could
    be read; an empty table gives none. Ids may be null or repeated. A file's pages follow each other in one
    partition, each a whole image. Nothing is shuffled; a worker holds one file and a few MB of pages.
    """
    kept = [id_col, *keep]
    head = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    names = [x.split()[0] for x in PAGE_SCHEMA.split(", ")]
    types = [pa.int32()] * 6 + [pa.bool_(), pa.binary(), pa.string()]

    def rows_of(data: bytes | None) -> Iterator[list]:
        try:
            for p in tiff.walk(data or b""):
                yield [p.page, p.width, p.height, p.channels, p.compression, p.predictor, p.tiled, p.samples, None]
        except (ValueError, struct.error, zlib.error, KeyError) as e:
            yield [None] * 8 + [f"{type(e).__name__}: {e}"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, rows, held = [], [], 0

            def flush() -> pa.RecordBatch:
                columns, file = list(zip(*rows, strict=True)), pa.array(of, pa.int64())
                return pa.RecordBatch.from_arrays([*[b.column(k).take(file) for k in range(len(kept))], *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[*kept, *names])

            for i in range(b.num_rows):
                for row in rows_of(b.column(len(kept))[i].as_py()):
                    of.append(i)
                    rows.append(row)
                    held += len(row[7] or b"")
                    if held > FLUSH_BYTES:
                        yield flush()
                        of, rows, held = [], [], 0
            if rows:
                yield flush()

    return df.select(*kept, media).mapInArrow(shared.frugal(run), f"{head}, {PAGE_SCHEMA}")


def stored_documents(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, media): every whole text as a TIFF file. A null text is empty; ids may be null or repeated.

    Files leave the worker by a few MB.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, sizes, files, held = 0, [], [], 0

            def flush() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([b.column(0).slice(start, len(files)), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=[id_col, "n_bytes", "media"])

            for i in range(b.num_rows):
                text_ = b.column(1)[i].as_py()
                sizes.append(len((text_ or "").encode()))
                files.append(stored(payload(text_)))
                held += sizes[-1] + len(files[-1])
                if held > FLUSH_BYTES:
                    yield flush()
                    start, sizes, files, held = i + 1, [], [], 0
            if files:
                yield flush()

    return df.select(id_col, text).mapInArrow(shared.frugal(run), f"`{id_col}` {kind}, n_bytes long, media binary")


DIGEST_SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages long"


def digests(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row of digests and features for each of the files (id, n_bytes, media), from the rows of ``pages``.

    A file's pages are digested as they come, one after the other; the first page begins the next file. A file
    that can't be read fails the job: these files are this module's own.
    """
    names = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    about = df.select(id_col, "n_bytes", "media", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    found = pages(about, id_col, "media", ("n_bytes", "media_bytes", "media_sha256"))

    class File:
        def __init__(self, row: dict):
            self.row, self.sha, self.size, self.tail, self.bins, self.pages = row, hashlib.sha256(), 0, b"", np.zeros(256, np.int64), 0

        def add(self, row: dict) -> None:
            if row["error"] is not None:
                raise ValueError(f"a stored document can't be read: {row['error']}")
            self.sha.update(row["samples"])
            self.size += len(row["samples"])
            self.tail = row["samples"][-ROW:]
            self.bins += np.bincount(np.frombuffer(row["samples"], np.uint8), minlength=256)
            self.pages += 1
            self.form = f"{row['compression']}/{row['predictor']}/{int(row['tiled'])}"

        def digest(self) -> list:
            mean = int(self.bins @ np.arange(256)) / self.size
            feature = f"{self.pages}x{ROW};form={self.form};mean={mean:.6f};levels={int((self.bins > 0).sum())};peak={int(self.bins.argmax())};hist={zlib.crc32(self.bins.astype('<i8').tobytes()):08x}"
            return [self.row["n_bytes"], self.size, self.sha.hexdigest(), zlib.crc32(self.tail), self.row["media_bytes"], self.row["media_sha256"], feature, self.pages]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind = None, None

        def out(files: list[File]) -> pa.RecordBatch:
            columns = list(zip(*[f.digest() for f in files], strict=True))
            return pa.RecordBatch.from_arrays([pa.array([f.row[id_col] for f in files], kind), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[id_col, *names])

        for b in batches:
            kind, done = b.schema.field(id_col).type, []
            for i in range(b.num_rows):
                row = {n: b.column(k)[i].as_py() for k, n in enumerate(b.schema.names)}
                if not row["page"]:
                    done += [now] if now else []
                    now = File(row)
                now.add(row)
            if done:
                yield out(done)
        if now:
            yield out([now])

    kind_ = df.schema[id_col].dataType.simpleString()
    return found.mapInArrow(shared.frugal(run), f"`{id_col}` {kind_}, {DIGEST_SCHEMA}")
