"""TIFF media: image directories, PackBits, LZW and deflate strips or tiles, and the horizontal predictor."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Tags that are read, and the sizes of their field types.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_BYTES = 256, 257, 258, 259, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, PHOTOMETRIC = 317, 322, 323, 324, 325, 262
_TYPES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}
_CLEAR, _END = 256, 257
#: A page's samples may not exceed this many bytes, whatever its directory says.
MAX_PAGE = 1 << 28


@dataclass(frozen=True)
class Page:
    page: int
    width: int
    height: int
    channels: int
    compression: int
    predictor: int
    tiled: bool
    samples: bytes


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i, held = [], 0, 0
    while held < size:
        if i >= len(data):
            raise ValueError("PackBits data ends early")
        n = data[i]
        if n < 128:
            part = data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            part = data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            part = b""
            i += 1
        out.append(part)
        held += len(part)
        if i > len(data):
            raise ValueError("PackBits data ends early")
    return b"".join(out)[:size]


_RUN = re.compile(rb"(.)\1{2,127}", re.S)


def pack_bits(data: bytes) -> bytes:
    out, at = [], 0

    def literal(a: int, b: int) -> None:
        for i in range(a, b, 128):
            part = data[i : min(i + 128, b)]
            out.append(bytes([len(part) - 1]) + part)

    for m in _RUN.finditer(data):
        literal(at, m.start())
        out.append(bytes([257 - (m.end() - m.start())]) + m[1])
        at = m.end()
    literal(at, len(data))
    return b"".join(out)


#: Codes between two clearings at most, their widths in bits, and where each begins: the table's size alone decides.
_RUN_CODES = 3837
_WIDTHS = np.searchsorted([512, 1024, 2048], 259 + np.arange(_RUN_CODES + 1)) + 9
_PLACES = np.concatenate([[0], np.cumsum(_WIDTHS)])


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first, that widen one code early; the table is cleared when full."""
    codes, cleared, at = [_CLEAR], [0], 1
    table, following, code = {}, 258, -1
    for byte in data:
        if code < 0:
            code = byte
            continue
        key = code << 8 | byte
        longer = table.get(key)
        if longer is not None:
            code = longer
            continue
        codes.append(code)
        table[key] = following
        following += 1
        code = byte
        if following == 4095:
            cleared.append(len(codes))
            codes.append(_CLEAR)
            table, following = {}, 258
    if code >= 0:
        codes.append(code)
    codes.append(_END)
    c = np.array(codes, np.int64)
    # A clearing is as wide as the codes before it; the first has 9 bits.
    w = np.full(len(c), 9)
    for at, to in zip(cleared, [*cleared[1:], len(c)], strict=True):
        w[at + 1 : to] = _WIDTHS[: to - at - 1]
        if at:
            w[at] = 12
    ends = np.cumsum(w)
    bits = np.zeros(int(ends[-1]), np.uint8)
    for k in range(12):
        some = w > k
        bits[ends[some] - 1 - k] = (c[some] >> k) & 1
    return np.packbits(bits).tobytes()


def unlzw(data: bytes, size: int) -> bytes:
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    out, got, at = [], 0, 0
    while got < size:
        # The codes up to the next clearing, as if it came as late as it may.
        places = at + _PLACES[:-1]
        places = places[places + _WIDTHS <= 8 * len(data)]
        byte, width = places >> 3, _WIDTHS[: len(places)]
        four = raw[byte] << 24 | raw[byte + 1] << 16 | raw[byte + 2] << 8 | raw[byte + 3]
        codes = (four >> (32 - (places & 7) - width).astype(np.uint32)) & ((1 << width) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == _CLEAR) | (codes == _END))
        n = int(stop[0]) if len(stop) else len(codes)
        table, last = list(single), b""
        for code in codes[:n].tolist():
            if last:
                if code < len(table):
                    found = table[code]
                elif code == len(table):
                    found = last + last[:1]
                else:
                    raise ValueError("LZW code beyond the table")
                table.append(last + found[:1])
                last = found
            elif code < 256:
                last = single[code]
            else:
                raise ValueError("LZW data starts with no byte")
            out.append(last)
            got += len(last)
            if got >= size:
                break
        if not len(stop) or codes[n] == _END:
            break
        at += int(_PLACES[n + 1])
    whole = b"".join(out)
    if len(whole) < size:
        raise ValueError("LZW data ends early")
    return whole[:size]


def _inflate(data: bytes, size: int) -> bytes:
    out = zlib.decompressobj().decompress(data, size)
    if len(out) < size:
        raise ValueError("deflate data ends early")
    return out


_DECODE = {NONE: lambda d, n: d[:n], PACKBITS: unpack_bits, LZW: unlzw, DEFLATE: _inflate, OLD_DEFLATE: _inflate}
_ENCODE = {NONE: bytes, PACKBITS: pack_bits, LZW: lzw, DEFLATE: lambda d: zlib.compress(d, 3)}


def _fields(data: bytes, order: str, at: int) -> tuple[dict[int, list[int]], int]:
    (count,) = struct.unpack_from(order + "H", data, at)
    fields = {}
    for i in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in _TYPES:
            continue
        letter, size = _TYPES[kind]
        if n * size > len(data):
            raise ValueError("a field is larger than the file")
        where = at + 10 + 12 * i
        if n * size > 4:
            (where,) = struct.unpack_from(order + "I", data, where)
        fields[tag] = list(struct.unpack_from(f"{order}{n}{letter}", data, where))
    (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * count)
    return fields, following


def walk(data: bytes) -> Iterator[Page]:
    """Every page of a file of 8-bit samples, in the order of its directories.

    Raises ValueError or struct.error where the file is broken, says so, or goes in a circle.
    """
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF header")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise ValueError("the directories go in a circle")
        seen.add(at)
        f, following = _fields(data, order, at)
        yield _page(data, f, len(seen) - 1)
        at = following


def _page(data: bytes, f: dict[int, list[int]], page: int) -> Page:
    one = lambda tag, default=None: f.get(tag, [default])[0]
    width, height, channels = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    compression, predictor, tiled = one(COMPRESSION, NONE), one(PREDICTOR, 1), TILES in f
    if not width or not height or width * height * channels > MAX_PAGE:
        raise ValueError("a page without or beyond all measure")
    if set(f.get(BITS, [8])) != {8} or compression not in _DECODE or predictor not in (1, 2):
        raise ValueError("only 8-bit samples, known compressions and predictors 1 and 2 are read")
    wide, high = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS, height), height))
    if not wide or not high or wide * high * channels > MAX_PAGE:
        raise ValueError("a strip or tile without or beyond all measure")
    offsets, sizes = (f[TILES], f[TILE_BYTES]) if tiled else (f.get(STRIPS, []), f.get(STRIP_BYTES, []))
    across, down = -(-width // wide), -(-height // high)
    if len(offsets) < across * down or len(sizes) < across * down:
        raise ValueError("strips or tiles are missing")
    image = np.empty((height, width, channels), np.uint8)
    for k in range(across * down):
        y, x = k // across * high, k % across * wide
        rows = high if tiled else min(high, height - y)
        need = rows * wide * channels
        raw = _DECODE[compression](data[offsets[k] : offsets[k] + sizes[k]], need)
        if len(raw) < need:
            raise ValueError("a strip or tile ends early")
        block = np.frombuffer(raw, np.uint8).reshape(rows, wide, channels)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        image[y : y + rows, x : x + wide] = block[: height - y, : width - x]
    return Page(page, width, height, channels, compression, predictor, tiled, image.tobytes())


def write(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: int = 0, rows: int = 128) -> bytes:
    """A little-endian file of 8-bit gray pages; tile: the side of square tiles (a multiple of 16), else strips of so many rows."""
    out, at, link = [b"II*\0", b"\0\0\0\0"], 8, 1
    for image in pages:
        height, width = image.shape
        blocks = []
        for y in range(0, height, tile or rows):
            for x in range(0, width, tile or width):
                block = image[y : y + (tile or rows), x : x + (tile or width)]
                if tile and block.shape != (tile, tile):
                    block = np.pad(block, ((0, tile - block.shape[0]), (0, tile - block.shape[1])))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.uint8(0)).astype(np.uint8)
                blocks.append(_ENCODE[compression](np.ascontiguousarray(block).tobytes()))
        starts = np.cumsum([0, *map(len, blocks)]) + at
        size, n = int(starts[-1]) - at, len(blocks)
        pad = -size % 2
        lists = at + size + pad
        fields = [(WIDTH, 4, 1, width), (HEIGHT, 4, 1, height), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, compression), (PHOTOMETRIC, 3, 1, 1), (SAMPLES, 3, 1, 1), (PREDICTOR, 3, 1, predictor)]
        fields += [(TILE_WIDTH, 4, 1, tile), (TILE_HEIGHT, 4, 1, tile)] if tile else [(ROWS, 4, 1, rows)]
        fields += [(TILES if tile else STRIPS, 4, n, int(starts[0]) if n == 1 else lists), (TILE_BYTES if tile else STRIP_BYTES, 4, n, len(blocks[0]) if n == 1 else lists + 4 * n)]
        extra = b"" if n == 1 else struct.pack(f"<{2 * n}I", *starts[:-1].tolist(), *map(len, blocks))
        ifd = lists + len(extra)
        out[link] = struct.pack("<I", ifd)
        out += [*blocks, b"\0" * pad, extra, struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", *x) for x in sorted(fields)), b"\0\0\0\0"]
        link, at = len(out) - 1, ifd + 2 + 12 * len(fields) + 4
    return b"".join(out)
