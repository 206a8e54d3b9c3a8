"""Exact batch tokenization inside Arrow functions.

A text is cut at safe boundaries: a single space between two characters that
are not white space.  The pre-tokenizers of the supported vocabularies never
join across such a space, so pieces encode independently, equal pieces of a
batch only once, and words that were seen before not again.  Special strings
hold no space and stay whole.
"""

from __future__ import annotations

import re
from array import array
from codecs import charmap_decode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once, and words that a worker remembers.
BATCH_BYTES = 4 << 20
CACHE_WORDS = 300_000
#: White space in the widest sense; a space beside one of these is no boundary.
_SPACE = "\\s\u0085\u00a0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
SAFE_CUT = re.compile(f"(?<=[^{_SPACE}]) (?=[^{_SPACE}])")
#: The same set for Arrow's regular expressions: an empty piece, or white space at an end.
_UNSAFE_PIECE = "^$|^[\\s\\v\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{2060}\\x{3000}\\x{feff}]|[\\s\\v\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{2060}\\x{3000}\\x{feff}]$"

_LETTERS, _SIGNS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "!-&(-/:-;=?@[-`{}~"
#: Pieces whose pre-tokens are plain to see: no apostrophe, digit, "<", "|" or ">" and no character beyond Latin-1.
PLAIN = re.compile(f"(?:[{_LETTERS}{_SIGNS}]+\n)*[{_LETTERS}{_SIGNS}]+")
RUNS = re.compile(f"[{_LETTERS}]+|[{_SIGNS}]+")
RUNS_AND_ENDS = re.compile(f" ?[{_LETTERS}]+| ?[{_SIGNS}]+|\n")
#: Byte-level vocabularies write a byte that prints as itself and the others as 256, 257, ... in order.
_PRINTS = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SHIFTED = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTS)}
ALPHABET = "".join(chr(_SHIFTED.get(b, b)) for b in range(256))
ONE_SIGN = frozenset(".,!?;:")


def balanced(nbytes: np.ndarray, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes each; a longer row stands alone."""
    start, held = 0, 0
    for i, n in enumerate(nbytes.tolist()):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(nbytes):
        yield start, len(nbytes)


class PieceEncoder:
    """Token ids of whole texts from one tokenizer file, by remembered words."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        probe = self.tokenizer.encode("Ab", add_special_tokens=False).ids
        self.lower = probe == self.tokenizer.encode("ab", add_special_tokens=False).ids
        self.words: dict[str, bytes] = {}
        # Plain pieces pass the library's search for added tokens by, so none may read like one.
        if held := [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if PLAIN.search(t.content) and PLAIN.fullmatch(t.content.strip())]:
            raise ValueError(f"{path}: added tokens that read like plain text: {held}")

    def _whole(self, pieces: list[str]) -> list[bytes]:
        """By the library's whole path: normalizer, pre-tokenizer and model."""
        got = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in got]

    def _ids(self, pieces: list[str], lead: str) -> list[bytes]:
        """Ids of pieces that all stand after ``lead``, a space or nothing."""
        out: list[bytes] = [b""] * len(pieces)
        odd = []
        words, get, word, lower = self.words, self.words.get, self._word, self.lower
        plain, runs = PLAIN.fullmatch, RUNS.findall if lower else RUNS_AND_ENDS.findall
        space = "" if lower else lead
        for i, piece in enumerate(pieces):
            if piece.isascii():
                # Most pieces are a word, or a word and one sign.
                if lower:
                    piece = piece.lower()
                if piece.isalpha():
                    out[i] = get(w := space + piece) or word(w)
                    continue
                if (w := piece[:-1]).isalpha() and piece[-1] in ONE_SIGN:
                    out[i] = (get(w := space + w) or word(w)) + (get(piece[-1]) or word(piece[-1]))
                    continue
            if plain(piece):
                out[i] = b"".join([get(w) or word(w) for w in runs(piece.lower() if lower else lead + piece)])
            else:
                odd.append(i)
        if odd:
            for i, ids in zip(odd, self._whole([lead + pieces[i] for i in odd]), strict=True):
                out[i] = ids
        if len(words) > CACHE_WORDS:
            words.clear()
        return out

    def _word(self, word: str) -> bytes:
        """By the library's model alone, which gets a pre-token's bytes as the byte-level alphabet."""
        found = self.model.tokenize(charmap_decode(word.encode(), "strict", ALPHABET)[0])
        ids = self.words[word] = array("I", [t.id for t in found]).tobytes()
        return ids

    def _pieces(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The texts' pieces, dictionary-encoded, and the offsets of each text's pieces."""
        parts = pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy()
        flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = (offsets - offsets[0]).astype(np.int64)
        coded = flat.dictionary_encode()
        odd = pc.match_substring_regex(coded.dictionary, _UNSAFE_PIECE).to_numpy(zero_copy_only=False)
        if odd.any():
            rows = np.searchsorted(offsets, np.flatnonzero(odd[coded.indices.to_numpy()]), "right") - 1
            rows = set(rows.tolist())
            cut = [SAFE_CUT.split(t) if i in rows else None for i, t in enumerate(texts.to_pylist())]
            lists, old = [], parts.to_pylist() if len(rows) < len(cut) else None
            for i, c in enumerate(cut):
                lists.append(old[i] if c is None else c)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            coded = pa.array([p for x in lists for p in x], pa.large_string()).dictionary_encode()
        return coded, offsets

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, bytes]:
        """For texts without nulls: each piece's first token and token count in the returned ids, and the pieces' offsets by text."""
        if len(texts) == 0:
            return np.zeros((0, 2), np.int64), np.zeros(1, np.int64), b""
        coded, offsets = self._pieces(texts.cast(pa.large_string()))
        codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = self._ids(words, " ")
        # A text's first piece has no space before it.
        firsts = offsets[:-1]
        heads = list(dict.fromkeys(codes[firsts].tolist()))
        place = {c: len(words) + i for i, c in enumerate(heads)}
        found += self._ids([words[c] for c in heads], "")
        codes[firsts] = [place[c] for c in codes[firsts].tolist()]
        counts = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        starts = np.cumsum(counts) - counts
        return np.stack([starts[codes], counts[codes]], 1), offsets, b"".join(found)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; a null text is empty."""
        texts = pc.fill_null(texts, "")
        out = np.zeros(len(texts), np.int64)
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in balanced(sizes):
            if b == a + 1 and sizes[a] > BATCH_BYTES:
                out[a] = sum(int(self._count(pa.array([s])).sum()) for s in segments(texts[a].as_py()))
            else:
                out[a:b] = self._count(texts.slice(a, b - a))
        return out

    def _count(self, texts: pa.Array) -> np.ndarray:
        spans, offsets, _ = self.encode(texts)
        total = np.concatenate([[0], np.cumsum(spans[:, 1])])
        return total[offsets[1:]] - total[offsets[:-1]]

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, token offsets by row) of batches balanced by bytes, in order; null texts are empty."""
        texts = pc.fill_null(texts, "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in balanced(sizes):
            if b == a + 1 and sizes[a] > BATCH_BYTES:
                ids = np.concatenate([self._gather(pa.array([s]))[0] for s in segments(texts[a].as_py())])
                yield a, ids, np.array([0, len(ids)])
            else:
                yield (a, *self._gather(texts.slice(a, b - a)))

    def _gather(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        spans, offsets, held = self.encode(texts)
        ends = np.cumsum(spans[:, 1])
        total = np.concatenate([[0], ends])
        at = np.repeat(spans[:, 0] - (ends - spans[:, 1]), spans[:, 1])
        at += np.arange(len(at))
        return np.frombuffer(held, "<u4")[at], total[offsets]


def segments(text: str, limit: int = BATCH_BYTES // 8) -> Iterator[str]:
    """A long text in parts of at least ``limit`` characters, cut before safe spaces.

    The parts joined are the text.  Every part but the first starts with the
    space that it was cut at; the encoder keeps it, since a part is encoded
    like any text.
    """
    start = 0
    while len(text) - start > limit:
        m = SAFE_CUT.search(text, start + limit)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
