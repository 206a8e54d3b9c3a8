import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.llm import packing, sstable, token_counts, tokens

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def library_ids(name, texts):
    enc = tokens.encoder(tokens.vocabulary(name))
    return [e.ids for e in enc.tokenizer.encode_batch(list(texts), add_special_tokens=False)]


def own_ids(name, texts):
    out = []
    for _, ids, at in tokens.encoder(tokens.vocabulary(name)).batches(pa.array(texts, pa.string())):
        out += [ids[at[i] : at[i + 1]].tolist() for i in range(len(at) - 1)]
    return out


@pytest.mark.parametrize("name", NAMES)
def test_ids_equal_the_librarys(name, documents):
    texts = [r.text for r in documents.collect()]
    assert own_ids(name, texts) == library_ids(name, texts)
    assert tokens.encoder(tokens.vocabulary(name)).counts(pa.array(texts)).tolist() == [len(x) for x in library_ids(name, texts)]


WORDS = st.sampled_from(["the", "It's", "don't", "naïve", "ÉTÉ", "ß", "x1", "3.14", "...", "a,b", "<|endoftext|>", "<|startoftext|>", "́", "İ", "日本", " ", "\n", "\n\n", "\t", " ", "  ", "", "\x1c", "_", "|", "<", "ﬁ", "🙂", "word.\nNext", "'s", "\r\n"])


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(WORDS, max_size=12).map(" ".join) | st.text(max_size=40), min_size=1, max_size=6))
def test_ids_of_odd_texts(name, texts):
    texts = [t.encode(errors="ignore").decode() for t in texts]
    assert own_ids(name, texts) == library_ids(name, texts)


@pytest.mark.parametrize("name", NAMES)
def test_long_texts_are_cut_at_safe_places(name, monkeypatch):
    monkeypatch.setattr(tokens, "BATCH_BYTES", 2000)
    monkeypatch.setattr(tokens.segments, "__defaults__", (300,))
    monkeypatch.setattr(tokens.balanced, "__defaults__", (2000,))
    text = "Some words, and the rest's not far.\nNext line  with blanks " * 300
    texts = [text, "short", text[:900]]
    assert own_ids(name, texts) == library_ids(name, texts)
    assert "".join(tokens.segments(text)) == text
    assert tokens.encoder(tokens.vocabulary(name)).counts(pa.array(texts)).tolist() == [len(x) for x in library_ids(name, texts)]


def test_balanced_batches():
    sizes = np.array([5, 5, 50, 1, 1, 9])
    assert list(tokens.balanced(sizes, 10)) == [(0, 2), (2, 3), (3, 5), (5, 6)]


def test_counts_of_edges(edges, edge_texts, empty):
    path = tokens.vocabulary(NAMES[0])
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.token_counts(edges, path).collect())
    want = [(str(None if i == "null" else i), len((t or "").encode()), len(x)) for (i, t), x in zip(edge_texts, library_ids(NAMES[0], [t or "" for _, t in edge_texts]), strict=True)]
    assert got == sorted(want)
    assert token_counts.token_counts(empty, path).collect() == []


def test_columns_that_clash_are_not_read(edges, edge_texts):
    clash = edges.withColumn("n_bytes", F.lit("x")).withColumn("n_tokens", F.lit("y")).withColumn("start", F.lit("z")).withColumn("length", F.lit("w"))
    path = tokens.vocabulary(NAMES[0])
    count = lambda df: sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.token_counts(df, path).collect())
    assert count(clash) == count(edges)
    assert packing.packed(packing.pieces(clash, tokens.vocabulary(NAMES[1]), 2)).count() >= len(edge_texts)


def shard_rows(spark, df, n=3):
    shards = sstable.write_shards(df, tokens.vocabulary(NAMES[0]), 2, shards=n)
    return shards, sstable.read_shards(spark, shards).collect()


def test_shards_hold_every_document_in_order(spark, documents):
    shards, rows = shard_rows(spark, documents)
    docs = sorted((r.doc_id, r.text) for r in documents.collect())
    at = 0
    for r, (i, _), ids in zip(sorted(rows, key=lambda r: r.start), docs, library_ids(NAMES[0], [t for _, t in docs]), strict=True):
        own = np.array([*ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
    assert sum(n for _, n, _ in shards) == len(docs)


def test_lookup_by_search(spark, documents):
    shards, _ = shard_rows(spark, documents)
    found = 0
    for uri, *_ in shards:
        reader = sstable.Reader(uri)
        for r in documents.limit(25).collect():
            got = reader.get(sstable.key_of(r.doc_id))
            if got:
                found += 1
                assert sstable.unpack_ids(got[0]).tolist() == [*library_ids(NAMES[0], [r.text])[0], 2]
        assert reader.get(sstable.key_of(10**9)) == []
    assert found == 25


def test_shards_of_edges(spark, edges, edge_texts, empty):
    shards, rows = shard_rows(spark, edges, 4)
    assert len(rows) == len(edge_texts)
    ids = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert ids[:2] == [None, None] and ids[2:] == sorted(i for i, _ in edge_texts if i != "null")
    assert sum(r.n_tokens for r in rows) == sum(n for *_, n in shards)
    assert any(len(sstable.Reader(u).get(sstable.key_of(5))) == 2 for u, *_ in shards)
    assert shard_rows(spark, empty)[1] == []


def test_shards_of_bounded_size(spark, documents):
    many = documents.select("doc_id", "text").unionByName(documents.selectExpr("7L as doc_id", "text")).withColumn("id", F.lit(1)).withColumn("mark", F.lit(2))
    shards = sstable.write_shards(many, tokens.vocabulary(NAMES[0]), 2, shards=3, shard_bytes=1 << 16)
    rows = sstable.read_shards(spark, shards).collect()
    assert len(shards) > 3 and len(rows) == many.count() and sum(r.n_tokens for r in rows) == sum(n for *_, n in shards)
    ids = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert ids == sorted(ids)


def test_many_blocks_and_keys(tmp_path):
    path = tmp_path / "x.sst"
    writer = sstable.Writer(open(path, "wb"))
    rng = np.random.default_rng(1)
    held = {int(i): rng.integers(0, 70_000 if i % 5 else 60_000, int(rng.integers(0, 400))).astype("<u4") for i in np.unique(rng.integers(-(10**12), 10**12, 3000))}
    for i in sorted(held):
        writer.add(sstable.key_of(i), sstable.pack_ids(held[i]), len(held[i]))
    writer.close()
    reader = sstable.Reader(f"file://{path}")
    assert len(reader.index) > 5
    for i in list(held)[::37]:
        assert sstable.unpack_ids(reader.get(sstable.key_of(i))[0]).tolist() == held[i].tolist()
    assert sum(reader.may_hold(sstable.key_of(int(i))) for i in range(5_000_000_000_000, 5_000_000_002_000)) < 100


def check_packing(rows, docs, name):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= packing.LENGTH
    for (i, _), ids in zip(docs, library_ids(name, [t or "" for _, t in docs]), strict=True):
        own = np.array([*ids, 2], "<u4")
        for r in pieces[i]:
            assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        assert sum(r.length for r in pieces[i]) == len(own)
    return sequences


def test_packing_holds_every_token_once(spark, documents):
    rows = packing.packed(packing.pieces(documents, tokens.vocabulary(NAMES[1]), 2)).collect()
    sequences = check_packing(rows, [(r.doc_id, r.text) for r in documents.collect()], NAMES[1])
    tokens_ = sum(r.length for r in rows)
    assert len(sequences) <= 1.05 * tokens_ / packing.LENGTH + 1


def test_packing_of_edges(edges, edge_texts, empty):
    rows = packing.packed(packing.pieces(edges, tokens.vocabulary(NAMES[1]), 2)).collect()
    got = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    for (s, o, n), (s2, o2, _) in zip(got, got[1:], strict=False):
        assert o2 == (o + n if s == s2 else 0)
    want = sum(len(x) + 1 for x in library_ids(NAMES[1], [t or "" for _, t in edge_texts]))
    assert sum(r.length for r in rows) == want
    assert packing.packed(packing.pieces(empty, tokens.vocabulary(NAMES[1]), 2)).collect() == []


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, packing.LENGTH - 1), st.integers(1, 400), max_size=60), st.sampled_from([8, packing.BINS]))
def test_patterns_cover_every_piece(held, limit):
    counts = np.zeros(packing.LENGTH - 1, np.int64)
    for k, n in held.items():
        counts[k - 1] = n
    rounded = packing.bin_sizes(counts, limit)
    assert ((rounded >= np.arange(1, packing.LENGTH)) == (counts > 0)).all() and len(set(rounded[rounded > 0].tolist())) == min(limit, len(held))
    sizes = np.unique(rounded[rounded > 0])
    binned = np.array([counts[rounded == s].sum() for s in sizes], np.int64)
    made = packing.solved(sizes, binned)
    total = sum((p * times for p, times in made), np.zeros(len(sizes), np.int64))
    assert (total == binned).all() and all((p * sizes).sum() <= packing.LENGTH for p, _ in made)
    assert sum(t for _, t in made) <= sum(t for _, t in packing.first_fit(sizes, binned))


def test_columns_beat_first_fit():
    # Longest first puts the two longest together; the program mixes them with the short ones.
    sizes, counts = np.array([1000, 1100, 1900, 2050]), np.array([3000, 1000, 1000, 1000])
    made = packing.solved(sizes, counts)
    assert sum(t for _, t in made) <= 1.02 * counts @ sizes / packing.LENGTH < sum(t for _, t in packing.first_fit(sizes, counts))


def cut_of(spark, lengths):
    rows, serial = [], 0
    for i, n in enumerate(lengths):
        whole = n == packing.LENGTH
        cut = packing.QUARTER < n < packing.LENGTH and n % packing.QUARTER
        rows.append((i, 0, n, i, n, i + 10**6 if cut else None, i + 2 * 10**6 if cut else None, 0, serial if whole else None))
        serial += whole
    return spark.createDataFrame(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, head_crc32 long, tail_crc32 long, task long, serial long").repartition(3)


SHORT = [1] * 20_000 + [3] * 5000 + [17] * 1000 + [64] * 100 + [65] * 40 + [4096, 900, 4096]
CASES = {"words": [2] * 20_000, "four": [5, 6, 7, 5] * 5000, "twelve": [13 + i % 9 for i in range(20_000)], "short": SHORT, "mixed": [2 + i % 29 for i in range(20_000)] + [30 + 37 * i % 4066 for i in range(2000)], "long": [1500 + 13 * i % 2596 for i in range(4000)], "65": [65] * 3000}


@pytest.mark.parametrize("name", CASES)
def test_padding_is_little(spark, name):
    lengths = CASES[name]
    rows = packing.packed(cut_of(spark, lengths)).collect()
    held, sequences = {}, {}
    for r in rows:
        held.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32 // 10**6))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, n in enumerate(lengths):
        head = n // packing.QUARTER * packing.QUARTER
        assert sorted(held[i]) in ([(0, n, 0)], [(0, head, 1), (head, n - head, 2)])
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= packing.LENGTH
    assert sorted(sequences) == list(range(len(sequences)))
    assert len(sequences) <= 1.03 * -(-sum(lengths) // packing.LENGTH) + 1


def test_added_tokens_that_read_like_plain_text_are_refused(tmp_path):
    found = json.loads(open(tokens.vocabulary(NAMES[0])).read())
    found["added_tokens"].append({"id": 50257, "content": "hello", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False})
    path = tmp_path / "vocabulary.json"
    path.write_text(json.dumps(found))
    with pytest.raises(ValueError, match="hello"):
        tokens.encoder(str(path))
