"""TIFF media and the toxicity classifier."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.llm import media, queries, tiff, toxicity

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16, 64])
def test_round_trip(compression, predictor, tile):
    rng = np.random.default_rng(3)
    for shape in ((1, 64), (130, 64), (65, 70), (300, 33)):
        for image in (rng.integers(0, 256, shape, dtype=np.uint8), np.zeros(shape, np.uint8), np.indices(shape).sum(0).astype(np.uint8)):
            pages = list(tiff.walk(tiff.write([image, image[::-1]], compression, predictor, tile, rows=40)))
            assert [p.page for p in pages] == [0, 1]
            assert pages[0].samples == image.tobytes() and pages[1].samples == image[::-1].tobytes()
            assert (pages[0].height, pages[0].width) == shape


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000) | st.binary(min_size=1, max_size=5).map(lambda b: b * 900))
def test_codecs(data):
    assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data
    assert tiff.unlzw(tiff.lzw(data), len(data)) == data


def test_lzw_over_a_full_table():
    data = np.random.default_rng(1).integers(0, 256, 30_000, dtype=np.uint8).tobytes()
    assert tiff.unlzw(tiff.lzw(data), len(data)) == data


def test_big_endian_and_several_channels():
    pixels = bytes(range(12))
    fields = [(256, 3, 1, 2 << 16), (257, 3, 1, 2 << 16), (258, 3, 3, 134), (259, 3, 1, 1 << 16), (273, 4, 1, 140), (277, 3, 1, 3 << 16), (278, 3, 1, 2 << 16), (279, 4, 1, 12)]
    data = struct.pack(">2sHI", b"MM", 42, 8) + struct.pack(">H", len(fields)) + b"".join(struct.pack(">HHII", *f) for f in fields) + b"\0" * 4
    data = data.ljust(134, b"\0") + struct.pack(">3H", 8, 8, 8) + pixels
    (page,) = tiff.walk(data)
    assert (page.width, page.height, page.channels, page.samples) == (2, 2, 3, pixels)


def test_pages_and_broken_files(spark):
    good = tiff.write([np.zeros((4, 64), np.uint8), np.ones((8, 64), np.uint8)], tiff.LZW, 2, 0)
    circle = bytearray(good)
    last = good.rfind(b"\0\0\0\0")
    circle[last : last + 4] = struct.unpack_from("<I", good, 4)[0].to_bytes(4, "little")
    rows = [(1, good), (2, None), (3, b""), (4, b"II*\0\x08\0\0\0"), (5, good[:-30]), (6, bytes(circle)), (None, b"not a tiff"), (1, good)]
    got = media.pages(spark.createDataFrame(rows, "doc_id long, media binary"), "doc_id", "media").collect()
    assert sorted((r.page, r.height) for r in got if r.doc_id == 1) == [(0, 4), (0, 4), (1, 8), (1, 8)]
    for i in (2, 3, 4, 5, None):
        assert [r.error is not None for r in got if r.doc_id == i][-1:] == [True], i
    assert [r.page for r in got if r.doc_id == 6] == [0, 1, None]


def test_digests_of_documents(documents, edges, empty):
    for df in (documents, edges):
        texts = sorted((str(r.doc_id), r.text or "") for r in df.collect())
        rows = sorted(media.digests(media.stored_documents(df)).collect(), key=lambda r: (str(r.doc_id), r.n_bytes))
        assert len(rows) == len(texts)
        want = {}
        for i, t in texts:
            raw = t.encode()
            padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
            form = media.stored(padded)
            want.setdefault(i, []).append((len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(form), hashlib.sha256(form).hexdigest()))
        for r in rows:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) in want[str(r.doc_id)]
        features = {}
        for r in rows:
            assert features.setdefault(r.payload_sha256, r.feature) == r.feature
    assert media.digests(media.stored_documents(empty)).collect() == []


def test_media_and_scores_of_clashing_columns(edges):
    clash = edges
    for c in ("media", "page", "samples", "n_bytes", "error", "z", "held_out", "score"):
        clash = clash.withColumn(c, F.lit("x"))
    rows = lambda df: sorted(map(str, media.digests(media.stored_documents(df)).collect()))
    assert rows(clash) == rows(edges)
    model = toxicity.fit([], np.zeros(0, np.int64))
    assert toxicity.scored(clash, model).columns == ["doc_id", "held_out", "score", "predicted"] and toxicity.scored(clash, model).count() == edges.count()


def test_long_documents_have_several_pages(spark):
    df = spark.createDataFrame([(1, "word " * 60_000)], "doc_id long, text string")
    (row,) = media.digests(media.stored_documents(df)).collect()
    assert row.n_pages == -(-row.payload_bytes // media.PAGE_BYTES) > 1
    assert media.pages(media.stored_documents(df), "doc_id", "media").count() == row.n_pages


def test_classifier_finds_held_out_documents(spark):
    rows = queries.op5_toxicity(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    found = rows.merge(labels, on="doc_id")
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in found.doc_id]).all()
    held = found[found.held_out & found.toxic.notna()]
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    ranks = held.score.rank()
    auc = (ranks[held.toxic == 1].sum() - len(toxic) * (len(toxic) + 1) / 2) / (len(toxic) * len(clean))
    assert auc > 0.95 and toxic.predicted.mean() > 0.6 and clean.predicted.mean() < 0.08
    assert ((rows.score >= 0) & (rows.score <= 1)).all() and (rows.predicted == (rows.score >= 0.7)).all()


def test_scores_see_texts_alone(spark, edges, empty):
    texts = ["you idiot and moron", "a fine day", "what a moron", "clean words here"] * 40
    labels = np.array([1, 0, 1, 0] * 40)
    model = toxicity.fit(texts, labels)
    rows = toxicity.scored(edges, model).collect()
    assert len(rows) == edges.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.predicted for r in rows if r.doc_id == 10} == {1}
    by_text = {}
    for r, t in zip(sorted(rows, key=lambda r: str(r.doc_id)), sorted(edges.collect(), key=lambda r: str(r.doc_id)), strict=True):
        by_text.setdefault(t.text or "", set()).add(round(r.score, 6))
    assert all(r.held_out is None for r in rows if r.doc_id is None)
    assert toxicity.scored(empty, model).collect() == []


def test_thresholds_come_from_all_labelled_rows(spark, monkeypatch):
    ids = [i for i in range(6000) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = [(i, "you idiot and moron" if i % 10 == 0 else "you fine and moron" if i % 10 == 1 else "you clean and words") for i in ids]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    # Of the middle text's rows a third is toxic: worth no cut below it, unless a sample of equal shares sets the cut.
    marks = spark.createDataFrame([(i, int(i % 10 == 0 or i % 30 == 1)) for i in ids], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE", {1: 200, 0: 200})
    texts, labels, known = toxicity.sample(df, marks)
    model = toxicity.fit(texts, labels)
    known = toxicity.learned(known)
    assert len(known) == 300
    found = toxicity.logits(df, model)
    cut = toxicity.calibrated(found, marks, model, known)
    rows = found.join(marks, "doc_id").toPandas()

    def f1(m):
        hit = rows.z >= m.thresholds[rows.lang]
        return 2 * (hit & (rows.toxic == 1)).sum() / (hit.sum() + rows.toxic.sum())

    best = max(2 * ((rows.z >= z) & (rows.toxic == 1)).sum() / ((rows.z >= z).sum() + rows.toxic.sum()) for z in rows.z.unique())
    assert f1(cut) == pytest.approx(best) and f1(model) < best - 0.01


def test_fit_without_labels():
    for texts, labels in (([], []), (["a b"], [1]), (["a", None], [0, 0])):
        model = toxicity.fit(texts, np.array(labels, np.int64))
        for _, rows, at, langs in toxicity.features(__import__("pyarrow").array(["any text", ""])):
            assert (model.scores(rows, at, langs) < 0.7).all()


def small_model(rng):
    model = toxicity.Model(
        rng.standard_normal((40, toxicity.DIM)),
        [rng.standard_normal((w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS],
        rng.standard_normal(toxicity.FILTERS * len(toxicity.WIDTHS)) * 0.1,
        rng.standard_normal(toxicity.FILTERS * len(toxicity.WIDTHS)),
        0.3,
        np.zeros(len(toxicity.LANGS) + 1),
    )
    sizes = [4, 0, 1, 2, 9]
    return model, rng.integers(0, 40, (sum(sizes), 3)), np.cumsum([0, *sizes])


def slow_pooled(model, rows, at, kept):
    """Every filter at every word, one after the other; nothing stands beyond a text's end."""
    out = np.zeros((len(at) - 1, len(model.biases)))
    for t in range(len(at) - 1):
        for k, f in enumerate(model.filters):
            for c in range(toxicity.FILTERS):
                for w in range(at[t], at[t + 1]):
                    total = model.biases[k * toxicity.FILTERS + c]
                    for o in range(len(f)):
                        if w + o < at[t + 1]:
                            total += kept[w + o] * model.table[rows[w + o]].sum(0) @ f[o, :, c]
                    out[t, k * toxicity.FILTERS + c] = max(out[t, k * toxicity.FILTERS + c], total)
    return out


def test_pooled_equals_brute_force():
    model, rows, at = small_model(np.random.default_rng(4))
    kept = np.random.default_rng(5).integers(0, 2, len(rows)).astype(float)
    assert np.allclose(model.pooled(rows, at, kept)[0], slow_pooled(model, rows, at, kept), atol=1e-5)
    assert np.allclose(model.pooled(rows, at)[0], slow_pooled(model, rows, at, np.ones(len(rows))), atol=1e-5)


def test_gradients_equal_differences():
    model, rows, at = small_model(np.random.default_rng(6))
    labels, weight, kept = np.array([1, 0, 0, 1, 0]), np.array([2.0, 1, 1, 2, 1]), np.ones(len(rows))
    kept[3] = 0

    def loss():
        z = slow_pooled(model, rows, at, kept) @ model.last + model.bias
        return float(np.mean(weight * (np.logaddexp(0, z) - labels * z)))

    g = toxicity.gradients(model, rows, at, labels, weight, kept)
    table = np.zeros_like(model.table)
    np.add.at(table, g["rows"], g["table"])
    for have, found in ((model.table, table), (model.biases, g["biases"]), (model.last, g["last"]), *zip(model.filters, g["filters"], strict=True)):
        for i in np.random.default_rng(1).permutation(have.size)[:60].tolist():
            at_ = np.unravel_index(i, have.shape)
            held, two = have[at_], []
            for step in (1e-5, -1e-5):
                have[at_] = held + step
                two.append(loss())
            have[at_] = held
            assert abs((two[0] - two[1]) / 2e-5 - found[at_]) < 1e-4
    held = model.bias
    model.bias = held + 1e-5
    above = loss()
    model.bias = held - 1e-5
    assert abs((above - loss()) / 2e-5 - g["bias"]) < 1e-4


def test_sample_of_repeated_identifiers_is_bounded(spark, monkeypatch):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").unionByName(spark.range(20_000).selectExpr(f"{ids[0]}L as doc_id", "concat('word ', id) as text"))
    docs = docs.withColumn("label", docs.doc_id).withColumn("size", docs.doc_id)
    marks = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    texts, labels, known = toxicity.sample(docs, marks)
    assert sorted(known) == ids and dict(zip(known, texts, strict=True))[ids[0]] == f"text {ids[0]}" and labels.tolist() == [i % 2 for i in known]
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 50)
    assert 3 < len(toxicity.sample(docs, marks)[0]) < 10


def test_merged_is_the_mean():
    models = [small_model(np.random.default_rng(k))[0] for k in (1, 2, 3)]
    _, rows, at = small_model(np.random.default_rng(1))
    assert np.allclose(toxicity.merged(models).logits(rows, at), np.mean([m.logits(rows, at) for m in models], 0), atol=1e-4)
