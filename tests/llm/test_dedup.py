"""Suffix-array dedup, the Jaccard join, and the pipeline."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import SCHEMA, SF, rows_of
from pyspark.sql import functions as F

import corpus_pipeline
from pairloom.llm import jaccard, packing, passages, shingles, tokens
from pairloom.llm.suffixes import CoverSorter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("seed", range(12))
def test_sorter_orders_suffixes(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(60, 900))).astype(np.uint8)
    x = np.tile(x[:60], 20) if seed % 3 == 0 else x
    depth = int(rng.choice([10, 16, 50]))
    sorter, at = CoverSorter(x, depth), rng.permutation(len(x) - depth + 1)
    got = np.concatenate(list(sorter.blocks(at, limit=64)))
    keys = [x.tobytes()[i : i + depth] for i in got]
    assert sorted(got.tolist()) == sorted(at.tolist()) and keys == sorted(keys)
    assert sorter.agree(got[:-1], got[1:]).tolist() == [a == b for a, b in zip(keys, keys[1:], strict=False)]


def kept_bytes(docs, length=passages.LENGTH):
    """(id, bytes, removed or not for each byte) by a table of all strings."""
    key = lambda i: float("inf") if i is None else i
    least = {}
    for i, t in docs:
        raw = (t or "").encode()
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            least[s] = min(least.get(s, float("inf")), key(i))
    out = []
    for i, t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            if least[raw[k : k + length]] < key(i):
                gone[k : k + length] = True
        out.append((i, raw, gone))
    return out


def removed(docs, length=passages.LENGTH):
    """(id, bytes, removed, spans, digest)."""
    out = []
    for i, raw, gone in kept_bytes(docs, length):
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum()) if len(raw) else 0
        out.append((str(i), len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def dedup(df, **more):
    return sorted((str(r[0]), *r[1:]) for r in passages.digests(passages.removed(df, **more)).collect())


@pytest.mark.parametrize("hot", [passages.HOT, 1])
def test_passages_equal_brute_force(documents, edges, edge_texts, hot):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    assert dedup(documents, hot=hot) == removed(docs)
    assert dedup(edges.select("doc_id", "text"), hot=hot) == removed([(None if i == "null" else i, t) for i, t in edge_texts])


def test_passages_of_small_alphabets(spark, monkeypatch):
    rng = random.Random(4)
    docs = []
    for i in range(60):
        parts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 90))) for _ in range(3)]
        if docs and rng.random() < 0.7:
            old = docs[rng.randrange(len(docs))][1]
            a = rng.randrange(len(old))
            parts.insert(1, old[a : a + rng.choice([49, 50, 51, 75, 300])])
        docs.append((i, "".join(parts) + "é" * rng.randrange(3)))
    df = spark.createDataFrame(rng.sample(docs, len(docs)), "doc_id long, text string").repartition(3)
    assert dedup(df) == removed(docs)


@pytest.mark.parametrize("docs", [[(1, 50), (2, 50)], [(1, 200), (2, 200), (3, 200)], [(2, 90), (1, 90), (None, 90)]])
def test_passages_of_exact_copies_in_one_batch(spark, docs):
    text = "".join(random.Random(7).choices("abcdefghij ", k=200))
    docs = [(i, text[:n]) for i, n in docs]
    assert dedup(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)) == removed(docs)


def test_passages_are_cut_where_they_are_found(spark):
    rng = random.Random(11)
    own, shared_ = ["".join(rng.choices("abcdefghijklmnop ", k=300_000)) for _ in range(9)], "é" * 30 + "".join(rng.choices("xyz", k=60))
    own = [t[:999] + str(i) * 2 + t[1001:] for i, t in enumerate(own)]  # what stands beside the passage is of one text
    rows = [(i, t[:1000] + shared_ + t[1000:], i + 0.5) for i, t in enumerate(own)] + [(9, None, 9.5), (10, "", 10.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed_spans double").coalesce(1)
    cut = passages.without(df)
    # One Python worker a task: a second one would hold the texts again.
    assert cut._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = [rows[0], *[(i, t, i + 0.5) for i, t in enumerate(own)][1:], *rows[9:]]
    assert sorted(map(tuple, cut.collect())) == want


def test_stretches_hold_every_window_once():
    rng = np.random.default_rng(2)
    texts = ["".join(chr(97 + int(c)) for c in rng.integers(0, 3, int(n))) for n in rng.integers(0, 200, 80)]
    x = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *map(len, texts)])
    text, first, last, *_ = passages.stretches(x, at)
    got = sorted(w for a, b in zip(first.tolist(), last.tolist(), strict=True) for w in range(a, b + 1))
    assert got == sorted(at[i] + k for i, t in enumerate(texts) for k in range(len(t) - passages.LENGTH + 1))
    assert (at[text] <= first).all() and (last + passages.LENGTH <= at[text + 1]).all()


def test_passages_of_an_empty_table_and_clashing_columns(empty, edges):
    assert dedup(empty) == []
    clash = edges.withColumn("removed_spans", F.lit(1)).withColumn("batch", F.lit(2)).withColumn("rows", F.lit(3))
    assert passages.without(clash.drop("removed_spans")).count() == edges.count()
    assert passages.removed(clash).where("batch = 2 and rows = 3").count() == edges.count()


def sets_of(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def joined(docs):
    """(id, set size, component) by all pairs that share a shingle."""
    sets = [sets_of(t) for _, t in docs]
    holders, root = {}, list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for k in s:
            holders.setdefault(k, []).append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for k in s for j in holders[k] if j < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(best.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(docs))


def near(df, **more):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.join(df, **more).collect())


def test_sets_equal_python(documents, edge_texts):
    texts = [t for _, t in edge_texts] + [r.text for r in documents.collect()] + ["x" * 700_000 + " y z " * 5, "A b\x0bc\x0cd\re"]
    seen = {}
    for first, value, at in shingles.sets(pa.array(texts, pa.string())):
        for i, d in enumerate(shingles.digests(value, at).tolist()):
            s = sets_of(texts[first + i])
            assert at[i + 1] - at[i] == len(s) and seen.setdefault(s, d) == d
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize(("cost", "more"), [(16, {}), (1, {"bits": 14, "tile": 3})])
def test_join_equals_brute_force(spark, documents, edges, edge_texts, cost, more):
    rng = random.Random(cost)
    words = [f"w{k}" for k in range(400)]
    made = []
    for i in range(220):
        base = made[rng.randrange(len(made))][1].split() if made and rng.random() < 0.8 else rng.choices(words, k=rng.randrange(1, 120))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            base[rng.randrange(len(base))] = rng.choice(words)
        made.append((10_000 + i, " ".join(base[: len(base) - rng.choice([0, 0, 1, 3])] or base)))
    docs = made + [(r.doc_id, r.text) for r in documents.limit(60).collect()]
    df = spark.createDataFrame(rng.sample(docs, len(docs)), "doc_id long, text string").repartition(3)
    # Few bits name sets twice, small tiles cut every shingle's members.
    assert near(df, cost=cost, **more) == joined(docs)


@pytest.mark.parametrize("more", [{}, {"cost": 1, "bits": 14, "tile": 3}])
def test_every_link_is_counted(spark, edges, edge_texts, more):
    rng = random.Random(25)
    base = [f"w{k}" for k in range(60)]
    docs = [(None if i == "null" else i, t) for i, t in edge_texts]
    # One group of near copies and of copies, all in one component, where two hubs tie everything.
    for i in range(60):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(3)}"
        docs.append((20_000 + i, " ".join(words)))
    sets = [sets_of(t) for _, t in docs]
    linked = [[j for j, b in enumerate(sets) if j != i and a and 100 * len(a & b) >= 80 * len(a | b)] for i, a in enumerate(sets)]
    assert sum(map(len, linked)) > 1000
    df = spark.createDataFrame(rng.sample(docs, len(docs)), "doc_id long, text string").repartition(3)
    found = jaccard.join(df, count_links=True, **more).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.n_links) for r in found) == sorted((str(d), len(sets[i]), len(linked[i])) for i, (d, _) in enumerate(docs))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == joined(docs)
    pairs, members = jaccard.links(df, **more)
    of = {r["class"]: r.n_shingles for r in members.collect()}
    pairs = [(r.a, r.b) for r in pairs.collect()]
    assert len(pairs) == len(set(pairs)) == len({frozenset((sets[i], sets[j])) for i in range(len(docs)) for j in linked[i] if sets[i] != sets[j]})
    assert None in of and {x for p in pairs for x in p} < set(of)


def test_join_of_an_empty_table_and_clashing_columns(empty, edges, edge_texts):
    assert near(empty) == []
    clash = edges.withColumn("node", F.lit(1)).withColumn("id", F.lit(2)).withColumn("component", F.lit("x")).withColumn("n", F.lit(3))
    assert near(clash) == joined([(None if i == "null" else i, t) for i, t in edge_texts])


def test_digests_that_never_tell_sets_apart(documents):
    with pytest.raises(RuntimeError, match="digest"):
        jaccard.join(documents, bits=2)


def test_pipeline_stages(spark, documents, tmp_path):
    columns = documents.columns
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        kept[name] = (docs, out)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        docs = out
    before, after = kept["near_duplicates"]
    want = {r for r, _, c in joined([(d.doc_id, d.text) for d in before.collect()]) if r == c}
    assert {str(d.doc_id) for d in after.collect()} == want
    before, after = kept["repeated_passages"]
    left = {d.doc_id: d.text for d in after.collect()}
    want = {i: np.frombuffer(raw, np.uint8)[~gone].tobytes().decode(errors="ignore") for i, raw, gone in kept_bytes([(d.doc_id, d.text) for d in before.collect()])}
    assert left == {i: t for i, t in want.items() if t.strip(" ")}
    cut = [i for i, t in left.items() if t != {d.doc_id: d.text for d in before.collect()}[i]]
    assert cut and all(d.n_chars == len(d.text) for d in after.collect() if d.doc_id in cut)
    before, after = kept["source_mix"]
    assert {d.doc_id for d in after.collect()} <= {d.doc_id for d in before.collect()}
    before, after = kept["packed_sequences"]
    assert {d.doc_id for d in after.collect()} == {d.doc_id for d in before.collect()}
    assert corpus_pipeline.run(spark, SF).count() == after.count()


def test_near_duplicates_of_missing_and_repeated_identifiers(spark):
    words = [f"w{k}" for k in range(400)]
    a, b, c, d = (" ".join(words[k : k + 60]) for k in (0, 100, 200, 300))
    texts = [("null", a), ("null", a + " x"), (1, b), ("null", b + " x"), ("null", b), (2, c), (3, c + " x"), (3, d), (4, d + " x"), (5, ""), ("null", ""), ("null", ""), ("null", None)]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3), SF).collect()
    got = [(r.doc_id, r.text) for r in out]
    # One row of the group without identifiers, either of its texts; elsewhere that of the least identifier.
    rest = [r for r in got if r not in [(None, a), (None, a + " x")]]
    assert len(got) - len(rest) == 1
    assert sorted(map(str, rest)) == sorted(map(str, [(1, b), (2, c), (3, d), (5, ""), (None, ""), (None, None)]))


def test_a_halved_character_goes_as_a_whole(spark):
    base = "".join(random.Random(3).choices("abcdefgh ", k=60))
    # The second text shares the 60 letters and the first byte of the next character.
    docs = spark.createDataFrame(rows_of([(1, base + "é" + "z" * 10), (2, base + "ê" + "y" * 10), (3, base), (4, None)]), SCHEMA)
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.repeated_passages(spark, docs, SF).collect()}
    assert got == {1: (base + "é" + "z" * 10, 71), 2: ("y" * 10, 10), 4: (None, None)}


def test_stages_keep_clashing_columns(spark, edges):
    names = ["__id", "__key", "key", "bin", "part", "rank", "task", "batch", "rows", "quality", "mix", "removed_spans", "component_id", "node"]
    more = [(20 + i, " ".join(f"the word{i * 100 + k} of and to" for k in range(12))) for i in range(4)]
    docs = spark.createDataFrame(rows_of(more, 3), SCHEMA).withColumn("lang", F.lit("en")).withColumn("source", F.lit("src1"))
    for k, n in enumerate(names):
        docs = docs.withColumn(n, F.lit(k))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).collect()
        assert out and all([r[n] for n in names] == list(range(len(names))) for r in out)
    for name in ("bin", "rank", "part"):
        own = docs.select(F.col("doc_id").alias(name), "text")
        assert packing.packed(packing.pieces(own, tokens.vocabulary("word_bpe_49k.json"), 2, id_col=name), name).count() == 4


def test_stages_of_edges_and_empty_tables(spark, edges, empty):
    more = spark.createDataFrame(rows_of([(20 + i, " ".join(f"the word{i * 100 + k} of and to" for k in range(12))) for i in range(4)], 3), edges.schema)
    for docs in (edges.unionByName(more), empty):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).collect()


@pytest.mark.parametrize("blind", [False, True])
def test_bytes_decide_not_hashes(monkeypatch, blind):
    if blind:  # every hash the same
        monkeypatch.setattr(passages, "_mix", lambda h: h & np.uint64(0))
    rng = np.random.default_rng(6)
    base = "".join(chr(97 + int(c)) for c in rng.integers(0, 2, 400))
    texts = [base[a : a + n] for a, n in zip(rng.integers(0, 40, 60).tolist(), rng.integers(50, 81, 60).tolist(), strict=True)]
    docs = rng.integers(0, 20, 60)
    x = np.frombuffer("".join(texts).encode(), np.uint8)
    got = passages._covered(x, docs, np.array([len(t) for t in texts]))
    least = {}
    for t, d in zip(texts, docs.tolist(), strict=True):
        for k in range(len(t) - 49):
            least[t[k : k + 50]] = min(d, least.get(t[k : k + 50], d))
    for t, d, m in zip(texts, docs.tolist(), got.tolist(), strict=True):
        assert [m >> k & 1 == 1 for k in range(len(t) - 49)] == [least[t[k : k + 50]] < d for k in range(len(t) - 49)]
    at = np.cumsum([0, *map(len, texts)])
    i, j = np.divmod(np.arange(3600), 60)
    sizes = np.diff(at)
    assert passages._same(x, at[i], at[j], sizes[i], sizes[j]).tolist() == [texts[a] == texts[b] for a, b in zip(i, j, strict=True)]


def test_words_at_any_place_sort_as_their_bytes():  # op10_suffix_array_dedup
    import numpy as np

    from pairloom.llm import suffixes

    rng = np.random.default_rng(3)
    text = rng.integers(0, 3, 4000).astype(np.uint8) * 127
    at = rng.integers(0, 3990, 900)
    want = [int.from_bytes(text[i : i + 8].tobytes(), "big") for i in at]
    assert suffixes.big(suffixes.words_of(text)[at]).tolist() == want
    # A block in order, its suffixes told apart by their first 50 bytes at least.
    sorter = suffixes.CoverSorter(text, 50)
    got = [text[i : i + 50].tobytes() for block in sorter.blocks(np.arange(3900), 500) for i in block]
    assert got == sorted(got) and len(got) == 3900
