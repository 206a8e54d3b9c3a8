"""License scans, quality rules and the mix of sources."""

import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from pairloom.llm import licenses, mixing, quality, queries, sql
from pairloom.llm.license_rules import BASE, NAMES, NOTICES, Signature, signatures

from llm_cases import SF, rows_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NO_PYTHON = re.compile("Python|Pandas|Arrow")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def license_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def scanned(text, rules):
    """Detections by trying every rule at every word."""
    words = license_words(text)
    norm = " " + " ".join(words) + " "
    found = []
    for r in rules:
        if not set(r.keyword.split()) <= set(words):
            continue
        for m in re.finditer(f"( (?:{r.pattern}))(?= )", norm):
            start = norm[: m.start()].count(" ")
            found.append((start, start + m[0].count(" "), r.priority, r.label))

    def inside(a, b):
        same = a[:2] == b[:2]
        return b[0] <= a[0] and a[1] <= b[1] and (b[2] < a[2] or (b[3] == a[3] and not same))

    kept = [a for a in found if not any(inside(a, b) for b in found)]
    base = [(label, i) for label, p in BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), sorted(base), sorted((s, e, x) for s, e, _, x in kept)


TEXTS = [
    "MIT License",
    "the MIT License and the mit-license, MIT LICENSE",
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
    "This work is licensed under the GNU General Public License, version 3. GNU GPL v2, LGPLv2.1 or the GNU Lesser General Public License",
    "SPDX-License-Identifier: BSD-3-Clause-Clear and SPDX-License-Identifier: MIT",
    "released under the terms of the MIT license; all rights reserved",
    "Creative Commons Attribution-NonCommercial 4.0, CC BY-NC-SA 4.0, CC0 1.0 Universal",
    "licence MIT mit licénse GPL" * 3,
    "mit license " * 400,
]


def test_license_scan_equals_brute_force(spark, documents, edge_texts):
    rules = signatures()
    texts = [(i, t) for i, (_, t) in enumerate([*edge_texts, *enumerate(TEXTS)])] + [(1000 + r.doc_id, r.text) for r in documents.collect()]
    df = spark.createDataFrame(texts, "id long, text string").repartition(2)
    got = {r.id: r.license for r in licenses.scan(df).collect()}
    for i, t in texts:
        x = got[i]
        assert (x.n_words, sorted(map(tuple, x.base)), sorted((f.start, f.end, f.label) for f in x.found)) == scanned(t, rules), t


def test_license_rules_are_sound():
    rules = signatures()
    assert len(rules) > 200 and [r.priority for r in rules] == list(range(len(rules)))
    assert sum(len(t.strip().splitlines()) for t in (NOTICES, NAMES)) >= 200
    for r in rules:
        assert re.compile(r.pattern) and all(re.search(rf"\b{k}", r.pattern.replace("?", "")) for k in r.keyword.split()), r


def matches(parsed):
    """Texts that a parsed pattern takes: every branch, every repeat at its least and most, at most 5 times."""
    out = [""]
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            some = [chr(value)]
        elif name == "ANY":
            some = ["x"]
        elif name == "IN":
            some = [chr(v) if str(k) == "LITERAL" else chr(v[0]) for k, v in value]
        elif name == "BRANCH":
            some = [t for b in value[1] for t in matches(b)]
        elif name == "SUBPATTERN":
            some = matches(value[3])
        else:
            assert name in ("MAX_REPEAT", "MIN_REPEAT"), name
            some = [t * n for n in {value[0], min(int(value[1]), 5)} for t in matches(value[2])]
        out = [a + t for a in out for t in some]
    return out


def test_license_matches_hold_their_keyword():
    for r in signatures():
        for t in matches(re._parser.parse(r.pattern)):
            assert set(r.keyword.split()) <= set(t.split()), (r, t)


def test_license_of_beerware_in_one_word(spark):
    texts = [("under the beerware license",), ("under the Beer-Ware license",)]
    rows = licenses.scan(spark.createDataFrame(texts, "text string")).collect()
    assert [[f.label for f in r.license.found] for r in rows] == [["Beerware"], ["Beerware"]]


def test_license_order_decides_between_equals(spark):
    rules = (Signature(0, "first", "foo", "foo bar", 1.0), Signature(1, "second", "foo", "foo bar", 0.5), Signature(2, "long", "foo", "foo bar baz", 0.5))
    found = licenses.scan(spark.createDataFrame([("foo bar baz",)], "text string"), rules=rules).first().license.found
    assert sorted(f.label for f in found) == ["first", "long"]


def test_long_detections_suppress_whatever_lies_between(spark):
    rules = (Signature(0, "long", "from", "from( w)* to", 1.0), Signature(1, "short", "w", "w", 0.5))
    texts = ["from" + " w" * 5000 + " to w w", "w from w to " * 50]
    rows = licenses.scan(spark.createDataFrame([(t,) for t in texts], "text string"), rules=rules).collect()
    for r in rows:
        assert sorted((f.start, f.end, f.label) for f in r.license.found) == scanned(r.text, rules)[2]


def test_native_plans_hold_no_python(spark):
    for name in ("op1_license_scan", "op7_quality_rules", "op3_source_mixing"):
        assert not NO_PYTHON.search(plan_of(queries.QUERIES[name](spark, SF))), name


def test_scan_and_rules_of_empty_tables_and_clashing_columns(spark, empty, edges):
    assert licenses.scan(empty).collect() == [] and quality.judged(empty).collect() == []
    clash = edges.withColumn("license", F.lit(1)).withColumn("quality", F.lit(2)).withColumn("mix", F.lit(3)).withColumn("a.b", F.lit(4))
    assert set(licenses.scan(clash).columns) == {*clash.columns}
    kept = quality.kept(clash)
    assert kept.columns == clash.columns and all(r["quality"] == 2 for r in kept.collect())
    assert mixing.mixed(clash, mixing.Recipe()).select("a.b" if False else "`a.b`").count() == clash.count()


def measures(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_equals_brute_force(spark, documents, edge_texts):
    more = ["a b c d e f g h " * 5, "x " * 30, "one\ntwo\none\n\n \none", "#* $%  & | <>", " nb sp " * 9, "w1 w2 w3 w4 w5 w6 w7 w8 X w1 w2 w3 w4 w5 w6 w7 w8", "😀 😀" * 20]
    texts = list(enumerate([*[t for _, t in edge_texts], *more, *[r.text for r in documents.collect()]]))
    df = spark.createDataFrame(texts, "id long, text string").repartition(2)
    for r in quality.judged(df).collect():
        q, want = r.quality, measures(r.text)
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == want, r.text
        base = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert base == any(x in q.failed for x in quality.BASE) and not (base and q.kept)
    assert quality.kept(df).count() == quality.judged(df).where("quality.kept").count()


def test_good_documents_pass(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(labels.select("doc_id", F.col("quality").alias("good")), "doc_id")
    rows = quality.judged(docs).select("good", "quality.kept", "quality.failed").collect()
    clean = [r for r in rows if r.good == 1 and not set(r.failed) & set(quality.BASE)]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)
    assert sum(r.kept for r in rows if r.good == 0) <= 0.3 * sum(r.good == 0 for r in rows)


def filled(children, budget):
    """(name, cap, weight) dealt one level: shares by weight, the full ones' rest again to the others."""
    share, left = {n: 0 for n, *_ in children}, Fraction(min(budget, sum(c for _, c, w in children if w)))
    open_ = {n: (c, w) for n, c, w in children if w}
    while open_:
        total = sum(w for _, w in open_.values())
        full = {n for n, (c, w) in open_.items() if c <= left * w / total}
        if not full:
            upto = 0  # what rounding leaves over goes on to the next
            for n, (_, w) in sorted(open_.items(), key=lambda x: (Fraction(*x[1]), x[0])):
                share[n] = int(left * (upto + w) / total) - int(left * upto / total)
                upto += w
            break
        for n in full:
            share[n] = open_[n][0]
        left -= sum(open_.pop(n)[0] for n in full)
    return share


def test_budgets_equal_a_loop(spark):
    leaves = [("web", "en", "src0", 900), ("web", "en", "src1", 30), ("web", "de", "src1", 5), ("curated", "en", "src11", 100), ("curated", "fr", "src12", 0), ("curated", "fr", "src13", 40)]
    recipe = mixing.Recipe(domains={"web": 1, "curated": 4}, langs={"de": 3}, sources={"src1": 2}, budget=500, epochs=2)
    got = {(r.domain, r.lang, r.source): r.share for r in mixing.budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"), recipe).collect()}

    def down(path, budget):
        depth = len(path)
        below = [x for x in leaves if x[:depth] == path]
        weights = (recipe.domains, recipe.langs, recipe.sources)[depth]
        names = sorted({x[depth] for x in below})
        caps = [(n, 2 * sum(x[3] for x in below if x[depth] == n), weights.get(n, 1)) for n in names]
        for n, share in filled(caps, budget).items():
            if depth == 2:
                assert got[(*path, n)] == share, (path, n)
            else:
                down((*path, n), share)

    down((), 500)
    assert sum(got.values()) == 500


@pytest.mark.parametrize("recipe", [mixing.Recipe(), mixing.Recipe(permille=500), mixing.Recipe(budget=0), mixing.Recipe(budget=10**9, epochs=3), mixing.Recipe(permille=2500, epochs=4, domains={"web": 0}), mixing.Recipe(domains={"web": 1, "curated": 9}, permille=700, epochs=2, seed=7)])
def test_mix_equals_sql(spark, documents, recipe):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(f"WITH {sql.mixing_sql(recipe)} SELECT doc_id, n_epochs, share FROM taken").fetchall() if recipe.domains.get("web") != 0 else None
    got = [(r.doc_id, r.mix.n_epochs, r.mix.share) for r in mixing.mixed(documents, recipe).collect()]
    if want is not None:
        assert sorted(got) == sorted(want)
    used = Counter()
    for r in mixing.mixed(documents, recipe).select("mix.*").collect():
        used[r.domain, r.lang, r.source, r.share] += r.n_tokens * r.n_epochs
        assert 1 <= r.n_epochs <= recipe.epochs
    assert all(n <= key[3] for key, n in used.items())


def test_mix_of_edges(spark, edges, empty):
    assert mixing.mixed(empty, mixing.Recipe()).collect() == []
    taken = mixing.mixed(edges, mixing.Recipe()).collect()
    assert len(taken) == edges.count()
    assert {r.mix.lang for r in taken} >= {"<null>"} and {r.mix.source for r in taken} >= {"<null>"}
    half = mixing.mixed(edges, mixing.Recipe(permille=500)).select("mix.*").collect()
    assert sum(r.n_tokens * r.n_epochs for r in half) <= sum(r.mix.n_tokens for r in taken) // 2
    clash = edges.withColumn("key", F.lit("k")).withColumn("share", F.lit(1)).withColumn("domain", F.lit("d"))
    assert {(r["key"], r["share"], r["domain"]) for r in mixing.mixed(clash, mixing.Recipe()).collect()} == {("k", 1, "d")}
    same = spark.createDataFrame(rows_of([(1, "a b c d")] * 9), edges.schema)
    assert mixing.mixed(same.withColumn("source", F.lit("src1")).withColumn("lang", F.lit("en")), mixing.Recipe(budget=10)).count() == 0


@pytest.mark.parametrize("identifier", ["null", 7])
def test_half_a_leaf_without_own_identifiers(spark, identifier, edges):
    texts = [(identifier, f"some words of document {i} " * (1 + i % 3)) for i in range(1000)]
    df = spark.createDataFrame(rows_of(texts), edges.schema).withColumn("lang", F.lit("en")).withColumn("source", F.lit("src1"))
    every = sum(len(t.split()) for _, t in texts)
    taken = mixing.mixed(df, mixing.Recipe(budget=every // 2)).collect()
    assert every // 2 - 15 < sum(r.mix.n_tokens for r in taken) <= every // 2
    assert len({r.text for r in taken}) == len(taken)


def test_mix_of_more_leaves_than_are_broadcast(spark, documents, monkeypatch):
    recipe = mixing.Recipe(permille=500)
    rows = lambda: sorted((r.doc_id, r.mix.n_epochs) for r in mixing.mixed(documents, recipe).collect())
    want = rows()
    monkeypatch.setattr(mixing, "SMALL", 1)
    monkeypatch.setattr(mixing, "HOT", 20)
    assert rows() == want
