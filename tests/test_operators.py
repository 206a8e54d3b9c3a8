"""Splits, samples, metrics, features, checks and joint sets against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import blocks, checks, features, items, joint, metrics, reports, sampling, scoring, split
from pairloom.operators.components import connected_components
from pairloom.plans import tables
from pairloom.sources import io
from pairloom.streaming import pairs as streaming

ITEMS = "id long, name string, attributes string, category string"


def precision(rows):
    """Average precision over falling scores, ties as one step."""
    total = sum(y for y, _ in rows)
    if not total:
        return None
    out, tp, n = 0.0, 0, 0
    for s in sorted({s for _, s in rows}, reverse=True):
        step = [y for y, z in rows if z == s]
        tp, n = tp + sum(step), n + len(step)
        out += sum(step) * tp / n
    return out / total


def test_average_precision(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abcd"), int(rng.random() < 0.3), rng.randrange(40) / 7) for _ in range(900)] + [("none", 0, 1.0)] * 3 + [("all", 1, 2.0)]
    df = spark.createDataFrame(rows, "category string, target int, score double")
    by = {r.category: r for r in metrics.average_precision_by(df, "category").collect()}
    for c, r in by.items():
        want = precision([(y, s) for k, y, s in rows if k == c])
        assert r.average_precision == (None if want is None else pytest.approx(want))
    assert metrics.average_precision(df).first().average_precision == pytest.approx(precision([(y, s) for _, y, s in rows]))
    table = metrics.average_precision_by(df, "category")
    known = [r.average_precision for r in by.values() if r.average_precision is not None]
    assert metrics.macro(table).first()[0] == pytest.approx(sum(known) / len(known))
    assert metrics.macro(table, "zero").first()[0] == pytest.approx(sum(known) / len(by))
    assert metrics.macro(table, "two_classes").first()[1] == 4
    with pytest.raises(ValueError):
        metrics.macro(table.where("category = 'all'"), "two_classes")


def dealt(capacities, count):
    """Even shares, then one more to each category with room, the roomiest first, until all are dealt."""
    quota = {c: min(n, count // len(capacities)) for c, n in capacities.items()}
    left = count - sum(quota.values())
    while left:
        for c in sorted((c for c in quota if quota[c] < capacities[c]), key=lambda c: (capacities[c] - quota[c], c), reverse=True):
            if left:
                quota[c] += 1
                left -= 1
    return quota


def test_quotas_equal_a_loop(spark):
    rng = random.Random(3)
    for _ in range(12):
        caps = {f"c{i}": rng.randrange(0, rng.choice([3, 20, 200])) for i in range(rng.randrange(1, 8))}
        count = rng.randrange(sum(caps.values()) + 1)
        got = sampling.quotas(spark.createDataFrame(list(caps.items()), "category string, capacity long"), count)
        assert {r.category: r.quota for r in got.collect()} == dealt(caps, count)
    with pytest.raises(ValueError):
        sampling.quotas(spark.createDataFrame([("a", 3)], "category string, capacity long"), 4)


def test_balanced_sample_is_exact_and_repeats(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 11).cast("string"))).alias("category"))
    a, b = (sorted(r.id for r in sampling.balanced_sample(df, 700, 5, ["id"]).collect()) for _ in range(2))
    assert a == b and len(set(a)) == 700
    assert a != sorted(r.id for r in sampling.balanced_sample(df, 700, 6, ["id"]).collect())
    assert sampling.balanced_sample(df, 0, 5, ["id"]).count() == 0


def chosen(components, fraction, seed):
    """The walk over components in seeded order."""
    import hashlib

    out = set()
    for category in {c for _, c, _ in components}:
        own = sorted(((hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i, n) for i, c, n in components if c == category))
        goal, now = round(sum(n for *_, n in own) * fraction), 0
        for _, i, n in own:
            if now < goal and (now + n <= goal or abs(goal - now - n) < abs(goal - now)):
                now += n
                out.add(i)
    return out


def test_component_selection_equals_a_walk(spark):
    rng = random.Random(5)
    for fraction in (0.0, 0.2, 0.5, 1.0):
        rows = [(i, f"c{i % 5}", rng.choice([1, 1, 2, 5, 40])) for i in range(160)]
        df = spark.createDataFrame(rows, "component long, category string, pairs long")
        got = split.validation_components(df, fraction, 9)
        assert {r.component for r in got.collect()} == chosen(rows, fraction, 9)


def test_split_shares_no_item(spark):
    rng = random.Random(2)
    pairs = [(c * 1000 + rng.randrange(60), c * 1000 + rng.randrange(60), float(rng.random() < 0.4), f"c{c}") for c in range(4) for _ in range(30)]
    df = spark.createDataFrame(pairs, "id1 long, id2 long, target double, category string")
    whole = split.split_pairs(df, 0.3, 1)
    train, val = split.train_and_val(whole)
    assert train.count() + val.count() == len(pairs) and val.count()
    mixed = df.unionByName(df.limit(1).withColumn("category", F.lit("other")))
    with pytest.raises(ValueError):
        split.split_pairs(mixed)


def test_joint_set(spark):
    human = spark.createDataFrame([(i, i + 1, float(i % 2), f"c{i % 3}") for i in range(0, 60, 2)], "id1 long, id2 long, target double, category string")
    soft = spark.createDataFrame([(100 + i, 200 + i, (i % 11) / 10, f"c{i % 3}") for i in range(200)], "id1 long, id2 long, target double, category string")
    val = spark.createDataFrame([(105,), (205,), (110,)], "id long")
    scores = human.select("id1", "id2", (F.col("id1") / 100.0).alias("cross_encoder_score"))
    hard = joint.hard_negatives(human, scores, 2)
    assert hard.count() == 6
    out = joint.joint_pairs(human, soft, val, 20, 30, hard, 4, 1)
    assert out.count() == 2 * (20 + 30 + 4 * human.count() + 6)
    ends = {r.id for r in checks.pair_ids(out.where("origin like 'soft%'")).collect()}
    assert not ends & {105, 205, 110}
    assert sorted(map(tuple, out.select("id1", "id2", "target").collect())) == sorted(map(tuple, joint.reversed_pairs(out).select("id1", "id2", "target").collect()))
    with pytest.raises(ValueError):
        joint.hard_negatives(human, scores.union(scores), 2)
    with pytest.raises(ValueError):
        joint.repeated(human, 0)


CARDS = [(1, "Tea 100g X12", '{"brand":"A","size":"1"}', "food"), (2, "tea 100G x12", '{"brand":"a","size":"2"}', "food"), (3, None, None, None), (4, "Cup", "[1]", "home"), (5, "", "{}", None)]


def test_features_of_edges(spark, tmp_path):
    cards = spark.createDataFrame(CARDS, ITEMS)
    pairs = spark.createDataFrame([(1, 2, 0.7), (3, 5, 0.2), (4, 1, 0.0)], "id1 long, id2 long, target double")
    records = items.item_records(cards)
    specs = features.attribute_specs(features.attribute_stats(pairs, records), 1)
    assert [s.column for s in specs] == ["attr_state__food__brand", "attr_state__food__size"]
    rows = {r.id1: r for r in features.pair_features(pairs, records, specs).collect()}
    assert (rows[1].name_exact, rows[1].number_match, rows[1].model_token_match, rows[1].target) == (1, 1, 1, 1)
    assert (rows[1].attr_state__food__brand, rows[1].attr_state__food__size, rows[1].equal_attribute_values) == (1, 2, 1)
    assert (rows[3].name_exact, rows[3].name_similarity, rows[3].category, rows[3].attr_state__food__brand) == (1, 1.0, "<NULL>", 0)
    swapped = {r.id2: r for r in features.pair_features(joint.reversed_pairs(pairs), records).collect()}
    for name in features.NUMERIC:
        if not name.endswith(("_a", "_b", "_a_count", "_b_count")):
            assert rows[1][name] == swapped[1][name], name
    fixed = features.with_columns(features.pair_features(pairs, records), ["id1", "id2", "target", "category", "name_exact", "attr_state__x__y"])
    assert dict(fixed.dtypes)["attr_state__x__y"] == "float" and fixed.dtypes[2] == ("target", "tinyint")
    # The same features from a stream of pairs.
    pairs.write.parquet(str(tmp_path / "in"))
    stream = streaming.stream_features(streaming.stream_pairs(spark, str(tmp_path / "in")), records, specs)
    streaming.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination(60)
    assert sorted(r.id1 for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3, 4]


def test_checks(spark):
    cards = spark.createDataFrame(CARDS, ITEMS)
    pairs = spark.createDataFrame([(1, 99, 1.0), (98, 2, 0.0)], "id1 long, id2 long, target double")
    with pytest.raises(KeyError, match="98, 99"):
        checks.require_items(pairs, cards)
    checks.require_items(pairs.where("id2 = -1"), cards)
    with pytest.raises(ValueError):
        checks.require_columns(pairs, ["id1", "score"])
    with pytest.raises(AssertionError):
        checks.require_disjoint(pairs, pairs)
    named = {r.id1: r.category for r in items.with_category(spark.createDataFrame([(99, 1), (3, 1), (99, 98)], "id1 long, id2 long"), cards).collect() if r.id2 != 98}
    assert named == {99: "food", 3: "<NULL>"}


def test_names_and_numbers_beyond_the_plain_letters(spark):
    cards = spark.createDataFrame([(1, "болт １２мм", '{"Объём чёрный":"x"}', "чай"), (2, "болт 12мм", '{"Объём чёрный":"y"}', "чай")], ITEMS)
    pairs = spark.createDataFrame([(1, 2, 1.0)], "id1 long, id2 long, target double")
    records = items.item_records(cards)
    assert [r.numbers for r in records.orderBy("id").collect()] == [["12мм"], ["12мм"]]
    stats = spark.createDataFrame([("чай", "Объём чёрный", 300), ("чай", "объем", 300)], "category string, attribute string, pairs_with_attribute_both long")
    assert [x.column for x in features.attribute_specs(stats)] == ["attr_state__чай__Объ_м_ч_рный", "attr_state__чай__объем"]
    row = features.pair_features(pairs, records).first()
    assert (row.number_match, row.number_conflict, row.numbers_jaccard, row.numbers_union_count) == (1, 0, 1.0, 1)


def length(two=False):
    """A scorer of two logits, or of one, that travels to workers by itself."""

    class Length:
        def load(self):
            return lambda left, right: [[0.0, len(a) - len(b)] if two else len(a) - len(b) for a, b in zip(left, right, strict=True)]

    return Length()


def test_missing_items_stop_features_and_scores(spark):
    cards = spark.createDataFrame(CARDS, ITEMS)
    pairs = spark.createDataFrame([(1, 2, 1.0), (1, 99, 1.0)], "id1 long, id2 long, target double")
    with pytest.raises(Exception, match="id without an item: 99"):
        features.pair_features(pairs, items.item_records(cards)).collect()
    with pytest.raises(Exception, match="id without an item: 99"):
        scoring.score_texts(pairs, items.item_texts(cards), length()).collect()
    with pytest.raises(KeyError, match="99"):
        scoring.submission(cards, pairs, length())


def test_submission_keeps_order_and_repeats(spark, tmp_path):
    cards = spark.createDataFrame(CARDS, ITEMS)
    ids = [(4, 1), (1, 2), (4, 1), (2, 1)]
    pairs = spark.createDataFrame(ids, "id1 long, id2 long").coalesce(1)
    for two in (False, True):
        rows = scoring.submission(cards, pairs, length(two), logits=True).collect()
        assert [(r.id1, r.id2) for r in rows] == ids
        texts = {r.id: r.text for r in items.item_texts(cards).collect()}
        assert [r.predict for r in rows] == [pytest.approx(1 / (1 + 2.718281828459045 ** (len(texts[b]) - len(texts[a])))) for a, b in ids]
    from pairloom import __main__ as cli

    io.write_parquet(cards, str(tmp_path / "items"))
    io.write_parquet(pairs, str(tmp_path / "pairs"))
    cli.main(["submission", "--items-path", str(tmp_path / "items"), "--matches_path", str(tmp_path / "pairs"), "-o", str(tmp_path / "out"), "--scorer", "pairloom.plans.queries:_Overlap"])
    (file,) = (tmp_path / "out").glob("*.csv")
    assert [line.split(",")[:2] for line in file.read_text().split()] == [["id1", "id2"], *[[str(a), str(b)] for a, b in ids]]


def test_heads_and_truncation():
    assert scoring.head([0.0, 800.0, -800.0]).tolist() == [0.5, 1.0, 0.0]
    assert scoring.head([[0.0], [0.0]]).tolist() == [0.5, 0.5]
    assert scoring.head([[1.0, 1.0, 1.0]]).tolist() == [pytest.approx(1 / 3)]
    for a, b, want in ((300, 5, (248, 5)), (5, 300, (5, 248)), (300, 300, (126, 127)), (200, 127, (127, 126)), (100, 100, (100, 100)), (0, 400, (0, 253))):
        left, right = scoring.truncated_pair(list(range(a)), list(range(b)))
        assert (len(left), len(right)) == want and left == list(range(len(left)))


def test_samples_of_repeated_keys_repeat(spark):
    df = spark.range(400).select((F.col("id") % 3).alias("id"), F.col("id").alias("row"), F.lit("a").alias("category"))
    a, b = (sorted(r.row for r in sampling.balanced_sample(d, 150, 5, ["id"]).collect()) for d in (df.repartition(7), df.repartition(2, "row")))
    assert a == b and len(a) == 150


def test_one_category_with_nearly_all_rows(spark):
    rng = random.Random(8)
    rows = [("big" if i % 50 else "small", int(rng.random() < 0.2), rng.random()) for i in range(4000)] + [(None, 1, 0.5), ("big", 0, None)]
    df = spark.createDataFrame(rows, "category string, target int, score double")
    got = {r.category: r.average_precision for r in metrics.average_precision_by(df, "category").collect()}
    for c in ("big", "small"):
        assert got[c] == pytest.approx(precision([(y, -1 if s is None else s) for k, y, s in rows if k == c]))
    assert got[None] == 1.0
    parts = [(i, "one", 1) for i in range(3000)] + [(3000 + i, "one", 700) for i in range(4)]
    got = split.validation_components(spark.createDataFrame(parts, "component long, category string, pairs long"), 0.3, 3)
    assert {r.component for r in got.collect()} == chosen([(i, c, n) for i, c, n in parts], 0.3, 3)


def test_early_stop_and_categories_as_sets(spark):
    rng = random.Random(4)
    rows = [(i, i, int((c in "ad") != (rng.random() < 0.05)), c, rng.random()) for i, c in enumerate(rng.choices("abcdef", k=600))]
    f = spark.createDataFrame(rows, "id1 long, id2 long, target int, category string, x double").cache()
    model = scoring.fit_trees(f.where("id1 < 400"), ["x"], rounds=20, depth=2, validation=f.where("id1 >= 400"))
    assert model.stages[-1].getNumTrees < 20
    assert " in {" in model.stages[-1].toDebugString


def test_scorers_and_reports(spark):
    cards = spark.createDataFrame([(i, f"item {i % 7} k{i}", '{"a":"1"}', f"c{i % 2}") for i in range(60)], ITEMS)
    pairs = spark.createDataFrame([(i, j, float(i % 7 == j % 7)) for i in range(60) for j in range(i + 1, 60, 3)], "id1 long, id2 long, target double")
    f = features.pair_features(pairs, items.item_records(cards, normalize=False)).cache()
    model = scoring.fit_trees(f, rounds=3, depth=3)
    scored = scoring.predicted(model, f)
    assert scored.where("prediction < 0 or prediction > 1").count() == 0
    assert [r[0] for r in scoring.importances(model)] == list(range(1, len(features.NUMERIC) + 2))
    assert scoring.predicted(scoring.fit_logistic(f), f).count() == f.count()
    errors = reports.hard_errors(scored, items.item_records(cards, normalize=False), 5)
    assert errors.groupBy("kind").count().count() == 2 and errors.count() == 10
    assert reports.baseline_report(f).count() == 4
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert zero.select(scoring.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0


def test_io(spark, tmp_path):
    cards = spark.createDataFrame(CARDS, ITEMS)
    path = str(tmp_path / "items")
    io.write_parquet(cards, path)
    io.write_parquet(cards.limit(1), path, force=False)
    assert io.row_count(spark, path) == 5 and io.read_items(spark, path, ["id"]).columns == ["id"]
    io.write_csv(spark.createDataFrame([("c", "a", 7)], io.ATTRIBUTE_STATS), str(tmp_path / "stats"), one_file=True)
    assert io.read_attribute_stats(spark, str(tmp_path / "stats")).first()[2] == 7
    io.write_report({"ключ": [1]}, str(tmp_path / "r" / "x.json"))
    assert "ключ" in (tmp_path / "r" / "x.json").read_text(encoding="utf-8")
    import hashlib

    with pytest.raises(ValueError):
        io.write_features(cards.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    ids = spark.createDataFrame([(10,), (9,), (10,), (-1,)], "id long")
    about = io.source_signature(spark, path, ids).first()
    assert about.n == 3 and about.source_bytes > 100 and about.source_changed is not None
    digest = lambda *lines: hashlib.sha256("".join(f"{x}\n" for x in lines).encode()).hexdigest()
    assert io.range_signature(ids, width=10).first()[0] == hashlib.sha256((digest(-1) + digest(9) + digest(10)).encode()).hexdigest()
    assert io.ordered_signature(ids).first()[0] == hashlib.sha256(b"-1\n9\n10\n").hexdigest()
    assert tuple(io.signature(ids).first())[:4] == (3, 18, -1, 10)


def _repeated_features(spark):
    rng = random.Random(16)
    rows = [(i, i, int(rng.random() < 0.3 + 0.4 * (i % 5 == 0)), "ab"[i % 2], float(i % 40), float(i % 7)) for i in range(400)]
    f = spark.createDataFrame(rows, "id1 long, id2 long, target int, category string, x double, y double")
    return f.unionByName(f).unionByName(f.where("id1 % 3 = 0")).cache()


def _seen(monkeypatch):
    """The rows that the fit gets."""
    fit, seen = scoring.Pipeline.fit, []
    monkeypatch.setattr(scoring.Pipeline, "fit", lambda self, df, *a: seen.append(df) or fit(self, df, *a))
    return seen


def test_trees_see_equal_rows_once_with_their_number(spark, monkeypatch):
    f, seen = _repeated_features(spark), _seen(monkeypatch)
    model = scoring.fit_trees(f, ["x", "y"], rounds=4, depth=3)
    assert seen[0].count() == f.select("target", "category", "x", "y").distinct().count() < f.count()
    assert seen[0].agg(F.sum("weight")).first()[0] == f.count()
    plain = scoring.Pipeline(stages=[*model.stages[:2], scoring.GBTClassifier(labelCol="target", maxIter=4, maxDepth=3, stepSize=0.1, maxBins=64, seed=42)]).fit(f)
    both = zip(scoring.predicted(model, f).orderBy("id1").collect(), scoring.predicted(plain, f).orderBy("id1").collect(), strict=True)
    assert all(a.prediction == pytest.approx(b.prediction, abs=1e-9) for a, b in both)


#: Parts with copies, a null label, a null key and a block of one.
BLOCKED = [(i, "tu"[i % 2], f"n{i % 3}", f"b{i * i % 4}" if i % 7 else None, i % 3 * 10) for i in range(40)] + [(50, None, "n0", "b1", 1), (51, "t", None, "b1", 1), (52, "z", "n9", "b1", 1), (53, "y", "n9", None, 1), (54, "y", "n9", None, 1)]


@pytest.fixture
def blocked(spark):
    items = spark.createDataFrame(BLOCKED, "id long, category string, name string, brand string, size int").repartition(3).cache()
    a, b = items.alias("a"), items.alias("b")
    same = (F.col("a.category") == F.col("b.category")) & (F.col("a.name") == F.col("b.name")) & (F.col("a.id") < F.col("b.id"))
    target = (F.col("a.brand") == F.col("b.brand")).cast("double").alias("target")
    return items, a.join(b, same).select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2"), target, "a.category").cache()


def _sorted(df):
    return sorted(map(str, (r.asDict().items() for r in df.collect())))


def test_folded_components_equal_those_of_all_pairs(blocked):  # component_labels_blocks
    parts, pairs = blocked
    folded = blocks.folded_pairs(parts, ["category", "name"], "brand")
    assert folded.count() < pairs.count() == folded.agg(F.sum("pairs")).first()[0]
    assert _sorted(connected_components(folded, "id1", "id2")) == _sorted(connected_components(pairs, "id1", "id2"))


def test_folded_split_equals_that_of_all_pairs(blocked):  # component_rollup, val_component_selection, split_stats, split_checks
    parts, pairs = blocked
    folded = blocks.folded_pairs(parts, ["category", "name"], "brand")
    assert _sorted(split.components_of(split.component_table(folded))) == _sorted(split.components_of(split.component_table(pairs)))
    a, b = split.split_pairs(folded, 0.4), split.split_pairs(pairs, 0.4)
    assert _sorted(split.split_stats(a)) == _sorted(split.split_stats(b))
    assert [checks.pair_ids(x).count() for x in split.train_and_val(a)] == [checks.pair_ids(x).count() for x in split.train_and_val(b)]


def test_attribute_counts_of_blocks_equal_those_of_all_pairs(spark, blocked):  # attribute_stats, csv_statistics
    parts, pairs = blocked
    records = parts.select("id", "category", F.when(F.col("id") % 5 == 0, F.create_map(F.lit("size"), F.lit("1"))).otherwise(F.create_map(F.lit("brand"), F.lit("x"), F.lit("size"), F.lit("1"))).alias("attrs"), "name")
    assert _sorted(blocks.attribute_stats(records, ["category", "name"])) == _sorted(features.attribute_stats(pairs, records.drop("name")))


def test_baselines_of_classes_equal_those_of_all_pairs(blocked):  # baseline_report, experiment_summary
    parts, pairs = blocked
    cards = parts.select("id", F.concat_ws(" ", "name", "brand", F.col("size").cast("string")).alias("name"), F.lit("{}").alias("attributes"), "category")
    records = items.item_records(cards, normalize=False)
    classes = blocks.class_pairs(parts, ["category", "name"], ["brand", "size"], "brand").drop("category", "name")
    assert classes.count() < pairs.count() == classes.agg(F.sum("weight")).first()[0]
    got = reports.baseline_report(features.pair_features(classes, records, keep=("weight",)), "weight")
    want = reports.baseline_report(features.pair_features(pairs, records))
    one = lambda df: sorted((r.experiment, r.category, r.pairs, r.positives, r.positive_rate and round(r.positive_rate, 9), r.average_precision and round(r.average_precision, 9)) for r in df.collect())
    assert one(got) == one(want)


def test_counted_summary_equals_that_of_the_drawn_pairs(spark, blocked):  # joint_summary
    parts, pairs = blocked
    score = pairs.select("id1", "id2", ((F.col("id1") * 31 + F.col("id2") * 17) % 997).cast("double").alias("cross_encoder_score"))
    soft = pairs.withColumn("target", (F.col("id1") * 7 + F.col("id2")) % 11 / 10.0)
    val = spark.createDataFrame([(3,), (8,)], "id long")
    able = joint.without_items(joint.confident(soft), val)
    want = joint.joint_summary(joint.joint_pairs(pairs, soft, val, 20, 15, joint.hard_negatives(pairs, score, 30), 4))
    counts = able.groupBy("category").agg(F.count_if(F.col("target") >= 0.7).alias("high"), F.count_if(F.col("target") <= 0.3).alias("low"))
    folded = blocks.folded_pairs(parts, ["category", "name"], "brand").groupBy("category")
    human = folded.agg(F.sum("pairs").alias("pairs"), F.sum("positives").alias("positives"), F.sum(F.col("known") - F.coalesce("positives", F.lit(0))).alias("negatives"))
    assert _sorted(joint.counted_summary(human, counts, 20, 15, 30, 4)) == _sorted(want)


def test_joined_pairs_of_blocks_are_all_pairs_with_their_items(blocked):  # confident_antijoin
    parts, pairs = blocked
    got = blocks.joined_pairs(parts, ["category", "name"])
    assert _sorted(got.select("id1", "id2", (F.col("l.brand") == F.col("r.brand")).cast("double").alias("target"), "category")) == _sorted(pairs)
    assert got.where("l.id <> id1 OR r.id <> id2").count() == 0


def test_sides_of_folded_pairs_are_those_of_all_pairs(blocked):  # split_pairs
    parts, pairs = blocked
    folded = split.sides(split.split_pairs(blocks.folded_pairs(parts, ["category", "name"], "brand"), 0.4))
    want = split.split_pairs(pairs, 0.4)
    assert want.where("is_val").count() and want.where("NOT is_val").count()
    assert _sorted(folded) == _sorted(split.sides(want))
    both = pairs.join(folded.select(F.col("id").alias("id1"), "is_val"), "id1")
    assert _sorted(both.select("id1", "id2", "is_val")) == _sorted(want.select("id1", "id2", "is_val"))


def test_hardest_pairs_are_the_hard_negatives(spark, blocked):  # hard_negatives_topk
    pairs = blocked[1]
    for score in (F.col("id1") * 31 + F.col("id2") * 17) % 5 / 3, (F.col("id1") * 31 + F.col("id2") * 17) % 97 / 9700, F.when(F.col("id1") > 9, F.lit(-1.5)), F.lit(None).cast("double"):
        scored = pairs.withColumn("cross_encoder_score", score)
        for k in (1, 7, 30, 4000):
            want = joint.hard_negatives(pairs, scored.select("id1", "id2", "cross_encoder_score"), k)
            assert _sorted(joint.hardest(scored, k)) == _sorted(want)


def test_counted_human_rows_equal_those_of_mining(spark, blocked):  # mined_summary
    parts, pairs = blocked
    soft = pairs.withColumn("target", (F.col("id1") * 7 + F.col("id2")) % 11 / 10.0)
    texts = parts.select("id", F.coalesce("brand", F.lit("-")).alias("text"))
    mined = joint.mined_pairs(pairs, soft, spark.createDataFrame([(3,)], "id long"), texts, length(), 5, 5, 30, 2)
    folded = blocks.folded_pairs(parts, ["category", "name"], "brand").groupBy("category")
    human = folded.agg(F.sum("pairs").alias("pairs"), F.sum("positives").alias("positives"), F.sum(F.col("known") - F.coalesce("positives", F.lit(0))).alias("negatives"))
    assert _sorted(joint.counted_human(human, 30, 2)) == _sorted(joint.joint_summary(mined.where("origin in ('hard', 'human')")))


@pytest.fixture
def classed(blocked):
    """Cards of the blocked items, their classes, and all pairs: two of three items have the card of others, and lists are cut short."""
    parts, pairs = blocked
    cards = parts.select("id", F.concat_ws(" ", "name", "brand", F.col("size").cast("string")).alias("title"), F.to_json(F.struct("brand", "size")).alias("attributes"), "category", "name", "brand")
    classes = tables.written(blocks.card_classes(cards, ["category", "name"], ["brand", "title", "attributes"]), "classes")
    assert classes.count() < cards.count() and classes.agg(F.max(F.size("ids"))).first()[0] > 2
    of = lambda df: df.select("id", F.col("title").alias("name"), "attributes", "category")
    return of(cards), classes, of(classes), pairs


def test_listed_features_of_classes_are_those_of_all_pairs(monkeypatch, classed):  # pair_features_core
    cards, classes, own, pairs = classed
    monkeypatch.setattr(blocks, "LISTED", 2)
    found = features.pair_features(blocks.ordered_class_pairs(classes, ["category", "name"], "brand"), items.item_records(own, normalize=False))
    assert found.count() < pairs.count()
    assert _sorted(blocks.listed_pairs(found, classes)) == _sorted(features.pair_features(pairs, items.item_records(cards, normalize=False)))


def test_listed_scores_of_classes_are_those_of_all_pairs(monkeypatch, classed):  # text_pair_score
    cards, classes, own, pairs = classed
    monkeypatch.setattr(blocks, "LISTED", 3)
    found = scoring.score_texts(blocks.ordered_class_pairs(classes, ["category", "name"], "brand"), items.item_texts(own), length())
    assert _sorted(blocks.listed_pairs(found, classes)) == _sorted(scoring.score_texts(pairs, items.item_texts(cards), length()))


def test_joint_set_of_listed_classes_equals_that_of_all_pairs(spark, classed):  # joint_dataset
    _, classes, _, pairs = classed
    soft, val = pairs.withColumn("target", (F.col("id1") * 7 + F.col("id2")) % 11 / 10.0), spark.createDataFrame([(3,), (8,)], "id long")
    able = joint.without_items(joint.confident(soft), val)
    high, low = (able.where(w).count() for w in ("target >= 0.7", "target <= 0.3"))
    told = blocks.ordered_class_pairs(classes, ["category", "name"], "brand").join(classes.select(F.col("id").alias("id1"), "category"), "id1")
    for share in (0, 2, 3):
        count = lambda n, share=share: n // share if share else n
        want = joint.joint_pairs(pairs, soft, val, count(high), count(low), None, 3, 5)
        assert _sorted(joint.drawn_soft(able, count, 5).unionByName(joint.listed_human(classes, told, 3))) == _sorted(want)


def _numbered_features(spark):
    rng = random.Random(8)
    rows = [(int(rng.random() < (0.8 if (x > 60) != (c in "ac") else 0.2)), c, float(x), float(y)) for x, y, c in ((rng.randrange(90), rng.randrange(5), rng.choice("abcd")) for _ in range(900))]
    return spark.createDataFrame(rows, "target int, category string, x double, y double").cache()


def test_whole_fit_of_many_rounds_does_not_run_jobs_by_round(spark):  # gbt_score
    f = _numbered_features(spark).where("x < 60")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    model = scoring.fit_trees(f, ["x", "y"])
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before < 30
    assert model.stages[-1].getNumTrees == 1800 and model.stages[-1].getOrDefault("maxDepth") == 8
    # Trees of so many levels tell all different rows apart: predictions are the shares of matches among equal rows.
    shares = scoring.predicted(model, f).groupBy("category", "x", "y").agg(F.avg("target").alias("share"), F.first("prediction").alias("p")).collect()
    assert max(abs(r.share - r.p) for r in shares) < 0.05


@pytest.mark.parametrize("val", [False, True])
def test_trees_are_those_of_the_library(spark, monkeypatch, val):  # gbt_score
    """Whatever the number of different rows, the fit is the same: more values than bins, and an early end, too."""
    f = _numbered_features(spark)
    train, held = (f.where("y < 4"), f.where("y = 4")) if val else (f, None)
    fit = lambda: scoring.fit_trees(train, ["x", "y"], rounds=12, depth=4, validation=held)
    own = fit()
    monkeypatch.setattr(scoring.trees, "ROWS", 0)
    library = fit()
    assert not isinstance(library.stages[-1], scoring.trees.BoostedTrees) and own.stages[-1].getNumTrees == library.stages[-1].getNumTrees
    rows = f.distinct()
    p, q = (sorted(scoring.predicted(m, rows).collect(), key=lambda r: r[:-1]) for m in (own, library))
    assert all(a.prediction == pytest.approx(b.prediction, abs=1e-9) for a, b in zip(p, q, strict=True))
    assert own.stages[-1].featureImportances.toArray() == pytest.approx(library.stages[-1].featureImportances.toArray(), abs=1e-6)
