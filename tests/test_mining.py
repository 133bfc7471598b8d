import random

import pytest
from pyspark.sql import functions as F

from latticeforge.functions import intents
from latticeforge.functions.labels import LabelSchema
from latticeforge.operators import mining
from latticeforge.operators.bagging import bagged_predict
from latticeforge.operators.context import Context, density, mask_labels, reorder_by_support
from latticeforge.operators.evaluation import evaluate
from latticeforge.operators.prediction import predict
from latticeforge.operators.sampling import fold_samples, parse_ratio, split

BINARY = LabelSchema.parse("B(a,b)")


def context(spark, rows, n, labels=BINARY):
    data = [(i, sorted(r), list(p)) for i, (r, p) in enumerate(rows)]
    return Context(spark.createDataFrame(data, "row_id long, intent array<int>, prop array<int>"), n, labels)


def closed_sets(rows, min_support):
    found = {frozenset(r) for r, _ in rows}
    while True:
        more = found | {a & frozenset(b) for a in found for b, _ in rows}
        if more == found:
            break
        found = more
    return {s: [p for r, p in rows if s <= set(r)] for s in found if sum(s <= set(r) for r, _ in rows) >= min_support}


def majority(votes):
    v, n = sum(1 if p == 0 else -1 for p in votes), len(votes)
    return 0 if v > n // 2 else 1 if v < -(n // 2) else -1


@pytest.mark.parametrize("seed,n,size,small", [(1, 8, 20, 256), (2, 70, 30, 256), (3, 12, 40, 3), (4, 64, 25, 3)])
def test_mined_sets_equal_brute_force(spark, monkeypatch, seed, n, size, small):
    monkeypatch.setattr(mining, "SMALL_ROWS", small)
    rng = random.Random(seed)
    pool = rng.sample(range(n), min(n, 9))
    rows = [(tuple(x for x in pool if rng.random() < 0.5), (rng.randrange(2),)) for _ in range(size)]
    want = closed_sets(rows, 2)
    c = context(spark, rows, n)
    got = mining.concepts(c).collect()
    assert {frozenset(r.intent): r.n for r in got} == {s: len(p) for s, p in want.items()} and len(got) == len(want)
    model = {frozenset(r.intent): r.prop[0] for r in mining.generate(c, strategy="votingMajority").collect()}
    assert model == {s: m for s, p in want.items() if (m := majority([x[0] for x in p])) != -1}
    model = {frozenset(r.intent): r.prop[0] for r in mining.generate(c).collect()}
    assert model == {s: p[0][0] for s, p in want.items() if len({x[0] for x in p}) == 1}


def test_deep_expansion_without_tail(spark, monkeypatch):
    monkeypatch.setattr(mining, "SMALL_ROWS", 0)
    rng = random.Random(9)
    rows = [(tuple(x for x in range(7) if rng.random() < 0.6), (0,)) for _ in range(25)]
    c = context(spark, rows, 7)
    monkeypatch.setattr(mining, "TASK_ROWS", 0)
    from latticeforge.operators.context import compress, count_names

    got = mining.mine_compressed(compress(c, F.lit("").alias("group")), 7, count_names(BINARY), 2, task_rows=0)
    words = [F.col(x) for x in intents.word_names(7, "d")]
    found = [tuple(r.i) for r in got.select(intents.from_words(words, 7).alias("i")).collect()]
    assert sorted(found) == sorted(tuple(sorted(s)) for s in closed_sets(rows, 2))


def test_fixed_contexts(spark):
    chain = [((0,), (0,)), ((0, 1), (0,)), ((0, 1, 2), (1,))]
    got = {tuple(r.intent): r.n for r in mining.concepts(context(spark, chain, 3), min_support=1).collect()}
    assert got == {(0,): 3, (0, 1): 2, (0, 1, 2): 1}
    apart = [((0,), (0,)), ((1,), (0,))]
    assert [(r.intent, r.prop, r.support) for r in mining.generate(context(spark, apart, 2)).collect()] == [([], [0], 2)]
    opposite = [((0,), (0,)), ((0,), (1,))]
    assert mining.generate(context(spark, opposite, 1)).count() == 0
    empty = context(spark, [], 3)
    assert mining.generate(empty).count() == 0 and mining.root_concept(empty).head().intent == [0, 1, 2]


def test_noop_mines_each_class(spark):
    rows = [((0, 1), (0,)), ((0, 2), (0,)), ((0, 1), (1,)), ((1, 2), (1,))]
    got = {(tuple(r.intent), r.prop[0]): r.support for r in mining.generate(context(spark, rows, 3), strategy="noop").collect()}
    assert got == {((0,), 0): 2, ((1,), 1): 2}
    whole = mining.generate(context(spark, rows, 3), strategy="noop", split_classes=False).collect()
    want = {tuple(sorted(s)): next(p for r, p in rows if s <= set(r)) for s in closed_sets(rows, 2)}
    assert {tuple(r.intent): tuple(r.prop) for r in whole} == want


def test_options_are_checked(spark):
    c = context(spark, [((0,), (0,))], 1)
    for options in ({"algorithm": "x"}, {"strategy": "x"}, {"data_structure": "x"}, {"min_support": 0}):
        with pytest.raises(ValueError):
            mining.generate(c, **options)
    with pytest.raises(mining.TooManyConcepts):
        mining.generate(context(spark, [((i,), (0,)) for i in range(5)], 5), min_support=1, max_concepts=2)


def test_composite_and_ordinal(spark):
    labels = LabelSchema.parse("B(a,b)O(x,y,z)")
    rows = [((0,), (0, 2)), ((0,), (0, 1)), ((0,), (1, 1))]
    got = mining.generate(context(spark, rows, 1, labels)).collect()
    assert got == []  # every component conflicts
    assert mining.generate(context(spark, rows, 1, labels), strategy="votingMajority").head().prop == [0, 1]
    ordinal = LabelSchema.parse("O(x,y,z)")
    rows = [((0,), (2,)), ((0,), (1,)), ((0,), (2,)), ((0,), (0,))]
    assert mining.generate(context(spark, rows, 1, ordinal), strategy="votingMajority").head().prop == [2]
    assert mining.generate(context(spark, rows, 1, ordinal), strategy="boundedVotingMajority:2").count() == 0
    assert mining.generate(context(spark, rows, 1, ordinal), strategy="boundedVotingMajority:3").head().prop == [2]


def test_prediction_and_evaluation(spark):
    rng = random.Random(4)
    rows = [(tuple(x for x in range(10) if rng.random() < 0.4), (rng.randrange(2),)) for _ in range(60)]
    train, test = rows[:40], rows[40:]
    c = context(spark, train, 10)
    model = mining.generate(c)
    hyps = [(set(r.intent), r.prop[0]) for r in model.collect()]
    examples = context(spark, test, 10)
    found = predict(model, mask_labels(examples))
    got = {r.row_id: r.prop[0] for r in found.collect()}
    want = {i: (majority([p for h, p in hyps if h <= set(r)]) if any(h <= set(r) for h, _ in hyps) else -2) for i, (r, _) in enumerate(test)}
    assert got == want
    r = evaluate(examples, examples.with_rows(found)).head()
    assert (r.correct, r.unknown, r.conflicts, r.total) == (sum(want[i] == p[0] for i, (_, p) in enumerate(test)), sum(v == -2 for v in want.values()), sum(v == -1 for v in want.values()), len(test))
    with pytest.raises(Exception, match="unknown labels"):
        evaluate(mask_labels(examples), examples).collect()
    with pytest.raises(Exception, match="partner"):
        evaluate(examples, examples.with_rows(found.where("row_id > 2"))).collect()


def test_empty_hypothesis_matches_everything(spark):
    model = spark.createDataFrame([([], [1])], "intent array<int>, prop array<int>")
    examples = context(spark, [((), (0,)), ((0, 1), (0,))], 2)
    assert {tuple(r.prop) for r in predict(model, examples).collect()} == {(1,)}
    votes = [([], [1], 0), ([0], [0], 0), ([1], [0], 0), ([0], [0], 1)]
    models = spark.createDataFrame(votes, "intent array<int>, prop array<int>, fold int")
    got = {(r.row_id, r.fold): r.prop[0] for r in predict(models, examples, by=("fold",)).collect()}
    assert got == {(0, 0): 1, (0, 1): -2, (1, 0): majority([1, 0, 0]), (1, 1): 0}
    assert {tuple(r.prop) for r in predict(model.limit(0), examples).collect()} == {(-2,)}


def test_split_folds_and_bagging(spark):
    rows = [((i % 3,), (i % 2,)) for i in range(80)]
    c = context(spark, rows, 3)
    first, second = split(c, 8, 2, seed=3)
    assert first.rows.count() + second.rows.count() == 80 and 45 < first.rows.count() < 80
    assert parse_ratio("8:2") == (8, 2)
    folds = fold_samples(c.rows, 4, seed=1)
    assert {r.fold: r["count"] for r in folds.groupBy("fold").count().collect()} == dict.fromkeys(range(4), 20)
    separable = context(spark, [((0, 2), (0,)), ((1, 2), (1,))] * 20, 3)
    got = bagged_predict(separable, separable, folds=4).collect()
    assert len(got) == 40 and all(r.prop == [0 if 0 in r.intent else 1] for r in got)


def test_reordering_is_neutral(spark):
    rng = random.Random(6)
    rows = [(tuple(x for x in range(8) if rng.random() < 0.5), (rng.randrange(2),)) for _ in range(20)]
    c = context(spark, rows, 8)
    moved, mapping = reorder_by_support(c)
    back = {r.new_id: r.attr_id for r in mapping.collect()}
    a = {frozenset(r.intent) for r in mining.generate(c).collect()}
    assert a == {frozenset(back[x] for x in r.intent) for r in mining.generate(moved).collect()}
    held = [sum(x in r for r, _ in rows) for x in range(8)]
    assert [back[k] for k in range(8)] == sorted(range(8), key=lambda x: (held[x], x))
    assert abs(density(c).head().density - 100 * sum(len(r) for r, _ in rows) / 160) < 1e-9


def test_set_functions(spark):
    df = spark.createDataFrame([([0, 3, 64, 69], [3, 69])], "a array<int>, b array<int>")
    a, b = F.col("a"), F.col("b")
    r = df.select(
        intents.from_words(intents.to_words(a, 70), 70).alias("round"), intents.intersect(a, b).alias("met"), intents.until(a, 64).alias("upto"), intents.subset(b, a).alias("sub"), intents.words_size(intents.to_words(a, 70)).alias("n"),
        intents.words_subset(intents.to_words(b, 70), intents.to_words(a, 70)).alias("wsub"), intents.equal_until(a, b, 0).alias("eq"), intents.equal_within(a, b, F.array(F.lit(69))).alias("within"), intents.add(b, F.lit(5)).alias("added"),
    ).head()
    assert (r["round"], r.met, r.upto, r["sub"], r.n, r.wsub, r.eq, r.within, r.added) == ([0, 3, 64, 69], [3, 69], [0, 3], True, 4, True, True, True, [3, 5, 69])


def test_reordering_by_a_table_equals_the_broadcast_row(spark):
    """Numbers that are joined: rows without attributes, repeated rows, attributes that no row has, further columns."""
    rng = random.Random(9)
    rows = [({a for a in range(12) if a != 5 and rng.random() < 0.3}, (rng.randrange(2),)) for _ in range(40)] + [(set(), (0,)), ({1}, (1,)), ({1}, (1,))]
    c = context(spark, rows, 12)
    c = c.with_rows(c.rows.withColumn("fold", F.col("row_id") % 3))
    (want, order), (got, table) = reorder_by_support(c), reorder_by_support(c, broadcast_attrs=0)
    assert sorted(tuple(r) for r in table.collect()) == sorted(tuple(r) for r in order.collect())
    assert got.rows.columns == c.rows.columns and got.rows.orderBy("row_id").collect() == want.rows.orderBy("row_id").select(got.rows.columns).collect()
