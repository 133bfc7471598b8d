"""The three searches: concepts and counters against brute force, subtrees handed back, label maps, and runs that go on."""

import os
import random

import pytest
from pyspark.sql import functions as F

from latticeforge.functions.labels import LabelSchema
from latticeforge.operators import context as context_module
from latticeforge.operators import mining, prediction
from latticeforge.operators.bagging import bagged_predict
from latticeforge.operators.context import compress
from latticeforge.operators.prediction import predict
from latticeforge.storage import Journal, scratch, stored
from test_mining import BINARY, closed_sets, context, majority


def brute_counters(rows, n, min_support, search):
    """(closures, failures, pruned) by plain recursion over rows."""
    count = {"closures": 0, "failures": 0, "pruned": 0}
    found = []

    def close(extent, a):
        own = [r for r in extent if a in r]
        return own, frozenset.intersection(*own) if own else frozenset(range(n))

    def visit(extent, intent, seen, failed):
        found.append(intent)
        branch = [a for a in range(n) if a not in intent and a not in seen]
        if search == mining.SUPPORT_ORDER:
            branch.sort(key=lambda a: (sum(a in r for r in extent), a))
        inner, visited, passed = [], set(seen), dict(failed)
        for a in branch:
            below = set(range(a)) if search != mining.SUPPORT_ORDER else visited
            if search == mining.FAILURES and a in failed and not {x for x in failed[a] if x < a} <= intent:
                count["pruned"] += 1
                continue
            count["closures"] += 1
            own, closed = close(extent, a)
            if len(own) >= min_support:
                if closed & below == intent & below:
                    visited.add(a)
                    inner.append((own, closed, set(visited) if search == mining.SUPPORT_ORDER else set(range(a + 1))))
                else:
                    count["failures"] += 1
                    passed[a] = closed
            visited.add(a)
        for own, closed, after in inner:
            visit(own, closed, after, passed)

    sets = [frozenset(r) for r in rows]
    visit(sets, frozenset.intersection(*sets), set(), {})
    return found, tuple(count.values())


@pytest.mark.parametrize("algorithm", ["cbo", "pfcbo", "dynsort-cbo"])
@pytest.mark.parametrize("seed, n, small, task_rows, task_concepts", [(1, 9, 256, 50_000, 200_000), (2, 9, 0, 6, 200_000), (3, 70, 0, 0, 200_000), (4, 11, 256, 50_000, 3), (5, 66, 3, 8, 2)])
def test_counters_equal_brute_force(spark, monkeypatch, algorithm, seed, n, small, task_rows, task_concepts):
    monkeypatch.setattr(mining, "SMALL_ROWS", small)
    rng = random.Random(seed)
    pool = sorted(rng.sample(range(n), min(n, 8)))
    rows = [tuple(x for x in pool if rng.random() < 0.6) for _ in range(24)] + [tuple(pool[:3])] * 2
    search = mining.SEARCHES[algorithm]
    want, counts = brute_counters(rows, n, 2, search)
    c = context(spark, [(r, (k % 2,)) for k, r in enumerate(rows)], n)
    payload, histogram = context_module.payload_of(BINARY)
    found, levels = mining.search_concepts(compress(c, F.lit("").alias("group")), mining.Shape(n, tuple(payload), histogram), 2, search=search, task_rows=task_rows, task_concepts=task_concepts)
    words = mining.Shape(n, ()).columns("d")
    got = [frozenset(r.i) for r in found.select(mining.intents.from_words(words, n).alias("i")).collect()]
    assert sorted(map(sorted, got)) == sorted(map(sorted, want)) and len(set(got)) == len(got)
    sums = levels.agg(*(F.sum(x) for x in ("closures", "failures", "pruned"))).head()
    assert tuple(sums) == counts
    assert levels.agg(F.sum("concepts")).head()[0] + 1 == len(got)  # and the root


def test_inherited_failures_and_support_order_save_closures(spark):
    rng = random.Random(8)
    rows = [(tuple(x for x in range(12) if rng.random() < 0.5), (0,)) for _ in range(60)]
    c = context(spark, rows, 12)
    plain, failures, ordered = (mining.counters(c, algorithm=a).head() for a in ("cbo", "fcbo", "dynsort-cbo"))
    assert failures.closures < plain.closures and failures.failures < plain.failures and failures.pruned > 0 and ordered.failures < plain.failures


def test_a_subtree_beyond_the_budget_is_handed_back(spark):
    """Rows that lack one attribute each: every set of attributes is closed."""
    n = 11
    rows = [(tuple(x for x in range(n) if x != k), (0,)) for k in range(n)] * 2
    c = context(spark, rows, n)
    payload, histogram = context_module.payload_of(BINARY)
    for search in (mining.PLAIN, mining.FAILURES, mining.SUPPORT_ORDER):
        found, levels = mining.search_concepts(compress(c, F.lit("").alias("group")), mining.Shape(n, tuple(payload), histogram), 2, search=search, task_concepts=100)
        assert found.count() == found.select("d0").distinct().count() == 2**n - 1
        assert levels.count() > 2  # several turns


@pytest.mark.parametrize("strategy, descriptor", [("noCounterExamples", "O(x,y,z)"), ("votingMajority", "B(a,b)O(x,y,z)"), ("boundedVotingMajority:3", "B(a,b)"), ("boundedVotingMajority:3", "O(x,y,z)")])
def test_label_maps_equal_label_columns(spark, monkeypatch, strategy, descriptor):
    labels = LabelSchema.parse(descriptor)
    rng = random.Random(6)
    value = lambda d: rng.choice([-2, -1, *d.codes, *d.codes, *d.codes])
    rows = [(tuple(x for x in range(7) if rng.random() < 0.5), tuple(value(d) for d in labels.domains)) for _ in range(40)]
    c = context(spark, rows, 7, labels)

    def results():
        model = mining.generate(c, strategy=strategy)
        kept = spark.createDataFrame(model.collect() or [], model.schema)
        bare = spark.createDataFrame([([], list(rows[0][1]), 3)], model.schema)
        return [sorted(map(str, x.collect())) for x in (kept, predict(kept.union(bare), c, strategy=strategy))]

    dense = results()
    monkeypatch.setattr(context_module, "DENSE_CODES", 0)
    monkeypatch.setattr(mining, "SMALL_ROWS", 0)
    monkeypatch.setattr(mining, "TASK_CELLS", 7 * 4)
    assert results() == dense


def test_bagging_counts_labels_in_maps(spark, monkeypatch):
    rng = random.Random(3)
    c = context(spark, [(tuple(x for x in range(5) if rng.random() < 0.5), (rng.randrange(2),)) for _ in range(30)], 5)
    dense = sorted(map(str, bagged_predict(c, c, folds=2).collect()))
    monkeypatch.setattr(context_module, "DENSE_CODES", 0)
    assert sorted(map(str, bagged_predict(c, c, folds=2).collect())) == dense


def test_a_frequent_attribute_is_cut_into_cells(spark, monkeypatch):
    """Attribute 0 is in all examples and in most hypotheses, alone or with others that are as frequent."""
    for name, value in (("CELL_HYPOTHESES", 40), ("CELL_EXAMPLES", 50), ("PAIR_FROM", 8)):
        monkeypatch.setattr(prediction, name, value)
    rng, n = random.Random(2), 12
    examples = [((0, *(x for x in range(1, n) if rng.random() < 0.7)), (0,)) for _ in range(500)]
    hyps = [(sorted({0, *rng.sample(range(1, n), rng.randrange(0, 3))}), [rng.randrange(2)]) for _ in range(400)]
    model = spark.createDataFrame(hyps, "intent array<int>, prop array<int>")
    c = context(spark, examples, n)
    left, right, key = prediction.cells(model, prediction._distinct(c.rows, n, ()), n)
    sizes = [[r["count"] for r in side.groupBy(*key).count().collect()] for side in (left, right)]
    assert max(sizes[0]) <= 40 * 2 and max(sizes[1]) <= 50 * 2 and max(sizes[1]) <= 3 * sorted(sizes[1])[len(sizes[1]) // 2]
    got = {r.row_id: r.prop[0] for r in predict(model, c).collect()}
    for i, (r, _) in enumerate(examples):
        votes = [p for h, p in hyps if set(h) <= set(r)]
        assert got[i] == (majority([p[0] for p in votes]) if votes else -2)


def test_ten_thousand_label_values(spark):
    labels = LabelSchema.parse("O(" + ",".join(f"v{k:05}" for k in range(10_000)) + ")")
    rng = random.Random(7)
    rows = [(tuple(x for x in range(6) if rng.random() < 0.5), (rng.randrange(10_000) if k % 3 else rng.randrange(5),)) for k in range(3000)]
    got = {frozenset(r.intent): r.prop[0] for r in mining.generate(context(spark, rows, 6, labels), strategy="votingMajority").collect()}
    want = {}
    for intent, votes in closed_sets(rows, 2).items():
        codes = [p[0] for p in votes]
        times = {x: codes.count(x) for x in set(codes)}
        want[intent] = min(times, key=lambda x: (-times[x], x))
    assert got == want


class Stopped(RuntimeError):
    pass


def test_a_run_that_was_ended_goes_on(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(mining, "SMALL_ROWS", 0)
    monkeypatch.setattr(mining, "TASK_ROWS", 5)
    rng = random.Random(10)
    rows = [(tuple(x for x in range(8) if rng.random() < 0.6), (rng.randrange(2),)) for _ in range(30)]
    c = context(spark, rows, 8)
    want = sorted(map(str, mining.generate(c).collect()))
    journal, made = Journal(spark, tmp_path.as_uri()), []

    def failing(df, name):
        if len(made) == 3:
            raise Stopped(name)
        made.append(name)
        return journal.keep(df, name)

    with pytest.raises(Stopped):
        mining.generate(c, keep=failing)
    times = {name: os.stat(tmp_path / name / "_SUCCESS").st_mtime_ns for name in made}
    os.remove(tmp_path / made[-1] / "_SUCCESS")  # as if the run had ended within the table
    assert sorted(map(str, mining.generate(c, keep=journal.keep).collect())) == want
    again = {name: os.stat(tmp_path / name / "_SUCCESS").st_mtime_ns for name in made}
    assert all(again[name] == times[name] for name in made[:-1]) and again[made[-1]] != times[made[-1]]


def test_scratch_tables_go_after_success_and_after_errors(spark, tmp_path):
    def there():
        from latticeforge.storage import shared_dir

        folder = shared_dir(spark).removeprefix("file://")
        return set(os.listdir(folder)) if os.path.isdir(folder) else set()

    before = there()
    with scratch(spark):
        assert stored(spark.range(3), "kept").count() == 3 and len(there()) == len(before) + 1
    assert there() == before
    with pytest.raises(Stopped), scratch(spark):
        stored(spark.range(3), "kept")
        raise Stopped
    assert there() == before


def test_labels_of_large_domains_stay_rows(spark, monkeypatch):
    """No table of a search holds the labels of an extent in one cell, and merges agree with maps of the counts."""
    rng = random.Random(8)
    rows = [(k, sorted(a for a in range(6) if rng.random() < 0.6), rng.choice([-2, -1, 0, 0, 1, 2, 3])) for k in range(80)]
    labels = LabelSchema.parse("O(a,b,c,d)")
    df = spark.createDataFrame([(k, i, [p]) for k, i, p in rows], "row_id long, intent array<int>, prop array<int>")
    c = context_module.Context(df, 6, labels)
    want = {s: sorted(map(str, mining.generate(c, strategy=s).collect())) for s in ("votingMajority", "noCounterExamples", "boundedVotingMajority:20")}
    monkeypatch.setattr(context_module, "DENSE_CODES", 2)
    made = []
    for small in (256, 0):
        monkeypatch.setattr(mining, "SMALL_ROWS", small)
        for name, model in want.items():
            keep = lambda t, n: made.append((n, t.schema)) or stored(t, n)
            assert sorted(map(str, mining.generate(c, strategy=name, keep=keep).collect())) == model
    assert {n for n, _ in made} >= {"rows", "subtrees-1", "label-counts"}
    assert not [n for n, schema in made if any(f.dataType.typeName() == "map" or f.name in ("keys", "times") for f in schema)]
    for r in mining.concepts(c).collect():
        held = {}
        for _, i, p in rows:
            if set(r.intent) <= set(i):
                held[p + 2] = held.get(p + 2, 0) + 1
        assert r.label_counts == held and sum(held.values()) == r.n
