import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeforge.cli import main
from latticeforge.functions.labels import LabelError
from latticeforge.operators import mining, scaling
from latticeforge.operators.context import require_same_header
from latticeforge.sources import tables, transactions


def halves(values, weights):
    """The bisection rule, written plainly and recursively."""
    if len(values) <= 2:
        return [(values[0] + values[-1]) / 2]
    first, step = values[0], (values[-1] - values[0]) / 25
    options = []
    for i in range(25):
        cut = first + i * step
        left = sum(w for v, w in zip(values, weights) if v < cut)
        options.append(-(float(left) * float(sum(weights) - left)))
    i = options.index(min(options))
    if options[i] == 0:
        return [(values[0] + values[-1]) / 2]
    cut = first + i * step
    k = sum(v < cut for v in values)
    left = halves(values[:k], weights[:k]) if k >= 10 else []
    return left + [cut] + (halves(values[k:], weights[k:]) if len(values) - k >= 10 else [])


@pytest.mark.parametrize("seed", range(6))
def test_bisection(seed):
    rng = random.Random(seed)
    values = sorted({round(rng.gauss(0, 10), 2) for _ in range(rng.choice([1, 2, 11, 60, 200]))})
    weights = [rng.choice([1, 1, 2, 50]) for _ in values]
    assert scaling.bisect(np.asarray(values), np.asarray(weights)) == halves(values, weights)


def test_large_segments_are_cut_first(spark):
    rng = random.Random(1)
    rows = [(0, float(v), rng.randrange(1, 9)) for v in sorted({rng.randrange(5000) for _ in range(300)})]
    df = spark.createDataFrame(rows, "col_idx int, v double, n long")
    want = halves([r[1] for r in rows], [r[2] for r in rows])
    assert scaling.numeric_thresholds(df)[0] == want
    assert scaling.numeric_thresholds(df, task_values=40)[0] == want
    assert scaling.numeric_thresholds(df.limit(0)) == {}


def test_numeric_ids(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 2.0, 9.0)], "v double")
    got = [r.i for r in df.select(scaling.numeric_ids(F.col("v"), [1.0, 2.0], 7).alias("i")).collect()]
    assert got == [[7], [7], [7, 8], [8], [8, 9]]
    for n in (1, 7, 8, 33):  # the binary search against a plain count
        cuts = [float(k * k) for k in range(n)]
        values = [-1.0, *cuts, *(c + 0.5 for c in cuts), float("inf")]
        rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", scaling.numeric_ids(F.col("v"), cuts, 3).alias("i")).collect()
        below = {v: sum(c < v for c in cuts) for v in values}
        assert {r.v: r.i for r in rows} == {v: [3 + b] if v in cuts or b == 0 else [2 + b, 3 + b] for v, b in below.items()}


def test_encoding_kinds(spark):
    rows = [(i, str(i % 10), str(i), "x" if i % 2 else "y", None) for i in range(30)]
    df = spark.createDataFrame(rows, "row_id long, ten string, many string, lab string, nothing string")
    c = scaling.encode(df, ["lab"])
    assert c.labels.descriptor() == "B(x,y)"
    first = c.rows.orderBy("row_id").head()
    assert first.prop == [1] and first.intent[0] == 0 and first.intent[-1] == c.n_attrs - 1
    coders, _ = scaling.fit_columns(df, ["ten", "many", "nothing"])
    assert [type(x).__name__ for x in coders] == ["NominalColumn", "NumericColumn", "NominalColumn"]
    assert coders[0].values == tuple(sorted(str(i) for i in range(10)))


def test_large_dictionaries_are_joined(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"v{i % 7}", "l") for i in range(20)], "row_id long, a string, lab string")
    want = scaling.encode(df, ["lab"]).rows.orderBy("row_id").collect()
    monkeypatch.setattr(scaling, "LITERAL_VALUES", 3)
    assert scaling.encode(df, ["lab"]).rows.orderBy("row_id").collect() == want
    monkeypatch.setattr(scaling, "TASK_VALUES", 2)
    assert scaling.encode(df, ["lab"]).rows.orderBy("row_id").collect() == want


def test_small_dictionaries_are_sent_not_shuffled(spark, monkeypatch):
    """Rows are not dealt out by a column of few texts, whatever Spark thinks of the dictionary's size."""
    rows = [(i, str(i % 40 / 4), f"n{i % 3}", str(i * 37 % 200), "l") for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, a string, b string, c string, lab string")
    plan = lambda c: c.rows._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = scaling.encode(df, ["lab"])
        assert plan(sent).count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan(sent)
        want = sent.rows.orderBy("row_id").collect()
        assert all(list(r.intent) == sorted(set(r.intent)) for r in want)
        monkeypatch.setattr(scaling, "BROADCAST_TEXTS", 50)
        mixed = scaling.encode(df, ["lab"])
        assert plan(mixed).count("BroadcastHashJoin") == 1 and plan(mixed).count("SortMergeJoin") == 1
        assert mixed.rows.orderBy("row_id").collect() == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ranks_over_ranges(spark):
    values = spark.createDataFrame([(i % 3, f"{i * 7919 % 1009:x}") for i in range(600)], "col_idx int, value string").distinct()
    want = sorted(tuple(r) for r in scaling.nominal_dictionary(values).collect())
    assert sorted(tuple(r) for r in scaling.nominal_dictionary(values, ranges=True).collect()) == want
    assert scaling.nominal_dictionary(values.limit(0), ranges=True).count() == 0


def test_line_parser(spark):
    lines = spark.createDataFrame([("0 1 2 6 7 8 | 5",), (" | a b",), ("3 1 1|x",), ("1 2",)], "value string")
    ids, label = transactions.parse_line(F.col("value"))
    got = [(r.i, r.l) for r in lines.select(ids.alias("i"), label.alias("l")).collect()]
    assert got == [([0, 1, 2, 6, 7, 8], "5"), ([], "a b"), ([1, 3], "x"), (None, "")]


def test_round_trip_and_errors(spark, tmp_path):
    path = str(tmp_path / "c")
    df = spark.createDataFrame([(0, "p", "x", "1"), (1, "q", "y", "2"), (2, "q", "z", "2")], "row_id long, a string, l string, m string")
    c = scaling.encode(df, ["l", "m"])
    transactions.write(c, path)
    back = transactions.read(spark, path)
    assert back.header == c.header == "# attributes: 2 properties: O(x,y,z)B(1,2)"
    assert sorted(r.value for r in transactions.lines(back).collect()) == ["0 | x 1", "1 | y 2", "1 | z 2"]
    (tmp_path / "bad.txt").write_text("# attributes: 2 properties: B(a,b)\n0 5 | a\n")
    with pytest.raises(Exception, match="malformed"):
        transactions.read(spark, str(tmp_path / "bad.txt")).rows.collect()
    (tmp_path / "label.txt").write_text("# attributes: 2 properties: B(a,b)\n0 | q\n")
    with pytest.raises(Exception, match="domain"):
        transactions.read(spark, str(tmp_path / "label.txt")).rows.collect()
    with pytest.raises(LabelError):
        transactions.write(scaling.encode(df.withColumn("l", F.lit("a,b")), ["l"]), str(tmp_path / "no"))


def test_command_line(spark, tmp_path, capsys):
    rng = random.Random(2)
    table = [["good" if a == "s" else "bad", a, rng.choice("uv"), '"q,1"'] for a in (rng.choice("st") for _ in range(60))]
    (tmp_path / "in.csv").write_text("\n".join(",".join(r) for r in table) + "\n\n")
    at = lambda name: str(tmp_path / name)
    assert tables.read_csv(spark, at("in.csv")).count() == 60
    main(["encode", at("in.csv"), at("all"), "-p", "0"])
    main(["split", "8:2", at("all"), at("train"), at("test")])
    main(["tau", at("test"), at("tau")])
    main(["generate", "-m", at("model"), at("train")])
    main(["predict", "-m", at("model"), "-o", at("out"), at("tau")])
    main(["jsm", "-o", at("out2"), at("train"), at("tau")])
    capsys.readouterr()
    main(["stats", at("test"), at("out")])
    said = capsys.readouterr().out
    main(["stats", at("test"), at("out2")])
    assert "correct" in said and "(100.00 %)" in said.splitlines()[0] and said == capsys.readouterr().out


@pytest.mark.parametrize("edges", [[float("inf")], [float("-inf")], [float("-inf"), float("inf")], []])
def test_infinite_values_end(spark, edges):
    """Distributed cuts and the bisection in a task agree, and end, whatever the ends of a column are."""
    numbers = sorted([float(v * v % 997) + v for v in range(60)] + edges)
    rows = [(0, v, 1 + k % 3) for k, v in enumerate(numbers)]
    df = spark.createDataFrame(rows, "col_idx int, v double, n long")
    want = scaling.numeric_thresholds(df)[0]
    assert want == sorted(scaling.bisect(np.asarray(numbers), np.asarray([r[2] for r in rows])), key=lambda t: (np.isnan(t), t)) or np.isnan(want).any()
    got = scaling.numeric_thresholds(df, task_values=20)[0]
    assert np.array_equal(got, want, equal_nan=True)
    if edges == [float("inf")]:  # the finite rest is cut as if it stood alone
        assert want == [*halves(numbers[:-1], [r[2] for r in rows[:-1]]), float("inf")]


def test_csv_cells_with_line_feeds_and_ragged_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,"x\ny",p\nb,z,q,"ex,""tra"\n\nc\n,,\n')
    rows = [tuple(r)[1:] for r in tables.read_csv(spark, str(tmp_path / "a.csv")).orderBy("row_id").collect()]
    assert rows == [("a", "x\ny", "p", ""), ("b", "z", "q", 'ex,"tra'), ("c", "", "", ""), ("", "", "", "")]
    assert tables.read_csv(spark, str(tmp_path / "a.csv")).orderBy("row_id").head().row_id == 0
    (tmp_path / "one.csv").write_text('u\n\n""\nv\n')
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "one.csv")).orderBy("row_id").collect()] == [(0, "u"), (1, "v")]


def test_rows_are_numbered_in_file_order(spark, tmp_path, capsys):
    """Parts of unequal size: Spark reads larger files first, the rows keep the order of the files all the same."""
    head = "# attributes: 3 properties: B(a,b)\n"

    def folder(name, cuts):
        (tmp_path / name).mkdir()
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            body = "".join(f"{i % 3} | {'ab'[i % 7 < 3]}\n" for i in range(a, b))
            (tmp_path / name / f"part-{k:05}-x.txt").write_text((head if k == 0 else "") + body)
        return str(tmp_path / name)

    one, other = folder("one", [0, 1, 201, 201, 230]), folder("other", [0, 150, 151, 160, 230])
    rows = transactions.read(spark, one).rows.orderBy("row_id").collect()
    assert [(r.row_id, r.intent, r.prop) for r in rows] == [(i, [i % 3], [int(i % 7 < 3)]) for i in range(230)]
    main(["stats", one, other])
    assert capsys.readouterr().out.startswith("correct: 230 / 230")
    main(["tau", one, str(tmp_path / "tau")])
    kept = transactions.read(spark, str(tmp_path / "tau")).rows.orderBy("row_id").collect()
    assert [r.intent for r in kept] == [[i % 3] for i in range(230)]


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from latticeforge import storage

    conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    assert storage.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[4]"))) == storage.LOCAL_FALLBACK
    assert storage.shared_dir(spark).startswith("file:/")


@pytest.mark.parametrize("split_bytes", [None, 150, 1000])
def test_csv_in_splits_equals_the_library(spark, tmp_path, split_bytes):
    """Cells with quotes, separators and line feeds, in several files, however the files are split."""
    import csv
    import io

    rng = random.Random(3)
    cells = ["a", "", "x,y", "l\nm", 'q"r', '""', "\n\n", " ", 'é\nü"', ",", "\r\n"]
    want = []
    for name in ("part-2.csv", "part-10.csv", "part-30.csv"):
        rows = [[rng.choice(cells) for _ in range(rng.randint(1, 4))] for _ in range(60)]
        out = io.StringIO()
        csv.writer(out, lineterminator="\r\n" if name == "part-10.csv" else "\n").writerows(rows)
        (tmp_path / name).write_bytes(out.getvalue().encode())
        want += [tuple(r + [""] * (4 - len(r))) for r in rows if r != [""]]
    keys = {"spark.sql.files.maxPartitionBytes": split_bytes, "spark.sql.files.openCostInBytes": 0}
    try:
        for key, value in keys.items() if split_bytes else ():
            spark.conf.set(key, str(value))
        got = [tuple(r) for r in tables.read_csv(spark, str(tmp_path)).orderBy("row_id").collect()]
    finally:
        for key in keys:
            spark.conf.unset(key)
    assert got == [(k, *r) for k, r in enumerate(want)]


def test_csv_lines_are_not_shuffled(spark, tmp_path):
    """Only pieces of records that lie over several splits are dealt out; the other records stand in the file's order of their splits."""
    (tmp_path / "a.csv").write_text("".join(f'{k},"l{k}\n{k}"\n' for k in range(400)))
    keys = {"spark.sql.files.maxPartitionBytes": 1000, "spark.sql.files.openCostInBytes": 0}
    try:
        for key, value in keys.items():
            spark.conf.set(key, str(value))
        found = tables.records(spark, str(tmp_path))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and plan.count("Aggregate") == 1 and "fields" in found.columns
        assert sorted(tuple(r) for r in found.collect()) == [(k, f'{k},"l{k}\n{k}"', 2) for k in range(400)]
    finally:
        for key in keys:
            spark.conf.unset(key)


def test_csv_blank_lines_open_records_and_empty_files(spark, tmp_path):
    read = lambda name: [tuple(r)[1:] for r in tables.read_csv(spark, str(tmp_path / name)).orderBy("row_id").collect()]
    (tmp_path / "blank.csv").write_text('a,b\n   \nc,d\n\n""\n5" pipe,x\n')
    assert read("blank.csv") == [("a", "b"), ("   ", ""), ("c", "d"), ('5" pipe', "x")]
    (tmp_path / "open.csv").write_text('a\n"b\nc,d\n')
    assert read("open.csv")[0] == ("a",) and len(read("open.csv")) == 2
    (tmp_path / "empty.csv").write_text("")
    assert read("empty.csv") == [] and tables.read_csv(spark, str(tmp_path / "empty.csv")).columns == ["row_id", "_c0"]


def test_command_line_reads_standard_input_and_goes_on(spark, tmp_path, capsys, monkeypatch):
    import io
    import sys
    from types import SimpleNamespace

    from latticeforge.storage import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    text = "".join(f"{'yes' if k % 3 else 'no'},a{k % 3},b{k % 2}\n" for k in range(30))
    monkeypatch.setattr(sys, "stdin", SimpleNamespace(buffer=io.BytesIO(text.encode())))
    main(["encode", "-", str(tmp_path / "all"), "-p", "0"])
    capsys.readouterr()
    outs = []
    for _ in range(2):
        main(["generate", "--journal", (tmp_path / "journal").as_uri(), "--counters", str(tmp_path / "all")])
        outs.append(sorted(capsys.readouterr().out.splitlines()))
    assert outs[0] == outs[1] and len(outs[0]) > 1 and os.path.exists(tmp_path / "journal" / "rows" / "_SUCCESS")
    assert (set(os.listdir(folder)) if os.path.isdir(folder) else set()) == before  # no scratch table is left


@pytest.mark.parametrize("task_values", [10**6, 30])
def test_intervals_from_tables_equal_plain_counts(spark, task_values):
    """Merged by ranges, every text gets the interval that counting thresholds gives; equal doubles may be several texts."""
    rng = random.Random(task_values)
    texts = {c: sorted({str(rng.randrange(-400, 400) / 4) for _ in range(300)} | {"1", "1.0", "1e0", "-0.0"}) for c in (0, 3)}
    values = spark.createDataFrame([(c, t, 1 + i % 4) for c, ts in texts.items() for i, t in enumerate(ts)], "col_idx int, value string, cnt long")
    table = scaling.threshold_table(scaling.numeric_histogram(values), task_values=task_values)
    assert "createDataFrame" not in table._jdf.queryExecution().toString() and "LocalTableScan" not in table._jdf.queryExecution().toString()
    cuts = {}
    for r in table.orderBy("col_idx", "place").collect():
        assert r.place == len(cuts.setdefault(r.col_idx, []))
        cuts[r.col_idx].append(r.threshold)
    for c, ts in texts.items():
        held = {}
        for i, t in enumerate(ts):
            held[float(t)] = held.get(float(t), 0) + 1 + i % 4
        assert cuts[c] == halves(sorted(held), [held[v] for v in sorted(held)])
    got = {(r.col_idx, r.value): (r["rank"], r.both) for r in scaling.interval_dictionary(values, table).collect()}
    want = {}
    for c, ts in texts.items():
        for t in ts:
            below = sum(x < float(t) for x in cuts[c])
            want[c, t] = (below, below > 0 and float(t) not in cuts[c])
    assert got == want
    assert scaling.interval_dictionary(values.limit(0), table.limit(0)).count() == 0


def test_label_tables_do_what_held_domains_do(spark, tmp_path):
    rows = [(i, f"v{i % 3}", ("?", "*", "", *(f"l{k}" for k in range(40)))[i * 7 % 43], "xy"[i % 2]) for i in range(129)]
    df = spark.createDataFrame(rows, "row_id long, a string, l string, m string")
    df = df.withColumn("l", F.when(F.col("l") == "", F.lit("l3")).otherwise(F.col("l")))
    held, large = scaling.encode(df, ["l", "m"]), scaling.encode(df, ["l", "m"], held_labels=5)
    assert [d.table is None for d in held.labels.domains] == [True, True] and [d.table is None for d in large.labels.domains] == [False, True]
    assert large.labels.domains[0].size == 40 and large.header_row().head().value == held.header == held.header_row().head().value
    assert held.rows.orderBy("row_id").collect() == large.rows.orderBy("row_id").collect()
    text = lambda c: sorted(r.value for r in transactions.lines(c).collect())
    assert text(held) == text(large) and {r.split(" | ")[1].split(" ")[0] for r in text(large)} >= {"?", "*", "l3"}
    path = str(tmp_path / "c")
    transactions.write(large, path, ordered=True)
    back = transactions.read(spark, path, header_chars=20, held=5)
    assert back.labels.domains[0].table is not None and back.labels.domains[1].binary and text(back) == text(held)
    assert [r.prop for r in back.rows.orderBy("row_id").collect()] == [r.prop for r in held.rows.orderBy("row_id").collect()]
    require_same_header(back, large)
    with pytest.raises(LabelError, match="incompatible"):
        require_same_header(large, scaling.encode(df.withColumn("l", F.regexp_replace("l", "^l", "k")), ["l", "m"], held_labels=5))
    for held_model in (mining.generate(c, strategy="votingMajority") for c in (held,)):
        want = sorted(tuple(r) for r in mining.model_text(held_model, held).collect())
    assert sorted(tuple(r) for r in mining.model_text(mining.generate(large, strategy="votingMajority"), large).collect()) == want
    with open(tmp_path / "unknown.txt", "w") as out:
        out.write("# attributes: 1 properties: O(" + ",".join(f"l{k}" for k in range(40)) + ")\n0 | l99\n")
    with pytest.raises(Exception, match="domain"):
        transactions.read(spark, str(tmp_path / "unknown.txt"), header_chars=20, held=5).rows.collect()
    with open(tmp_path / "bad.txt", "w") as out:
        out.write("# attributes: 1 properties: B(" + ",".join(f"l{k}" for k in range(40)) + ")\n0 | l9\n")
    with pytest.raises(LabelError, match="two values"):
        transactions.read(spark, str(tmp_path / "bad.txt"), header_chars=20, held=5)
    with pytest.raises(LabelError, match="cannot hold"):
        transactions.write(scaling.encode(df.withColumn("l", F.concat("l", F.lit(",z"))), ["l"], held_labels=5), str(tmp_path / "no"))
