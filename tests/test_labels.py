import itertools

import pytest
from pyspark.sql import functions as F

from latticeforge.functions.labels import CONFLICT, UNKNOWN, Domain, LabelError, LabelSchema, class_key, is_conflict, is_unknown, meet_labels


def expected(a, b):
    if a == UNKNOWN:
        return b
    if b == UNKNOWN:
        return a
    return a if a == b else CONFLICT


def test_meet_table(spark):
    codes = [UNKNOWN, CONFLICT, 0, 1, 2]
    pairs = [([a], [b]) for a, b in itertools.product(codes, codes)]
    for r in spark.createDataFrame(pairs, "a array<int>, b array<int>").select("a", "b", meet_labels(F.col("a"), F.col("b")).alias("m")).collect():
        assert r.m == [expected(r.a[0], r.b[0])]


def test_tests_of_composites(spark):
    rows = [([],), ([CONFLICT],), ([CONFLICT, 0],), ([UNKNOWN, UNKNOWN],), ([UNKNOWN, 1],)]
    got = spark.createDataFrame(rows, "p array<int>").select(is_conflict(F.col("p")).alias("c"), is_unknown(F.col("p")).alias("u"), class_key(F.col("p")).alias("k")).collect()
    assert [(r.c, r.u) for r in got] == [(True, False), (True, False), (False, False), (False, True), (False, False)]
    assert [r.k for r in got] == ["", "-1", "-1,0", "-2,-2", "-2,1"]


def test_binary_codec():
    d = Domain.of(["b", "a", "?", "*"])
    assert d.binary and d.values == ("a", "b")
    assert [d.encode(x) for x in "ab?*"] == [0, 1, UNKNOWN, CONFLICT]
    assert [d.decode(x) for x in (0, 1, UNKNOWN, CONFLICT)] == ["a", "b", "?", "*"]
    with pytest.raises(LabelError):
        d.encode("c")


def test_descriptor_round_trip():
    schema = LabelSchema.parse("B(a, b)O(z,x,y)")
    assert schema.descriptor() == "B(a,b)O(x,y,z)"
    assert schema.encode("b z") == [1, 2] and schema.decode([1, 2]) == "b z"
    for bad in ("B(a)", "X(a,b)", "O"):
        with pytest.raises(LabelError):
            LabelSchema.parse(bad)


def test_column_codec(spark):
    schema = LabelSchema.parse("B(a,b)O(x,y,z)")
    rows = spark.createDataFrame([("a", "z"), ("?", "*"), ("q", "x")], "u string, v string")
    got = rows.select(schema.encode_column([F.col("u"), F.col("v")]).alias("p")).select("p", schema.decode_column(F.col("p")).alias("t")).collect()
    assert [r.p for r in got] == [[0, 2], [UNKNOWN, CONFLICT], [None, 0]]
    assert [r.t for r in got][:2] == ["a z", "? *"]
