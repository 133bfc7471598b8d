from latticeforge.functions.labels import LabelSchema
from latticeforge.operators.context import Context
from latticeforge.streaming.scoring import score_stream


def test_batches_of_a_stream_are_scored(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, [0]), (2, [1]), (3, [0, 1]), (4, [])], "row_id long, intent array<int>").coalesce(1).write.parquet(source)
    model = spark.createDataFrame([([0], [0]), ([1], [1])], "intent array<int>, prop array<int>")
    context = Context(spark.createDataFrame([], "row_id long, intent array<int>, prop array<int>"), 2, LabelSchema.parse("B(a,b)"))
    found = {}
    stream = spark.readStream.schema("row_id long, intent array<int>").parquet(source)
    query = score_stream(model, stream, context, lambda rows, n: found.update({r.row_id: r.prop[0] for r in rows.collect()}), checkpoint=str(tmp_path / "state"), availableNow=True)
    query.awaitTermination(120)
    assert found == {1: 0, 2: 1, 3: -1, 4: -2}
