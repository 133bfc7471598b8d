"""Registered queries: one for each operator of the engine, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import intents
from ..functions.labels import LabelSchema, meet, meet_labels
from .. import cli
from ..operators import bagging as bagging_
from ..operators import context as ctx
from ..operators import evaluation, mining, prediction, sampling, scaling
from ..sources import tables, transactions
from ..storage import scratch_path, stored
from .contexts import BUYERS, CUSTOMER, EVENTS, GRADED, LINEITEM, ORDERS, PART, PRICES, Source

Query = Callable[[SparkSession, str], DataFrame]


def _rows_text(context: ctx.Context, rows: DataFrame | None = None) -> DataFrame:
    rows = context.rows if rows is None else rows
    return context.labels.with_text(rows).select("row_id", intents.text(F.col("intent")).alias("intent"), "label")


def _concepts(source: Source) -> Query:
    return lambda s, d: mining.concepts(source.context(s, d)).select(intents.text(F.col("intent")).alias("intent"), F.col("n").alias("support"))


def _hypotheses(source: Source, strategy: str, algorithm: str = "pfcbo") -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        context = source.context(s, d)
        return mining.model_text(mining.generate(context, strategy=strategy, algorithm=algorithm), context)

    return query


def value_distribution(s: SparkSession, d: str) -> DataFrame:
    return scaling.distribution(EVENTS.table(s, d), list(EVENTS.attributes))


def label_distribution(s: SparkSession, d: str) -> DataFrame:
    found = scaling.label_distribution(EVENTS.table(s, d), list(EVENTS.attributes), list(EVENTS.labels))
    return found.select("col_idx", "value", F.array_join("labels", "|").alias("labels"))


def column_kinds(s: SparkSession, d: str) -> DataFrame:
    table = s.read.parquet(f"{d}/lineitem.parquet")
    return scaling.column_kinds(scaling.distribution(table, ["l_quantity", "l_linenumber", "l_returnflag"]))


def attribute_dictionary(s: SparkSession, d: str) -> DataFrame:
    coders, dictionary = scaling.fit_columns(EVENTS.table(s, d), list(EVENTS.attributes))
    offsets = F.array(*(F.lit(c.offset) for c in coders))
    return dictionary.select("col_idx", "value", (F.col("rank") + F.element_at(offsets, F.col("col_idx") + 1)).alias("attr_id"))


def numeric_first_split(s: SparkSession, d: str) -> DataFrame:
    columns = (("lineitem", "l_quantity"), ("part", "p_size"), ("orders", "o_totalprice"))
    values = None
    for i, (table, column) in enumerate(columns):
        own = s.read.parquet(f"{d}/{table}.parquet").groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n")).select(F.lit(i).alias("col_idx"), "v", "n")
        values = own if values is None else values.unionByName(own)
    return scaling.first_split(values)


def numeric_thresholds(s: SparkSession, d: str) -> DataFrame:
    table = s.read.parquet(f"{d}/lineitem.parquet")
    return scaling.threshold_table(scaling.number_histogram(table, ["l_quantity", "l_extendedprice"]))


def numeric_scale(s: SparkSession, d: str) -> DataFrame:
    ids = scaling.numeric_ids(F.col("p_size").cast("double"), [10.0, 20.0, 40.0], 5)
    return s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("row_id"), intents.text(ids).alias("intent"))


def label_codes(s: SparkSession, d: str) -> DataFrame:
    """Every order's label by a domain that stays a table: its code, and its text from the code."""
    context = scaling.encode(BUYERS.table(s, d), ["l0"], attribute_columns=list(BUYERS.attributes), held_labels=0)
    return context.labels.with_text(context.rows).select("row_id", F.col("prop")[0].alias("code"), "label")


def label_table_file(s: SparkSession, d: str) -> DataFrame:
    """Writes a context whose label domain is a table as a file, reads its long header back and gives its lines."""
    path = scratch_path(s, "labels")
    transactions.write(scaling.encode(BUYERS.table(s, d), ["l0"], attribute_columns=list(BUYERS.attributes), held_labels=0), path)
    return transactions.lines(transactions.read(s, path, header_chars=40, held=0)).select(F.col("value").alias("line"))


def attribute_order(s: SparkSession, d: str) -> DataFrame:
    return ctx.reorder_by_support(EVENTS.context(s, d))[1]


def reordered_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows with attributes renumbered rarest first, by numbers that stay a table."""
    return _rows_text(ctx.reorder_by_support(EVENTS.context(s, d), broadcast_attrs=0)[0])


def root_concept(s: SparkSession, d: str) -> DataFrame:
    return mining.root_concept(EVENTS.context(s, d)).select(intents.text(F.col("intent")).alias("intent"), "support")


def closure_step(s: SparkSession, d: str) -> DataFrame:
    """The closure of every single attribute: children of the empty set, canonical or not."""
    context = EVENTS.context(s, d)
    shape = mining.Shape(context.n_attrs, ())
    zero = {x: F.lit(0).cast("long") for prefix in "bvp" for x in shape.words(prefix)}
    extents = ctx.compress(context, F.lit("").alias("group")).withColumns(zero)
    closed = mining.close_concepts(extents, shape)[1]
    return closed.select(F.col("a").alias("attr_id"), intents.text(intents.from_words(shape.columns("d"), context.n_attrs)).alias("intent"), "support")


def search_counters(s: SparkSession, d: str) -> DataFrame:
    """What each search closes, fails and rules out on the same context."""
    context = EVENTS.context(s, d)
    context = context.with_rows(stored(context.rows, "encoded"))
    found = [mining.counters(context, algorithm=a).select(F.lit(a).alias("algorithm"), "closures", "failures", "pruned") for a in ("cbo", "fcbo", "dynsort-cbo")]
    return reduce(DataFrame.unionByName, found)


def extent_weights(s: SparkSession, d: str) -> DataFrame:
    context = ORDERS.context(s, d)
    context = context.with_rows(stored(context.rows, "encoded"))
    found = stored(mining.concepts(context).select("intent"), "concepts")
    return mining.extent_weights(context, found).select(intents.text(F.col("intent")).alias("intent"), "attr_id", "weight")


def mask_labels(s: SparkSession, d: str) -> DataFrame:
    return _rows_text(ctx.mask_labels(GRADED.context(s, d)))


def _trained(s: SparkSession, d: str) -> tuple[ctx.Context, DataFrame]:
    context = EVENTS.context(s, d)
    rows = stored(context.rows, "encoded")
    train, test = context.with_rows(rows.where("row_id % 5 <> 0")), context.with_rows(rows.where("row_id % 5 = 0"))
    return test, prediction.predict(stored(mining.generate(train), "model"), ctx.mask_labels(test))


def predict(s: SparkSession, d: str) -> DataFrame:
    test, found = _trained(s, d)
    return _rows_text(test, found)


def predict_all_rows(s: SparkSession, d: str) -> DataFrame:
    """Each fifth of the rows by the model of the other four, so every row is predicted; all models are mined in one job."""
    context = EVENTS.context(s, d)
    context = context.with_rows(stored(context.rows, "encoded"))
    folded = context.rows.withColumn("fold", F.explode(F.array(*(F.lit(f) for f in range(5))))).where("fold <> row_id % 5")
    models = stored(bagging_.fold_models(context, folded), "models")
    masked = ctx.mask_labels(context)
    masked = masked.with_rows(masked.rows.withColumn("fold", (F.col("row_id") % 5).cast("int")))
    return _rows_text(context, prediction.predict(models, masked, by=("fold",)))


def evaluate(s: SparkSession, d: str) -> DataFrame:
    test, found = _trained(s, d)
    return evaluation.evaluate(test, test.with_rows(found))


def _files(s: SparkSession, d: str) -> tuple[str, str, str]:
    """Transaction files of the rows to learn from, the others and the others without labels."""
    context = EVENTS.context(s, d)
    rows = stored(context.rows, "encoded")
    train, test = context.with_rows(rows.where("row_id % 5 <> 0")), context.with_rows(rows.where("row_id % 5 = 0"))
    out = tuple(scratch_path(s, x) for x in ("train", "test", "tau"))
    for c, path in zip((train, test, ctx.mask_labels(test)), out):
        transactions.write(c, path, ordered=True)
    return out


def command_induce(s: SparkSession, d: str) -> DataFrame:
    """The command that mines and classifies in one run, on files: the lines it writes."""
    (train, _, tau), out = _files(s, d), scratch_path(s, "predictions")
    cli.main(["jsm", "-o", out, train, tau])
    return transactions.lines(transactions.read(s, out)).select(F.col("value").alias("line"))


def command_generate_predict(s: SparkSession, d: str) -> DataFrame:
    """The commands that mine a model file and classify with it, and the comparison of both files line by line."""
    (train, test, tau), model, out = _files(s, d), scratch_path(s, "model"), scratch_path(s, "predictions")
    cli.main(["generate", "-m", model, train])
    cli.main(["predict", "-m", model, "-o", out, tau])
    return evaluation.evaluate(transactions.read(s, test), transactions.read(s, out))


def command_encode(s: SparkSession, d: str) -> DataFrame:
    """The command that scales a CSV file: the lines it writes."""
    source, out = scratch_path(s, "csv"), scratch_path(s, "context")
    CUSTOMER.table(s, d).select("l0", "a0", "a1").write.csv(source)
    cli.main(["encode", source, out, "-p", "0"])
    return transactions.lines(transactions.read(s, out)).select(F.col("value").alias("line"))


def command_split(s: SparkSession, d: str) -> DataFrame:
    """The command that splits a file in two at random: the lines of both."""
    source, first, second = scratch_path(s, "context"), scratch_path(s, "first"), scratch_path(s, "second")
    transactions.write(EVENTS.context(s, d), source, ordered=True)
    cli.main(["split", "7:3", source, first, second, "--seed", "4"])
    parts = [transactions.lines(transactions.read(s, p)).select(F.lit(n).alias("part"), F.col("value").alias("line")) for n, p in (("first", first), ("second", second))]
    return parts[0].union(parts[1])


def command_mask(s: SparkSession, d: str) -> DataFrame:
    """The command that masks labels: the lines it writes."""
    source, out = scratch_path(s, "context"), scratch_path(s, "masked")
    transactions.write(GRADED.context(s, d), source)
    cli.main(["tau", source, out])
    return transactions.lines(transactions.read(s, out)).select(F.col("value").alias("line"))


def bagging(s: SparkSession, d: str) -> DataFrame:
    context = CUSTOMER.context(s, d)
    context = context.with_rows(stored(context.rows, "encoded"))
    folded = context.rows.withColumn("fold", (F.col("row_id") % 3).cast("int"))
    return _rows_text(context, bagging_.bagged_predict(context, context, folds=3, folded=folded)).select("row_id", "label")


def bagging_random(s: SparkSession, d: str) -> DataFrame:
    context = CUSTOMER.context(s, d)
    context = context.with_rows(stored(context.rows, "encoded"))
    return _rows_text(context, bagging_.bagged_predict(context, context, seed=3)).select("row_id", "label")


def split(s: SparkSession, d: str) -> DataFrame:
    first, second = sampling.split(EVENTS.context(s, d), 8, 2, seed=1)
    return first.rows.select(F.lit("first").alias("part"), "row_id").union(second.rows.select(F.lit("second"), "row_id"))


def hypothesis_sample(s: SparkSession, d: str) -> DataFrame:
    context = EVENTS.context(s, d)
    return mining.model_text(mining.generate(context, sampling=0.5, seed=5), context)


def label_algebra(s: SparkSession, d: str) -> DataFrame:
    a = s.range(25).select((F.col("id") % 5 - 2).cast("int").alias("a"), (F.floor(F.col("id") / 5) - 2).cast("int").alias("b"))
    return a.select("a", "b", meet(F.col("a"), F.col("b")).alias("met"))


def label_meets(s: SparkSession, d: str) -> DataFrame:
    """The component-wise meet of every order's label (its status, its priority's place) with the next order's; some are unknown."""
    context = ORDERS.context(s, d)
    unknown = F.when(F.col("row_id") % 3 == 0, -2).otherwise(F.col("prop")[0])
    rows = context.rows.select("row_id", F.array(unknown, F.get("intent", F.lit(0)) % 2).cast("array<int>").alias("label"))
    others = rows.select((F.col("row_id") - 1).alias("row_id"), F.col("label").alias("other"))
    met = meet_labels(F.col("label"), F.col("other"))
    return rows.join(others, "row_id").select("row_id", met[0].alias("status"), met[1].alias("place"))


def label_descriptor(s: SparkSession, d: str) -> DataFrame:
    """The components of a label descriptor, built from the table's labels, written and parsed again."""
    schema = LabelSchema.parse(GRADED.context(s, d).labels.descriptor())
    rows = [(i, "B" if x.binary else "O", "|".join(x.values)) for i, x in enumerate(schema.domains)]
    return s.createDataFrame(rows, "component int, kind string, labels string")


def prediction_file(s: SparkSession, d: str) -> DataFrame:
    """Writes predictions as a file, reads it back and gives its lines."""
    path = scratch_path(s, "predictions")
    test, found = _trained(s, d)
    transactions.write(test.with_rows(found), path, ordered=True)
    return transactions.lines(transactions.read(s, path)).select(F.col("value").alias("line"))


def csv_context(s: SparkSession, d: str) -> DataFrame:
    """Writes a table as CSV, reads and encodes it: the lines of its context."""
    path = scratch_path(s, "csv")
    CUSTOMER.table(s, d).select("l0", "a0", "a1").write.csv(path)
    return transactions.lines(scaling.encode(tables.read_csv(s, path), [0])).select(F.col("value").alias("line"))


def csv_cells(s: SparkSession, d: str) -> DataFrame:
    """Texts with quotes and line feeds through a CSV file that is read in splits."""
    path = scratch_path(s, "csv")
    rows = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string"), F.coalesce("lang", F.lit("")), F.coalesce("text", F.lit("")))
    rows.write.option("escape", '"').option("quoteAll", True).csv(path)
    back = tables.read_csv(s, path)
    return back.select(F.col("_c0").cast("long").alias("doc_id"), F.col("_c1").alias("lang"), F.md5(F.col("_c2").cast("binary")).alias("text_md5"))


def set_algebra(s: SparkSession, d: str) -> DataFrame:
    context = EVENTS.context(s, d)
    word = intents.to_words(F.col("intent"), context.n_attrs)[0]
    other = word.bitwiseXOR(word.bitwiseAND(F.lit(1023)) * 3).bitwiseAND(F.lit(1023))
    rows = context.rows.select("row_id", F.col("intent").alias("a"), intents.from_words([other], context.n_attrs).alias("b"))
    a, b, text = F.col("a"), F.col("b"), intents.text
    return rows.select(
        "row_id",
        text(F.array_sort(intents.intersect(a, b))).alias("met"),
        text(intents.until(a, 8)).alias("upto"),
        intents.equal_until(a, b, 8).alias("same_until"),
        intents.equal_within(a, b, F.sequence(F.lit(6), F.lit(9))).alias("same_within"),
        intents.subset(a, b).alias("inside"),
        F.size(a).alias("size"),
        intents.contains(a, 3).alias("holds"),
        text(intents.add(a, F.lit(3))).alias("added"),
    )


def transaction_file(s: SparkSession, d: str) -> DataFrame:
    """Writes a context as a transaction file, reads it back and gives its lines."""
    path = scratch_path(s, "transactions")
    transactions.write(CUSTOMER.context(s, d), path)
    return transactions.lines(transactions.read(s, path)).select(F.col("value").alias("line"))


def queries() -> dict[str, Query]:
    return {
        "value_distribution": value_distribution,
        "label_distribution": label_distribution,
        "column_kinds": column_kinds,
        "attribute_dictionary": attribute_dictionary,
        "encode_nominal": lambda s, d: _rows_text(EVENTS.context(s, d)),
        "numeric_first_split": numeric_first_split,
        "numeric_thresholds": numeric_thresholds,
        "numeric_scale": numeric_scale,
        "encode_numeric": lambda s, d: _rows_text(PRICES.context(s, d)),
        "label_codes": label_codes,
        "label_table_file": label_table_file,
        "density": lambda s, d: ctx.density(EVENTS.context(s, d)),
        "attribute_support": lambda s, d: ctx.attribute_support(EVENTS.context(s, d)),
        "attribute_order": attribute_order,
        "reordered_rows": reordered_rows,
        "root_concept": root_concept,
        "closure_step": closure_step,
        "search_counters": search_counters,
        "extent_weights": extent_weights,
        "concepts_customer": _concepts(CUSTOMER),
        "concepts_events": _concepts(EVENTS),
        "concepts_lineitem": _concepts(LINEITEM),
        "concepts_part": _concepts(PART),
        "classwise_concepts": _hypotheses(CUSTOMER, "noop"),
        "hyp_no_counter": _hypotheses(CUSTOMER, "noCounterExamples"),
        "hyp_no_counter_events": _hypotheses(EVENTS, "noCounterExamples", "cbo"),
        "hyp_no_counter_lineitem": _hypotheses(LINEITEM, "noCounterExamples", "dynsort-cbo"),
        "hyp_majority": _hypotheses(EVENTS, "votingMajority", "fcbo"),
        "hyp_bounded": _hypotheses(EVENTS, "boundedVotingMajority:3", "pcbo"),
        "hyp_ordinal_mode": _hypotheses(ORDERS, "votingMajority"),
        "hyp_ordinal_bounded": _hypotheses(ORDERS, "boundedVotingMajority:150"),
        "hyp_composite": _hypotheses(GRADED, "votingMajority"),
        "hyp_composite_bounded": _hypotheses(GRADED, "boundedVotingMajority:3", "fcbo"),
        "hyp_many_labels": _hypotheses(BUYERS, "votingMajority"),
        "mask_labels": mask_labels,
        "predict": predict,
        "predict_all_rows": predict_all_rows,
        "evaluate": evaluate,
        "bagging": bagging,
        "bagging_random": bagging_random,
        "split": split,
        "hypothesis_sample": hypothesis_sample,
        "label_algebra": label_algebra,
        "label_meets": label_meets,
        "label_descriptor": label_descriptor,
        "set_algebra": set_algebra,
        "transaction_file": transaction_file,
        "prediction_file": prediction_file,
        "command_encode": command_encode,
        "command_split": command_split,
        "command_induce": command_induce,
        "command_generate_predict": command_generate_predict,
        "command_mask": command_mask,
        "csv_context": csv_context,
        "csv_cells": csv_cells,
    }
