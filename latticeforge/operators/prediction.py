"""Classification by the hypotheses that an example contains.

An index decides which hypotheses an example is compared with.  A hypothesis is filed under its attribute that fewest examples hold;
under an attribute with many hypotheses they are filed under their two rarest attributes, and those without a second one form the
attribute's remainder.  Keys that many examples or many hypotheses share are cut into cells of bounded size on both sides, so no
task's work follows a frequent attribute.  The bitmap test is the residual.  Examples are compressed to distinct intents
first.  Hypotheses without attributes match everything; their votes are counted once for each model and added to those of every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import intents
from ..functions.labels import LabelSchema
from .context import HISTOGRAM, Context, count_names, label_counts, label_rows, payload_of
from .strategies import strategy as strategy_by_name

#: Hypotheses under one attribute beyond which a second attribute divides them.
PAIR_FROM = 64
#: Hypotheses and examples of one cell.
CELL_HYPOTHESES, CELL_EXAMPLES = 2_000, 20_000
#: Keys up to so many are sent to all tasks; more are joined.
BROADCAST_KEYS = 200_000
REST = -1


def rarest_two(hypotheses: DataFrame, examples: DataFrame, h: list[str]) -> DataFrame:
    """(h*, first, second): the two attributes of each distinct hypothesis that fewest examples hold; no second is REST."""
    held = examples.select(F.explode("intent").alias("a")).groupBy("a").agg(F.count("*").alias("k"))
    cells = hypotheses.select(*h, "intent").dropDuplicates(h).select(*h, F.explode("intent").alias("a")).join(held, "a", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("k", F.lit(0)).alias("k"), "a")))
    two = cells.groupBy(*h).agg(order.alias("order"))
    return two.select(*h, F.get("order", F.lit(0))["a"].alias("first"), F.coalesce(F.get("order", F.lit(1))["a"], F.lit(REST)).alias("second"))


def cells(model: DataFrame, examples: DataFrame, n_attrs: int, own: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, list[str]]:
    """(hypotheses, examples, key columns): both sides dealt to cells; every hypothesis inside an example shares just one cell with it.

    `own` are columns of both sides that must agree as well.
    """
    e, h = intents.word_names(n_attrs, "e"), intents.word_names(n_attrs, "h")
    words = [w.alias(x) for w, x in zip(intents.to_words(F.col("intent"), n_attrs), h)]
    hyps = model.where(F.size("intent") > 0).select("*", *words)
    hyps = hyps.join(rarest_two(hyps, examples, h), h)
    many = hyps.groupBy("first").agg(F.count("*").alias("k")).where(F.col("k") > PAIR_FROM).select("first", F.lit(True).alias("paired"))
    few = model.count() <= BROADCAST_KEYS  # there are no more keys than hypotheses
    many = F.broadcast(many) if few else many
    hyps = hyps.join(many, "first", "left").withColumn("second", F.when(F.col("paired"), F.col("second")).otherwise(F.lit(REST))).drop("paired", "intent")
    probes = examples.select(*own, *e, "intent", F.explode("intent").alias("first")).join(many, "first", "left")
    others = F.concat(F.array(F.lit(REST)), F.filter("intent", lambda a: a != F.col("first")))
    probes = probes.select(*own, *e, "first", F.explode(F.when(F.col("paired"), others).otherwise(F.array(F.lit(REST)))).alias("second"))
    key = [*own, "first", "second"]
    # Keys of both sides with their sizes; an example's pair that no hypothesis is filed under ends here.
    keys = hyps.groupBy(*key).agg(F.count("*").alias("n_h")).join(probes.groupBy(*key).agg(F.count("*").alias("n_e")), key)
    keys = keys.select(*key, F.ceil(F.col("n_h") / CELL_HYPOTHESES).cast("int").alias("parts_h"), F.ceil(F.col("n_e") / CELL_EXAMPLES).cast("int").alias("parts_e"))
    keys = F.broadcast(keys) if few else keys
    part = lambda names, n: F.pmod(F.xxhash64(*names), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    hyps = hyps.join(keys, key).withColumn("part_h", part([*h, F.to_json(F.struct("prop"))], "parts_h")).withColumn("part_e", upto("parts_e"))
    probes = probes.join(keys, key).withColumn("part_e", part(e, "parts_e")).withColumn("part_h", upto("parts_h"))
    return hyps.drop("parts_h", "parts_e"), probes.drop("parts_h", "parts_e"), [*key, "part_h", "part_e"]


def matches(model: DataFrame, examples: DataFrame, n_attrs: int, own: tuple[str, ...] = ()) -> DataFrame:
    """Every (example words e*, hypothesis) pair with the hypothesis, which has attributes, inside the example."""
    e, h = intents.word_names(n_attrs, "e"), intents.word_names(n_attrs, "h")
    hyps, probes, key = cells(model, examples, n_attrs, own)
    return probes.join(hyps, key).where(intents.words_subset([F.col(x) for x in h], [F.col(x) for x in e]))


def _distinct(rows: DataFrame, n_attrs: int, own: tuple[str, ...]) -> DataFrame:
    words = [w.alias(x) for w, x in zip(intents.to_words(F.col("intent"), n_attrs), intents.word_names(n_attrs, "e"))]
    return rows.select(*own, "intent", *words).dropDuplicates([*own, *intents.word_names(n_attrs, "e")])


def _votes(found: DataFrame, labels: LabelSchema, *keys: str) -> DataFrame:
    """(keys, n, counts of labels): in columns or, for large domains, in a map."""
    if not payload_of(labels)[1]:
        return found.groupBy(*keys).agg(F.count("*").alias("n"), *label_counts(labels, F.col("prop")))
    codes = label_rows(found, *keys).groupBy(*keys, "component", "key").agg(F.count("*").alias("k"))
    n = F.sum(F.when(F.col("component") == 0, F.col("k")))
    return codes.groupBy(*keys).agg(n.alias("n"), F.map_from_entries(F.collect_list(F.struct("key", "k"))).alias(HISTOGRAM))


def predict(model: DataFrame, context: Context, *, strategy: str = "votingMajority", by: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, intent, prop[, by]): each example with the merged label of its hypotheses, unknown if none match.

    model: (intent, prop[, by]).  The example's own label is not looked at.  Rows are predicted by every model (value of `by`),
    or, if they have the columns of `by` themselves, by their own one.
    """
    e, labels = intents.word_names(context.n_attrs, "e"), context.labels
    own = by if set(by) <= set(context.rows.columns) else ()
    examples = _distinct(context.rows, context.n_attrs, own)
    votes = _votes(matches(model.select("intent", "prop", *by), examples, context.n_attrs, own), labels, *by, *e)
    histogram = payload_of(labels)[1]
    counts = ["n"] if histogram else ["n", *count_names(labels)]
    always = _votes(model.where(F.size("intent") == 0).select("prop", *by), labels, *by)
    renamed = {c: f"all_{c}" for c in (*counts, *([HISTOGRAM] if histogram else []))}
    if by:
        always = model.select(*by).distinct().join(always, list(by), "left")  # models without bare hypotheses as well
    always = always.withColumnsRenamed(renamed)
    rows = context.rows.select("row_id", "intent", *own, *(w.alias(x) for w, x in zip(intents.to_words(F.col("intent"), context.n_attrs), e)))
    if own:
        rows = rows.join(always, list(own), "left")
    elif by:
        rows = rows.join(F.broadcast(always))  # every row by every model: one row for each model
    else:
        held = always.head()  # one row, or none
        zero = {a: F.lit(held[a] if held is not None else 0).cast("long") for c, a in renamed.items() if c != HISTOGRAM}
        rows = rows.withColumns(zero)
        if histogram:
            pairs = list((held[renamed[HISTOGRAM]] or {}).items()) if held is not None else []
            rows = rows.withColumn(renamed[HISTOGRAM], F.create_map(*(F.lit(x).cast("long") for p in pairs for x in p)).cast("map<bigint,bigint>"))
    sums = {c: F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"all_{c}"), F.lit(0)) for c in counts}
    if histogram:
        none = F.create_map().cast("map<bigint,bigint>")
        sums[HISTOGRAM] = F.map_zip_with(F.coalesce(HISTOGRAM, none), F.coalesce(renamed[HISTOGRAM], none), lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
    out = rows.join(votes, [*by, *e], "left").withColumns(sums)
    decided = F.when(F.col("n") > 0, strategy_by_name(strategy)(labels)).otherwise(labels.unknown())
    return out.select("row_id", "intent", decided.alias("prop"), *by)


def majority_of_predictions(predictions: DataFrame, labels: LabelSchema) -> DataFrame:
    """(row_id, intent, prop): the most frequent whole label over models; unknown and conflict vote too.

    Ties go to the smallest label.
    """
    votes = predictions.groupBy("row_id", "prop").agg(F.count("*").alias("k"), F.first("intent").alias("intent"))
    best = F.min_by(F.struct("prop", "intent"), F.struct(-F.col("k"), F.col("prop")))
    return votes.groupBy("row_id").agg(best.alias("b")).select("row_id", "b.intent", "b.prop")
