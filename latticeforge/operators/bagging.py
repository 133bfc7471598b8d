"""Bagging: models of several folds, mined in one job, that vote with whole labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import intents
from ..functions.labels import is_conflict
from ..storage import stored
from .context import Context
from .mining import mine_labelled
from .prediction import majority_of_predictions, predict
from .sampling import fold_samples
from .strategies import no_counter_examples

FOLDS = 8


def fold_models(context: Context, folded: DataFrame, *, min_support: int = 2) -> DataFrame:
    """(fold, intent, prop, support): the unanimous hypotheses of each fold's rows."""
    mined = mine_labelled(context.with_rows(folded), F.col("fold").cast("string"), min_support, summed=True)[0].withColumnRenamed("support", "n")
    words = [F.col(x) for x in intents.word_names(context.n_attrs, "d")]
    model = mined.select(F.col("group").cast("int").alias("fold"), intents.from_words(words, context.n_attrs).alias("intent"), no_counter_examples(context.labels, summed=True).alias("prop"), F.col("n").alias("support"))
    return model.where(~is_conflict(F.col("prop")))


def bagged_predict(train: Context, test: Context, *, folds: int = FOLDS, min_support: int = 2, seed: int = 0, folded: DataFrame | None = None) -> DataFrame:
    """(row_id, intent, prop): the vote of the fold models; `folded` gives the folds' rows (fold, row_id, intent, prop)."""
    models = stored(fold_models(train, folded if folded is not None else fold_samples(train.rows, folds, seed=seed), min_support=min_support), "models")
    return majority_of_predictions(predict(models, test, by=("fold",)), test.labels)
