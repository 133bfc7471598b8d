"""Command line: encode, split, tau, generate, predict, jsm-style induce, stats."""

from __future__ import annotations

import argparse
import logging
import sys
import time
from contextlib import contextmanager

from pyspark.sql import SparkSession, functions as F

from .operators import context as ctx
from .operators import evaluation, mining, prediction, sampling, scaling
from .sources import tables, transactions
from .storage import Journal, copied, scratch, stored

log = logging.getLogger("latticeforge")


@contextmanager
def timed(name: str):
    began = time.time()
    yield
    log.info("%s took %.3f s", name, time.time() - began)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="latticeforge")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple, **options) -> argparse.ArgumentParser:
        p = commands.add_parser(name, **options)
        for names, settings in arguments:
            p.add_argument(*names, **settings)
        return p

    mining_options = (
        (("-a", "--algorithm"), {"default": "pfcbo", "choices": mining.ALGORITHMS}),
        (("--strategy",), {"default": "noCounterExamples"}),
        (("--support",), {"type": int, "default": 2}),
        (("--sampling",), {"type": float, "default": 1.0}),
        (("--seed",), {"type": int, "default": 0}),
        (("--data-structure",), {"default": "dense", "choices": mining.DATA_STRUCTURES}),
    )
    command("encode", (("-p", "--properties"), {"type": int, "nargs": "*", "default": [], "help": "0-based label columns"}), (("input",), {"help": "a CSV file or folder, or - for standard input"}), (("output",), {"nargs": "?"}), help="CSV to a context")
    command("split", (("ratio",), {}), (("input",), {}), (("first",), {}), (("second",), {}), (("--seed",), {"type": int, "default": 0}), help="a random split a:b")
    command("tau", (("input",), {}), (("output",), {}), help="mask labels")
    command("generate", *mining_options, (("-t", "--threads"), {"type": int, "help": "accepted; Spark's own settings decide"}), (("-m", "--model"), {}), (("--journal",), {"help": "a folder that keeps what is mined; a run that was ended goes on from there"}), (("--counters",), {"action": "store_true", "help": "log closures and failed tests"}), (("input",), {}), help="mine hypotheses")
    command("predict", (("-m", "--model"), {"required": True}), (("-o", "--output"), {"required": True}), (("--merge",), {"default": "votingMajority"}), (("tau",), {}), help="classify examples")
    command("jsm", *mining_options, (("--merge",), {"default": "votingMajority"}), (("-o", "--output"), {"required": True}), (("training",), {}), (("tau",), {}), help="mine and classify in one run")
    command("stats", (("validation",), {}), (("prediction",), {}), help="compare with the truth")
    return top


def _put(context: ctx.Context, path: str | None, *, ordered: bool = False) -> None:
    if path:
        transactions.write(context, path, ordered=ordered)
        return
    print(context.header_row().head().value)
    for row in (transactions.ordered_lines(context) if ordered else transactions.lines(context)).toLocalIterator():
        print(row.value)


def _numbered(context: ctx.Context, rows) -> ctx.Context:
    return context.with_rows(rows.withColumn("row_id", F.monotonically_increasing_id()))


def _generate(args, context: ctx.Context):
    keep = Journal(context.rows.sparkSession, args.journal).keep if args.journal else stored
    return mining.generate(context, keep=keep, strategy=args.strategy, min_support=args.support, algorithm=args.algorithm, data_structure=args.data_structure, sampling=args.sampling, seed=args.seed)


def induce_and_predict(train: ctx.Context, test: ctx.Context, *, merge: str = "votingMajority", **options):
    """Mines `train` and classifies `test`, without files in between."""
    ctx.require_same_header(train, test)
    return prediction.predict(mining.generate(train, split_classes=False, **options), test, strategy=merge)


def main(argv: list[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO, format="%(message)s", stream=sys.stderr)
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("latticeforge").getOrCreate()
    with timed(args.command), scratch(spark):
        if args.command == "encode":
            path = copied(spark, sys.stdin.buffer) if args.input == "-" else args.input
            _put(scaling.encode(tables.read_csv(spark, path), args.properties), args.output, ordered=True)
        elif args.command == "split":
            first, second = sampling.split(transactions.read(spark, args.input), *sampling.parse_ratio(args.ratio), seed=args.seed)
            _put(first, args.first, ordered=True)
            _put(second, args.second, ordered=True)
        elif args.command == "tau":
            _put(ctx.mask_labels(transactions.read(spark, args.input)), args.output, ordered=True)
        elif args.command == "generate":
            context = transactions.read(spark, args.input)
            if args.counters:
                log.info("%s", mining.counters(context, min_support=args.support, algorithm=args.algorithm).head().asDict())
            _put(_numbered(context, _generate(args, context).select("intent", "prop")), args.model)
        elif args.command == "predict":
            model, examples = transactions.read(spark, args.model), transactions.read(spark, args.tau)
            ctx.require_same_header(model, examples)
            found = prediction.predict(model.rows.select("intent", "prop"), examples, strategy=args.merge)
            _put(examples.with_rows(found), args.output, ordered=True)
        elif args.command == "jsm":
            train, examples = transactions.read(spark, args.training), transactions.read(spark, args.tau)
            options = {"strategy": args.strategy, "min_support": args.support, "algorithm": args.algorithm, "data_structure": args.data_structure, "sampling": args.sampling, "seed": args.seed}
            _put(examples.with_rows(induce_and_predict(train, examples, merge=args.merge, **options)), args.output, ordered=True)
        else:
            truth, found = transactions.read(spark, args.validation), transactions.read(spark, args.prediction)
            r = evaluation.evaluate(truth, found).head()  # both are numbered by line
            for name in ("correct", "unknown", "conflicts"):
                print(f"{name}: {r[name]} / {r['total']} ({r[name + '_pct']:.2f} %)")
    return 0


if __name__ == "__main__":
    sys.exit(main())
