"""Closed attribute sets with minimum support, by close-by-one over a distributed frontier.

A concept of the frontier is (group, b*): its attributes as words.  Two tables hold a level:
  * heads(group, b*, v*, p*, failed): the concepts; v* are attributes that its subtree does not branch on (any more), p* those
    that an inherited failure rules out;
  * extents(group, b*, v*, p*, w*, n, first_row, payload): every compressed row under every concept whose row contains it.
One level explodes each row at the attributes that are in none of b*, v* and p*, aggregates (intersection of rows, support, payload)
with map-side combining, keeps frequent canonical children, and joins rows to the children they belong to: only equi-joins on
concept and attribute, never a scan of all rows for each concept.  As soon as every extent fits a task, subtrees are finished in
memory: rows stream in by concept and concepts stream out in batches; a subtree beyond TASK_CONCEPTS hands what is left of it back
to the frontier, so neither memory nor the length of a task grows with the concepts under one root.

Three searches share this plan and give the same set of concepts:
  * plain (cbo, pcbo): attributes in their order, canonical if nothing new lies below the attribute;
  * failures (fcbo, pfcbo): an intent that failed the test at an attribute is inherited, and children that lack a part of it
    below the attribute do not close there again;
  * support order (dynsort-cbo): each concept branches on its attributes from the rarest in its extent to the most frequent (ties by
    id), and a child is canonical if nothing new lies in what was visited before.
Closures, failed tests and branches ruled out are counted from stored tables, so a task that runs again counts once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..functions import intents
from ..functions.labels import class_key, is_conflict
from ..shipping import ship_package
from ..storage import stored
from .context import Context, compress, compress_labels, merged_counts, payload_of, summed_counts
from .prediction import matches
from .sampling import chance
from .strategies import strategy as strategy_by_name

PLAIN, FAILURES, SUPPORT_ORDER = "plain", "failures", "support order"
SEARCHES = {"cbo": PLAIN, "pcbo": PLAIN, "fcbo": FAILURES, "pfcbo": FAILURES, "dynsort-cbo": SUPPORT_ORDER}
ALGORITHMS = tuple(SEARCHES)
DATA_STRUCTURES = ("dense", "sparse")
#: Compressed rows of one concept that a task finishes in memory.
TASK_ROWS = 50_000
#: And their cells, a byte each.
TASK_CELLS = 64_000_000
#: Concepts after which a task hands the rest of a subtree back, and concepts that it sends on at once.
TASK_CONCEPTS, BATCH = 200_000, 5_000
#: Below this many rows in a group a single task mines it from the root.
SMALL_ROWS = 256

Keep = Callable[[DataFrame, str], DataFrame]


class TooManyConcepts(RuntimeError):
    """More concepts than the caller allowed."""


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


@dataclass(frozen=True)
class Shape:
    """What the tables of a search hold: attributes and summed columns; `histogram` tells that labels are counted in rows beside it."""

    n_attrs: int
    payload: tuple[str, ...]
    histogram: bool = False

    def words(self, prefix: str) -> list[str]:
        return intents.word_names(self.n_attrs, prefix)

    def columns(self, prefix: str) -> list[Column]:
        return [F.col(x) for x in self.words(prefix)]

    def renamed(self, old: str, new: str) -> list[Column]:
        return [F.col(x).alias(y) for x, y in zip(self.words(old), self.words(new))]

    def bit(self, a: Column, k: int) -> Column:
        """The bit of attribute `a` in word k."""
        low = k * intents.WORD
        return F.when((a >= low) & (a < low + intents.WORD), F.call_function("shiftleft", F.lit(1).cast("long"), a - low)).otherwise(F.lit(0).cast("long"))

    def mask(self, k: int) -> Column:
        """The attributes that word k has."""
        return F.lit((1 << max(0, min(intents.WORD, self.n_attrs - k * intents.WORD))) - 1).cast("long")

    def free(self, source: list[Column]) -> list[Column]:
        """Attributes of `source` that the concept branches on."""
        out = []
        for k, x in enumerate(source):
            for prefix in "bvp":
                x = x.bitwiseAND(F.bitwise_not(self.columns(prefix)[k]))
            out.append(x)
        return out


def _aggregates(shape: Shape, prefix: str) -> list[Column]:
    words = [F.bit_and(w).alias(d) for w, d in zip(shape.words("w"), shape.words(prefix))]
    return [*words, F.sum("n").alias("support"), F.min("first_row").alias("first_row"), *(F.sum(p).alias(p) for p in shape.payload)]


def close_concepts(extents: DataFrame, shape: Shape) -> tuple[DataFrame, DataFrame]:
    """(extents exploded at each free attribute `a`, closures of concept and attribute: group, b*, v*, a, d*, support, ...)."""
    exploded = extents.withColumn("a", F.explode(intents.from_words(shape.free(shape.columns("w")), shape.n_attrs)))
    return exploded, exploded.groupBy("group", *shape.words("b"), *shape.words("v"), "a").agg(*_aggregates(shape, "d"))


def tested(closures: DataFrame, shape: Shape, search: str, min_support: int) -> DataFrame:
    """Frequent closures with `canonical`, and with e*, the attributes that their own subtrees do not branch on."""
    a, n_words = F.col("a"), range(len(shape.words("b")))
    if search == SUPPORT_ORDER:
        order = W.partitionBy("group", *shape.words("b")).orderBy("support", "a").rowsBetween(W.unboundedPreceding, -1)
        whole = W.partitionBy("group", *shape.words("b"))
        for k in n_words:
            own = shape.bit(a, k)
            # What no row of the extent holds comes first of all: it is visited before any other attribute.
            absent = shape.mask(k).bitwiseAND(F.bitwise_not(F.bit_or(own).over(whole).bitwiseOR(F.col(f"b{k}"))))
            before = F.coalesce(F.bit_or(own).over(order), F.lit(0).cast("long"))
            closures = closures.withColumn(f"s{k}", F.col(f"v{k}").bitwiseOR(before).bitwiseOR(absent))
        seen = shape.columns("s")
        after = [s.bitwiseOR(shape.bit(a, k)) for k, s in enumerate(seen)]
    else:
        seen = [intents.below(a, k) for k in n_words]
        after = [intents.below(a + 1, k) for k in n_words]
    same = _all([d.bitwiseAND(s) == b.bitwiseAND(s) for d, b, s in zip(shape.columns("d"), shape.columns("b"), seen)])
    out = closures.withColumns({"canonical": same, **dict(zip(shape.words("e"), after))})
    return out.where(F.col("support") >= min_support).select("group", *shape.words("b"), "a", *shape.words("d"), *shape.words("e"), "canonical", "support", "first_row", *shape.payload)


def _failed_type(shape: Shape) -> str:
    return f"array<struct<a:int,{','.join(f'{f}:bigint' for f in shape.words('f'))}>>"


def inherited(kids: DataFrame, heads: DataFrame, shape: Shape) -> DataFrame:
    """Heads of the canonical children: failures of their parents at later attributes, and those that rule a branch out."""
    b, d, f = (shape.words(x) for x in "bdf")
    old = heads.select("group", *b, F.explode("failed").alias("x")).select("group", *b, "x.a", *(f"x.{c}" for c in f), F.lit(0).alias("age"))
    new = kids.where(~F.col("canonical")).select("group", *b, "a", *shape.renamed("d", "f"), F.lit(1).alias("age"))
    latest = old.unionByName(new).groupBy("group", *b, "a").agg(F.max_by(F.struct(*f), "age").alias("x")).select("group", *b, F.col("a").alias("at"), *(f"x.{c}" for c in f))
    own = kids.where("canonical").select("group", *b, "a", *d, *shape.words("e"))
    met = own.select("group", *b, "a", *d).join(latest, ["group", *b]).where("at > a")
    lacks = reduce(lambda x, y: x | y, [fk.bitwiseAND(intents.below(F.col("at"), k)).bitwiseAND(F.bitwise_not(dk)) != 0 for k, (fk, dk) in enumerate(zip(shape.columns("f"), shape.columns("d")))])
    pruned = [F.bit_or(F.when(lacks, shape.bit(F.col("at"), k)).otherwise(F.lit(0).cast("long"))).alias(p) for k, p in enumerate(shape.words("p"))]
    passed = met.groupBy("group", *d).agg(F.collect_list(F.struct(F.col("at").alias("a"), *f)).alias("failed"), *pruned)
    none = {p: F.coalesce(F.col(p), F.lit(0).cast("long")) for p in shape.words("p")}
    return own.join(passed, ["group", *d], "left").withColumns(none).withColumn("failed", F.coalesce("failed", F.array().cast(_failed_type(shape))))


def _children(kids: DataFrame, heads: DataFrame, shape: Shape, search: str) -> DataFrame:
    """The next heads, still with their parents' words and the attribute that led to them."""
    if search == FAILURES:
        return inherited(kids, heads, shape)
    zero = {p: F.lit(0).cast("long") for p in shape.words("p")}
    return kids.where("canonical").select("group", *shape.words("b"), "a", *shape.words("d"), *shape.words("e")).withColumns(zero).withColumn("failed", F.array().cast(_failed_type(shape)))


class _Subtree:
    """Depth-first search under one concept, in memory."""

    def __init__(self, shape: Shape, search: str, min_support: int, budget: int) -> None:
        self.shape, self.search, self.min_support, self.budget = shape, search, min_support, budget

    def run(self, group: str, root: list[int], head: dict, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        shape, n = self.shape, self.shape.n_attrs
        bits = self._bits([rows[w].to_numpy() for w in shape.words("w")])
        self.weight, self.first = rows["n"].to_numpy(), rows["first_row"].to_numpy()
        self.sums = np.stack([rows[p].to_numpy() for p in shape.payload], axis=1) if shape.payload else np.zeros((len(bits), 0), np.int64)
        self.group, self.root, self.found, self.counters = group, root, [], [0, 0, 0]
        own, seen = self._one(root), self._one([head[v] for v in shape.words("v")])
        failed = {x["a"]: self._one([x[f] for f in shape.words("f")]) for x in head["failed"]}
        stack, produced = [(np.arange(len(bits)), own, seen, failed)], 0
        while stack and produced < self.budget:
            rows_, own, seen, failed = stack.pop()
            for sub, closed, after, support in self._below(bits, rows_, own, seen, failed, stack):
                self.found.append((sub, closed, support))
                produced += 1
            if len(self.found) >= BATCH:
                yield self._batch()
        yield self._batch([(own, seen, failed) for _, own, seen, failed in stack], last=True)

    def _below(self, bits: np.ndarray, rows: np.ndarray, own: np.ndarray, seen: np.ndarray, failed: dict, stack: list) -> list[tuple]:
        """Children of one concept; they are pushed onto the stack as well."""
        support = self.weight[rows] @ bits[rows]
        branch = np.flatnonzero(~own & ~seen)
        if self.search == SUPPORT_ORDER:
            branch = branch[np.lexsort((branch, support[branch]))]
        elif self.search == FAILURES and failed:
            ruled_out = [a for a in branch.tolist() if a in failed and (failed[a][:a] & ~own[:a]).any()]
            self.counters[2] += len(ruled_out)
            branch = branch[~np.isin(branch, ruled_out)]
        self.counters[0] += len(branch)
        out, passed = [], dict(failed) if self.search == FAILURES else failed
        if self.search == SUPPORT_ORDER:
            place = np.full(len(own), -1)
            place[branch] = np.arange(len(branch))
        for a in branch[support[branch] >= self.min_support].tolist():
            sub = rows[bits[rows, a]]
            closed = bits[sub].all(axis=0)
            if self.search == SUPPORT_ORDER:
                before = seen | ((place >= 0) & (place < place[a]))
                same = (closed[before] == own[before]).all()
                after = before.copy()
                after[a] = True
            else:
                same, after = (closed[:a] == own[:a]).all(), np.arange(len(own)) <= a
            if same:
                out.append((sub, closed, after, int(support[a])))
            else:
                self.counters[1] += 1
                if self.search == FAILURES:
                    passed[a] = closed
        stack += [(sub, closed, after, passed) for sub, closed, after, _ in out]
        return out

    def _bits(self, words: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(words[0]), self.shape.n_attrs), bool)
        for a in range(self.shape.n_attrs):
            out[:, a] = (words[a // intents.WORD] >> (a % intents.WORD)) & 1
        return out

    def _one(self, words: list[int]) -> np.ndarray:
        return self._bits([np.asarray([w], np.int64) for w in words])[0]

    def _words(self, sets: list[np.ndarray]) -> list[np.ndarray]:
        """The words of some attribute sets."""
        table, out = np.asarray(sets, np.int64).reshape(len(sets), self.shape.n_attrs), []
        for k in range(len(self.shape.words("b"))):
            part = table[:, k * intents.WORD : (k + 1) * intents.WORD]
            out.append(part @ (np.int64(1) << np.arange(part.shape[1], dtype=np.int64)))
        return out

    def _batch(self, pending: Sequence[tuple] = (), last: bool = False) -> pa.RecordBatch:
        """Found concepts (kind 0), concepts whose subtrees are handed back (1), and at the end the counters (2)."""
        shape, found, self.found = self.shape, self.found, []
        end = int(last)
        kind = np.repeat([0, 1, 2], [len(found), len(pending), end]).astype(np.int32)
        pad = lambda x, before, after: np.concatenate([np.zeros(before, np.int64), np.asarray(x, np.int64), np.zeros(after, np.int64)])
        columns = {"kind": pa.array(kind), "group": pa.array([self.group] * len(kind), pa.string())}
        sets = self._words([c for _, c, _ in found] + [own for own, *_ in pending])
        columns |= {d: pa.array(pad(x, 0, end)) for d, x in zip(shape.words("d"), sets)}
        columns |= {b: pa.array(np.full(len(kind), w, np.int64)) for b, w in zip(shape.words("b"), self.root)}
        columns |= {v: pa.array(pad(x, len(found), end)) for v, x in zip(shape.words("v"), self._words([seen for _, seen, _ in pending]))}
        rest = len(pending) + end
        columns["support"] = pa.array(pad([s for *_, s in found], 0, rest))
        columns["first_row"] = pa.array(pad([self.first[sub].min() for sub, *_ in found], 0, rest))
        summed = np.asarray([self.sums[sub].sum(axis=0) for sub, *_ in found], np.int64).reshape(len(found), len(shape.payload))
        columns |= {p: pa.array(pad(summed[:, k], 0, rest)) for k, p in enumerate(shape.payload)}
        failed = [[{"a": a} | {f: int(w[0]) for f, w in zip(shape.words("f"), self._words([x]))} for a, x in failed.items()] for *_, failed in pending]
        struct = pa.struct([("a", pa.int32()), *((f, pa.int64()) for f in shape.words("f"))])
        columns["failed"] = pa.array([[]] * len(found) + failed + [[]] * end, pa.list_(struct))
        for k, name in enumerate(("closures", "failures", "pruned")):
            columns[name] = pa.array(pad([self.counters[k]] * end, len(found) + len(pending), 0))
        return pa.record_batch(list(columns.values()), names=list(columns))


def _finish(heads: DataFrame, extents: DataFrame, shape: Shape, search: str, min_support: int, budget: int, n_heads: int) -> DataFrame:
    """Mines the subtrees of all heads, a concept at a time in a task that streams sorted rows."""
    b, longs = shape.words("b"), ["n", "first_row", *shape.payload, *shape.words("w")]
    zero = lambda names: [F.lit(0).cast("long").alias(c) for c in names]
    top = heads.select("group", *b, F.lit(0).alias("is_row"), *shape.words("v"), "failed", *zero(longs))
    rows = extents.select("group", *b, F.lit(1).alias("is_row"), *zero(shape.words("v")), F.array().cast(_failed_type(shape)).alias("failed"), *longs)
    tasks = max(1, min(int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_heads // 2))  # subtrees take time, not room: tasks are not to be joined by their bytes
    both = top.unionByName(rows).repartition(tasks, "group", *b).sortWithinPartitions("group", *b, "is_row")

    def subtree(table: pa.Table) -> Iterator[pa.RecordBatch]:
        head, rows_ = table.slice(0, 1).to_pylist()[0], table.slice(1)
        if rows_.num_rows:
            yield from _Subtree(shape, search, min_support, budget).run(head["group"], [head[x] for x in b], head, rows_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            begins = np.flatnonzero(table["is_row"].to_numpy() == 0).tolist()
            for s, e in zip([0, *begins], [*begins, table.num_rows]):
                if s in begins and held:
                    yield from subtree(pa.concat_tables(held))
                    held = []
                if e > s:
                    held.append(table.slice(s, e - s))
        if held:
            yield from subtree(pa.concat_tables(held))

    words = [f"{x} long" for x in (*shape.words("d"), *b, *shape.words("v"))]
    kept = [f"{x} long" for x in ("support", "first_row", *shape.payload)]
    counters = [f"{x} long" for x in ("closures", "failures", "pruned")]
    return both.mapInArrow(run, ", ".join(["kind int", "group string", *words, *kept, f"failed {_failed_type(shape)}", *counters]))


def search_concepts(
    rows: DataFrame, shape: Shape, min_support: int, *, search: str = FAILURES, max_concepts: int | None = None, task_rows: int = TASK_ROWS, task_concepts: int = TASK_CONCEPTS, keep: Keep = stored
) -> tuple[DataFrame, DataFrame]:
    """(group, d*, support, first_row, sums) of every concept of every group; and counters (level, concepts, closures, failures, pruned).

    rows: (group, w*, n, first_row, sums) with a row for each distinct intent of a group.  `keep` stores a table under a name.
    """
    if min_support < 1:
        raise ValueError("min_support must be at least 1")
    ship_package(rows.sparkSession)
    b, d, v, w = (shape.words(x) for x in "bdvw")
    order = ["group", *d, "support", "first_row", *shape.payload]
    rows = keep(rows, "rows")
    root = rows.groupBy("group").agg(*_aggregates(shape, "d"))
    zero = {x: F.lit(0).cast("long") for x in (*v, *shape.words("p"))}
    heads = root.where(F.col("support") >= min_support).select("group", *shape.renamed("d", "b")).withColumns(zero).withColumn("failed", F.array().cast(_failed_type(shape)))
    extents = rows.join(heads.drop("failed"), "group")
    found, counters, level = [root.where(F.col("support") >= min_support).select(order)], [], 0
    n_heads, largest = rows.groupBy("group").agg(F.count("*").alias("k")).agg(F.count("*"), F.coalesce(F.max("k"), F.lit(0))).head()
    limit = SMALL_ROWS
    while largest > limit:
        limit = max(1, min(task_rows, TASK_CELLS // max(1, shape.n_attrs)))  # expand once for parallelism, and further only while an extent is too large
        level += 1
        exploded, closures = close_concepts(extents, shape)
        kids = keep(tested(closures, shape, search, min_support), f"concepts-{level}")
        branch = reduce(lambda x, y: x + y, (F.bit_count(x) for x in shape.free([shape.mask(k) for k in range(len(b))])))
        ruled_out = reduce(lambda x, y: x + y, (F.bit_count(p.bitwiseAND(F.bitwise_not(bk)).bitwiseAND(F.bitwise_not(vk))) for p, bk, vk in zip(shape.columns("p"), shape.columns("b"), shape.columns("v"))))
        one = F.col("canonical").cast("int")
        branches = heads.select(F.lit(0).alias("concepts"), branch.alias("closures"), F.lit(0).alias("failures"), ruled_out.alias("pruned"))
        tests = kids.select(one.alias("concepts"), F.lit(0).alias("closures"), (1 - one).alias("failures"), F.lit(0).alias("pruned"))
        counters.append(_summed(branches.unionByName(tests), level))
        heads = keep(_children(kids, heads, shape, search), f"heads-{level}")
        below = heads.select("group", *b, "a", *d, *shape.words("e"), *(F.col(p).alias(f"_{p}") for p in shape.words("p")))
        joined = exploded.join(below, ["group", *b, "a"])
        extents = joined.select("group", *shape.renamed("d", "b"), *shape.renamed("e", "v"), *(F.col(f"_{p}").alias(p) for p in shape.words("p")), *w, "n", "first_row", *shape.payload)
        extents = keep(extents, f"extents-{level}")
        heads = heads.select("group", *shape.renamed("d", "b"), *shape.renamed("e", "v"), *shape.words("p"), "failed")
        mined = kids.where("canonical")
        found.append(mined.select(order))
        _check(found, max_concepts)
        n_heads, largest = extents.groupBy("group", *b).agg(F.count("*").alias("k")).agg(F.count("*"), F.coalesce(F.max("k"), F.lit(0))).head()
    turn = 0
    while largest:
        turn += 1
        done = keep(_finish(heads, extents, shape, search, min_support, task_concepts, n_heads), f"subtrees-{turn}")
        found.append(done.where("kind = 0").select("group", *d, "support", "first_row", *shape.payload))
        _check(found, max_concepts)
        counters.append(_summed(done.withColumn("concepts", (F.col("kind") == 0).cast("int")), level + 1))
        left = done.where("kind = 1").select("group", *b, *d, *(F.col(x).alias(f"_{x}") for x in v), "failed")
        n_heads = largest = left.count()
        if largest:
            left = keep(left, f"left-{turn}")
            inside = _all([x.bitwiseAND(y) == y for x, y in zip(shape.columns("w"), shape.columns("d"))])
            under = extents.drop(*v).join(left.drop("failed"), ["group", *b]).where(inside)
            extents = keep(under.select("group", *shape.renamed("d", "b"), *(F.col(f"_{x}").alias(x) for x in v), *shape.words("p"), *w, "n", "first_row", *shape.payload), f"rest-{turn}")
            heads = left.select("group", *shape.renamed("d", "b"), *(F.col(f"_{x}").alias(x) for x in v), *(F.lit(0).cast("long").alias(p) for p in shape.words("p")), "failed")
    empty = rows.sparkSession.createDataFrame([], "level int, concepts long, closures long, failures long, pruned long")
    return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, counters, empty)


def _summed(counted: DataFrame, level: int) -> DataFrame:
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("concepts", "closures", "failures", "pruned")]
    return counted.agg(*sums).select(F.lit(level).alias("level"), "concepts", "closures", "failures", "pruned")


def _check(found: list[DataFrame], max_concepts: int | None) -> None:
    if max_concepts is not None and sum(f.count() for f in found) > max_concepts:
        raise TooManyConcepts(f"more than {max_concepts} concepts; raise min_support")


def mine_compressed(rows: DataFrame, n_attrs: int, payload: list[str], min_support: int, **options) -> DataFrame:
    """(group, d*, support, first_row, sums) of every concept of every group of `rows`."""
    return search_concepts(rows, Shape(n_attrs, tuple(payload)), min_support, **options)[0]


def label_counts_of(found: DataFrame, rows: DataFrame, counted: DataFrame, n_attrs: int, *, keep: Keep = stored) -> DataFrame:
    """(group, d*, key, k): the label counts of every compressed row under every concept (group, d*) whose row contains it.

    Concepts meet the distinct intents by their rarest attributes, and the pairs meet the counts, which stay rows: no task holds the
    labels of a concept.
    """
    d, w, e, h = (intents.word_names(n_attrs, x) for x in "dweh")
    model = found.select("group", intents.from_words([F.col(x) for x in d], n_attrs).alias("intent"), F.lit("").alias("prop"))
    examples = rows.select("group", intents.from_words([F.col(x) for x in w], n_attrs).alias("intent"), *(F.col(x).alias(y) for x, y in zip(w, e)))
    met = matches(model, examples, n_attrs, ("group",)).select("group", *(F.col(x).alias(y) for x, y in zip([*h, *e], [*d, *w])))
    bare = found.where(_all([F.col(x) == 0 for x in d])).select("group", *d).join(rows.select("group", *w), "group")  # every row of its group
    pairs = keep(met.unionByName(bare), "pairs")
    return pairs.join(counted.select("group", *w, "key", "k"), ["group", *w]).select("group", *d, "key", "k")


def mine_labelled(context: Context, key: Column, min_support: int, *, summed: bool, keep: Keep = stored, **options) -> tuple[DataFrame, DataFrame]:
    """Concepts by groups of `key` with label counts, and the counters of the search.

    Counts are columns or, for large domains, a map; with `summed` those are summed up as far as merges need them (see summed_counts).
    """
    payload, histogram = payload_of(context.labels)
    shape, key = Shape(context.n_attrs, tuple(payload), histogram), key.alias("group")
    if not histogram:
        return search_concepts(compress(context, key), shape, min_support, keep=keep, **options)
    counted = keep(compress_labels(context, key), "label-counts")
    rows = keep(compress(context, key, counted=counted), "intents")
    found, levels = search_concepts(rows, shape, min_support, keep=keep, **options)
    found = keep(found, "mined")
    own = ["group", *shape.words("d")]
    counts = label_counts_of(found, rows, counted, context.n_attrs, keep=keep)
    return found.join(summed_counts(counts, context.labels.width, *own) if summed else merged_counts(counts, *own), own), levels


def root_concept(context: Context) -> DataFrame:
    """(intent, support) of the concept of all rows; every attribute if there are no rows."""
    names = intents.word_names(context.n_attrs)
    rows = compress(context).agg(*(F.bit_and(w).alias(w) for w in names), F.coalesce(F.sum("n"), F.lit(0)).alias("support"))
    held = intents.from_words([F.col(w) for w in names], context.n_attrs)
    return rows.select(F.when(F.col("support") == 0, intents.full(context.n_attrs)).otherwise(held).alias("intent"), "support")


def _searched(context: Context, min_support: int, algorithm: str, classwise: bool, *, summed: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    if algorithm not in SEARCHES:
        raise ValueError(f"unknown algorithm {algorithm!r}, known are {', '.join(ALGORITHMS)}")
    key = class_key(F.col("prop")) if classwise else F.lit("")
    return mine_labelled(context, key, min_support, summed=summed, search=SEARCHES[algorithm], **options)


def concepts(context: Context, *, min_support: int = 2, algorithm: str = "pfcbo", classwise: bool = False, max_concepts: int | None = None, summed: bool = False, keep: Keep = stored) -> DataFrame:
    """(class_key, intent, n, first_row, label counts) of every closed set with enough support; `summed` as in mine_labelled."""
    mined = _searched(context, min_support, algorithm, classwise, summed=summed, max_concepts=max_concepts, keep=keep)[0]
    words = [F.col(x) for x in intents.word_names(context.n_attrs, "d")]
    counts = [c for c in mined.columns if c not in ("group", "support", "first_row", *intents.word_names(context.n_attrs, "d"))]
    return mined.select(F.col("group").alias("class_key"), intents.from_words(words, context.n_attrs).alias("intent"), F.col("support").alias("n"), "first_row", *counts)


def counters(context: Context, *, min_support: int = 2, algorithm: str = "pfcbo") -> DataFrame:
    """(closures, failures, pruned) of a search: sets closed, canonicity tests failed, and branches that inherited failures ruled out."""
    levels = _searched(context, min_support, algorithm, False)[1]
    return levels.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("closures", "failures", "pruned")))


def extent_weights(context: Context, found: DataFrame) -> DataFrame:
    """(intent, attr_id, weight): for each concept of `found` (intent) and attribute, how many rows of its extent hold it."""
    names = intents.word_names(context.n_attrs, "e")
    words = [w.alias(x) for w, x in zip(intents.to_words(F.col("intent"), context.n_attrs), names)]
    rows = context.rows.groupBy(*words).agg(F.count("*").alias("n"), F.first("intent").alias("intent"))
    named = found.select("intent", intents.text(F.col("intent")).alias("prop"))
    met = matches(named, rows, context.n_attrs).join(rows.select(*names, "n", F.explode("intent").alias("attr_id")), names)
    below = met.groupBy(F.col("prop").alias("name"), "attr_id").agg(F.sum("n").alias("weight"))
    listed = F.transform(F.split("name", " "), lambda a: a.cast("int"))
    all_rows = context.rows.select(F.explode("intent").alias("attr_id")).groupBy("attr_id").agg(F.count("*").alias("weight"))
    bare = found.where(F.size("intent") == 0).limit(1).count() > 0  # a concept without attributes has every row
    out = below.select(listed.alias("intent"), "attr_id", "weight")
    return out.unionByName(all_rows.select(intents.empty().alias("intent"), "attr_id", "weight")) if bare else out


def generate(
    context: Context, *, strategy: str = "noCounterExamples", min_support: int = 2, algorithm: str = "pfcbo", data_structure: str = "dense", sampling: float = 1.0, seed: int = 0, max_concepts: int | None = None, split_classes: bool = True, keep: Keep = stored
) -> DataFrame:
    """The model: (intent, prop, support) of every concept whose merged label is not all conflict.

    `noop` mines each class of labels on its own and keeps the class's label; with split_classes off it
    mines all rows together and takes the label of the lowest row of each concept.  With a `keep` that finds tables again
    (storage.Journal), a run that was ended goes on from the last table it stored.
    """
    if data_structure not in DATA_STRUCTURES:
        raise ValueError(f"unknown data structure {data_structure!r}, known are {', '.join(DATA_STRUCTURES)}")
    mined = concepts(context, min_support=min_support, algorithm=algorithm, classwise=strategy == "noop" and split_classes, max_concepts=max_concepts, summed=True, keep=keep)
    if strategy == "noop" and not split_classes:
        mined = mined.join(context.rows.select(F.col("row_id").alias("first_row"), F.col("prop").alias("first_prop")), "first_row")
        prop = F.col("first_prop")
    elif strategy == "noop":
        prop = F.transform(F.split("class_key", ","), lambda c: c.cast("int"))
    else:
        prop = strategy_by_name(strategy)(context.labels, summed=True)
    model = mined.select("intent", prop.alias("prop"), F.col("n").alias("support")).where(~is_conflict(F.col("prop")))
    return model if sampling >= 1.0 else sample_hypotheses(model, sampling, seed)


def sample_hypotheses(model: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Keeps each hypothesis with the given probability; the choice depends on the intent and the seed only."""
    words = lambda name: F.concat_ws(" ", F.transform(name, lambda x: x.cast("string")))
    return model.where(chance(words("intent"), words("prop"), F.lit(seed)) < fraction)


def model_text(model: DataFrame, context: Context) -> DataFrame:
    """(intent, label, support) as text."""
    return context.labels.with_text(model).select(intents.text(F.col("intent")).alias("intent"), "label", "support")
