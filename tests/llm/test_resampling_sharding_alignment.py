"""Operators 11 to 13 against brute force, on tables with nulls, empty and long texts, repeated rows, shared ids and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeforge.llm import alignment, importance, sharding
from latticeforge.llm.byte_bpe import ByteTokenizer
from test_operators import corpus

CLASH = ("uid", "side", "offset", "ids", "size", "key", "place", "range", "piece", "shard", "slot", "part", "block", "row", "score", "rank", "bucket", "n", "doc", "weight")
EXTRA = [
    "don't 'S said\n\nTwo  spaces,\ttabs\r\n and 12345 numbers!?", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "語字" * 300 + " юбЁ é 😀 ﬁ ①", "a" * 3000, " ", "   ", "\n", "\n\n ",
    "x\0y \x85 \xa0z 　w", "Ünïcode WORDS and ascii Words", "!!! ... ---", "Token=abc <|fim|> it's we'll I'D",
]


def rows():
    return corpus() + [(700 + k, t) for k, t in enumerate(EXTRA)] + [(700, EXTRA[0])]


def table(spark, data):
    made = spark.createDataFrame(data, "doc_id long, text string")
    return made.select("*", *(F.lit("clash").alias(c) for c in CLASH)).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    table(spark, rows()).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


WANTED = ["Two tabs and numbers two TWO", None, "", "ünïcode words " * 20]


def drawn(table, wanted, buckets, max_run, min_words, percent, seed=2024):
    """Operator 11 in plain Python; rows keep their order in the table for ties."""

    def runs(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        grams = [" ".join(words[i : i + k]) for k in range(1, max_run + 1) for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(g.encode()) % buckets for g in grams]

    own = [runs(t) for _, t in table]
    s, t = Counter(b for _, g in own for b in g), Counter(b for x in wanted for b in runs(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for (i, _), (n_words, grams) in zip(table, own):
        weight = sum(gain[b] for b in grams) // len(grams) if grams else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("buckets, max_run, min_words, percent", [(10_000, 1, 20, 10), (97, 3, 1, 50), (50, 2, 0, 100)])
def test_resampling(spark, docs, buckets, max_run, min_words, percent):
    target = spark.createDataFrame([(k, t) for k, t in enumerate(WANTED)], "item_id long, text string")
    got = importance.resample(docs, target, buckets=buckets, max_run=max_run, min_words=min_words, percent=percent)
    assert Counter(map(tuple, got.collect())) == drawn(rows(), WANTED, buckets, max_run, min_words, percent)


def test_resampling_ranks_by_ranges(spark, docs, monkeypatch):
    monkeypatch.setattr(importance, "RANGE_ROWS", 3)
    target = spark.createDataFrame([(0, WANTED[0])], "item_id long, text string")
    many = docs.select("doc_id", "text").union(docs.select("doc_id", "text")).union(docs.select(F.col("doc_id") + 5000, "text"))
    got = importance.resample(many, target, percent=40).collect()
    data = rows() * 2 + [(None if i is None else i + 5000, t) for i, t in rows()]
    assert Counter(map(tuple, got)) == drawn(data, WANTED[:1], 10_000, 1, 20, 40)


def test_resampling_towards_nothing(spark, docs):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert Counter(map(tuple, importance.resample(docs, nothing).collect())) == drawn(rows(), [], 10_000, 1, 20, 10)
    assert importance.resample(docs.limit(0), nothing).collect() == []


def check_shards(got, data, shards):
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in data)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)} and all(0 <= r.shard < shards for r in got)
    slots, loads, homes, weight = defaultdict(list), [0] * shards, defaultdict(set), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        homes[r.text_crc32].add(r.shard)
        weight[r.text_crc32] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = sum(loads) / shards
    assert all(len(h) == 1 for t, h in homes.items() if weight[t] <= share)  # copies stay together unless they exceed a share
    return loads, share


@pytest.mark.parametrize("ranges, range_rows", [(1024, 500_000), (4, 2)])
def test_shards_of_odd_rows(docs, ranges, range_rows):
    check_shards(sharding.assign(docs, ranges=ranges, range_rows=range_rows).collect(), rows(), 8)


@pytest.mark.parametrize("ranges", [128, 1024])
def test_shards_are_nearly_equal(spark, ranges):
    """A text of a third of all bytes, one of a third of all rows, and groups of copies."""
    data = [(i, f"text {i} " + "word " * (i * i % 97)) for i in range(2000)] + [(i, "copy " * 60) for i in range(3000, 3600)] + [(None, "") for _ in range(1500)] + [(9000 + i, "group " * (i % 7) * 50) for i in range(90)]
    loads, share = check_shards(sharding.assign(spark.createDataFrame(data, "doc_id long, text string").repartition(4), ranges=ranges).collect(), data, 8)
    assert max(loads) - min(loads) < 0.02 * share


def test_overfull_ranges_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SAMPLES_EACH", 1)  # a poor sample
    data = [(i, f"text {i} " * (1 + i % 9)) for i in range(3000)]
    rows_ = sharding.measured(spark.createDataFrame(data, "doc_id long, text string"))
    total = rows_.agg(F.sum("size")).head()[0]
    sizes = sharding.split_ranges(rows_, total, 256)[1].collect()
    assert sum(r.n for r in sizes) == 3000 and all(r.one_key or r.bytes <= sharding.OVERFULL * (total // 256) for r in sizes)
    loads, share = check_shards(sharding.assign(spark.createDataFrame(data, "doc_id long, text string"), shards=5, ranges=256).collect(), data, 5)
    assert max(loads) - min(loads) < 0.02 * share


def test_written_shards_hold_whole_rows(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(map(tuple, back.select("doc.*").collect())) == Counter(map(tuple, docs.collect()))
    for r in back.groupBy("shard").agg(F.collect_list("slot").alias("slots")).collect():
        assert sorted(r.slots) == list(range(len(r.slots)))
    sharding.write_shards(docs.limit(0), str(tmp_path / "none"))


def aligned(data):
    """Operator 13 in plain Python with the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = alignment.default_models()
    a_model, b_model = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a_model.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    bytes_a = {i: bytes(letters.get(c, 0) for c in p) for p, i in a_model.get_vocab().items()}
    bytes_b = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i in range(b_model.get_piece_size()) for p in [b_model.id_to_piece(i)]]
    found, count = [], Counter()
    for i, text in data:
        whole = f" {text}".encode()
        a, b = (a_model.encode(f" {text}", add_special_tokens=False).ids, b_model.encode(text)) if text else ([], [])
        if not text or b"".join(bytes_a[x] for x in a) != whole or b"".join(bytes_b[x] for x in b) != whole:
            found.append((i, 0, 0, [], Counter()))
            continue
        end_a, end_b = np.cumsum([len(bytes_a[x]) for x in a]), np.cumsum([len(bytes_b[x]) for x in b])
        groups, k, j = [], 0, 0
        for end in sorted(set(end_a.tolist()) & set(end_b.tolist())):
            k2, j2 = int((end_a <= end).sum()), int((end_b <= end).sum())
            groups.append((a[k:k2], b[j:j2]))
            k, j = k2, j2
        links = Counter((x, y) for xs, ys in groups for x in xs for y in ys)
        found.append((i, len(a), len(b), groups, links))
        count.update(links.keys())
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = Counter()
    for i, n_a, n_b, groups, links in found:
        said = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        numbers = (len(groups), sum(links.values()), sum(n for p, n in links.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in links.items()))
        out[(i, n_a, n_b, *numbers, hashlib.sha256(said.encode()).hexdigest() if groups else "")] += 1
    return out


@pytest.mark.parametrize("sizes", [{}, {"event_tokens": 5, "sweep_tokens": 60}])
def test_alignment(docs, sizes):
    data = [(i, t) for i, t in rows() if len(t or "") < 50_000]
    some = docs.where("text IS NULL OR length(text) < 50000")
    assert Counter(map(tuple, alignment.align(some, **sizes).collect())) == aligned(data)


def test_alignment_of_nothing(docs):
    assert alignment.align(docs.limit(0)).collect() == []


def test_a_group_without_bound_is_counted_before_it_is_paired(monkeypatch):
    rng = np.random.default_rng(3)
    group, b_group = np.sort(rng.integers(0, 9, 400)), np.sort(rng.integers(0, 9, 300))
    a, b, doc = rng.integers(0, 20, 400), rng.integers(0, 15, 300), group // 4
    want = Counter()
    for d, g, x in zip(doc.tolist(), group.tolist(), a.tolist()):
        for y in b[b_group == g].tolist():
            want[d, x * 15 + y] += 1
    for large in (1, 1 << 40):
        monkeypatch.setattr(alignment, "LARGE_GROUP", large)
        for unfold in (10, 1 << 20):
            monkeypatch.setattr(alignment, "UNFOLD", unfold)
            docs_, pairs, times = alignment.unfolded(doc, group, a, b_group, b, 9, (20, 15))
            assert Counter(dict(zip(zip(docs_.tolist(), pairs.tolist()), times.tolist()))) == want and len(pairs) == len(want)


def test_byte_level_ids_equal_the_library():
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    from latticeforge.llm._kernels import text_buffers

    path = alignment.default_models()[0]
    library, own, rng = Tokenizer.from_file(path), ByteTokenizer(path, 1 << 20), random.Random(4)
    library.encode_special_tokens = True
    letters = " \t\n\r\x0b\x0c'!,.-aZsdtmrevlL09é\xa0 　\x85—語字юбЁ²¼\x1c\x1f\x00😀<|>_́"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["".join(rng.choice(" 'sdta!\n") for _ in range(rng.randint(0, 30))) for _ in range(3000)] + EXTRA
    ids, at = own.ids(*text_buffers(pa.array(texts)))
    assert [ids[s:e].tolist() for s, e in zip(at, at[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
