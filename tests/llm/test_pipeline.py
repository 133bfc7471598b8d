"""The pipeline's stages against brute force on the smallest driver table."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from latticeforge.llm import secret_scan, suffix_dedup

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output rows."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(10**6, None, None, None, None), (None, "", "en", "s", 0)], docs.schema))
    seen = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(number))
        out = stage(spark, docs, DATA)
        if number < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(path)
        out = spark.read.parquet(path)
        seen[name] = (docs.collect(), out.collect())
        docs = out
    return seen


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def test_quality_drops_bad_rows_only(spark, stages):
    before, after = stages["quality_rules"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    assert not any(r.text is None or len(WORD.findall(r.text)) < 50 for r in after)
    judged = [r.doc_id for r in before if r.doc_id in labels and r.text and len(WORD.findall(r.text)) >= 60]
    assert sum((i in kept) == bool(labels[i]) for i in judged) >= 0.9 * len(judged)


def test_one_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    sets = [shingles(r.text) for r in before]
    group = list(range(len(before)))
    for a in range(len(before)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    first = {g: min(before[k].doc_id for k in range(len(before)) if group[k] == g) for g in set(group)}
    assert sorted(r.doc_id for r in after) == sorted(first.values())


def without_passages(texts):
    """Texts without passages of 51 words that stand twice; texts of nothing else go."""
    seen = {}
    for text in texts.values():
        words = WORD.findall(text)
        for k in range(len(words) - 50):
            seen[tuple(words[k : k + 51])] = seen.get(tuple(words[k : k + 51]), 0) + 1
    out = {}
    for i, text in texts.items():
        spans = [m.span() for m in WORD.finditer(text)]
        words = [text[s:e] for s, e in spans]
        gone = [False] * len(text)
        for k in range(len(words) - 50):
            if seen[tuple(words[k : k + 51])] > 1:
                gone[spans[k][0] : spans[k + 50][1]] = [True] * (spans[k + 50][1] - spans[k][0])
        rest = "".join(c for c, g in zip(text, gone) if not g)
        if rest == text or WORD.search(rest):
            out[i] = rest
    return out


def test_repeated_strings_go(stages):
    before, after = stages["repeated_strings"]
    data = {i: text.encode() for i, text in without_passages({r.doc_id: r.text for r in before}).items()}
    seen = {}
    for x in data.values():
        for k in range(len(x) - 399):
            seen[x[k : k + 400]] = seen.get(x[k : k + 400], 0) + 1
    left = {r.doc_id: r.text for r in after}
    assert set(left) <= set(data)
    for i, x in data.items():
        gone = bytearray(len(x))
        for k in range(len(x) - 399):
            if seen[x[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        rest = bytes(c for c, g in zip(x, gone) if not g).decode("utf-8", "ignore")
        if i in left:
            strip = lambda t: re.sub(r"[^\x00-\x7f]", "", t)
            assert strip(left[i]) == strip(rest)
        else:
            assert not rest.strip()


def test_secrets_are_masked(stages):
    before, after = stages["mask_secrets"]
    assert sorted(r.doc_id for r in before) == sorted(r.doc_id for r in after)
    assert not any(secret_scan.scan_text(r.text)[1] for r in after) and all(r.n_chars == len(r.text) for r in after)


def test_everything_left_is_packed(stages):
    before, after = stages["pack_sequences"]
    assert {r.doc_id for r in before} == {r.doc_id for r in after}
    fill = {}
    for r in after:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048 and len(fill) <= 1.05 * sum(fill.values()) / 2048 + 1


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, DATA).where(F.col("length") > 0).count() > 0


def test_repeated_passages_of_over_50_words_go(spark):
    import random

    rng = random.Random(8)
    new = lambda n: ["".join(rng.choices("abcdeé", k=rng.randrange(2, 7))) for _ in range(n)]
    shared = {n: new(n) for n in (50, 51, 57, 63, 120)}
    texts = [" ".join(new(70)), " ".join(new(51)) + "\t"]
    for n, words in shared.items():
        assert n == 120 or len(" ".join(words).encode()) < 400
        texts += [" ".join(new(30) + words + new(40)), "\n".join(new(20)) + "\n" + "\n".join(words) + " " + " ".join(new(60))]
    texts += [" ".join(shared[57]), texts[0]]
    rows = [(k, text, "en", "s", len(text)) for k, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    words = [text.split() for text in texts]
    seen = {}
    for x in words:
        for k in range(len(x) - 50):
            seen[tuple(x[k : k + 51])] = seen.get(tuple(x[k : k + 51]), 0) + 1
    want = {}
    for i, x in enumerate(words):
        gone = {k + j for k in range(len(x) - 50) if seen[tuple(x[k : k + 51])] > 1 for j in range(51)}
        if len(gone) < len(x):
            want[i] = [w for k, w in enumerate(x) if k not in gone]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, words=51).collect()}
    assert {i: r.text.split() for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())
    assert len(want[2]) == 120 and len(want[4]) == 70


def test_there_are_five_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_strings", "mask_secrets", "pack_sequences"]


def test_stages_take_empty_tables_and_nulls(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    prose = " ".join(f"word{k % 70} stone{k}" for k in range(80))
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (None, prose, None, "s", None), (3, prose, "en", "s", 5), (3, "secret: 12345678 " + prose[:200], None, None, None)], schema)
    for docs in (odd.limit(0), odd):
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, DATA)
            rows = out.collect()
            assert number == 4 or out.columns == docs.columns
            assert docs is odd or not rows
