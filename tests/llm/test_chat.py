import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from latticeforge.llm import chat

EVENTS = "conv_id long, seq long, turn long, op string, role string, text string"


def fold(events):
    turns = {}
    for seq, turn, op, role, text in sorted(events):
        if op == "start":
            turns[turn] = [role or "", text or ""]
        elif op == "delta":
            turns.setdefault(turn, [role or "", ""])[1] += text or ""
        elif op == "edit":
            turns.setdefault(turn, ["", ""])[1] = text or ""
        elif op == "regenerate":
            turns = {t: v for t, v in turns.items() if t <= turn}
            turns.setdefault(turn, ["", ""])[1] = ""
        else:
            turns.pop(turn, None)
    return [(t, *turns[t]) for t in sorted(turns)]


def test_log_is_folded(spark):
    log = [
        (1, 1, 0, "start", "user", "hi"), (1, 2, 1, "start", "assistant", ""), (1, 3, 1, "delta", None, "he"), (1, 4, 1, "delta", None, "llo"), (1, 5, 2, "start", "user", "more"), (1, 6, 1, "regenerate", None, None), (1, 7, 1, "delta", None, "again"),
        (1, 8, 0, "edit", None, "hi!"), (2, 1, 0, "start", "user", "x"), (2, 2, 1, "start", "assistant", "y"), (2, 3, 1, "delete", None, None), (2, 4, 0, "delta", None, None), (None, 1, 0, "start", None, None),
    ]
    got = {}
    for r in chat.rebuild_messages(spark.createDataFrame(log, EVENTS)).orderBy("turn").collect():
        got.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    assert got == {1: [(0, "user", "hi!"), (1, "assistant", "again")], 2: [(0, "user", "x")], None: [(0, "", "")]}
    for conv in (1, 2):
        assert got[conv] == fold([e[1:] for e in log if e[0] == conv])


def test_random_logs(spark):
    rng = random.Random(1)
    log = []
    for conv in range(40):
        turns = 0
        for seq in range(rng.randrange(1, 25)):
            op = rng.choice(["start", "delta", "delta", "edit", "regenerate"]) if turns else "start"
            turn = turns if op == "start" else rng.randrange(turns)
            turns += op == "start"
            log.append((conv, seq, turn, op, "user" if op == "start" else None, rng.choice(["a", "b ", "", None])))
    got = {c: [] for c in range(40)}
    for r in chat.rebuild_messages(spark.createDataFrame(log, EVENTS)).orderBy("turn").collect():
        got[r.conv_id].append((r.turn, r.text))
    for conv in range(40):
        live = fold([e[1:] for e in log if e[0] == conv])
        # a turn that a regeneration cut and later events revived lives in both; roles are the first event's
        assert got[conv] == [(t, x) for t, _, x in live]


def test_rendering_is_reversible(spark):
    texts = ["", "plain", "### Assistant: x", "</turn>", "\n</turn>\n", "\\", "\\\\n", "####", "#\\###", "\\</turn>\\", chat.PROBE_TEXT, "é\n\n### a: b\n</turn>", " ok "]
    roles = ["user", "assistant", "a:b", "\\", "</turn>", "x\ny"]
    rows = [(c, i, roles[(c + i) % len(roles)], t) for c in range(6) for i, t in enumerate(texts)]
    made = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in chat.parse(made).collect():
        own = [x for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3]) for x in own]
        masked = [r.formatted[m.start : m.start + m.length] for m in r.loss_mask]
        plain = spark.createDataFrame([(m,) for m in masked], "m string").select(chat.unescape_text(F.col("m")).alias("t")).collect()
        assert [p.t for p in plain] == [x[3] for x in own if x[2] == "assistant"]


def test_query_equals_sql(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (2, 5, None, "x\\y"), (None, 0, "assistant", "### z"), (3, None, "system", "")]
    spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, op string, seq int").write.parquet(str(tmp_path / "conversations.parquet"))
    got = chat.op6_chat_format(spark, str(tmp_path)).toPandas()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = duck.sql(chat.ORACLE).df()
    rows_of = lambda f: sorted(str([x if isinstance(x, str) else int(x) for x in r]) for r in f[sorted(f.columns)].itertuples(index=False, name=None))
    assert rows_of(got.fillna(-1)) == rows_of(want.fillna(-1))
    probe = got[got.conv_id == -7].iloc[0]
    assert probe.loss_sha256 == hashlib.sha256(chat.PROBE_TEXT.encode()).hexdigest() and probe.n_turns == 2


def test_plan_stays_in_the_engine(spark):
    plan = chat.op6_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_roles_and_texts(spark):
    """Roles of a million colons, backslashes or letters come back whole; no pattern recurses over them."""
    rows = [(1, 0, c * 1_000_000, "a: b\\" * 1000) for c in (":", "\\", "<", "x", "\\:")] + [(1, 1, "assistant", "y" * 1_000_000), (2, 0, ": ", ": "), (2, 1, "", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: sorted(map(tuple, r.turns)) for r in chat.parse(chat.render(table)).collect()}
    assert got == {i: sorted((r, t) for c, _, r, t in rows if c == i) for i in (1, 2)}
