"""Operator 6: chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log of events (conv_id, seq, turn, op, role, text) is folded into final messages:

    start       opens a turn with its role and first text (often empty)
    delta       appends streamed text to the turn
    edit        replaces the turn's text
    regenerate  drops the turn's text, and all later turns that the log had so far
    delete      removes the turn, until a later event of it

Logs are partitioned by conversation, sorted by seq, and every event before a turn's last resetting
one is forgotten.  Rendering marks turns and escapes control strings reversibly:

    ### ROLE: TEXT
    </turn>

In texts `\\` becomes `\\\\`, `###` becomes `\\###`, `</turn>` becomes `\\</turn>`; in roles `\\`, `:`
and `<` get a backslash.  So a line feed before an unescaped `</turn>` ends a turn and nothing else does.

Defined results: null text is empty and null role is empty; a null conv_id is a conversation of its
own; rows that share a turn number stay separate turns, ordered by role, then text; texts and roles
may be as long as a string can be; an empty table gives only the fixed conversation; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

HEAD, END = "### ", "\n</turn>\n"
#: The fixed conversation: both turns say this.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"
RESETS = ("start", "edit", "regenerate", "delete")


def escape_text(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("###"), F.lit("\\###")), F.lit("</turn>"), F.lit("\\</turn>"))


def unescape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(\\|###|</turn>)", "$1")


def escape_role(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\:<])", r"\\$1")


def unescape_role(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def rebuild_messages(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of an event log."""
    event = F.struct("seq", "op", F.coalesce("text", F.lit("")).alias("text"), "role")
    turns = events.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(event)).alias("log"))
    redone = F.array_max(F.transform(F.filter("log", lambda e: e["op"] == "regenerate"), lambda e: e["seq"]))
    earlier = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    turns = turns.withColumn("redone", redone).withColumn("cut", F.max("redone").over(earlier))
    # What a regeneration of an earlier turn cut off is gone; of the rest, all from the last reset on counts.
    turns = turns.withColumn("log", F.when(F.col("cut").isNull(), F.col("log")).otherwise(F.filter("log", lambda e: e["seq"] > F.col("cut"))))
    reset = F.array_max(F.transform(F.filter("log", lambda e: e["op"].isin(*RESETS)), lambda e: e["seq"]))
    turns = turns.withColumn("reset", F.coalesce(reset, F.lit(-(2**63)))).where((F.size("log") > 0) & (F.element_at("log", -1)["op"] != "delete"))
    live = F.filter("log", lambda e: (e["seq"] >= F.col("reset")) & ~e["op"].isin("delete", "regenerate"))
    roles = F.filter("log", lambda e: e["role"].isNotNull())
    role = F.coalesce(F.try_element_at(roles, F.lit(-1))["role"], F.lit(""))
    return turns.select("conv_id", "turn", role.alias("role"), F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask): loss_mask holds the (start, length) of each assistant text in code points."""
    head = F.concat(F.lit(HEAD), escape_role(F.col("role")), F.lit(": "))
    parts = messages.select("conv_id", "turn", (F.col("role") == "assistant").alias("loss"), F.length(head).alias("skip"), escape_text(F.col("text")).alias("body"), head.alias("head"))
    parts = parts.withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
    turn = F.struct("turn", "piece", "loss", (F.col("at") + F.col("skip")).alias("start"), F.length("body").cast("long").alias("length"))
    grouped = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    mask = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return grouped.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), mask.alias("loss_mask"))


def parse(formatted: DataFrame) -> DataFrame:
    """Reads rendered conversations back: adds turns, an array of (role, text)."""
    pieces = F.filter(F.split("formatted", "\n</turn>\n", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        # The role ends at the first colon without a backslash; no pattern repeats a group, so roles may be long.
        plain = F.replace(F.replace(p, F.lit("\\\\"), F.lit("..")), F.lit("\\:"), F.lit(".."))
        colon = F.instr(plain, ":")
        skip = len(HEAD)
        role, text = p.substr(F.lit(skip + 1), colon - F.lit(skip + 1)), p.substr(colon + F.lit(2), F.length(p))
        return F.struct(unescape_role(role).alias("role"), unescape_text(text).alias("text"))

    return formatted.withColumn("turns", F.transform(pieces, turn))


def as_events(conversations: DataFrame) -> DataFrame:
    """The streamed log of finished conversations: each row starts its turn and then sends its text."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("k", F.row_number().over(order).cast("long"))
    steps = F.array(
        F.struct((2 * F.col("k")).alias("seq"), F.lit("start").alias("op"), F.col("role"), F.lit("").alias("text")),
        F.struct((2 * F.col("k") + 1).alias("seq"), F.lit("delta").alias("op"), F.lit(None).cast("string").alias("role"), F.col("text")),
    )
    return rows.select("conv_id", F.col("k").alias("turn"), F.explode(steps).alias("e")).select("conv_id", "turn", "e.*")


def with_probe(conversations: DataFrame) -> DataFrame:
    probe = conversations.sparkSession.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(PROBE_TEXT).alias("text")
    )
    given = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return given.unionByName(probe)


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    log = as_events(with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    read = parse(render(rebuild_messages(log)))
    said = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"),
        F.sha2(said.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, '### ' || regexp_replace(role, '([\\:<])', '\\\1', 'g') || ': ' || replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') || chr(10) || '</turn>' || chr(10) AS piece FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(piece)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
