"""DuckDB SQL for the registered queries, put together from the same context definitions."""

from __future__ import annotations

from .contexts import BUYERS, CUSTOMER, EVENTS, GRADED, LINEITEM, ORDERS, PART, PRICES, Source


def _raw(source: Source) -> str:
    sql = source.duck_sql
    for t in source.tables:
        sql = sql.replace(f"{{{t}}}", t)
    return sql


def context_ctes(source: Source) -> str:
    """raw, cells, dict, codes (label texts to codes), obj (row_id, m, p0, p1, ...)."""
    cells = " UNION ALL ".join(f"SELECT row_id, {i} AS col_idx, {a} AS value FROM raw" for i, a in enumerate(source.attributes))
    codes = " UNION ALL ".join(f"SELECT {i} AS comp, value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT {c} AS value FROM raw)" for i, c in enumerate(source.labels))
    joins = " ".join(f"JOIN codes k{i} ON k{i}.comp = {i} AND k{i}.value = r.{c}" for i, c in enumerate(source.labels))
    props = ", ".join(f"k{i}.code AS p{i}" for i in range(len(source.labels)))
    ids = " | ".join(f"(1::BIGINT << d{i}.attr_id)" for i in range(len(source.attributes)))
    dicts = " ".join(f"JOIN dict d{i} ON d{i}.col_idx = {i} AND d{i}.value = r.{a}" for i, a in enumerate(source.attributes))
    return f"""raw AS ({_raw(source)}),
cells AS ({cells}),
dict AS (SELECT col_idx, value, row_number() OVER (ORDER BY col_idx, value) - 1 AS attr_id FROM (SELECT DISTINCT col_idx, value FROM cells)),
codes AS ({codes}),
obj AS (SELECT r.row_id, {ids} AS m, {props} FROM raw r {dicts} {joins})"""


def ids(m: str) -> str:
    return f"array_to_string(list_filter(range(0, 63), lambda i: ({m} >> i) & 1 = 1), ' ')"


def concept_ctes(source: Source, table: str = "obj", name: str = "") -> str:
    """d (distinct intents with counts), c (closed sets), x (closed sets with support and label counts)."""
    comps = range(len(source.labels))
    width = {"l0": 3}
    counts = [(f"n{i}_{v}", f"count(*) FILTER (WHERE p{i} = {v})") for i in comps for v in range(width["l0"])]
    return f"""d{name} AS (SELECT m, count(*) AS n, {', '.join(f'{e} AS {c}' for c, e in counts)} FROM {table} GROUP BY m),
c{name}(m) AS (SELECT m FROM d{name} UNION SELECT c{name}.m & d{name}.m FROM c{name}, d{name}),
x{name} AS (SELECT c.m, CAST(sum(n) AS BIGINT) AS n, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c, _ in counts)} FROM c{name} c JOIN d{name} d ON (d.m & c.m) = c.m GROUP BY c.m HAVING sum(n) >= 2)"""


def label_text(i: int, code: str) -> str:
    return f"CASE {code} WHEN -2 THEN '?' WHEN -1 THEN '*' ELSE (SELECT value FROM codes WHERE comp = {i} AND code = {code}) END"


UNANIMOUS = "CASE WHEN n0_0 = n THEN 0 WHEN n0_1 = n THEN 1 WHEN n0_2 = n THEN 2 ELSE -1 END"
MAJORITY = "CASE WHEN 2 * n0_0 - n > n // 2 THEN 0 WHEN 2 * n0_0 - n < -(n // 2) THEN 1 ELSE -1 END"


def mode(i: int) -> str:
    top = f"greatest(n{i}_0, n{i}_1, n{i}_2)"
    return f"CASE WHEN n{i}_0 = {top} THEN 0 WHEN n{i}_1 = {top} THEN 1 ELSE 2 END"


def bounded(b: int) -> str:
    return f"CASE WHEN 2 * n0_0 - n > n - {b} THEN 0 WHEN 2 * n0_0 - n < {b} - n THEN 1 ELSE -1 END"


def bounded_mode(b: int) -> str:
    top = "greatest(n0_0, n0_1, n0_2)"
    return f"CASE WHEN n = 1 OR {top} > n - {b} THEN {mode(0)} ELSE -1 END"


def concepts(source: Source) -> str:
    return f"WITH RECURSIVE {context_ctes(source)}, {concept_ctes(source)} SELECT {ids('m')} AS intent, n AS support FROM x"


def hypotheses(source: Source, *codes: str) -> str:
    named = ", ".join(f"{e} AS q{i}" for i, e in enumerate(codes))
    text = " || ' ' || ".join(label_text(i, f"q{i}") for i in range(len(codes)))
    some = " OR ".join(f"q{i} <> -1" for i in range(len(codes)))
    return f"WITH RECURSIVE {context_ctes(source)}, {concept_ctes(source)}, y AS (SELECT *, {named} FROM x) SELECT {ids('m')} AS intent, {text} AS label, n AS support FROM y WHERE {some}"


def many_labels(source: Source) -> str:
    """The mode of a label with many values, ties to the first value."""
    return f"""WITH RECURSIVE {context_ctes(source)},
d AS (SELECT DISTINCT m FROM obj), c(m) AS (SELECT m FROM d UNION SELECT c.m & d.m FROM c, d),
k AS (SELECT c.m, p0, count(*) AS k FROM c JOIN obj o ON (o.m & c.m) = c.m GROUP BY ALL),
x AS (SELECT m, CAST(sum(k) AS BIGINT) AS n, arg_min(p0, p0 - k * 10000000) AS q FROM k GROUP BY m HAVING sum(k) >= 2)
SELECT {ids('m')} AS intent, value AS label, n AS support FROM x JOIN codes ON comp = 0 AND code = q"""


def extent_weights(source: Source) -> str:
    return f"""WITH RECURSIVE {context_ctes(source)}, {concept_ctes(source)}
SELECT {ids('x.m')} AS intent, CAST(attr_id AS INTEGER) AS attr_id, count(*) AS weight FROM x JOIN obj o ON (o.m & x.m) = x.m JOIN dict ON (o.m >> attr_id) & 1 = 1 GROUP BY x.m, attr_id"""


def label_meets(source: Source) -> str:
    met = lambda a, b: f"CAST(CASE WHEN {a} = -2 THEN {b} WHEN {b} = -2 THEN {a} WHEN {a} = {b} THEN {a} ELSE -1 END AS INTEGER)"
    return f"""WITH {context_ctes(source)}, r AS (SELECT row_id, CASE WHEN row_id % 3 = 0 THEN -2 ELSE p0 END AS s, CAST(list_min(list_filter(range(0, 63), lambda i: (m >> i) & 1 = 1)) % 2 AS INTEGER) AS t FROM obj)
SELECT a.row_id, {met('a.s', 'b.s')} AS status, {met('a.t', 'b.t')} AS place FROM r a JOIN r b ON b.row_id = a.row_id + 1"""


def classwise(source: Source) -> str:
    return f"""WITH RECURSIVE {context_ctes(source)},
d AS (SELECT p0, m, count(*) AS n FROM obj GROUP BY ALL),
c(p0, m) AS (SELECT p0, m FROM d UNION SELECT c.p0, c.m & d.m FROM c JOIN d ON c.p0 = d.p0),
x AS (SELECT c.p0, c.m, CAST(sum(n) AS BIGINT) AS n FROM c JOIN d ON c.p0 = d.p0 AND (d.m & c.m) = c.m GROUP BY ALL HAVING sum(n) >= 2)
SELECT {ids('m')} AS intent, {label_text(0, 'p0')} AS label, n AS support FROM x"""


def _prediction_ctes(source: Source) -> str:
    """Trains on rows whose id is not a multiple of 5, predicts the others: p (row_id, m, q)."""
    return f"""{context_ctes(source)},
train AS (SELECT * FROM obj WHERE row_id % 5 <> 0), test AS (SELECT * FROM obj WHERE row_id % 5 = 0),
{concept_ctes(source, 'train')},
h AS (SELECT m, q FROM (SELECT m, {UNANIMOUS} AS q FROM x) WHERE q <> -1),
v AS (SELECT e.m, count(*) AS n, count(*) FILTER (WHERE q = 0) AS n0_0 FROM (SELECT DISTINCT m FROM test) e JOIN h ON (e.m & h.m) = h.m GROUP BY e.m),
p AS (SELECT t.row_id, t.m, t.p0, coalesce({MAJORITY}, -2) AS q FROM test t LEFT JOIN (SELECT * FROM v) v ON v.m = t.m)""".replace(
        "coalesce(CASE", "CASE WHEN v.m IS NULL THEN -2 ELSE (CASE"
    ).replace("END, -2) AS q FROM test", "END) END AS q FROM test")


def predict(source: Source) -> str:
    return f"WITH RECURSIVE {_prediction_ctes(source).replace('n // 2', 'v.n // 2')} SELECT row_id, {ids('m')} AS intent, {label_text(0, 'q')} AS label FROM p"


def evaluate(source: Source) -> str:
    return f"""WITH RECURSIVE {_prediction_ctes(source)}
SELECT count(*) FILTER (WHERE p0 = q) AS correct, count(*) FILTER (WHERE q = -2) AS unknown, count(*) FILTER (WHERE q = -1) AS conflicts, count(*) AS total,
100.0 * count(*) FILTER (WHERE p0 = q) / count(*) AS correct_pct, 100.0 * count(*) FILTER (WHERE q = -2) / count(*) AS unknown_pct, 100.0 * count(*) FILTER (WHERE q = -1) / count(*) AS conflicts_pct FROM p"""


def predict_all_rows(source: Source, folds: int) -> str:
    """Each of the folds (row_id modulo their number) by the model of all others."""
    parts = ", ".join(f"t{f} AS (SELECT * FROM obj WHERE row_id % {folds} <> {f}), {concept_ctes(source, f't{f}', f'_{f}')}" for f in range(folds))
    models = " UNION ALL ".join(f"SELECT {f} AS fold, m, {UNANIMOUS} AS q FROM x_{f}" for f in range(folds))
    return f"""WITH RECURSIVE {context_ctes(source)}, {parts},
h AS (SELECT * FROM ({models}) WHERE q <> -1),
e AS (SELECT DISTINCT m, row_id % {folds} AS fold FROM obj),
v AS (SELECT e.m, e.fold, count(*) AS n, count(*) FILTER (WHERE q = 0) AS n0_0 FROM e JOIN h ON h.fold = e.fold AND (e.m & h.m) = h.m GROUP BY ALL),
p AS (SELECT o.row_id, o.m, CASE WHEN v.n IS NULL THEN -2 ELSE {MAJORITY} END AS q FROM obj o LEFT JOIN v ON v.m = o.m AND v.fold = o.row_id % {folds})
SELECT row_id, {ids('m')} AS intent, {label_text(0, 'q')} AS label FROM p"""


def digest(*keys: str) -> str:
    """15 hexadecimal digits of an MD5 as a number."""
    text = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def chance(*keys: str) -> str:
    return f"(({digest(*keys)} >> 30) / 1073741824.0)"


def split(source: Source, a: int, b: int, seed: int) -> str:
    return f"WITH {context_ctes(source)} SELECT CASE WHEN {chance('row_id', str(seed))} < {a / (a + b)} THEN 'first' ELSE 'second' END AS part, row_id FROM obj"


def hypothesis_sample(source: Source, fraction: float, seed: int) -> str:
    kept = chance(ids("m"), "q", str(seed))
    return f"WITH RECURSIVE {context_ctes(source)}, {concept_ctes(source)}, y AS (SELECT *, {UNANIMOUS} AS q FROM x) SELECT {ids('m')} AS intent, {label_text(0, 'q')} AS label, n AS support FROM y WHERE q <> -1 AND {kept} < {fraction}"


def numeric_thresholds(columns: list[tuple[str, str]]) -> str:
    """All bisections of numeric columns (table, column): segments by recursion, then the cut of each."""
    parts = " UNION ALL ".join(f"SELECT {i} AS col_idx, CAST({c} AS DOUBLE) AS v FROM {t}" for i, (t, c) in enumerate(columns))
    ladder = """SELECT g.*, i AS candidate, a + i * ((b - a) / 25) AS cut FROM g, range(0, 25) t(i)"""
    scored = """SELECT col_idx, lo, hi, k, a, b, candidate, cut, coalesce(CAST(sum(n) FILTER (WHERE v < cut) AS DOUBLE), 0) * coalesce(CAST(sum(n) FILTER (WHERE v >= cut) AS DOUBLE), 0) AS balance,
       count(*) FILTER (WHERE v < cut) AS below, count(*) FILTER (WHERE v >= cut) AS above
FROM p JOIN o USING (col_idx, lo, hi) GROUP BY ALL"""
    best = f"""WITH o AS (SELECT s.col_idx, lo, hi, v, n FROM {{segments}} s JOIN h ON h.col_idx = s.col_idx AND v >= lo AND v < hi),
g AS (SELECT col_idx, lo, hi, count(*) AS k, min(v) AS a, max(v) AS b FROM o GROUP BY ALL),
p AS ({ladder}), q AS ({scored})
SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY col_idx, lo, hi ORDER BY balance DESC, candidate) = 1"""
    return f"""WITH RECURSIVE h AS (SELECT col_idx, v, count(*) AS n FROM ({parts}) GROUP BY ALL),
s(col_idx, lo, hi) AS (
  SELECT DISTINCT col_idx, CAST('-infinity' AS DOUBLE), CAST('infinity' AS DOUBLE) FROM h
  UNION ALL
  SELECT col_idx, CASE WHEN side = 0 THEN lo ELSE cut END, CASE WHEN side = 0 THEN cut ELSE hi END
  FROM ({best.format(segments="s")}) c, (VALUES (0), (1)) t(side) WHERE k > 2 AND balance > 0 AND CASE WHEN side = 0 THEN below ELSE above END >= 10)
SELECT col_idx, CAST(row_number() OVER (PARTITION BY col_idx ORDER BY threshold) - 1 AS INTEGER) AS place, threshold
FROM (SELECT col_idx, CASE WHEN k <= 2 OR balance = 0 THEN (a + b) / 2 ELSE cut END AS threshold FROM ({best.format(segments="s")}))"""


def encode_numeric(source: Source, columns: list[tuple[str, str]]) -> str:
    """Rows by the intervals of their numbers: that of the last threshold below, and the one before unless a threshold is met."""
    n = len(columns)
    sizes = ", ".join(f"(SELECT count(*) + 1 FROM t WHERE col_idx = {i}) AS s{i}" for i in range(n))
    offset = lambda i: " + ".join(f"s{j}" for j in range(i)) or "0"
    joins = " ".join(f"JOIN k k{i} ON k{i}.col_idx = {i} AND k{i}.v = CAST(r.a{i} AS DOUBLE)" for i in range(n))
    texts = " || ' ' || ".join(f"CASE WHEN k{i}.both THEN CAST({offset(i)} + k{i}.below - 1 AS VARCHAR) || ' ' ELSE '' END || CAST({offset(i)} + k{i}.below AS VARCHAR)" for i in range(n))
    values = " UNION ".join(f"SELECT {i} AS col_idx, CAST(a{i} AS DOUBLE) AS v FROM raw" for i in range(n))
    return f"""WITH raw AS ({_raw(source)}), t AS ({numeric_thresholds(columns)}), s AS (SELECT {sizes}), v AS ({values}),
k AS (SELECT v.col_idx, v.v, coalesce(b.place + 1, 0) AS below, b.place IS NOT NULL AND e.place IS NULL AS both
      FROM v ASOF LEFT JOIN t b ON b.col_idx = v.col_idx AND v.v > b.threshold LEFT JOIN t e ON e.col_idx = v.col_idx AND e.threshold = v.v)
SELECT r.row_id, {texts} AS intent, r.l0 AS label FROM raw r, s {joins}"""


def bagging(source: Source, folds: int, seed: int | None = None) -> str:
    """Folds by row_id modulo their number or, with a seed, independent samples of n div folds rows."""
    parts = []
    for f in range(folds):
        own = f"SELECT * FROM obj WHERE row_id % {folds} = {f}"
        if seed is not None:
            own = f"SELECT * FROM obj QUALIFY row_number() OVER (ORDER BY {digest('row_id', str(f), str(seed))}, row_id) <= (SELECT count(*) // {folds} FROM obj)"
        parts.append(f"t{f} AS ({own}), {concept_ctes(source, f't{f}', f'_{f}')}")
    models = " UNION ALL ".join(f"SELECT {f} AS fold, m, {UNANIMOUS} AS q FROM x_{f}" for f in range(folds))
    return f"""WITH RECURSIVE {context_ctes(source)}, {', '.join(parts)},
h AS (SELECT * FROM ({models}) WHERE q <> -1),
e AS (SELECT DISTINCT m FROM obj),
v AS (SELECT e.m, fold, count(*) AS n, count(*) FILTER (WHERE q = 0) AS n0_0 FROM e JOIN h ON (e.m & h.m) = h.m GROUP BY e.m, fold),
w AS (SELECT e.m, f.fold, CASE WHEN v.n IS NULL THEN -2 WHEN 2 * n0_0 - n > n // 2 THEN 0 WHEN 2 * n0_0 - n < -(n // 2) THEN 1 ELSE -1 END AS q
      FROM e CROSS JOIN (SELECT DISTINCT fold FROM h) f LEFT JOIN v ON v.m = e.m AND v.fold = f.fold),
k AS (SELECT m, q, count(*) AS votes FROM w GROUP BY m, q),
b AS (SELECT m, arg_min(q, votes * -100 + q) AS q FROM k GROUP BY m)
SELECT row_id, {label_text(0, 'q')} AS label FROM obj JOIN b USING (m)"""


def numeric_split(columns: dict[str, tuple[str, str]]) -> str:
    """The first bisection of numeric columns: {name: (table, column)}."""
    parts = " UNION ALL ".join(f"SELECT {i} AS col_idx, CAST({c} AS DOUBLE) AS v FROM {t}" for i, (t, c) in enumerate(columns.values()))
    return f"""WITH h AS (SELECT col_idx, v, count(*) AS n FROM ({parts}) GROUP BY ALL),
e AS (SELECT col_idx, min(v) AS a, max(v) AS b FROM h GROUP BY col_idx),
p AS (SELECT col_idx, CAST(i AS INTEGER) AS candidate, a + i * ((b - a) / 25) AS cut FROM e, range(0, 25) t(i)),
s AS (SELECT p.col_idx, candidate, cut, CAST(sum(n) FILTER (WHERE v < cut) AS DOUBLE) AS l, CAST(sum(n) FILTER (WHERE v >= cut) AS DOUBLE) AS r FROM p JOIN h ON p.col_idx = h.col_idx GROUP BY ALL)
SELECT col_idx, candidate, cut AS "pivot" FROM s QUALIFY row_number() OVER (PARTITION BY col_idx ORDER BY coalesce(l, 0) * coalesce(r, 0) DESC, candidate) = 1"""


def oracles() -> dict[str, str]:
    e = context_ctes(EVENTS)
    return {
        "value_distribution": f"WITH {e} SELECT col_idx, value, count(*) AS cnt FROM cells GROUP BY ALL",
        "label_distribution": f"WITH {e} SELECT col_idx, value, string_agg(DISTINCT l0, '|' ORDER BY l0) AS labels FROM cells JOIN raw USING (row_id) GROUP BY ALL",
        "column_kinds": "WITH c AS (SELECT 0 AS col_idx, CAST(l_quantity AS VARCHAR) AS value FROM lineitem UNION ALL SELECT 1, CAST(l_linenumber AS VARCHAR) FROM lineitem UNION ALL SELECT 2, l_returnflag FROM lineitem) SELECT col_idx, count(DISTINCT value) AS n_values, bool_and(TRY_CAST(value AS DOUBLE) IS NOT NULL) AND count(DISTINCT value) > 10 AS numeric FROM c GROUP BY col_idx",
        "attribute_dictionary": f"WITH {e} SELECT col_idx, value, CAST(attr_id AS INTEGER) AS attr_id FROM dict",
        "encode_nominal": f"WITH {e} SELECT row_id, {ids('m')} AS intent, {label_text(0, 'p0')} AS label FROM obj",
        "numeric_first_split": numeric_split({"quantity": ("lineitem", "l_quantity"), "size": ("part", "p_size"), "price": ("orders", "o_totalprice")}),
        "numeric_scale": "SELECT p_partkey AS row_id, CASE WHEN p_size <= 10 THEN '5' WHEN p_size < 20 THEN '5 6' WHEN p_size = 20 THEN '6' WHEN p_size < 40 THEN '6 7' WHEN p_size = 40 THEN '7' ELSE '7 8' END AS intent FROM part",
        "density": f"WITH {e} SELECT 100.0 * sum(bit_count(m)) / (count(*) * (SELECT count(*) FROM dict)) AS density FROM obj",
        "attribute_support": f"WITH {e} SELECT CAST(attr_id AS INTEGER) AS attr_id, count(*) AS support FROM cells JOIN dict USING (col_idx, value) GROUP BY attr_id",
        "attribute_order": f"WITH {e}, s AS (SELECT attr_id, count(*) AS k FROM cells JOIN dict USING (col_idx, value) GROUP BY attr_id) SELECT CAST(attr_id AS INTEGER) AS attr_id, CAST(row_number() OVER (ORDER BY k, attr_id) - 1 AS INTEGER) AS new_id FROM s",
        "reordered_rows": f"WITH {e}, s AS (SELECT attr_id, count(*) AS k FROM cells JOIN dict USING (col_idx, value) GROUP BY attr_id), o AS (SELECT attr_id, row_number() OVER (ORDER BY k, attr_id) - 1 AS new_id FROM s) SELECT row_id, string_agg(CAST(new_id AS VARCHAR), ' ' ORDER BY new_id) AS intent, {label_text(0, 'any_value(p0)')} AS label FROM obj JOIN o ON (m >> attr_id) & 1 = 1 GROUP BY row_id",
        "root_concept": f"WITH {e} SELECT {ids('bit_and(m)')} AS intent, count(*) AS support FROM obj",
        "closure_step": f"WITH {e} SELECT CAST(a.attr_id AS INTEGER) AS attr_id, {ids('bit_and(m)')} AS intent, count(*) AS support FROM dict a JOIN obj ON (m >> a.attr_id) & 1 = 1 GROUP BY a.attr_id",
        "concepts_customer": concepts(CUSTOMER),
        "concepts_events": concepts(EVENTS),
        "concepts_lineitem": concepts(LINEITEM),
        "concepts_part": concepts(PART),
        "classwise_concepts": classwise(CUSTOMER),
        "hyp_no_counter": hypotheses(CUSTOMER, UNANIMOUS),
        "hyp_no_counter_events": hypotheses(EVENTS, UNANIMOUS),
        "hyp_no_counter_lineitem": hypotheses(LINEITEM, UNANIMOUS),
        "hyp_majority": hypotheses(EVENTS, MAJORITY),
        "hyp_bounded": hypotheses(EVENTS, bounded(3)),
        "hyp_ordinal_mode": hypotheses(ORDERS, mode(0)),
        "hyp_ordinal_bounded": hypotheses(ORDERS, bounded_mode(150)),
        "hyp_composite": hypotheses(GRADED, mode(0), mode(1)),
        "hyp_composite_bounded": hypotheses(GRADED, mode(0), mode(1)),
        "hyp_many_labels": many_labels(BUYERS),
        "extent_weights": extent_weights(ORDERS),
        "label_meets": label_meets(ORDERS),
        "label_descriptor": f"WITH {context_ctes(GRADED)} SELECT comp AS component, CASE WHEN count(*) = 2 THEN 'B' ELSE 'O' END AS kind, string_agg(value, '|' ORDER BY value) AS labels FROM codes GROUP BY comp",
        "encode_numeric": encode_numeric(PRICES, [("lineitem", "l_quantity"), ("lineitem", "l_extendedprice")]),
        "label_codes": f"WITH {context_ctes(BUYERS)} SELECT row_id, p0 AS code, {label_text(0, 'p0')} AS label FROM obj",
        "label_table_file": f"WITH {context_ctes(BUYERS)} SELECT {ids('m')} || ' | ' || value AS line FROM obj JOIN codes ON comp = 0 AND code = p0",
        "command_encode": f"WITH {context_ctes(CUSTOMER)} SELECT {ids('m')} || ' | ' || {label_text(0, 'p0')} AS line FROM obj",
        "command_split": f"WITH {e}, n AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS place FROM obj) SELECT CASE WHEN {chance('place', '4')} < 0.7 THEN 'first' ELSE 'second' END AS part, {ids('m')} || ' | ' || {label_text(0, 'p0')} AS line FROM n",
        "command_induce": f"SELECT intent || ' | ' || label AS line FROM ({predict(EVENTS)})",
        "command_generate_predict": evaluate(EVENTS),
        "command_mask": f"WITH {context_ctes(GRADED)} SELECT {ids('m')} || ' | ? ?' AS line FROM obj",
        "prediction_file": f"SELECT intent || ' | ' || label AS line FROM ({predict(EVENTS)})",
        "csv_context": f"WITH {context_ctes(CUSTOMER)} SELECT {ids('m')} || ' | ' || {label_text(0, 'p0')} AS line FROM obj",
        "csv_cells": "SELECT doc_id, coalesce(lang, '') AS lang, md5(coalesce(text, '')) AS text_md5 FROM documents",
        "mask_labels": f"WITH {context_ctes(GRADED)} SELECT row_id, {ids('m')} AS intent, '? ?' AS label FROM obj",
        "predict": predict(EVENTS),
        "predict_all_rows": predict_all_rows(EVENTS, 5),
        "evaluate": evaluate(EVENTS),
        "bagging": bagging(CUSTOMER, 3),
        "bagging_random": bagging(CUSTOMER, 8, 3),
        "split": split(EVENTS, 8, 2, 1),
        "hypothesis_sample": hypothesis_sample(EVENTS, 0.5, 5),
        "numeric_thresholds": numeric_thresholds([("lineitem", "l_quantity"), ("lineitem", "l_extendedprice")]),
        "label_algebra": "SELECT a, b, CASE WHEN a = -2 THEN b WHEN b = -2 THEN a WHEN a = b THEN a ELSE -1 END AS met FROM (SELECT CAST(i AS INTEGER) - 2 AS a FROM range(0, 5) t(i)) CROSS JOIN (SELECT CAST(i AS INTEGER) - 2 AS b FROM range(0, 5) t(i))",
        "set_algebra": f"WITH {e}, k AS (SELECT row_id, m, xor(m, (m & 1023) * 3) & 1023 AS o FROM obj) SELECT row_id, {ids('m & o')} AS met, {ids('m & 255')} AS upto, (m & 255) = (o & 255) AS same_until, (m & 960) = (o & 960) AS same_within, (m & o) = m AS inside, CAST(bit_count(m) AS INTEGER) AS size, (m >> 3) & 1 = 1 AS holds, {ids('m | 8')} AS added FROM k",
        "transaction_file": f"WITH {context_ctes(CUSTOMER)} SELECT {ids('m')} || ' | ' || {label_text(0, 'p0')} AS line FROM obj",
    }
