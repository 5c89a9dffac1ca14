"""The same questions in plain SQL, for a side-by-side check on another engine."""

from __future__ import annotations

import re

from askgauge.functions.fixed_values import (
    AGGREGATE_NAMES,
    CHAT_SYSTEM,
    COMPARISONS,
    DISTRACTORS,
    PREDICATE_PATTERNS,
    QUESTION_PROMPT,
    QUESTION_STYLES,
    REWRITE_PROMPTS,
    RICHNESS_PROMPT,
    SQL_START_WORDS,
    SQL_WORDS,
    STOP_WORDS,
)
from askgauge.functions.vectors import unit_directions
from askgauge.plans.inputs import QUERY_PAIRS

SLICES = 64
SETS, SET_SIZE, SET_SLICES = 20, 100, 16
JOINT_CAP = 200

ORACLE: dict[str, str] = {}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- vectors -----------------------------------------------------------------------------

VECTORS = """v AS (SELECT vec_id, label, CASE WHEN label < 5 THEN 'source' ELSE 'target' END AS side,
  embedding::DOUBLE[] AS e, 0 AS k FROM embeddings)"""


def directions(count: int) -> str:
    rows = ", ".join(
        f"({i}, [{', '.join(repr(float(x)) for x in row)}])" for i, row in enumerate(unit_directions(64, count))
    )
    return f"dirs(dir, u) AS (VALUES {rows})"


# Per key k: one row with the five numbers, from v(k, side, e).
MOMENTS = """x AS (SELECT k, side, unnest(e) AS val, generate_subscripts(e, 1) AS i FROM v),
st AS (SELECT k, side, i, avg(val) AS mu, var_pop(val) + 1e-8 AS s2 FROM x GROUP BY ALL),
fr AS (SELECT s.k, sum((t.mu - s.mu) ** 2) AS mean_shift, sum((sqrt(t.s2 / s.s2) - 1) ** 2) AS scale_shift
  FROM st s JOIN st t ON s.k = t.k AND s.i = t.i AND s.side = 'source' AND t.side = 'target' GROUP BY s.k),
nv AS (SELECT *, row_number() OVER () AS rid FROM v WHERE side = 'target'),
xd AS (SELECT k, rid, unnest(e) AS val, generate_subscripts(e, 1) AS i FROM nv),
di AS (SELECT xd.k, rid, sqrt(sum((val - mu) ** 2 / s2)) AS dist
  FROM xd JOIN st ON xd.k = st.k AND xd.i = st.i AND st.side = 'source' GROUP BY ALL),
mh AS (SELECT k, avg(dist) AS dist_mean, stddev_pop(dist) AS dist_std FROM di GROUP BY k)"""
SLICED = """p AS (SELECT k, side, dir, list_dot_product(e, u) AS val FROM v, dirs),
r AS (SELECT *, row_number() OVER (PARTITION BY k, side, dir ORDER BY val) AS rk FROM p),
g AS (SELECT s.k, s.dir, sqrt(avg((t.val - s.val) ** 2)) AS gap FROM r s JOIN r t
  ON s.k = t.k AND s.dir = t.dir AND s.rk = t.rk AND s.side = 'source' AND t.side = 'target' GROUP BY ALL),
sw AS (SELECT k, avg(gap) AS swd FROM g GROUP BY k)"""
FIVE = """round(mean_shift, 6) AS mean_shift, round(scale_shift, 6) AS scale_shift,
  round(dist_mean, 6) AS dist_mean, round(dist_std, 6) AS dist_std, round(swd, 6) AS swd"""

ORACLE["shift_delta"] = f"""WITH {VECTORS}, {directions(SLICES)}, {MOMENTS}, {SLICED}
SELECT {FIVE} FROM fr JOIN mh USING (k) JOIN sw USING (k)"""
ORACLE["shift_frechet"] = f"""WITH {VECTORS}, {MOMENTS}
SELECT round(mean_shift, 6) AS mean_shift, round(scale_shift, 6) AS scale_shift FROM fr"""
ORACLE["shift_mahalanobis"] = f"""WITH {VECTORS}, {MOMENTS}
SELECT round(dist_mean, 6) AS dist_mean, round(dist_std, 6) AS dist_std FROM mh"""
ORACLE["shift_swd"] = f"""WITH {VECTORS}, {directions(SLICES)}, {SLICED}
SELECT round(swd, 6) AS swd FROM sw"""
ORACLE["shift_report"] = f"""WITH {VECTORS}, {directions(SLICES)}, {MOMENTS}, {SLICED},
c AS (SELECT count(*) FILTER (side = 'source' AND e IS NOT NULL) AS source_count,
  count(*) FILTER (side = 'target' AND e IS NOT NULL) AS target_count,
  count(*) FILTER (side = 'source' AND e IS NULL) AS source_skipped,
  count(*) FILTER (side = 'target' AND e IS NULL) AS target_skipped FROM v)
SELECT c.*, {FIVE} FROM c, fr JOIN mh USING (k) JOIN sw USING (k)"""
ORACLE["shift_multi_pairs"] = f"""WITH
v AS (SELECT l.label AS k, 'source' AS side, embedding::DOUBLE[] AS e FROM embeddings e JOIN
    (SELECT DISTINCT label FROM embeddings) l ON e.label = l.label
  UNION ALL
  SELECT l.label AS k, 'target' AS side, embedding::DOUBLE[] AS e FROM embeddings e JOIN
    (SELECT DISTINCT label FROM embeddings) l ON e.label = (l.label + 1) % 10),
{directions(SET_SLICES)}, {MOMENTS}, {SLICED}
SELECT k AS pair_id, {FIVE} FROM fr JOIN mh USING (k) JOIN sw USING (k)"""
ORACLE["joint_subsample"] = f"""WITH {VECTORS}
SELECT vec_id, side FROM v ORDER BY md5('0|' || vec_id) LIMIT {JOINT_CAP}"""
ORACLE["scan_embeddings"] = """SELECT vec_id, len(embedding)::INTEGER AS dim,
  round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings"""
ORACLE["mean_pool"] = """WITH x AS (SELECT label, (embedding[1] > 0)::INTEGER AS mask,
  unnest(embedding::DOUBLE[]) AS val, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
SELECT label, dim::INTEGER AS dim, round(sum(val * mask) / greatest(sum(mask), 1e-6), 6) AS value
FROM x GROUP BY label, dim"""

# --- subsets -----------------------------------------------------------------------------

MEMBERS = f"""tv AS (SELECT vec_id AS rec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label >= 5),
m AS (SELECT set_id, rec_id FROM (SELECT set_id, rec_id, row_number() OVER (
    PARTITION BY set_id ORDER BY md5('0|' || set_id || '|' || rec_id)) AS r
  FROM (SELECT unnest(range({SETS}))::INTEGER AS set_id), tv) WHERE r <= {SET_SIZE})"""
ORACLE["sample_sets"] = f"WITH {MEMBERS} SELECT set_id, rec_id FROM m"
ORACLE["sample_set_accuracy"] = f"""WITH {MEMBERS}
SELECT set_id, round(avg((label % 2)::DOUBLE), 6) AS accuracy, count(*) AS n
FROM m JOIN tv USING (rec_id) GROUP BY set_id"""
ORACLE["shift_by_set"] = f"""WITH {MEMBERS},
v AS (SELECT set_id AS k, 'target' AS side, e FROM m JOIN tv USING (rec_id) UNION ALL
  SELECT s.set_id AS k, 'source' AS side, embedding::DOUBLE[] AS e
  FROM embeddings, (SELECT DISTINCT set_id FROM m) s WHERE label < 5),
{directions(SET_SLICES)}, {MOMENTS}, {SLICED}
SELECT k AS set_id, {FIVE} FROM fr JOIN mh USING (k) JOIN sw USING (k)"""
ORACLE["holdout_split"] = """WITH n AS (SELECT count(*) AS n FROM orders),
k AS (SELECT ceil(round(least(0.2::DOUBLE, greatest(2, floor(n * 0.2::DOUBLE)) / n) * n, 9))::BIGINT AS k FROM n),
r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('0|' || o_orderkey)) AS r FROM orders)
SELECT o_orderkey, (r <= k)::INTEGER AS is_holdout FROM r, k"""
ORACLE["mae_report"] = """SELECT l_returnflag, l_linestatus, round(avg(abs(l_discount - l_tax)), 6) AS mae,
  round(1.96 * stddev_samp(abs(l_discount - l_tax)) / sqrt(count(*)), 6) AS ci95, count(*) AS n
FROM lineitem GROUP BY l_returnflag, l_linestatus"""
ORACLE["generate_text"] = """SELECT conv_id, turn, 'SELECT ' || turn AS output FROM conversations"""
ORACLE["embed_texts_hashed"] = """SELECT conv_id, turn, 64::INTEGER AS dim,
  CASE WHEN regexp_matches(text, '[A-Za-z0-9_]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM conversations"""

# --- execution accuracy ------------------------------------------------------------------

# Scores that no engine needs to be asked for: unknown column, blank text, unknown database, command.
GIVEN_SCORES = {"04": 0, "07": 0, "12": 1, "13": 0}
# Pairs whose bags differ in width or column types, with both sizes compared instead.
EMPTY_PAIRS = {"06"}


def _pair_score(pair: tuple[str, str, str, str]) -> str:
    name, db_id, gold, pred = pair
    # Double-quoted values are written in single quotes here, where double quotes mean names.
    gold, pred = (re.sub('"([^"]*)"', lambda m: lit(m[1]), q.removesuffix(" -- end").rstrip(" ;")) for q in (gold, pred))
    if name in GIVEN_SCORES:
        same = str(bool(GIVEN_SCORES[name])).lower()
    elif not pred:
        same = f"(SELECT count(*) FROM ({gold})) = 0"
    elif name in EMPTY_PAIRS:
        same = f"(SELECT count(*) FROM ({gold})) = 0 AND (SELECT count(*) FROM ({pred})) = 0"
    elif name == "03":
        same = f"(SELECT round(a, 6) = round(b, 6) FROM ({gold}) AS x(a), ({pred}) AS y(b))"
    elif name == "09":
        same = "false"
    else:
        same = (
            f"NOT EXISTS (SELECT * FROM ({gold}) EXCEPT ALL SELECT * FROM ({pred})) AND "
            f"NOT EXISTS (SELECT * FROM ({pred}) EXCEPT ALL SELECT * FROM ({gold}))"
        )
    return f"SELECT '{name}' AS id, '{db_id}' AS db_id, CASE WHEN {same} THEN 1.0 ELSE 0.0 END::DOUBLE AS execution_accuracy"


ORACLE["exec_accuracy_samples"] = "\nUNION ALL\n".join(_pair_score(p) for p in QUERY_PAIRS)
ORACLE["exec_accuracy_summary"] = f"""SELECT round(coalesce(avg(execution_accuracy), 0), 6) AS execution_accuracy,
  count(*) AS num_samples FROM ({ORACLE["exec_accuracy_samples"]})"""
ORACLE["bag_compare"] = """WITH b AS (
  SELECT l_linenumber AS pair_id, l_orderkey, l_returnflag, round(l_extendedprice, 6) AS price, 1 AS cnt FROM lineitem
  UNION ALL
  SELECT l_linenumber, l_orderkey, l_returnflag,
    round(l_extendedprice + CASE WHEN l_linenumber % 2 = 1 THEN 1e-9 ELSE 0.01 END, 6), -1 FROM lineitem),
r AS (SELECT pair_id, l_orderkey, l_returnflag, price, sum(cnt) AS diff FROM b GROUP BY ALL)
SELECT pair_id, bool_and(diff = 0)::INTEGER AS equal FROM r GROUP BY pair_id"""

LOG = """lg AS (SELECT event_id, 'db' || (user_id % 5) AS db_id, CASE event_type
  WHEN 'click' THEN 'SELECT  user_id,' || chr(9) || 'value FROM events WHERE user_id = ' || user_id || ' ;'
  WHEN 'view' THEN 'select "value" from "events" WHERE event_type = ''View -- All''  -- event ' || event_id
  WHEN 'purchase' THEN 'SELECT COUNT(*), AVG(value) FROM events JOIN users ON events.user_id = users.user_id WHERE note = "It''s  A -- /* B" AND value > ' || user_id
  WHEN 'error' THEN 'SELECT MAX("value") FROM "events" /* user ' || user_id || ' */ GROUP BY user_id HAVING SUM("value") >= 10;'
  ELSE 'SELECT user_id FROM Events WHERE value BETWEEN 1 AND ' || user_id || ' OR user_id IN (1, 2)' END AS sql
  FROM events)"""
# Two passes over a query: comments become blanks, then what is not quoted is folded.
NORM = r"""regexp_replace(array_to_string(list_transform(regexp_extract_all(
    array_to_string(list_transform(regexp_extract_all(coalesce(sql, ''), '''[^'']*''|"[^"]*"|--[^\n]*|/\*[^*]*\*/|[^''"/-]+|[''"/-]'),
      lambda p: CASE WHEN p[1:2] IN ('--', '/*') THEN ' ' ELSE p END), ''),
    '''[^'']*''|"[^"]*"|[^''"]+|[''"]'),
  lambda p: CASE WHEN p[1] IN ('''', '"') THEN p ELSE lower(regexp_replace(p, '\s+', ' ', 'g')) END), ''), '^\s+|[\s;]+$', '', 'g')"""
ORACLE["sql_normalize"] = f"WITH {LOG} SELECT event_id, {NORM} AS norm FROM lg"
ORACLE["unique_queries"] = f"""WITH {LOG}, n AS (SELECT db_id, sql, {NORM} AS norm FROM lg)
SELECT md5(db_id || '|' || norm) AS query_id, db_id, norm, min(sql) AS sql, count(*) AS uses
FROM n GROUP BY db_id, norm"""


def _predicates() -> str:
    return " UNION ALL ".join(
        f"SELECT event_id, 'predicate' AS kind, '{name}' AS name FROM o WHERE regexp_matches(s, {lit(pattern)})"
        for name, pattern in PREDICATE_PATTERNS.items()
    )


_SQL_TOKEN = r"""'[^']*(?:''[^']*)*'|"[^"]*(?:""[^"]*)*"|`[^`]*`|--[^\n]*|/\*[^*]*\*/|[A-Za-z_][A-Za-z_0-9]*|[0-9][0-9.]*|<>|!=|<=|>=|==|\S"""
_IN = lambda words: "(" + ", ".join(lit(w) for w in words) + ")"
# Tokens (x) with those around them (p, p2, p3 before, y behind) and the names among them.
TOKENS = rf"""tk AS (SELECT event_id, list_filter(regexp_extract_all(sql, {lit(_SQL_TOKEN)}), lambda z: z[1:2] NOT IN ('--', '/*')) AS t FROM lg),
w AS (SELECT event_id, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM tk),
n AS (SELECT *, coalesce(upper(lag(x) OVER o), '') AS p, coalesce(upper(lag(x, 2) OVER o), '') AS p2, coalesce(upper(lag(x, 3) OVER o), '') AS p3,
  coalesce(lead(x) OVER o, '') AS y FROM w WINDOW o AS (PARTITION BY event_id ORDER BY i)),
m AS (SELECT *, x[1] IN ('"', '`') AS quoted, p IN ('FROM', 'JOIN') OR (p = '.' AND p3 IN ('FROM', 'JOIN')) AS source,
  lower(CASE WHEN x[1] IN ('"', '`') THEN substr(x, 2, length(x) - 2) ELSE x END) AS name FROM n
  WHERE (regexp_matches(x, '^[A-Za-z_]') AND upper(x) NOT IN {_IN(SQL_WORDS)}) OR x[1] = '`'
    OR (x[1] = '"' AND (y = '.' OR NOT (p IN {_IN(COMPARISONS)} OR (p = '(' AND p2 = 'IN')))))"""
ORACLE["sql_components"] = rf"""WITH {LOG}, {TOKENS},
o AS (SELECT event_id, string_agg(CASE WHEN x[1] IN ('''', '"', '`') THEN '''''' ELSE x END, ' ' ORDER BY i) AS s FROM w GROUP BY event_id),
t AS (SELECT DISTINCT event_id, name FROM m WHERE source AND y <> '.'),
q AS (SELECT DISTINCT event_id, name FROM m WHERE quoted),
a AS (SELECT DISTINCT event_id, upper(unnest(regexp_extract_all(s, '(?i)\b({"|".join(AGGREGATE_NAMES)})\s*\(', 1))) AS name FROM o),
f AS (SELECT event_id, 'table' AS kind, name FROM t
  UNION ALL SELECT event_id, 'column', name FROM (SELECT * FROM q EXCEPT SELECT * FROM t)
  UNION ALL SELECT event_id, 'aggregate', name FROM a
  UNION ALL {_predicates()})
SELECT kind, name, count(*) AS queries FROM f GROUP BY kind, name""".replace(r"\'", "'")
ORACLE["sql_columns"] = rf"""WITH {LOG}, {TOKENS}
SELECT name, count(DISTINCT event_id) AS queries FROM m
WHERE NOT source AND y NOT IN ('(', '.') AND p NOT IN ('AS', 'WITH')
  AND NOT (regexp_matches(p, {lit("""^[A-Z_0-9"'`)]""")}) AND p NOT IN {_IN(SQL_WORDS)}) GROUP BY name"""
ORACLE["align_gold_pred"] = """WITH t AS (SELECT *, 'db' || (conv_id % 7) AS db_id FROM conversations)
SELECT g.conv_id || ':' || g.turn AS id, g.db_id, g.text AS gold_sql, coalesce(p.text, '') AS pred_sql
FROM t g LEFT JOIN t p ON p.role = 'assistant' AND p.conv_id = g.conv_id AND p.turn = g.turn + 1
WHERE g.role = 'user'"""

# --- text --------------------------------------------------------------------------------

STRIP = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
ANSWERS = """a AS (SELECT conv_id, turn, CASE turn % 5
  WHEN 0 THEN text || chr(10) || '```sql' || chr(10) || 'SELECT a FROM t WHERE note = ''' || role || '''' || chr(10) || '```' || chr(10) || 'done'
  WHEN 1 THEN '```' || chr(10) || ' ' || chr(10) || '```' || text || '``` SQL' || chr(10) || 'WITH x AS (SELECT 1) SELECT * FROM x ``` end'
  WHEN 2 THEN text || ' update t set a = 1; select 2 '
  WHEN 3 THEN '  ' || text
  ELSE '' END AS t FROM conversations)"""
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEYWORD_CASES = " ".join(
    f"WHEN instr(up, '{w}') > 0 THEN {STRIP(f'substr(t, instr(up, {lit(w)}))')}" for w in SQL_START_WORDS
)
ORACLE["extract_sql"] = rf"""WITH {ANSWERS},
b AS (SELECT conv_id, turn, t, translate(t, '{LOWER}', '{UPPER}') AS up,
  list_filter(list_transform(list_filter(string_split(t, '```'), lambda x, i: i % 2 = 0),
    lambda x: regexp_replace({STRIP("x")}, '^(?i:sql)\s*', '')), lambda x: x <> '') AS blocks FROM a)
SELECT conv_id, turn, CASE WHEN len(blocks) > 0 THEN blocks[1] {KEYWORD_CASES}
  ELSE {STRIP(rf"string_split_regex({STRIP('t')}, '\r\n|\n|\r')[1]")} END AS sql FROM b"""
ORACLE["select_text_field"] = """SELECT coalesce(nullif(gold_sql, ''), nullif(query, '')) AS text FROM (
  SELECT CASE WHEN role = 'assistant' THEN text ELSE '' END AS gold_sql,
    CASE WHEN role = 'user' THEN 'q ' || text END AS query FROM conversations)
WHERE coalesce(nullif(gold_sql, ''), nullif(query, '')) IS NOT NULL"""
ORACLE["field_texts_skipped"] = r"""SELECT count(*) FILTER (role <> 'system' AND regexp_matches(text, '\S')) AS kept,
  count(*) FILTER (NOT (role <> 'system' AND regexp_matches(text, '\S'))) AS skipped FROM conversations"""
LANG_SUMS = ", ".join(
    f"sum((w IN ({', '.join(lit(x) for x in words)}))::INTEGER) AS {lang}" for lang, words in STOP_WORDS.items()
)
DETECTED = rf"""w AS (SELECT doc_id, lang AS actual, unnest(string_split_regex(lower(text), '\s+')) AS w FROM documents),
s AS (SELECT doc_id, actual, {LANG_SUMS} FROM w GROUP BY doc_id, actual),
det AS (SELECT doc_id, actual AS lang, CASE WHEN greatest(en, de, fr, es) = 0 THEN NULL
  {" ".join(f"WHEN {x} = greatest(en, de, fr, es) THEN '{x}'" for x in STOP_WORDS)} END AS detected FROM s)"""
ORACLE["language_filter"] = f"WITH {DETECTED} SELECT doc_id, lang, detected FROM det"
ORACLE["language_accuracy"] = f"""WITH {DETECTED}
SELECT lang, count(*) AS n, count(*) FILTER (lang = detected) AS hits FROM det GROUP BY lang"""
ORACLE["clean_names"] = """SELECT p_partkey, replace(lower(trim('  ' || p_name || ' ' || p_type || ' ')), ' ', '_') AS clean_name FROM part"""
PARTS = """pt AS (SELECT *, p_size % 2 = 1 AS odd, p_size > 40 AS big, p_size < 4 AS tiny,
  string_split(p_name, ' ') AS w FROM part),
sc AS (SELECT *, 'Table ' || CASE WHEN tiny THEN 'unknown_table' ELSE replace(p_brand, '#', '_') END
  || CASE WHEN odd AND p_type <> '' THEN ' (' || p_type || ')' ELSE '' END
  || CASE WHEN big THEN ' has no columns listed.' ELSE ' has columns: ' || w[1]
    || CASE WHEN odd THEN ' (type: text; comment: ' || p_type || '; primary key)' ELSE ' (primary key)' END
    || ', ' || w[2] || CASE WHEN odd THEN '' ELSE ' (type: number)' END || '.' END
  || CASE WHEN odd THEN ' Foreign keys: ' || p_brand || '.a -> ' || p_type || '.b.' ELSE '' END AS st FROM pt),
pr AS (SELECT p_partkey::VARCHAR AS id, st, p_size, p_brand,
  'Question: ' || CASE WHEN NOT tiny THEN 'How many ' || p_name || '?' WHEN odd THEN p_type END
  || ' Schema: ' || CASE WHEN NOT big THEN st END AS prompt FROM sc)"""
ORACLE["schema_to_prompt"] = f"WITH {PARTS} SELECT id, st AS schema_text FROM pr"
ORACLE["record_prompt"] = f"WITH {PARTS} SELECT id, prompt FROM pr"
ORACLE["prompt_records"] = f"""WITH {PARTS}
SELECT p_brand AS db_id, prompt, 'SELECT ' || p_size AS gold_sql FROM pr WHERE prompt IS NOT NULL AND p_size <> 10"""
ORACLE["chat_prompts"] = f"""SELECT conv_id, turn, {lit("System: " + CHAT_SYSTEM)} || chr(10) || 'User: ' || text || chr(10) || 'Assistant:' AS chat
FROM conversations WHERE role = 'user'"""


def split_lines(source: str, column: str) -> str:
    return rf"""SELECT conv_id, turn, {STRIP("line")} AS line, pos FROM (SELECT conv_id, turn,
  unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT conv_id, turn, string_split_regex({column}, '\r\n|\n|\r') AS l FROM {source}))"""


ORACLE["output_lines"] = f"""WITH l AS ({split_lines("conversations", "text")}),
r AS (SELECT conv_id, turn, line, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) - 1 AS idx
  FROM l WHERE line <> '')
SELECT conv_id, turn, idx::INTEGER AS idx, line FROM r"""
ORACLE["qa_pairs"] = rf"""WITH a AS (SELECT conv_id, turn, CASE turn % 3
  WHEN 0 THEN 'Q: ' || replace(text, chr(10), ' ') || chr(10) || chr(10) || 'note' || chr(10) || ' A: SELECT 1' || chr(10) || 'A: SELECT 2'
  WHEN 1 THEN 'A: none' || chr(10) || 'Q: first' || chr(10) || 'Q: ' || replace(text, chr(10), ' ') || chr(10) || 'A: '
    || replace(text, chr(10), ' ') || chr(10) || 'Q: open'
  ELSE text END AS output FROM conversations),
l AS ({split_lines("a", "output")}),
k AS (SELECT *, substr(line, 1, 2) AS kind, {STRIP("substr(line, 3)")} AS body FROM l
  WHERE line LIKE 'Q:%' OR line LIKE 'A:%'),
p AS (SELECT *, lag(kind) OVER o AS before, lag(body) OVER o AS question FROM k
  WINDOW o AS (PARTITION BY conv_id, turn ORDER BY pos))
SELECT conv_id, turn, question, body AS answer FROM p WHERE kind = 'A:' AND before = 'Q:'"""

# --- cells -------------------------------------------------------------------------------

COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ],
}
MONEY = {
    "c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
}
DATES = {"o_orderdate", "l_shipdate"}
ROW_KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
    "part": "p_partkey", "orders": "o_orderkey", "lineitem": "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey",
}


def _cell_text(name: str) -> str:
    if name in MONEY:
        return f"CAST(CAST({name} AS DECIMAL(18, 2)) AS VARCHAR)"
    if name in DATES:
        return f"strftime({name}, '%Y-%m-%d')"
    return f"CAST({name} AS VARCHAR)"


CELLS = "cells AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_id, {ROW_KEYS[t]} AS row_idx, {i} AS col_idx, '{c}' AS col_name, {_cell_text(c)} AS value FROM {t}"
    for t, columns in COLUMNS.items()
    for i, c in enumerate(columns)
) + ")"
PROFILE = """prof AS (SELECT table_id, count(*) FILTER (col_idx = 0) AS n_rows,
  (max(col_idx) + 1)::BIGINT AS n_cols FROM cells GROUP BY table_id)"""
ORACLE["table_profile"] = f"WITH {CELLS}, {PROFILE} SELECT * FROM prof"
ORACLE["structural_filter"] = f"WITH {CELLS}, {PROFILE} SELECT * FROM prof WHERE n_rows >= 5 AND n_cols >= 5"
ORACLE["semantic_richness"] = rf"""WITH {CELLS},
w AS (SELECT table_id, unnest(string_split_regex(lower(coalesce(value, 'nan')), '\s+')) AS w FROM cells),
d AS (SELECT table_id, count(DISTINCT w) AS n FROM w WHERE w <> '' GROUP BY table_id),
c AS (SELECT table_id, count(*) AS n FROM cells GROUP BY table_id)
SELECT table_id, round(least(1.0::DOUBLE, coalesce(d.n, 0)::DOUBLE / c.n), 6) AS richness FROM c LEFT JOIN d USING (table_id)"""
ORACLE["infer_foreign_keys"] = f"""WITH {CELLS},
f AS (SELECT * FROM cells),
v AS (SELECT DISTINCT table_id, col_name, coalesce(value, 'nan') AS value FROM f ),
s AS (SELECT table_id, col_name, count(*) AS n FROM v GROUP BY ALL),
j AS (SELECT a.table_id AS left_table, a.col_name AS left_column, b.table_id AS right_table,
    b.col_name AS right_column, count(*) AS shared
  FROM v a JOIN v b ON a.value = b.value AND a.table_id < b.table_id GROUP BY ALL)
SELECT left_table, left_column, right_table, right_column, shared, round(shared::DOUBLE / least(x.n, y.n), 6) AS overlap
FROM j JOIN s x ON x.table_id = left_table AND x.col_name = left_column
  JOIN s y ON y.table_id = right_table AND y.col_name = right_column
WHERE shared::DOUBLE / least(x.n, y.n) > 0.8"""


def filled(template: str, **slots: str) -> str:
    """Template as one SQL expression."""
    out = lit(template)
    for name, value in slots.items():
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


ORACLE["richness_prompts"] = f"""WITH {CELLS},
f AS (SELECT *, row_number() OVER (PARTITION BY table_id, col_idx ORDER BY row_idx) AS r FROM cells),
l AS (SELECT table_id, row_idx, string_agg(coalesce(value, 'nan'), ', ' ORDER BY col_idx) AS line
  FROM f WHERE r <= 5 GROUP BY table_id, row_idx),
s AS (SELECT table_id, string_agg(line, chr(10) ORDER BY row_idx) AS samples FROM l GROUP BY table_id),
h AS (SELECT table_id, string_agg(col_name, ', ' ORDER BY col_idx) AS header
  FROM (SELECT DISTINCT table_id, col_idx, col_name FROM cells) GROUP BY table_id)
SELECT table_id, {filled(RICHNESS_PROMPT, header="header", samples="samples")} AS prompt FROM s JOIN h USING (table_id)"""

# --- templates and examples --------------------------------------------------------------

ORACLE["tmpl_select"] = "SELECT c_custkey FROM customer"
ORACLE["tmpl_count"] = "SELECT COUNT(*) AS n FROM lineitem"
ORACLE["tmpl_group_avg"] = """SELECT event_type, round(avg(CASE WHEN value > 1 THEN value END), 6) AS avg_value
FROM events GROUP BY event_type"""
ORACLE["tmpl_join"] = """SELECT l.*, d.doc_id AS doc_id_right, d.text, d.lang, d.source, d.n_chars
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""
ORACLE["tmpl_nested_having"] = """SELECT o_custkey FROM orders WHERE o_custkey IN (
  SELECT o_custkey FROM orders GROUP BY o_custkey HAVING COUNT(*) > 1)"""


HEADERS = """hd AS (SELECT page_id * 2 AS table_id, string_split(regexp_extract(html, '<title>([^<]*)</title>', 1), ' ') AS header FROM pages
  UNION ALL SELECT page_id * 2 + 1, list_append(list_transform(string_split(regexp_extract(html, '<title>([^<]*)</title>', 1), ' '), lambda x: upper(replace(x, 'ß', 'SS'))), 'id') FROM pages)"""
WORK = HEADERS + """, nm AS (SELECT 'page ' || table_id AS table_name, header, '"page ' || table_id || '"' AS t,
    '"' || replace(header[1], '"', '""') || '"' AS a, '"' || replace(header[2], '"', '""') || '"' AS b FROM hd),
wl AS (SELECT table_name, array_to_string(header, ', ') AS columns, header[1] AS first_column, kind, sql FROM (
  SELECT *, 'select' AS kind, 'SELECT ' || a || ' FROM ' || t AS sql FROM nm
  UNION ALL SELECT *, 'count', 'SELECT COUNT(*) FROM ' || t FROM nm
  UNION ALL SELECT *, 'group', 'SELECT ' || a || ', AVG(' || b || ') FROM ' || t || ' GROUP BY ' || a FROM nm WHERE len(header) > 1
  UNION ALL SELECT *, 'nested', 'SELECT ' || a || ' FROM ' || t || ' WHERE ' || a || ' IN (SELECT ' || a || ' FROM ' || t || ' GROUP BY ' || a || ' HAVING COUNT(*) > 1)' FROM nm))"""
ORACLE["header_hash"] = f"""WITH {HEADERS}
SELECT table_id, sha1(array_to_string(list_transform(header, lambda x: lower(trim(x))), chr(9))) AS header_hash FROM hd"""
ORACLE["english_tables"] = rf"""WITH {HEADERS},
h AS (SELECT table_id, unnest(header) AS h, generate_subscripts(header, 1) AS place FROM hd),
hw AS (SELECT table_id, place, unnest(string_split_regex(lower(regexp_replace(h, '[_\W]+', ' ', 'g')), '\s+')) AS w FROM h),
s AS (SELECT table_id, place, {LANG_SUMS} FROM hw GROUP BY ALL)
SELECT DISTINCT table_id FROM s WHERE greatest(en, de, fr, es) > 0 AND CASE
  {" ".join(f"WHEN {x} = greatest(en, de, fr, es) THEN '{x}'" for x in STOP_WORDS)} END = 'en'"""
ORACLE["sqlgen_workload"] = f"WITH {WORK} SELECT table_name, kind, sql FROM wl"
ORACLE["dataset_ids"] = f"WITH {WORK} SELECT 'web:' || table_name || ':' || kind || ':' || md5(sql) AS id FROM wl"
STYLES = "st(style, template) AS (VALUES " + ", ".join(
    f"({lit(s)}, {lit(t)})" for s, t in QUESTION_STYLES.items()
) + ")"
ORACLE["question_templates"] = f"""WITH {WORK}, {STYLES},
x AS (SELECT *, 'web:' || table_name || ':' || style || ':' || md5(sql) AS id FROM wl, st)
SELECT id, 'web' AS db_id, replace(template, '{{ask}}', table_name || ' ' || first_column) || ' '
  || [{", ".join(lit(x) for x in DISTRACTORS)}][1 + ('0x' || substr(md5(id), 1, 8))::BIGINT % 4] AS question,
  sql AS gold_sql FROM x"""
QUESTION_TEXT = filled(
    QUESTION_PROMPT, num="'4'", styles=lit(", ".join(QUESTION_STYLES)), db_id="'web'",
    table="table_name", columns="columns", sql="sql",
)
ORACLE["render_templates"] = f"WITH {WORK} SELECT table_name, kind, {QUESTION_TEXT} AS prompt FROM wl"
ORACLE["rewrite_prompts"] = " UNION ALL ".join(
    f"""SELECT conv_id, turn, '{kind}' AS kind, {filled(
        template, num="'2'", db_id="'db1'", table="'events'", columns="'user_id, value'",
        sql="'SELECT value FROM events WHERE user_id > ' || turn", question="text")} AS prompt
FROM conversations WHERE role = 'user'"""
    for kind, template in REWRITE_PROMPTS.items()
)

# --- written and read back ---------------------------------------------------------------

ORACLE["read_records"] = ORACLE["prompt_records"]
ORACLE["load_aligned"] = ORACLE["align_gold_pred"]
ORACLE["write_report"] = ORACLE["exec_accuracy_samples"]
ORACLE["write_aligned"] = ORACLE["align_gold_pred"]
ORACLE["write_dataset"] = ORACLE["question_templates"]
ORACLE["write_embeddings"] = ORACLE["scan_embeddings"]
ORACLE["write_shift_samples"] = f"""SELECT d.*, a.accuracy, 0 AS seed, {SET_SIZE} AS size, {SETS} AS num_sets
FROM ({ORACLE["shift_by_set"]}) d JOIN ({ORACLE["sample_set_accuracy"]}) a USING (set_id)"""
ORACLE["csv_to_cells"] = f"""WITH {CELLS}
SELECT table_id AS table_name, col_idx::INTEGER AS col_idx, col_name, count(value) AS n_values,
  sum(length(value))::BIGINT AS n_chars, count(DISTINCT value) AS n_distinct
FROM cells WHERE table_id IN ('customer', 'orders', 'part') GROUP BY ALL"""
ORACLE["wikisql_to_cells"] = """WITH h AS (SELECT page_id::VARCHAR AS table_id,
  regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS header FROM pages),
c AS (SELECT table_id, unnest(header) AS col_name, generate_subscripts(header, 1) - 1 AS col_idx FROM h)
SELECT table_id, row_idx::BIGINT AS row_idx, col_idx::INTEGER AS col_idx, col_name,
  CASE row_idx WHEN 0 THEN col_name WHEN 1 THEN translate(col_name, 'aeiou', 'AEIOU') ELSE CASE WHEN col_idx < 2 THEN col_name END END AS value
FROM c, (VALUES (0), (1), (2)) r(row_idx)"""
ORACLE["read_json_array"] = "SELECT conv_id || ':' || turn AS id, text AS question FROM conversations WHERE role = 'user'"
ORACLE["csv_line_breaks"] = """WITH t AS (SELECT doc_id, '<' || replace(replace(coalesce(text, ''), chr(13), ''), ' ', chr(10)) || '>' AS text FROM documents)
SELECT doc_id, length(text)::BIGINT AS n_chars, md5(text) AS text_md5 FROM t"""
ORACLE["discover_csv_files"] = """SELECT table_name, true AS distinct_paths, true AS all_csv FROM (
  SELECT 'customer' AS table_name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part) WHERE n > 0"""
ORACLE["materialize_tables"] = """SELECT 'customer' AS table_name, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer
UNION ALL SELECT 'orders', count(*), round(sum(o_totalprice), 2) FROM orders
UNION ALL SELECT 'part', count(*), round(sum(p_retailprice), 2) FROM part"""
ORACLE["evaluate_files"] = """WITH n AS (SELECT k.n_nationkey AS k, (SELECT count(*) FROM customer WHERE c_nationkey = k.n_nationkey) AS gold,
  (SELECT count(*) FROM customer WHERE c_nationkey = k.n_nationkey // 2) AS pred FROM nation k)
SELECT k::VARCHAR AS id, 'tpc' AS db_id, CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END::DOUBLE AS execution_accuracy FROM n"""
