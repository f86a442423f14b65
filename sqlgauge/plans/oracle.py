"""Checking SQL (DuckDB dialect) for the registered queries.

Expected texts per query shape are written out here by hand, independently of
the expressions they check.
"""

from __future__ import annotations

from sqlgauge.functions import prompts
from sqlgauge.functions.wordlists import COMMON_WORDS, COUNTED_OPS, STOP_WORDS
from sqlgauge.plans import derived as dv
from sqlgauge.plans.catalogue import MATCH_PAIRS, TEXT_QUERIES
from sqlgauge.plans.formats import NATSQL, NATSQL_TABLES
from sqlgauge.plans.grammar import GRAMMAR

# table -> (column, Spark type)
COLUMNS = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [
        ("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
        ("c_acctbal", "double"), ("c_mktsegment", "string"),
    ],
    "supplier": [
        ("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"),
        ("s_acctbal", "double"),
    ],
    "part": [
        ("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"),
        ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double"),
    ],
    "orders": [
        ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
        ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"),
    ],
    "lineitem": [
        ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
        ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
        ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
        ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
    ],
}
ALL_COLUMNS = [(t, c) for t, cs in COLUMNS.items() for c, _ in cs]
N_SHAPES = len(dv.QUERY_SHAPES)
LOG = f"(SELECT o_orderkey AS sql_idx, o_orderkey % {N_SHAPES} AS shape, o_orderstatus, " \
      f"{dv.shaped_sql(dv.QUERY_SHAPES)} AS gold_sql FROM orders)"

TOKENS = [
    "SELECT count ( * ) FROM orders WHERE o_orderpriority = '{prio}' ;",
    "SELECT T1.c_name , T2.o_totalprice FROM customer AS T1 JOIN orders AS T2 ON "
    "T1.c_custkey = T2.o_custkey WHERE T2.o_orderkey = {key}",
    "select o_orderstatus , avg ( o_totalprice ) , max ( o_totalprice ) from orders where "
    "o_custkey = {cust} group by o_orderstatus having count ( * ) > 1 order by avg ( o_totalprice )",
    "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100.5 AND {price} AND "
    "o_orderstatus != '{status}' OR o_custkey > {cust} ORDER BY o_totalprice DESC LIMIT 5",
    "SELECT c_name FROM customer WHERE c_custkey IN ( SELECT o_custkey FROM orders WHERE "
    "o_orderkey < {key} ) EXCEPT SELECT c_name FROM customer WHERE c_acctbal >= -1",
    "SELECT T3.n_name , count ( * ) FROM orders AS T1 JOIN customer AS T2 ON T1.o_custkey = "
    "T2.c_custkey JOIN nation AS T3 ON T2.c_nationkey = T3.n_nationkey WHERE T1.o_orderpriority "
    "= '{prio}' GROUP BY T3.n_name ORDER BY T3.n_name",
    "SELECT l_quantity * l_extendedprice FROM lineitem WHERE l_orderkey = {key} AND "
    "l_tax >= -1 AND l_discount < 0.25",
    "SELECT 1",
]
NORMALIZED = [
    "select count ( * ) from orders where o_orderpriority = '{prio}'",
    "select customer.c_name , orders.o_totalprice from customer join orders on "
    "customer.c_custkey = orders.o_custkey where orders.o_orderkey = {key}",
    "select o_orderstatus , avg ( o_totalprice ) , max ( o_totalprice ) from orders where "
    "o_custkey = {cust} group by o_orderstatus having count ( * ) > 1 "
    "order by avg ( o_totalprice ) asc",
    "select o_orderkey from orders where o_totalprice between 100.5 and {price} and "
    "o_orderstatus != '{status}' or o_custkey > {cust} order by o_totalprice desc limit 5",
    "select c_name from customer where c_custkey in ( select o_custkey from orders where "
    "o_orderkey < {key} ) except select c_name from customer where c_acctbal >= -1",
    "select nation.n_name , count ( * ) from orders join customer on orders.o_custkey = "
    "customer.c_custkey join nation on customer.c_nationkey = nation.n_nationkey where "
    "orders.o_orderpriority = '{prio}' group by nation.n_name order by nation.n_name asc",
    "select l_quantity * l_extendedprice from lineitem where l_orderkey = {key} and "
    "l_tax >= -1 and l_discount < 0.25",
    "select 1",
]
SKELETONS = [
    "select count ( _ ) from _ where _",
    "select _ from _ where _",
    "select _ , avg ( _ ) , max ( _ ) from _ where _ group by _ having count ( _ ) > _ "
    "order by avg ( _ ) asc",
    "select _ from _ where _ between _ and _ and _ or _ order by _ desc limit _",
    "select _ from _ where _ in ( select _ from _ where _ ) except select _ from _ where _",
    "select _ , count ( _ ) from _ where _ group by _ order by _ asc",
    "select _ _ _ from _ where _",
    "select _",
]
_ALL = "customer,lineitem,nation,orders,part,region,supplier"
# named, with neighbours, with connecting tables
TABLE_SETS = [
    ("orders", "customer,lineitem,orders", "customer,lineitem,nation,orders,supplier"),
    ("customer,orders", "customer,lineitem,nation,orders",
     "customer,lineitem,nation,orders,supplier"),
    ("orders", "customer,lineitem,orders", "customer,lineitem,nation,orders,supplier"),
    ("orders", "customer,lineitem,orders", "customer,lineitem,nation,orders,supplier"),
    ("customer,orders", "customer,lineitem,nation,orders",
     "customer,lineitem,nation,orders,supplier"),
    ("customer,nation,orders", "customer,lineitem,nation,orders,region,supplier",
     "customer,lineitem,nation,orders,region,supplier"),
    ("lineitem", "lineitem,orders,part,supplier",
     "customer,lineitem,nation,orders,part,supplier"),
    (_ALL, _ALL, _ALL),
]
BY_WORD = [
    "orders:o_orderpriority",
    "customer:c_custkey,c_name;orders:o_orderkey,o_custkey,o_totalprice",
    "orders:o_custkey,o_orderstatus,o_totalprice",
    "orders:o_orderkey,o_custkey,o_orderstatus,o_totalprice",
    "customer:c_custkey,c_name,c_acctbal;orders:o_orderkey,o_custkey",
    "nation:n_nationkey,n_name;customer:c_custkey,c_nationkey;orders:o_custkey,o_orderpriority",
    "lineitem:l_orderkey,l_quantity,l_extendedprice,l_discount,l_tax",
    "",
]
BY_MENTION = [
    "orders:o_orderpriority",
    "customer:c_custkey,c_name;orders:o_custkey,o_orderkey,o_totalprice",
    "orders:o_custkey,o_orderstatus,o_totalprice",
    "orders:o_custkey,o_orderkey,o_orderstatus,o_totalprice",
    "customer:c_acctbal,c_custkey,c_name;orders:o_custkey,o_orderkey",
    "nation:n_name,n_nationkey;customer:c_custkey,c_nationkey;orders:o_custkey,o_orderpriority",
    "lineitem:l_discount,l_extendedprice,l_orderkey,l_quantity,l_tax",
    ";".join(f"{t}:{','.join(sorted(c for c, _ in cs))}" for t, cs in COLUMNS.items()),
]
WITH_KEYS = [
    "customer:c_custkey;orders:o_custkey,o_orderkey,o_orderpriority;lineitem:l_orderkey",
    "nation:n_nationkey;customer:c_custkey,c_name,c_nationkey;"
    "orders:o_custkey,o_orderkey,o_totalprice;lineitem:l_orderkey",
    "customer:c_custkey;orders:o_custkey,o_orderkey,o_orderstatus,o_totalprice;"
    "lineitem:l_orderkey",
    "customer:c_custkey;orders:o_custkey,o_orderkey,o_orderstatus,o_totalprice;"
    "lineitem:l_orderkey",
    "nation:n_nationkey;customer:c_acctbal,c_custkey,c_name,c_nationkey;"
    "orders:o_custkey,o_orderkey;lineitem:l_orderkey",
    "region:r_regionkey;nation:n_name,n_nationkey,n_regionkey;customer:c_custkey,c_nationkey;"
    "supplier:s_nationkey;orders:o_custkey,o_orderkey,o_orderpriority;lineitem:l_orderkey",
    "supplier:s_suppkey;part:p_partkey;orders:o_orderkey;"
    "lineitem:l_discount,l_extendedprice,l_orderkey,l_partkey,l_quantity,l_suppkey,l_tax",
    "region:r_regionkey;nation:n_nationkey,n_regionkey;customer:c_custkey,c_nationkey;"
    "supplier:s_nationkey,s_suppkey;part:p_partkey;orders:o_custkey,o_orderkey;"
    "lineitem:l_orderkey,l_partkey,l_suppkey",
]
KEY_LINES = [f"# {a}.{b} = {c}.{d}" for a, b, c, d in dv.FOREIGN_KEYS]
_ORDER_KEY, _CUSTOMER_KEY = KEY_LINES[3], KEY_LINES[1]
FK_LINES = [
    "", _ORDER_KEY, "", "", _ORDER_KEY, _CUSTOMER_KEY + "\n" + _ORDER_KEY, "",
    "\n".join(KEY_LINES),
]
N_TABLES = [1, 2, 1, 1, 2, 3, 1, 0]
# tables, aggregates, set operators, directions, limit, joins, conditions, subqueries
PROFILES = [
    ("orders", "count", "", "", "NULL", 0, 1, 0),
    ("customer,orders", "", "", "", "NULL", 1, 2, 0),
    ("orders", "avg,max,count,avg", "", "asc", "NULL", 0, 2, 0),
    ("orders", "", "", "desc", "5", 0, 3, 0),
    ("customer,orders,customer", "", "except", "", "NULL", 0, 3, 1),
    ("orders,customer,nation", "count", "", "asc", "NULL", 2, 3, 0),
    ("lineitem", "", "", "", "NULL", 0, 3, 0),
    ("", "", "", "", "NULL", 0, 0, 0),
]
JOIN_COLUMNS = {
    "region": "r_regionkey",
    "nation": "n_nationkey,n_regionkey",
    "customer": "c_custkey,c_nationkey",
    "supplier": "s_nationkey,s_suppkey",
    "part": "p_partkey",
    "orders": "o_custkey,o_orderkey",
    "lineitem": "l_orderkey,l_partkey,l_suppkey",
}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _by_shape(texts: list[str], shape: str = "shape") -> str:
    return f"CASE {shape} " + " ".join(
        f"WHEN {i} THEN {_q(t)}" for i, t in enumerate(texts)
    ) + " END"


def _values(columns: list[tuple[str, str]]) -> str:
    """Distinct non-empty values as (table_name, column_name, value)."""
    return " UNION ALL ".join(
        f"SELECT DISTINCT '{t}' AS table_name, '{c}' AS column_name, "
        f"CAST({c} AS VARCHAR) AS value FROM {t} WHERE {c} IS NOT NULL AND CAST({c} AS VARCHAR) <> ''"
        for t, c in columns
    )


def _first_values(k: int) -> str:
    return (
        "(SELECT table_name, column_name, value, row_number() OVER (PARTITION BY table_name, "
        f"column_name ORDER BY value) AS place FROM ({_values(ALL_COLUMNS)}) "
        f"QUALIFY place <= {k})"
    )


def _bm25(questions: str, values: str) -> str:
    """Scores (sql_idx, table_name, column_name, value, score) by plain SQL."""
    key = "table_name, column_name"
    return f"""
    WITH v AS ({values}),
    d AS (SELECT *, len(string_split(value, ' ')) AS length FROM v),
    s AS (SELECT {key}, count(*) AS n, avg(length) AS mean_length FROM d GROUP BY {key}),
    p AS (SELECT {key}, value, length, token, count(*) AS tf FROM
          (SELECT *, unnest(string_split(value, ' ')) AS token FROM d)
          GROUP BY {key}, value, length, token),
    f AS (SELECT {key}, token, count(*) AS df FROM p GROUP BY {key}, token),
    r AS (SELECT f.*, mean_length, ln(n - df + 0.5) - ln(df + 0.5) AS idf
          FROM f JOIN s USING ({key})),
    m AS (SELECT {key}, 0.25 * avg(idf) AS floor_idf FROM r GROUP BY {key}),
    w AS (SELECT r.*, CASE WHEN idf < 0 THEN floor_idf ELSE idf END AS weight
          FROM r JOIN m USING ({key})),
    q AS (SELECT sql_idx, token, count(*) AS qtf FROM
          (SELECT sql_idx, unnest(string_split(question, ' ')) AS token FROM ({questions}))
          GROUP BY sql_idx, token)
    SELECT q.sql_idx, p.table_name, p.column_name, p.value,
           round(sum(qtf * weight * tf * 2.5e0 /
                     (tf + 1.5e0 * (0.25e0 + 0.75e0 * length / mean_length))), 9) AS score
    FROM q JOIN w USING (token)
    JOIN p ON p.token = w.token AND p.table_name = w.table_name AND p.column_name = w.column_name
    GROUP BY q.sql_idx, p.table_name, p.column_name, p.value
    """


def _occurrences(text: str, part: str) -> str:
    return f"((length({text}) - length(replace({text}, {_q(part)}, ''))) // {len(part)})"


_COUNTED = "replace(replace(lower(gold_sql), '(*)', ''), '( * )', '')"
_DIFFICULTY = f"""
    SELECT sql_idx, CAST(n_operators AS BIGINT) AS n_operators, CAST(n_tables AS BIGINT) AS n_tables,
           o_orderstatus,
           CASE WHEN n_tables = 1 AND n_operators <= 6 THEN 'simple'
                WHEN n_tables = 1 THEN 'moderate' ELSE 'challenging' END AS difficulty
    FROM (SELECT sql_idx, o_orderstatus,
                 {_by_shape([str(n) for n in N_TABLES])}::INTEGER AS n_tables,
                 {' + '.join(_occurrences('t', op) for op in COUNTED_OPS)} AS n_operators
          FROM (SELECT *, {_COUNTED} AS t FROM {LOG}))
"""


def _levels(scored: str, name: str) -> str:
    """(level, count, <name>) of rows (difficulty, score)."""
    return f"""
    WITH s AS ({scored}),
    levels AS (SELECT unnest(['simple', 'moderate', 'challenging', 'total']) AS level)
    SELECT level, count(score) AS count, round(coalesce(avg(score), 0), 6) AS {name}
    FROM levels LEFT JOIN s ON level = 'total' OR level = difficulty GROUP BY level
    """


_TRIMMED = """
    SELECT user_id AS sql_idx, value AS ratio FROM events JOIN
      (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY user_id)
      USING (user_id)
    WHERE s = 0 OR (value < m + 3 * s AND value > m - 3 * s)
"""


def _set_equal(gold: str, predicted: str) -> str:
    return (
        f"NOT EXISTS ((SELECT * FROM ({gold}) EXCEPT SELECT * FROM ({predicted})) UNION ALL "
        f"(SELECT * FROM ({predicted}) EXCEPT SELECT * FROM ({gold})))"
    )


def _distances(max_depth: int) -> list[tuple[str, str, int]]:
    edges = {(a, c) for a, _, c, _ in dv.FOREIGN_KEYS}
    edges |= {(b, a) for a, b in edges}
    found = []
    for start in COLUMNS:
        depth, seen = 0, {start}
        frontier = {start}
        while frontier and depth < max_depth:
            depth += 1
            frontier = {b for a, b in edges if a in frontier} - seen
            seen |= frontier
            found += [(start, t, depth) for t in sorted(frontier)]
    return found


def _labels_sql() -> str:
    named = lambda n: f"list_contains(w, '{n}')"
    tables = " || ".join(f"CAST({named(t)} AS INTEGER)::VARCHAR" for t in COLUMNS)
    per_table = []
    for t, columns in COLUMNS.items():
        digits = " || ".join(
            f"CAST({named(t)} AND ({named(c)} OR {named(t + '.' + c)}) AS INTEGER)::VARCHAR"
            for c, _ in columns
        )
        per_table.append(f"({digits})")
    return (
        f"SELECT sql_idx, {tables} AS table_labels, {(' || ' + _q('/') + ' || ').join(per_table)} "
        "AS column_labels FROM (SELECT o_orderkey AS sql_idx, "
        f"string_split({dv.shaped_sql(NORMALIZED)}, ' ') AS w FROM orders)"
    )


_SCHEMA_ORDER = ", ".join(
    f"({ti}, '{t}', {ci}, '{c}')"
    for ti, (t, cs) in enumerate(COLUMNS.items())
    for ci, (c, _) in enumerate(cs)
)
_COLUMN_TEXT = f"""
    (SELECT o.*, o.c || ' ( e.g., `' || string_agg(value, '`, `' ORDER BY place)
            || '`, etc. )' AS text,
            string_agg(value, ', ' ORDER BY place) AS plain
     FROM (VALUES {_SCHEMA_ORDER}) AS o(ti, t, ci, c)
     JOIN {_first_values(2)} f ON f.table_name = o.t AND f.column_name = o.c
     GROUP BY o.ti, o.t, o.ci, o.c)
"""


def _render_schema_sql() -> str:
    return f"""
    WITH c AS {_COLUMN_TEXT},
    lines AS (SELECT ti, '# ' || t || ' ( ' || string_agg(text, ', ' ORDER BY ci) || ' )' AS full_line,
                     '# ' || t || ' ( ' || string_agg(c, ', ' ORDER BY ci) || ' )' AS names
              FROM c GROUP BY ti, t),
    a AS (SELECT string_agg(full_line, chr(10) ORDER BY ti) AS schema_text,
                 string_agg(names, chr(10) ORDER BY ti) AS simple_text FROM lines),
    n AS (SELECT *, row_number() OVER (ORDER BY ti, ci) AS n FROM c),
    b AS (SELECT string_agg('table: ' || t || ', column: ' || c || ', sample value: ' || plain,
                            chr(10) ORDER BY n) AS descriptions,
                 string_agg('# [' || n || ']. ' || t || '.' || c, chr(10) ORDER BY n) AS numbered
          FROM n)
    SELECT '{dv.DB_ID}' AS db_id, schema_text, schema_text AS exact_text, simple_text,
           descriptions, numbered FROM a, b
    """


def _render_selection_sql() -> str:
    rows = []
    for shape, used in enumerate(BY_WORD):
        tables = [u.split(":") for u in used.split(";")] if used else []
        rows += [
            f"({shape}, {i}, '{t}', {j}, '{c}')"
            for i, (t, cs) in enumerate(tables)
            for j, c in enumerate(cs.split(","))
        ]
    order = list(COLUMNS)
    named = ", ".join(
        f"({i}, '{t}', {order.index(t)})" for i, x in enumerate(TABLE_SETS) for t in x[0].split(",")
    )
    return f"""
    WITH c AS {_COLUMN_TEXT},
    lines AS (SELECT shape, i, '# ' || u.t || ' ( ' || string_agg(text, ', ' ORDER BY j) || ' )' AS line
              FROM (VALUES {', '.join(rows)}) AS u(shape, i, t, j, col)
              JOIN c ON c.t = u.t AND c.c = u.col GROUP BY shape, i, u.t),
    picked AS (SELECT shape, string_agg(line, chr(10) ORDER BY i) AS by_columns,
                      string_agg(line, chr(10) ORDER BY i DESC) AS in_order
               FROM lines GROUP BY shape),
    tables AS (SELECT shape, f.ti, '# ' || f.t || ' ( ' || string_agg(text, ', ' ORDER BY ci) || ' )'
                      AS line
               FROM (VALUES {named}) AS f(shape, t, ti) JOIN c ON c.t = f.t GROUP BY shape, f.ti, f.t),
    first AS (SELECT shape, string_agg(line, chr(10) ORDER BY ti) AS by_tables FROM tables GROUP BY shape)
    SELECT o_orderkey AS sql_idx, coalesce(by_columns, '') AS by_columns,
           coalesce(in_order, '') AS in_order, by_tables
    FROM orders JOIN first ON first.shape = o_orderkey % {N_SHAPES}
    LEFT JOIN picked ON picked.shape = o_orderkey % {N_SHAPES}
    """


def _train_sql() -> str:
    simple = "\n".join(
        f"# {t} ( {', '.join(c for c, _ in cs)} )" for t, cs in COLUMNS.items()
    )
    fields = {
        "schema": _q(simple),
        "foreign_keys": _q("\n".join(KEY_LINES)),
        "question": "'Question ' || sql_idx",
        "knowledge": "'known'",
        "sql": "regexp_replace(gold_sql || ' -- draft', '\\s+', ' ', 'g')",
        "result": "'[' || res || ']'",
    }

    def text(known: bool) -> str:
        lines = [x for x in prompts.TRAIN.strip().split("\n") if known or "{knowledge}" not in x]
        out = _q("\n".join(lines))
        for name, value in fields.items():
            out = f"replace({out}, '{{{name}}}', {value})"
        return out

    return f"""
    SELECT sql_idx, md5(CASE WHEN res = 1 THEN {text(True)} ELSE {text(False)} END) AS input_md5,
           CASE WHEN res = 1 THEN gold_sql || ' -- draft' ELSE gold_sql END AS output
    FROM (SELECT *, CAST(o_orderstatus = 'F' AS INTEGER) AS res FROM {LOG}) WHERE shape <> 7
    """


def _common_lengths(pairs: str) -> str:
    """(a, b, n): length of the longest common subsequence, one row of the table per step."""
    return f"""
    WITH RECURSIVE pairs AS (SELECT DISTINCT a, b FROM ({pairs})),
    t(a, b, i, cells) AS (
      SELECT a, b, 0, list_transform(range(length(b) + 1), lambda x: 0) FROM pairs
      UNION ALL
      SELECT a, b, i + 1, list_transform(range(length(b) + 1), lambda j: list_max(list_transform(
               range(j + 1), lambda m: CASE WHEN m = 0 THEN 0 WHEN a[i + 1] = b[m] THEN cells[m] + 1
                                            ELSE cells[m + 1] END)))
      FROM t WHERE i < length(a))
    SELECT a, b, cells[-1] AS n FROM t WHERE i = length(a)
    """


# What the questions of the log can match, worked out by hand: the part's name (with its plural s), brands
# that begin alike, the nation, region and market, and a part type that is the first word of the name.
_ASKED = """(
    SELECT o_orderkey AS sql_idx, p_name, p_brand, split_part(p_name, ' ', 1) AS word, n_name, r_name, c_mktsegment
    FROM orders
    LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS first_part FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
    LEFT JOIN part ON p_partkey = first_part
    JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
    JOIN region ON r_regionkey = n_regionkey)"""


def _brand_pairs_sql() -> str:
    """(asked, value, score, size): stored brands similar to the one in the question."""
    lengths = _common_lengths(
        "SELECT lower(x.p_brand) AS a, lower(y.p_brand) AS b FROM (SELECT DISTINCT p_brand FROM part) x, "
        "(SELECT DISTINCT p_brand FROM part) y"
    )
    return f"""
    SELECT x.p_brand AS asked, y.p_brand AS value, 2e0 * n / (length(a) + length(b)) AS score,
           (SELECT max(k) FROM (SELECT unnest(range(1, 20)) AS k) WHERE k <= length(a) AND k <= length(b)
             AND x.p_brand[1:k] = y.p_brand[1:k]) AS size
    FROM ({lengths}) JOIN (SELECT DISTINCT p_brand FROM part) x ON lower(x.p_brand) = a
    JOIN (SELECT DISTINCT p_brand FROM part) y ON lower(y.p_brand) = b
    WHERE 2e0 * n / (length(a) + length(b)) >= 0.85
    """


def _fuzzy_sql() -> str:
    exact = lambda t, c, value, source, where="TRUE": (
        f"SELECT sql_idx, '{t}', '{c}', {value}, {value}, {source}, 1e0, length({value}) FROM asked WHERE {where}"
    )
    return f"""
    WITH asked AS MATERIALIZED {_ASKED}, brands AS MATERIALIZED ({_brand_pairs_sql()}),
    types AS (SELECT DISTINCT p_type FROM part)
    SELECT sql_idx, table_name, column_name, value, match_text, source_text, round(score, 6) AS match_score,
           size::INTEGER AS match_size
    FROM (
      SELECT sql_idx, 'part' AS table_name, 'p_name' AS column_name, p_name AS value, p_name AS match_text,
             p_name || 's' AS source_text, 2e0 * length(p_name) / (2 * length(p_name) + 1) AS score, length(p_name) AS size
      FROM asked WHERE p_name IS NOT NULL
      UNION ALL SELECT sql_idx, 'part', 'p_brand', value, value[1:size], asked, score, size
      FROM asked a JOIN brands ON a.p_brand = brands.asked
      UNION ALL SELECT sql_idx, 'part', 'p_type', p_type, p_type, word, 1e0, length(p_type)
      FROM asked JOIN types ON lower(p_type) = word
      UNION ALL {exact('nation', 'n_name', 'n_name', 'n_name')}
      UNION ALL {exact('region', 'r_name', 'r_name', 'lower(r_name)')}
      UNION ALL {exact('customer', 'c_mktsegment', 'c_mktsegment', 'c_mktsegment')})
    """


def _links_sql() -> str:
    """(sql_idx, table_name, column_name, matches): two values for every question and column."""
    own = lambda t, c, value: f"SELECT sql_idx, '{t}', '{c}', {value}, 1 FROM asked WHERE {value} IS NOT NULL"
    return f"""
    WITH asked AS MATERIALIZED {_ASKED}, brands AS MATERIALIZED ({_brand_pairs_sql()}),
    firsts AS MATERIALIZED (SELECT * FROM {_first_values(4)}),
    -- of brands with one matched text the last stands for all, at the place of the first
    texts AS (
      SELECT asked, arg_max(struct_pack(v := value, s := score, n := size), value) AS m, min(value) AS first
      FROM brands GROUP BY asked, value[1:size]),
    best AS (
      SELECT asked, m.v AS value, row_number() OVER (PARTITION BY asked ORDER BY 1e16 * m.s + 1e8 * m.s + m.n DESC, first) AS n
      FROM texts),
    chosen AS (
      SELECT sql_idx, 'part' AS table_name, 'p_brand' AS column_name, value, n
      FROM asked a JOIN best ON a.p_brand = best.asked WHERE n <= 2
      UNION ALL SELECT sql_idx, 'part', 'p_name', value, row_number() OVER (PARTITION BY sql_idx ORDER BY value)
      FROM asked JOIN (SELECT DISTINCT p_name AS value FROM part) ON split_part(value, ' ', 1) = word
      UNION ALL SELECT sql_idx, 'part', 'p_type', p_type, 1 FROM asked JOIN (SELECT DISTINCT p_type FROM part) ON lower(p_type) = word
      UNION ALL {own('nation', 'n_name', 'n_name')}
      UNION ALL {own('region', 'r_name', 'r_name')}
      UNION ALL {own('customer', 'c_mktsegment', 'c_mktsegment')}),
    listed AS (
      SELECT sql_idx, table_name, column_name, value, 0 AS rest, n FROM chosen WHERE n <= 4
      UNION ALL SELECT sql_idx, table_name, column_name, value, 1, place FROM asked, firsts
      WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.sql_idx = asked.sql_idx AND c.column_name = firsts.column_name
                          AND c.value = firsts.value)),
    two AS (
      SELECT *, row_number() OVER (PARTITION BY sql_idx, table_name, column_name ORDER BY rest, n) AS spot FROM listed
      QUALIFY spot <= 2)
    SELECT sql_idx, table_name, column_name, string_agg(value, '|' ORDER BY spot) AS matches
    FROM two GROUP BY sql_idx, table_name, column_name
    """


def _lcs_ratio_sql() -> str:
    pairs = "SELECT {a} AS a, {b} AS b FROM part"
    low = _common_lengths(pairs.format(a="lower(p_name)", b="lower(p_type)"))
    plain = _common_lengths(pairs.format(a="p_name", b="p_brand"))
    ratio = lambda t: f"round(2e0 * {t}.n / (length({t}.a) + length({t}.b)), 6)"
    return f"""
    SELECT p_partkey, {ratio('x')} AS name_type, {ratio('y')} AS name_brand FROM part
    JOIN ({low}) x ON x.a = lower(p_name) AND x.b = lower(p_type)
    JOIN ({plain}) y ON y.a = p_name AND y.b = p_brand
    """


def _natsql_sql() -> str:
    """Canonical text and labels of each shape, worked out from the table and its two columns."""
    cases = []
    for i, (table, column, other) in enumerate(NATSQL_TABLES):
        text = NATSQL.replace("{table}", table).replace("{column}", column).replace("{other}", other)
        tables = "".join(str(int(t == table)) for t in COLUMNS)
        columns = "/".join("".join(str(int(t == table and c in (column, other))) for c, _ in cs) for t, cs in COLUMNS.items())
        cases.append(f"({i}, {_q(text)}, '{tables}', '{columns}')")
    return f"""
    SELECT o_orderkey AS sql_idx, replace(text, '{{k}}', o_orderkey::VARCHAR) AS norm_natsql, table_labels, column_labels
    FROM orders JOIN (VALUES {', '.join(cases)}) AS n(shape, text, table_labels, column_labels)
      ON shape = o_orderkey % {len(NATSQL_TABLES)}
    """


_SUPPLIED = "(SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey)"
# number of the prediction's shape: 0 to 4, or 5 if it fails when run
_SCORED = "CASE WHEN s_suppkey % 40 = 5 THEN 5 ELSE s_suppkey % 5 END"
_SCORED_CONDITION = (
    "CASE shape WHEN 3 THEN 'UNRESOLVED_COLUMN.WITH_SUGGESTION' WHEN 4 THEN 'PARSE_SYNTAX_ERROR' "
    f"WHEN 5 THEN CASE WHEN EXISTS {_SUPPLIED} THEN 'USER_RAISED_EXCEPTION' END END"
)


def _evaluate_log_sql() -> str:
    return f"""
    SELECT s_suppkey AS sql_idx, CAST(CASE shape WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN NOT EXISTS (
             SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity <= 2)
           WHEN 5 THEN NOT EXISTS {_SUPPLIED} ELSE 0 END AS INTEGER) AS res, {_SCORED_CONDITION} AS condition
    FROM (SELECT s_suppkey, {_SCORED} AS shape FROM supplier)
    """


def _check_log_sql() -> str:
    shown = "'(' || l_orderkey || ', ' || l_quantity || ')'"
    return f"""
    WITH shaped AS (SELECT s_suppkey, {_SCORED} AS shape FROM supplier),
    lines AS (
      SELECT l_suppkey, l_orderkey, l_quantity, shape FROM lineitem JOIN shaped ON s_suppkey = l_suppkey
      WHERE shape IN (0, 1) OR (shape = 2 AND l_quantity > 2)
    ), kept AS (
      SELECT * FROM lines WHERE shape <> 1
      UNION ALL SELECT DISTINCT * FROM lines WHERE shape = 1
    ), firsts AS (
      SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_quantity) <= 3
    ), texts AS (
      SELECT l_suppkey, string_agg({shown}, ', ' ORDER BY l_orderkey, l_quantity) AS t FROM firsts GROUP BY l_suppkey
    ), failed AS (SELECT s_suppkey, {_SCORED_CONDITION} AS condition FROM shaped)
    SELECT s_suppkey AS sql_idx, condition IS NULL AS ok,
           CASE WHEN condition IS NULL THEN '[' || coalesce(t, '') || ']' END AS rows, condition
    FROM failed LEFT JOIN texts ON l_suppkey = s_suppkey
    """


def oracle_sql() -> dict[str, str]:
    words = "(SELECT lang, unnest(string_split(lower(text), ' ')) AS word FROM documents)"
    listed = lambda names: ", ".join(_q(n) for n in sorted(names))
    linked = _values(ALL_COLUMNS)
    # White space at the ends of a word does not count.
    bare = "trim(word, chr(32) || chr(9) || chr(10) || chr(13))"
    flag = "CAST(o_orderstatus = 'F' AS INTEGER)"
    counts = lambda t, c: f"(SELECT count(DISTINCT {c}) FROM {t})"
    sql = {name: text for name, (_, text) in GRAMMAR.items()}
    sql.update({f"text_{name}": GRAMMAR[name][1] for name in TEXT_QUERIES})
    sql |= {
        "question_cleanup": f"SELECT sql_idx, question FROM ({dv.question_log_sql()})",
        "picklist_distinct": linked,
        "picklist_first_k": "SELECT table_name, column_name, string_agg(value, '|' ORDER BY place) "
        f"AS first_values FROM {_first_values(3)} GROUP BY table_name, column_name",
        "bm25_scores": "SELECT sql_idx, table_name, column_name, value, round(score, 6) AS score "
        f"FROM ({_bm25(dv.question_log_sql(), linked)})",
        "bm25_topk": "SELECT sql_idx, rank, md5(value) AS value_md5, round(score, 6) AS score FROM "
        "(SELECT *, row_number() OVER (PARTITION BY sql_idx ORDER BY score DESC, value) AS rank FROM ("
        + _bm25("SELECT item_id AS sql_idx, text AS question FROM benchmark",
                _values([("documents", "text")]))
        + ")) WHERE rank <= 10",
        "fuzzy_matches": _fuzzy_sql(),
        "value_link_top2": _links_sql(),
        "lcs_ratio": _lcs_ratio_sql(),
        # every column has two values for each sample, or all that it has
        "sample_contents": "SELECT o_orderkey AS sql_idx, (SELECT sum(least(2, n))::BIGINT FROM (SELECT count(*) "
        f"AS n FROM ({linked}) GROUP BY table_name, column_name)) AS n_values FROM orders",
        "stopword_filter": f"SELECT lang, count(*) FILTER ({bare} IN ({listed(STOP_WORDS)})) AS n_stop, "
        f"count(*) FILTER ({bare} IN ({listed(COMMON_WORDS)})) AS n_common, "
        f"count(*) FILTER ({bare} = 'id') AS n_db_terms, count(*) AS n_words "
        f"FROM {words} GROUP BY lang",
        "number_filter": "SELECT lang, count(*) FILTER (TRY_CAST(replace(word, ',', '') AS DOUBLE) "
        "IS NOT NULL) AS n_numbers, count(*) FILTER (regexp_full_match(word, '-[0-9]+')) AS "
        "n_negative, count(*) FILTER (regexp_full_match(word, '-?[0-9]+(\\.[0-9]+)?')) AS n_floats "
        f"FROM {words} GROUP BY lang",
        "sql_tokens": f"SELECT o_orderkey AS sql_idx, {dv.shaped_sql(TOKENS)} AS tokens FROM orders",
        "normalize_sql": f"SELECT o_orderkey AS sql_idx, {dv.shaped_sql(NORMALIZED)} AS norm_sql "
        "FROM orders",
        "table_aliases": f"SELECT o_orderkey AS sql_idx, alias, table_name FROM orders JOIN (VALUES "
        "(1, 't1', 'customer'), (1, 't2', 'orders'), (5, 't1', 'orders'), (5, 't2', 'customer'), "
        f"(5, 't3', 'nation')) AS a(shape, alias, table_name) ON shape = o_orderkey % {N_SHAPES}",
        "sql_skeleton": f"SELECT sql_idx, {_by_shape(SKELETONS)} AS skeleton FROM {LOG}",
        "schema_labels": _labels_sql(),
        "clause_profile": 'SELECT o_orderkey AS sql_idx, tables, aggregates, set_operators, '
        'directions, CAST("limit" AS INTEGER) AS "limit", FALSE AS is_distinct, n_joins, '
        "n_conditions, n_subqueries FROM orders JOIN (VALUES "
        + ", ".join(
            f"({i}, '{t}', '{a}', '{s}', '{d}', {n}, {j}, {c}, {q})"
            for i, (t, a, s, d, n, j, c, q) in enumerate(PROFILES)
        )
        + ') AS p(shape, tables, aggregates, set_operators, directions, "limit", n_joins, '
        f"n_conditions, n_subqueries) ON shape = o_orderkey % {N_SHAPES}",
        "draft_cleanup": "SELECT sql_idx, sql AS draft, sql AS correction FROM (SELECT sql_idx, "
        "'SELECT ' || regexp_replace(regexp_replace(gold_sql, '\\s*\\n\\s*', ' ', 'g'), "
        f"'^select\\s+', '', 'i') AS sql FROM {LOG})",
        "catalog_columns": " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, '{c}' AS column_name, {ti} AS table_idx, {ci} AS col_idx, "
            f"'{kind}' AS data_type, {str(c in dv.PRIMARY_KEYS.get(t, [])).upper()} AS is_pk, "
            f"{counts(t, c)} AS n_values"
            for ti, (t, cs) in enumerate(COLUMNS.items())
            for ci, (c, kind) in enumerate(cs)
        ),
        "catalog_fks": " UNION ALL ".join(
            f"SELECT {i} AS fk_idx, '{a}' AS src_table, '{b}' AS src_column, {counts(a, b)} AS "
            f"src_values, '{c}' AS dst_table, '{d}' AS dst_column, {counts(c, d)} AS dst_values"
            for i, (a, b, c, d) in enumerate(dv.FOREIGN_KEYS)
        ),
        "used_tables": f"SELECT sql_idx, {_by_shape([x[0] for x in TABLE_SETS])} AS named, "
        f"{_by_shape([x[1] for x in TABLE_SETS])} AS neighbors, "
        f"{_by_shape([x[2] for x in TABLE_SETS])} AS connected FROM {LOG}",
        "fk_reachability": "SELECT src, dst, depth, n_queries FROM (SELECT src, count(*) AS n_queries "
        f"FROM (SELECT unnest(string_split({_by_shape([x[0] for x in TABLE_SETS])}, ',')) AS src "
        f"FROM {LOG}) GROUP BY src) JOIN (VALUES "
        + ", ".join(f"('{a}', '{b}', {n})" for a, b, n in _distances(len(COLUMNS)))
        + ") AS d(src, dst, depth) USING (src)",
        "used_columns": f"SELECT sql_idx, {_by_shape(BY_WORD)} AS by_word, "
        f"{_by_shape(BY_MENTION)} AS by_mention, {_by_shape(WITH_KEYS)} AS with_keys FROM {LOG}",
        "render_schema": _render_schema_sql(),
        "render_fks": f"SELECT sql_idx, {_by_shape(FK_LINES)} AS fk_text FROM {LOG}",
        "render_selection": _render_selection_sql(),
        "keys_by_table": " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows, '{JOIN_COLUMNS[t]}' AS "
            f"join_columns, {_q(dv.PRIMARY_KEYS[t][0]) if t in dv.PRIMARY_KEYS else 'NULL'} AS pk_columns"
            for t in COLUMNS
        ),
        "exec_match": " UNION ALL ".join(
            f"SELECT CAST({i} AS BIGINT) AS sql_idx, CAST({_set_equal(g, p)} AS INTEGER) AS res"
            for i, (g, p) in enumerate(MATCH_PAIRS)
        ),
        "gold_source": f"SELECT sql_idx, gold_sql, '{dv.DB_ID}' AS db_id FROM {LOG}",
        "sql_source": f"SELECT sql_idx, gold_sql AS predicted_sql FROM {LOG}",
        "prediction_source": "SELECT sql_idx, CASE WHEN sql_idx % 4 = 3 THEN ' ' ELSE gold_sql END AS predicted_sql, "
        f"CASE WHEN sql_idx % 4 = 3 THEN 'financial' ELSE '{dv.DB_ID}' END AS db_id FROM {LOG}",
        "question_source": f"SELECT sql_idx, '{dv.DB_ID}' AS db_id, question, evidence, CAST(NULL AS VARCHAR) AS "
        f"difficulty, gold_sql FROM ({dv.question_log_sql()}) JOIN {LOG} USING (sql_idx)",
        "natsql_source": _natsql_sql(),
        "selection_source": "SELECT o_orderkey AS sql_idx, 'orders:o_orderkey,o_' || o_orderkey || ';part:p_name' AS used "
        "FROM orders",
        "example_replies": "SELECT sql_idx, 'what about ' || sql_idx || '?' AS question, CASE WHEN sql_idx % 2 = 0 "
        f"THEN 'fact ' || sql_idx END AS evidence, gold_sql FROM {LOG}",
        "evaluate_log": _evaluate_log_sql(),
        "check_log": _check_log_sql(),
        "difficulty_class": "SELECT sql_idx, n_operators, n_tables, difficulty "
        f"FROM ({_DIFFICULTY})",
        "difficulty_counts": f"SELECT difficulty, count(*) AS n FROM ({_DIFFICULTY}) GROUP BY difficulty",
        "acc_by_difficulty": _levels(
            f"SELECT difficulty, {flag} * 100e0 AS score FROM ({_DIFFICULTY})", "accuracy"
        ),
        "outlier_trim": "SELECT sql_idx, count(*) AS n_kept, round(sum(ratio), 4) AS total "
        f"FROM ({_TRIMMED}) GROUP BY sql_idx",
        "ves_aggregate": "SELECT round(avg(sqrt(r) * 100), 6) AS ves FROM "
        f"(SELECT avg(ratio) AS r FROM ({_TRIMMED}) GROUP BY sql_idx)",
        "ves_by_difficulty": _levels(
            "SELECT difficulty, sqrt(r) * 100 AS score FROM "
            f"(SELECT sql_idx, avg(ratio) AS r FROM ({_TRIMMED}) GROUP BY sql_idx) "
            f"LEFT JOIN ({_DIFFICULTY}) USING (sql_idx)",
            "ves",
        ),
        "train_pairs": _train_sql(),
        "slice_first_n": f"SELECT sql_idx, gold_sql FROM {LOG} WHERE sql_idx < 500",
        "chunks": "SELECT CAST(chunk AS INTEGER) AS chunk, min(o_orderkey) AS first, "
        "max(o_orderkey) AS last, count(*) AS n FROM orders JOIN (SELECT chunk, "
        "chunk * total // 7 AS low, (chunk + 1) * total // 7 AS high FROM "
        "(SELECT unnest(range(7)) AS chunk), (SELECT count(*) AS total FROM orders)) "
        "ON o_orderkey >= low AND o_orderkey < high GROUP BY chunk",
        "resume_remaining": "SELECT o_orderkey AS sql_idx FROM orders WHERE o_orderstatus <> 'F'",
        "merge_predictions": "SELECT sql_idx, 'SELECT c_name ,  c_mktsegment FROM (' || gold_sql || ')' "
        f"|| chr(9) || '----- bird -----' || chr(9) || '{dv.DB_ID}' AS entry FROM {LOG}",
        "gold_lines": f"SELECT sql_idx, gold_sql || chr(9) || '{dv.DB_ID}' AS line FROM {LOG}",
    }
    return sql
