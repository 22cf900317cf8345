"""Registered queries over the relational tables mapped to a graph, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.functions import metrics as M
from tripleloom.operators import analytics as A
from tripleloom.operators import cardinality as C
from tripleloom.operators import datasets as D
from tripleloom.operators import features as X
from tripleloom.operators import search
from tripleloom.operators import statistics as S
from tripleloom.plans import bgp as B
from tripleloom.plans import orders as O
from tripleloom.plans import table as T
from tripleloom.session import durable
from tripleloom.sources.triples import MAPPING, graph_of, mapping_sql, parts_of, rows_of, told_apart

Query = Callable[[SparkSession, str], DataFrame]

PATH = B.parse_all(["?o <o_customer> ?c", "?c <c_nation> ?n", "?n <n_region> <region/1>"])
STAR = B.parse_all(["?o <o_customer> ?c", "?o <o_status> <status/F>", "?o <has_part> ?p"])
SNOWFLAKE = B.parse_all(["?o <has_part> ?p", "?p <p_brand> ?b", "?o <o_customer> ?c", "?c <c_nation> ?n", "?n <n_region> ?r"])
SPLIT = B.parse_all(["?c <c_nation> ?n", "?c <c_segment> ?m", "?s <s_nation> <nation/3>"])
MIXED = B.parse_all(["?o <o_customer> ?c", "?c <c_nation> ?n", "?s <s_nation> ?n", "?o <has_supplier> ?s"])

FOUND: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        FOUND[name] = (f, sql)
        return f

    return add


def predicates(patterns) -> list[str]:
    """The predicates that bound patterns need; all if one is a variable."""
    names = {p.p for p in patterns}
    return list(MAPPING) if any(n.startswith("?") for n in names) else [m for m in MAPPING if f"<{m}>" in names]


def graph(spark: SparkSession, sf_dir: str, patterns) -> DataFrame:
    return graph_of(spark, sf_dir, predicates(patterns))


def kg_sql(patterns=None) -> str:
    return f"WITH kg AS ({mapping_sql(predicates(patterns) if patterns else None)})"


def bgp_sql(patterns) -> str:
    """FROM and WHERE of a pattern as a join of graph aliases, and its columns."""
    where, columns = [], {}
    for i, p in enumerate(patterns):
        for c, t in zip("spo", (p.s, p.p, p.o), strict=True):
            if not t.startswith("?"):
                where.append(f"t{i}.{c} = '{t}'")
            elif t in columns:
                where.append(f"t{i}.{c} = {columns[t]}")
            else:
                columns[t] = f"t{i}.{c}"
    return f"FROM {', '.join(f'kg AS t{i}' for i in range(len(patterns)))} WHERE {' AND '.join(where)}"


def count_sql(patterns) -> str:
    return f"SELECT count(*) {bgp_sql(patterns)}"


def columns_sql(patterns) -> str:
    seen = {}
    for i, p in enumerate(patterns):
        for c, t in zip("spo", (p.s, p.p, p.o), strict=True):
            if t.startswith("?"):
                seen.setdefault(t, f"t{i}.{c} AS {t[1:]}")
    return ", ".join(seen.values())


def cards_sql(patterns) -> str:
    """(mask, card) of every set of patterns, by products of components."""
    rows = []
    for k in range(1, len(patterns) + 1):
        for members in combinations(range(len(patterns)), k):
            product = " * ".join(f"({count_sql([patterns[i] for i in c])})" for c in B.components(patterns, members))
            rows.append(f"SELECT {sum(1 << i for i in members)} AS mask, CAST({product} AS BIGINT) AS card")
    return " UNION ALL ".join(rows)


def orders_sql(orders) -> str:
    rows = [f"({i}, {k + 1}, {sum(1 << j for j in o[: k + 1])}, '{','.join(map(str, o))}')" for i, o in enumerate(orders) for k in range(len(o))]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS v(order_id, k, mask, ord)"


def cost_sql(patterns, orders) -> str:
    return f"{kg_sql(patterns)}, cards AS ({cards_sql(patterns)}), steps AS ({orders_sql(orders)}), costs AS (SELECT order_id, ord, CAST(sum(CASE WHEN k >= 2 THEN card ELSE 0 END) AS BIGINT) AS c_out FROM steps JOIN cards USING (mask) GROUP BY order_id, ord)"


def with_text(df: DataFrame) -> DataFrame:
    return df.withColumn("ord", F.array_join(F.col("ord").cast("array<string>"), ","))


# statistics


@query("kg_predicate_counts", f"{kg_sql()} SELECT p, count(*) AS n FROM kg GROUP BY p")
def kg_predicate_counts(spark, sf_dir):
    return graph_of(spark, sf_dir).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@query("term_occurrences", f"{kg_sql()} SELECT term, count(*) AS n FROM (SELECT s AS term FROM kg UNION ALL SELECT p FROM kg UNION ALL SELECT o FROM kg) GROUP BY term")
def term_occurrences(spark, sf_dir):
    return S.term_occurrences(graph_of(spark, sf_dir, ranges=True))


@query("role_occurrences", f"{kg_sql()} SELECT term, count(*) FILTER (WHERE role = 's') AS n_s, count(*) FILTER (WHERE role = 'p') AS n_p, count(*) FILTER (WHERE role = 'o') AS n_o FROM (SELECT s AS term, 's' AS role FROM kg UNION ALL SELECT p, 'p' FROM kg UNION ALL SELECT o, 'o' FROM kg) GROUP BY term")
def role_occurrences(spark, sf_dir):
    return S.role_occurrences(graph_of(spark, sf_dir, ranges=True))


STATS_SQL = "SELECT p, CAST(sum(d) AS BIGINT) AS {0}, count(*) AS {1}, max(d) AS {2} FROM (SELECT p, {3}, count(*) AS d FROM kg GROUP BY p, {3}) GROUP BY p"
PRED_SQL = f"{kg_sql()}, a AS ({STATS_SQL.format('n', 'n_subj', 'max_out', 's')}), b AS ({STATS_SQL.format('m', 'n_obj', 'max_in', 'o')}) SELECT p, n AS count, n_subj, n_obj, max_out, max_in FROM a JOIN b USING (p)"


def subject_parts(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> int:
    """Tasks that count the predicates' subjects, each of as many triples as three tasks make."""
    return parts_of(-(-sum(rows_of(spark, sf_dir, names).values()) // 3))


def stats_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the predicates."""
    return S.predicate_stats(graph_of(spark, sf_dir), subject_parts(spark, sf_dir))


@query("predicate_stats", PRED_SQL)
def predicate_stats(spark, sf_dir):
    return stats_of(spark, sf_dir)


@query("top_predicates", f"{PRED_SQL} ORDER BY max_out DESC, p LIMIT 5")
def top_predicates(spark, sf_dir):
    return S.top_predicates(stats_of(spark, sf_dir))


@query("factor_graph_degree", f"{kg_sql()}, e AS (SELECT 'e:' || s AS src FROM kg UNION ALL SELECT 'r:' || p FROM kg UNION ALL SELECT 'e:' || o FROM kg UNION ALL SELECT 't:' || sha1(s || ' ' || p || ' ' || o) FROM kg, range(3)) SELECT src, count(*) AS degree FROM e GROUP BY src")
def factor_graph_degree(spark, sf_dir):
    return S.factor_degrees(graph_of(spark, sf_dir, ranges=True), told_apart(spark, sf_dir))


@query("node_features", f"{kg_sql()} SELECT term, ln(1 + count(*) FILTER (WHERE role = 's')) AS log_s, ln(1 + count(*) FILTER (WHERE role = 'p')) AS log_p, ln(1 + count(*) FILTER (WHERE role = 'o')) AS log_o, count(*) FILTER (WHERE role = 'p') > 0 AS is_relation FROM (SELECT s AS term, 's' AS role FROM kg UNION ALL SELECT p, 'p' FROM kg UNION ALL SELECT o, 'o' FROM kg) GROUP BY term")
def node_features(spark, sf_dir):
    return S.node_features(graph_of(spark, sf_dir, ranges=True)).withColumns({c: F.round(c, 9) for c in ("log_s", "log_p", "log_o")})


HOOD_SQL = f"""WITH RECURSIVE kg AS ({mapping_sql()}), e AS (SELECT s AS src, o AS dst, p AS role FROM kg UNION ALL SELECT o, s, p FROM kg),
f1 AS (SELECT * FROM e WHERE src = '<region/1>'), n1 AS (SELECT DISTINCT dst AS node FROM f1 WHERE dst <> '<region/1>'),
f2 AS (SELECT e.* FROM e JOIN n1 ON e.src = n1.node), n2 AS (SELECT DISTINCT dst AS node FROM f2 WHERE dst <> '<region/1>' AND dst NOT IN (SELECT node FROM n1)),
f3 AS (SELECT e.* FROM e JOIN n2 ON e.src = n2.node)"""


def both_ways(kg: DataFrame) -> DataFrame:
    return kg.select(F.col("s").alias("src"), F.col("o").alias("dst"), F.col("p").alias("role")).unionByName(kg.select(F.col("o").alias("src"), F.col("s").alias("dst"), F.col("p").alias("role")))


@query("bounded_neighborhood", f"{HOOD_SQL} SELECT src, dst, role, CAST(min(hop) AS INTEGER) AS hop FROM (SELECT *, 1 AS hop FROM f1 UNION ALL SELECT *, 2 FROM f2 UNION ALL SELECT *, 3 FROM f3) GROUP BY ALL")
def bounded_neighborhood(spark, sf_dir):
    seeds = spark.createDataFrame([("<region/1>",)], "node string")
    return S.neighbourhood(both_ways(graph_of(spark, sf_dir)), seeds, 3).select("src", "dst", "role", "hop")


@query("capped_neighborhood", f"""WITH kg AS ({mapping_sql()}), e AS (SELECT s AS src, o AS dst, p AS role FROM kg UNION ALL SELECT o, s, p FROM kg),
d AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY md5('7|' || src || '|' || dst || '|' || role), dst, role) AS k, count(*) OVER (PARTITION BY src) AS n FROM e),
f1 AS (SELECT * FROM d WHERE src = '<region/1>' AND k <= 20), n1 AS (SELECT DISTINCT dst AS node FROM f1 WHERE dst <> '<region/1>'),
f2 AS (SELECT d.* FROM d JOIN n1 ON d.src = n1.node WHERE k <= 20)
SELECT src, dst, role, CAST(min(hop) AS INTEGER) AS hop, round(arg_min(weight, hop), 6) AS weight FROM (SELECT src, dst, role, 1 AS hop, greatest(1.0, n / 20.0) AS weight FROM f1 UNION ALL SELECT src, dst, role, 2, greatest(1.0, n / 20.0) FROM f2) GROUP BY src, dst, role""")
def capped_neighborhood(spark, sf_dir):
    seeds = spark.createDataFrame([("<region/1>",)], "node string")
    return rounded(S.neighbourhood(both_ways(graph_of(spark, sf_dir)), seeds, 2, cap=20, seed=7))


@query("bound_terms", f"{kg_sql()}, w AS (SELECT unnest(['<n_region>', '<o_customer>', '<c_nation>', '<region/1>']) AS term), st AS (SELECT 1) SELECT term, (SELECT count(*) FROM kg WHERE s = term) AS n_s, (SELECT count(*) FROM kg WHERE p = term) AS n_p, (SELECT count(*) FROM kg WHERE o = term) AS n_o, coalesce((SELECT max(d) FROM (SELECT count(*) AS d FROM kg WHERE p = term GROUP BY s)), 0) AS max_out, coalesce((SELECT max(d) FROM (SELECT count(*) AS d FROM kg WHERE p = term GROUP BY o)), 0) AS max_in FROM w")
def bound_terms(spark, sf_dir):
    return S.bound_terms(graph_of(spark, sf_dir), PATH, subject_parts(spark, sf_dir, predicates(PATH)))


# patterns


@query("pattern_scan", f"{kg_sql(PATH)} SELECT s AS n FROM kg WHERE p = '<n_region>' AND o = '<region/1>'")
def pattern_scan(spark, sf_dir):
    return B.scan(graph(spark, sf_dir, PATH), PATH[2])


@query("variable_predicate_scan", f"{kg_sql()} SELECT p, o FROM kg WHERE s = '<order/7>'")
def variable_predicate_scan(spark, sf_dir):
    return B.scan(graph_of(spark, sf_dir), B.parse("<order/7> ?p ?o"))


LOOP_SQL = "WITH kg AS (SELECT 'n' || n_nationkey AS s, 'same' AS p, 'n' || (n_nationkey % 7) AS o FROM nation)"


@query("repeated_var_scan", f"{LOOP_SQL} SELECT s AS x FROM kg WHERE s = o")
def repeated_var_scan(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    kg = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("s"), F.lit("same").alias("p"), F.concat(F.lit("n"), (F.col("n_nationkey") % 7).cast("string")).alias("o"))
    return B.scan(kg, B.Pattern("?x", "same", "?x"))


PATH_SQL = """SELECT '<order/' || o_orderkey || '>' AS o, '<customer/' || c_custkey || '>' AS c, '<nation/' || n_nationkey || '>' AS n
FROM (SELECT DISTINCT o_orderkey, o_custkey FROM orders) JOIN (SELECT DISTINCT c_custkey, c_nationkey FROM customer) ON c_custkey = o_custkey
JOIN (SELECT DISTINCT n_nationkey, n_regionkey FROM nation) ON n_nationkey = c_nationkey WHERE n_regionkey = 1"""


@query("bgp_path3", PATH_SQL)
def bgp_path3(spark, sf_dir):
    return B.solve(graph(spark, sf_dir, PATH), PATH, [2, 1, 0]).select("o", "c", "n")


def _register_counts() -> None:
    for name, patterns in (("path3", PATH), ("star3", STAR), ("snowflake", SNOWFLAKE), ("cyclic", MIXED)):

        @query(f"bgp_{name}_count", f"{kg_sql(patterns)} SELECT count(*) AS cnt {bgp_sql(patterns)}")
        def counted(spark, sf_dir, patterns=patterns):
            return B.count(graph(spark, sf_dir, patterns), patterns)


_register_counts()


@query("bgp_disconnected_count", f"{kg_sql(SPLIT)}, c AS ({cards_sql(SPLIT)}) SELECT card FROM c WHERE mask = 7")
def bgp_disconnected_count(spark, sf_dir):
    cards = C.subset_cards(graph(spark, sf_dir, SPLIT), SPLIT, [(0, 1, 2)])
    return cards.select(F.col("card").cast("long").alias("card"))


# a table of queries: each customer asks one of four shapes about itself

SHAPES = [
    ["?o <o_customer> ?c", "?c <c_nation> {n}", "?o <o_status> ?x", "?o <has_part> ?p"],
    ["?o <has_part> ?p", "?p <p_brand> ?b", "?o <o_customer> {c}"],
    ["?c <c_nation> {n}", "?c <c_segment> ?m", "?s <s_nation> {n}"],
    ["?o <has_supplier> ?s", "?c <c_nation> ?n", "?s <s_nation> ?n", "?o <o_customer> ?c", "?n <n_region> ?r"],
]
_SHAPE_ROWS = ", ".join(f"({k}, {i}, '{p.s}', '{p.p}', '{p.o}')" for k, texts in enumerate(SHAPES) for i, p in enumerate(B.parse_all(texts)))
WORKLOAD_SQL = f"""t(k, i, s, p, o) AS (VALUES {_SHAPE_ROWS}),
pat AS (SELECT c_custkey AS query_id, i, s, p, replace(replace(o, '{{n}}', '<nation/' || c_nationkey || '>'), '{{c}}', '<customer/' || c_custkey || '>') AS o FROM customer JOIN t ON c_custkey % 4 = k),
v AS (SELECT DISTINCT query_id, i, unnest([s, p, o]) AS name FROM pat), vars AS (SELECT * FROM v WHERE name LIKE '?%'),
n AS (SELECT query_id, CAST(count(*) AS INTEGER) AS n FROM pat GROUP BY query_id),
share AS (SELECT a.query_id, a.i AS i, b.i AS j, count(*) AS n FROM vars AS a JOIN vars AS b ON a.query_id = b.query_id AND a.name = b.name AND a.i <> b.i GROUP BY ALL),
ord AS (SELECT query_id, CAST(k AS INTEGER) AS k, CAST(pos AS INTEGER) AS pos, CAST((pos + k) % n AS INTEGER) AS i FROM n, range(n) AS r(k), range(n) AS u(pos))"""
WORKLOAD = f"WITH RECURSIVE {WORKLOAD_SQL}"


def workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, triples."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("query_id"), "c_nationkey")
    rows = T.spread(rows, rows.count(), "query_id")  # a small file of many queries is else one task
    nation, customer = F.concat(F.lit("<nation/"), F.col("c_nationkey").cast("string"), F.lit(">")), F.concat(F.lit("<customer/"), F.col("query_id").cast("string"), F.lit(">"))
    term = lambda t: nation if t == "{n}" else customer if t == "{c}" else F.lit(t)
    shapes = F.array(*[F.array(*[F.struct(*[term(x).alias(a) for a, x in zip("spo", (p.s, p.p, p.o), strict=True)]) for p in B.parse_all(texts)]) for texts in SHAPES])
    return rows.select("query_id", F.get(shapes, (F.col("query_id") % 4).cast("int")).alias("triples"))


def rotations(queries: DataFrame) -> DataFrame:
    """query_id, triples, k, ord: each query's orders k, k + 1, ... round to k - 1."""
    n = F.size("triples")
    every = queries.select("query_id", "triples", F.explode(T.numbers(n)).alias("k"))
    return every.withColumn("ord", F.transform(T.numbers(n), lambda i: F.pmod(i + F.col("k"), n)))


def shapes(spark: SparkSession, sf_dir: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """query_id with what ``work`` makes of the distinct shapes (names) of queries."""
    rows = workload(spark, sf_dir).select("query_id", T.names_of(F.col("triples")).alias("names"))
    return T.by_kind(rows, {"names": F.col("names")}, work)


def turned(kinds: DataFrame) -> DataFrame:
    """names, k, ord: ``rotations`` of shapes."""
    n = F.size("names")
    every = kinds.select("names", F.explode(T.numbers(n)).alias("k"))
    return every.withColumn("ord", F.transform(T.numbers(n), lambda i: F.pmod(i + F.col("k"), n)))


def text_of(order: Column) -> Column:
    return F.array_join(order.cast("array<string>"), ",")


@query("share_matrix", f"{WORKLOAD} SELECT query_id, i, j, CAST(n AS INTEGER) AS n FROM share")
def share_matrix(spark, sf_dir):
    return shapes(spark, sf_dir, lambda kinds: kinds.select("names", F.explode(T.shared_counts(F.col("names"))).alias("x"))).select("query_id", "x.*")


@query("components", f"{WORKLOAD}, r AS (SELECT query_id, i, i AS j FROM pat UNION SELECT r.query_id, r.i, s.j FROM r JOIN share AS s ON s.query_id = r.query_id AND s.i = r.j) SELECT query_id, i AS pattern, min(j) AS component FROM r GROUP BY query_id, i")
def components(spark, sf_dir):
    labels = F.posexplode(T.component_labels(F.col("names"))).alias("pattern", "component")
    return shapes(spark, sf_dir, lambda kinds: kinds.select("names", labels)).select("query_id", "pattern", "component")


@query("cartesian_counts", f"""{WORKLOAD} SELECT query_id, k, CAST(count(*) FILTER (WHERE pos > 0 AND NOT near) AS INTEGER) AS cartesian FROM (
  SELECT a.query_id, a.k, a.pos, EXISTS (SELECT 1 FROM ord AS b JOIN share AS s ON s.query_id = b.query_id AND s.j = b.i WHERE b.query_id = a.query_id AND b.k = a.k AND b.pos < a.pos AND s.i = a.i) AS near FROM ord AS a) GROUP BY query_id, k""")
def cartesian_counts(spark, sf_dir):
    joins = T.cartesian_joins(F.col("ord"), F.col("names")).alias("cartesian")
    return shapes(spark, sf_dir, lambda kinds: turned(kinds).select("names", "k", joins)).select("query_id", "k", "cartesian")


@query("greedy_connected", f"""{WORKLOAD}, c AS (SELECT query_id, i, sum(CAST(x NOT LIKE '?%' AS INTEGER)) AS bound FROM (SELECT query_id, i, unnest([s, p, o]) AS x FROM pat) GROUP BY query_id, i),
g AS (SELECT query_id, [arg_min(i, (-bound, i))] AS l FROM c GROUP BY query_id
  UNION ALL SELECT query_id, list_append(l, nxt) FROM (SELECT g.query_id, g.l, (SELECT min(s.j) FROM share AS s WHERE s.query_id = g.query_id AND list_contains(g.l, s.i) AND NOT list_contains(g.l, s.j)) AS nxt FROM g) WHERE nxt IS NOT NULL)
SELECT n.query_id, array_to_string(any_value(g.l), ',') AS ord FROM n LEFT JOIN g ON g.query_id = n.query_id AND len(g.l) = n.n GROUP BY n.query_id""")
def greedy_connected(spark, sf_dir):
    rows = workload(spark, sf_dir).select("query_id", T.names_of(F.col("triples")).alias("names"), T.constants_of(F.col("triples")).alias("constants"))
    order = text_of(T.connected_order_of(F.col("names"), F.col("constants"))).alias("ord")
    return T.by_kind(rows, {c: F.col(c) for c in ("names", "constants")}, lambda kinds: kinds.select("names", "constants", order)).select("query_id", "ord")


@query("plan_validation_diff", f"""{WORKLOAD}, plan AS (SELECT query_id, k, pos, CASE WHEN k % 3 = 2 AND pos = 0 THEN (i + 1) % n.n WHEN k % 3 = 0 AND pos = 1 THEN 17 ELSE i END AS i FROM ord JOIN n USING (query_id) WHERE NOT (k % 3 = 1 AND pos = 0)),
q AS (SELECT query_id, k, i, count(*) AS times FROM plan GROUP BY ALL),
e AS (SELECT o.query_id, o.k, o.i, q.times FROM ord AS o LEFT JOIN q ON q.query_id = o.query_id AND q.k = o.k AND q.i = o.i)
SELECT query_id, k, coalesce(string_agg(i, ',' ORDER BY i) FILTER (WHERE times IS NULL), '') AS missing, coalesce(string_agg(i, ',' ORDER BY i) FILTER (WHERE times > 1), '') AS repeated,
  coalesce((SELECT string_agg(q.i, ',' ORDER BY q.i) FROM q JOIN n ON n.query_id = q.query_id WHERE q.query_id = e.query_id AND q.k = e.k AND q.i >= n.n), '') AS unknown FROM e GROUP BY query_id, k""")
def plan_validation_diff(spark, sf_dir):
    n = F.size("triples")
    changed = F.transform("ord", lambda i, pos: F.when((F.col("k") % 3 == 2) & (pos == 0), F.pmod(i + 1, n)).when((F.col("k") % 3 == 0) & (pos == 1), 17).otherwise(i))
    plan = F.when(F.col("k") % 3 == 1, F.slice("ord", F.lit(2), n)).otherwise(changed)
    found = rotations(workload(spark, sf_dir)).select("query_id", "k", T.problems(plan, n).alias("x"))
    return found.select("query_id", "k", *[text_of(F.col(f"x.{c}")).alias(c) for c in ("missing", "repeated", "unknown")])


@query("fanout_upper_bound", f"""WITH RECURSIVE kg AS ({mapping_sql()}), {WORKLOAD_SQL}, st AS (SELECT * FROM ({STATS_SQL.format('cnt', 'n_subj', 'max_out', 's')}) JOIN ({STATS_SQL.format('m', 'n_obj', 'max_in', 'o')}) USING (p)),
step AS (SELECT a.query_id, a.k, a.pos, pat.p, pat.s NOT LIKE '?%' OR EXISTS (SELECT 1 FROM ord AS b JOIN vars ON vars.query_id = b.query_id AND vars.i = b.i WHERE b.query_id = a.query_id AND b.k = a.k AND b.pos < a.pos AND vars.name = pat.s) AS sb,
  pat.o NOT LIKE '?%' OR EXISTS (SELECT 1 FROM ord AS b JOIN vars ON vars.query_id = b.query_id AND vars.i = b.i WHERE b.query_id = a.query_id AND b.k = a.k AND b.pos < a.pos AND vars.name = pat.o) AS ob FROM ord AS a JOIN pat ON pat.query_id = a.query_id AND pat.i = a.i)
SELECT query_id, k, round(sum(ln(CASE WHEN sb AND ob THEN 1 WHEN sb THEN max_out WHEN ob THEN max_in ELSE cnt END)), 6) AS log_bound FROM step JOIN st USING (p) GROUP BY query_id, k""")
def fanout_upper_bound(spark, sf_dir):
    orders = rotations(workload(spark, sf_dir)).withColumn("plan_id", F.col("k"))
    found = C.fanout_bounds(orders, stats_of(spark, sf_dir))
    return found.select("query_id", F.col("plan_id").alias("k"), F.round("log_bound", 6).alias("log_bound"))


@query("plan_families")
def plan_families(spark, sf_dir):
    return T.family(workload(spark, sf_dir)).select("query_id", "kind", text_of(F.col("ord")).alias("ord"))


@query("invalid_plans")
def invalid_plans(spark, sf_dir):
    plans = rotations(workload(spark, sf_dir)).select("query_id", F.col("k").alias("plan_id"), F.size("triples").alias("n"), T.left_deep_edges(F.col("ord")).alias("edges"))
    return T.broken(plans).select("query_id", "plan_id", F.array_join(F.transform("edges", lambda e: F.concat_ws(">", e["child"], e["parent"])), ",").alias("edges"), "y")


@query("pattern_features", f"""WITH RECURSIVE kg AS ({mapping_sql()}), {WORKLOAD_SQL}, slots AS (SELECT query_id, i, unnest([0, 1, 2]) AS slot, unnest([s, p, o]) AS term FROM pat),
seen AS (SELECT query_id, term, min(i * 3 + slot) AS place FROM slots WHERE term LIKE '?%' GROUP BY ALL), ids AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY place) - 1 AS variable FROM seen),
cnt AS (SELECT term, count(*) AS c FROM (SELECT s AS term FROM kg UNION ALL SELECT p FROM kg UNION ALL SELECT o FROM kg) GROUP BY term),
emb AS (SELECT '<customer/' || vec_id || '>' AS term, list_sum(embedding) AS total FROM embeddings)
SELECT s.query_id, s.i AS pattern, s.slot, CAST(coalesce(ids.variable, 0) AS INTEGER) AS variable, round(CASE WHEN s.term LIKE '?%' THEN 64.0 ELSE coalesce(emb.total, 0.0) END, 4) AS embedding_sum,
  CAST(CASE WHEN s.term LIKE '?%' THEN 0 ELSE coalesce(cnt.c, 1) END AS BIGINT) AS n FROM slots AS s LEFT JOIN ids ON ids.query_id = s.query_id AND ids.term = s.term LEFT JOIN emb ON emb.term = s.term LEFT JOIN cnt ON cnt.term = s.term""")
def pattern_features(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.concat(F.lit("<customer/"), F.col("vec_id").cast("string"), F.lit(">")).alias("term"), F.col("embedding").cast("array<double>").alias("embedding"))
    found = X.pattern_features(workload(spark, sf_dir), vectors, S.term_occurrences(graph_of(spark, sf_dir, ranges=True)), 64)
    return found.select("query_id", "pattern", "slot", "variable", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("embedding_sum"), "n")


# costs and orders

PERMS = list(permutations(range(3)))


def shares_sql(patterns) -> str:
    rows = [f"({i}, '{v}')" for i, p in enumerate(patterns) for v in sorted(p.variables)]
    return f"v(i, name) AS (VALUES {', '.join(rows)})"



@query("prefix_cards", f"{kg_sql(STAR)}, cards AS ({cards_sql(STAR)}), steps AS ({orders_sql(PERMS)}) SELECT ord, k, card FROM steps JOIN cards USING (mask)")
def prefix_cards(spark, sf_dir):
    cards = C.subset_cards(graph(spark, sf_dir, STAR), STAR)
    return with_text(C.prefix_cards(C.all_orders(spark, 3), cards)).select("ord", "k", F.col("card").cast("long").alias("card"))


def costs(spark, sf_dir, patterns, orders=None) -> DataFrame:
    kg = graph(spark, sf_dir, patterns)
    table = C.all_orders(spark, len(patterns)) if orders is None else C.order_table(spark, orders)
    return C.c_out(table, C.subset_cards(kg, patterns))


def cost_rows(df: DataFrame) -> DataFrame:
    return with_text(df).select("ord", F.col("c_out").cast("long").alias("c_out"))


@query("c_out_all_orders", f"{cost_sql(PATH, PERMS)} SELECT ord, c_out FROM costs")
def c_out_all_orders(spark, sf_dir):
    return cost_rows(costs(spark, sf_dir, PATH))


@query("c_out_five_patterns", f"{cost_sql(SNOWFLAKE, list(permutations(range(5))))} SELECT ord, c_out FROM costs")
def c_out_five_patterns(spark, sf_dir):
    return cost_rows(costs(spark, sf_dir, SNOWFLAKE))


@query("best_order", f"{cost_sql(PATH, PERMS)} SELECT ord, c_out FROM costs ORDER BY c_out, order_id LIMIT 1")
def best_order(spark, sf_dir):
    return cost_rows(C.best(costs(spark, sf_dir, PATH)))


@query("worst_order", f"{cost_sql(STAR, PERMS)} SELECT ord, c_out FROM costs ORDER BY c_out DESC, order_id LIMIT 1")
def worst_order(spark, sf_dir):
    return cost_rows(C.best(costs(spark, sf_dir, STAR), worst=True))


BEAM_SQL = f"""{kg_sql(STAR)}, cards AS ({cards_sql(STAR)}), o AS ({orders_sql(PERMS)}),
one AS (SELECT mask, card FROM cards WHERE mask IN (1, 2, 4) ORDER BY card, mask LIMIT 2),
two AS (SELECT a.ord[1:3] AS head, c.card AS c2 FROM o AS a JOIN o AS f ON f.order_id = a.order_id AND f.k = 1 JOIN one ON one.mask = f.mask JOIN cards AS c ON c.mask = a.mask WHERE a.k = 2 ORDER BY c.card, a.ord LIMIT 2)
SELECT a.ord AS ord, CAST(two.c2 + c.card AS BIGINT) AS c_out FROM o AS a JOIN two ON a.ord[1:3] = two.head AND a.k = 3 JOIN cards AS c ON c.mask = a.mask"""


def numbered(cards: DataFrame) -> DataFrame:
    return cards.select(F.lit(1).cast("long").alias("query_id"), "mask", "card")


@query("beam_best_k2", BEAM_SQL)
def beam_best_k2(spark, sf_dir):
    found = search.beam(numbered(C.subset_cards(graph(spark, sf_dir, STAR), STAR)), 2)
    return found.select(text_of(F.col("ord")).alias("ord"), F.col("cost").cast("long").alias("c_out"))


def beam_sql(width: int) -> str:
    grown = "SELECT b.mask + (1 << r.i) AS mask, b.ord || ',' || r.i AS ord, b.cost + c.card AS cost, row_number() OVER (ORDER BY b.cost + c.card, b.ord || ',' || r.i) AS place FROM b, range(5) AS r(i), cards AS c WHERE (b.mask >> r.i) & 1 = 0 AND c.mask = b.mask + (1 << r.i)"
    return f"b AS (SELECT mask, CAST(CAST(log2(mask) AS INTEGER) AS VARCHAR) AS ord, CAST(0 AS HUGEINT) AS cost FROM (SELECT mask, row_number() OVER (ORDER BY card, mask) AS place FROM cards WHERE bit_count(mask) = 1) WHERE place <= {width} UNION ALL SELECT mask, ord, cost FROM ({grown}) WHERE place <= {width})"


def search_sql(width: int) -> str:
    return f"WITH RECURSIVE kg AS ({mapping_sql(predicates(SNOWFLAKE))}), cards AS ({cards_sql(SNOWFLAKE)}), {beam_sql(width)} SELECT ord, cost FROM b WHERE mask = 31 ORDER BY cost, ord LIMIT 1"


SEARCH_SQL = f"""SELECT 'dynamic' AS method, ord, CAST(c_out AS BIGINT) AS cost FROM ({cost_sql(SNOWFLAKE, list(permutations(range(5))))} SELECT ord, c_out FROM costs ORDER BY c_out, ord LIMIT 1)
UNION ALL SELECT 'greedy', ord, CAST(cost AS BIGINT) FROM ({search_sql(1)}) UNION ALL SELECT 'beam', ord, CAST(cost AS BIGINT) FROM ({search_sql(6)})"""


@query("search_methods", SEARCH_SQL)
def search_methods(spark, sf_dir):
    cards = durable(numbered(C.subset_cards(graph(spark, sf_dir, SNOWFLAKE), SNOWFLAKE)))  # a row for each set of patterns
    first = lambda df, name: df.groupBy("query_id").agg(F.min(F.struct("cost", "ord")).alias("x")).select(F.lit(name).alias("method"), text_of(F.col("x.ord")).alias("ord"), F.col("x.cost").cast("long").alias("cost"))
    return first(search.dynamic(cards), "dynamic").unionByName(first(search.beam(cards, 1), "greedy")).unionByName(first(search.beam(cards, 6), "beam"))


TREES = [((0, 1), ((2, 3), 4)), (((0, 2), 1), (3, 4)), (((3, 4), 2), (0, 1)), ((((0, 1), 2), 3), 4), ((0, 3), (1, (2, 4)))]


def tree_edges(tree, n: int) -> list[tuple[int, int]]:
    """(child, parent) edges of a nested tree, joins numbered from n upwards, the root last."""
    edges, following = [], iter(range(n, 2 * n - 1))

    def place(node) -> int:
        if isinstance(node, int):
            return node
        sides = [place(x) for x in node]
        here = next(following)
        edges.extend((x, here) for x in sides)
        return here

    place(tree)
    return edges


def tree_masks(tree) -> list[int]:
    return [] if isinstance(tree, int) else [*tree_masks(tree[0]), *tree_masks(tree[1]), sum(1 << i for i in O.leaves(tree))]


_TREE_ROWS = ", ".join(f"({k}, {m})" for k, t in enumerate(TREES) for m in tree_masks(t))


@query("bushy_costs", f"{kg_sql(SNOWFLAKE)}, cards AS ({cards_sql(SNOWFLAKE)}), j(plan_id, mask) AS (VALUES {_TREE_ROWS}) SELECT plan_id, CAST(sum(card) AS BIGINT) AS c_out FROM j JOIN cards USING (mask) GROUP BY plan_id")
def bushy_costs(spark, sf_dir):
    plans = spark.createDataFrame([(k, tree_edges(t, 5)) for k, t in enumerate(TREES)], "plan_id int, edges array<struct<child:int,parent:int>>")
    cards = C.subset_cards(graph(spark, sf_dir, SNOWFLAKE), SNOWFLAKE)
    return C.tree_costs(plans, cards, 5).select("plan_id", F.col("c_out").cast("long").alias("c_out"))


@query("tree_cartesian_counts", f"""{WORKLOAD} SELECT query_id, k, CASE WHEN k = 2 THEN -1 ELSE CAST(count(*) FILTER (WHERE pos > 0 AND NOT near) AS INTEGER) END AS cartesian FROM (
  SELECT a.query_id, a.k, a.pos, EXISTS (SELECT 1 FROM ord AS b JOIN share AS s ON s.query_id = b.query_id AND s.j = b.i WHERE b.query_id = a.query_id AND b.k = a.k AND b.pos < a.pos AND s.i = a.i) AS near FROM ord AS a) GROUP BY query_id, k""")
def tree_cartesian_counts(spark, sf_dir):
    # without the root's edges its join has nothing below it
    malformed = F.when(F.col("k") == 2, F.filter("edges", lambda e: e["parent"] < 2 * F.size("names") - 2)).otherwise(F.col("edges"))

    def counted(kinds: DataFrame) -> DataFrame:
        plans = turned(kinds).withColumn("edges", T.left_deep_edges(F.col("ord"))).withColumn("edges", malformed)
        return plans.select("names", "k", T.tree_cartesian_joins(F.col("edges"), F.col("names")).alias("cartesian"))

    return shapes(spark, sf_dir, counted).select("query_id", "k", "cartesian")


@query("card_targets", f"{kg_sql(STAR)}, cards AS ({cards_sql(STAR)}), steps AS ({orders_sql(PERMS)}) SELECT ord, k, round(CASE WHEN card > 0 THEN ln(card) ELSE 0 END, 9) AS target, card > 0 AS valid FROM steps JOIN cards USING (mask) WHERE k >= 2")
def card_targets(spark, sf_dir):
    cards = C.subset_cards(graph(spark, sf_dir, STAR), STAR)
    return with_text(C.card_targets(C.all_orders(spark, 3), cards)).select("ord", "k", F.round("target", 9).alias("target"), "valid")


@query("plan_dataset", f"""{cost_sql(SNOWFLAKE, list(permutations(range(5))))}, {shares_sql(SNOWFLAKE)}, step AS (SELECT a.ord, a.mask AS after, b.mask AS before FROM steps AS a JOIN steps AS b ON a.order_id = b.order_id AND b.k = a.k - 1),
cart AS (SELECT ord, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM v AS x JOIN v AS y ON x.name = y.name WHERE (1 << x.i) = after - before AND (before >> y.i) & 1 = 1)) AS n FROM step GROUP BY ord)
SELECT ord, c_out AS y, round(ln(c_out), 9) AS log_y, cart.n > 0 AS cartesian, 5 AS size FROM costs JOIN cart USING (ord)""")
def plan_dataset(spark, sf_dir):
    triples = F.array(*[F.struct(*[F.lit(x).alias(a) for a, x in zip("spo", (p.s, p.p, p.o), strict=True)]) for p in SNOWFLAKE])
    found = D.assembled(costs(spark, sf_dir, SNOWFLAKE).withColumn("triples", triples))
    return found.select(text_of(F.col("ord")).alias("ord"), F.col("y").cast("long").alias("y"), F.round("log_y", 9).alias("log_y"), "cartesian", "size")


FAMILY = O.siblings(MIXED)


@query("sibling_family", f"{cost_sql(MIXED, [o for _, o in FAMILY])} SELECT ord, c_out FROM costs")
def sibling_family(spark, sf_dir):
    return cost_rows(costs(spark, sf_dir, MIXED, [o for _, o in FAMILY]))


# analytics: an order's lines stand for plans of a query, by return flag and line status

METHOD_NAMES = ["AF", "NF", "NO", "RF"]
RESULTS_SQL = "WITH r AS (SELECT l_orderkey AS query_id, l_orderkey % 13 + 3 AS size, l_returnflag || l_linestatus AS method, sum(l_quantity) * 900 AS predicted_cost, min(l_extendedprice) AS real_cost FROM lineitem GROUP BY ALL)"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines = rows.select(F.col("l_orderkey").alias("query_id"), F.concat("l_returnflag", "l_linestatus").alias("method"), "l_quantity", "l_extendedprice")
    lines = lines.repartition(parts_of(rows.count()), "query_id")  # in tasks of bounded size; a query's plans stay together
    return lines.groupBy("query_id", (F.col("query_id") % 13 + 3).alias("size"), "method").agg((F.sum("l_quantity") * 900).alias("predicted_cost"), F.min("l_extendedprice").alias("real_cost"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


RATIO_SQL = f"{RESULTS_SQL}, q AS (SELECT *, real_cost / min(real_cost) OVER (PARTITION BY query_id) AS ratio FROM r WHERE real_cost > 0)"


@query("win_rate_matrix", f"{RESULTS_SQL}, j AS (SELECT a.method AS a, b.method AS b, a.real_cost AS x, b.real_cost AS y FROM r AS a JOIN r AS b ON a.query_id = b.query_id AND a.method <> b.method), c AS (SELECT a, b, count(*) FILTER (WHERE abs(y - x) / greatest(x, y) >= 0.01 AND x < y) AS wins, count(*) FILTER (WHERE abs(y - x) / greatest(x, y) >= 0.01 AND x > y) AS losses FROM j GROUP BY a, b) SELECT a, b, wins, losses, round(CASE WHEN wins + losses = 0 THEN 0.5 ELSE wins / (wins + losses) END, 6) AS rate FROM c")
def win_rate_matrix(spark, sf_dir):
    return rounded(A.win_rates(results(spark, sf_dir)))


@query("optimality_gap_by_size", f"{RATIO_SQL} SELECT method, size, round(avg(ratio), 6) AS gap, count(*) AS n FROM q GROUP BY method, size")
def optimality_gap_by_size(spark, sf_dir):
    return rounded(A.optimality_gap(results(spark, sf_dir)))


TAUS = [1.0, 1.5, 2.0, 3.0, 5.0, 10.0, 20.0, 50.0, 100.0]
PROFILE_SQL = f"{RATIO_SQL}, t AS (SELECT CAST(unnest({TAUS}) AS DOUBLE) AS tau), pr AS (SELECT method, tau, avg(CASE WHEN ratio <= tau THEN 1.0 ELSE 0.0 END) AS share FROM q, t GROUP BY method, tau)"


@query("performance_profile", f"{PROFILE_SQL} SELECT method, tau, round(share, 6) AS share FROM pr")
def performance_profile(spark, sf_dir):
    return rounded(A.performance_profile(results(spark, sf_dir), TAUS))


@query("performance_profile_area", f"{PROFILE_SQL}, s AS (SELECT method, (tau - lag(tau) OVER w) * (share + lag(share) OVER w) / 2 AS part FROM pr WINDOW w AS (PARTITION BY method ORDER BY tau)) SELECT method, round(sum(part), 4) AS area FROM s GROUP BY method")
def performance_profile_area(spark, sf_dir):
    return rounded(A.profile_area(A.performance_profile(results(spark, sf_dir), TAUS)), 4)


@query("geomean_by_size", f"{RESULTS_SQL} SELECT method, size, round(avg(real_cost), 4) AS mean, round(median(real_cost), 4) AS median, round(exp(avg(ln(real_cost)) FILTER (WHERE real_cost > 0)), 4) AS geomean, count(real_cost) AS n FROM r GROUP BY method, size")
def geomean_by_size(spark, sf_dir):
    return rounded(A.by_size(results(spark, sf_dir)), 4)


@query("iqr_whisker", f"{RESULTS_SQL}, b AS (SELECT method, quantile_cont(real_cost, 0.25) AS q1, quantile_cont(real_cost, 0.5) AS median, quantile_cont(real_cost, 0.75) AS q3 FROM r GROUP BY method) SELECT method, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, max(real_cost) AS whisker FROM r JOIN b USING (method) WHERE real_cost <= q3 + 1.5 * (q3 - q1) GROUP BY method, q1, median, q3")
def iqr_whisker(spark, sf_dir):
    return A.box(results(spark, sf_dir)).select("method", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")], "whisker")


Q_SQL = "greatest(real_cost / (predicted_cost + 1e-10), predicted_cost / (real_cost + 1e-10))"


@query("qerror_summary", f"{RESULTS_SQL} SELECT size, round(avg({Q_SQL}), 6) AS mean, round(quantile_cont({Q_SQL}, 0.5), 6) AS median, round(quantile_cont({Q_SQL}, 0.95), 6) AS p95, round(quantile_disc({Q_SQL}, 0.5), 6) AS lower_median, round(avg((ln(real_cost) - ln(predicted_cost)) ** 2), 6) AS mse, count(*) AS n FROM r WHERE real_cost > 0 AND predicted_cost > 0 GROUP BY size")
def qerror_summary(spark, sf_dir):
    return rounded(A.q_error_summary(results(spark, sf_dir)))


@query("pairwise_rank_accuracy", f"{RESULTS_SQL} SELECT a.size AS size, count(*) AS pairs, round(avg(CASE WHEN a.predicted_cost < b.predicted_cost THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM r AS a JOIN r AS b ON a.query_id = b.query_id AND a.real_cost < b.real_cost GROUP BY a.size")
def pairwise_rank_accuracy(spark, sf_dir):
    return rounded(A.pair_accuracy(results(spark, sf_dir)))


@query("quantile_huber_loss", f"{RESULTS_SQL}, e AS (SELECT method, ln(real_cost) - ln(predicted_cost) AS e FROM r WHERE real_cost > 0 AND predicted_cost > 0) SELECT method, round(avg((CASE WHEN abs(e) <= 1 THEN 0.5 * e * e ELSE abs(e) - 0.5 END) * (CASE WHEN e > 0 THEN 1.6 ELSE 0.4 END)), 6) AS loss FROM e GROUP BY method")
def quantile_huber_loss(spark, sf_dir):
    return rounded(A.huber_loss(results(spark, sf_dir), 0.8))


@query("head_to_head", f"{RESULTS_SQL}, w AS (SELECT query_id, max(real_cost) FILTER (WHERE method = 'AF') AS a, max(real_cost) FILTER (WHERE method = 'RF') AS b FROM r GROUP BY query_id), l AS (SELECT log10(greatest(coalesce(a, 1e18), 1)) AS a, log10(greatest(coalesce(b, 1e18), 1)) AS b FROM w) SELECT count(*) FILTER (WHERE a < b - 1e-6) AS a_wins, count(*) FILTER (WHERE b < a - 1e-6) AS b_wins, round(avg(a), 6) AS a_mean_log, round(avg(b), 6) AS b_mean_log, count(*) FILTER (WHERE a >= 18) AS a_lost, count(*) FILTER (WHERE b >= 18) AS b_lost FROM l")
def head_to_head(spark, sf_dir):
    return rounded(A.head_to_head(results(spark, sf_dir), "AF", "RF"))


@query("best_plans", f"{RESULTS_SQL} SELECT query_id, arg_min(method, (real_cost, method)) AS method, min(real_cost) AS real_cost FROM r GROUP BY query_id")
def best_plans(spark, sf_dir):
    return A.best_plans(results(spark, sf_dir))


@query("varied_queries", f"{RESULTS_SQL} SELECT query_id, count(*) AS plans, count(DISTINCT real_cost) AS costs FROM r GROUP BY query_id HAVING count(*) >= 2 AND count(DISTINCT real_cost) >= 2")
def varied_queries(spark, sf_dir):
    return A.varied_queries(results(spark, sf_dir))


@query("plan_ranks", f"{RESULTS_SQL} SELECT query_id, method, CAST(row_number() OVER (PARTITION BY query_id ORDER BY real_cost, method) - 1 AS INTEGER) AS rank FROM r")
def plan_ranks(spark, sf_dir):
    return A.plan_ranks(results(spark, sf_dir)).select("query_id", "method", "rank")


@query("running_best", "SELECT user_id AS study, event_id AS iteration, value AS loss, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS best_so_far FROM events")
def running_best(spark, sf_dir):
    history = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("study"), F.col("event_id").alias("iteration"), F.col("value").alias("loss"))
    return A.running_best(history)


@query("best_of_n", f"{RESULTS_SQL}, d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY md5('0|' || query_id || '|' || method), method) AS i FROM r), b AS (SELECT n, query_id, min(real_cost) AS best FROM d, (SELECT CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS n) WHERE i <= n GROUP BY n, query_id) SELECT n, round(median(best), 6) AS median, round(avg(best), 6) AS mean, round(stddev_pop(best), 6) AS deviation FROM b GROUP BY n")
def best_of_n(spark, sf_dir):
    return rounded(A.best_of_n(results(spark, sf_dir), [1, 2, 3, 4]))


@query("parameter_correlation", f"{RESULTS_SQL} SELECT 'size' AS \"column\", round(corr(size, real_cost), 6) AS r FROM r UNION ALL SELECT 'predicted_cost', round(corr(predicted_cost, real_cost), 6) FROM r")
def parameter_correlation(spark, sf_dir):
    return rounded(A.correlation(results(spark, sf_dir), ["size", "predicted_cost"], "real_cost"))


# data sets of plans: the same results as plans of a group

PLANS_SQL = f"{RESULTS_SQL}, p AS (SELECT query_id AS group_id, method AS plan_id, real_cost AS y, ln(predicted_cost) AS prediction, CAST(size % 3 AS INTEGER) AS s, CASE WHEN method IN ('AF', 'NF') THEN 1 ELSE 0 END AS cartesian FROM r)"


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir)
    return r.select(F.col("query_id").alias("group_id"), F.col("method").alias("plan_id"), F.col("real_cost").alias("y"), F.ln("predicted_cost").alias("prediction"), (F.col("size") % 3).cast("int").alias("s"), F.col("method").isin("AF", "NF").cast("int").alias("cartesian"))


RANK_SQL = f"{PLANS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY y, plan_id) - 1 AS rank FROM p), j AS (SELECT a.group_id, b.prediction - a.prediction AS gap, 1.0 / (1 + least(a.rank, b.rank)) AS w FROM k AS a JOIN k AS b ON a.group_id = b.group_id AND a.y < b.y)"


@query("ranking_loss", f"{RANK_SQL} SELECT group_id, round(sum(w * (greatest(-gap, 0) + ln(1 + exp(-abs(gap))))) / sum(w), 6) AS loss, round(avg(CASE WHEN gap > 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS pairs FROM j GROUP BY group_id")
def ranking_loss(spark, sf_dir):
    return rounded(D.ranking_loss(plans(spark, sf_dir)))


@query("total_ranking_loss", f"{PLANS_SQL}, k AS (SELECT p.*, r.size, row_number() OVER (PARTITION BY group_id ORDER BY y, plan_id) - 1 AS rank FROM p JOIN r ON r.query_id = p.group_id AND r.method = p.plan_id), j AS (SELECT b.prediction - a.prediction AS gap, sqrt(a.size * b.size) / (1 + least(a.rank, b.rank)) AS w FROM k AS a JOIN k AS b ON a.group_id = b.group_id AND a.y < b.y) SELECT round(sum(w * (greatest(-gap, 0) + ln(1 + exp(-abs(gap))))) / sum(w), 6) AS loss, round(avg(CASE WHEN gap > 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS pairs FROM j")
def total_ranking_loss(spark, sf_dir):
    return rounded(D.total_ranking_loss(plans(spark, sf_dir).withColumn("size", F.col("group_id") % 13 + 3)))


@query("loss_buckets", "WITH q AS (SELECT quantile_cont(value, 0.2) AS lo, quantile_cont(value, 0.8) AS hi FROM events) SELECT event_id AS iteration, value AS loss, CASE WHEN value <= lo THEN 'best' ELSE 'worst' END AS bucket FROM events, q WHERE value <= lo OR value >= hi")
def loss_buckets(spark, sf_dir):
    return A.extremes(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("iteration"), F.col("value").alias("loss")))


@query("results_from_json", f"{RESULTS_SQL} SELECT query_id, CAST(size AS INTEGER) AS size, method, round(predicted_cost, 4) AS predicted_cost, CASE WHEN method <> 'AF' THEN real_cost END AS real_cost FROM r")
def results_from_json(spark, sf_dir):
    """Results packed as their files have them, infinite costs included, and read back."""
    known = results(spark, sf_dir).withColumn("real_cost", F.when(F.col("method") == "AF", float("inf")).otherwise(F.col("real_cost")))
    packed = known.groupBy("query_id").agg(F.first("size").cast("int").alias("ntriplepattern"), F.map_from_entries(F.collect_list(F.struct("method", F.struct("predicted_cost", "real_cost")))).alias("plans"))  # a query's methods
    lines = packed.select(F.to_json(F.struct("query_id", "ntriplepattern", "plans")).alias("line"))
    found = A.unpacked_results(lines.select(F.from_json("line", A.RESULTS_JSON).alias("x")).select("x.*"))
    return found.select("query_id", "size", "method", F.round("predicted_cost", 4).alias("predicted_cost"), "real_cost")


@query("schedules", "SELECT event_id AS step, round(greatest(0.5, 2.0 * (1 - event_id / 1000.0)), 9) AS temperature, round(CASE WHEN event_id <= 199 THEN 1.0 + (0.2 - 1.0) * (1 + cos(pi() * event_id / 199.0)) / 2 ELSE 0.01 + (1.0 - 0.01) * (1 + cos(pi() * least(1.0, (event_id - 199) / 800.0))) / 2 END, 9) AS rate FROM events WHERE event_id < 1000")
def schedules(spark, sf_dir):
    steps = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id < 1000").select(F.col("event_id").alias("step"))
    return steps.select("step", F.round(M.annealed(F.col("step"), 1000, 2.0, 0.5), 9).alias("temperature"), F.round(M.one_cycle(F.col("step"), 1000, 1.0), 9).alias("rate"))


@query("rank_groups", f"{PLANS_SQL} SELECT group_id, plan_id FROM p WHERE group_id IN (SELECT group_id FROM p GROUP BY group_id HAVING count(*) >= 2 AND count(DISTINCT y) >= 2)")
def rank_groups(spark, sf_dir):
    return D.rank_groups(plans(spark, sf_dir)).select("group_id", "plan_id")


@query("labelled_best", f"{PLANS_SQL} SELECT group_id, plan_id, plan_id = first_value(plan_id) OVER (PARTITION BY group_id ORDER BY y, plan_id) AS is_best FROM p")
def labelled_best(spark, sf_dir):
    return D.label_plans(plans(spark, sf_dir)).select("group_id", "plan_id", "is_best")


VERDICT_SQL = "CASE WHEN NOT has THEN 'free' WHEN c IS NULL THEN 'unknown' WHEN x < c THEN 'cartesian' WHEN bound < c THEN 'unknown' WHEN x = c THEN 'tie' ELSE 'connected' END AS verdict FROM m"


def verdict_sql(censored: str) -> str:
    return f"{PLANS_SQL}, q AS (SELECT *, {censored} AS cens FROM p), m AS (SELECT group_id, bool_or(cartesian = 1) AS has, min(y) FILTER (WHERE cartesian = 1 AND NOT cens) AS x, min(y) FILTER (WHERE cartesian = 0 AND NOT cens) AS c, min(y) FILTER (WHERE cartesian = 1 AND cens) AS bound FROM q GROUP BY group_id) SELECT group_id, {VERDICT_SQL}"


@query("plan_verdicts", verdict_sql("false"))
def plan_verdicts(spark, sf_dir):
    return D.verdicts(plans(spark, sf_dir).withColumn("censored", F.lit(False)))


@query("plan_verdicts_censored", verdict_sql("(group_id + CAST(y AS BIGINT)) % 3 = 0"))
def plan_verdicts_censored(spark, sf_dir):
    # DuckDB rounds a cast, Spark cuts it
    return D.verdicts(plans(spark, sf_dir).withColumn("censored", (F.col("group_id") + F.rint("y").cast("long")) % 3 == 0))


@query("dataset_profile", f"{PLANS_SQL} SELECT 'all' AS source, cartesian, count(*) AS plans, count(DISTINCT group_id) AS groups, round(median(log10(y)), 6) AS log10_y FROM p GROUP BY cartesian")
def dataset_profile(spark, sf_dir):
    return rounded(D.profile(D.combined(all=plans(spark, sf_dir))))


@query("expected_risk", f"{PLANS_SQL}, q AS (SELECT *, exp(prediction - max(prediction) OVER w) AS e, log10(greatest(y, 1)) - log10(greatest(min(y) OVER w, 1)) AS regret FROM p WINDOW w AS (PARTITION BY group_id)) SELECT group_id, round(sum(e * regret) / sum(e), 9) AS risk, round(sum(CASE WHEN regret = 0 THEN e ELSE 0 END) / sum(e), 9) AS best_share FROM q GROUP BY group_id")
def expected_risk(spark, sf_dir):
    return rounded(D.expected_risk(plans(spark, sf_dir)), 9)


@query("stratum_quotas", f"{PLANS_SQL}, t AS (SELECT plan_id AS stratum, count(*) AS n FROM p GROUP BY plan_id), h AS (SELECT *, 100 * sqrt(n) / sum(sqrt(n)) OVER () AS share FROM t), f AS (SELECT *, floor(share) AS base, row_number() OVER (ORDER BY share - floor(share) DESC, stratum) AS place FROM h) SELECT stratum, n, CAST(least(n, base + CASE WHEN place <= 100 - (SELECT sum(base) FROM f) THEN 1 ELSE 0 END) AS BIGINT) AS quota FROM f")
def stratum_quotas(spark, sf_dir):
    strata = plans(spark, sf_dir).groupBy(F.col("plan_id").alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    return D.quotas(strata, 100)


@query("stratum_blocks", f"{PLANS_SQL}, k AS (SELECT plan_id, group_id, row_number() OVER (PARTITION BY plan_id ORDER BY md5('0|' || plan_id || '|' || group_id), group_id) - 1 AS place, count(*) OVER (PARTITION BY plan_id) AS n FROM p) SELECT plan_id, group_id FROM k WHERE (place - 50 + 50 * n) % n < 50")
def stratum_blocks(spark, sf_dir):
    return D.block(plans(spark, sf_dir).select("plan_id", "group_id"), "plan_id", "group_id", 50, 1)


@query("contrast_pairs", f"{PLANS_SQL}, j AS (SELECT a.group_id, a.plan_id AS good, b.plan_id AS bad FROM p AS a JOIN p AS b ON a.group_id = b.group_id AND a.y < b.y) SELECT group_id, arg_min(good, (md5('0|' || group_id || '|' || good || '|' || bad), good, bad)) AS good, arg_min(bad, (md5('0|' || group_id || '|' || good || '|' || bad), good, bad)) AS bad FROM j GROUP BY group_id")
def contrast_pairs(spark, sf_dir):
    return D.contrast(plans(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
