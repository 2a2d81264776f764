"""The shapes of SQL audit rules, run by the rule engine over the driver tables, with SQL that says the same in another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.rules.engine import SqlRule, run_sql
from tallywright.session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

#: By name: the rule, and the SQL it is held to. Defects are CASE expressions: a null now and then, a key that leads nowhere.
#: Where rows of one key would meet all others of it, rules say EXISTS; NOT IN under OR is said by what it means with nulls.
RULES: dict[str, tuple[str, str]] = {
    "rule_completeness": (
        "SELECT c_custkey AS subject_id, c_name FROM {customer} WHERE CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE c_mktsegment END IS NULL",
        "SELECT c_custkey AS subject_id, c_name FROM customer WHERE c_custkey % 97 = 0 OR c_mktsegment IS NULL",
    ),
    "rule_ref_left_anti": (
        "SELECT o.o_orderkey AS subject_id FROM {orders} o LEFT JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey WHERE l.l_orderkey IS NULL",
        "SELECT o_orderkey AS subject_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    ),
    "rule_ref_not_in_null_aware": (
        "SELECT CAST(1 AS BIGINT) AS subject_id, count(*) AS n FROM {orders} WHERE o_orderkey NOT IN (SELECT l_orderkey FROM {lineitem}) "
        "UNION ALL SELECT CAST(2 AS BIGINT), count(*) FROM {orders} WHERE o_orderkey NOT IN (SELECT CASE WHEN l_orderkey % 101 = 0 THEN NULL ELSE l_orderkey END FROM {lineitem})",
        "SELECT 1 AS subject_id, count(*) - count(DISTINCT CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN o_orderkey END) AS n FROM orders "
        "UNION ALL SELECT 2, CASE WHEN (SELECT count(*) FROM lineitem WHERE l_orderkey % 101 = 0) > 0 THEN 0 ELSE (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) END",
    ),
    "rule_not_exists_residual": (
        "SELECT o.o_orderkey AS subject_id FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_shipdate >= o.o_orderdate)",
        "SELECT o_orderkey AS subject_id FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE last IS NULL OR last < o_orderdate",
    ),
    "rule_or_not_in": (
        "SELECT DISTINCT l.l_orderkey AS subject_id FROM {lineitem} l WHERE (l.l_partkey IS NOT NULL AND (SELECT count(*) FROM {part} WHERE p_size < 49 AND p_partkey IS NULL) = 0 AND NOT EXISTS (SELECT 1 FROM {part} p WHERE p.p_size < 49 AND p.p_partkey = l.l_partkey)) "
        "OR (l.l_suppkey IS NOT NULL AND (SELECT count(*) FROM {supplier} WHERE s_acctbal > 0 AND s_suppkey IS NULL) = 0 AND NOT EXISTS (SELECT 1 FROM {supplier} s WHERE s.s_acctbal > 0 AND s.s_suppkey = l.l_suppkey))",
        "SELECT DISTINCT l_orderkey AS subject_id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 49) OR l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)",
    ),
    "rule_temporal_order": (
        "SELECT o.o_orderkey AS subject_id, count(*) AS n FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey WHERE l.l_shipdate < o.o_orderdate GROUP BY o.o_orderkey",
        "SELECT o_orderkey AS subject_id, n FROM (SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate < o_orderdate) AS n FROM orders) WHERE n > 0",
    ),
    "rule_duplicates": (
        "SELECT min(l_linenumber) AS subject_id, l_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
        "SELECT DISTINCT l_linenumber AS subject_id, l_orderkey, n FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1",
    ),
    "rule_count_not_one": (
        "SELECT o_custkey AS subject_id, count(*) AS n FROM {orders} WHERE o_orderstatus = 'P' GROUP BY o_custkey HAVING count(*) <> 1",
        "SELECT DISTINCT o_custkey AS subject_id, n FROM (SELECT o_custkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_orderstatus = 'P') WHERE n > 1",
    ),
    "rule_duplicate_after_first": (
        "SELECT event_id AS subject_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM {events}) x WHERE n > 1",
        "SELECT event_id AS subject_id FROM events e JOIN (SELECT user_id u, event_type t, min(event_id) AS first FROM events GROUP BY ALL) ON u IS NOT DISTINCT FROM user_id AND t IS NOT DISTINCT FROM event_type WHERE event_id > first",
    ),
    "rule_sum_check": (
        "SELECT x.l_orderkey AS subject_id, CAST(x.q AS BIGINT) AS quantity FROM (SELECT l_orderkey, sum(CAST(l_quantity AS DECIMAL(18, 2))) AS q FROM {lineitem} GROUP BY l_orderkey) x "
        "WHERE x.q <> CASE WHEN x.l_orderkey % 50 = 0 THEN x.q + 1 ELSE x.q END",
        "SELECT l_orderkey AS subject_id, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem WHERE l_orderkey % 50 = 0 GROUP BY 1",
    ),
    "rule_count_distinct_key": (
        "SELECT l_partkey AS subject_id, count(DISTINCT l_suppkey) AS n FROM {lineitem} GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 25",
        "SELECT l_partkey AS subject_id, count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_suppkey IS NOT NULL) GROUP BY 1 HAVING n > 25",
    ),
    "rule_latest_row_ties": (
        "SELECT o.o_orderkey AS subject_id FROM {orders} o WHERE o.o_orderdate = (SELECT max(p.o_orderdate) FROM {orders} p WHERE p.o_custkey = o.o_custkey)",
        "SELECT o_orderkey AS subject_id FROM orders WHERE o_custkey IS NOT NULL QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) = 1",
    ),
    "rule_regex_format": (
        "SELECT c_custkey AS subject_id FROM {customer} WHERE NOT regexp_like(c_name, '^Customer#[0-9]{{8}}[0-7]$')",
        "SELECT c_custkey AS subject_id FROM customer WHERE NOT (length(c_name) = 18 AND left(c_name, 9) = 'Customer#' AND try_cast(substr(c_name, 10) AS BIGINT) IS NOT NULL AND right(c_name, 1) <= '7')",
    ),
    "rule_interval_contains": (
        "SELECT o.o_orderkey AS subject_id FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM (SELECT l_orderkey, min(l_shipdate) AS a, max(l_shipdate) AS b FROM {lineitem} GROUP BY l_orderkey) s "
        "WHERE s.l_orderkey = o.o_orderkey AND s.a <= o.o_orderdate AND (s.b IS NULL OR s.b >= o.o_orderdate))",
        "SELECT o_orderkey AS subject_id FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate HAVING NOT coalesce(o_orderdate BETWEEN min(l_shipdate) AND max(l_shipdate), false)",
    ),
    "rule_self_join_sod": (
        "SELECT DISTINCT a.user_id AS subject_id FROM {events} a WHERE a.event_type = 'error' AND a.value > 60 AND EXISTS (SELECT 1 FROM {events} b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.value > 60)",
        "SELECT user_id AS subject_id FROM events WHERE value > 60 AND user_id IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') > 0 AND count(*) FILTER (event_type = 'purchase') > 0",
    ),
    "rule_null_safe_composite": (
        "SELECT DISTINCT l.l_returnflag AS subject_id, l.l_linestatus FROM {lineitem} l LEFT JOIN (SELECT DISTINCT CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS f, l_linestatus AS s FROM {lineitem} WHERE l_orderkey % 2 = 0) k "
        "ON k.f IS NOT DISTINCT FROM l.l_returnflag AND k.s IS NOT DISTINCT FROM l.l_linestatus WHERE k.s IS NULL",
        "SELECT l_returnflag AS subject_id, l_linestatus FROM lineitem EXCEPT SELECT CASE WHEN l_returnflag <> 'N' THEN l_returnflag END, l_linestatus FROM lineitem WHERE l_orderkey % 2 = 0",
    ),
    "rule_constant_join": (
        "SELECT n.n_nationkey AS subject_id, r.r_name FROM {nation} n JOIN {region} r ON r.r_name = 'ASIA' WHERE n.n_regionkey <> r.r_regionkey",
        "SELECT n_nationkey AS subject_id, 'ASIA' AS r_name FROM nation WHERE n_regionkey <> (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')",
    ),
    "rule_inner_residual": (
        "SELECT c.c_custkey AS subject_id, count(*) AS n FROM {customer} c JOIN {orders} o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 100 * c.c_acctbal WHERE c.c_acctbal > 0 GROUP BY c.c_custkey",
        "SELECT c_custkey AS subject_id, len(list_filter(prices, lambda p: p > 100 * c_acctbal)) AS n FROM customer JOIN (SELECT o_custkey, list(o_totalprice) AS prices FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_acctbal > 0 AND n > 0",
    ),
    "rule_group_having_join": (
        "SELECT s.s_suppkey AS subject_id, count(DISTINCT l.l_orderkey) AS n FROM {supplier} s JOIN {lineitem} l ON l.l_suppkey = s.s_suppkey GROUP BY s.s_suppkey HAVING count(DISTINCT l.l_orderkey) > 500",
        "SELECT l_suppkey AS subject_id, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY 1 HAVING n > 500",
    ),
    "rule_exists_semi": (
        "SELECT p_partkey AS subject_id FROM {part} p WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_partkey = p.p_partkey AND l.l_discount > 0.09 AND l.l_quantity > 48)",
        "SELECT DISTINCT l_partkey AS subject_id FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_discount > 0.09 AND l_quantity > 48",
    ),
    "set_union_intersect_except": (
        "SELECT l_suppkey AS subject_id FROM {lineitem} WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM {lineitem} WHERE l_returnflag = 'A' EXCEPT SELECT s_suppkey FROM {supplier} WHERE s_acctbal < 0 UNION SELECT CAST(-1 AS BIGINT)",
        "SELECT l_suppkey AS subject_id FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'R') > 0 AND count(*) FILTER (l_returnflag = 'A') > 0 AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) UNION ALL SELECT -1",
    ),
}

#: The columns that are evidence, where a rule gives any.
EVIDENCE = {
    "rule_completeness": ["c_name"], "rule_ref_not_in_null_aware": ["n"], "rule_temporal_order": ["n"], "rule_duplicates": ["l_orderkey", "n"], "rule_count_not_one": ["n"], "rule_sum_check": ["quantity"],
    "rule_count_distinct_key": ["n"], "rule_null_safe_composite": ["l_linestatus"], "rule_constant_join": ["r_name"], "rule_inner_residual": ["n"], "rule_group_having_join": ["n"],
}


def findings_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The findings of one of the rules."""
    text = RULES[name][0]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return run_sql(spark, SqlRule(name, name, "ERROR", text), used)


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return findings_of(spark, sf_dir, name).select("subject_id", *[F.col("evidence")[c].alias(c) for c in EVIDENCE.get(name, [])])

    run.__name__ = name
    return run


def _oracle(name: str) -> str:
    columns = ["subject_id", *EVIDENCE.get(name, [])]
    return "SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns) + f" FROM ({RULES[name][1]})"


QUERIES = {name: _query(name) for name in RULES}
SQL = {name: _oracle(name) for name in RULES}
