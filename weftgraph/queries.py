"""Queries over the driver's tables, each with the SQL that must give the same rows.

A query is Cypher text; floating results are rounded on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import cypher
from .operators.checkpoints import shared_folder
from .operators.writes import Batch, execute
from .plans.parser import parse
from .sources.graph import from_rows, over_tables
from .sources.store import FOLDER, Store

#: name: (Cypher, SQL)
READ: dict[str, tuple[str, str]] = {
    # scans and filters
    "flagship": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_orderstatus = 'F' RETURN c.c_mktsegment AS segment, count(*) AS orders ORDER BY segment",
        "SELECT c_mktsegment AS segment, count(*) AS orders FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY 1",
    ),
    "node_scan": ("MATCH (n) RETURN count(*) AS nodes", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(DISTINCT user_id) FROM events) + (SELECT count(*) FROM events) + (SELECT count(*) FROM documents) + (SELECT count(*) FROM conversations) AS nodes"),
    "label_scan": ("MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name, labels(n)[0] AS label", "SELECT n_nationkey AS k, n_name AS name, 'Nation' AS label FROM nation"),
    "property_match": ("MATCH (c:Customer {c_mktsegment: 'BUILDING', c_nationkey: 3.0}) RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3"),
    "point_lookup": ("MATCH (o:Order {o_orderkey: 7}) RETURN id(o) AS id, o.o_totalprice AS price", "SELECT 'Order:' || o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey = 7"),
    "id_lookup": ("MATCH (n) WHERE id(n) = 'Nation:3' RETURN n.n_name AS name", "SELECT n_name AS name FROM nation WHERE n_nationkey = 3"),
    "where_and_or_xor_not": (
        "MATCH (o:Order) WHERE (o.o_orderstatus = 'F' XOR o.o_totalprice > 200000) AND NOT o.o_orderpriority = '1-URGENT' OR o.o_orderkey < 10 RETURN count(*) AS n",
        "SELECT count(*) AS n FROM orders WHERE ((o_orderstatus = 'F') <> (o_totalprice > 200000) AND NOT o_orderpriority = '1-URGENT') OR o_orderkey < 10",
    ),
    "where_null_logic": (
        "MATCH (s:Supplier) OPTIONAL MATCH (s)-[:LOCATED_IN]->(n:Nation {n_regionkey: 1}) WITH s, n.n_name AS name RETURN count(name) AS known, sum(CASE WHEN name = 'x' OR s.s_suppkey > 0 THEN 1 ELSE 0 END) AS or_null, sum(CASE WHEN name = 'x' THEN 1 WHEN name IS NULL THEN 10 ELSE 0 END) AS s",
        "SELECT count(n_name) AS known, CAST(sum(CASE WHEN n_name = 'x' OR s_suppkey > 0 THEN 1 ELSE 0 END) AS BIGINT) AS or_null, CAST(sum(CASE WHEN n_name = 'x' THEN 1 WHEN n_name IS NULL THEN 10 ELSE 0 END) AS BIGINT) AS s FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey = 1",
    ),
    "in_list": ("MATCH (o:Order) WHERE o.o_orderpriority IN ['1-URGENT', '2-HIGH'] RETURN o.o_orderpriority AS p, count(*) AS n", "SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1"),
    "not_in_list": ("MATCH (o:Order) WHERE o.o_orderstatus NOT IN ['F', 'O'] AND NOT o.o_orderkey IN [] RETURN count(*) AS n", "SELECT count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', 'O')"),
    "string_predicates": (
        "MATCH (p:Part) WHERE p.p_name STARTS WITH 'p' OR p.p_type ENDS WITH 'L' OR p.p_brand CONTAINS '1' RETURN count(*) AS n",
        "SELECT count(*) AS n FROM part WHERE starts_with(p_name, 'p') OR suffix(p_type, 'L') OR contains(p_brand, '1')",
    ),
    "regex_search": ("MATCH (c:Customer) WHERE c.c_name =~ '0[1-3]$' RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE regexp_matches(c_name, '0[1-3]$')"),
    "chained_comparison": ("MATCH (p:Part) WHERE 10 < p.p_size <= 20 <> p.p_partkey RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE 10 < p_size AND p_size <= 20 AND 20 <> p_partkey"),
    "is_null": ("MATCH (n:Nation) WHERE n.missing IS NULL AND n.n_name IS NOT NULL RETURN count(*) AS n", "SELECT count(*) AS n FROM nation WHERE n_name IS NOT NULL"),
    "label_predicate": ("MATCH (n) WHERE n:Region OR n:Nation RETURN count(*) AS n", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS n"),
    # expansion
    "expand_out": ("MATCH (u:User)-[:DID]->(e:Event) RETURN u.user_id AS u, count(e) AS n", "SELECT user_id AS u, count(*) AS n FROM events GROUP BY 1"),
    "expand_in": ("MATCH (n:Nation)<-[:LOCATED_IN]-(s:Supplier) RETURN n.n_name AS name, count(s) AS n, max(s.s_suppkey) AS last", "SELECT n_name AS name, count(*) AS n, max(s_suppkey) AS last FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"),
    "expand_undirected": ("MATCH (n:Nation)--(x) RETURN n.n_nationkey AS k, count(*) AS n", "SELECT n_nationkey AS k, 1 + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n FROM nation"),
    "type_alternatives": ("MATCH (c:Customer)-[r:PLACED|CHILD]->(o:Order) RETURN type(r) AS t, count(*) AS n", "SELECT unnest(['PLACED', 'CHILD']) AS t, count(*) AS n FROM orders GROUP BY 1"),
    "edge_properties": ("MATCH (o:Order)-[l:CONTAINS {l_returnflag: 'R'}]->(p:Part) WHERE l.l_quantity > 40 RETURN count(*) AS n, count(DISTINCT o) AS orders", "SELECT count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40"),
    "edge_multiplicity": ("MATCH (o:Order)-[l:CONTAINS]->() RETURN count(DISTINCT l) AS n", "SELECT count(*) AS n FROM lineitem"),
    "two_hop": ("MATCH (r:Region)-[:CHILD]->(n:Nation)-[:CHILD]->(c:Customer) RETURN r.r_name AS r, count(c) AS n", "SELECT r_name AS r, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"),
    "hierarchy_4": ("MATCH (r:Region)-[:CHILD]->(n)-[:CHILD]->(c)-[:PLACED]->(o:Order)-[l:CONTAINS]->(p:Part) RETURN r.r_name AS r, count(*) AS n", "SELECT r_name AS r, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"),
    "trail_uniqueness": ("MATCH (a:Nation)<-[:CHILD]-(r:Region)-[:CHILD]->(b:Nation) RETURN count(*) AS n", "SELECT count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey"),
    "comma_join": ("MATCH (n:Nation)-[:CHILD]->(c:Customer), (n)<-[:LOCATED_IN]-(s:Supplier) RETURN n.n_name AS name, count(*) AS n", "SELECT n_name AS name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"),
    "separate_parts_share_edges": ("MATCH (r:Region)-[x:CHILD]->(:Nation), (r)-[y:CHILD]->(:Nation) RETURN count(*) AS n", "SELECT count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey"),
    "cartesian": ("MATCH (a:Region), (b:Nation) RETURN count(*) AS n", "SELECT count(*) AS n FROM region, nation"),
    "theta_join": ("MATCH (a:Nation), (b:Nation) WHERE a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey RETURN count(*) AS n", "SELECT count(*) AS n FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey"),
    "repeated_variable": ("MATCH (s:Supplier)-[:LOCATED_IN]->(n:Nation)-[:CHILD]->(c:Customer)-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part)<-[:SUPPLIES]-(s) RETURN count(*) AS n", "SELECT count(*) AS n FROM supplier JOIN customer ON c_nationkey = s_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN (SELECT DISTINCT l_suppkey AS sk, l_partkey AS pk FROM lineitem) x ON x.sk = s_suppkey AND x.pk = l_partkey"),
    "next_event": ("MATCH (a:Event {event_type: 'click'})-[:NEXT]->(b:Event) RETURN b.event_type AS t, count(*) AS n", "SELECT nt AS t, count(*) AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nt FROM events) WHERE event_type = 'click' AND nt IS NOT NULL GROUP BY 1"),
    # variable length
    "varlen_1_3": ("MATCH (r:Region)-[:CHILD*1..3]->(x) RETURN labels(x)[0] AS l, count(*) AS n", "SELECT 'Nation' AS l, count(*) AS n FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Order', count(*) FROM orders"),
    "varlen_zero": ("MATCH (r:Region {r_regionkey: 1})-[:CHILD*0..1]->(x) RETURN id(x) AS id", "SELECT 'Region:1' AS id UNION ALL SELECT 'Nation:' || n_nationkey FROM nation WHERE n_regionkey = 1"),
    "varlen_exact": ("MATCH (r:Region)-[:CHILD*2]->(c) RETURN count(c) AS n", "SELECT count(*) AS n FROM customer"),
    "varlen_empty": ("MATCH (r:Region) OPTIONAL MATCH (r)-[:CHILD*2..1]->(x) RETURN count(r) AS r, count(x) AS x", "SELECT count(*) AS r, 0 AS x FROM region"),
    "varlen_unbounded": ("MATCH (t:Turn {turn: 0})-[:NEXT*]->(x:Turn) RETURN t.conv_id AS c, count(x) AS n", "SELECT conv_id AS c, count(*) - 1 AS n FROM conversations GROUP BY 1 HAVING count(*) > 1 AND min(turn) = 0"),
    "varlen_trail_undirected": ("MATCH (r:Region {r_regionkey: 0})-[:CHILD*2]-(x:Nation) RETURN count(*) AS n", "SELECT 0 AS n"),
    "varlen_relationships": ("MATCH (n:Nation)-[rs:CHILD*2]->(o:Order) WHERE all(r IN rs WHERE type(r) = 'CHILD') RETURN sum(size(rs)) AS n", "SELECT CAST(2 * count(*) AS BIGINT) AS n FROM orders"),
    "named_path_length": ("MATCH p = (r:Region)-[:CHILD*1..2]->(x) RETURN length(p) AS l, count(*) AS n, max(size(nodes(p))) AS nodes", "SELECT 1 AS l, count(*) AS n, 2 AS nodes FROM nation UNION ALL SELECT 2, count(*), 3 FROM customer"),
    "path_nodes": ("MATCH p = (r:Region)-[:CHILD]->(n:Nation) RETURN [x IN nodes(p) | id(x)][1] AS id, nodes(p)[0].r_name AS r, startNode(relationships(p)[0]) IS NOT NULL AS ok", "SELECT 'Nation:' || n_nationkey AS id, r_name AS r, true AS ok FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "path_ends": ("MATCH p = (:Region)-[:CHILD]->(:Nation) WITH relationships(p) AS rs RETURN startNode(rs[0]).r_name AS r, [x IN rs | endNode(x).n_name][0] AS n", "SELECT r_name AS r, n_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey"),
    # optional, semi, anti
    "optional_match": ("MATCH (p:Part) OPTIONAL MATCH (p)<-[l:CONTAINS]-(o:Order {o_orderstatus: 'P'}) RETURN count(DISTINCT p) AS parts, count(l) AS lines, count(*) AS n", "SELECT count(DISTINCT p_partkey) AS parts, count(l_orderkey) AS lines, count(*) AS n FROM part LEFT JOIN (SELECT l_partkey, l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P') ON l_partkey = p_partkey"),
    "optional_where": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > c.c_acctbal * 60 RETURN c.c_custkey AS c, count(o) AS n", "SELECT c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 60 GROUP BY 1"),
    "exists_subquery": ("MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 400000 } RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"),
    "exists_correlated": ("MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > c.c_acctbal * 80 } OR c.c_custkey = 1 RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 80) OR c_custkey = 1"),
    "not_exists": ("MATCH (p:Part) WHERE NOT EXISTS { (p)<-[l:CONTAINS]-() WHERE l.l_returnflag = 'R' } RETURN p.p_partkey AS p", "SELECT p_partkey AS p FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')"),
    "pattern_predicate": ("MATCH (n:Nation) WHERE (n)<-[:LOCATED_IN]-(:Supplier) AND NOT (n)-[:CHILD]->(:Customer {c_mktsegment: 'MACHINERY'}) RETURN count(*) AS n", "SELECT count(*) AS n FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier) AND n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'MACHINERY')"),
    "pattern_comprehension_size": ("MATCH (n:Nation) RETURN n.n_name AS name, size([(n)<-[:LOCATED_IN]-(s) WHERE s.s_acctbal > 0 | s.s_name]) AS k", "SELECT n_name AS name, count(s_suppkey) AS k FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0 GROUP BY 1"),
    # shortest paths
    "shortest_path_len": ("MATCH (a:Turn {turn: 0}), (b:Turn) WHERE a.conv_id = b.conv_id AND b.turn > 0 MATCH p = shortestPath((a)-[:NEXT*]->(b)) RETURN b.conv_id AS c, b.turn AS t, length(p) AS l", "SELECT conv_id AS c, turn AS t, n AS l FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, min(turn) OVER (PARTITION BY conv_id) AS low FROM conversations) WHERE turn > 0 AND low = 0"),
    "all_shortest_count": ("MATCH (a:Supplier {s_suppkey: 1}), (b:Nation {n_nationkey: 3}) MATCH p = allShortestPaths((a)-[:SUPPLIES|LOCATED_IN*..3]-(b)) RETURN length(p) AS l, count(*) AS n", "WITH x AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), d AS (SELECT count(*) AS n FROM supplier WHERE s_suppkey = 1 AND s_nationkey = 3), t AS (SELECT count(*) AS n FROM x a JOIN x b ON a.p = b.p AND b.s <> 1 JOIN supplier ON b.s = s_suppkey AND s_nationkey = 3 WHERE a.s = 1), u AS (SELECT count(*) AS n FROM supplier a JOIN supplier b ON false) SELECT CASE WHEN d.n > 0 THEN 1 ELSE 3 END AS l, CASE WHEN d.n > 0 THEN d.n ELSE t.n END AS n FROM d, t"),
    "all_shortest_suppliers": (
        "MATCH (a:Supplier), (b:Supplier {s_nationkey: 3}) WHERE id(a) <> id(b) MATCH p = allShortestPaths((a)-[:SUPPLIES*..2]-(b)) RETURN a.s_suppkey AS a, b.s_suppkey AS b, length(p) AS l, count(*) AS n",
        "WITH x AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) SELECT y.s AS a, z.s AS b, 2 AS l, count(*) AS n FROM x y JOIN x z ON y.p = z.p AND y.s <> z.s JOIN supplier o ON y.s = o.s_suppkey JOIN supplier e ON z.s = e.s_suppkey AND e.s_nationkey = 3 JOIN part ON y.p = p_partkey GROUP BY 1, 2",
    ),
    # projection, order, limits
    "distinct_rows": ("MATCH (o:Order) RETURN DISTINCT o.o_orderstatus AS s, o.o_orderpriority AS p", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders"),
    "order_skip_limit": ("MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_totalprice AS price ORDER BY price DESC, k SKIP 5 LIMIT 10", "SELECT o_orderkey AS k, o_totalprice AS price FROM orders ORDER BY price DESC, k LIMIT 10 OFFSET 5"),
    "order_nulls": ("UNWIND [3, null, 1] AS x WITH x ORDER BY x DESC LIMIT 2 RETURN x", "SELECT unnest([NULL, 3]) AS x"),
    "with_where_before_limit": ("MATCH (n:Nation) WITH n.n_nationkey AS k ORDER BY k LIMIT 3 WHERE k > 4 RETURN k", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 4 ORDER BY 1 LIMIT 3"),
    "return_star_count": ("MATCH (n:Nation) WITH n.n_regionkey AS r RETURN *, count(*) AS n", "SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY 1"),
    "case_simple": ("MATCH (o:Order) RETURN CASE o.o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS s, count(*) AS n", "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS s, count(*) AS n FROM orders GROUP BY 1"),
    "case_searched": ("MATCH (p:Part) RETURN CASE WHEN p.p_size < 10 THEN 'small' WHEN p.p_size < 30 THEN 'middle' END AS s, count(*) AS n", "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' END AS s, count(*) AS n FROM part GROUP BY 1"),
    "top_k_per_group": (
        "MATCH (c:Customer) WITH c.c_nationkey AS n, c ORDER BY c.c_acctbal DESC WITH n, collect(c.c_acctbal)[0..3] AS best UNWIND best AS top RETURN n, top",
        "SELECT c_nationkey AS n, c_acctbal AS top FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) <= 3",
    ),
    "collect_in_order": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, o ORDER BY o.o_orderstatus DESC, o.o_orderkey WITH c.c_custkey AS k, collect(o.o_orderkey) AS orders UNWIND range(0, size(orders) - 1) AS i RETURN k, i, orders[i] AS o",
        "SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus DESC, o_orderkey) - 1 AS i, o_orderkey AS o FROM orders JOIN customer ON c_custkey = o_custkey",
    ),
    "float_texts": (
        "MATCH (o:Order) WHERE o.o_totalprice < 1000000 RETURN o.o_orderkey AS k, toString(o.o_totalprice) AS t, toString(o.o_totalprice / 10 ^ 12 > 0) AS b",
        r"SELECT o_orderkey AS k, regexp_replace(CAST(o_totalprice AS VARCHAR), '\.0$', '') AS t, 'true' AS b FROM orders WHERE o_totalprice < 1000000",
    ),
    "float_text_forms": (
        "UNWIND [0.00002, 0.0001, 1000000.0, 12345678.1234567, 999999.0, -0.5, 1e21, 1.5e300, -0.0, 123456.789] AS x RETURN toString(x) AS t",
        "SELECT unnest(['2e-05', '0.0001', '1e+06', '1.23456781234567e+07', '999999', '-0.5', '1e+21', '1.5e+300', '-0', '123456.789']) AS t",
    ),
    "number_parsing": (
        "UNWIND ['7', ' 7 ', '1.5d', '1.5f', '-1.9', '+3', '1e3', '', 'x', '0x10', '9223372036854775807', '.5', '5.'] AS s RETURN s, toInteger(s) AS i, toFloat(s) AS f",
        "SELECT unnest(['7', ' 7 ', '1.5d', '1.5f', '-1.9', '+3', '1e3', '', 'x', '0x10', '9223372036854775807', '.5', '5.']) AS s, unnest([7, NULL, NULL, NULL, -1, 3, 1000, NULL, NULL, NULL, 9223372036854775807, 0, 5]) AS i, unnest([7.0::DOUBLE, NULL, NULL, NULL, -1.9, 3.0, 1000.0, NULL, NULL, NULL, 9223372036854775807::DOUBLE, 0.5, 5.0]) AS f",
    ),
    "truncate_with_map": (
        "MATCH (o:Order) WITH date(o.o_orderdate) AS d, o RETURN o.o_orderkey AS k, toString(date.truncate('month', d, {day: 4})) AS m, toString(date.truncate('year', d, {month: 3})) AS y, toString(date.truncate('week', d, {dayOfWeek: 3})) AS w",
        "SELECT o_orderkey AS k, strftime(date_trunc('month', o_orderdate) + INTERVAL 3 DAY, '%Y-%m-%d') AS m, strftime(date_trunc('year', o_orderdate) + INTERVAL 2 MONTH, '%Y-%m-%d') AS y, strftime(date_trunc('week', o_orderdate) + INTERVAL 2 DAY, '%Y-%m-%d') AS w FROM orders",
    ),
    "duration_between": (
        "MATCH (o:Order) WITH o.o_orderkey AS k, duration.between(date('1990-01-15'), date(o.o_orderdate)) AS d RETURN k, d.months AS m, d.days AS days, toString(d) AS t",
        "SELECT k, m, days, 'P' || CASE WHEN m // 12 > 0 THEN (m // 12) || 'Y' ELSE '' END || CASE WHEN m % 12 > 0 THEN (m % 12) || 'M' ELSE '' END || CASE WHEN days > 0 THEN days || 'D' ELSE '' END AS t FROM (SELECT *, date_diff('day', CAST(DATE '1990-01-15' + to_months(CAST(m AS INTEGER)) AS DATE), d) AS days FROM (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, date_sub('month', DATE '1990-01-15', CAST(o_orderdate AS DATE)) AS m FROM orders))",
    ),
    "range_sizes": ("MATCH (p:Part) RETURN p.p_partkey AS k, size(range(0, p.p_size)) AS a, size(range(p.p_size, 0, -3)) AS b", "SELECT p_partkey AS k, p_size + 1 AS a, p_size // 3 + 1 AS b FROM part"),
    "split_and_replace": (
        "MATCH (p:Part) RETURN p.p_partkey AS k, size(split(p.p_name, ' ')) AS n, replace(p.p_type, '', '-') AS r",
        "SELECT p_partkey AS k, len(string_split(p_name, ' ')) AS n, '-' || regexp_replace(p_type, '(.)', '\\1-', 'g') AS r FROM part",
    ),
    # aggregation
    "count_star": ("MATCH ()-[r:SUPPLIES]->() RETURN count(*) AS n", "SELECT count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)"),
    "count_distinct": ("MATCH (e:Event) RETURN e.event_type AS t, count(DISTINCT e.user_id) AS users", "SELECT event_type AS t, count(DISTINCT user_id) AS users FROM events GROUP BY 1"),
    "sum_avg": ("MATCH ()-[l:CONTAINS]->() RETURN l.l_returnflag AS f, sum(l.l_linenumber) AS s, avg(l.l_quantity) AS a, sum(l.l_quantity) AS q", "SELECT l_returnflag AS f, CAST(sum(l_linenumber) AS BIGINT) AS s, avg(l_quantity) AS a, sum(l_quantity) AS q FROM lineitem GROUP BY 1"),
    "min_max": ("MATCH (o:Order) RETURN o.o_orderstatus AS s, min(o.o_totalprice) AS a, max(o.o_orderpriority) AS b", "SELECT o_orderstatus AS s, min(o_totalprice) AS a, max(o_orderpriority) AS b FROM orders GROUP BY 1"),
    "stdev": ("MATCH (c:Customer) RETURN c.c_nationkey AS n, stdev(c.c_acctbal) AS s", "SELECT c_nationkey AS n, CASE WHEN count(*) = 1 THEN 0.0 ELSE stddev_samp(c_acctbal) END AS s FROM customer GROUP BY 1"),
    "stdevp": ("MATCH (c:Customer) RETURN stdevp(c.c_acctbal) AS s", "SELECT stddev_pop(c_acctbal) AS s FROM customer"),
    "percentile_cont": ("MATCH (o:Order) RETURN o.o_orderstatus AS s, percentileCont(o.o_totalprice, 0.9) AS p", "SELECT o_orderstatus AS s, quantile_cont(o_totalprice, 0.9) AS p FROM orders GROUP BY 1"),
    "percentile_disc": ("MATCH (c:Customer) RETURN c.c_mktsegment AS s, percentileDisc(c.c_acctbal, 0.5) AS p", "SELECT c_mktsegment AS s, list_sort(list(c_acctbal))[CAST(ceil(0.5 * (count(*) - 1)) AS INTEGER) + 1] AS p FROM customer GROUP BY 1"),
    "distinct_spread": (
        "MATCH (:Order)-[l:CONTAINS]->() RETURN l.l_returnflag AS f, percentileDisc(DISTINCT l.l_quantity, 0.3) AS d, percentileCont(DISTINCT l.l_quantity, 0.3) AS c, stdev(DISTINCT l.l_quantity) AS s, stdevp(DISTINCT l.l_quantity) AS p",
        "SELECT l_returnflag AS f, list_sort(list(q))[CAST(ceil(0.3 * (count(*) - 1)) AS INTEGER) + 1] AS d, quantile_cont(q, 0.3) AS c, stddev_samp(q) AS s, stddev_pop(q) AS p FROM (SELECT DISTINCT l_returnflag, CAST(l_quantity AS DOUBLE) AS q FROM lineitem) GROUP BY 1",
    ),
    "collect_size": ("MATCH (n:Nation)-[:CHILD]->(c:Customer) RETURN n.n_name AS n, size(collect(c.c_name)) AS k", "SELECT n_name AS n, count(*) AS k FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"),
    "collect_distinct": ("MATCH (n:Nation)-[:CHILD]->(c:Customer) WITH n, collect(DISTINCT c.c_mktsegment) AS l RETURN n.n_name AS n, size(l) AS k", "SELECT n_name AS n, count(DISTINCT c_mktsegment) AS k FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"),
    "global_agg_empty": ("MATCH (n:Nation) WHERE n.n_nationkey < 0 RETURN count(*) AS c, sum(n.n_nationkey) AS s, size(collect(n.n_name)) AS l, avg(n.n_nationkey) AS a, max(n.n_name) AS m", "SELECT 0 AS c, 0 AS s, 0 AS l, CAST(NULL AS DOUBLE) AS a, CAST(NULL AS VARCHAR) AS m"),
    "agg_in_expression": ("MATCH (o:Order) RETURN o.o_orderstatus AS s, count(*) * 2 + 1 AS n, [min(o.o_orderkey), max(o.o_orderkey)][1] AS last, sum(o.o_totalprice) / count(o) AS mean", "SELECT o_orderstatus AS s, count(*) * 2 + 1 AS n, max(o_orderkey) AS last, sum(o_totalprice) / count(*) AS mean FROM orders GROUP BY 1"),
    "having_via_with": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n WHERE n > 15 RETURN c.c_custkey AS c, n", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15"),
    "group_by_node": ("MATCH (s:Supplier)-[:LOCATED_IN]->(n:Nation) RETURN n.n_name AS name, count(s) AS k, max(s.s_acctbal) AS m ORDER BY k DESC, name LIMIT 5", "SELECT n_name AS name, count(*) AS k, max(s_acctbal) AS m FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name ORDER BY k DESC, name LIMIT 5"),
    # lists
    "unwind": ("UNWIND [[1, 2], [], [3]] AS l UNWIND l AS x RETURN x", "SELECT unnest([1, 2, 3]) AS x"),
    "unwind_null": ("UNWIND null AS x RETURN count(*) AS n", "SELECT 0 AS n"),
    "range_unwind": ("UNWIND range(10, 1, -3) AS x WITH x UNWIND range(x, 1) AS y RETURN x, y", "SELECT 1 AS x, 1 AS y"),
    "list_comprehension": ("MATCH (n:Nation) RETURN n.n_nationkey AS k, size([x IN range(1, n.n_nationkey) WHERE x % 3 = 0 | x * n.n_nationkey]) AS s", "SELECT n_nationkey AS k, CAST(n_nationkey // 3 AS BIGINT) AS s FROM nation"),
    "reduce_sum": ("MATCH (n:Nation) RETURN n.n_nationkey AS k, reduce(s = 0, x IN range(1, n.n_nationkey) | s + x) AS s", "SELECT n_nationkey AS k, CAST(n_nationkey * (n_nationkey + 1) // 2 AS BIGINT) AS s FROM nation"),
    "list_predicates": ("MATCH (n:Nation) WITH n.n_nationkey AS k, range(1, n.n_nationkey) AS l RETURN k, all(x IN l WHERE x < 10) AS a, any(x IN l WHERE x = 5) AS b, none(x IN l WHERE x > 20) AS c, single(x IN l WHERE x % 7 = 0) AS d", "SELECT n_nationkey AS k, n_nationkey < 10 AS a, n_nationkey >= 5 AS b, n_nationkey <= 20 AS c, n_nationkey BETWEEN 7 AND 13 AS d FROM nation"),
    "slice_index": ("MATCH (n:Nation) WITH n.n_nationkey AS k, range(0, n.n_nationkey) AS l RETURN k, l[1] AS a, l[-1] AS b, size(l[2..-1]) AS c, l[99] AS d", "SELECT n_nationkey AS k, CASE WHEN n_nationkey >= 1 THEN 1 END AS a, n_nationkey AS b, greatest(n_nationkey - 2, 0) AS c, CAST(NULL AS BIGINT) AS d FROM nation"),
    "head_last_tail": ("MATCH (n:Nation) WITH n.n_nationkey AS k, range(1, n.n_nationkey) AS l RETURN k, head(l) AS h, last(l) AS t, size(tail(l)) AS s, reverse(l)[0] AS r", "SELECT n_nationkey AS k, CASE WHEN n_nationkey > 0 THEN 1 END AS h, CASE WHEN n_nationkey > 0 THEN n_nationkey END AS t, greatest(n_nationkey - 1, 0) AS s, CASE WHEN n_nationkey > 0 THEN n_nationkey END AS r FROM nation"),
    "list_equality": ("RETURN [1, 2] = [1, 2] AS a, [1, null] = [1, 2] AS b, [1, null] = [2, 2] AS c, [1] = [1, 2] AS d, 2 IN [1, null] AS e, null IN [] AS f", "SELECT true AS a, CAST(NULL AS BOOLEAN) AS b, false AS c, false AS d, CAST(NULL AS BOOLEAN) AS e, false AS f"),
    # scalars
    "string_functions": ("MATCH (p:Part) RETURN p.p_partkey AS k, toUpper(p.p_name) AS u, substring(p.p_type, 1, 3) AS s, replace(p.p_brand, 'B', 'bb') AS r, size(split(p.p_type, ' ')) AS w, reverse(p.p_brand) AS v, trim('  x ') + ltrim(' y') + rtrim('z ') AS t", "SELECT p_partkey AS k, upper(p_name) AS u, substring(p_type, 2, 3) AS s, replace(p_brand, 'B', 'bb') AS r, len(string_split(p_type, ' ')) AS w, reverse(p_brand) AS v, 'xyz' AS t FROM part"),
    "numeric_functions": ("MATCH (c:Customer) RETURN c.c_custkey AS k, abs(c.c_acctbal) AS a, ceil(c.c_acctbal) AS c, sign(c.c_acctbal) AS s, sqrt(c.c_custkey) AS r, c.c_custkey % 7 AS m, c.c_custkey ^ 2 AS p", "SELECT c_custkey AS k, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, CAST(sign(c_acctbal) AS BIGINT) AS s, sqrt(c_custkey) AS r, c_custkey % 7 AS m, CAST(c_custkey * c_custkey AS DOUBLE) AS p FROM customer"),
    "conversions": ("RETURN toInteger('42') AS a, toInteger('4.9') AS b, toInteger('x') AS c, toFloat('1.5') AS d, toBoolean('T') AS e, toString(12) AS f, toInteger(true) AS g, toBoolean('maybe') AS h", "SELECT 42 AS a, 4 AS b, CAST(NULL AS BIGINT) AS c, CAST(1.5 AS DOUBLE) AS d, true AS e, '12' AS f, 1 AS g, CAST(NULL AS BOOLEAN) AS h"),
    "integer_division": ("UNWIND [-7, 7, 8] AS x RETURN x, x / 2 AS q, x % 2 AS r, x / 2.0 AS f", "SELECT x, CAST(trunc(x / 2.0) AS BIGINT) AS q, x % 2 AS r, CAST(x AS DOUBLE) / 2 AS f FROM (SELECT unnest([-7, 7, 8]) AS x)"),
    "float_division_by_zero": ("RETURN 1.0 / 0 = 1.0 / 0 AS inf, (0.0 / 0) = (0.0 / 0) AS nan, 0.0 / 0 < 1 AS less", "SELECT true AS inf, false AS nan, false AS less"),
    "exact_comparison": ("RETURN 9007199254740993 = 9007199254740992.0 AS a, 9007199254740993 > 9007199254740992.0 AS b, 1 = 1.0 AS c", "SELECT false AS a, true AS b, true AS c"),
    "keys_properties": ("MATCH (n:Nation) RETURN n.n_nationkey AS k, keys(n)[0] AS first, properties(n).n_name AS name, size(keys({a: 1, b: null})) AS m", "SELECT n_nationkey AS k, 'n_name' AS first, n_name AS name, 2 AS m FROM nation"),
    "coalesce": ("MATCH (n:Nation) RETURN n.n_nationkey AS k, coalesce(n.nothing, n.n_name, 'x') AS c", "SELECT n_nationkey AS k, n_name AS c FROM nation"),
    # time
    "date_components": ("MATCH (o:Order) WITH o.o_orderkey AS k, o.o_orderdate AS d RETURN k, d.year AS y, d.month AS m, d.day AS d, d.quarter AS q, d.week AS w, d.ordinalDay AS o, d.weekDay AS x", "SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, week(o_orderdate) AS w, dayofyear(o_orderdate) AS o, isodow(o_orderdate) AS x FROM orders"),
    "date_truncate": ("MATCH (o:Order) RETURN o.o_orderkey AS k, toString(date.truncate('month', o.o_orderdate)) AS m, toString(date.truncate('week', o.o_orderdate)) AS w, date.truncate('decade', o.o_orderdate).year AS d", "SELECT o_orderkey AS k, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS w, year(o_orderdate) - year(o_orderdate) % 10 AS d FROM orders"),
    "duration_add": ("MATCH (o:Order) RETURN o.o_orderkey AS k, toString(date(o.o_orderdate) + duration('P1M10D')) AS d", "SELECT o_orderkey AS k, strftime(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH + INTERVAL 10 DAY, '%Y-%m-%d') AS d FROM orders"),
    "duration_between_days": ("MATCH (o:Order) RETURN o.o_orderkey AS k, duration.inDays(date('1995-01-01'), date(o.o_orderdate)).days AS d", "SELECT o_orderkey AS k, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders"),
    "temporal_texts": ("RETURN toString(date('2015W302')) AS a, toString(date('2015-202')) AS b, toString(localtime('21:40:32.142')) AS c, toString(time('21:40+01:30')) AS d, toString(duration('P1Y2M10DT2H30M')) AS e, toString(datetime('2015-07-21T21:40:32Z')) AS f, toString(date({year: 1984, week: 10, dayOfWeek: 3})) AS g, toString(localdatetime('2015-W30-2T214032.142')) AS h", "SELECT '2015-07-21' AS a, '2015-07-21' AS b, '21:40:32.142' AS c, '21:40+01:30' AS d, 'P1Y2M10DT2H30M' AS e, '2015-07-21T21:40:32Z' AS f, '1984-03-07' AS g, '2015-07-21T21:40:32.142' AS h"),
    # sets and calls
    "union_distinct": ("MATCH (c:Customer) RETURN c.c_nationkey AS n UNION MATCH (s:Supplier) RETURN s.s_nationkey AS n", "SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier"),
    "union_all": ("MATCH (r:Region) RETURN r.r_name AS n UNION ALL MATCH (r:Region) RETURN r.r_name AS n", "SELECT r_name AS n FROM region UNION ALL SELECT r_name FROM region"),
    "call_subquery": ("MATCH (c:Customer) CALL { WITH c MATCH (c)-[:PLACED]->(o:Order) RETURN o.o_orderkey AS k ORDER BY o.o_totalprice DESC, k LIMIT 1 } RETURN c.c_custkey AS c, k", "SELECT o_custkey AS c, o_orderkey AS k FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1"),
    "call_subquery_count": ("MATCH (n:Nation) CALL { WITH n MATCH (n)<-[:LOCATED_IN]-(s) WITH count(s) AS k RETURN k } RETURN sum(k) AS s", "SELECT count(*) AS s FROM supplier"),
    "call_labels": ("CALL db.labels() YIELD label RETURN label", "SELECT unnest(['Customer', 'Document', 'Event', 'Nation', 'Order', 'Part', 'Region', 'Supplier', 'Turn', 'User']) AS label"),
    "call_rel_types": ("CALL db.relationshipTypes() YIELD relationshipType AS t RETURN t", "SELECT unnest(['CHILD', 'CONTAINS', 'DID', 'LOCATED_IN', 'NEXT', 'PLACED', 'SUPPLIES']) AS t"),
    "call_property_keys": ("CALL db.propertyKeys() YIELD propertyKey AS p WHERE p STARTS WITH 'n_' RETURN p", "SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey', 'n_chars']) AS p"),
    "call_nodes": ("CALL graph.nodes() YIELD node WITH labels(node)[0] AS l RETURN l, count(*) AS n", "SELECT 'Region' AS l, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'User', count(DISTINCT user_id) FROM events UNION ALL SELECT 'Event', count(*) FROM events UNION ALL SELECT 'Document', count(*) FROM documents UNION ALL SELECT 'Turn', count(*) FROM conversations"),
}


#: Floating columns of the queries, which are rounded so that the order of additions doesn't show.
FLOATS = {
    "point_lookup": ["price"],
    "order_skip_limit": ["price"],
    "top_k_per_group": ["top"],
    "number_parsing": ["f"],
    "sum_avg": ["a", "q"],
    "min_max": ["a"],
    "stdev": ["s"],
    "stdevp": ["s"],
    "percentile_cont": ["p"],
    "percentile_disc": ["p"],
    "distinct_spread": ["d", "c", "s", "p"],
    "agg_in_expression": ["mean"],
    "group_by_node": ["m"],
    "numeric_functions": ["a", "c", "r", "p"],
    "integer_division": ["f"],
    "conversions": ["d"],
}
PLACES = 4


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{n}`"), PLACES).alias(n) if k in ("double", "float") else F.col(f"`{n}`") for n, k in df.dtypes])


def _history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as a history: each distinct order date is a revision, in which its orders begin."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    dates = orders.select("o_orderdate").distinct()
    revisions = dates.select(F.dense_rank().over(Window.orderBy("o_orderdate")).cast("long").alias("revision"), F.col("o_orderdate").cast("timestamp").alias("time"), F.lit("clerk").alias("actor"), F.lit("").alias("message"))
    nodes = orders.join(revisions.select("revision", F.col("time").alias("t")), F.col("o_orderdate").cast("timestamp") == F.col("t"))
    nodes = nodes.select(F.concat(F.lit("Order:"), F.col("o_orderkey").cast("string")).alias("id"), F.array(F.lit("Order")).alias("labels"), F.lit("").alias("body"), "o_orderkey", "o_orderstatus", F.col("revision").alias("valid_from"))
    return nodes, revisions


def _snapshot(at: str) -> Callable[[SparkSession, str], DataFrame]:
    """The graph as of a revision that a condition on revisions chooses."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes, revisions = _history(spark, sf_dir)
        last = revisions.where(at).agg(F.coalesce(F.max("revision"), F.lit(0)).alias("last"))
        then = nodes.join(F.broadcast(last), F.col("valid_from") <= F.col("last")).drop("last", "valid_from")  # one row
        return cypher.query(from_rows(spark, then, _no_edges(spark), revisions), "MATCH (o:Order) RETURN o.o_orderstatus AS s, count(*) AS n")

    return run


def _no_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id string, from_id string, type string, to_id string, position long")


def _revisions_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, revisions = _history(spark, sf_dir)
    return cypher.query(from_rows(spark, nodes.drop("valid_from"), _no_edges(spark), revisions), "CALL graph.revisions(5, 10) YIELD revision, actor, next RETURN revision, actor, next")


def _written(change: str, read: str) -> Callable[[SparkSession, str], DataFrame]:
    """A change of the graph of nations and suppliers, staged, and what is read from it then."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nation, supplier = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("nation", "supplier"))
        node = lambda df, label, key, name: df.select(F.concat(F.lit(f"{label}:"), F.col(key).cast("string")).alias("id"), F.array(F.lit(label)).alias("labels"), F.lit("").alias("body"), F.col(key).cast("long").alias("key"), F.col(name).alias("name"))
        nodes = node(nation, "Nation", "n_nationkey", "n_name").unionByName(node(supplier, "Supplier", "s_suppkey", "s_name"))
        edges = supplier.select(F.concat(F.lit("L:"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("Supplier:"), F.col("s_suppkey").cast("string")).alias("from_id"), F.lit("LOCATED_IN").alias("type"), F.concat(F.lit("Nation:"), F.col("s_nationkey").cast("string")).alias("to_id"), F.lit(None).cast("long").alias("position"))
        batch = Batch(from_rows(spark, nodes, edges))
        for statement in parse(change):
            batch.run(statement)
        return cypher.query(batch.graph, read)

    return run


def _nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a first commit: nations, and none."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    nodes = nation.select(F.concat(F.lit("Nation:"), F.col("n_nationkey").cast("string")).alias("id"), F.array(F.lit("Nation")).alias("labels"), F.lit("").alias("body"), F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"), F.lit(False).alias("deleted"))
    return nodes, _no_edges(spark).withColumn("deleted", F.lit(False))


def _stored(changes: list[str], read: str, revision: int | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """What is read from a store, now or at a revision, after its first commit and some statements."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
        store.commit(*_nations(spark, sf_dir), actor="loader")
        for text in changes:
            execute(store, text, actor="me")
        return cypher.query(store.graph(revision), read)

    return run


def _label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a statement that sets two labels, one of which the nodes have."""
    nodes, edges = _nations(spark, sf_dir)
    batch = Batch(from_rows(spark, nodes.drop("deleted"), edges.drop("deleted")))
    for statement in parse("MATCH (n:Nation) WHERE n.key < 10 SET n:Nation:Low; MATCH (n:Low) WHERE n.key < 4 REMOVE n:Low:Other"):
        batch.run(statement)
    return spark.createDataFrame([(batch.counters["labels_added"], batch.counters["labels_removed"])], "added long, removed long")


def _history_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of a sound store, and of one into whose files a second row of a node has got."""
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    store.commit(*_nations(spark, sf_dir))
    sound = store.problems().count()
    folder = store.revisions().first()["folder"]
    _nations(spark, sf_dir)[0].where("key = 3").withColumn("revision", F.lit(1).cast("long")).write.mode("append").parquet(f"{store.folder}/nodes/{FOLDER}={folder}")
    return store.problems().select(F.lit(sound).cast("long").alias("before"), "what", "id")


#: name: (what gives the rows, SQL)
OTHER: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "snapshot_at_revision": (_snapshot("revision <= 40"), "SELECT o_orderstatus AS s, count(*) AS n FROM (SELECT *, dense_rank() OVER (ORDER BY o_orderdate) AS r FROM orders) WHERE r <= 40 GROUP BY 1"),
    "snapshot_at_time": (_snapshot("time <= timestamp '1996-06-01 00:00:00'"), "SELECT o_orderstatus AS s, count(*) AS n FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-01' GROUP BY 1"),
    "revisions_page": (_revisions_page, "SELECT unnest([11, 12, 13, 14, 15]) AS revision, 'clerk' AS actor, 15 AS next"),
    "create_nodes": (
        _written("MATCH (n:Nation) CREATE (n)-[:HAS {since: n.key + 1900}]->(:Capital {name: 'capital of ' + n.name})", "MATCH (n:Nation)-[h:HAS]->(c:Capital) RETURN n.name AS n, c.name AS c, h.since AS s"),
        "SELECT n_name AS n, 'capital of ' || n_name AS c, n_nationkey + 1900 AS s FROM nation",
    ),
    "merge_upsert": (
        _written("UNWIND range(20, 29) AS k MERGE (n:Nation {key: k}) ON CREATE SET n.name = 'new' ON MATCH SET n.seen = true", "MATCH (n:Nation) RETURN n.key AS k, n.name AS name, n.seen AS seen"),
        "SELECT n_nationkey AS k, n_name AS name, CASE WHEN n_nationkey >= 20 THEN true END AS seen FROM nation UNION ALL SELECT unnest(range(25, 30)), 'new', NULL",
    ),
    "set_property": (_written("MATCH (n:Nation) WHERE n.key > 10 SET n.rank = n.key * 2, n.name = null", "MATCH (n:Nation) RETURN n.key AS k, n.rank AS r, n.name AS name"), "SELECT n_nationkey AS k, CASE WHEN n_nationkey > 10 THEN n_nationkey * 2 END AS r, CASE WHEN n_nationkey <= 10 THEN n_name END AS name FROM nation"),
    "remove_label": (_written("MATCH (n:Nation) WHERE n.key < 5 REMOVE n:Nation SET n:Old", "MATCH (n) WHERE n:Nation OR n:Old RETURN labels(n)[0] AS l, count(*) AS n"), "SELECT CASE WHEN n_nationkey < 5 THEN 'Old' ELSE 'Nation' END AS l, count(*) AS n FROM nation GROUP BY 1"),
    "store_commit_read": (
        _stored(["MATCH (n:Nation) WHERE n.key < 3 SET n.rank = n.key + 1", "CREATE (:Nation {key: 99, name: 'new'})"], "MATCH (n:Nation) RETURN n.key AS k, n.name AS name, n.rank AS r"),
        "SELECT n_nationkey AS k, n_name AS name, CASE WHEN n_nationkey < 3 THEN n_nationkey + 1 END AS r FROM nation UNION ALL SELECT 99, 'new', NULL",
    ),
    "store_time_travel": (
        _stored(["MATCH (n:Nation) WHERE n.key < 3 DETACH DELETE n", "MATCH (n:Nation) SET n.name = 'gone'"], "MATCH (n:Nation) RETURN n.key AS k, n.name AS name", revision=2),
        "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey >= 3",
    ),
    "store_net_no_op": (
        _stored(["CREATE (x:Tmp) WITH x DETACH DELETE x", "MATCH (n:Nation) SET n.name = n.name", "MATCH (n:Nation {key: 0}) SET n.name = 'first'"], "CALL graph.revisions(10) YIELD revision, actor RETURN revision, actor"),
        "SELECT unnest([1, 2]) AS revision, unnest(['loader', 'me']) AS actor",
    ),
    "store_problems": (_history_problems, "SELECT 0 AS before, 'nodes: changed twice in a revision' AS what, 'Nation:3' AS id"),
    "set_labels_counted": (_label_counts, "SELECT count(CASE WHEN n_nationkey < 10 THEN 1 END) AS added, count(CASE WHEN n_nationkey < 4 THEN 1 END) AS removed FROM nation"),
    "detach_delete": (_written("MATCH (n:Nation) WHERE n.key < 12 DETACH DELETE n", "MATCH (s:Supplier) OPTIONAL MATCH (s)-[:LOCATED_IN]->(n) RETURN count(s) AS s, count(n) AS n"), "SELECT count(*) AS s, count(CASE WHEN s_nationkey >= 12 THEN 1 END) AS n FROM supplier"),
}


def _reader(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(cypher.query(over_tables(spark, sf_dir), text))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _reader(text) for name, (text, _) in READ.items()} | {name: run for name, (run, _) in OTHER.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (_, sql) in READ.items():
        cut = ", ".join(f"round({x}, {PLACES}) AS {x}" for x in FLOATS.get(name, []))
        out[name] = f"SELECT * REPLACE ({cut}) FROM ({sql})" if cut else sql
    return out | {name: sql for name, (_, sql) in OTHER.items()}
