"""The SQL that an independent engine answers like the query of the same name."""

ORACLE_SQL: dict[str, str] = {
    'scan_full': 'SELECT * FROM nation',
    'project_columns': 'SELECT o_totalprice, o_orderkey FROM orders',
    'filter_eq': "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R'",
    'filter_ne': "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'",
    'filter_gt': 'SELECT o_orderkey FROM orders WHERE o_totalprice > 100000',
    'filter_lt': 'SELECT o_orderkey FROM orders WHERE o_totalprice < 50000',
    'filter_ge': 'SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 45',
    'filter_le': 'SELECT p_partkey FROM part WHERE p_size <= 10',
    'filter_and': "SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND l_quantity = 10",
    'filter_or': "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '1-URGENT'",
    'filter_nested_bool': "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 90000) OR (o_orderstatus = 'O' AND NOT (o_totalprice >= 30000))",
    'filter_is_null': "SELECT c_custkey FROM (SELECT c_custkey, NULLIF(c_mktsegment,'BUILDING') s FROM customer) x WHERE s IS NULL",
    'filter_datetime': "SELECT l_orderkey, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-02-01 00:00:00'",
    'seek_point': 'SELECT * FROM orders WHERE o_orderkey = 25',
    'seek_range': 'SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 9000 AND 9500',
    'index_scan_nonleading': 'SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_linenumber = 3',
    'secondary_range': 'SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 900 AND 950',
    'large_text': 'SELECT doc_id, CAST(LENGTH(text) AS INTEGER) n FROM documents WHERE LENGTH(text) >= 1024',
    'cast_types': "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS BOOLEAN) b, CAST(CAST(o_orderkey % 100 AS VARCHAR) AS TINYINT) t, CAST('2024-04-12 12:12:12' AS TIMESTAMP) d FROM orders",
    'limit_topk': 'SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20',
    'order_asc': 'SELECT c_custkey, c_name FROM customer ORDER BY c_name ASC',
    'order_desc': 'SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderkey DESC',
    'order_multi_key': 'SELECT o_orderstatus, o_totalprice, o_orderkey FROM orders ORDER BY o_orderstatus ASC, o_totalprice DESC, o_orderkey ASC',
    'compat_string_order': 'SELECT n_name FROM nation ORDER BY strlen(n_name) ASC, n_name DESC',
    'join_inner_equi': 'SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey',
    'join_multi_key': 'SELECT a.l_orderkey, a.l_linenumber, a.l_quantity q1, b.l_quantity q2 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_quantity < b.l_quantity',
    'join_intermediate': 'SELECT x.o_orderkey, x.c_name, n.n_name, r.r_name FROM (SELECT o.o_orderkey, c.c_name, c.c_nationkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 100000) x JOIN nation n ON x.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey',
    'join_theta': 'SELECT a.n_nationkey k1, b.n_nationkey k2 FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey',
    'sql_join': 'SELECT r_name, COUNT(*) n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name',
    'group_single_key': 'SELECT l_returnflag, COUNT(*) n FROM lineitem GROUP BY l_returnflag',
    'group_multi_key': 'SELECT l_returnflag, l_linestatus, COUNT(*) n FROM lineitem GROUP BY l_returnflag, l_linestatus',
    'group_keys_only': 'SELECT o_orderstatus FROM orders GROUP BY o_orderstatus',
    'agg_count_col': "SELECT o_orderstatus, COUNT(NULLIF(o_orderpriority,'5-LOW')) n FROM orders GROUP BY o_orderstatus",
    'agg_count_star': 'SELECT COUNT(*) n FROM lineitem',
    'agg_sum': 'SELECT o_orderstatus, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) s, CAST(SUM(o_custkey) AS BIGINT) k FROM orders GROUP BY o_orderstatus',
    'agg_avg': 'SELECT l_returnflag, AVG(CAST(l_quantity AS BIGINT)) a FROM lineitem GROUP BY l_returnflag',
    'agg_max': 'SELECT l_linestatus, MAX(l_quantity) m, MAX(l_shipdate) d, MAX(l_returnflag) s FROM lineitem GROUP BY l_linestatus',
    'agg_min': 'SELECT l_linestatus, MIN(l_quantity) m, MIN(l_shipdate) d, MIN(l_returnflag) s FROM lineitem GROUP BY l_linestatus',
    'agg_global': 'SELECT COUNT(*) n, MIN(o_totalprice) lo, MAX(o_totalprice) hi FROM orders',
    'agg_all_five': 'SELECT c_mktsegment, COUNT(*) n, CAST(SUM(c_nationkey) AS BIGINT) s, AVG(c_nationkey) a, MIN(c_acctbal) lo, MAX(c_acctbal) hi FROM customer GROUP BY c_mktsegment',
    'having_filter': 'SELECT o_custkey, COUNT(*) n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12',
    'dml_insert': "SELECT * FROM nation UNION ALL SELECT 25, 'NATION_25', 0",
    'dml_unique_check': 'SELECT o_custkey FROM orders GROUP BY o_custkey HAVING COUNT(*) > 1',
    'dml_update': "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'UPDATED' ELSE n_name END n_name, n_regionkey FROM nation",
    'dml_delete': "SELECT * FROM customer WHERE NOT COALESCE(c_mktsegment = 'BUILDING', FALSE)",
    'dml_truncate': 'SELECT * FROM nation WHERE FALSE',
    'sql_where': 'SELECT * FROM orders WHERE o_orderkey = 25',
    'sql_subquery_from': "SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F') s WHERE o_totalprice > 100000",
    'sql_group_having': 'SELECT o_orderpriority, COUNT(*) n FROM orders GROUP BY o_orderpriority HAVING COUNT(*) > 10',
    'sql_order_by': 'SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC',
    'sql_insert': "SELECT * FROM nation UNION ALL SELECT 25, 'NATION_25', 0 UNION ALL SELECT 26, 'NATION_26', 1 UNION ALL SELECT n_nationkey + 100, NULL, n_regionkey FROM nation WHERE n_nationkey < 3",
    'sql_update': "SELECT n_nationkey, CASE WHEN n_regionkey = 1 OR n_nationkey IN (3, 4) THEN concat(n_name, '!') ELSE n_name END n_name, CAST(CASE WHEN n_regionkey = 1 OR n_nationkey IN (3, 4) THEN n_regionkey + 1 ELSE n_regionkey END AS INTEGER) n_regionkey FROM nation",
    'sql_delete': 'SELECT * FROM nation WHERE NOT (n_regionkey = 1 AND n_nationkey > 5)',
    'sql_select_stored': 'SELECT n_regionkey, COUNT(*) n FROM nation WHERE n_nationkey <> 7 GROUP BY n_regionkey HAVING COUNT(*) > 1',
    'flagship': 'SELECT l_returnflag, l_linestatus, COUNT(*) n, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) sum_qty, AVG(CAST(l_quantity AS BIGINT)) avg_qty, MIN(l_extendedprice) min_price, MAX(l_extendedprice) max_price FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 0 ORDER BY l_returnflag DESC, l_linestatus',
    'str_concat': "SELECT p_partkey, CONCAT(p_brand, ':', p_type) v FROM part",
    'str_ascii': 'SELECT p_partkey, CAST(ASCII(p_type) AS INTEGER) v FROM part',
    'str_char': 'SELECT n_nationkey, CHR(65 + n_nationkey) v FROM nation',
    'str_charindex': "SELECT p_partkey, CAST(STRPOS(p_name,'widget') AS INTEGER) v, CAST(STRPOS(p_name,'widget') - 1 AS INTEGER) v0 FROM part",
    'str_datalength': 'SELECT doc_id, CAST(strlen(text) AS INTEGER) v FROM documents',
    'str_left': 'SELECT p_partkey, LEFT(p_type, 3) v FROM part',
    'str_right': 'SELECT p_partkey, RIGHT(p_type, 3) v FROM part',
    'str_length': 'SELECT p_partkey, CAST(LENGTH(p_name) AS INTEGER) v FROM part',
    'str_length_trimmed': "SELECT p_partkey, CAST(LENGTH(TRIM(CONCAT('  ',p_name,' '))) AS INTEGER) v FROM part",
    'str_lower': 'SELECT p_partkey, LOWER(p_type) v FROM part',
    'str_upper': 'SELECT p_partkey, UPPER(p_name) v FROM part',
    'str_trim': "SELECT p_partkey, TRIM(CONCAT('  ',p_name,' ')) v FROM part",
    'str_ltrim': "SELECT p_partkey, LTRIM(CONCAT('  ',p_name,' ')) v FROM part",
    'str_rtrim': "SELECT p_partkey, RTRIM(CONCAT('  ',p_name,' ')) v FROM part",
    'str_replace': "SELECT p_partkey, REPLACE(p_name,'widget','gadget') v FROM part",
    'str_substring': 'SELECT p_partkey, SUBSTRING(p_name, 2, 4) v FROM part',
    'dt_make': 'SELECT n_nationkey, make_timestamp(2024, 1, 1 + n_nationkey, 1, 2, 3.0) v FROM nation',
    'dt_from_epoch': 'SELECT event_id, make_timestamp(1700000000000000 + event_id * 1000000) v FROM events',
    'dt_date_parts': 'SELECT o_orderkey, CAST(YEAR(o_orderdate) AS INTEGER) y, CAST(MONTH(o_orderdate) AS INTEGER) m, CAST(DAY(o_orderdate) AS INTEGER) d FROM orders',
    'dt_time_parts': 'SELECT event_id, CAST(HOUR(ts) AS INTEGER) h, CAST(MINUTE(ts) AS INTEGER) m, CAST(SECOND(ts) AS INTEGER) s FROM events',
    'dt_add': 'SELECT event_id, ts + INTERVAL 3 DAY d3, ts + INTERVAL 90 SECOND s90 FROM events',
    'dt_parse': "SELECT n_nationkey, strptime('2024-04-12 12:12:12','%Y-%m-%d %H:%M:%S') v FROM nation",
    'dt_epoch': 'SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) v FROM orders',
    'dt_format': "SELECT event_id, strftime(ts,'%Y-%m-%d %H:%M:%S') v FROM events",
    'dec_parse': "SELECT o_orderkey, CAST(CONCAT(CAST(o_orderkey AS VARCHAR), '.5') AS DECIMAL(18,8)) v FROM orders",
    'dec_add': 'SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) + CAST(1.77 AS DECIMAL(18,2)) AS DECIMAL(19,2)) v FROM orders',
    'dec_compare': 'SELECT o_orderkey FROM orders WHERE CAST(o_totalprice AS DECIMAL(18,2)) > CAST(100000.50 AS DECIMAL(18,2))',
}
