"""Clauses that dialects write in their own way."""

from polyquery.queries.base import sql

LIMITED = "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 5"
sql("dialect_top", "SELECT TOP (5) [o_orderkey], o_totalprice FROM [orders] WITH (NOLOCK) ORDER BY o_totalprice DESC, o_orderkey OPTION (MAXDOP 1)", LIMITED, "sqlserver")
sql("dialect_offset_fetch", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 5 ROWS FETCH NEXT 4 ROWS ONLY", "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 4 offset 5", "oracle")
sql("dialect_fetch_first", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey FETCH FIRST 5 ROWS ONLY", LIMITED, "db2")
sql("dialect_limit_comma", "SELECT `o_orderkey` FROM `orders` USE INDEX (`pk`) ORDER BY o_totalprice DESC, o_orderkey LIMIT 5, 4", "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 4 offset 5", "mysql")
sql("dialect_first_skip", "SELECT FIRST 4 SKIP 5 o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey", "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 4 offset 5", "firebird")
sql("dialect_rows_to", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey ROWS 6 TO 9", "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 4 offset 5", "firebird")
sql("dialect_dual", "SELECT NVL(NULL, 'x') AS v, 1 + 1 AS n FROM dual", "select 'x' as v, 2 as n", "oracle")
sql("dialect_rdb_database", "SELECT 7 AS n FROM RDB$DATABASE", "select 7 as n", "firebird")
sql("dialect_like_ignores_case", "SELECT n_name FROM nation WHERE n_name LIKE 'a%'", "select n_name from nation where n_name ilike 'a%'", "mysql")
sql("dialect_equal_ignores_case", "SELECT n_nationkey FROM nation WHERE n_name = 'brazil' OR n_name = 'Nation_3'", "select n_nationkey from nation where lower(n_name) in ('brazil', 'nation_3')", "sqlserver")
sql("dialect_alias_equals", "SELECT k = n_nationkey, n = n_name FROM nation", "select n_nationkey as k, n_name as n from nation", "sqlserver")
sql("dialect_regex_operators", "SELECT n_name FROM nation WHERE n_name ~ '^[A-N]' AND n_name !~* 'x'", "select n_name from nation where regexp_matches(n_name, '^[A-N]') and not regexp_matches(n_name, '(?i)x')", "postgres")
sql("dialect_mysql_regexp", "SELECT n_name FROM nation WHERE n_name REGEXP 'A$' OR n_name RLIKE '^B' # remark", "select n_name from nation where regexp_matches(n_name, 'A$|^B')", "mysql")
sql("dialect_oracle_concat", "SELECT n_nationkey, n_name || NULL || '!' AS x FROM nation", "select n_nationkey, n_name || '!' as x from nation", "oracle")
sql("dialect_sounds_like", "SELECT n_nationkey FROM nation WHERE n_name SOUNDS LIKE n_name", "select n_nationkey from nation", "mysql")
sql("dialect_stddev_population", "SELECT ROUND(STD(c_acctbal), 4) AS s FROM customer", "select round(stddev_pop(c_acctbal), 4) as s from customer", "mysql")
sql("dialect_count_type", "SELECT COUNT(*) AS n FROM nation", "select count(*)::int as n from nation", "sqlserver")
sql("dialect_auto", "SELECT TOP 3 o_orderkey, IFNULL(o_orderstatus, 'x') AS s FROM orders ORDER BY o_orderkey", "select o_orderkey, o_orderstatus as s from orders order by o_orderkey limit 3", "auto")
sql("dialect_found_rows", "SELECT SQL_CALC_FOUND_ROWS o_orderkey FROM orders ORDER BY o_orderkey LIMIT 3", "select o_orderkey from orders order by o_orderkey limit 3", "mysql")
sql("dialect_text_in_ignores_case", "SELECT n_nationkey FROM nation WHERE n_name IN ('nation_1', 'NATION_3', 'Nation_5') AND n_name <> 'nation_5'", "select n_nationkey from nation where lower(n_name) in ('nation_1', 'nation_3')", "mysql")
sql("dialect_text_not_in_ignores_case", "SELECT n_nationkey FROM nation WHERE n_name NOT IN ('nation_1', 'NATION_3')", "select n_nationkey from nation where lower(n_name) not in ('nation_1', 'nation_3')", "mysql")
