"""PIVOT, UNPIVOT, JSON rows and documents."""

from polyquery.queries.base import sql

sql("pivot_count", "select * from (select o_orderstatus, o_orderpriority, o_orderkey from orders) pivot (count(o_orderkey) for o_orderstatus in ('F' as f, 'O' as o, 'P' as p))", "select o_orderpriority, nullif(count(*) filter (where o_orderstatus = 'F'), 0) as f, nullif(count(*) filter (where o_orderstatus = 'O'), 0) as o, nullif(count(*) filter (where o_orderstatus = 'P'), 0) as p from orders group by 1")
sql("pivot_aggregates", "select * from (select c_mktsegment, c_nationkey, c_acctbal from customer) pivot (round(sum(c_acctbal), 2) as s, max(c_acctbal) as m for c_nationkey in (0 as n0, 1 as n1, 2 as n2))", "select c_mktsegment, " + ", ".join(f"round(sum(c_acctbal) filter (where c_nationkey = {k}), 2) as n{k}_s, max(c_acctbal) filter (where c_nationkey = {k}) as n{k}_m" for k in range(3)) + " from customer group by 1")
sql("unpivot", "select s_suppkey, measure, amount from (select s_suppkey, cast(s_nationkey as double) as nation, s_acctbal as balance, nullif(s_acctbal, s_acctbal) as nothing from supplier) unpivot (amount for measure in (nation, balance, nothing))", "select s_suppkey, 'nation' as measure, s_nationkey::double as amount from supplier union all select s_suppkey, 'balance', s_acctbal from supplier")
sql("for_json_path", "select r_regionkey, r_name from region where r_regionkey = 1 for json path", "select '[{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}]' as json from region where r_regionkey = 1", "sqlserver")
sql("for_json_root_nulls", "select r_regionkey, nullif(r_name, r_name) as x from region where r_regionkey = 2 for json path, root('r'), include_null_values", "select '{\"r\":[{\"r_regionkey\":2,\"x\":null}]}' as json", "sqlserver")
sql("for_json_no_wrapper", "select r_regionkey from region where r_regionkey = 3 for json path, without_array_wrapper", "select '{\"r_regionkey\":3}' as json", "sqlserver")
sql("string_split", "select n_nationkey, s.value, s.ordinal from nation cross apply string_split(n_name, 'A', 1) s", "select n_nationkey, unnest(string_split(n_name, 'A')) as value, generate_subscripts(string_split(n_name, 'A'), 1)::int as ordinal from nation", "sqlserver")
sql("openjson", "select e.event_id, j.key, j.value, j.type from events e cross apply openjson(e.props) j", "select event_id, j.key, case when j.type = 'VARCHAR' then j.value ->> '$' else j.value::varchar end as value, case j.type when 'NULL' then 0 when 'VARCHAR' then 1 when 'BOOLEAN' then 3 when 'ARRAY' then 4 when 'OBJECT' then 5 else 2 end as type from events, lateral (select * from json_each(events.props)) j", "sqlserver")
sql("openjson_literal", "select j.[key], j.value, j.type from openjson('[1,\"a\",null,true,[2],{\"b\":3}]') j", "select * from (values ('0', '1', 2), ('1', 'a', 1), ('2', null, 0), ('3', 'true', 3), ('4', '[2]', 4), ('5', '{\"b\":3}', 5)) t(key, value, type)", "sqlserver")
sql("openjson_with", "select j.id, j.name, j.tags from openjson('{\"rows\":[{\"id\":1,\"n\":{\"x\":\"a\"},\"tags\":[1,2]},{\"id\":2}]}', '$.rows') with (id int '$.id', name varchar(10) '$.n.x', tags nvarchar(max) '$.tags' as json) j", "select * from (values (1, 'a', '[1,2]'), (2, null, null)) t(id, name, tags)", "sqlserver")
sql("json_table", "select j.* from json_table('[{\"a\":1,\"b\":\"x\"},{\"a\":2},{\"b\":\"z\"}]', '$[*]' columns (id for ordinality, a int path '$.a' default '9' on empty, b varchar(5) path '$.b', has_b int exists path '$.b')) j", "select * from (values (1, 1, 'x', 1), (2, 2, null, 0), (3, 9, 'z', 1)) t(id, a, b, has_b)", "mysql")
sql("json_table_nested", "select j.* from json_table('[{\"a\":1,\"b\":[10,11],\"c\":[7]},{\"a\":2,\"b\":[]}]', '$[*]' columns (a int path '$.a', nested path '$.b[*]' columns (b int path '$'), nested path '$.c[*]' columns (c int path '$'))) j", "select * from (values (1, 10, null), (1, 11, null), (2, null, null), (1, null, 7)) t(a, b, c)", "mysql")
sql("json_each", "select e.event_id, j.key, j.value from events e cross join json_each(e.props) j", "select event_id, j.key, case when j.type = 'VARCHAR' then j.value ->> '$' else j.value::varchar end as value from events, lateral (select * from json_each(events.props)) j", "sqlite")
sql("json_tree", "select key, value, type, id, parent, path from json_tree('{\"a\":[1,{\"b\":null}],\"c\":\"t\"}') t", "select key, value, type, id::bigint as id, parent::bigint as parent, path from (values (null, '{\"a\":[1,{\"b\":null}],\"c\":\"t\"}', 'object', 0, null, '$'), ('a', '[1,{\"b\":null}]', 'array', 2, 0, '$'), ('0', '1', 'integer', 4, 2, '$.a'), ('1', '{\"b\":null}', 'object', 6, 2, '$.a'), ('b', null, 'null', 8, 6, '$.a[1]'), ('c', 't', 'text', 10, 0, '$')) t(key, value, type, id, parent, path)", "sqlite")
