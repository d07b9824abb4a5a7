"""Scalar functions by family."""

from polyquery.queries.base import sql

sql("fn_math_basic", "select c_custkey, abs(c_acctbal) as a, ceil(c_acctbal) as c, floor(c_acctbal) as f, round(c_acctbal, 1) as r, sign(c_acctbal) as s from customer", "select c_custkey, abs(c_acctbal) as a, ceil(c_acctbal)::bigint as c, floor(c_acctbal)::bigint as f, round(c_acctbal, 1) as r, sign(c_acctbal)::int as s from customer")
sql("fn_math_trig", "select n_nationkey, " + ", ".join(f"round({f}(n_nationkey / cast(30 as double)), 8) as {f}_" for f in "sin cos tan asin acos atan sinh cosh tanh degrees radians".split()) + " from nation")
sql("fn_math_logs", "select p_partkey, round(ln(p_retailprice), 8) as a, round(log10(p_retailprice), 8) as b, round(exp(p_size / 10.0), 6) as d, round(pow(p_size, 2), 4) as e, round(sqrt(p_retailprice), 8) as g, round(cbrt(p_retailprice), 8) as h from part")
sql("fn_math_log_order", "select round(log(8, 2), 6) as x", "select 3.0::double as x", "sqlserver")
sql("fn_math_log_order_default", "select round(log(2, 8), 6) as x", "select 3.0::double as x", "postgres")
sql("fn_math_mod_zero", "select n_nationkey, mod(n_nationkey, n_regionkey) as m from nation", "select n_nationkey, case when n_regionkey <> 0 then n_nationkey % n_regionkey end as m from nation")
sql("fn_math_sqrt_negative", "select n_nationkey, round(sqrt(n_nationkey - 10), 6) as s from nation", "select n_nationkey, case when n_nationkey >= 10 then round(sqrt(n_nationkey - 10), 6) end as s from nation")
sql("fn_math_greatest_nulls", "select n_nationkey, greatest(n_nationkey, nullif(n_regionkey, 1), 3) as g, least(n_nationkey, n_regionkey) as l from nation", "select n_nationkey, case when n_regionkey = 1 then null else greatest(n_nationkey, n_regionkey, 3) end as g, least(n_nationkey, n_regionkey) as l from nation", "mysql")
sql("fn_math_truncate", "select c_custkey, truncate(c_acctbal, 1) as t from customer", "select c_custkey, (sign(c_acctbal) * floor(abs(c_acctbal) * 10.0) / 10.0)::double as t from customer", "mysql")
sql("fn_math_bits", "select n_nationkey, bitand(n_nationkey, 5) as a, bitor(n_nationkey, 8) as o, bitxor(n_nationkey, 3) as x, bitandnot(n_nationkey, 4) as n from nation", "select n_nationkey, n_nationkey & 5 as a, n_nationkey | 8 as o, xor(n_nationkey, 3) as x, n_nationkey & ~4 as n from nation", "oracle")
sql("fn_math_conv", "select n_nationkey, bin(n_nationkey) as b, conv(n_nationkey, 10, 16) as h, oct(n_nationkey) as o from nation", "select n_nationkey, bin(n_nationkey) as b, hex(n_nationkey) as h, case when n_nationkey < 8 then n_nationkey::varchar else (n_nationkey // 8)::varchar || (n_nationkey % 8)::varchar end as o from nation", "mysql")
sql("fn_math_gcd", "select n_nationkey, gcd(n_nationkey, 12) as g, lcm(n_nationkey, 4) as l from nation", "select n_nationkey, gcd(n_nationkey, 12)::bigint as g, lcm(n_nationkey, 4)::bigint as l from nation", "postgres")
sql("fn_math_width_bucket", "select c_custkey, width_bucket(c_acctbal, 0, 9000, 9) as b from customer where c_acctbal > 0", "select c_custkey, case when c_acctbal >= 9000 then 10 else floor(c_acctbal / 1000)::bigint + 1 end as b from customer where c_acctbal > 0", "oracle")
sql("fn_str_case_length", "select c_custkey, upper(c_name) as u, lower(c_mktsegment) as l, length(c_name) as n, reverse(c_name) as r, initcap(c_mktsegment) as i from customer", "select c_custkey, upper(c_name) as u, lower(c_mktsegment) as l, length(c_name)::int as n, reverse(c_name) as r, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) as i from customer", "postgres")
sql("fn_str_parts", "select p_partkey, left(p_name, 3) as l, right(p_name, 3) as r, substring(p_name, 2, 4) as s, substring(p_name, -1, 3) as clamp, position('a' in p_name) as p from part", "select p_partkey, left(p_name, 3) as l, right(p_name, 3) as r, substr(p_name, 2, 4) as s, substr(p_name, 1, 3) as clamp, instr(p_name, 'a')::int as p from part", "postgres")
sql("fn_str_pad_repeat", "select n_nationkey, lpad(n_name, 12, '*') as l, rpad(n_name, 4, '-') as r, repeat('ab', n_regionkey) as x, lpad(n_name, -1, '*') as neg, space(n_regionkey) as s from nation", "select n_nationkey, lpad(n_name, 12, '*') as l, rpad(n_name, 4, '-') as r, repeat('ab', n_regionkey) as x, null::varchar as neg, repeat(' ', n_regionkey) as s from nation", "mysql")
sql("fn_str_trim", "select trim('  x ') as a, ltrim('\t x') as b, rtrim('x \n') as c, trim(both 'y' from 'yyxyy') as d", "select 'x' as a, 'x' as b, 'x' as c, 'x' as d", "postgres")
sql("fn_str_replace_translate", "select n_nationkey, replace(n_name, 'A', 'aa') as r, translate(n_name, 'AEI', '123') as t from nation", dialect="postgres")
sql("fn_str_concat_null", "select concat('a', null, 'b') as x, concat_ws('-', 'a', null, 'b') as y", "select 'ab' as x, 'a-b' as y", "postgres")
sql("fn_str_concat_null_strict", "select concat('a', null, 'b') as x, concat_ws('-', 'a', null, 'b') as y", "select null::varchar as x, 'a-b' as y", "mysql")
sql("fn_str_regexp", "select p_partkey, regexp_replace(p_name, '[aeiou]', '#') as r, regexp_count(p_name, 'a') as c, regexp_substr(p_name, '[a-z]+') as s, regexp_instr(p_name, 'e') as i from part", "select p_partkey, regexp_replace(p_name, '[aeiou]', '#', 'g') as r, len(regexp_extract_all(p_name, 'a'))::int as c, nullif(regexp_extract(p_name, '[a-z]+'), '') as s, instr(p_name, 'e')::int as i from part", "oracle")
sql("fn_str_split", "select c_custkey, split_part(c_name, '#', 2) as s, substring_index(c_name, '#', 1) as i from customer", "select c_custkey, split_part(c_name, '#', 2) as s, split_part(c_name, '#', 1) as i from customer", "auto")
sql("fn_str_hashes", "select n_nationkey, md5(n_name) as m, sha1(n_name) as s, sha2(n_name, 256) as t, hex(n_name) as h, to_base64(n_name) as b from nation", "select n_nationkey, md5(n_name) as m, sha1(n_name) as s, sha256(n_name) as t, hex(n_name) as h, base64(n_name::blob) as b from nation", "mysql")
sql("fn_str_char_ascii", "select ascii('A') as a, char(233) as b, chr(8364) as c, unicode('é') as d", "select 65 as a, 'é' as b, '€' as c, 233 as d", "auto")
sql("fn_str_soundex_difference", "select soundex('Robert') as a, difference('Robert', 'Rupert') as b", "select 'R163' as a, 4 as b", "sqlserver")
sql("fn_str_mysql_sets", "select field('b', 'a', 'b', 'c') as f, elt(2, 'x', 'y') as e, find_in_set('b', 'a,b') as s, make_set(5, 'a', 'b', 'c') as m, export_set(5, 'Y', 'N', ',', 4) as x, strcmp('a', 'b') as c, quote('it''s') as q", "select 2 as f, 'y' as e, 2 as s, 'a,c' as m, 'Y,N,Y,N' as x, -1 as c, '''it''''s''' as q", "mysql")
sql("fn_str_sqlserver", "select stuff('abcdef', 2, 3, 'XY') as a, quotename('a]b') as b, parsename('x.y.z', 1) as c, patindex('%c_e%', 'abcdef') as d, replicate('z', 3) as e, len('ab  ') as f, charindex('C', 'abc') as g, str(3.7, 5, 0) as h", "select 'aXYef' as a, '[a]]b]' as b, 'z' as c, 3 as d, 'zzz' as e, 2 as f, 3 as g, '    4' as h", "sqlserver")
sql("fn_str_unicode", "select normalize('é') as a, to_ascii('Élan') as b", "select 'é' as a, 'Elan' as b", "postgres")
sql("fn_str_glob", "select n_name from nation where glob('A*A', n_name) = 1", "select n_name from nation where n_name glob 'A*A'", "sqlite")
sql("fn_str_documents", "select doc_id, length(text) as n, octet_length(text) as b, instr(text, 'the') as p from documents", "select doc_id, length(text)::int as n, octet_length(encode(text))::int as b, instr(text, 'the')::int as p from documents", "auto")
sql("fn_cond_nulls", "select n_nationkey, ifnull(nullif(n_regionkey, 0), -1) as a, coalesce(nullif(n_regionkey, 1), n_nationkey) as b, if(n_nationkey > 10, 'hi', 'lo') as c from nation", "select n_nationkey, ifnull(nullif(n_regionkey, 0), -1) as a, coalesce(nullif(n_regionkey, 1), n_nationkey) as b, if(n_nationkey > 10, 'hi', 'lo') as c from nation", "mysql")
sql("fn_cond_oracle", "select n_nationkey, nvl(nullif(n_regionkey, 0), 9) as a, nvl2(nullif(n_regionkey, 0), 'y', 'n') as b, decode(n_regionkey, 0, 'zero', 1, 'one', 'many') as c, lnnvl(n_regionkey = 1) as d from nation", "select n_nationkey, coalesce(nullif(n_regionkey, 0), 9) as a, case when n_regionkey <> 0 then 'y' else 'n' end as b, case n_regionkey when 0 then 'zero' when 1 then 'one' else 'many' end as c, n_regionkey <> 1 as d from nation", "oracle")
sql("fn_cond_iif_choose", "select n_nationkey, iif(n_regionkey = 1, 'a', 'b') as i, isnull(nullif(n_regionkey, 2), -2) as s from nation", "select n_nationkey, if(n_regionkey = 1, 'a', 'b') as i, coalesce(nullif(n_regionkey, 2), -2) as s from nation", "sqlserver")
sql("fn_conv_text_to_int", "select cast('12x' as int) as a, cast('7' as int) as b, cast(null as int) as c", "select 0 as a, 7 as b, null::int as c", "mysql")
sql("fn_conv_try", "select try_cast('x' as int) as a, try_convert(int, '5') as b, isnumeric('1.5') as c, isnumeric('q') as d, convert(varchar(10), 42) as e", "select null::int as a, 5 as b, 1 as c, 0 as d, '42' as e", "sqlserver")
sql("fn_conv_colon_cast", "select '2020-01-02'::date as d, '5'::int + 1 as i, 3::varchar as s", "select date '2020-01-02' as d, 6 as i, '3' as s", "postgres")
sql("fn_conv_to_char", "select o_orderkey, to_char(o_orderdate, 'YYYY-MM-DD HH24:MI') as t, to_number('1,234') as n from orders", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') as t, 1234::decimal(38,10) as n from orders", "oracle")
sql("fn_date_parts", "select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as d, quarter(o_orderdate) as q, dayofyear(o_orderdate) as j, weekofyear(o_orderdate) as w, dayofweek(o_orderdate) as k from orders", "select o_orderkey, year(o_orderdate)::int as y, month(o_orderdate)::int as m, day(o_orderdate)::int as d, quarter(o_orderdate)::int as q, dayofyear(o_orderdate)::int as j, weekofyear(o_orderdate)::int as w, dayofweek(o_orderdate)::int + 1 as k from orders", "mysql")
sql("fn_date_extract", "select event_id, extract(hour from ts) as h, extract(minute from ts) as m, extract(dow from ts) as d, date_part('year', ts) as y from events", "select event_id, extract(hour from ts)::int as h, extract(minute from ts)::int as m, extract(dow from ts)::int as d, year(ts)::int as y from events", "postgres")
sql("fn_date_add", "select o_orderkey, date_add(o_orderdate, interval 3 month) as a, date_sub(o_orderdate, interval 10 day) as b, timestampadd(hour, 5, o_orderdate) as c from orders", "select o_orderkey, o_orderdate + interval 3 month as a, o_orderdate - interval 10 day as b, o_orderdate + interval 5 hour as c from orders", "mysql")
sql("fn_date_diff", "select o_orderkey, datediff(year, o_orderdate, l_shipdate) as y, datediff(month, o_orderdate, l_shipdate) as m, datediff(day, o_orderdate, l_shipdate) as d from orders join lineitem on o_orderkey = l_orderkey where l_linenumber = 1", "select o_orderkey, datediff('year', o_orderdate, l_shipdate)::int as y, datediff('month', o_orderdate, l_shipdate)::int as m, datediff('day', o_orderdate, l_shipdate)::int as d from orders join lineitem on o_orderkey = l_orderkey where l_linenumber = 1", "sqlserver")
sql("fn_date_trunc_eomonth", "select o_orderkey, date_trunc('month', o_orderdate) as m, eomonth(o_orderdate) as e, eomonth(o_orderdate, 1) as n from orders", "select o_orderkey, date_trunc('month', o_orderdate)::timestamp as m, last_day(o_orderdate) as e, last_day(o_orderdate::date + interval 1 month) as n from orders", "auto")
sql("fn_date_format", "select o_orderkey, date_format(o_orderdate, '%Y/%m/%d %H:%i') as f, monthname(o_orderdate) as m, dayname(o_orderdate) as d from orders", "select o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M') as f, monthname(o_orderdate) as m, dayname(o_orderdate) as d from orders", "mysql")
sql("fn_date_from_parts", "select n_nationkey, datefromparts(2020, n_regionkey + 1, n_nationkey + 1) as d from nation", "select n_nationkey, make_date(2020, n_regionkey + 1, n_nationkey + 1) as d from nation", "sqlserver")
sql("fn_date_unix", "select event_id, unix_timestamp(ts) as u, from_unixtime(1600000000) as f from events", "select event_id, floor(epoch(ts))::bigint as u, timestamp '2020-09-13 12:26:40' as f from events", "mysql")
sql("fn_date_months", "select o_orderkey, add_months(o_orderdate, 2) as a, last_day(o_orderdate) as l from orders", "select o_orderkey, (o_orderdate::date + interval 2 month)::date as a, last_day(o_orderdate) as l from orders", "db2")
sql("fn_date_to_date", "select to_date('03.02.2021', 'DD.MM.YYYY') as a, str_to_date('2021-02-03 04:05', '%Y-%m-%d %H:%i') as b", "select date '2021-02-03' as a, timestamp '2021-02-03 04:05:00' as b", "auto")
sql("fn_date_periods", "select period_add(202011, 3) as a, period_diff(202102, 202011) as b, makedate(2020, 61) as c, sec_to_time(3661) as d, to_days('2020-01-01') as e, from_days(737791) as f", "select 202102 as a, 3::bigint as b, date '2020-03-01' as c, '01:01:01' as d, 737790 as e, date '2020-01-02' as f", "mysql")
sql("fn_date_julian", "select round(julianday(timestamp '2000-01-01 12:00:00'), 4) as j, strftime('%Y-%m', timestamp '2000-02-03 00:00:00') as s", "select 2451545.0::double as j, '2000-02' as s", "sqlite")
sql("fn_json_extract", "select event_id, json_value(props, '$.k') as k, isjson(props) as v from events", "select event_id, json_extract_string(props, '$.k') as k, json_valid(props)::int as v from events", "sqlserver")
sql("fn_json_build", "select r_regionkey, json_object('k', r_regionkey, 'n', r_name) as o, json_array(r_regionkey, r_name, null) as a from region", "select r_regionkey, '{\"k\":' || r_regionkey || ',\"n\":\"' || r_name || '\"}' as o, '[' || r_regionkey || ',\"' || r_name || '\",null]' as a from region", "mysql")
sql("fn_json_change", "select json_set('{\"a\":1}', '$.b', 2, '$.a', 9) as s, json_remove('{\"a\":1,\"b\":[1,2]}', '$.b[0]') as r, json_merge_patch('{\"a\":1,\"b\":2}', '{\"b\":null,\"c\":3}') as m, json_array_append('[1,2]', '$', 3) as p", "select '{\"a\":9,\"b\":2}' as s, '{\"a\":1,\"b\":[2]}' as r, '{\"a\":1,\"c\":3}' as m, '[1,2,3]' as p", "mysql")
sql("fn_json_tests", "select json_contains('[1,2,{\"a\":3}]', '2') as c, json_overlaps('[1,2]', '[2,5]') as o, json_depth('{\"a\":[1]}') as d, json_length('[1,2,3]') as l, json_type('{\"a\":1}') as t, json_keys('{\"a\":1,\"b\":2}') as k, json_search('{\"a\":\"xy\"}', 'one', 'x%') as s", "select 1 as c, 1 as o, 3 as d, 3 as l, 'OBJECT' as t, '[\"a\",\"b\"]' as k, '\"$.a\"' as s", "mysql")
sql("fn_json_arrows", "select event_id, props->>'k' as a, props->'$.k' as b from events", "select event_id, props->>'$.k' as a, props->>'$.k' as b from events", "mysql")
sql("fn_json_postgres", "select jsonb_set('{\"a\":{\"b\":1}}', '{a,b}', '5') as s, jsonb_strip_nulls('{\"a\":null,\"b\":1}') as n, jsonb_extract_path_text('{\"a\":{\"b\":\"z\"}}', 'a', 'b') as e, jsonb_array_length('[1,2]') as l", "select '{\"a\":{\"b\":5}}' as s, '{\"b\":1}' as n, 'z' as e, 2 as l", "postgres")
sql("fn_array", "select array_length(string_to_array('a,b,c', ','), 1) as l, array_to_string(array_append(string_to_array('a,b', ','), 'z'), '-') as a, array_position(string_to_array('a,b', ','), 'b') as p, array_to_string(array_replace(string_to_array('a,b,a', ','), 'a', 'q'), '') as r, array_to_string(array_remove(string_to_array('a,b,a', ','), 'a'), '') as m", "select 3 as l, 'a-b-z' as a, 2::bigint as p, 'qbq' as r, 'b' as m", "postgres")
sql("fn_vector_distance", "select a.vec_id as a, b.vec_id as b, round(vec_distance_euclidean(a.embedding, b.embedding), 5) as e, round(vec_distance_cosine(a.embedding, b.embedding), 5) as c from embeddings a join embeddings b on b.vec_id = a.vec_id + 1", "select a.vec_id as a, b.vec_id as b, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::double - x[2]) ** 2))), 5) as e, round(1 - list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::double * x[2])) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::double * x)) * list_sum(list_transform(b.embedding, lambda x: x::double * x))), 5) as c from embeddings a join embeddings b on b.vec_id = a.vec_id + 1", "mariadb")
sql("fn_dynamic_columns", "select column_json(column_create('a', '1', 'b', '2')) as j, column_get(column_create('a', '1'), 'a') as g, column_exists(column_create('a', '1'), 'z') as e, column_list(column_delete(column_create('a', '1', 'b', '2'), 'a')) as l", "select '{\"a\":\"1\",\"b\":\"2\"}' as j, '1' as g, false as e, 'b' as l", "mariadb")
sql("fn_inet", "select inet_aton('10.0.5.9') as a, inet_ntoa(167773449) as n, is_ipv4('1.2.3.4') as v, is_ipv6('::1') as s", "select 167773449::bigint as a, '10.0.5.9' as n, 1 as v, 1 as s", "mysql")
sql("fn_inet_postgres", "select host('10.1.2.3/8') as h, netmask('10.1.2.3/8') as m, network('10.1.2.3/8') as n, masklen('10.1.2.3/8') as l", "select '10.1.2.3' as h, '255.0.0.0' as m, '10.0.0.0/8' as n, 8 as l", "postgres")
sql("fn_crypto_round_trip", "select aes_decrypt(aes_encrypt('text', 'key'), 'key') as a, hex(uncompress(compress('abc'))) as c, bin_to_uuid(uuid_to_bin('6ccd780c-baba-1026-9564-5b8c656024db')) as u, crc32('abc') as r", "select 'text' as a, '616263' as c, '6ccd780c-baba-1026-9564-5b8c656024db' as u, 891568578::bigint as r", "mysql")
sql("fn_crc32c", "select crc32c('123456789') as c", "select 3808858755::bigint as c", "mariadb")
sql("fn_session", "select db_name() is not null as d, xact_state() as x, object_id('t') as o", "select true as d, 0 as x, null as o", "sqlserver")
sql("fn_match_against", "select doc_id, match_against(text, 'the and') as s from documents", "select doc_id, (len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x in ('the', 'and'))))::bigint as s from documents", "mysql")
sql("agg_checksum", "select checksum_agg(n_nationkey) as c from nation", "select sum(n_nationkey)::bigint as c from nation", "sqlserver")
