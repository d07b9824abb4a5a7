"""Every function renders; the edge rules hold."""

import pytest

from polyquery.functions import catalog
from polyquery.functions.registry import Unsupported
from polyquery.plans.engine import Engine
from polyquery.profiles import PROFILES

#: Encryption that only its own server can do: the functions raise and never give something that looks like it.
REFUSED = {"DES_ENCRYPT", "DES_DECRYPT", "ENCODE", "ENCRYPT", "PWDENCRYPT", "PWDCOMPARE", "CERTENCODED", "CERTPRIVATEKEY"}


def test_catalog_size():
    assert len(catalog().names()) >= 768


@pytest.mark.parametrize("dialect", sorted(PROFILES))
def test_names_of_a_dialect_render_or_say_why(dialect):
    for name in catalog().names(dialect):
        for args in ([], ["a"], ["a", "b"], ["'DAY'", "b", "c"], ["a", "b", "c", "d", "e", "f"], ["'DAY'", "'MD5'"], ["2", "'DAY'"], ["2", "'MONTH'"], ["a", "int"], ["int", "a"]):
            try:
                assert catalog().call(name, args, dialect)
                break
            except (Unsupported, KeyError, IndexError, AttributeError, ValueError, TypeError):
                continue
        else:
            assert name in REFUSED, name


RULES = [
    ("mysql", "SUBSTRING('abc', 0, 2)", "ab"),
    ("mysql", "LPAD('a', -1, 'x')", None),
    ("mysql", "ROUND(2.5)", 3),
    ("mysql", "MOD(5, 0)", None),
    ("mysql", "CONCAT('a', NULL)", None),
    ("postgres", "CONCAT('a', NULL)", "a"),
    ("sqlserver", "LOG(8, 2)", 3.0),
    ("postgres", "LOG(2, 8)", 3.0),
    ("mysql", "CAST('x' AS SIGNED)", 0),
    ("mysql", "GREATEST(1, NULL)", None),
    ("oracle", "DECODE(NULL, NULL, 1, 2)", 1),
    ("oracle", "INITCAP('ab cd')", "Ab Cd"),
    ("oracle", "'a' || NULL", "a"),
    ("mysql", "TRIM(' x ')", "x"),
    ("sqlserver", "CHAR(8364)", "€"),
    ("mysql", "JSON_MERGE_PRESERVE('[1]', '{\"a\":2}')", '[1,{"a":2}]'),
    ("mysql", "JSON_INSERT('{\"a\":1}', '$.a', 2, '$.b', 3)", '{"a":1,"b":3}'),
    ("mysql", "JSON_REPLACE('{\"a\":1}', '$.a', 2, '$.b', 3)", '{"a":2}'),
    ("mysql", "JSON_ARRAY_INSERT('[1,3]', '$[1]', 2)", "[1,2,3]"),
    ("sqlserver", "JSON_MODIFY('{\"a\":1}', '$.a', NULL)", "{}"),
    ("postgres", "JSONB_INSERT('[1,2]', '{1}', '9')", "[1,9,2]"),
    ("mariadb", "JSON_SCHEMA_VALID('{\"type\":\"array\"}', '[1]')", 1),
    ("mariadb", "JSON_OBJECT_TO_ARRAY('{\"a\":1}')", '[["a",1]]'),
    ("mysql", "WEIGHT_STRING('a') IS NOT NULL", True),
    ("postgres", "AGE(DATE '2021-03-05', DATE '2020-01-01')", "1 years 2 mons 4 days"),
    ("mysql", "TIMEDIFF(TIMESTAMP '2020-01-01 10:00:00', TIMESTAMP '2020-01-01 08:30:00')", "01:30:00"),
    ("oracle", "BIN_TO_NUM(1, 0, 1)", 5),
    ("oracle", "REMAINDER(7, 4)", -1.0),
    ("firebird", "BIN_SHL(1, 4)", 16),
    ("firebird", "DATEADD(DAY, 1, DATE '2020-02-28') IS NOT NULL", True),
    ("sqlserver", "DATEDIFF(WEEK, DATE '2020-01-04', DATE '2020-01-05')", 1),
    ("sqlserver", "DATENAME(MONTH, DATE '2020-01-04')", "January"),
    ("mysql", "FORMAT_BYTES(2048)", "2.00 KiB"),
    ("mariadb", "NATURAL_SORT_KEY('a9') < NATURAL_SORT_KEY('a10')", True),
    ("postgres", "REGEXP_LIKE('ABC', 'b', 'i')", True),
    ("postgres", "SPLIT_PART('a.b', '.', 2)", "b"),
    ("mysql", "IS_UUID('6ccd780c-baba-1026-9564-5b8c656024db')", 1),
    ("mysql", "INET_NTOA(INET_ATON('1.2.3.4'))", "1.2.3.4"),
]


@pytest.mark.parametrize(("dialect", "call", "want"), RULES)
def test_edge_rules(spark, dialect, call, want):
    got = Engine(spark, dialect).sql(f"SELECT {call} AS x").first()["x"]
    assert got == want if not isinstance(want, float) else float(got) == pytest.approx(want)
