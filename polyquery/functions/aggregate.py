"""Aggregates and window functions."""

from __future__ import annotations

import re

from polyquery.functions.registry import FunctionCatalog


def _distinct(x: str) -> tuple[str, str]:
    m = re.match(r"\s*distinct\s+(.*)", x, re.I | re.S)
    return ("distinct ", m.group(1)) if m else ("", x)


def _order(x: str) -> tuple[str, str]:
    """(argument, ORDER BY list) of an argument with an inner ORDER BY."""
    m = re.match(r"(.*?)\s+order\s+by\s+(.*)", x, re.I | re.S)
    return (m.group(1), m.group(2)) if m else (x, "")


def _listagg(separator: str):
    """GROUP_CONCAT([DISTINCT] x [ORDER BY ..] [SEPARATOR s]) and STRING_AGG(x, s [ORDER BY ..])."""

    def make(args: list[str], rules) -> str:
        args = list(args)
        sep = separator
        m = re.match(r"(.*?)\s+separator\s+('.*')\s*$", args[-1], re.I | re.S)
        if m:
            args[-1], sep = m.groups()
        body, order = _order(args[-1])
        args[-1] = body
        if len(args) > 1:
            sep = args[-1]
        distinct, x = _distinct(args[0])
        order = order or (x if distinct else "")
        return f"listagg({distinct}cast({x} as string), {sep})" + (f" within group (order by {'cast(' + x + ' as string)' if distinct else order})" if order else "")

    return make


def _count(args: list[str], rules) -> str:
    call = f"count({', '.join(args)})"
    return call if rules.count_type == "bigint" else f"cast({call} as {rules.count_type})"


def _regr(name: str):
    """The standard takes (y, x); compat takes (x, y)."""
    return lambda a, r: f"{name}({a[1]}, {a[0]})" if r.compat else f"{name}({a[0]}, {a[1]})"


def _objectagg(args: list[str], rules) -> str:
    return f"to_json(map_from_entries(collect_list(case when ({args[0]}) is not null then struct(cast({args[0]} as string), {args[1]}) end)))"


def define(c: FunctionCatalog) -> None:
    def agg(names: str, template, family: str = "") -> None:
        c.add(names, template, family, "aggregate")

    agg("COUNT COUNT_BIG", _count)
    agg("SUM", "sum({0})")
    agg("AVG", "avg({0})")
    agg("MIN", "min({0})")
    agg("MAX", "max({0})")
    agg("TOTAL", "coalesce(sum(cast({0} as double)), 0D)")
    agg("GROUP_CONCAT STRING_AGG LIST", _listagg("','"))
    agg("LISTAGG", _listagg("''"))
    agg("ARRAY_AGG COLLECT", "nullif(collect_list({0}), array())")
    agg("JSON_ARRAYAGG JSON_AGG JSONB_AGG", "to_json(collect_list({0}))")
    agg("JSON_OBJECTAGG JSON_GROUP_OBJECT JSONB_OBJECT_AGG JSON_OBJECT_AGG JSON_OBJECT_AGG_STRICT JSON_OBJECT_AGG_UNIQUE JSON_OBJECT_AGG_UNIQUE_STRICT JSONB_OBJECT_AGG_STRICT JSONB_OBJECT_AGG_UNIQUE JSONB_OBJECT_AGG_UNIQUE_STRICT", _objectagg)
    agg("BOOL_AND EVERY", "bool_and({0})")
    agg("BOOL_OR", "bool_or({0})")
    agg("BIT_AND", "bit_and(cast({0} as bigint))")
    agg("BIT_OR", "bit_or(cast({0} as bigint))")
    agg("BIT_XOR", "bit_xor(cast({0} as bigint))")
    agg("ANY_VALUE", "any_value({0}, true)")
    agg("VAR_POP VARP", "var_pop({0})")
    agg("VARIANCE", lambda a, r: f"{'var_samp' if r.stddev_is_sample else 'var_pop'}({a[0]})")
    agg("VAR VAR_SAMP VARIANCE_SAMP", "var_samp({0})")
    agg("STDDEV_POP STDEVP STD", "stddev_pop({0})")
    agg("STDDEV", lambda a, r: f"{'stddev_samp' if r.stddev_is_sample else 'stddev_pop'}({a[0]})")
    agg("STDDEV_SAMP STDEV", "stddev_samp({0})")
    agg("CV", "case when abs(avg({0})) > 1e-12 then stddev_pop({0}) / avg({0}) end")
    agg("MEDIAN", "percentile({0}, 0.5)")
    agg("PERCENTILE PERCENTILE_CONT", "percentile({0}, least(greatest({1:0.5}, 0), 1))")
    agg("PERCENTILE_DISC", "percentile_disc({1:0.5}) within group (order by {0})")
    agg("CORR CORRELATION CORR_K CORR_S", "corr({0}, {1})")
    agg("COVAR_POP COVARIANCE", "covar_pop({0}, {1})")
    agg("COVAR_SAMP COVARIANCE_SAMP", "covar_samp({0}, {1})")
    for name in "COUNT AVGX AVGY SXX SYY SXY SLOPE INTERCEPT R2".split():
        agg(f"REGR_{name}", _regr(f"regr_{name.lower()}"))
    agg("REGR_ICPT", _regr("regr_intercept"))
    agg("APPROX_COUNT_DISTINCT APPROX_COUNT_DISTINCT_AGG APPROX_COUNT_DISTINCT_DETAIL TO_APPROX_COUNT_DISTINCT", "approx_count_distinct({0})")
    agg("APPROX_MEDIAN", "percentile_approx({0}, 0.5)")
    agg("APPROX_PERCENTILE APPROX_PERCENTILE_AGG APPROX_PERCENTILE_DETAIL TO_APPROX_PERCENTILE", "percentile_approx({0}, {1:0.5})")
    agg("CHECKSUM_AGG", "cast(sum(cast({0} as bigint)) & 4294967295 as bigint)")
    agg("GROUP_ID", "0")
    agg("GROUPING", "grouping({0})")
    agg("GROUPING_ID", "grouping_id({*})")
    agg("RATIO_TO_REPORT", "(({0}) / sum({0}) over ())")
    agg("STATS_MODE", "mode({0})")
    agg("STATS_BINOMIAL_TEST STATS_CROSSTAB STATS_F_TEST STATS_KS_TEST STATS_MW_TEST STATS_ONE_WAY_ANOVA STATS_T_TEST_INDEP STATS_T_TEST_INDEPU STATS_T_TEST_ONE STATS_T_TEST_PAIRED STATS_WSR_TEST XMLAGG", "max(cast(null as double))")
    for name in "ROW_NUMBER RANK DENSE_RANK PERCENT_RANK CUME_DIST".split():
        c.add(name, name.lower() + "()", kind="window")
    c.add("ROWNUMBER", "row_number()", kind="window")
    c.add("NTILE", "ntile({0})", kind="window")
    c.add("LAG", "lag({*})", kind="window")
    c.add("LEAD", "lead({*})", kind="window")
    c.add("FIRST_VALUE", "first_value({0})", kind="window")
    c.add("LAST_VALUE", "last_value({0})", kind="window")
    c.add("NTH_VALUE", "nth_value({0}, {1})", kind="window")
