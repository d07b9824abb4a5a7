"""Math and bit functions."""

from __future__ import annotations

from polyquery.functions.registry import FunctionCatalog


def _strict(name: str):
    """greatest/least that are NULL if any argument is."""

    def make(args: list[str], rules) -> str:
        nulls = " or ".join(f"({a}) is null" for a in args)
        return f"case when {nulls} then null else {name}({', '.join(args)}) end" if len(args) > 1 else args[0]

    return make


def _log(args: list[str], rules) -> str:
    if len(args) == 1:
        return f"ln({args[0]})"
    value, base = args if rules.log_value_first else args[::-1]
    return f"log({base}, {value})"


def _count_nulls(test: str):
    return lambda args, rules: "(" + " + ".join(f"cast(({a}) {test} as int)" for a in args) + ")"


def define(c: FunctionCatalog) -> None:
    c.add("ABS ABSVAL", "abs({0})")
    c.add("BIN", "bin(cast({0} as bigint))")
    c.add("GREATEST MAXVALUE", _strict("greatest"))
    c.add("LEAST MINVALUE", _strict("least"))
    for name in "DEGREES RADIANS ACOS ASIN ATAN COS COSH COT EXP SIN SINH TAN TANH ACOSH ASINH ATANH CBRT CRC32 BIT_COUNT".split():
        c.add(name, name.lower() + "({0})")
    c.add("ATAN2 ATN2", "atan2({0}, {1})")
    c.add("CEIL CEILING", "ceil({0})")
    c.add("FLOOR", "floor({0})")
    c.add("MOD", "try_mod({0}, {1})")
    c.add("LN", "ln({0})")
    c.add("LOG", _log)
    c.add("LOG10", "log10({0})")
    c.add("LOG2", "log2({0})")
    c.add("PI", "pi()")
    c.add("POWER POW", "pow({0}, {1})")
    c.add("RAND RANDOM", "rand({*})")
    c.add("ROUND", "round({0}, {1:0})")
    c.add("SIGN", "cast(signum({0}) as int)")
    c.add("SQRT", "case when ({0}) < 0 then null else sqrt({0}) end")
    c.add("SQUARE", "(({0}) * ({0}))")
    c.add("CONV", "conv(cast({0} as string), {1}, {2})")
    c.add("OCT", "conv(cast({0} as string), 10, 8)")
    c.add("TRUNCATE", "(cast(signum({0}) as int) * floor(abs({0}) * pow(10, {1:0})) / pow(10, {1:0}))")
    c.add("TRUNC", "(cast(signum({0}) as int) * floor(abs({0}) * pow(10, {1:0})) / pow(10, {1:0}))")
    c.add("TO_HEX", "lower(hex({0}))", "postgres")
    c.add("NUM_NULLS", _count_nulls("is null"))
    c.add("NUM_NONNULLS", _count_nulls("is not null"))
    c.add("MIN_SCALE", "length(regexp_extract(cast({0} as string), '[.]([0-9]*[1-9])0*$', 1))")
    c.add("GCD", "pq_gcd({0}, {1})")
    c.add("LCM", "pq_lcm({0}, {1})")
    c.add("BIN_TO_NUM", "cast(conv(concat({*}), 2, 10) as bigint)")
    c.add("BITAND BIN_AND", "(({0}) & ({1}))")
    c.add("BITOR BIN_OR", "(({0}) | ({1}))")
    c.add("BITXOR BIN_XOR", "(({0}) ^ ({1}))")
    c.add("BITNOT BIN_NOT", "(~({0}))")
    c.add("BITANDNOT", "(({0}) & ~({1}))")
    c.add("REMAINDER", "(({0}) - ({1}) * rint(({0}) / ({1})))")
    c.add("WIDTH_BUCKET", "width_bucket({0}, {1}, {2}, {3})")
    c.add("NANVL", "nanvl({0}, {1})")
    c.add("DIV", "(({0}) div ({1}))")
    c.add("BIN_SHL", "shiftleft({0}, {1})")
    c.add("BIN_SHR", "shiftright({0}, {1})")
    c.add("CRC32C", "pq_crc32c({0})")
