"""Conditional and conversion functions."""

from __future__ import annotations

from polyquery.functions.registry import FunctionCatalog, Unsupported

#: Type names of the dialects -> Spark (fixed values).
TYPES = {
    "TINYINT": "smallint", "INT2": "smallint", "SMALLINT": "smallint", "MEDIUMINT": "int", "INT": "int", "INT4": "int", "INTEGER": "int", "SIGNED": "bigint", "UNSIGNED": "bigint", "BIGINT": "bigint", "INT8": "bigint", "SERIAL": "int", "BIGSERIAL": "bigint",
    "NUMBER": "decimal(38,10)", "DECIMAL": "decimal(38,10)", "NUMERIC": "decimal(38,10)", "DEC": "decimal(38,10)", "MONEY": "decimal(19,4)", "SMALLMONEY": "decimal(10,4)",
    "REAL": "float", "FLOAT4": "float", "FLOAT": "double", "FLOAT8": "double", "DOUBLE": "double", "DOUBLE PRECISION": "double", "BINARY_DOUBLE": "double", "BINARY_FLOAT": "float",
    "BIT": "boolean", "BOOL": "boolean", "BOOLEAN": "boolean",
    "CHAR": "string", "NCHAR": "string", "VARCHAR": "string", "VARCHAR2": "string", "NVARCHAR": "string", "NVARCHAR2": "string", "TEXT": "string", "NTEXT": "string", "CLOB": "string", "NCLOB": "string", "STRING": "string", "UUID": "string", "UNIQUEIDENTIFIER": "string", "JSON": "string", "JSONB": "string", "XML": "string", "CHARACTER": "string", "CHARACTER VARYING": "string", "LONGTEXT": "string", "BPCHAR": "string", "DBCLOB": "string", "GRAPHIC": "string", "VARGRAPHIC": "string", "INET": "string",
    "BLOB": "binary", "BYTEA": "binary", "BINARY": "binary", "VARBINARY": "binary", "RAW": "binary", "IMAGE": "binary",
    "DATE": "date", "TIME": "time", "DATETIME": "timestamp_ntz", "DATETIME2": "timestamp_ntz", "SMALLDATETIME": "timestamp_ntz", "TIMESTAMP": "timestamp_ntz", "TIMESTAMPTZ": "timestamp", "DATETIMEOFFSET": "timestamp",
}


def spark_type(text: str) -> str:
    """The Spark type of a dialect's type text."""
    name, _, size = text.strip().upper().partition("(")
    name = " ".join(name.split())
    if name.endswith("[]"):
        return f"array<{spark_type(name[:-2])}>"
    if name not in TYPES:
        raise Unsupported(f"unknown type {text}")
    if size and TYPES[name].startswith("decimal(38"):
        parts = [p.strip() for p in size.rstrip(")").split(",")]
        return f"decimal({parts[0]},{parts[1] if len(parts) > 1 else 0})"
    return TYPES[name]


def cast(args: list[str], rules) -> str:
    """CAST with the dialect's rule for text that isn't a number: 0, or an error where the dialect raises."""
    kind = spark_type(args[1])
    if not rules.cast_text_to_int_is_zero:
        return f"cast({args[0]} as {kind})"
    tried = f"try_cast({args[0]} as {kind})"
    return f"case when ({args[0]}) is null then null else coalesce({tried}, 0) end" if kind in ("int", "bigint", "smallint") else tried


def define(c: FunctionCatalog) -> None:
    c.add("COALESCE", "coalesce({*})")
    c.add("NULLIF", "nullif({0}, {1})")
    c.add("IIF IF", "if({0}, {1}, {2:null})")
    c.add("IFNULL NVL VALUE", "coalesce({*})")
    c.add("ISNULL", lambda a, r: f"coalesce({a[0]}, {a[1]})" if len(a) > 1 else f"isnull({a[0]})")
    c.add("DECODE DECODE_ORACLE", "decode({*})")
    c.add("LNNVL", "(not coalesce({0}, false))")
    c.add("NVL2", "nvl2({0}, {1}, {2})")
    c.add("LIKELY UNLIKELY LIKELIHOOD", "{0}")
    c.add("NAME_CONST", "{1}")
    c.add("VALUES DEFAULT", "{0}")
    c.add("CHOOSE", "elt({*})")
    c.add("CAST", cast)
    c.add("TRY_CAST", lambda a, r: f"try_cast({a[0]} as {spark_type(a[1])})")
    c.add("TRY_CONVERT", lambda a, r: f"try_cast({a[1]} as {spark_type(a[0])})")
    c.add("TRY_PARSE PARSE", lambda a, r: f"try_cast({a[0]} as {spark_type(a[1])})")
    c.add("CONVERT", lambda a, r: cast([a[1], a[0]], r) if r.families[:1] == ("sqlserver",) else cast(a, r) if a[1].strip().split("(")[0].upper() in TYPES else a[0])
    for name, kind in (("BIGINT", "bigint"), ("INT INTEGER", "int"), ("SMALLINT", "smallint"), ("DECIMAL DEC", "decimal(38,10)"), ("DOUBLE_PRECISION FLOAT8 DOUBLE FLOAT TO_BINARY_DOUBLE", "double"), ("FLOAT4 REAL TO_BINARY_FLOAT", "float")):
        c.add(name, f"try_cast({{0}} as {kind})")
    c.add("ISNUMERIC", "cast(try_cast({0} as double) is not null as int)")
    c.add("TO_NUMBER", "try_cast(replace({0}, ',', '') as decimal(38,10))")
    c.add("TO_BLOB", "cast({0} as binary)")
    c.add("TO_CLOB TO_NCHAR TO_NCLOB TO_LOB BPCHAR DBCLOB GRAPHIC VARGRAPHIC VARCHAR", "cast({0} as string)")
    c.add("VALIDATE_CONVERSION", lambda a, r: f"cast(try_cast({a[0]} as {spark_type(a[1])}) is not null as int)")
    c.add("TYPEOF", "case when {0} is null then 'null' when typeof({0}) in ('tinyint', 'smallint', 'int', 'bigint') then 'integer' when typeof({0}) in ('float', 'double') or typeof({0}) like 'decimal%' then 'real' when typeof({0}) = 'binary' then 'blob' else 'text' end")
    c.add("REF REFTOHEX ROWIDTOCHAR ROWTONCHAR DEREF MAKE_REF CHARTOROWID", "cast({0} as string)")
    c.add("EMPTY_CLOB EMPTY_DBCLOB EMPTY_NCLOB", "''")
    c.add("EMPTY_BLOB", "X''")
    c.add("BFILENAME", "concat({0}, '/', {1})")
    c.add("ZEROBLOB SQLITE3_RESULT_ZEROBLOB", "unhex(repeat('00', {0}))")
