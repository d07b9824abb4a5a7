"""JSON functions over JSON text."""

from __future__ import annotations

from polyquery.functions.registry import FunctionCatalog


def _object(args: list[str], rules) -> str:
    """Pairs of key and value as JSON text, in order."""
    if not args:
        return "'{}'"
    parts = [f"concat(to_json(array(cast({k} as string))), '\x00')" for k in args[::2]]
    pairs = ", ".join(f"concat(substring({p.split(', ')[0][7:]}, 2, length({p.split(', ')[0][7:]}) - 2), ':', {_value(v)})" for p, v in zip(parts, args[1::2]))
    return f"concat('{{', concat_ws(',', {pairs}), '}}')"


def _value(x: str) -> str:
    """One value as JSON text."""
    one = f"to_json(array({x}), map('ignoreNullFields', 'false'))"
    return f"case when ({x}) is null then 'null' else substring({one}, 2, length({one}) - 2) end"


def _array(args: list[str], rules) -> str:
    return "concat('[', concat_ws(',', " + ", ".join(map(_value, args)) + "), ']')" if args else "'[]'"


def _path(args: list[str], rules) -> str:
    """JSONB_EXTRACT_PATH(j, 'a', 'b')."""
    steps = "".join(f".{a.strip().strip(chr(39))}" if not a.strip().strip("'").isdigit() else f"[{a.strip().strip(chr(39))}]" for a in args[1:])
    return f"get_json_object({args[0]}, '${steps}')"


def define(c: FunctionCatalog) -> None:
    c.add("JSON_EXTRACT JSON_QUERY JSON_VALUE JSONB_EXTRACT", "get_json_object({0}, {1:'$'})")
    c.add("JSONB_EXTRACT_PATH JSONB_EXTRACT_PATH_TEXT JSON_EXTRACT_PATH JSON_EXTRACT_PATH_TEXT", _path)
    c.add("JSON_UNQUOTE", "case when {0} like '\"%\"' then get_json_object({0}, '$') else {0} end")
    c.add("JSON_OBJECT JSON_BUILD_OBJECT JSONB_BUILD_OBJECT JSONB_OBJECT", _object)
    c.add("JSON_ARRAY JSON_BUILD_ARRAY JSONB_BUILD_ARRAY", _array)
    c.add("ISJSON JSON_VALID", "cast(try_parse_json({0}) is not null as int)")
    c.add("JSON_QUOTE TO_JSON TO_JSONB ROW_TO_JSON ARRAY_TO_JSON JSON_SCALAR JSON_SERIALIZE", lambda a, r: _value(a[0]))
    c.add("JSON_KEYS", "to_json(json_object_keys({0}))")
    c.add("JSON_TYPE JSON_TYPEOF JSONB_TYPEOF", "pq_json('type', {0})")
    c.add("JSON_LENGTH JSON_ARRAY_LENGTH JSONB_ARRAY_LENGTH", "coalesce(json_array_length({0}), size(json_object_keys({0})), 1)")
    c.add("JSON_ARRAY_LENGTH JSONB_ARRAY_LENGTH", "json_array_length({0})", "postgres")
    c.add("JSON_CONTAINS_PATH", "cast(get_json_object({0}, {2}) is not null as int)")
    c.add("JSON_EXISTS JSONB_PATH_EXISTS", "(get_json_object({0}, {1}) is not null)")
    c.add("JSONB_PATH_QUERY_ARRAY", "get_json_object({0}, {1})")
    # in-place changes and structural tests share one vectorised function over Python's json
    changed = "JSON_MODIFY MEMBER_OF JSON_SET JSON_REMOVE JSON_SEARCH JSON_INSERT JSON_REPLACE JSON_ARRAY_APPEND JSON_ARRAY_INSERT JSON_MERGE JSON_MERGE_PRESERVE JSON_MERGE_PATCH JSON_CONTAINS JSON_OVERLAPS JSON_STORAGE_SIZE JSON_DEPTH JSON_APPEND JSON_NORMALIZE JSON_EQUALS JSON_SCHEMA_VALID JSON_ARRAY_INTERSECT JSON_OBJECT_FILTER_KEYS JSON_OBJECT_TO_ARRAY JSON_KEY_VALUE JSONB_SET JSONB_SET_LAX JSONB_INSERT JSON_DATAGUIDE JSON_TRANSFORM JSON_PRETTY JSON_COMPACT JSON_DETAILED JSON_LOOSE JSONB_STRIP_NULLS JSONB_PRETTY JSON_STRIP_NULLS"
    integers = {"MEMBER_OF", "JSON_CONTAINS", "JSON_OVERLAPS", "JSON_STORAGE_SIZE", "JSON_DEPTH", "JSON_EQUALS", "JSON_SCHEMA_VALID"}
    for name in changed.split():
        call = "pq_json('" + name.lower() + "', {*})"
        c.add(name, (lambda a, r, n=name.lower(): f"cast(pq_json('{n}', {', '.join(f'cast({x} as string)' for x in a)}) as int)") if name in integers else (lambda a, r, n=name.lower(): f"pq_json('{n}', {', '.join(f'cast({x} as string)' for x in a)})"))
        del call
    c.add("OPENJSON JSON_EACH JSONB_EACH JSON_TREE JSONB_TREE JSON_TABLE STRING_SPLIT", "{0}", kind="table")
