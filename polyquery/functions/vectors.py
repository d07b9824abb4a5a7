"""Arrays, dynamic columns and vectors."""

from __future__ import annotations

from polyquery.functions.registry import FunctionCatalog

_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> cast(x as double) * y), 0D, (s, v) -> s + v)"
_NORM = "sqrt(aggregate({0}, 0D, (s, v) -> s + cast(v as double) * v))"


def define(c: FunctionCatalog) -> None:
    c.add("COLUMN_CREATE", "map({*})")
    c.add("COLUMN_ADD", "map_concat(map_filter({0}, (k, v) -> k <> {1}), map({1*}))")
    c.add("COLUMN_DELETE", "map_filter({0}, (k, v) -> not array_contains(array({1*}), k))")
    c.add("COLUMN_EXISTS", "map_contains_key({0}, {1})")
    c.add("COLUMN_CHECK", "({0} is not null)")
    c.add("COLUMN_JSON", "to_json({0})")
    c.add("COLUMN_LIST", "array_join(map_keys({0}), ',')")
    c.add("COLUMN_GET", "element_at({0}, {1})")
    c.add("VECTOR", "array({*})")
    c.add("VEC_FROMTEXT", "from_json({0}, 'array<float>')")
    c.add("VEC_TOTEXT", "to_json({0})")
    c.add("VEC_DISTANCE VEC_DISTANCE_EUCLIDEAN", "sqrt(aggregate(zip_with({0}, {1}, (x, y) -> (cast(x as double) - y) * (cast(x as double) - y)), 0D, (s, v) -> s + v))")
    c.add("VEC_DISTANCE_COSINE", "(1 - " + _DOT + " / (" + _NORM + " * " + _NORM.replace("{0}", "{1}") + "))")
    c.add("STRING_TO_ARRAY", "split({0}, concat('\\\\Q', {1}, '\\\\E'))")
    c.add("ARRAY_TO_STRING", lambda a, r: f"array_join({', '.join(a)})")
    c.add("ARRAY_DIMS", "concat('[1:', size({0}), ']')")
    c.add("ARRAY_LOWER ARRAY_NDIMS", "case when size({0}) > 0 then 1 end")
    c.add("ARRAY_UPPER ARRAY_LENGTH", "nullif(size({0}), 0)")
    c.add("CARDINALITY", "size({0})")
    c.add("ARRAY_POSITION", "nullif(array_position({0}, {1}), 0)")
    c.add("ARRAY_APPEND", "array_append({0}, {1})")
    c.add("ARRAY_PREPEND", "array_prepend({1}, {0})")
    c.add("ARRAY_REMOVE", "array_remove({0}, {1})")
    c.add("ARRAY_CAT", "concat({0}, {1})")
    c.add("ARRAY_REPLACE", "transform({0}, v -> if(v <=> {1}, {2}, v))")
    c.add("ARRAY_POSITIONS", "filter(transform({0}, (v, i) -> if(v <=> {1}, i + 1, null)), i -> i is not null)")
    c.add("POWERMULTISET", "aggregate({0}, array(slice({0}, 1, 0)), (s, x) -> concat(s, transform(s, y -> array_append(y, x))))")
    c.add("POWERMULTISET_BY_CARDINALITY", "filter(aggregate({0}, array(slice({0}, 1, 0)), (s, x) -> concat(s, transform(s, y -> array_append(y, x)))), y -> size(y) = {1})")
