"""Functions that Spark lacks: vectorised Python, registered once a session."""

from __future__ import annotations

import gzip
import ipaddress
import json
import math
import os
import re
import unicodedata
import zlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf


def _each(f):
    """f over the rows of its columns; NULL if the first argument is."""

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if x[0] is None or x[0] is pd.NA or (isinstance(x[0], float) and math.isnan(x[0])) else f(*x) for x in zip(*(c.tolist() for c in columns))], dtype=object)

    return run


def path_steps(path: str) -> list[str | int]:
    """The steps of ``$.a[0]."b c"`` or ``{a,0}``."""
    if path.startswith("{"):
        return [int(p) if p.strip().lstrip("-").isdigit() else p.strip().strip('"') for p in path.strip("{}").split(",") if p.strip()]
    out: list[str | int] = []
    for name, quoted, index in re.findall(r'\.([^.\[\]"]+)|\."([^"]*)"|\[(\d+)\]', path):
        out.append(int(index) if index else quoted or name)
    return out


def reach(value, steps):
    """(found, value) at the end of steps."""
    for s in steps:
        if isinstance(s, int) and isinstance(value, list) and -len(value) <= s < len(value):
            value = value[s]
        elif isinstance(value, dict) and str(s) in value:
            value = value[str(s)]
        else:
            return False, None
    return True, value


def place(doc, steps, new, insert: bool = True, replace: bool = True, shift: bool = False):
    """``doc`` with ``new`` at ``steps``; what may be made or replaced is said by the flags."""
    if not steps:
        return new if replace else doc
    found, parent = reach(doc, steps[:-1])
    last = steps[-1]
    if not found:
        return doc
    if isinstance(parent, list) and isinstance(last, int):
        if shift:
            parent.insert(min(last, len(parent)), new)
        elif last < len(parent):
            if replace:
                parent[last] = new
        elif insert:
            parent.append(new)
    elif isinstance(parent, dict):
        if (replace and str(last) in parent) or (insert and str(last) not in parent):
            parent[str(last)] = new
    return doc


def merge_patch(a, b):
    if not isinstance(b, dict):
        return b
    out = dict(a) if isinstance(a, dict) else {}
    for k, v in b.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge_patch(out.get(k), v)
    return out


def merge_keep(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: merge_keep(a[k], b[k]) if k in a and k in b else a.get(k, b.get(k)) for k in (*a, *(k for k in b if k not in a))}
    return (a if isinstance(a, list) else [a]) + (b if isinstance(b, list) else [b])


def contains(a, b) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and contains(a[k], v) for k, v in b.items())
    if isinstance(a, list):
        return all(any(contains(x, y) for x in a) for y in b) if isinstance(b, list) else any(contains(x, b) for x in a)
    return a == b


def strip_nulls(x):
    if isinstance(x, dict):
        return {k: strip_nulls(v) for k, v in x.items() if v is not None}
    return [strip_nulls(v) for v in x] if isinstance(x, list) else x


def depth(x) -> int:
    return 1 + max((depth(v) for v in (x.values() if isinstance(x, dict) else x)), default=0) if isinstance(x, dict | list) else 1


def find_text(x, want: re.Pattern, at: str = "$"):
    """The path of the first string that matches."""
    if isinstance(x, str) and want.fullmatch(x):
        return at
    items = [(f"{at}.{k}", v) for k, v in x.items()] if isinstance(x, dict) else [(f"{at}[{i}]", v) for i, v in enumerate(x)] if isinstance(x, list) else []
    return next((p for k, v in items if (p := find_text(v, want, k))), None)


def fits(x, schema) -> bool:
    """A small part of JSON schema: type, required, properties, items, enum, minimum, maximum."""
    kinds = {"object": dict, "array": list, "string": str, "number": (int, float), "integer": int, "boolean": bool, "null": type(None)}
    if "type" in schema and (not isinstance(x, kinds[schema["type"]]) or isinstance(x, bool) and schema["type"] in ("number", "integer")):
        return False
    if "enum" in schema and x not in schema["enum"]:
        return False
    if isinstance(x, dict):
        return all(k in x for k in schema.get("required", ())) and all(fits(x[k], s) for k, s in schema.get("properties", {}).items() if k in x)
    if isinstance(x, list):
        return all(fits(v, schema["items"]) for v in x) if "items" in schema else True
    return not isinstance(x, int | float) or schema.get("minimum", x) <= x <= schema.get("maximum", x)


def _loads(x):
    try:
        return json.loads(x)
    except (TypeError, ValueError):
        return x


def _dumps(x, **how) -> str:
    return json.dumps(x, ensure_ascii=False, **({"separators": (",", ":")} | how))


@lru_cache(256)
def _like(pattern: str) -> re.Pattern:
    return re.compile("".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in pattern), re.S)


def json_call(name: str, text: str, *more: str | None):
    """One JSON operation on JSON text; text that isn't JSON gives NULL."""
    try:
        doc = json.loads(text)
    except ValueError:
        if name != "member_of":
            return None
        doc = text
    pairs = list(zip(more[::2], more[1::2]))
    kind = {dict: "OBJECT", list: "ARRAY", str: "STRING", bool: "BOOLEAN", int: "INTEGER", float: "DOUBLE", type(None): "NULL"}
    if name == "type":
        return kind[type(doc)]
    if name in ("json_set", "jsonb_set", "jsonb_set_lax", "json_insert", "json_replace", "json_modify", "json_transform"):
        for path, new in pairs:
            value = _loads(new) if name.startswith("jsonb") else None if new is None else _number(new)
            if name == "json_modify" and new is None:
                doc = _removed(doc, path_steps(path))
                continue
            doc = place(doc, path_steps(path), value, insert=name != "json_replace", replace=name != "json_insert")
        return _dumps(doc)
    if name == "jsonb_insert":
        return _dumps(place(doc, path_steps(more[0]), _loads(more[1]), shift=True))
    if name == "json_array_insert":
        return _dumps(place(doc, path_steps(more[0]), _number(more[1]), shift=True))
    if name in ("json_array_append", "json_append"):
        for path, new in pairs:
            steps = path_steps(path)
            found, at = reach(doc, steps)
            if found:
                doc = place(doc, steps, (at if isinstance(at, list) else [at]) + [_number(new)])
        return _dumps(doc)
    if name == "json_remove":
        for path in more:
            doc = _removed(doc, path_steps(path))
        return _dumps(doc)
    if name == "json_merge_patch":
        for m in more:
            doc = merge_patch(doc, json.loads(m))
        return _dumps(doc)
    if name in ("json_merge", "json_merge_preserve"):
        for m in more:
            doc = merge_keep(doc, json.loads(m))
        return _dumps(doc)
    if name == "json_contains":
        if len(more) > 1:
            doc = reach(doc, path_steps(more[1]))[1]
        return str(int(contains(doc, json.loads(more[0]))))
    if name == "member_of":
        members = json.loads(more[0])
        return str(int(doc in members if isinstance(members, list) else doc == members))
    if name == "json_overlaps":
        other = json.loads(more[0])
        if isinstance(doc, dict) and isinstance(other, dict):
            return str(int(any(k in other and other[k] == v for k, v in doc.items())))
        a, b = (x if isinstance(x, list) else [x] for x in (doc, other))
        return str(int(any(x in b for x in a)))
    if name == "json_search":
        found = find_text(doc, _like(more[1]))
        return None if found is None else _dumps(found)
    if name == "json_storage_size":
        return str(len(_dumps(doc).encode()))
    if name == "json_depth":
        return str(depth(doc))
    if name == "json_equals":
        return str(int(doc == json.loads(more[0])))
    if name == "json_normalize":
        return _dumps(doc, sort_keys=True)
    if name == "json_schema_valid":  # the schema comes first
        return str(int(fits(json.loads(more[0]), doc)))
    if name == "json_array_intersect":
        other = json.loads(more[0])
        return _dumps([x for x in doc if x in other])
    if name == "json_object_filter_keys":
        keys = json.loads(more[0])
        return _dumps({k: v for k, v in doc.items() if k in keys})
    if name == "json_object_to_array":
        return _dumps([[k, v] for k, v in doc.items()])
    if name == "json_key_value":
        at = reach(doc, path_steps(more[0] if more else "$"))[1]
        return _dumps([{"key": k, "value": v} for k, v in at.items()]) if isinstance(at, dict) else None
    if name == "json_dataguide":
        return _dumps([{"o:path": f"$.{k}", "type": kind[type(v)].lower()} for k, v in doc.items()] if isinstance(doc, dict) else [])
    if name in ("json_pretty", "json_detailed", "jsonb_pretty"):
        return _dumps(doc, indent=2 if name == "json_pretty" else 4, separators=(",", ": "))
    if name == "json_loose":
        return _dumps(doc, separators=(", ", ": "))
    if name in ("jsonb_strip_nulls", "json_strip_nulls"):
        return _dumps(strip_nulls(doc))
    return _dumps(doc)  # json_compact


def _number(x: str | None):
    """A SQL value as JSON: numbers stay numbers, all else is text."""
    if x is None:
        return None
    try:
        return int(x) if re.fullmatch(r"-?\d+", x) else float(x) if re.fullmatch(r"-?\d+\.\d+", x) else x
    except ValueError:
        return x


def _removed(doc, steps):
    found, parent = reach(doc, steps[:-1])
    last = steps[-1] if steps else None
    if found and isinstance(parent, dict):
        parent.pop(str(last), None)
    elif found and isinstance(parent, list) and isinstance(last, int) and last < len(parent):
        del parent[last]
    return doc


def inet(name: str, text: str):
    """Functions of network addresses."""
    try:
        if name == "inet6_ntoa":
            return str(ipaddress.ip_address(bytes.fromhex(text)))
        face = ipaddress.ip_interface(text)
    except ValueError:
        return "0" if name.startswith("is_") else None
    ip, net = face.ip, face.network
    v6 = ip.version == 6
    return {
        "inet6_aton": lambda: ip.packed.hex().upper(),
        "is_ipv4": lambda: str(int(not v6)),
        "is_ipv6": lambda: str(int(v6)),
        "is_ipv4_mapped": lambda: str(int(v6 and ip.ipv4_mapped is not None)),
        "is_ipv4_compat": lambda: str(int(v6 and ip.packed[:12] == bytes(12) and int(ip) > 1)),
        "host": lambda: str(ip),
        "hostmask": lambda: str(net.hostmask),
        "netmask": lambda: str(net.netmask),
        "network": lambda: str(net),
        "masklen": lambda: str(net.prefixlen),
    }[name]()


def crc32c(data: bytes) -> int:
    """CRC with the Castagnoli polynomial."""
    crc = 0xFFFFFFFF
    for b in data:
        crc = _crc_table()[(crc ^ b) & 255] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


@lru_cache(1)
def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


def _bytes(how: str, data: bytes):
    data = bytes(data)
    if how == "zlib":
        return zlib.compress(data)
    if how == "gzip":
        return gzip.compress(data, mtime=0)
    if how == "unzip":
        try:
            return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else zlib.decompress(data)
        except (OSError, zlib.error):
            return None
    return zlib.crc32(data).to_bytes(4, "big")


def like_regex(p: str) -> str:
    """A LIKE pattern with [sets] as a regular expression; % at its ends is free."""
    return "".join(".*" if ch == "%" else "." if ch == "_" else ch if ch in "[]^-" else re.escape(ch) for ch in p.strip("%"))


def glob_regex(p: str) -> str:
    return "^" + "".join(".*" if ch == "*" else "." if ch == "?" else ch if ch in "[]^-" else re.escape(ch) for ch in p) + "$"


def register(spark: SparkSession) -> None:
    """Register all functions of this module under their pq_ names."""
    from polyquery.session import ship

    ship(spark)
    text = {
        "pq_json": json_call,
        "pq_inet": inet,
        "pq_sort_key": lambda s: re.sub(r"\d+", lambda m: m.group(0).zfill(20), unicodedata.normalize("NFKD", s).casefold()),
        "pq_normalize": lambda s, form: unicodedata.normalize(form, s),
        "pq_ascii": lambda s: unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode(),
        "pq_asciistr": lambda s: "".join(ch if ord(ch) < 128 and ch != "\\" else "".join(f"\\{u:04X}" for u in memoryview(ch.encode("utf-16-le")).cast("H")) for ch in s),
        "pq_unistr": lambda s: re.sub(r"\\([0-9A-Fa-f]{4})", lambda m: chr(int(m.group(1), 16)), s),
        "pq_like_regex": like_regex,
        "pq_glob_regex": glob_regex,
    }
    for name, f in text.items():
        spark.udf.register(name, pandas_udf(_each(f), "string"))
    numbers = {
        "pq_gcd": lambda a, b: math.gcd(int(a), int(b)),
        "pq_lcm": lambda a, b: math.lcm(int(a), int(b)),
        "pq_crc32c": lambda s: crc32c(s.encode() if isinstance(s, str) else bytes(s)),
        "pq_checksum": lambda s: int.from_bytes(zlib.crc32(s.encode()).to_bytes(4, "big"), "big", signed=True),
        "pq_match_score": lambda s, q: sum(s.lower().split().count(w) for w in set(re.findall(r"\w+", q.lower()))),
    }
    for name, f in numbers.items():
        spark.udf.register(name, pandas_udf(_each(f), "bigint"))
    spark.udf.register("pq_bytes", pandas_udf(_each(_bytes), "binary"))
    spark.udf.register("pq_random_bytes", pandas_udf(_each(lambda n: os.urandom(int(n))), "binary").asNondeterministic())
