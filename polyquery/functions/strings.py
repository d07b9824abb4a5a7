"""Text functions."""

from __future__ import annotations

from polyquery.functions.registry import FunctionCatalog

#: Unicode white space, as a character class.
BLANK = r"[\\s\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"


def _concat(args: list[str], rules) -> str:
    if rules.concat_null_is_empty:
        return "concat(" + ", ".join(f"coalesce(cast({a} as string), '')" for a in args) + ")"
    return f"concat({', '.join(args)})"


def _locate(args: list[str], rules) -> str:
    needle, hay = (f"{a} collate UTF8_LCASE" for a in args[:2]) if rules.ignore_case else args[:2]
    return f"locate({needle}, {hay}{''.join(', ' + a for a in args[2:])})"


def _trim(where: str):
    def make(args: list[str], rules) -> str:
        if len(args) > 1:
            return f"{where}({args[1]}, {args[0]})" if where != "btrim" else f"btrim({args[0]}, {args[1]})"
        pattern = {"ltrim": f"^{BLANK}+", "rtrim": f"{BLANK}+$", "btrim": f"^{BLANK}+|{BLANK}+$"}[where]
        return f"regexp_replace({args[0]}, '{pattern}', '')"

    return make


def _pad(name: str):
    return f"case when ({{1}}) < 0 or {{2:' '}} = '' then null else {name}({{0}}, {{1}}, {{2:' '}}) end"


def _flags(at: int, template: str):
    """Patterns with match flags: i becomes an inline flag."""

    def make(args: list[str], rules) -> str:
        args = list(args)
        if len(args) > at:
            args[1] = f"concat(case when contains({args[at]}, 'i') then '(?i)' else '' end, {args[1]})"
        return template.format(*args, *[""] * 6)

    return make


def define(c: FunctionCatalog) -> None:
    c.add("CONCAT", _concat)
    c.add("CONCAT_WS", "concat_ws({*})")
    c.add("CHAR NCHAR CHR ASCII_CHAR UNICODE_CHAR", "decode(unhex(lpad(hex(cast({0} as int)), 8, '0')), 'UTF-32')")
    c.add("ASCII ORD ASCII_VAL UNICODE UNICODE_VAL", "ascii({0})")
    c.add("LIKE", "cast(({1}) like ({0}) as int)")
    c.add("LENGTH CHAR_LENGTH CHARACTER_LENGTH", "length({0})")
    c.add("LEN", "length(rtrim({0}))")
    c.add("BIT_LENGTH", "bit_length({0})")
    c.add("HEX RAWTOHEX RAWTONHEX HEX_ENCODE", "hex({0})")
    c.add("INSTR", "instr({0}, {1})")
    c.add("LOCATE POSITION CHARINDEX", _locate)
    c.add("LEFT", "left({0}, {1})")
    c.add("RIGHT", "right({0}, {1})")
    c.add("LOWER NLS_LOWER LCASE", "lower({0})")
    c.add("UPPER NLS_UPPER UCASE", "upper({0})")
    c.add("OCTET_LENGTH DATALENGTH LENGTHB VSIZE", "octet_length({0})")
    c.add("RPAD", _pad("rpad"))
    c.add("LPAD", _pad("lpad"))
    c.add("LTRIM", _trim("ltrim"))
    c.add("RTRIM", _trim("rtrim"))
    c.add("TRIM TRIM_ORACLE BTRIM", _trim("btrim"))
    c.add("SPACE", "space({0})")
    c.add("UNHEX HEXTORAW HEX_DECODE", "unhex({0})")
    c.add("MD5", "md5({0})")
    c.add("REPEAT REPLICATE", "repeat({0}, {1})")
    c.add("REPLACE", "replace({0}, {1}, {2:''})")
    c.add("REVERSE", "reverse({0})")
    c.add("SUBSTRING SUBSTR MID", lambda a, r: f"substring({a[0]}, greatest({a[1]}, 1){''.join(', ' + x for x in a[2:3])})")
    c.add("TRANSLATE", "translate({0}, {1}, {2})")
    c.add("MATCH_AGAINST", "pq_match_score({0}, {1})")
    c.add("DIFFERENCE", "aggregate(sequence(1, 4), 0, (s, i) -> s + cast(substring(soundex({0}), i, 1) = substring(soundex({1}), i, 1) as int))")
    c.add("SOUNDEX", "soundex({0})")
    c.add("PARSENAME", "element_at(reverse(split({0}, '[.]')), {1})")
    c.add("QUOTENAME", "concat('[', replace({0}, ']', ']]'), ']')")
    c.add("STRING_ESCAPE", "substring(to_json(array({0})), 3, length(to_json(array({0}))) - 4)")
    c.add("QUOTE QUOTE_LITERAL", "concat('\\'', replace({0}, '\\'', '\\'\\''), '\\'')")
    c.add("QUOTE_IDENT", "case when {0} rlike '^[a-z_][a-z0-9_]*$' then {0} else concat('\"', replace({0}, '\"', '\"\"'), '\"') end")
    c.add("PARSE_IDENT", "transform(split({0}, '[.]'), x -> case when x rlike '^\".*\"$' then btrim(x, '\"') else lower(x) end)")
    c.add("STUFF", "case when ({1}) < 1 or ({1}) > length({0}) or ({2}) < 0 then null else overlay({0} placing coalesce({3}, '') from {1} for {2}) end")
    c.add("OVERLAY", lambda a, r: a[0] if len(a) == 1 else f"overlay({a[0]} placing {a[1]} from {a[2]}{' for ' + a[3] if len(a) > 3 else ''})")
    c.add("FORMATMESSAGE SFORMAT PRINTF SQLITE3_MPRINTF", "format_string({*})")
    c.add("PATINDEX", "regexp_instr({1}, pq_like_regex({0}))")
    c.add("STR", "lpad(cast(round({0}, {2:0}) as string), {1:10}, ' ')")
    c.add("FORMAT", lambda a, r: f"format_number({a[0]}, {a[1]})" if a[1].strip().isdigit() else f"date_format({a[0]}, {a[1]})")
    c.add("FORMAT", "format_string({*})", "sqlite")
    c.add("FORMAT", "format_string({*})", "postgres")
    c.add("FIELD", "cast(array_position(array({1*}), {0}) as int)")
    c.add("ELT", "elt({*})")
    c.add("FIND_IN_SET", "find_in_set({0}, {1})")
    c.add("CHARSET", "'utf8mb4'")
    c.add("COLLATION", "collation({0})")
    c.add("COERCIBILITY", "4")
    c.add("MAKE_SET", "array_join(transform(filter(posexplode_array(array({1*})), p -> shiftright({0}, p.pos) & 1 = 1), p -> p.col), ',')".replace("filter(posexplode_array(array({1*}))", "filter(transform(array({1*}), (x, i) -> named_struct('pos', i, 'col', x))"))
    c.add("EXPORT_SET", "array_join(transform(sequence(0, {4:64} - 1), i -> case when shiftright(cast({0} as bigint), i) & 1 = 1 then {1} else {2} end), {3:','})")
    c.add("FROM_BASE64 BASE64_DECODE", "unbase64({0})")
    c.add("TO_BASE64 BASE64_ENCODE", "base64({0})")
    c.add("SUBSTRING_INDEX", "substring_index({0}, {1}, {2})")
    c.add("WEIGHT_STRING", "cast(upper({0}) as binary)")
    c.add("NATURAL_SORT_KEY NLSSORT", "pq_sort_key({0})")
    c.add("NORMALIZE COMPOSE", "pq_normalize({0}, 'NFC')")
    c.add("DECOMPOSE", "pq_normalize({0}, 'NFD')")
    c.add("TO_ASCII", "pq_ascii({0})")
    c.add("ASCIISTR", "pq_asciistr({0})")
    c.add("UNISTR", "pq_unistr({0})")
    c.add("UNISTR_QUOTE", "concat('\\'', pq_asciistr({0}), '\\'')")
    c.add("TO_MULTI_BYTE", "translate({0}, ' !#$%&()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', '　！＃＄％＆（）＊＋，－．／０１２３４５６７８９：；＜＝＞？＠ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ')")
    c.add("TO_SINGLE_BYTE", "pq_normalize({0}, 'NFKC')")
    c.add("REGEXP_INSTR", "regexp_instr({0}, {1})")
    c.add("REGEXP_REPLACE", _flags(3, "regexp_replace({0}, {1}, {2})"))
    c.add("REGEXP_SUBSTR", "regexp_substr({0}, {1})")
    c.add("REGEXP_COUNT", "regexp_count({0}, {1})")
    c.add("REGEXP_LIKE", _flags(2, "({0} rlike {1})"))
    c.add("REGEXP_MATCH", "nullif(slice(regexp_extract_all({0}, {1}, 0), 1, 1), array())")
    c.add("REGEXP_SPLIT_TO_ARRAY", "split({0}, {1})")
    c.add("STRCMP", "case when {0} = {1} then 0 when {0} < {1} then -1 when {0} > {1} then 1 end")
    c.add("INITCAP NLS_INITCAP", "initcap({0})")
    c.add("SPLIT_PART", "split_part({0}, {1}, {2})")
    c.add("STARTS_WITH", "startswith({0}, {1})")
    c.add("DUMP", "concat('Typ=1 Len=', octet_length({0}), ': ', array_join(transform(regexp_extract_all(hex(cast({0} as binary)), '..', 0), h -> conv(h, 16, 10)), ','))")
    c.add("GLOB", "cast({1} rlike pq_glob_regex({0}) as int)")
