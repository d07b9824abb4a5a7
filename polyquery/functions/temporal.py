"""Date and time functions."""

from __future__ import annotations

import re

from polyquery.functions.registry import FunctionCatalog

#: Units of the dialects' date arithmetic -> Spark's (fixed values).
UNITS = {"YY": "YEAR", "YYYY": "YEAR", "YEAR": "YEAR", "QQ": "QUARTER", "Q": "QUARTER", "QUARTER": "QUARTER", "MM": "MONTH", "M": "MONTH", "MONTH": "MONTH", "WK": "WEEK", "WW": "WEEK", "WEEK": "WEEK", "DD": "DAY", "D": "DAY", "DAY": "DAY", "DY": "DAY", "HH": "HOUR", "HOUR": "HOUR", "MI": "MINUTE", "N": "MINUTE", "MINUTE": "MINUTE", "SS": "SECOND", "S": "SECOND", "SECOND": "SECOND", "MS": "MILLISECOND", "MILLISECOND": "MILLISECOND", "MICROSECOND": "MICROSECOND", "MCS": "MICROSECOND"}
#: Format marks of strftime-like and of to_char-like patterns -> Spark's (fixed values).
PERCENT = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%c": "M", "%d": "dd", "%e": "d", "%H": "HH", "%k": "H", "%h": "hh", "%I": "hh", "%i": "mm", "%M": "MMMM", "%b": "MMM", "%S": "ss", "%s": "ss", "%f": "SSSSSS", "%p": "a", "%W": "EEEE", "%a": "EEE", "%j": "DDD", "%T": "HH:mm:ss", "%r": "hh:mm:ss a", "%%": "%"}
PERCENT_C = PERCENT | {"%M": "mm", "%i": "mm", "%B": "MMMM", "%A": "EEEE", "%F": "yyyy-MM-dd", "%W": "ww"}
LETTERS = {"YYYY": "yyyy", "YY": "yy", "MONTH": "MMMM", "MON": "MMM", "MM": "MM", "DD": "dd", "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss", "FF6": "SSSSSS", "FF3": "SSS", "FF": "SSSSSS", "US": "SSSSSS", "MS": "SSS", "DAY": "EEEE", "DY": "EEE", "DDD": "DDD", "AM": "a", "PM": "a", "Q": "q"}


def unit(text: str) -> str:
    return UNITS[text.strip().strip("'\"").upper()]


def pattern(text: str, marks: dict[str, str]) -> str:
    """A quoted pattern in Spark's letters."""
    keys = sorted(marks, key=len, reverse=True)
    return re.sub("|".join(map(re.escape, keys)), lambda m: marks[m.group(0).upper() if marks is LETTERS else m.group(0)], text, flags=re.I if marks is LETTERS else 0)


def _boundaries(args: list[str], rules) -> str:
    """How many unit boundaries lie between two times."""
    u, a, b = unit(args[0]), args[1], args[2]
    if u == "YEAR":
        return f"(year({b}) - year({a}))"
    if u == "QUARTER":
        return f"((year({b}) - year({a})) * 4 + quarter({b}) - quarter({a}))"
    if u == "MONTH":
        return f"((year({b}) - year({a})) * 12 + month({b}) - month({a}))"
    if u == "DAY":
        return f"datediff({b}, {a})"
    if u == "WEEK":
        return f"cast((datediff({b}, date'1900-01-07') div 7) - (datediff({a}, date'1900-01-07') div 7) as int)"
    return f"timestampdiff({u}, date_trunc('{u}', {a}), date_trunc('{u}', {b}))"


def _datediff(args: list[str], rules) -> str:
    return f"datediff({args[0]}, {args[1]})" if len(args) == 2 else _boundaries(args, rules)


def _add(sign: str = ""):
    """DATE_ADD(d, INTERVAL n unit), with a number of days or an interval text."""

    def make(args: list[str], rules) -> str:
        if len(args) == 3:
            return f"timestampadd({unit(args[0])}, {sign}({args[1]}), {args[2]})"
        m = re.fullmatch(r"\s*interval\s+(.+?)\s+([a-z_]+)\s*", args[1], re.I | re.S)
        if m:
            n = m.group(1)
            n = f"cast({n} as int)" if n.startswith("'") else n
            return f"timestampadd({unit(m.group(2))}, {sign}({n}), {args[0]})"
        return f"date_add({args[0]}, {sign}({args[1]}))"

    return make


def _extract(args: list[str], rules) -> str:
    if len(args) == 1:
        u, x = re.fullmatch(r"\s*([A-Za-z_]+)\s+from\s+(.+)", args[0], re.I | re.S).groups()
    else:
        u, x = args
    name = u.strip().strip("'\"").upper()
    special = {"DOW": f"(dayofweek({x}) - 1)", "WEEKDAY": f"dayofweek({x})", "DW": f"dayofweek({x})", "DOY": f"dayofyear({x})", "DAYOFYEAR": f"dayofyear({x})", "EPOCH": f"unix_timestamp({x})", "ISO_WEEK": f"weekofyear({x})", "ISOWK": f"weekofyear({x})"}
    return special.get(name) or f"cast(extract({UNITS.get(name, name)} from {x}) as int)"


def _datename(args: list[str], rules) -> str:
    name = args[0].strip().strip("'\"").upper()
    if name in ("MONTH", "MM", "M"):
        return f"date_format({args[1]}, 'MMMM')"
    if name in ("WEEKDAY", "DW"):
        return f"date_format({args[1]}, 'EEEE')"
    return f"cast({_extract(args, rules)} as string)"


def _week(args: list[str], rules) -> str:
    """Week of the year: ISO with mode 1, 3 or none asked of the ISO dialects; else weeks that begin on Sunday, from 0."""
    mode = args[1].strip() if len(args) > 1 else "0"
    if mode in ("1", "3"):
        return f"weekofyear({args[0]})"
    return f"cast((dayofyear({args[0]}) + 6 - (dayofweek({args[0]}) - 1)) div 7 as int)"


def _format(marks: dict[str, str], call: str):
    return lambda a, r: call.format(a[0], pattern(a[1], marks))


def _time_of(seconds: str) -> str:
    return f"date_format(timestamp_seconds({seconds}), 'HH:mm:ss')"


def define(c: FunctionCatalog) -> None:
    c.add("CURRENT_DATE CURDATE TODAY UTC_DATE", "current_date()")
    c.add("CURRENT_TIME CURTIME LOCALTIME UTC_TIME", "date_format(current_timestamp(), 'HH:mm:ss')")
    c.add("CURRENT_TIMESTAMP NOW SYSDATE SYSTEMDATE GETDATE SYSDATETIME SYSTIMESTAMP LOCALTIMESTAMP CLOCK_TIMESTAMP STATEMENT_TIMESTAMP TRANSACTION_TIMESTAMP SYSDATETIMEOFFSET", "current_timestamp()")
    c.add("GETUTCDATE SYSUTCDATETIME UTC_TIMESTAMP SYS_EXTRACT_UTC", "to_utc_timestamp({0:current_timestamp()}, current_timezone())")
    c.add("ADDDATE DATE_ADD DATEADD TIMESTAMPADD", _add())
    c.add("DATE_SUB SUBDATE", _add("-"))
    c.add("ADDTIME", "timestampadd(SECOND, unix_timestamp(to_timestamp(concat('1970-01-01 ', {1}))), {0})")
    c.add("SUBTIME", "timestampadd(SECOND, -unix_timestamp(to_timestamp(concat('1970-01-01 ', {1}))), {0})")
    c.add("EOMONTH LAST_DAY", "last_day(add_months({0}, {1:0}))")
    c.add("DATEFROMPARTS MAKE_DATE", "make_date({0}, {1}, {2})")
    c.add("MAKEDATE", "date_add(make_date({0}, 1, 1), {1} - 1)")
    c.add("DATETIMEFROMPARTS DATETIME2FROMPARTS MAKE_TIMESTAMP MAKE_TIMESTAMPTZ", "make_timestamp({0}, {1}, {2}, {3:0}, {4:0}, {5:0})")
    c.add("SMALLDATETIMEFROMPARTS", "make_timestamp({0}, {1}, {2}, {3}, {4}, 0)")
    c.add("DATETIMEOFFSETFROMPARTS", "make_timestamp({0}, {1}, {2}, {3}, {4}, {5})")
    c.add("TODATETIMEOFFSET FROM_TZ", "convert_timezone({1}, current_timezone(), cast({0} as timestamp_ntz))")
    c.add("SWITCHOFFSET", "convert_timezone({1}, cast({0} as timestamp_ntz))")
    c.add("CONVERT_TZ NEW_TIME", "convert_timezone({1}, {2}, cast({0} as timestamp_ntz))")
    c.add("TZ_OFFSET SYS_OP_ZONE_ID", "date_format(current_timestamp(), 'XXX')")
    c.add("TIMEFROMPARTS MAKETIME MAKE_TIME", "concat_ws(':', lpad(cast({0} as string), 2, '0'), lpad(cast({1} as string), 2, '0'), lpad(cast({2} as string), 2, '0'))")
    c.add("DATENAME", _datename)
    c.add("DATEPART EXTRACT DATE_PART", _extract)
    for name in "DAY MONTH YEAR HOUR MINUTE SECOND QUARTER DAYOFWEEK DAYOFYEAR WEEKOFYEAR".split():
        c.add(name, name.lower() + "({0})")
    c.add("DAYOFMONTH", "day({0})")
    c.add("WEEKDAY", "weekday({0})")
    c.add("DATETRUNC DATE_TRUNC", lambda a, r: f"date_trunc('{unit(a[0])}', {a[1]})")
    c.add("DATEDIFF", _datediff)
    c.add("DATEDIFF_BIG", lambda a, r: f"cast({_boundaries(a, r)} as bigint)")
    c.add("TIMESTAMPDIFF", lambda a, r: f"timestampdiff({unit(a[0])}, {a[1]}, {a[2]})")
    c.add("ISDATE", "cast(try_to_timestamp(cast({0} as string)) is not null as int)")
    c.add("TO_DAYS", "(datediff({0}, date'0001-01-01') + 366)")
    c.add("FROM_DAYS", "date_add(date'0001-01-01', {0} - 366)")
    c.add("DAYS", "(datediff({0}, date'0001-01-01') + 1)")
    c.add("TO_SECONDS", "((datediff({0}, date'0001-01-01') + 366) * 86400L + hour({0}) * 3600 + minute({0}) * 60 + second({0}))")
    c.add("GET_FORMAT", "'%Y-%m-%d'")
    c.add("TIME_FORMAT DATE_FORMAT", _format(PERCENT, "date_format({0}, {1})"))
    c.add("STR_TO_DATE", _format(PERCENT, "try_to_timestamp({0}, {1})"))
    c.add("STRFTIME", lambda a, r: f"date_format({a[1]}, {pattern(a[0], PERCENT_C)})")
    c.add("UNIX_TIMESTAMP UNIXEPOCH", "unix_timestamp({0:current_timestamp()})")
    c.add("FROM_UNIXTIME", lambda a, r: f"timestamp_seconds({a[0]})" if len(a) == 1 else f"date_format(timestamp_seconds({a[0]}), {pattern(a[1], PERCENT)})")
    c.add("DATE", "cast({0} as date)")
    c.add("DATETIME TIMESTAMP", "cast({0} as timestamp)")
    c.add("TIME", "date_format({0}, 'HH:mm:ss')")
    c.add("MICROSECOND", "cast((extract(second from {0}) % 1) * 1000000 as int)")
    c.add("MONTHNAME", "date_format({0}, 'MMMM')")
    c.add("DAYNAME", "date_format({0}, 'EEEE')")
    c.add("PERIOD_ADD", "cast(date_format(add_months(make_date({0} div 100, {0} % 100, 1), {1}), 'yyyyMM') as int)")
    c.add("PERIOD_DIFF", "((({0}) div 100 - ({1}) div 100) * 12 + ({0}) % 100 - ({1}) % 100)")
    c.add("TIMEDIFF", "concat(case when {0} < {1} then '-' else '' end, " + _time_of("abs(unix_timestamp({0}) - unix_timestamp({1}))") + ")")
    c.add("SEC_TO_TIME", _time_of("{0}"))
    c.add("TIME_TO_SEC MIDNIGHT_SECONDS", "(hour({0}) * 3600 + minute({0}) * 60 + second({0}))")
    c.add("WEEK", _week)
    c.add("WEEK_ISO", "weekofyear({0})")
    c.add("YEARWEEK", "(extract(yearofweek from {0}) * 100 + weekofyear({0}))")
    c.add("FORMAT_PICO_TIME", "case when {0} >= 1e12 then concat(format_number({0} / 1e12, 2), ' s') when {0} >= 1e9 then concat(format_number({0} / 1e9, 2), ' ms') when {0} >= 1e6 then concat(format_number({0} / 1e6, 2), ' us') when {0} >= 1e3 then concat(format_number({0} / 1e3, 2), ' ns') else concat({0}, ' ps') end")
    c.add("AGE", "concat(cast(months_between({0}, {1}) as int) div 12, ' years ', cast(months_between({0}, {1}) as int) % 12, ' mons ', datediff({0}, add_months({1}, cast(months_between({0}, {1}) as int))), ' days')")
    c.add("MAKE_INTERVAL", "make_interval({*})")
    c.add("TO_DSINTERVAL", "to_timestamp_interval({0})".replace("to_timestamp_interval", "pq_day_interval"))
    c.add("TO_YMINTERVAL", "make_ym_interval(cast(split_part({0}, '-', 1) as int), cast(split_part({0}, '-', 2) as int))")
    c.add("NUMTODSINTERVAL", lambda a, r: {"DAY": f"make_dt_interval({a[0]})", "HOUR": f"make_dt_interval(0, {a[0]})", "MINUTE": f"make_dt_interval(0, 0, {a[0]})", "SECOND": f"make_dt_interval(0, 0, 0, {a[0]})"}[unit(a[1])])
    c.add("NUMTOYMINTERVAL", lambda a, r: {"YEAR": f"make_ym_interval({a[0]})", "MONTH": f"make_ym_interval(0, {a[0]})"}[unit(a[1])])
    c.add("TO_DATE", lambda a, r: f"try_to_date({a[0]})" if len(a) == 1 else f"try_to_date({a[0]}, {pattern(a[1], LETTERS)})")
    c.add("TO_TIMESTAMP TO_TIMESTAMP_TZ", lambda a, r: f"try_to_timestamp({a[0]})" if len(a) == 1 else f"try_to_timestamp({a[0]}, {pattern(a[1], LETTERS)})")
    c.add("TO_CHAR", lambda a, r: f"cast({a[0]} as string)" if len(a) == 1 else (f"trim(to_char(cast({a[0]} as decimal(38,10)), {a[1]}))" if re.fullmatch(r"\s*'[0-9.,$SGDL MI]*'\s*", a[1]) else f"date_format({a[0]}, {pattern(a[1], LETTERS)})"))
    c.add("ADD_MONTHS", "add_months({0}, {1})")
    c.add("MONTHS_BETWEEN", "months_between({0}, {1})")
    c.add("DBTIMEZONE SESSIONTIMEZONE", "current_timezone()")
    c.add("NEXT_DAY", "next_day({0}, {1})")
    c.add("SCN_TO_TIMESTAMP", "timestamp_seconds({0})")
    c.add("TIMESTAMP_TO_SCN", "unix_timestamp({0})")
    for name in "DAYS HOURS MINUTES SECONDS YEARS".split():
        c.add(f"ADD_{name}", f"timestampadd({name[:-1]}, {{1}}, {{0}})")
    c.add("DAYOFWEEK_ISO", "(weekday({0}) + 1)")
    c.add("JULIANDAY", "(unix_micros(cast({0} as timestamp)) / 86400000000.0 + 2440587.5)")
    c.add("TOMORROW", "date_add(current_date(), 1)")
    c.add("YESTERDAY", "date_add(current_date(), -1)")
