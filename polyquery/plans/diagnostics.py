"""What a plan tells: text, warnings, advice, measured rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from polyquery.plans.tokens import Token, nested, tokenize
from polyquery.profiles import Profile, profile

#: Rows from which a read counts as high (fixed value).
HIGH_READ = 100
#: Share of rows kept from which a filter counts as weak.
WEAK_FILTER = 0.6


@dataclass(frozen=True)
class Warning_:
    code: str
    message: str


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as text."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def warnings(sql: str, rows_read: int, rows_out: int, dialect: str | Profile = "standard") -> list[Warning_]:
    """PW001 to PW005 for a query and its row counts."""
    t = nested(tokenize(sql, profile(dialect)))
    has = lambda *w: any(x.is_word(*w) for x in t)
    out = []
    if has("ORDER") and not has("LIMIT", "FETCH", "TOP", "FIRST", "OFFSET"):
        out.append(Warning_("PW001", "ORDER BY without a limit sorts everything"))
    high = rows_read >= HIGH_READ
    if has("WHERE") and high and rows_out / rows_read >= WEAK_FILTER:
        out.append(Warning_("PW002", "the filter keeps most rows"))
    at = next((i for i, x in enumerate(t) if x.is_word("SELECT")), 0)
    if at + 1 < len(t) and (t[at + 1].text == "*" or any(a.text == "." and b.text == "*" for a, b in zip(t, t[1:]))):
        out.append(Warning_("PW003", "SELECT * reads all columns"))
    if not has("WHERE") and high:
        out.append(Warning_("PW004", "a large read without WHERE"))
    if has("DISTINCT") and high:
        out.append(Warning_("PW005", "DISTINCT over a large read"))
    return out


def advice(sql: str, dialect: str | Profile = "standard") -> list[str]:
    """Columns compared with values in WHERE: candidates to partition, bucket or sort files by."""
    t = nested(tokenize(sql, profile(dialect)))
    at = next((i for i, x in enumerate(t) if x.is_word("WHERE")), len(t))
    found = []

    def walk(part: list[Token]) -> None:
        for a, b in zip(part, part[1:]):
            if a.kind in ("word", "name") and (b.text in ("=", "<", ">", "<=", ">=") or b.is_word("IN", "BETWEEN")):
                found.append(a.text.strip("`"))
        for x in part:
            if x.kind == "group":
                walk(x.inner)

    walk(t[at:])
    return list(dict.fromkeys(found))


def traced(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """The frame and an observation that has its row count after an action."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows_out")), seen
