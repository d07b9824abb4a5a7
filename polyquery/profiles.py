"""What differs between the emulated SQL dialects, one frozen profile each."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Profile:
    """Rules of one dialect; ``compat`` turns on the two-valued NULL logic."""

    name: str
    ignore_case: bool = True  # text comparison
    like_ignores_case: bool = True
    concat_null_is_empty: bool = False
    log_value_first: bool = False  # LOG(value, base)
    cast_text_to_int_is_zero: bool = True
    empty_text_is_null: bool = False
    count_type: str = "bigint"
    upsert_counts_double: bool = False
    stddev_is_sample: bool = False
    quotes: str = '"'  # characters that may quote a name
    string_quotes: str = "'"
    hash_comments: bool = False
    pagination: frozenset[str] = frozenset({"limit"})
    families: tuple[str, ...] = ()  # function families, most specific first
    compat: bool = False

    def compatible(self) -> Profile:
        return replace(self, compat=True)


PROFILES: dict[str, Profile] = {
    p.name: p
    for p in (
        Profile("standard", ignore_case=False, like_ignores_case=False, cast_text_to_int_is_zero=False, stddev_is_sample=True, pagination=frozenset({"limit", "fetch", "top"})),
        Profile("mysql", quotes="`", string_quotes="'\"", hash_comments=True, upsert_counts_double=True, families=("mysql",)),
        Profile("mariadb", quotes="`", string_quotes="'\"", hash_comments=True, upsert_counts_double=True, pagination=frozenset({"limit", "fetch"}), families=("mariadb", "mysql")),
        Profile("sqlserver", quotes='"[', concat_null_is_empty=True, log_value_first=True, cast_text_to_int_is_zero=False, count_type="int", pagination=frozenset({"top", "fetch"}), families=("sqlserver",)),
        Profile("sqlazure", quotes='"[', concat_null_is_empty=True, log_value_first=True, cast_text_to_int_is_zero=False, count_type="int", pagination=frozenset({"top", "fetch"}), families=("sqlserver",)),
        Profile("oracle", ignore_case=False, like_ignores_case=False, concat_null_is_empty=True, empty_text_is_null=True, count_type="decimal(38,0)", pagination=frozenset({"fetch"}), families=("oracle",)),
        Profile("postgres", ignore_case=False, like_ignores_case=False, concat_null_is_empty=True, pagination=frozenset({"limit", "fetch"}), families=("postgres",)),
        Profile("sqlite", ignore_case=False, quotes='"`[', families=("sqlite",)),
        Profile("db2", ignore_case=False, pagination=frozenset({"fetch", "limit"}), families=("db2", "oracle")),
        Profile("firebird", ignore_case=False, pagination=frozenset({"rows", "first", "fetch"}), families=("firebird",)),
        Profile("auto", quotes='"`[', pagination=frozenset({"limit", "fetch", "top", "rows", "first"}), families=("sqlserver", "mysql", "postgres", "oracle", "sqlite", "db2", "firebird", "mariadb")),
    )
}


def profile(dialect: str | Profile = "standard") -> Profile:
    if isinstance(dialect, Profile):
        return dialect
    try:
        return PROFILES[dialect.lower()]
    except KeyError:
        raise ValueError(f"unknown dialect {dialect!r}; known: {', '.join(PROFILES)}") from None
