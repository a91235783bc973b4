"""Casts that give a default instead of an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = ["", "nan", "None"]


def _present(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    t = F.trim(c.cast("string"))
    return F.when(~t.isin(MISSING), t)


def safe_double(c: Column | str, default: float | None = 0.0) -> Column:
    return F.coalesce(_present(c).try_cast("double"), F.lit(default).cast("double"))


def safe_long(c: Column | str, default: int | None = 0) -> Column:
    """Integer by way of double, cut toward zero."""
    return F.coalesce(_present(c).try_cast("double").try_cast("bigint"), F.lit(default).cast("bigint"))


def safe_string(c: Column | str, default: str = "") -> Column:
    return F.coalesce(_present(c), F.lit(default))


def zero_as_missing(c: Column, default: Column | float) -> Column:
    """NULL and 0 both count as missing."""
    value = default if isinstance(default, Column) else F.lit(default)
    return F.when(c.isNull() | (c == 0), value).otherwise(c)


def fix_scientific(c: Column | str) -> Column:
    """'1.2E+08' back to '120000000'; anything else unchanged."""
    c = F.col(c) if isinstance(c, str) else c
    number = c.try_cast("double").try_cast("decimal(38,0)").cast("string")
    return F.when(F.contains(F.lower(c), F.lit("e+")), F.coalesce(number, c)).otherwise(c)


def price_from_text(c: Column | str) -> Column:
    """'1.290.000 đ' to 1290000; unreadable text to NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(c, r"[,. đ₫]|VND", "")).try_cast("double")


def first_digits(c: Column | str) -> Column:
    """The first run of digits once commas are gone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"(\d+)", 1), F.lit("")).try_cast("double")


def to_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Coerce the listed columns that exist; bad values become NULL."""
    return df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in columns if c in df.columns})


def tidy_strings(df: DataFrame) -> DataFrame:
    """In every string column: newlines to blanks, quotes dropped, trimmed."""
    def tidy(field: T.StructField) -> Column:
        if not isinstance(field.dataType, T.StringType):
            return F.col(field.name)
        t = F.regexp_replace(F.col(field.name), r"[\n\r]", " ")
        return F.trim(F.replace(t, F.lit('"'), F.lit(""))).alias(field.name)

    return df.select([tidy(f) for f in df.schema.fields])


def rating_label(c: Column | str, codes: dict[str, int]) -> Column:
    """Label name to class number; unknown names to NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return lookup(c, codes)


def lookup(c: Column, table: dict) -> Column:
    """Value of a fixed, short table; NULL when the key is not in it."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)
