"""Scalar column builders (all JVM-side expressions, no Python UDFs).

Each function takes column names or Columns and returns a Column, so callers
compose them inside ``select``/``withColumn`` and Catalyst keeps them in
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The unknown-date sentinel year prefix, and the flag and code
# maps that must match the reference's behaviour.
SENTINEL_PREFIX = "0001"
FLAG_MAP = {
    "Y": 1, "N": 0, "Yes": 1, "No": 0, "T": 1, "F": 0, "t": 1, "f": 0,
    "True": 1, "False": 0, "OPEN": 1, "CLOSED": 0,
}
BINARY_CODE_MAP = {"FEMALE": 1, "MALE": 0, "F": 1, "M": 0}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def not_sentinel(c) -> Column:
    """``c NOT LIKE '0001%'`` on text dates or ``year(c) > 1`` on dates.

    NULL stays NULL, so a WHERE on it drops NULL rows too (three-valued logic).
    """
    c = _c(c)
    return ~c.cast("string").startswith(SENTINEL_PREFIX)


def sentinel_to_null(c) -> Column:
    """``CASE WHEN c LIKE '0001%' THEN NULL ELSE c END``."""
    c = _c(c)
    return F.when(not_sentinel(c), c)


def least_strict(*cols) -> Column:
    """Row-wise minimum that is NULL when any input is NULL.

    Spark's ``least`` skips NULLs; the scalar ``min(a, b)`` being replaced
    returns NULL instead.
    """
    cs = [_c(c) for c in cols]
    cond = cs[0].isNotNull()
    for c in cs[1:]:
        cond = cond & c.isNotNull()
    return F.when(cond, F.least(*cs))


def day_diff(end, start) -> Column:
    """Whole days between two dates (``julianday(end) - julianday(start)``)."""
    return F.datediff(_c(end), _c(start))


def years_between_nonneg(later, earlier, days_per_year: float = 365.0) -> Column:
    """``(later - earlier) / 365.0``, NULL when negative or either is NULL."""
    d = day_diff(later, earlier).cast("double") / F.lit(days_per_year)
    return F.when(d >= 0, d)


def range_flag(value, lo, hi, default=None) -> Column:
    """``coalesce(value, default) BETWEEN lo AND hi`` as 0/1 (inclusive)."""
    v = _c(value)
    if default is not None:
        v = F.coalesce(v, F.lit(default))
    return F.when(v.between(lo, hi), 1).otherwise(0).cast("int")


def truncating_mean(total, n) -> Column:
    """Integer ``sum / count(*)`` truncated toward zero (SQLite integer division)."""
    return F.when(_c(n) != 0, (_c(total) / _c(n)).cast("long"))


def scrub_delimiter(c, delimiter: str = ",") -> Column:
    """``REPLACE(c, ',', '')``: remove the list delimiter from a code."""
    return F.translate(_c(c), delimiter, "")


def strip_chars(c, chars: str) -> Column:
    """Remove every character of ``chars`` from a string column."""
    return F.translate(_c(c), chars, "")


def empty_to_null(c) -> Column:
    return F.nullif(_c(c), F.lit(""))


def flag_to_dummy(c) -> Column:
    """Map Y/N-style flags to 1/0; anything else becomes NULL."""
    m = F.create_map(*[x for k, v in FLAG_MAP.items() for x in (F.lit(k), F.lit(v))])
    text = _c(c).cast("string")
    return m[F.when(text == "true", "True").when(text == "false", "False").otherwise(text)].cast("int")  # booleans as text


def binary_code_dummy(c) -> Column:
    """FEMALE/F -> 1, MALE/M -> 0, anything else NULL."""
    m = F.create_map(*[x for k, v in BINARY_CODE_MAP.items() for x in (F.lit(k), F.lit(v))])
    return m[_c(c)].cast("int")


def to_numeric(c, integral: bool = False) -> Column:
    """Coercing parse: bad values become NULL (``pd.to_numeric(errors='coerce')``)."""
    v = F.expr(f"try_cast({c} AS double)") if isinstance(c, str) else c.try_cast("double")
    if integral:
        return F.when(v == F.floor(v), v.cast("long"))
    return v


def numeric_column(df, c: str):  # noqa: ANN001, ANN201 - DataFrame to DataFrame
    """``c`` parsed as a number, as BIGINT only if every parsed value is whole (one aggregate decides)."""
    v = to_numeric(c)
    whole = df.agg(F.bool_and(v == F.floor(v))).first()[0]
    return df.withColumn(c, v.cast("long") if whole else v)


def parse_date(c, fmt: str | None = None) -> Column:
    """Text to DATE; unparseable values become NULL."""
    if fmt:
        return F.try_to_date(_c(c), F.lit(fmt)) if hasattr(F, "try_to_date") else F.to_date(_c(c), fmt)
    return F.try_to_date(_c(c)) if hasattr(F, "try_to_date") else F.to_date(_c(c))


def year_in_range_or_null(c, lo: int, hi: int, sep: str = "/") -> Column:
    """For ``M/D/YYYY`` text: keep the value when lo <= year <= hi, else NULL."""
    c = _c(c)
    year = F.split(c, sep).getItem(2).try_cast("int")
    return F.when(year.between(lo, hi), c)


def missing_indicator(c) -> Column:
    """1 when NULL else 0."""
    return _c(c).isNull().cast("int")


def not_equal_keep_null(c, value) -> Column:
    """``c != value`` that keeps NULL rows (pandas semantics)."""
    return ~_c(c).eqNullSafe(F.lit(value))
