"""DataFrame-level column transforms built from the scalar expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scalars as S

FLAG_SUFFIX_LEN = 5  # e.g. "_flag": dropped from the name when renaming


def flag_to_dummy(df: DataFrame, cols: Sequence[str], rename: bool = True) -> DataFrame:
    """Map Y/N-style flags to 1/0 (other values NULL).

    With ``rename`` the last five characters of the name are dropped
    (``new_period_flag`` -> ``new_period``); names of five characters or less
    are rejected rather than emptied.
    """
    out = df
    for c in cols:
        out = out.withColumn(c, S.flag_to_dummy(c))
        if rename:
            if len(c) <= FLAG_SUFFIX_LEN:
                raise ValueError(f"cannot drop a {FLAG_SUFFIX_LEN}-character suffix from {c!r}")
            out = out.withColumnRenamed(c, c[:-FLAG_SUFFIX_LEN])
    return out


def binary_to_dummy(df: DataFrame, col: str, new_name: str = "female") -> DataFrame:
    """FEMALE/F -> 1, MALE/M -> 0, other NULL; the column is renamed."""
    return df.withColumn(col, S.binary_code_dummy(col)).withColumnRenamed(col, new_name)


def add_indicators(df: DataFrame, cols: Sequence[str], name: str = "missing") -> DataFrame:
    """``<col>_<name>`` = 1 where ``col`` is NULL."""
    return df.select("*", *[S.missing_indicator(c).alias(f"{c}_{name}") for c in cols])


def to_numeric(df: DataFrame, cols: Sequence[str], integral: bool = False) -> DataFrame:
    return df.select(*[S.to_numeric(c, integral).alias(c) if c in cols else F.col(c) for c in df.columns])


def to_dates(df: DataFrame, cols: Sequence[str], fmt: str | None = None) -> DataFrame:
    return df.select(*[S.parse_date(c, fmt).alias(c) if c in cols else F.col(c) for c in df.columns])


def clean_strings(df: DataFrame, chars: str = "?\u0000", empty_to_null: bool = True) -> DataFrame:
    """Strip characters from every string column; optionally '' -> NULL."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "string":
            c = S.strip_chars(f.name, chars)
            if empty_to_null:
                c = F.nullif(c, F.lit(""))
            out.append(c.alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
