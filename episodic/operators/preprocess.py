"""Leakage-safe preprocessing: fit statistics on one frame, apply to any.

Every ``fit_*`` runs one distributed aggregation and returns a small,
bounded statistics object (one number per column, one mean per group key,
one vocabulary per categorical column); every ``apply_*`` is a pure column
expression (or a many-to-one join for per-group statistics), so fitting on
train and applying to test never leaks test rows into the statistics.
Group statistics are computed with ``groupBy`` and joined back -- not with
a window -- so one huge group is pre-aggregated map-side instead of landing
in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Hashable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reuse
from .ranking import GROUP_N, RANK, rank

# ------------------------------------------------------------ D13 null columns


def null_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(column_name, n_null)`` for the columns that contain NULLs (one pass)."""
    cols = list(cols or df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    long = counts.selectExpr(f"stack({len(cols)}, {stack}) AS (column_name, n_null)")
    return long.where(F.col("n_null") > 0).select("column_name", F.col("n_null").cast("long"))


# ------------------------------------------------------------ D9, P3, P4 fills

_AGGS: dict[str, Callable[[str], Column]] = {
    "mean": lambda c: F.avg(c),
    "max": lambda c: F.max(c),
    "min": lambda c: F.min(c),
}


def fit_quantiles(df: DataFrame, cols: Sequence[str], ps: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns, linearly interpolated between order statistics.

    The values of all columns are ranked in one range-partitioned pass
    (``ranking.rank``), so no task holds the distinct values of a column; only
    the two ranks around each quantile reach the driver (at most
    ``2 * len(ps)`` rows a column).  NULLs take no part; a column without
    values has NULL quantiles.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols])
    long = df.select(F.explode(cells).alias("_c")).select("_c.name", "_c.v").where(F.col("v").isNotNull())
    ranked = rank(long, [F.col("v").asc()], ["name"])
    at = F.array(*[F.lit(float(p)) * (F.col(GROUP_N) - 1) for p in ps])
    wanted = F.exists(at, lambda x: (F.floor(x) + 1 == F.col(RANK)) | (F.ceil(x) + 1 == F.col(RANK)))
    rows = ranked.where(wanted).select("name", "v", RANK, GROUP_N).collect()
    found = {(r["name"], r[RANK]): r["v"] for r in rows}
    sizes = {r["name"]: r[GROUP_N] for r in rows}

    def value(c: str, p: float) -> float | None:
        if c not in sizes:
            return None
        x = float(p) * (sizes[c] - 1)
        lo, hi = math.floor(x), math.ceil(x)
        a, b = found[c, lo + 1], found[c, hi + 1]
        return a if lo == hi or a == b else (hi - x) * a + (x - lo) * b

    return {c: [value(c, p) for p in ps] for c in cols}



def fit_fill(df: DataFrame, cols: Sequence[str], how: str | Callable[[str], Column] = "mean") -> dict:
    """Column -> fill value, from one aggregation over ``df``.

    ``how`` is mean / max / min / median or any ``str -> Column`` aggregate
    (the caller-supplied fill function of the original API).
    """
    if how == "median":
        return {c: v[0] for c, v in fit_quantiles(df, cols, [0.5]).items()}
    if isinstance(how, str):
        if how not in _AGGS:
            raise ValueError("fill only supports mean, max, min or median")
        fn = _AGGS[how]
    else:
        fn = how
    row = df.agg(*[fn(c).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def apply_fill(df: DataFrame, values: dict) -> DataFrame:
    return df.select(*[
        F.coalesce(F.col(c), F.lit(values[c])).alias(c) if c in values and values[c] is not None else F.col(c)
        for c in df.columns])


def fill_nan(df: DataFrame, cols: Sequence[str], how="mean") -> DataFrame:
    return apply_fill(df, fit_fill(df, cols, how))


def fill_by_aggregate(df: DataFrame, col: str, agg: Callable[[str], Column] = F.avg) -> DataFrame:
    return apply_fill(df, fit_fill(df, [col], agg))


# ------------------------------------------------------------ D12, P5 outliers


def fit_zscore(df: DataFrame, cols: Sequence[str]) -> dict:
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}


def null_outliers(df: DataFrame, cols: Sequence[str], sd: float = 3.0, stats: dict | None = None) -> DataFrame:
    """Values with ``|z| >= sd`` become NULL; rows are kept.  A constant column
    (std 0) becomes all NULL, as the division by zero does in pandas."""
    stats = stats or fit_zscore(df, cols)
    out = []
    for c in df.columns:
        if c in stats:
            m, s = stats[c]
            z = F.try_divide(F.col(c) - F.lit(m), F.lit(s)) if s else F.lit(None).cast("double")
            out.append(F.when(F.abs(z) < sd, F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


# ------------------------------------------------------------ D14, P6 deciles


def fit_quantile_edges(df: DataFrame, cols: Sequence[str], q: int = 10, round_digits: int | None = None) -> dict[str, list[float]]:
    """Distinct quantile edges of each column (linear interpolation, like ``qcut``), all from one ranking."""
    out = {}
    for c, values in fit_quantiles(df, cols, [i / q for i in range(q + 1)]).items():
        edges = [v if round_digits is None else round(v, round_digits) for v in values if v is not None]
        out[c] = sorted(set(edges))
    return out


def apply_bins(col: str, edges: list[float]) -> Column:
    """0-based bin, right-closed, lowest edge included: the number of interior
    edges strictly below the value.  NULL stays NULL."""
    c = F.col(col)
    interior = edges[1:-1]
    if not edges:
        return F.lit(None).cast("int")
    b = F.lit(0)
    for e in interior:
        b = b + (c > F.lit(e)).cast("int")
    inside = (c >= F.lit(edges[0])) & (c <= F.lit(edges[-1]))
    return F.when(c.isNotNull() & inside, b).cast("int")


def discretise(df: DataFrame, cols: Sequence[str], q: int = 10, suffix: str = "cat",
               round_digits: int | None = None) -> DataFrame:
    out = df
    edges = fit_quantile_edges(df, cols, q, round_digits)
    for c in cols:
        out = out.withColumn(c + suffix, apply_bins(c, edges[c]))
    return out


# ------------------------------------------------------------ R4, R5 min-max


def fit_minmax(df: DataFrame, cols: Sequence[str]) -> dict:
    row = df.agg(*[x for c in cols for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first()
    return {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in cols}


def _scale(lo, hi) -> float:
    rng = (hi - lo) if lo is not None and hi is not None else None
    return 1.0 if not rng else float(rng)


def apply_minmax(df: DataFrame, stats: dict, suffix: str = "") -> DataFrame:
    """``(x - min) / (max - min)`` with the train min/max; a constant train
    column uses range 1 (train values scale to 0).  Test values may leave
    [0, 1].  ``suffix`` keeps raw columns beside the scaled ones."""
    scaled = {c: ((F.col(c).cast("double") - F.lit(lo)) / F.lit(_scale(lo, hi))) for c, (lo, hi) in stats.items()}
    if suffix:
        return df.select("*", *[e.alias(c + suffix) for c, e in scaled.items()])
    return df.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def invert_minmax(df: DataFrame, stats: dict) -> DataFrame:
    inv = {c: (F.col(c) * F.lit(_scale(lo, hi)) + F.lit(lo)) for c, (lo, hi) in stats.items()}
    return df.select(*[inv[c].alias(c) if c in inv else F.col(c) for c in df.columns])


# ------------------------------------------------------------ R1-R3 encoders


MOST_CODES = 100_000


def distinct_codes(codes: DataFrame, most: int = MOST_CODES) -> list[str]:
    """Sorted distinct values of a one-column frame; an error beyond ``most``, so that free text never fills the driver."""
    got = codes.toDF("v").where(F.col("v").isNotNull()).distinct().limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} distinct codes: not a vocabulary")
    return sorted(str(r["v"]) for r in got)


def first_codes(codes: DataFrame, most: int = MOST_CODES) -> dict[str, int]:
    """The least number beside each code of a frame of (code, number); an error beyond ``most`` codes."""
    got = codes.toDF("v", "n").where(F.col("v").isNotNull()).groupBy("v").agg(F.min("n").alias("n")).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} distinct codes: not a vocabulary")
    return {str(r["v"]): r["n"] for r in got}


def fit_vocabulary(df: DataFrame, col: str, sep: str | None = None, most: int = MOST_CODES) -> list[str]:
    """Sorted distinct values (or tokens of a delimited list) of ``col``, at most ``most``."""
    return distinct_codes(df.select(F.explode(F.split(F.col(col), sep)) if sep else F.col(col)), most)


def apply_one_hot(df: DataFrame, col: str, vocab: Sequence[str], keep: bool = True) -> DataFrame:
    """``<col>_<value>`` 0/1 columns for the train vocabulary; NULL and unseen
    values give all zeros."""
    dummies = [F.coalesce((F.col(col) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{col}_{v}") for v in vocab]
    out = df.select("*", *dummies)
    return out if keep else out.drop(col)


def apply_multi_hot(df: DataFrame, col: str, vocab: Sequence[str], sep: str = ",") -> DataFrame:
    """``<col>_<token>`` 0/1 for delimited lists; NULL -> all zeros."""
    toks = F.split(F.col(col), sep)
    dummies = [F.coalesce(F.array_contains(toks, F.lit(v)).cast("int"), F.lit(0)).alias(f"{col}_{v}")
               for v in vocab]
    return df.select("*", *dummies)


def align_to_train(test: DataFrame, train_columns: Sequence[str], fill=0) -> DataFrame:
    """Select exactly the train columns; those missing in test become 0."""
    have = set(test.columns)
    return test.select(*[F.col(c) if c in have else F.lit(fill).alias(c) for c in train_columns])


# ------------------------------------------------------------ P1, P2 imputation


def _group_means(df: DataFrame, keys: Sequence[str], exprs: dict[str, Column]) -> DataFrame:
    return (df.where(F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull())
            .groupBy(*keys).agg(*[F.avg(e).alias(n) for n, e in exprs.items()]))


def impute_group_mean(df: DataFrame, year: str, code: str, target: str) -> DataFrame:
    """NULL -> mean of target for the row's (year, code) group, else the mean
    over rows where both keys are present.  Statistics come from the
    un-imputed input; rows with a NULL key form no group."""
    gm = _group_means(df, [year, code], {"_gm": F.col(target)})
    glob = df.where(F.col(year).isNotNull() & F.col(code).isNotNull()).agg(F.avg(target)).first()[0]
    out = df.join(gm, [year, code], "left")
    filled = F.coalesce(F.col(target), F.col("_gm"), F.lit(glob))
    return out.select(*[filled.alias(c) if c == target else F.col(c) for c in df.columns])


@dataclass
class CascadeStats:
    """Fitted state of ``impute_cascade``: per-(year, code) means from the
    un-imputed fit frame plus two global means taken after the earlier steps.
    ``held``: the columns of the frame that hold its group means, in place of ``group``."""
    group: DataFrame | None
    global_start: float | None = None
    global_gap: float | None = None
    names: dict = field(default_factory=dict)
    held: tuple[str, str] | None = None


def _cascade_steps(df: DataFrame, st: CascadeStats, upto: int) -> DataFrame:
    n = st.names
    yrs = F.col(n["length"]) / F.lit(n["days_per_year"])
    s, e, f = n["age_start"], n["age_end"], n["age_first"]
    x = df if st.held else df.join(st.group, [n["year"], n["code"]], "left")
    start_mean, gap_mean = st.held or ("_gs", "_gd")
    x = x.withColumn(s, F.coalesce(F.col(s), F.col(e) - yrs, F.col(start_mean)))
    if upto == 1:
        return x
    x = x.withColumn(s, F.coalesce(F.col(s), F.lit(st.global_start)))
    x = x.withColumn(e, F.coalesce(F.col(e), F.col(s) + yrs))
    x = x.withColumn(f, F.coalesce(F.col(f), F.col(s) - F.col(gap_mean)))
    if upto == 2:
        return x
    return x.withColumn(f, F.coalesce(F.col(f), F.col(s) - F.lit(st.global_gap)))


def fit_cascade(df: DataFrame, year: str, code: str, length: str, age_start: str, age_end: str,
                age_first: str, days_per_year: float = 365.0) -> CascadeStats:
    names = dict(year=year, code=code, length=length, age_start=age_start, age_end=age_end,
                 age_first=age_first, days_per_year=days_per_year)
    gm = _group_means(df, [year, code], {"_gs": F.col(age_start), "_gd": F.col(age_start) - F.col(age_first)})
    st = CascadeStats(group=gm, names=names)
    st.global_start = _cascade_steps(df, st, 1).agg(F.avg(age_start)).first()[0]
    st.global_gap = _cascade_steps(df, st, 2).agg(F.avg(F.col(age_start) - F.col(age_first))).first()[0]
    return st


def fit_cascades(df: DataFrame, members: Mapping[Hashable, Column], year: str, code: str, length: str, age_start: str, age_end: str,
                 age_first: str, days_per_year: float = 365.0) -> tuple[DataFrame, dict[Hashable, CascadeStats]]:
    """Several cascades in one series of jobs, each fitted on the rows where its condition of ``members`` holds.

    Also gives ``df``, written, with every cascade's group means (columns ``_gs_0``, ``_gd_0``, ...).
    All means come from one aggregate; only rows that lack an age are joined to them.
    """
    names = dict(year=year, code=code, length=length, age_start=age_start, age_end=age_end,
                 age_first=age_first, days_per_year=days_per_year)
    stats = {m: CascadeStats(None, names=names, held=(f"_gs_{i}", f"_gd_{i}")) for i, m in enumerate(members)}
    gap = F.col(age_start) - F.col(age_first)
    means = {}
    for m, inside in members.items():
        means |= {stats[m].held[0]: F.when(inside, F.col(age_start)), stats[m].held[1]: F.when(inside, gap)}
    groups = _group_means(df, [year, code], means)
    lacks = F.col(age_first).isNull() | (F.col(age_start).isNull() & (F.col(age_end).isNull() | F.col(length).isNull()))
    lacks = lacks & F.col(year).isNotNull() & F.col(code).isNotNull()  # without a key there is no group; such rows would meet in one task
    whole = df.where(~lacks).select("*", *[F.lit(None).cast("double").alias(c) for c in means])
    df = reuse(whole.unionByName(df.where(lacks).join(groups, [year, code], "left").select(*df.columns, *means)), "cascade_rows")

    def over_all(value: Callable[[CascadeStats], Column]) -> dict[Hashable, float | None]:
        row = df.agg(*[F.avg(F.when(inside, value(stats[m]))).alias(f"m{i}") for i, (m, inside) in enumerate(members.items())]).first()
        return dict(zip(members, row, strict=True))

    yrs = F.col(length) / F.lit(days_per_year)

    def start(st: CascadeStats) -> Column:
        return F.coalesce(F.col(age_start), F.col(age_end) - yrs, F.col(st.held[0]))

    for m, v in over_all(start).items():
        stats[m].global_start = v

    def gap_left(st: CascadeStats) -> Column:
        s = F.coalesce(start(st), F.lit(st.global_start))
        return s - F.coalesce(F.col(age_first), s - F.col(st.held[1]))

    for m, v in over_all(gap_left).items():
        stats[m].global_gap = v
    return df, stats


def apply_cascade(df: DataFrame, st: CascadeStats) -> DataFrame:
    return _cascade_steps(df, st, 3).select(*df.columns)


def impute_cascade(df: DataFrame, year: str, code: str, length: str, age_start: str, age_end: str,
                   age_first: str, days_per_year: float = 365.0, fit_on: DataFrame | None = None) -> DataFrame:
    """Cascading imputation of three related ages.

    start: end - len/365, then the (year, code) group mean of start, then the
    mean of start after those two steps; end: start + len/365; first:
    start - group mean of (start - first), then start - mean(start - first)
    after that step.  Group means use the un-imputed fit frame.  Statistics
    come from ``fit_on`` (e.g. the train fold) or, by default, from ``df``.
    """
    st = fit_cascade(fit_on if fit_on is not None else df, year, code, length, age_start, age_end,
                     age_first, days_per_year)
    return apply_cascade(df, st)
