"""Repetitions: their profile, and one row from several. (The reference format only declares this aggregation; here it runs.)"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys with more rows than this get their quantiles by narrowing intervals, so that no task holds all their values.
LARGE_GROUP = 1_000_000
#: Points of a sketch between which a rank is looked for, and its accuracy: about one row in 300 is left to be sorted.
POINTS, ACCURACY = 1000, 10_000


def repetition_profile(df: DataFrame, key: str) -> DataFrame:
    """n_rows, n_unique (missing counts as a value), avg_repeats, is_repetition of a key."""
    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    p = sizes.agg(F.sum("n").cast("long").alias("n_rows"), F.count("*").alias("n_unique"))
    avg = F.col("n_rows") / F.col("n_unique")
    return p.select("n_rows", "n_unique", avg.alias("avg_repeats"), ((F.col("n_unique") < F.col("n_rows")) & (avg >= 1.5)).alias("is_repetition"))


def _beside(df: DataFrame, other: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """df with the columns of other, which has one row for each key; missing keys are equal."""
    o = other.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(by)], *[f"`{c}`" for c in other.columns if c not in by])
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & F.col(f"`{c}`").eqNullSafe(F.col(f"__k{i}"))
    return df.join(o, on, how).drop(*[f"__k{i}" for i in range(len(by))])


def _step(cells: DataFrame, want: DataFrame) -> DataFrame:
    """want (g, at, rank, low, high, found) with narrower open intervals: the rank counts the values within its interval."""
    within = _within(cells, want)
    grid = F.percentile_approx("v", [k / POINTS for k in range(POINTS + 1)], ACCURACY).alias("grid")
    seen = within.groupBy("g", "at").agg(grid, F.count("*").alias("n")).withColumnsRenamed({"g": "__g", "at": "__at"})
    k = F.floor(F.col("rank") * POINTS / F.col("n")).cast("int")
    edges = want.join(seen, (F.col("g") == F.col("__g")) & (F.col("at") == F.col("__at"))).select("g", "at", "rank", "low", "high", "found", F.get("grid", k - 1).alias("x"), F.get("grid", k + 2).alias("y"))
    v, x, y = F.col("v"), F.coalesce("x", F.lit(float("-inf"))), F.coalesce("y", F.lit(float("nan")))
    counts = [F.count_if(c).alias(name) for name, c in (("lt_x", v < x), ("le_x", v <= x), ("lt_y", v < y), ("le_y", v <= y))]
    names = ["g", "at", "rank", "low", "high", "found"]
    sums = _within(cells, edges, "x", "y").groupBy(*names, x.alias("x"), y.alias("y")).agg(*counts)
    r = F.col("rank")
    case = lambda *c: F.when(r < F.col("lt_x"), c[0]).when(r < F.col("le_x"), c[1]).when(r < F.col("lt_y"), c[2]).when(r < F.col("le_y"), c[3]).otherwise(c[4])
    none = F.lit(None).cast("double")
    new = sums.select("g", "at", (r - case(F.lit(0), r, F.col("le_x"), r, F.col("le_y"))).alias("rank"), case(F.col("low"), none, F.col("x"), none, F.col("y")).alias("low"), case(F.col("x"), none, F.col("y"), none, F.col("high")).alias("high"), case(none, F.col("x"), none, F.col("y"), none).alias("found"))
    return want.where("found is not null").unionByName(new)


def _within(cells: DataFrame, want: DataFrame, *more: str) -> DataFrame:
    """The values within each open interval that is still looked into, beside it; a missing end is open."""
    w = want.where("found is null").withColumnRenamed("g", "__g")
    both = cells.join(w, F.col("g") == F.col("__g")).where("(low is null or v > low) and (high is null or v < high)")
    return both.select("g", "at", "v", "rank", "low", "high", "found", *more)


def _selected(cells: DataFrame, want: DataFrame) -> DataFrame:
    """g, at, found: the value of each rank among the values (g, v) of its group, whatever their number."""
    want = _step(cells, want)
    nth = F.row_number().over(Window.partitionBy("g", "at").orderBy("v")) - 1
    rest = _within(cells, want).withColumn("nth", nth).where("nth = rank").select("g", "at", F.col("v").alias("found"))
    return want.where("found is not null").select("g", "at", "found").unionByName(rest)


def _large_keys(df: DataFrame, by: list[str], large: int) -> DataFrame | None:
    """The keys of more than `large` rows, if there are any."""
    keys = df.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > large).drop("__n")
    return None if keys.isEmpty() else keys


def quantiles(df: DataFrame, by: list[str], columns: list[str], shares: list[float], large: int = LARGE_GROUP) -> DataFrame:
    """One row for each key: of each column the exact quantiles at the shares, interpolated, as `c` (one share) or an array.

    A key of at most `large` rows is aggregated as it is. Of a larger one a mergeable sketch gives an interval that a
    rank lies in, and one count the rank within it; only the values between are sorted, about one in 300.
    """
    if not by:
        return quantiles(df.withColumn("__all", F.lit(0)), ["__all"], columns, shares, large).drop("__all")
    return _quantiles(df, by, columns, shares, _large_keys(df, by, large))


def _quantiles(df: DataFrame, by: list[str], columns: list[str], shares: list[float], large: DataFrame | None) -> DataFrame:
    one = lambda c: F.percentile(F.col(f"`{c}`").cast("double"), shares[0] if len(shares) == 1 else shares).alias(c)
    if large is None:
        return df.groupBy(*by).agg(*[one(c) for c in columns])
    small = _beside(df, large, by, "left_anti").groupBy(*by).agg(*[one(c) for c in columns])
    key = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(by)])
    each = [F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(columns)]
    cells = _beside(df, large, by, "left_semi").select(key.alias("key"), F.inline(F.array(*each))).where("v is not null").select(F.struct("key", "c").alias("g"), "v")
    spots = cells.groupBy("g").agg(F.count("*").alias("n")).select("g", F.posexplode(F.array(*[(F.col("n") - 1) * F.lit(float(q)) for q in shares])).alias("q", "spot"))
    none = F.lit(None).cast("double")
    want = spots.select("g", "spot", F.explode(F.array_distinct(F.array(F.floor("spot"), F.ceil("spot")))).alias("rank")).select("g", F.col("rank").alias("at"), "rank", none.alias("low"), none.alias("high"), none.alias("found")).distinct()
    got = _selected(cells, want)
    near = spots.join(got.withColumnRenamed("g", "__g"), (F.col("g") == F.col("__g")) & F.abs(F.col("at") - F.col("spot")).__lt__(1))
    weight = F.when(F.col("at") == F.col("spot"), 1.0).otherwise(1 - F.abs(F.col("at") - F.col("spot")))
    value = near.groupBy("g", "q").agg(F.sum(F.col("found") * weight).alias("x"))
    whole = value.groupBy("g.key").agg(*[F.transform(F.sort_array(F.collect_list(F.when(F.col("g.c") == i, F.struct("q", "x")))), lambda s: s["x"]).alias(f"__x{i}") for i in range(len(columns))])
    out = [F.when(F.size(f"__x{i}") > 0, F.get(f"__x{i}", F.lit(0)) if len(shares) == 1 else F.col(f"__x{i}")).alias(c) for i, c in enumerate(columns)]
    # keys whose values are all missing have no cells
    empty = large.select(*by, key.alias("__key"))
    found = empty.join(whole.withColumnRenamed("key", "__found"), F.col("__key") == F.col("__found"), "left")
    return small.unionByName(found.select(*[f"`{c}`" for c in by], *out))


def aggregate(df: DataFrame, by: list[str], columns: list[str], method: str = "mean") -> DataFrame:
    """One row for each key: mean, median, or robust_mean (of values within three scaled median deviations)."""
    if method == "robust_mean":
        return robust_mean(df, by, columns)
    if method == "median":
        return quantiles(df, by, columns, [0.5])
    return df.groupBy(*by).agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in columns])


def vote(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """The most frequent label of each key, the least of equals; counted first, so that a hot key is few rows."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("__n"))
    return counts.groupBy(*by).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col(label).alias("label"))).alias("__best")).select(*by, F.col("__best.label").alias(label))


def robust_mean(df: DataFrame, by: list[str], columns: list[str], within: float = 3.0, large: int = LARGE_GROUP) -> DataFrame:
    """Mean of the values whose distance from the median is at most `within` times 1.4826 times the median distance (all, where that is 0)."""
    cell = [F.col(f"`{c}`") for c in columns]
    keys = _large_keys(df, by, large)
    mid = _quantiles(df, by, columns, [0.5], keys).withColumnsRenamed({c: f"__m{i}" for i, c in enumerate(columns)})
    far = _beside(df.select(*[f"`{c}`" for c in by], *cell), mid, by).withColumns({f"__d{i}": F.abs(c - F.col(f"__m{i}")) for i, c in enumerate(cell)})
    spread = _quantiles(far, by, [f"__d{i}" for i in range(len(columns))], [0.5], keys).withColumnsRenamed({f"__d{i}": f"__s{i}" for i in range(len(columns))})
    both = _beside(far, spread, by)
    kept = [F.when((F.col(f"__s{i}") == 0) | (F.col(f"__d{i}") <= within * 1.4826 * F.col(f"__s{i}")), c) for i, c in enumerate(cell)]
    return both.groupBy(*by).agg(*[F.avg(k).alias(c) for k, c in zip(kept, columns, strict=True)])


def without_outliers(df: DataFrame, by: list[str], columns: list[str], threshold: float = 0.95, large: int = LARGE_GROUP) -> DataFrame:
    """The rows whose every value lies within the central `threshold` share of its key's values (by quantiles; ties stay)."""
    bounds = quantiles(df, by, columns, [(1 - threshold) / 2, (1 + threshold) / 2], large).withColumnsRenamed({c: f"__b{i}" for i, c in enumerate(columns)})
    rows = _beside(df, bounds, by)
    for i, c in enumerate(columns):
        rows = rows.where(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").between(F.get(f"__b{i}", F.lit(0)), F.get(f"__b{i}", F.lit(1))))
    return rows.select(*[f"`{c}`" for c in df.columns])


def profile_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n_unique (missing counts), n_missing, uniqueness: one pass for all columns."""
    n = F.count("*")
    cells = [F.struct(F.lit(c).alias("column_name"), (F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).cast("long").alias("n_unique"), F.count_if(F.col(c).isNull()).alias("n_missing"), ((F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))) / n).alias("uniqueness")) for c in columns]
    return df.agg(F.array(*cells).alias("x")).select(F.inline("x"))


def ragged_lengths(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n_points"))


def increasing_within(df: DataFrame, by: str, time: str) -> DataFrame:
    """Whether each sample's time never repeats and never falls in the order of its points."""
    before = F.lag(time).over(Window.partitionBy(by).orderBy(time))
    return df.withColumn("__up", F.coalesce(F.col(time) > before, F.lit(True))).groupBy(by).agg(F.bool_and("__up").alias("increasing"))


def row_hash(*columns: str | Column) -> Column:
    """SHA-256 of a row's canonical text: cells as text, a missing one as \\N, with a separator between."""
    cells = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\\N")) for c in columns]
    return F.sha2(F.concat_ws("\u001f", *cells), 256)
