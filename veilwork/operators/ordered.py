"""Order-dependent operators that survive a hot group.

A plain window sorts a whole group in one task.  Here a group of more than
``ROWS_PER_BUCKET`` rows is cut into buckets along its order; windows run inside
(group, bucket), and only one summary row per bucket of these groups is
windowed per group.  Both sides meet on (group, bucket), by which the window
has dealt the rows already: the table is shuffled once.  Other groups are one
bucket and need no summary; which groups are large is counted first, and there
are at most as many as the table has times ``ROWS_PER_BUCKET`` rows.

Where the buckets come from:

* by default from the quantiles of the first order column over the large groups,
  read off a mergeable KLL sketch.  A bucket has about ``ROWS_PER_BUCKET`` rows, so
  no part of a group has more; beyond ``SKETCH`` buckets they grow with the table.
  Values so frequent that they are several quantiles are cut again by the
  second order column.
* or from an expression that grows with the order, such as ``even_buckets``
  over a dense sequence number.

Results don't depend on the bounds, which are values of the plan (scalar
subqueries): nothing is checkpointed, and a lost task finds the same buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET, GROUP, LARGE = "_bucket", "_group", "_large"
ROWS_PER_BUCKET = 1_000_000
SKETCH = 4096  # size of the quantile sketch, and the quantiles it is asked for: ranks are right to about 0.1 percent
FINE = 1 << 31  # buckets of the second column inside one of the first


def even_buckets(df: DataFrame, position: Column, rows_per_bucket: int = ROWS_PER_BUCKET) -> Column:
    """Bucket number of a numeric order column: equal widths, as many as the row count asks for.

    The bounds are one aggregate row (a scalar subquery), so the bucket size
    stays the same when the table grows.
    """
    bounds = df.agg(
        F.struct(F.min(position).alias("low"), F.max(position).alias("high"), F.count(F.lit(1)).alias("n")).alias("b")
    ).scalar()
    buckets = F.ceil(bounds["n"] / F.lit(rows_per_bucket))
    width = (bounds["high"] - bounds["low"] + 1).cast("double")
    return F.floor((position - bounds["low"]) / width * buckets)


def position(df: DataFrame, column: str) -> Column:
    """A whole number that never falls while the column rises; null counts as the least.

    Texts are read as the number of seven bytes after what the least and the
    greatest text share, fractions as their place between least and greatest.
    """
    dtype, value = df.schema[column].dataType, F.col(column)
    if isinstance(dtype, T.IntegralType | T.BooleanType):
        number = value.cast("long")
    elif isinstance(dtype, T.TimestampType):
        number = F.unix_micros(value)
    elif isinstance(dtype, T.TimestampNTZType):
        seconds = (F.hour(value) * 60 + F.minute(value)) * 60 + F.second(value)
        number = F.unix_date(value.cast("date")).cast("long") * 86_400 + seconds
    elif isinstance(dtype, T.DateType):
        number = F.unix_date(value).cast("long")
    elif isinstance(dtype, T.FractionalType):
        value = value.cast("double")
        finite = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
        ends = df.agg(F.struct(F.min(finite).alias("low"), F.max(finite).alias("high")).alias("e")).scalar()
        place = F.floor((value - ends["low"]) / (ends["high"] - ends["low"]) * (1 << 52))
        number = F.when(value <= ends["low"], 0).when(value >= ends["high"], 1 << 52).otherwise(place).cast("long")
    elif isinstance(dtype, T.StringType):
        low, high = (F.col(c).cast("binary") for c in ("low", "high"))
        same = F.filter(
            F.sequence(F.lit(0), F.least(F.octet_length(low), F.octet_length(high))),
            lambda i: F.substring(low, F.lit(1), i) == F.substring(high, F.lit(1), i),
        )
        shared = df.agg(F.min(value).alias("low"), F.max(value).alias("high")).select(F.size(same).alias("n")).scalar()
        number = F.conv(F.rpad(F.hex(F.substring(value.cast("binary"), shared, F.lit(7))), 14, "0"), 16, 10).cast("long")
    else:
        raise TypeError(f"no order of {dtype.simpleString()} can be cut into buckets")
    return F.coalesce(number, F.lit(-(1 << 63)))


def _quantiles(df: DataFrame, place: Column, rows_per_bucket: int) -> Column:
    """Bounds between buckets of equal size, ascending, as a scalar; frequent values more than once."""
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_bigint(place, SKETCH).alias("sketch"))
    buckets = F.ceil(F.col("n") / F.lit(rows_per_bucket))
    # ranks must be constants: all that the sketch tells apart, of which every so-maniest is taken
    ranks = F.split(F.lit(",".join(str(i / SKETCH) for i in range(1, SKETCH))), ",").cast("array<double>")
    stride = F.greatest(F.floor(F.lit(SKETCH) / buckets), F.lit(1))
    taken = F.filter(F.kll_sketch_get_quantile_bigint("sketch", ranks), lambda x, i: (i + 1) % stride == 0)
    return seen.select(F.when(buckets > 1, taken).otherwise(F.array().cast("array<bigint>")).alias("q")).scalar()


def _below(bounds: Column, place: Column) -> Column:
    """How many ascending bounds are smaller: a look at every so-maniest, then at those between two of them."""
    stride = F.greatest(F.ceil(F.sqrt(F.size(bounds))).cast("int"), F.lit(1))
    coarse = F.filter(bounds, lambda x, i: i % stride == 0)
    blocks = F.size(F.filter(coarse, lambda x: x < place))
    start = (blocks - 1) * stride
    inside = F.size(F.filter(F.slice(bounds, start + 1, stride), lambda x: x < place))
    return F.when(blocks == 0, 0).otherwise(start + inside).cast("long")


def with_sketched_buckets(
    df: DataFrame, order: Sequence[str], rows_per_bucket: int | None = None, among: Column | None = None
) -> DataFrame:
    """The frame with a bucket number that never falls along the order; buckets are of about equal size.

    With ``among`` this holds for the rows it is true of; all others get bucket 0.
    """
    rows_per_bucket = rows_per_bucket or ROWS_PER_BUCKET
    among = F.lit(True) if among is None else among
    # bounds are columns first: a lambda must not hold a subquery
    placed = df.withColumns({"_place": F.when(among, position(df.filter(among), order[0]))})
    placed = placed.withColumns({"_bounds": _quantiles(placed.filter(among), F.col("_place"), rows_per_bucket)})
    bucket = _below(F.array_distinct("_bounds"), F.col("_place")) * F.lit(FINE)
    if len(order) > 1:
        often = among & (F.size(F.filter("_bounds", lambda x: x == F.col("_place"))) > 1)
        placed = placed.withColumns({"_often": often, "_second": F.when(among, position(df.filter(among), order[1]))})
        frequent = placed.filter("_often")
        placed = placed.withColumns({"_inner": F.array_distinct(_quantiles(frequent, F.col("_second"), rows_per_bucket))})
        bucket = bucket + F.when(F.col("_often"), _below(F.col("_inner"), F.col("_second"))).otherwise(F.lit(0))
    return placed.withColumn(BUCKET, F.when(among, bucket).otherwise(F.lit(0).cast("long"))).select(*df.columns, BUCKET)


def _cut(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column | None) -> DataFrame:
    """The frame with its group (one column, so that null keys meet by equality), whether that has several buckets, and its bucket."""
    cut = df.withColumn(GROUP, F.struct(*keys) if keys else F.lit(0))
    if bucket is not None:
        return cut.withColumns({LARGE: F.lit(True), BUCKET: bucket})
    sizes = cut.groupBy(GROUP).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > ROWS_PER_BUCKET)
    large = sizes.agg(F.collect_list(GROUP).alias("g")).scalar()
    return with_sketched_buckets(cut.withColumn(LARGE, F.array_contains(large, F.col(GROUP))), order, among=F.col(LARGE))


def _fine(order: Sequence[str]):
    return Window.partitionBy(GROUP, BUCKET).orderBy(*order)


def _coarse():
    return Window.partitionBy(GROUP).orderBy(BUCKET)


def _join_bucket(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """Join the bucket summary back."""
    right = coarse.withColumnsRenamed({GROUP: f"_r{GROUP}", BUCKET: f"_r{BUCKET}"})
    return fine.join(right, (F.col(GROUP) == F.col(f"_r{GROUP}")) & (F.col(BUCKET) == F.col(f"_r{BUCKET}")), "left")


def previous_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, bucket: Column | None = None
) -> DataFrame:
    """``lag(value)`` per group in the given order, plus ``<out>_exists`` for "there was one"."""
    cut = _cut(df, keys, order, bucket)
    ends = cut.filter(LARGE).groupBy(GROUP, BUCKET).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    carried = ends.select(GROUP, BUCKET, F.lag("_last").over(_coarse()).alias("_carry"))
    inside = cut.withColumn("_prev", F.lag(F.struct(F.col(value).alias("v"))).over(_fine(order)))
    joined = _join_bucket(inside, carried)
    found = F.coalesce(F.col("_prev"), F.col("_carry"))
    return joined.select(*df.columns, found["v"].alias(out), found.isNotNull().alias(f"{out}_exists"))


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: Column, out: str, bucket: Column | None = None,
    total: str | None = None,
) -> DataFrame:
    """Sum of ``amount`` over the rows up to and including this one, per group; with ``total`` also over the whole group."""
    cut = _cut(df, keys, order, bucket).withColumn("_amount", amount)
    sums = cut.filter(LARGE).groupBy(GROUP, BUCKET).agg(F.sum("_amount").alias("_sum"))
    before = _coarse().rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("_sum").over(Window.partitionBy(GROUP))
    carried = sums.select(GROUP, BUCKET, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry"), whole.alias("_total"))
    up_to = _fine(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = cut.withColumn("_inside", F.sum("_amount").over(up_to))
    if total:
        inside = inside.withColumn("_own", F.sum("_amount").over(Window.partitionBy(GROUP, BUCKET)))
    joined = _join_bucket(inside, carried)
    more = [F.when(F.col(LARGE), F.col("_total")).otherwise(F.col("_own")).alias(total)] if total else []
    return joined.select(*df.columns, (F.col("_inside") + F.when(F.col(LARGE), F.col("_carry")).otherwise(F.lit(0))).alias(out), *more)


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, bucket: Column | None = None, total: str | None = None
) -> DataFrame:
    """``row_number()`` per group in ascending order; with ``total`` also the rows of the group."""
    return running_sum(df, keys, order, F.lit(1), out, bucket, total)


def salted_lookup(
    df: DataFrame, on: dict[str, Column], summary: DataFrame, columns: Sequence[str], salts: int | None = None
) -> DataFrame:
    """Left join with one summary row per key; the rows of a hot key spread over ``salts`` tasks.

    By default there is a salt for every ``ROWS_PER_BUCKET`` rows.  The summary is
    repeated for the salts that a key really has, so it never grows beyond
    the rows.  Below the broadcast threshold AQE turns the join into a
    broadcast by itself, after measuring the side.
    """
    hashable = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    many = F.lit(salts) if salts else df.agg((F.floor(F.count(F.lit(1)) / ROWS_PER_BUCKET) + 1).cast("int").alias("n")).scalar()
    salt = F.pmod(F.xxhash64(*hashable), many).cast("int")
    left = df.withColumns({"_l": F.struct(*[e.alias(k) for k, e in on.items()]), "_salt": salt})
    held = summary.select(F.struct(*on).alias("_r"), *columns)
    pairs = left.select(F.col("_l").alias("_p"), F.col("_salt").alias("_r_salt")).distinct()
    right = pairs.join(held, F.col("_p") == F.col("_r")).drop("_r")
    return left.join(right, (F.col("_l") == F.col("_p")) & (F.col("_salt") == F.col("_r_salt")), "left").select(*df.columns, *columns)


def per_group_value(
    df: DataFrame, keys: Sequence[str], aggregate: Column, out: str, salts: int | None = None
) -> DataFrame:
    """Attach one aggregate per group to every row of it; combined map-side, then looked up."""
    summary = df.groupBy(*keys).agg(aggregate.alias(out))
    return salted_lookup(df, {k: F.col(k) for k in keys}, summary, [out], salts)
