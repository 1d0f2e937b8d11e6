"""Ordered operators: tiles, slices, ranks, peaks, smoothing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F


def _above(df: DataFrame, keys: list[str], order: str, value: str, least: float) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    v = Window.partitionBy(*keys, F.col(value) > least).orderBy(order)
    return df.withColumn("_run", F.row_number().over(w) - F.row_number().over(v)).filter(F.col(value) > least)


def hysteresis(df: DataFrame, keys: list[str], order: str, value: str, low: float, high: float, width: int) -> DataFrame:
    """Runs above ``low``, of ``width`` rows at least, that reach ``high``."""
    runs = _above(df, keys, order, value, low).groupBy(*keys, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), F.max(value).alias("best"))
    return runs.filter((F.col("n") >= width) & (F.col("best") >= high)).drop("_run")


def peaks(df: DataFrame, keys: list[str], order: str, value: str, low: float, width: int) -> DataFrame:
    """The largest row (first of equals) of each run above ``low`` of at most ``width`` rows."""
    runs = _above(df, keys, order, value, low).groupBy(*keys, "_run").agg(F.max_by(order, F.struct(F.col(value), -F.col(order))).alias(order), F.max(value).alias("best"), F.count("*").alias("width"))
    return runs.filter(F.col("width") <= width).drop("_run")


def slices(df: DataFrame, start: str, n: int = 20, width: int = 50) -> DataFrame:
    """Each window as ``n`` slices: slice, slice_start, slice_end."""
    out = df.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.withColumn("slice_start", F.col(start) + F.col("slice") * width).withColumn("slice_end", F.col("slice_start") + width)


def tiles(contigs: DataFrame, stride: int, tail: int = 10_000) -> DataFrame:
    """Tiles of (contig, length) rows; the last one reaches ``tail`` beyond the end."""
    cut = contigs.withColumn("start_pos", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(stride).cast("long"))))
    return cut.withColumn("end_pos", F.when(F.col("start_pos") + stride > F.col("length"), F.col("length") + tail).otherwise(F.col("start_pos") + stride)).drop("length")


def gaussian(sigma: float) -> list[float]:
    """Weights from the centre outwards, cut at 4 sigma."""
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(int(4 * sigma + 0.5) + 1)]
    total = w[0] + 2 * sum(w[1:])
    return [x / total for x in w]


def smooth(df: DataFrame, keys: list[str], order: str, value: str, sigma: float) -> Column:
    """Smoothed value; beyond the edges the row is mirrored, edge value included."""
    w = Window.partitionBy(*keys).orderBy(order)
    i, n = F.row_number().over(w), F.count("*").over(Window.partitionBy(*keys))
    kernel = gaussian(sigma)
    reach = len(kernel) - 1
    # What stands ``j`` rows away; a mirrored place is at most 2 * reach away.
    away = {j: F.lag(value, -j).over(w) if j < 0 else F.lead(value, j).over(w) for j in range(-2 * reach, 2 * reach + 1)}

    def mirrored(place: Column) -> Column:
        p = F.pmod(place - 1, 2 * n)
        return F.when(p < n, p + 1).otherwise(2 * n - p)

    def at(place: Column) -> Column:
        out = F.lit(None)
        for j, v in away.items():
            out = F.when(place == i + j, v).otherwise(out)
        return out

    out = F.col(value) * kernel[0]
    for k, weight in enumerate(kernel[1:], 1):
        out = out + weight * (at(mirrored(i - k)) + at(mirrored(i + k)))
    return out


def average_rank(keys: list[str], value: str) -> Column:
    """Rank with ties shared."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2.0


def top_share(df: DataFrame, value: str, share: float = 0.9, accuracy: int = 10_000) -> DataFrame:
    """Rows at or above an exact percentile (linear interpolation).

    A quantile sketch brackets it to a few parts in ``accuracy`` of the rows; the exact place is then found among the
    distinct values of the bracket, so no task holds those of all rows."""
    low, high = max(0.0, share - 2 / accuracy), min(1.0, share + 2 / accuracy)
    v = F.col(value).cast("double")
    found = df.agg(F.count(value).alias("_n"), F.approx_percentile(v, [low, high], accuracy).alias("_q")).select("_n", F.col("_q")[0].alias("_lo"), F.col("_q")[1].alias("_hi"))
    # One more value on either side, which matters where rows are few.
    wide = df.crossJoin(F.broadcast(found)).agg(F.max("_n").alias("_n"), F.max(F.when(v < F.col("_lo"), v)).alias("_p"), F.min(F.when(v > F.col("_hi"), v)).alias("_q"), F.max("_lo").alias("_a"), F.max("_hi").alias("_b"))
    near = df.crossJoin(F.broadcast(wide.select("_n", F.coalesce("_p", "_a").alias("_lo"), F.coalesce("_q", "_b").alias("_hi"))))
    below = near.agg(F.count_if(v < F.col("_lo")).alias("_below"))
    inside = near.filter((v >= F.col("_lo")) & (v <= F.col("_hi"))).groupBy(v.alias("_v")).agg(F.count("*").alias("_c"), F.max("_n").alias("_n"))
    past = inside.crossJoin(F.broadcast(below)).withColumn("_past", F.col("_below") + F.sum("_c").over(Window.orderBy("_v"))).withColumn("_place", (F.col("_n") - 1) * share)
    at = lambda k: F.min(F.when(F.col("_past") > k, F.col("_v")))
    place = F.col("_place")
    cut = past.agg(at(F.floor(place)).alias("_a"), at(F.ceil(place)).alias("_b"), F.max(place - F.floor(place)).alias("_part")).select((F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).filter(v >= F.col("_cut")).drop("_cut")


def slice_labels(df: DataFrame, keys: list[str], order: str, gone: str, more: str, low: float = 0.40, anchor: float = 0.70, least: int = 2, cut: float = 0.85, sure: float = 0.92, most: int = 10) -> DataFrame:
    """keys, ``order``, label: 1 in runs of ``gone`` above ``low``, of ``least`` rows at least, that reach ``anchor``; 2 at the first
    largest row of runs of ``more`` above ``cut`` of at most ``most`` rows, if none of them is 1 or it is above ``sure``."""
    every = df.select(*keys, order, gone, more)
    w = Window.partitionBy(*keys).orderBy(order)
    run = lambda c, at: F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, F.col(c) > at).orderBy(order))
    marked = every.withColumn("_r", run(gone, low)).withColumn("_q", run(more, cut))
    own = Window.partitionBy(*keys, "_r", F.col(gone) > low)
    lost = (F.col(gone) > low) & (F.count("*").over(own) >= least) & (F.max(gone).over(own) >= anchor)
    marked = marked.withColumn("_lost", lost)
    narrow = Window.partitionBy(*keys, "_q", F.col(more) > cut)
    first = F.row_number().over(narrow.orderBy(F.desc(more), order)) == 1
    peak = first & (F.col(more) > cut) & (F.count("*").over(narrow) <= most) & (~F.bool_or("_lost").over(narrow) | (F.max(more).over(narrow) > sure))
    return marked.withColumn("label", F.when(peak, 2).when(F.col("_lost"), 1).otherwise(0)).select(*keys, order, "label")


def tiled(pixels: DataFrame, side: int = 256) -> DataFrame:
    """(channel, y, x) of images of ``side`` as plane, y, x: four channels make a plane of two by two tiles, of which the lower two
    are upside down."""
    tile = F.col("channel") % 4
    y = F.when(tile >= 2, 2 * side - 1 - F.col("y")).otherwise(F.col("y"))
    return pixels.withColumn("plane", F.floor(F.col("channel") / 4).cast("int")).withColumn("y", y).withColumn("x", F.col("x") + F.when(tile % 2 == 1, side).otherwise(0))
