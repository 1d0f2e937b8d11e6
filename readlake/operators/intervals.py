"""Interval algebra on half-open [start_pos, end_pos) rows by contig."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Width of the bins of the overlap join.
BIN = 1024
#: Positions of a contig that one task sorts where a running value is needed.
SPAN = 1 << 16


def spans(df: DataFrame, keys: list[str], start: str, *aggs: Column) -> tuple[DataFrame, Column]:
    """(keys, _span and aggregates of each stretch of ``SPAN`` positions), and the window over a key's stretches before one.

    Running values need no sort of whole contigs: stretches run alone, and what earlier ones hand on comes from this
    table, of a row for each stretch that has rows."""
    return df.groupBy(*keys, "_span").agg(*aggs), Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)


def islands(df: DataFrame, keys: list[str], start: str = "start_pos", end: str = "end_pos", gap: int | None = None) -> DataFrame:
    """``df`` with ``island``: the start of the merged stretch that a row is in.

    Touching intervals are apart; with ``gap`` stretches at most so far from each other merge. An empty interval is in
    the stretch that starts where it does.
    """
    keys = list(keys)
    b = df.withColumn("_span", F.floor(F.col(start) / SPAN))
    most, before = spans(b, keys, start, F.max(end).alias("_m"))
    own = b.join(most.select(*keys, "_span", F.max("_m").over(before).alias("_carry")), [*keys, "_span"])
    w = Window.partitionBy(*keys, "_span").orderBy(start, end)
    reach = F.greatest(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carry"))
    joins = F.col(start) < reach if gap is None else F.col(start) - reach <= gap
    marked = own.withColumn("_new", F.when(joins, F.lit(None)).otherwise(F.col(start))).drop("_carry")
    last, before = spans(marked, keys, start, F.max("_new").alias("_l"))
    out = marked.withColumn("island", F.max("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).join(last.select(*keys, "_span", F.max("_l").over(before).alias("_from")), [*keys, "_span"])
    return out.withColumn("island", F.coalesce("island", "_from")).select(*df.columns, "island")


def merge(df: DataFrame, keys: list[str] = ("contig",), *aggs: Column) -> DataFrame:
    """Merged intervals: keys, start_pos, end_pos and further aggregates."""
    return islands(df, list(keys)).groupBy(*keys, "island").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), *aggs).drop("island")


def overlap_join(a: DataFrame, b: DataFrame, how: str = "inner", width: int = BIN, pad: int = 0) -> DataFrame:
    """Rows of ``a`` and ``b`` on one contig that overlap (within ``pad``).

    Both sides are dealt to the bins that they touch, so the join is an equi-join on (contig,
    bin) that shuffles evenly, instead of a nested loop; a pair is kept in the first bin that
    both touch. ``how``: inner (columns of b get the suffix _b), semi, anti, or flag (a boolean ``hit``).
    """
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / width), F.floor((F.greatest(hi, lo + 1) - 1) / width)))
    if how in ("semi", "anti", "flag"):
        # Hits go by coordinates: row numbers could differ between two evaluations of ``a``.
        at = ["contig", "start_pos", "end_pos"]
        left = a.select(*at).distinct().withColumn("_bin", bins(F.col("start_pos") - pad, F.col("end_pos") + pad))
        right = b.select(F.col("contig").alias("_c"), F.col("start_pos").alias("_s"), F.col("end_pos").alias("_e")).distinct().withColumn("_b", bins(F.col("_s"), F.col("_e")))
        # A semi join stops at the first partner, so pairs are not made.
        meet = (F.col("start_pos") - pad < F.col("_e")) & (F.col("end_pos") + pad > F.col("_s"))
        hit = left.join(right, (F.col("contig") == F.col("_c")) & (F.col("_bin") == F.col("_b")) & meet, "left_semi").select(*at).distinct()
        if how == "flag":
            return a.join(hit.withColumn("hit", F.lit(True)), at, "left").withColumn("hit", F.coalesce("hit", F.lit(False))).select(*a.columns, "hit")
        return a.join(hit, at, "left_semi" if how == "semi" else "left_anti").select(*a.columns)
    right = b.select(*[F.col(c).alias(c + "_b") for c in b.columns])
    left = a.withColumn("_bin", bins(F.col("start_pos") - pad, F.col("end_pos") + pad))
    right = right.withColumn("_bin_b", bins(F.col("start_pos_b"), F.col("end_pos_b")))
    meet = (F.col("start_pos") - pad < F.col("end_pos_b")) & (F.col("end_pos") + pad > F.col("start_pos_b"))
    first = F.col("_bin") == F.greatest(F.floor((F.col("start_pos") - pad) / width), F.floor(F.col("start_pos_b") / width))
    return left.join(right, (F.col("contig") == F.col("contig_b")) & (F.col("_bin") == F.col("_bin_b")) & meet & first).drop("_bin", "_bin_b")


def complement(df: DataFrame, length: DataFrame, shrink: int = 0, least: int = 1) -> DataFrame:
    """Stretches of (contig, length) rows that no interval, cut by ``shrink`` at both ends, covers."""
    cut = df.select("contig", (F.col("start_pos") + shrink).alias("start_pos"), (F.col("end_pos") - shrink).alias("end_pos")).filter("end_pos > start_pos")
    whole = merge(cut)
    w = Window.partitionBy("contig").orderBy("start_pos")
    inner = whole.select("contig", F.coalesce(F.lag("end_pos").over(w), F.lit(0)).alias("a"), F.col("start_pos").alias("b"))
    tail = length.join(whole.groupBy("contig").agg(F.max("end_pos").alias("a")), "contig", "left").select("contig", F.coalesce("a", F.lit(0)).alias("a"), F.col("length").alias("b"))
    return inner.union(tail).filter(F.col("b") - F.col("a") >= least).select("contig", F.col("a").alias("start_pos"), F.col("b").alias("end_pos"))


def label_masks(frames: list[DataFrame]) -> DataFrame:
    """For n interval sets: merged islands by the set of sources in them; every mask has a row."""
    rows = None
    for i, f in enumerate(frames):
        part = f.select("contig", "start_pos", "end_pos", F.lit(1 << i).alias("bit"))
        rows = part if rows is None else rows.unionByName(part)
    merged = merge(rows, ["contig"], F.bit_or("bit").alias("mask"))
    found = merged.groupBy("mask").agg(F.count("*").alias("n"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("bases"))
    every = rows.sparkSession.range(1, 1 << len(frames)).select(F.col("id").cast("int").alias("mask"))
    return every.join(found, "mask", "left").select("mask", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("bases", F.lit(0)).cast("long").alias("bases"))


def runs(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Maximal runs of equal values: keys, value, first, last, n."""
    w, v = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys, value).orderBy(order)
    marked = df.withColumn("_run", F.row_number().over(w) - F.row_number().over(v))
    return marked.groupBy(*keys, value, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")


def nearest(a: DataFrame, b: DataFrame, distance: int = 10, width: int = BIN) -> DataFrame:
    """``a`` points (contig, pos) with ``hit``: whether ``b`` has a point within ``distance``."""
    as_interval = lambda df: df.withColumn("start_pos", F.col("pos")).withColumn("end_pos", F.col("pos") + 1)
    return overlap_join(as_interval(a), as_interval(b), "flag", width, distance).drop("start_pos", "end_pos")


def as_of(df: DataFrame, bounds: DataFrame, key: str, bound: str, value: str, width: int = 1 << 16) -> DataFrame:
    """``df`` with the value of the first bound above each key (null beyond the last).

    ``bounds`` is a small dimension; each bound owns the stretch from the one before it, and
    keys find their stretch by the binned overlap join.
    """
    before = F.coalesce(F.lag(bound).over(Window.orderBy(bound)), F.lit(0))
    owned = bounds.select(F.lit("").alias("contig"), before.alias("start_pos"), F.col(bound).alias("end_pos"), F.col(value)).filter("end_pos > start_pos")
    points = df.withColumn("contig", F.lit("")).withColumn("start_pos", F.col(key)).withColumn("end_pos", F.col(key) + 1)
    found = overlap_join(points, owned, "inner", width)
    return found.select(*df.columns, F.col(value + "_b").alias(value))


def locus_signatures(loci: DataFrame, points: DataFrame, width: int) -> DataFrame:
    """contig, locus, pos, support: median and count of the points of each locus (contig, start_pos, end_pos)
    within one bin of its fullest bin of ``width``, the first of equals."""
    at = ["contig", "locus"]
    inside = overlap_join(points, loci).select("contig", F.col("start_pos_b").alias("locus"), "start_pos", F.floor(F.col("start_pos") / width).alias("bin"))
    fullest = inside.groupBy(*at, "bin").agg(F.count("*").alias("n")).groupBy(*at).agg(F.max_by("bin", F.struct(F.col("n"), -F.col("bin"))).alias("best"))
    near = inside.join(fullest, at).filter(F.abs(F.col("bin") - F.col("best")) <= 1)
    return near.groupBy(*at).agg(F.median("start_pos").alias("pos"), F.count("*").alias("support"))


def mode_bin(df: DataFrame, keys: list[str], pos: str, size: str, width: int = 20) -> DataFrame:
    """keys, pos, size (medians, cut to integers) of the rows within one bin of the fullest bin, the first of equals, and its
    support (rows of that bin)."""
    b = df.withColumn("_bin", F.floor(F.col(pos) / width))
    best = b.groupBy(*keys, "_bin").agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.max_by("_bin", F.struct(F.col("_n"), -F.col("_bin"))).alias("_best"), F.max("_n").alias("support"))
    near = b.join(best, keys).filter(F.abs(F.col("_bin") - F.col("_best")) <= 1)
    return near.groupBy(*keys, "support").agg(F.floor(F.median(pos)).cast("bigint").alias("pos"), F.floor(F.median(size)).cast("bigint").alias("size")).select(*keys, "pos", "size", "support")
