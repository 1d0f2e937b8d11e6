"""Statistics of reads and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def trimmed(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Mean and deviation, cut to integers, of the values between two shares of the sorted rows.

    Works on counts of equal values, so the running count covers distinct values only.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    past = F.sum("n").over(Window.orderBy(value))
    total = F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy())
    kept = F.greatest(F.lit(0), F.least(F.col("past"), F.floor(F.col("total") * high)) - F.greatest(F.col("past") - F.col("n"), F.floor(F.col("total") * low)))
    cut = counts.withColumn("past", past).withColumn("total", total).withColumn("k", kept)
    sums = cut.agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col(value)).alias("s"), F.sum(F.col("k") * F.col(value) * F.col(value)).alias("q"))
    mean = F.col("s") / F.col("n")
    return sums.select(mean.cast("long").alias("mean"), F.sqrt(F.col("q") / F.col("n") - mean * mean).cast("long").alias("sd"), "n")


def alignment_stats(reads: DataFrame, genome: int) -> DataFrame:
    """Mean and deviation of inserts, read length and depth; fixed values under 100 reads."""
    g = reads.filter("tlen > 50 and tlen < 6000").agg(F.count("*").alias("n"), F.avg("tlen").alias("m"), F.stddev_pop("tlen").alias("s"), F.avg(F.col("ref_end") - F.col("ref_start")).alias("l"))
    few = F.col("n") < 100
    return g.select(*[F.round(F.when(few, F.lit(d)).otherwise(F.col(c)), 6).alias(a) for c, a, d in (("m", "mean", 500.0), ("s", "sd", 100.0), ("l", "read_len", 150.0))], F.round(F.col("n") * F.col("l") / genome, 6).alias("depth"))


def support(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows above both the 33rd percentile of their group and 1."""
    cut = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.33)).alias("_cut"))
    return df.join(cut, keys).filter(F.col(value) > F.greatest("_cut", F.lit(1.0))).groupBy(*keys).agg(F.count("*").alias("n"))


def discordant(reads: DataFrame, reach: float = 1.95) -> DataFrame:
    """Weighted count of odd pairs by contig; of each name the first read counts."""
    first = reads.withColumn("_i", F.row_number().over(Window.partitionBy("qname").orderBy("ref_start", "ref_end", "mapq", "tlen"))).filter("_i = 1")
    stats = reads.agg(F.avg("tlen").alias("_m"), F.stddev_pop("tlen").alias("_d"))
    weight = F.when(F.col("tlen") > F.col("_m") + reach * F.col("_d"), 1.0).when(F.col("tlen") < F.col("_m") - reach * F.col("_d"), 0.8).otherwise(0.0)
    return first.crossJoin(F.broadcast(stats)).groupBy("contig").agg(F.round(F.sum(weight), 6).alias("abnormal"), F.count("*").alias("total"))


def largest_cluster(df: DataFrame, keys: list[str], value: str, gap: int = 3) -> DataFrame:
    """Median of the largest cluster of values at most ``gap`` apart (first of equals), if it has
    two members or there are at most three values."""
    w = Window.partitionBy(*keys).orderBy(value)
    marked = df.withColumn("_c", F.sum(F.when(F.col(value) - F.lag(value).over(w) <= gap, 0).otherwise(1)).over(w))
    clusters = marked.groupBy(*keys, "_c").agg(F.count("*").alias("n"), F.median(value).alias("mid"))
    best = clusters.groupBy(*keys).agg(F.max_by(F.struct("n", "mid"), F.struct(F.col("n"), -F.col("_c"))).alias("b"), F.sum("n").alias("total"))
    return best.filter((F.col("b.n") > 1) | (F.col("total") <= 3)).select(*keys, F.col("b.mid").alias("mid"), F.col("b.n").alias("n"))


def ranked_by_contig(df: DataFrame, start: str) -> DataFrame:
    """``df`` with ``place``: the dense rank by (contig key, ``start``), first within a contig, then
    after the places of the contigs before it, so that no task sorts all rows."""
    from readlake.functions.reads import contig_key

    own = df.withColumn("_k", contig_key("contig")).withColumn("_r", F.dense_rank().over(Window.partitionBy("_k").orderBy(start)))
    sizes = own.groupBy("_k").agg(F.max("_r").alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return own.join(before, "_k").withColumn("place", (F.col("_b") + F.col("_r")).cast("long")).drop("_k", "_r", "_b")


def class_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of each class."""
    both = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    hit = F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0))
    recall = both.groupBy(F.col("t").alias("class")).agg(hit.alias("tp"), F.sum("n").alias("of_truth"))
    precision = both.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("of_calls"))
    p, r = F.try_divide("tp", "of_calls"), F.try_divide("tp", "of_truth")
    return recall.join(precision, "class", "left").select("class", F.round(F.coalesce(p, F.lit(0.0)), 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def best_threshold(df: DataFrame, score: str, truth: str, steps: int = 99) -> DataFrame:
    """The threshold of a grid with the largest mean recall of both classes, first of equals.

    Rows are counted by grid cell first; the grid then sums ``steps`` cells, whatever the size.
    """
    cell = F.least(F.lit(steps), F.greatest(F.lit(0), F.floor(F.col(score) * (steps + 1))))
    cells = df.groupBy(cell.alias("cell")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("n"))
    after = Window.orderBy("cell").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    full = df.sparkSession.range(0, steps + 1).withColumnRenamed("id", "cell").join(cells, "cell", "left").fillna(0)
    w = full.withColumn("tp", F.sum("p").over(after)).withColumn("fp", F.sum("n").over(after)).withColumn("pos", F.sum("p").over(every)).withColumn("neg", F.sum("n").over(every)).filter("cell > 0")
    metric = F.round(0.5 * (F.col("tp") / F.col("pos") + 1 - F.col("fp") / F.col("neg")), 9)
    return w.select((F.col("cell") / (steps + 1)).alias("threshold"), metric.alias("metric")).agg(F.max_by("threshold", F.struct("metric", -F.col("threshold"))).alias("threshold"), F.max("metric").alias("metric"))
