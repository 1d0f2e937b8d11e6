"""Decisions over joined evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Weights of the two kinds of support.
SUPPORT, CLIPS = 0.65, 1.15


def weighted(support: str, clips: str) -> Column:
    return SUPPORT * F.col(support) + CLIPS * F.col(clips)


def region_status(df: DataFrame, least: int, most: int) -> DataFrame:
    return df.withColumn("status", F.when(F.col("bases") < least, "empty").when(F.col("bases") > most, "too_large_skip").otherwise("bam_ready"))


def verdict(status: Column, raw: Column, depth: Column, odd: Column, pairs: Column) -> Column:
    """Whether three kinds of evidence keep a call."""
    vaf, ratio = F.coalesce(F.try_divide(raw.cast("double"), depth), F.lit(0.0)), F.coalesce(F.try_divide(odd.cast("double"), pairs), F.lit(0.0))
    adaptive = F.greatest(F.lit(0.065), F.least(F.lit(0.12), 0.002 * depth))
    doubtful = ((vaf >= adaptive) & (raw >= 5)) | ((ratio >= 0.08) & (odd >= 3)) | ((vaf >= 0.045) & (raw >= 3) & (ratio >= 0.045) & (odd >= 2))
    return F.when(status == "VERIFIED", ~((raw < 1) & (odd < 1))).when(status == "REF", (vaf >= 0.10) & (raw >= 5)).otherwise(doubtful)


def refined(start: Column, end: Column, new_start: Column, new_end: Column) -> Column:
    """The new interval where it is near the old one, else the old one."""
    near = (F.abs(new_start - start) < 2000) & (F.abs((new_end - new_start) - (end - start)) < 0.83 * (end - start))
    return F.when(F.coalesce(near, F.lit(False)), F.struct(new_start.alias("start_pos"), new_end.alias("end_pos"))).otherwise(F.struct(start.alias("start_pos"), end.alias("end_pos")))


def pass_through(calls: DataFrame, found: DataFrame) -> DataFrame:
    """``calls`` (call_id, start_pos, end_pos, svtype, info) with ``length``: that of ``found`` (call_id, length, evidence) for
    deletions, else as known. Split reads (SR) take IMPRECISE from info, pairs (DP) put it there."""
    flags = F.split("info", ";")
    exact = F.array_join(F.array_remove(flags, "IMPRECISE"), ";")
    vague = F.when(F.array_contains(flags, "IMPRECISE"), F.col("info")).otherwise(F.concat_ws(";", F.when(F.col("info") != "", F.col("info")), F.lit("IMPRECISE")))
    both = calls.join(found, "call_id", "left").withColumn("evidence", F.when(F.col("svtype") == "DEL", F.col("evidence")))
    info = F.when(F.col("evidence") == "SR", exact).when(F.col("evidence") == "DP", vague).otherwise(F.col("info"))
    length = F.when(F.col("evidence").isNotNull(), F.col("length")).otherwise(F.col("end_pos") - F.col("start_pos"))
    return both.withColumn("info", info).withColumn("length", length)


def deletion_length(split: str, pairs: str, known: str) -> list[Column]:
    """Length, its kind of evidence (SR, DP or none) and whether it stays imprecise."""
    s, d = F.col(split), F.col(pairs)
    return [F.coalesce(s, d, F.col(known)).alias("length"), F.when(s.isNotNull(), "SR").when(d.isNotNull(), "DP").alias("evidence"), F.when(s.isNotNull(), False).when(d.isNotNull(), True).alias("imprecise")]


def parallelism(cpus: Column) -> tuple[Column, Column]:
    """Workers and threads of each, by the number of processors."""
    n = F.greatest(cpus, F.lit(1))
    workers = F.when(n >= 32, 4).when(n >= 24, 3).when(n >= 12, 2).otherwise(1)
    return workers, F.greatest(F.lit(1), F.floor(n / workers))
