"""Signals, piles, sinks and model surface on hand-computed cases."""

import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from readlake.operators import models, sequential, signals
from readlake.sources import formats, sinks


def test_indel_signals(spark):
    rows = [("5S10M30D10M40D9M", 100), ("10M30D90M40D9M", 100), ("10M25I5M30I9M", 0), ("10M20D10M", 0)]
    df = spark.createDataFrame(rows, "cigar string, start bigint")
    got = [[tuple(x) for x in r[0]] for r in df.select(signals.indel_signals("cigar", "start")).collect()]
    assert got == [[(110, -80)], [(110, -30), (230, -40)], [(10, 55)], []]


def test_split_signals(spark):
    df = spark.createDataFrame([(100, 600, 50, 50), (100, 100, 50, 300), (100, 9000, 50, 5000)], "a bigint, b bigint, c bigint, d bigint")
    got = [[tuple(x) for x in r[0]] for r in df.select(signals.split_signals(*[F.col(c) for c in "abcd"])).collect()]
    assert got == [[(100, -500)], [(100, 250), (100, 250)], []]


def test_discover(spark):
    reads = spark.createDataFrame([("c", 0, "100M50D10M"), ("c", 5, "97M48D10M"), ("c", 5, "9M")], "contig string, ref_start bigint, cigar string")
    parts = spark.createDataFrame([("c", 7, 5000, 5000, 50, 300)], "contig string, qname bigint, ref_end bigint, sa_start bigint, read_end bigint, sa_read_start bigint")
    got = {(r.pos, r["size"], r.support) for r in signals.discover(reads, parts).collect()}
    assert got == {(102, -48, 2), (5000, 250, 2)}


def test_pile(spark):
    reads = spark.createDataFrame([("c", 1, 2, "2M2I2M"), ("c", 2, 3, "1M1D2M"), ("c", 3, 9, "3M"), ("c", 4, 7, "2M1D2M")], "contig string, qname bigint, ref_start bigint, cigar string")
    rows = {(r.qname, r.win): (r.lead, r.pile) for r in signals.padded_pile(reads, 10).collect()}
    assert rows == {(1, 0): (2, "MMIIMM"), (2, 0): (3, "M--DMM"), (3, 0): (11, "M"), (3, 1): (0, "MM"), (4, 0): (9, "MMD"), (4, 1): (0, "MM")}
    assert all(len(r.pile) == 200 for r in signals.column_rows(signals.padded_pile(reads, 10)).collect())


def test_clip_target(spark):
    df = spark.createDataFrame([(1000, 1300, True), (1000, 700, False), (0, 10**6, True)], "a bigint, m bigint, r boolean")
    got = [tuple(x[0]) for x in df.select(signals.clip_target(F.col("a"), F.col("m"), F.col("r"))).collect()]
    assert got == [(1000, 1550), (600, 1000), (0, 50_000)]


def test_segments_ties(spark):
    flat = spark.createDataFrame([("c", i, 5.0) for i in range(50)], "contig string, pos bigint, value double")
    assert [tuple(r) for r in sequential.segments(flat).collect()] == [("c", 0, 49, 50, 5.0)]
    step = spark.createDataFrame([("c", i, float(40 <= i < 60)) for i in range(100)], "contig string, pos bigint, value double")
    assert [(r["first"], r["last"], r.mid) for r in sequential.segments(step).collect()] == [(0, 39, 0.0), (40, 59, 1.0), (60, 99, 0.0)]


def test_images():
    data = sinks.contact_sheet(np.full((20, 256, 50), 7, np.uint8))
    width, height = struct.unpack(">II", data[16:24])
    at = data.index(b"IDAT")
    size = struct.unpack(">I", data[at - 4 : at])[0]
    raw = np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + size]), np.uint8).reshape(height, width + 1)[:, 1:]
    assert (height, width) == (512, 640) and raw[0, 0] == 7 and raw[0, 60] == 0 and (raw == 7).sum() == 20 * 128 * 50


def test_stage_and_jobs(spark, tmp_path):
    path = f"file://{tmp_path}/stage"
    made = []
    build = lambda: made.append(1) or spark.range(3)
    assert sinks.stage(spark, path, build).count() == 3 and sinks.stage(spark, path, build).count() == 3 and len(made) == 1
    sinks.stage(spark, path, build, again=True)
    assert len(made) == 2
    jobs = spark.createDataFrame([("a", "cached", "x"), ("b", "assemble", "x")], "region string, status string, job string")
    assert [tuple(r) for r in sinks.run_jobs(jobs, "no-such-tool").collect()] == [("a", "cached"), ("b", "no tool")]
    assert dict(tuple(r) for r in sinks.run_jobs(jobs, "true").collect())["b"] == "assembled"
    assert dict(tuple(r) for r in sinks.run_jobs(jobs, "false").collect())["b"] == "failed"


def test_master_var(spark):
    cells = ["1", "2", "chr1", "99", "101", "het", "snp", "A", "C", "A", "30", "20"] + [""] * 9 + ["7", "5", "", "12"]
    rows = ["\t".join(cells), "\t".join([*cells[:7], "A", "CC", "?", *cells[10:]]), "#" + "\t".join(cells), "\t".join([*cells[:6], "ref", *cells[7:]])]
    got = [tuple(r) for r in formats.master_var(spark.createDataFrame([(r,) for r in rows], "value string")).collect()]
    assert got == [("chr1", 100, "A", "C", 30, "DP=12;CGDP2=5,7", "0/1", 20), ("chr1", 100, "NA", "NCC", 30, "DP=12;CGDP2=0,7", "./.", 20)]


def test_restore_and_sequences(spark):
    assert models.restore({"module.model.a": 1, "b": 2, "module.c": 3}, ["a", "b", "d"]) == ({"a": 1, "b": 2}, ["d"])
    df = spark.createDataFrame([(1, [0.5]), (2, [1.0] * 30), (3, [])], "key bigint, values array<double>")
    got = models.score_sequences(df).collect()
    assert len(got) == 80 and all(abs(r.p0 + r.p1 + r.p2 - 1) < 1e-9 for r in got)


def test_pile_is_not_pushed_down(spark):
    """No filter stands over text that is built below it, which would build it twice."""
    reads = spark.createDataFrame([("c", 1, 3, "2M1I3M")], "contig string, qname bigint, ref_start bigint, cigar string")
    df = signals.padded_pile(reads, 10)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "rpad" in x] and df.count() == 1
