"""Hand-computed cases of rules that are easy to get wrong."""

import json

import numpy as np
from pyspark.sql import functions as F

from readlake.functions import reads as fn, variants as vf
from readlake.operators import decide, intervals as iv, pileup, sequential as seq, stats, windows as win
from readlake.sources import formats as fmt
from readlake.streaming import windows as st


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_cigar_walk(spark):
    r = one(spark, s=fn.cigar_walk(F.lit("5S10M3D7M2I4M"), F.lit(100)), ref=fn.span(F.lit("5S10M3D7M2I4M"), "MDN=X"))
    assert [(x.op, x.n, x.ref_pos) for x in r.s] == [("S", 5, 100), ("M", 10, 100), ("D", 3, 110), ("M", 7, 113), ("I", 2, 120), ("M", 4, 120)]
    assert r.s[1].read_pos == 5 and 100 + r.ref == 124


def test_md_walk(spark):
    assert [(x.kind, x.pos) for x in one(spark, s=fn.md_walk(F.lit("3A2^CG4T1"), F.lit(0))).s] == [("X", 3), ("D", 6), ("D", 7), ("X", 12)]


def test_scalars(spark):
    r = one(spark, a=fn.nearest_int(F.lit(2.5)), b=fn.nearest_int(F.lit(2.6)), c=fn.signed_log(F.lit(0.0)), k=fn.contig_key(F.lit("chrX")), o=fn.contig_key(F.lit("chr7")), z=fn.contig_key(F.lit("un_1")))
    assert (r.a, r.b, r.c, r.k, r.o, r.z) == (2, 3, 0.0, 23, 7, 999)


def test_merge_keeps_touching_apart(spark):
    df = spark.createDataFrame([("c", 0, 10), ("c", 10, 20), ("c", 15, 30)], "contig string, start_pos bigint, end_pos bigint")
    assert sorted((r.start_pos, r.end_pos) for r in iv.merge(df).collect()) == [(0, 10), (10, 30)]


def test_label_masks(spark):
    a = spark.createDataFrame([("c", 0, 10), ("c", 12, 20)], "contig string, start_pos bigint, end_pos bigint")
    b = spark.createDataFrame([("c", 5, 12)], "contig string, start_pos bigint, end_pos bigint")
    assert sorted(tuple(r) for r in iv.label_masks([a, b]).collect()) == [(1, 1, 8), (2, 0, 0), (3, 1, 12)]


def test_overlap_join_over_bins(spark):
    a = spark.createDataFrame([("c", 0, 5000), ("c", 1023, 1025)], "contig string, start_pos bigint, end_pos bigint")
    b = spark.createDataFrame([("c", 1000, 3000), ("d", 0, 9), ("c", 1025, 1026)], "contig string, start_pos bigint, end_pos bigint")
    got = sorted((r.start_pos, r.start_pos_b) for r in iv.overlap_join(a, b).collect())
    assert got == [(0, 1000), (0, 1025), (1023, 1000)]
    assert iv.overlap_join(a, b, "anti").count() == 0


def test_depth_cap(spark):
    reads = spark.createDataFrame([("c", 10, 20, "2S10M", "10", i) for i in range(3)], "contig string, ref_start bigint, ref_end bigint, cigar string, md string, id int")
    r = pileup.site_channels(reads, ["id"], 2).filter("pos = 10").first()
    assert (r.clips, r.depth) == (2, 3)


def test_deletion_mean(spark):
    reads = spark.createDataFrame([("c", 0, 10, "4M2D4M", "4^AC4", 1)], "contig string, ref_start bigint, ref_end bigint, cigar string, md string, id int")
    s = {r.pos: r for r in pileup.ratios(pileup.site_channels(reads, ["id"], 5)).collect()}
    assert s[4].del_mean == 2 and s[4].del_max == 2 and s[4].deleted == 1 and s[5].deleted == 1


def test_consensus(spark):
    rows = [("a", v) for v in (100, 102, 104, 150)] + [("b", v) for v in (100, 200, 300, 400)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    assert [(r.k, r.mid) for r in stats.largest_cluster(df, ["k"], "v", 3).collect()] == [("a", 102.0)]


def test_verdict(spark):
    rows = [("AMBIGUOUS", 3, 60, 2, 40), ("VERIFIED", 0, 10, 0, 5), ("REF", 5, 50, 0, 1)]
    df = spark.createDataFrame(rows, "s string, a bigint, b bigint, c bigint, d bigint")
    assert [r[0] for r in df.select(decide.verdict(*[F.col(c) for c in "sabcd"])).collect()] == [True, False, True]


def test_genotype_index(spark):
    r = one(spark, a=vf.genotype_index(F.lit(0), F.lit(2)), b=vf.genotype_index(F.lit(1), F.lit(1)), p=vf.genotype_index(F.lit(0), F.lit(2), True), q=vf.genotype_index(F.lit(1), F.lit(1), True))
    assert (r.a, r.b, r.p, r.q) == (3, 2, 2, 2)


def test_fisher():
    assert abs(vf.fisher(3, 1, 1, 3) - 0.485714) < 1e-6 and vf.fisher(0, 0, 0, 0) == 1.0


def test_kernel_sizes():
    assert [len(win.gaussian(s)) for s in (0.6, 0.3)] == [3, 2]


def test_drop_overlaps(spark):
    df = spark.createDataFrame([("c", 0, 10, 5), ("c", 5, 15, 9), ("c", 12, 20, 9), ("c", 30, 31, 1)], "contig string, start_pos bigint, end_pos bigint, qual bigint")
    assert sorted(r.start_pos for r in seq.drop_overlaps(df).collect()) == [5, 30]


def test_clusters(spark):
    rows = [("c", p, s, -1) for p, s in ((0, 100), (50, 110), (60, -100), (120, 105), (900, 100))]
    got = seq.cluster_signals(spark.createDataFrame(rows, "contig string, pos bigint, size bigint, split bigint")).collect()
    assert sorted((r.pos, r["size"], r.support) for r in got) == [(50, 105, 3), (60, -100, 1), (900, 100, 1)]


def test_segments_and_alignment(spark):
    rows = [("c", i, 51.0 if 100 <= i < 140 else 1.0) for i in range(200)]
    got = seq.segments(spark.createDataFrame(rows, "contig string, pos bigint, value double"), window=60).collect()
    assert (100, 139) in {(r["first"], r["last"]) for r in got}
    assert seq.local_alignment("ACGT", "TTACGTTT") == (8, 2, 6)


def test_formats(spark, tmp_path):
    sam = "@SQ\tSN:chr1\tLN:99\nr1\t16\tchr1\t11\t60\t2S5M1D3M\t=\t31\t40\tACGTACGTAC\t*\tMD:Z:5^A3\tSA:Z:chr1,50,-,9M,60,0;\tNM:i:1\n"
    (tmp_path / "a.sam").write_text(sam)
    r = fmt.read_sam(spark, str(tmp_path / "a.sam")).first()
    assert (r.ref_start, r.ref_end, r.md, r.nm) == (10, 19, "5^A3", 1)
    assert fmt.supplementary(fmt.read_sam(spark, str(tmp_path / "a.sam"))).first().sa_pos == 50
    assert fmt.header_contigs(spark.read.text(str(tmp_path / "a.sam"))).first().length == 99
    (tmp_path / "c.csv").write_text("chr,position,score\nchr1,0,1\nchr1,1000,1\n,5,1\n")
    assert [tuple(x) for x in fmt.read_candidates(spark, str(tmp_path / "c.csv")).collect()] == [("chr1", 1000, 2000)]
    (tmp_path / "d.csv").write_text("chrom,start,end\nchr1,5,9\n")
    assert [tuple(x) for x in fmt.read_candidates(spark, str(tmp_path / "d.csv")).collect()] == [("chr1", 5, 9)]
    (tmp_path / "b.bed").write_text("chr1\t5\t9\n")
    assert fmt.read_intervals(spark, str(tmp_path / "b.bed")).first().end_pos == 9
    (tmp_path / "f.fa").write_text(">c1 x\nACGT\nAC\n>c2\nTT\n")
    assert sorted(tuple(x) for x in fmt.read_fasta(spark, str(tmp_path / "f.fa"), 4).collect()) == [("c1", 0, "ACGT"), ("c1", 1, "AC"), ("c2", 0, "TT")]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.select("ts", "event_type").write.parquet(str(tmp_path / "in"))
    live = st.hourly(st.stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema))
    got = st.run_to_memory(live, "hours", str(tmp_path / "check"))
    assert got.agg(F.sum("n")).first()[0] == events.count() and got.count() == st.hourly(events).count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    json.dumps(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_alignments_of_many_pairs():
    rng = np.random.default_rng(7)
    text = lambda most: "".join(rng.choice(list("acgé"), rng.integers(0, most)))
    a, b = [text(14) for _ in range(300)], [text(40) for _ in range(300)]
    for costs in ({}, {"gap_open": -2}, {"mismatch": 0, "gap_open": -1}):
        assert [tuple(r) for r in seq.local_alignments(a, b, **costs)] == [seq.local_alignment(x, y, **costs) for x, y in zip(a, b, strict=True)]


def test_alignment_of_all_chunks(spark):
    from readlake.plans import registry
    from readlake.sources.views import table

    sf = "/root/testdata/sf0.001"
    got = registry.QUERIES["fn_05_local_alignment"](spark, sf).collect()
    assert len(got) == table(spark, sf, "part").count()
    assert all((r.score, r.hit_start, r.hit_end) == seq.local_alignment(r.clip, r.seq) for r in got)


def test_site_channels_by_block(spark):
    """Against a count read by read: blocks that reads cross, texts that go beyond a read's end, places at a depth beyond the cap,
    equal reads (each counts by itself), and a read without a contig, a place or texts."""
    import random

    rng = random.Random(3)
    rows = [("a", i // 2, s := rng.randrange(90), s + 2 * m + d, f"2S{m}M{d}D1I{m}M3S", f"{m - 1}C^{'A' * d}{m}") for i in range(160) for m, d in [(rng.randrange(1, 9), rng.randrange(1, 5))]]
    rows += [("a", 200, 40, 44, "4M", "2")] * 3 + [("a", 201, 10, 12, "2M30D", "40A"), (None, 1, 5, 9, "4M2S", "1G2"), ("a", 2, None, 9, "4M1S", "1G2"), ("a", 3, 50, 54, None, "1G2"), ("b", 4, 7, 9, "2M1S", None)]
    reads = spark.createDataFrame(rows, "contig string, id int, ref_start int, ref_end bigint, cigar string, md string")
    order, cap = ["id", "ref_start", "ref_end", "cigar", "md"], 6
    events = {(r.contig, r.id, r.ref_start, r.ref_end, r.cigar, r.md): [] for r in reads.collect()}
    for r in pileup.signals(reads.withColumn("_rank", F.struct("contig", *order))).collect():
        events[tuple(r["_rank"])].append((r.kind, r.pos, r["size"]))
    single = {k: v[: len(v) // rows.count(k)] for k, v in events.items()}
    ranked, want = sorted(rows, key=lambda r: [(x is not None, x) for x in r[1:]]), {}
    covers = lambda r, c, p: None not in (r[0], r[2], p) and r[0] == c and r[2] <= p < r[3]
    for i, r in enumerate(ranked):
        for kind, pos, size in single[r]:
            if sum(covers(x, r[0], pos) for x in ranked[:i]) < cap:
                want.setdefault((r[0], pos), []).append((kind, size))
    of = lambda v, k: [s for kind, s in v if kind == k]
    want = {k: (*[len(of(v, x)) for x in "XBCI"], sum(of(v, "I")), max(of(v, "I"), default=0), sum(of(v, "D")), max(of(v, "D"), default=0), sum(covers(x, *k) for x in rows)) for k, v in want.items()}
    assert max(v[-1] for v in want.values()) > 2 * cap
    for block in (4, 7, pileup.BLOCK):
        df = pileup.site_channels(reads, order, cap, block)
        assert {(r.contig, r.pos): tuple(r)[2:] for r in df.collect()} == want
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_score_sites(spark):
    """Scores from counts in place are those of collected windows."""
    from readlake.operators import models, networks

    rows = [("a" if i % 3 else None, i, 700 * (i % 19), 700 * (i % 19) + 9, "3S4M1D4M", "4^A2C1") for i in range(90)]
    reads = spark.createDataFrame(rows, "contig string, id int, ref_start bigint, ref_end bigint, cigar string, md string")
    net, mean = networks.WindowNet.initial(filters=4, dense=8, reduction=2), [1.0, 2.0, 0.5] * 3
    got = {tuple(r)[:2]: r.score for r in pileup.score_sites(reads, ["id"], 3, net, mean).collect()}
    want = {tuple(r)[:2]: r.score for r in models.score_channels(pileup.channel_windows(pileup.ratios(pileup.site_channels(reads, ["id"], 3))), net, mean).collect()}
    assert len(got) > 20 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_clusters_of_a_dense_contig(spark):
    """Against the rounds one by one, on a contig without gaps whose clusters are longer than a stretch, and on sparse ones."""
    import random

    rng = random.Random(5)
    rows = [("a", p, rng.choice([1, -1]) * rng.randrange(0, 90) * 10, rng.choice([-1, -1, rng.randrange(300)])) for p in range(0, 60_000, 60)]
    rows += [("a", p, 5000 + p % 7, -1) for p in range(0, 60_000, 150)]
    rows += [("b", rng.randrange(400_000), rng.choice([1, -1]) * rng.randrange(100, 900), rng.choice([-1, rng.randrange(40)])) for _ in range(600)] + [(None, 5, 9, 1), (None, 6, 9, 2)]
    want = []
    for contig in ("a", "b", None):
        queue, found = sorted(r[1:] for r in rows if r[0] == contig), []
        while queue:
            members, left = [queue[0]], []
            for i, x in enumerate(queue[1:], 1):
                last = members[-1]
                if x[0] - last[0] > 200:
                    left += queue[i:]
                    break
                (members if (x[1] > 0) == (last[1] > 0) and min(abs(x[1]), abs(last[1])) > 0.7 * max(abs(x[1]), abs(last[1])) else left).append(x)
            found.append(members)
            queue = left
        taken = set()
        at = lambda m: (m[len(m) // 2][0], sorted(x[1] for x in m)[len(m) // 2])
        for m in sorted(found, key=lambda m: (-len(m), m[0][0], *at(m))):
            own = {x[2] for x in m} - {-1}
            want.append((str(contig), *at(m), len(m) - len(own & taken)))
            taken |= own
    got = seq.cluster_signals(spark.createDataFrame(rows, "contig string, pos int, size bigint, split bigint")).collect()
    assert sorted((str(r.contig), r.pos, r["size"], r.support) for r in got) == sorted(want)
    assert max(w[3] for w in want) == 400


def test_long_indels_by_text(spark):
    """Texts parsed once give what the column functions give."""
    import random

    from readlake.operators import signals

    rng = random.Random(9)
    rows = [(rng.choice("ab"), i, "".join(f"{rng.randrange(1, 60)}{rng.choice('MMDDIISN=XHP')}" for _ in range(rng.randrange(1, 12)))) for i in range(300)] + [("a", 5, None)]
    reads = spark.createDataFrame(rows, "contig string, ref_start int, cigar string")
    want = sorted(tuple(r) for r in reads.select("contig", F.inline(signals.indel_signals("cigar", "ref_start"))).collect())
    assert len(want) > 200 and sorted(tuple(r) for r in signals.long_indels(reads).collect()) == want
    both = signals.with_ends(reads.withColumn("own", signals.ends("cigar"))).collect()
    assert all((r.read_start, r.read_end) == (r.own.start, r.own.end) for r in both if r.own.end is not None) and len(both) == len(rows)
