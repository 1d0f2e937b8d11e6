"""Evidence, calls and running values on hand-computed cases and against plain Python."""

import numpy as np
from pyspark.sql import functions as F

from readlake.functions import reads as fn, text, variants as vf
from readlake.operators import calls, evidence, intervals as iv, pileup, sequential as seq, windows as win
from readlake.sources import formats as fmt, sinks

READ = "contig string, qname bigint, flag int, ref_start bigint, ref_end bigint, mapq int, tlen bigint, mate_contig string, mate_start bigint, cigar string, md string, nm int, query_len int, clip_seq string"


def _reads(spark, rows):
    base = {"contig": "c", "qname": 1, "flag": 3, "ref_start": 0, "ref_end": 10, "mapq": 60, "tlen": 300, "mate_contig": "c", "mate_start": 500, "cigar": "10M", "md": "10", "nm": 0, "query_len": 10, "clip_seq": ""}
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], READ)


def _calls(spark, rows):
    return spark.createDataFrame(rows, "call_id bigint, contig string, start_pos bigint, end_pos bigint, svtype string")


def test_raw_support(spark):
    reads = _reads(spark, [{"qname": i, "ref_start": 90, "ref_end": 130, "cigar": "10M20D10M", "md": "10^" + "A" * 20 + "10"} for i in range(3)] + [{"ref_start": 100, "ref_end": 110, "cigar": "9S10M", "flag": f} for f in (3, 4 + 3, 1024 + 3)])
    r = evidence.raw_support(_calls(spark, [(1, "c", 95, 125, "DEL"), (2, "d", 0, 50, "INS")]), reads).orderBy("call_id").collect()
    # Twenty deleted positions of thirty have 3, and ten have 0: their 33rd percentile is 0.33 * 29 = 9.57, so between 0 and 3.
    assert [(x.call_id, round(x.support, 6), x.reads) for x in r] == [(1, 0.65 * 20, 4), (2, 0.0, 0)]


def test_pair_support_and_few_pairs(spark):
    reads = _reads(spark, [{"qname": 1, "tlen": 5000}, {"qname": 1, "ref_start": 5, "tlen": 300}, {"qname": 2, "tlen": -10, "mate_start": 900}, {"qname": 3, "mapq": 8}, {"qname": 4, "mate_start": 0}])
    assert [round(x, 1) for x in evidence.library_stats(reads).first()] == [557.0, 154.6, 148.0]
    got = {x.call_id: (round(x.abnormal, 6), x.total) for x in evidence.pair_support(_calls(spark, [(1, "c", 0, 100, "DEL"), (2, "c", 0, 100, "INS"), (3, "c", 5000, 5100, "DEL")]), reads).collect()}
    assert got == {1: (1.8, 2), 2: (1.8, 2), 3: (0.0, 0)}


def test_assembly(spark):
    reads = _reads(spark, [{"qname": 1, "ref_start": 950, "ref_end": 1300, "cigar": "50M100D200M", "nm": 100}, {"qname": 2, "ref_start": 0, "ref_end": 2000, "cigar": "2000M"}])
    got = {x.call_id: (x.status, x.new_start, x.new_len) for x in evidence.assembly(_calls(spark, [(1, "c", 1000, 1100, "DEL"), (2, "c", 1000, 1100, "INS"), (3, "x", 0, 9, "DEL")]), reads).collect()}
    assert got == {1: ("VERIFIED", 1000, 100), 2: ("REF", None, None), 3: ("AMBIGUOUS", None, None)}
    sure = _reads(spark, [{"qname": i, "ref_start": 950, "ref_end": 1300, "cigar": "50M100D200M", "md": "50^" + "A" * 100 + "200"} for i in range(3)])
    kept = evidence.validate(_calls(spark, [(1, "c", 900, 1250, "DEL")]), sure).first()
    assert tuple(kept) == (1, True, 1000, 1100)


def test_evidence_without_pairs_is_that_of_the_joins(spark):
    rng = np.random.default_rng(1)
    pick = lambda *x: x[rng.integers(len(x))]

    def read():
        start, a, b = int(rng.integers(0, 40000)), int(rng.integers(5, 60)), int(rng.integers(1, 60))
        cigar, md, n = pick((f"{a}M{b}D{a}M", f"{a}^{'A' * b}{a}", 2 * a + b), (f"{b}S{a}M", f"{a}", a), (f"{a}M{b}S", f"{a}", a), (f"{a}M{b}I{a}M", f"{2 * a}", 2 * a),
                            (f"{a}M{b}I3P9I{a}M{b}D4M{b}H", f"{2 * a}^{'C' * b}4", 2 * a + b + 4), ("2000M", "2000", 2000), (None, "9^AAA9", 20), ("3S400M12D400M20S", None, 812))
        end = pick(*[start + n] * 30, None, start - 20)
        return {"contig": pick("c", "d"), "qname": pick(None, *rng.integers(0, 500, 40).tolist()), "flag": pick(1, 3, 3, 3, 35, 5, 1025, 9, 0, None), "ref_start": pick(*[start] * 50, None), "ref_end": end, "mapq": int(rng.integers(5, 20)),
                "tlen": pick(0, 100, 300, -300, 5000, 900, 320, 310, 330), "mate_start": start + int(rng.integers(-50, 500)), "cigar": cigar, "md": md, "nm": pick(None, *range(30)), "query_len": 100}

    def call(i):
        start = int(rng.integers(0, 42000))
        return (i, pick("c", "d", "e"), start, start + pick(0, 1, 2, 50, 200, 200, 900, 5000, 9000, -30, -3000), pick("DEL", "INS", "DUP"))

    whole = [{"contig": "f", "qname": i, "ref_end": 2000, "cigar": "2000M", "nm": n} for i, n in enumerate((0, 190, 191, 300, None, 0))]
    reads = _reads(spark, [*(read() for _ in range(1500)), *whole]).cache()
    at = _calls(spark, [*map(call, range(120)), (120, None, 5, 50, "DEL"), (121, "c", None, 50, "INS"), (122, "f", 900, 1000, "DEL"), (123, "f", 0, 1000, "DEL")]).cache()
    told = lambda df: {r.call_id: (round(r.support, 6), r.reads, round(r.abnormal, 6), r.total, r.status, r.new_start, r.new_len) for r in df.collect()}
    want = told(at.join(evidence.raw_support(at, reads), "call_id").join(evidence.pair_support(at, reads), "call_id").join(evidence.assembly(at, reads), "call_id"))
    assert told(evidence.together(at, reads)) == want and len(want) == 124 and len({x[4] for x in want.values()}) == 3
    # Short calls make no pairs with reads.
    assert "_bin" not in evidence.validate(at.filter("end_pos - start_pos between 0 and 5000"), reads)._jdf.queryExecution().toString()


def test_staged(spark):
    rows = [([1] * 5, [1] * 6, [1] * 7), ([1], [1] * 4, [1] * 7), ([], [1], [1] * 7)]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>, c array<int>")
    assert [len(r[0]) for r in df.select(evidence.staged([F.col(c) for c in "abc"])).collect()] == [5, 5, 8]


def test_split_lengths(spark):
    rng = np.random.default_rng(11)
    ref = "".join(rng.choice(list("acgt"), 4000))
    chunks = spark.createDataFrame([("c", i, ref[i * 50 : i * 50 + 50]) for i in range(80)], "contig string, chunk_id bigint, seq string")
    # Right clips at 1000 go on at 1400: 400 bases are gone. Left clips at 1400 end at 1000.
    right = [{"qname": i, "ref_start": 960 + i, "ref_end": 1000, "cigar": f"{40 - i}M20S", "clip_seq": ref[1400:1420].upper(), "mate_start": 1700, "query_len": 60} for i in range(4)]
    left = [{"qname": 9, "ref_start": 1400, "ref_end": 1440, "cigar": "20S40M", "clip_seq": ref[980:1000], "mate_start": 700, "query_len": 60}]
    far = [{"qname": 10 + i, "ref_start": 960, "ref_end": 1000, "cigar": "40M20S", "clip_seq": ref[1500:1520], "mate_start": 1700, "query_len": 60, "flag": f, "mate_contig": m} for i, (f, m) in enumerate([(1, "c"), (3, "d"), (1027, "c"), (7, "c")])]
    at = _calls(spark, [(1, "c", 1000, 1350, "DEL"), (2, "c", 1000, 1350, "INS"), (3, "c", 3500, 3600, "DEL")])
    got = evidence.split_lengths(at, _reads(spark, [*right, *left, *far]), chunks, 50).collect()
    assert [tuple(r) for r in got] == [(1, 400)]


def test_alignments_in_one_text():
    rng = np.random.default_rng(3)
    for letters in ("ab", "acg", "acgt"):
        text = "".join(rng.choice(list(letters), 3000))
        first = rng.integers(0, 2900, 150)
        past = first + rng.integers(1, 90, 150)
        # Words of chance, and of the text with a gap on either side.
        clips = [["".join(rng.choice(list(letters), rng.integers(0, 20))), t[3:15] + t[19:33], t[3:15] + "zz" + t[15:28]][i % 3] for i, t in enumerate(text[a:z] for a, z in zip(first, past, strict=True))]
        got = seq.alignments_in(np.array([ord(x) for x in text]), first, past, clips)
        want = seq.local_alignments(clips, [text[a:z] for a, z in zip(first, past, strict=True)])
        assert (got == np.where(want[:, :1] > 0, want, 0)).all()


def test_pair_length(spark):
    reads = _reads(spark, [{"qname": i, "tlen": 300 + i % 3} for i in range(30)] + [{"qname": 50 + i, "tlen": t, "flag": 1} for i, t in enumerate((1300, 1400, 1500))])
    got = evidence.pair_length(_calls(spark, [(1, "c", 50, 900, "DEL"), (2, "c", 50, 900, "INS"), (3, "c", 5000, 5100, "DEL")]), reads).collect()
    assert [tuple(r) for r in got] == [(1, 1099)]


def test_soft_clip(spark):
    df = spark.createDataFrame([("4M6S", "AAAACCCCCC"), ("7S3M", "CCCCCCCAAA"), ("7S3M5S", "CCCCCCCAAATTTTT"), ("4S6M", "CCCCAAAAAA"), ("10M", "A" * 10)], "cigar string, seq string")
    got = [None if r[0] is None else tuple(r[0]) for r in df.select(fn.soft_clip("cigar", F.lit(100), F.lit(110), "seq")).collect()]
    assert got == [("right", 6, 110, "CCCCCC"), ("left", 7, 100, "CCCCCCC"), ("right", 5, 110, "TTTTT"), None, None]


def test_atoms_by_cigar(spark):
    rows = [("ACGT", "AGGTT", "1M1X2M1I"), ("ACGT", "AT", "1M2D1M"), ("A", "G", "1X"), ("AC", "GT", None), ("ACC", "A", None), ("A", "ATT", None), ("GCA", "TCAA", None)]
    df = spark.createDataFrame(rows, "ref string, alt string, cigar string")
    got = [[tuple(x) for x in r[0]] for r in df.select(vf.atoms(F.col("ref"), F.col("alt"), F.lit(10), F.col("cigar"))).collect()]
    assert got == [[(1, 11, 0, ""), (3, 14, 1, "T")], [(4, 11, -2, "CG")], [(0, 10, 0, "")], [(0, 10, 0, ""), (0, 11, 0, "")], [(4, 11, -2, "CC")], [(3, 11, 2, "TT")], [(3, 10, 1, "T"), (1, 10, 0, ""), (1, 11, 0, "")]]


def test_depths(spark):
    rows = [("DP=9;DP4=1,2,3,4", "GT", "0/1"), ("CGDP2=5,6", "GT:ADF:ADR", "0/1:1,2:3,4"), ("CGDP2=5,6", "GT:AD", "0/1:9,9"), ("NF=1,5;NR=2,1;TCF=3;TCR=9", "GT", "0/1"), ("DP=7", "GT:DP", "0/1:8"), (".", "GT", "0/1"), ("DP=3", "GT:AD", "0/1:4,1,2")]
    df = spark.createDataFrame(rows, "info string, format string, sample string")
    got = [(r._depth, r._ref, r._alt) for r in vf.with_depths(df).collect()]
    # Of NF to TCR the second allele has most reads; the reference's forward count would be -2 and is 0.
    assert got == [(10, 3, 7), (10, 4, 6), (11, 5, 6), (14, 8, 6), (8, None, None), (-1, None, None), (7, 4, 3)]


def test_half_calls(spark):
    rows = [("c", 1, "AC", "A", "./1"), ("c", 2, "C", "T", "1/."), ("c", 9, "A", "C", "./1"), ("c", 20, "G", "C", "./1"), ("c", 20, "GT", "G", ".|1"), ("c", 21, "T", "A", "1|."), ("d", 1, "A", "C", "./1"), ("d", 1, "A", "G", "0/1"), ("e", 5, "ACGT", "A", "./1"), ("e", 6, "C", "G", "./1")]
    got = sorted(tuple(r) for r in calls.merge_half_calls(spark.createDataFrame(rows, "contig string, pos bigint, ref string, alt string, gt string")).collect())
    assert got == [("c", 1, "AC", "A,AT", "1/2"), ("c", 9, "A", "C", "./1"), ("c", 20, "GT", "CT,G", "1/2"), ("c", 21, "T", "A", "1|."), ("d", 1, "A", "C", "./1"), ("d", 1, "A", "G", "0/1"), ("e", 5, "ACGT", "A,AGGT", "1/2")]


def test_fisher_tails():
    two, left, right = vf.fisher_tests([3, 0, 8], [1, 0, 2], [1, 0, 1], [3, 0, 5])
    assert np.allclose(two, [0.485714, 1, 0.034965], atol=1e-6) and np.allclose(left, [0.985714, 1, 0.999126], atol=1e-6) and np.allclose(right, [0.242857, 1, 0.024476], atol=1e-6)


def test_islands_and_depth_over_stretches(spark):
    rng = np.random.default_rng(2)
    starts = np.sort(rng.integers(0, 5 * iv.SPAN, 400))
    rows = [("c", int(s), int(s + n)) for s, n in zip(starts, rng.integers(1, 2500, 400), strict=True)] + [("c", 10, 3 * iv.SPAN), ("d", 5, 6)]
    df = spark.createDataFrame(rows, "contig string, start_pos bigint, end_pos bigint")
    want = []
    for c, s, e in sorted(rows):
        if want and want[-1][0] == c and s < want[-1][2]:
            want[-1][2] = max(want[-1][2], e)
        else:
            want.append([c, s, e])
    assert sorted((r.contig, r.start_pos, r.end_pos) for r in iv.merge(df).collect()) == [tuple(w) for w in want]
    count = np.zeros(6 * iv.SPAN + 3000, int)
    for c, s, e in rows:
        if c == "c":
            count[s:e] += 1
    got = pileup.depth(df.withColumnsRenamed({"start_pos": "ref_start", "end_pos": "ref_end"})).filter("contig = 'c'").toPandas()
    assert len(got) == (count > 0).sum() and (count[got.pos] == got.depth).all()


def test_top_share_is_exact(spark):
    rng = np.random.default_rng(4)
    for v in (rng.normal(size=5000), rng.integers(0, 4, 3000).astype(float), np.array([1.0]), np.array([1.0, 2.0])):
        df = spark.createDataFrame([(float(x),) for x in v], "v double")
        for share in (0.9, 0.33, 0.0, 1.0):
            assert win.top_share(df, "v", share).count() == (v >= np.quantile(v, share)).sum()


def test_smooth_of_short_rows(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 1.0), ("b", 1, 3.0)], "k string, i int, v double")
    k = win.gaussian(0.6)
    got = {(r.k, r.i): r.s for r in df.withColumn("s", win.smooth(df, ["k"], "i", "v", 0.6)).collect()}
    assert abs(got["a", 0] - 1) < 1e-9 and abs(got["b", 0] - (k[0] * 1 + k[1] * (1 + 3) + k[2] * (3 + 3))) < 1e-9


def test_names_and_numbers(spark):
    r = spark.range(1).select(text.duration_text(F.lit(93784)).alias("a"), text.duration_text(F.lit(None).cast("double")).alias("b"), text.size_text(F.lit(5 << 40)).alias("c"), text.comma_count(F.lit(1234.5)).alias("d"), text.rate_text(F.lit(-1.0)).alias("e"), text.compact_count(F.lit(2.5)).alias("f")).first()
    assert tuple(r) == ("1d 02h", "n/a", "5.0TB", "1,234.50", None, "2.5")
    plain = fmt.resolve_contigs(spark.createDataFrame([("chr2",), ("7",)], "name string"), spark.createDataFrame([("2",), ("7",)], "contig string")).orderBy("name").collect()
    assert [(x.listed, x.as_listed) for x in plain] == [("7", "7"), ("2", "2")]


def test_sinks(spark, tmp_path):
    empty = spark.createDataFrame([], "chr string, position bigint")
    sinks.write_csv(empty, f"file://{tmp_path}/empty")
    assert [f.read_text() for f in (tmp_path / "empty").glob("*.csv")] == ["chr,position\n"]
    sinks.write_batches(spark.range(250).withColumn("c", F.lit("x")), f"file://{tmp_path}/batches", "c", "id")
    assert sorted(r["count"] for r in spark.read.parquet(f"file://{tmp_path}/batches").groupBy("batch").count().collect()) == [50, 100, 100]
    assert sinks.locate(spark, [f"file://{tmp_path}/none"], {"a"}) is None


def test_alignment_is_used_where_text_is_short():
    assert [tuple(x) for x in seq.local_alignments(["acgt"], [""])] == [(0, 0, 0)]
