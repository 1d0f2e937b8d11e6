"""Read filters, clips, pairs and the evidence for structural calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from readlake.functions import reads as fn
from readlake.operators import decide, evidence, intervals as iv, signals
from readlake.plans.registry import query
from readlake.sources.views import view

_KEYS = "contig, qname, flag, ref_start"
_COLS = ["contig", "qname", "flag", "ref_start"]


@query(f"""select {_KEYS}, ref_start + case when shape = 3 then a else a - 1 end as pos, 'X' as kind from alignments union all
 select {_KEYS}, unnest(range(ref_start + a, ref_start + a + b)), 'D' from alignments where shape < 2""")
def prj_02_md_positions(spark, sf_dir):
    """Mismatches and deleted bases of MD text."""
    return view(spark, sf_dir, "alignments").select(*_COLS, F.inline(fn.md_walk("md", F.col("ref_start")))).select(*_COLS, "pos", "kind")


@query("""with e as (select contig, unnest(range(ref_start - k, ref_start)) as pos, 4 as code from alignments where shape = 1 union all select contig, unnest(range(ref_start + a, ref_start + a + k)), 4 from alignments where shape = 2
 union all select contig, unnest(range(ref_start + a, ref_start + least(a + b, 2 * a))), 2 from alignments where shape < 2 union all select contig, unnest(range(ref_start + a, ref_start + a + b)), 1 from alignments where shape = 3)
 select contig, pos, count(*) filter (where code = 4) as clips, floor(-sum(code) / 4.0)::BIGINT as parity from e group by contig, pos""")
def prj_14_clip_score(spark, sf_dir):
    return fn.clip_scores(view(spark, sf_dir, "alignments"))


_SEQ = "substring(repeat('ACGTTGCA', 40), 1, query_len::INT)"


@query(f"""select {_KEYS}, case shape when 2 then 'right' else 'left' end as side, k as n, case shape when 2 then ref_end else ref_start end as anchor,
 case shape when 2 then right({_SEQ}, k::INT) else left({_SEQ}, k::INT) end as clip_seq from alignments where shape in (1, 2) and k >= 5""")
def prj_18_soft_clip(spark, sf_dir):
    r = view(spark, sf_dir, "alignments").withColumn("seq", F.expr("substring(repeat('ACGTTGCA', 40), 1, cast(query_len as int))"))
    return r.withColumn("x", fn.soft_clip("cigar", "ref_start", "ref_end", "seq")).filter("x is not null").select(*_COLS, "x.side", "x.n", "x.anchor", "x.clip_seq")


@query(f"""select {_KEYS}, mapq, abs(tlen) as size from alignments where flag & 2 <> 0 and flag & 1 <> 0 and flag & 64 <> 0 and flag & 4 = 0 and flag & 8 = 0 and flag & 1024 = 0 and flag & 256 = 0 and flag & 2048 = 0
 and ((ref_start < mate_start and flag & 16 = 0 and flag & 32 <> 0) or (ref_start > mate_start and flag & 16 <> 0 and flag & 32 = 0))""")
def flt_02_proper_pairs(spark, sf_dir):
    return view(spark, sf_dir, "alignments").filter(fn.proper_inward("flag", "ref_start", "mate_start")).select(*_COLS, "mapq", F.abs("tlen").alias("size"))


@query(f"select {_KEYS}, mapq from alignments where flag & 1 <> 0 and flag & 4 = 0 and flag & 8 = 0 and flag & 1024 = 0 and mapq >= 9 and tlen <> 0 and ref_start < mate_start")
def flt_03_read_pairs(spark, sf_dir):
    return view(spark, sf_dir, "alignments").filter(fn.usable_pair("flag", "mapq", "tlen", "ref_start", "mate_start")).select(*_COLS, "mapq")


@query(f"select {_KEYS}, mapq from alignments where flag & 4 = 0 and flag & 1024 = 0 and mapq >= 20 and flag & 2 <> 0 and contig = mate_contig")
def flt_04_split_reads(spark, sf_dir):
    return view(spark, sf_dir, "alignments").filter(fn.usable_split("flag", "mapq", "contig", "mate_contig")).select(*_COLS, "mapq")


_ROBUST = "select median(size) as mid, stddev_pop(size) as sd from (select abs(tlen) as size from alignments where flag & 2 <> 0 and mapq > 20 and abs(tlen) < 2000 order by contig, ref_start, qname, flag, size limit 50000)"


@query(f"select mid::DOUBLE as mid, round(sd, 6) as sd from ({_ROBUST})")
def agg_08_robust_insert(spark, sf_dir):
    return evidence.robust_insert(view(spark, sf_dir, "alignments")).select("mid", F.round("sd", 6).alias("sd"))


_USED = "u as (select * from alignments where flag & 4 = 0 and flag & 1024 = 0)"
_LIB = """lib as (select case when n < 100 then 557.0 else m end as m, case when n < 100 then 154.6 else s end as s, case when n < 100 then 148.0 else l end as l from
 (select count(x) as n, avg(x) as m, stddev_pop(x) as s, avg(query_len) as l from (select *, case when flag & 1 <> 0 and flag & 8 = 0 and abs(tlen) > 50 and abs(tlen) < 6000 then abs(tlen) end as x from u)))"""
_RAW = """sig as (select contig, 'B' as kind, unnest(range(ref_start + a, ref_start + a + b)) as pos, 1 as size from u where shape < 2 union all select contig, 'C', case shape when 1 then ref_start else ref_end end, k from u where shape in (1, 2)
  union all select contig, 'I', ref_start + a, b from u where shape = 3),
 site as (select contig, pos, count(*) filter (where kind = 'B')::DOUBLE as gone, count(*) filter (where kind = 'C')::DOUBLE as clips, coalesce(avg(size) filter (where kind = 'I'), 0)::DOUBLE as more from sig group by 1, 2),
 pt as (select call_id, contig, svtype, unnest(range(start_pos, end_pos)) as pos from calls),
 v as (select pt.call_id, coalesce(case when svtype = 'DEL' then gone else more end, 0) as x, coalesce(clips, 0) as c from pt left join site on site.contig = pt.contig and site.pos = pt.pos),
 t as (select call_id, quantile_cont(x, 0.33) as qx, quantile_cont(c, 0.33) as qc from v group by 1),
 z as (select v.call_id, count(*) filter (where x > greatest(qx, 1)) as own, count(*) filter (where c > greatest(qc, 1)) as clips from v join t on t.call_id = v.call_id group by 1),
 raw as (select c.call_id, (0.65 * any_value(z.own) + 1.15 * any_value(z.clips))::DOUBLE as support, count(r.qname) as reads from calls c join z on z.call_id = c.call_id
  left join u r on r.contig = c.contig and r.ref_start < c.end_pos + 370 and r.ref_end > c.start_pos - 370 group by 1)"""
_PAIRS = """one as (select c.call_id, c.svtype, abs(r.tlen) as size, row_number() over (partition by c.call_id, r.qname order by r.ref_start, r.ref_end, r.tlen) as i from calls c
  join u r on r.contig = c.contig and r.ref_start < c.end_pos + 670 and r.ref_end > c.start_pos - 670 where r.flag & 1 <> 0 and r.flag & 8 = 0 and r.mapq >= 9 and r.tlen <> 0 and r.ref_start < r.mate_start),
 sums as (select call_id, sum(case when size > m + 1.95 * s then case svtype when 'DEL' then 1.0 else 0.8 end when size < m - 1.95 * s then case svtype when 'INS' then 1.0 else 0.8 end else 0 end)::DOUBLE as abnormal, count(*) as total from one, lib where i = 1 group by 1),
 rp as (select c.call_id, coalesce(abnormal, 0)::DOUBLE as abnormal, coalesce(total, 0) as total from calls c left join sums on sums.call_id = c.call_id)"""
_ASM = """near as (select c.*, r.ref_start, r.ref_end, r.qname, r.flag, r.a, r.b, r.k, r.shape, r.nm, case r.shape when 1 then r.ref_start else r.ref_end end as cp,
   case r.shape when 2 then r.a when 3 then 2 * r.a + r.b else 2 * r.a end as aligned, greatest(8, floor((c.end_pos - c.start_pos) * 0.025), floor(lib.l * 0.06)) as least, greatest(300, floor((c.end_pos - c.start_pos) * 0.2)) as slop
  from calls c join alignments r on r.contig = c.contig and r.ref_start < c.end_pos + 370 and r.ref_end > c.start_pos - 370 cross join lib where r.mapq >= 9),
 hit as (select *, (svtype = 'DEL' and shape < 2 and b >= least and (abs(ref_start + a - start_pos) < slop or abs(ref_start + a - end_pos) < slop)) or (svtype = 'INS' and shape = 3 and b >= least and abs(ref_start + a - start_pos) < slop) as indel,
   shape in (1, 2) and k >= least and (abs(cp - start_pos) < slop or abs(cp - end_pos) < slop) as clip from near),
 last as (select call_id, ref_start + a as new_start, b as new_len from (select *, row_number() over (partition by call_id order by ref_start desc, ref_end desc, qname desc, flag desc, a desc, b desc) as i from hit where indel) where i = 1),
 cnt as (select call_id, bool_or(indel or clip) as shown, count(*) filter (where not indel and not clip and nm <= aligned * 0.095 and ref_start < start_pos and ref_end > end_pos) as clean, count(*) as total from hit group by 1),
 asm as (select c.call_id, case when shown then 'VERIFIED' when clean / total::DOUBLE > 0.35 then 'REF' else 'AMBIGUOUS' end as status, last.new_start, last.new_len
  from calls c left join cnt on cnt.call_id = c.call_id left join last on last.call_id = c.call_id)"""


def _evidence(spark, sf_dir):
    return view(spark, sf_dir, "calls"), view(spark, sf_dir, "alignments")


@query(f"with {_USED}, {_RAW} select call_id, round(support, 6) as support, reads from raw")
def agg_11_raw_support(spark, sf_dir):
    return evidence.raw_support(*_evidence(spark, sf_dir)).withColumn("support", F.round("support", 6))


@query(f"with {_USED}, {_LIB}, {_PAIRS} select call_id, round(abnormal, 6) as abnormal, total from rp")
def agg_12_discordant_pairs(spark, sf_dir):
    return evidence.pair_support(*_evidence(spark, sf_dir)).withColumn("abnormal", F.round("abnormal", 6))


@query(f"with {_USED}, {_LIB}, {_ASM} select * from asm")
def agg_13_assembly_evidence(spark, sf_dir):
    return evidence.assembly(*_evidence(spark, sf_dir))


@query(f"""with {_USED}, {_LIB}, {_RAW}, {_PAIRS}, {_ASM}, e as (select c.*, asm.status, asm.new_start, asm.new_len, raw.support, rp.abnormal, coalesce(raw.support / nullif(raw.reads, 0), 0) as vaf, coalesce(rp.abnormal / nullif(rp.total, 0), 0) as ratio,
   greatest(0.065, least(0.12, 0.002 * raw.reads)) as adaptive from calls c join raw on raw.call_id = c.call_id join rp on rp.call_id = c.call_id join asm on asm.call_id = c.call_id),
 k as (select *, case status when 'VERIFIED' then not (support < 1 and abnormal < 1) when 'REF' then vaf >= 0.10 and support >= 5
   else (vaf >= adaptive and support >= 5) or (ratio >= 0.08 and abnormal >= 3) or (vaf >= 0.045 and support >= 3 and ratio >= 0.045 and abnormal >= 2) end as keep from e),
 m as (select *, coalesce(keep and status = 'VERIFIED' and abs(new_start - start_pos) < 2000 and abs(new_len - (end_pos - start_pos)) < 0.83 * (end_pos - start_pos), false) as moved from k)
 select call_id, keep, case when moved then new_start else start_pos end as start_pos, case when moved then new_start + new_len else end_pos end as end_pos from m""")
def dec_01_validated(spark, sf_dir):
    """The verdict of raw, pair and alignment evidence, and refined intervals."""
    return evidence.validate(*_evidence(spark, sf_dir))


@query("""with c as (select c.call_id, count(r.qname) filter (where r.ref_start < c.start_pos + 100 and r.ref_end > c.start_pos - 100) as n1, count(r.qname) filter (where r.ref_start < c.start_pos + 500 and r.ref_end > c.start_pos - 500) as n2, count(r.qname) as n3
  from calls c left join alignments r on r.contig = c.contig and r.ref_start < c.start_pos + 1000 and r.ref_end > c.start_pos - 1000 and r.mapq >= 45 group by 1)
 select call_id, case when n1 >= 5 then n1 when n1 + n2 >= 5 then n1 + n2 else n1 + n2 + n3 end as n, (case when n1 >= 5 then 100 when n1 + n2 >= 5 then 500 else 1000 end)::INT as radius from c""")
def lim_01_staged_radius(spark, sf_dir):
    """Radii widen until five reads are found, and inner reads count again."""
    calls, reads = _evidence(spark, sf_dir)
    near = iv.overlap_join(calls.withColumn("end_pos", F.col("start_pos")), reads.filter("mapq >= 45").select("contig", F.col("ref_start").alias("start_pos"), F.col("ref_end").alias("end_pos")), pad=1000)
    inside = lambda r: F.count_if((F.col("start_pos_b") < F.col("start_pos") + r) & (F.col("end_pos_b") > F.col("start_pos") - r))
    found = near.groupBy("call_id").agg(*[inside(r).alias(f"n{r}") for r in evidence.RADII])
    n, radius = evidence.staged_count([F.coalesce(f"n{r}", F.lit(0)) for r in evidence.RADII])
    return calls.select("call_id").join(found, "call_id", "left").select("call_id", n.cast("long").alias("n"), radius.alias("radius"))


_PAIR_LENGTH = f"""with lib as ({_ROBUST}), near as (select c.call_id, abs(r.tlen) - mid as more from calls c join alignments r on r.contig = c.contig and r.ref_start < c.start_pos + 200 and r.ref_end > c.start_pos - 200 cross join lib
  where c.svtype = 'DEL' and r.flag & 4 = 0 and r.flag & 1024 = 0 and r.mapq >= 20 and abs(r.tlen) > mid + 3 * sd) select call_id, floor(median(more))::BIGINT as dp from near where more > 50 and more < 100000 group by 1 having count(*) >= 3"""


@query(_PAIR_LENGTH)
def dec_02_pair_length(spark, sf_dir):
    return evidence.pair_length(*_evidence(spark, sf_dir))


def _clipped(spark, sf_dir):
    return view(spark, sf_dir, "alignments").withColumn("clip_seq", F.expr("substring(repeat('almondantiqueblue', 4), 1, cast(k as int))"))


@query()
def dec_02_deletion_length(spark, sf_dir):
    """Deletion lengths from aligned clips, else from pairs, else as known."""
    calls, reads = view(spark, sf_dir, "calls"), _clipped(spark, sf_dir)
    sr = evidence.split_lengths(calls, reads, view(spark, sf_dir, "chunks"), 50)
    every = calls.filter("svtype = 'DEL'").join(sr, "call_id", "left").join(evidence.pair_length(calls, reads), "call_id", "left").withColumn("known", F.col("end_pos") - F.col("start_pos"))
    return every.select("call_id", *decide.deletion_length("sr", "dp", "known"))


_INFO = "case when call_id % 3 = 0 then 'IMPRECISE;SVTYPE=' || svtype when call_id % 3 = 1 then 'SVTYPE=' || svtype || ';IMPRECISE' else 'SVTYPE=' || svtype end"


@query(f"""with r as (select call_id, call_id * 3 + 50 as length, case when call_id % 4 = 0 then 'SR' else 'DP' end as evidence from calls where call_id % 4 < 2),
 y as (select *, {_INFO} as info from calls), x as (select c.call_id, c.svtype, c.end_pos - c.start_pos as known, c.info, r.length, r.evidence from y c left join r on r.call_id = c.call_id and c.svtype = 'DEL')
 select call_id, coalesce(length, known) as length, case evidence when 'SR' then 'SVTYPE=' || svtype when 'DP' then case when contains(info, 'IMPRECISE') then info else info || ';IMPRECISE' end else info end as info from x""")
def dec_04_pass_through(spark, sf_dir):
    """Lengths that were found replace those known; IMPRECISE goes with split reads and comes with pairs."""
    calls = view(spark, sf_dir, "calls").withColumn("info", F.expr(_INFO))
    found = calls.filter("call_id % 4 < 2").select("call_id", (F.col("call_id") * 3 + 50).alias("length"), F.when(F.col("call_id") % 4 == 0, "SR").otherwise("DP").alias("evidence"))
    return decide.pass_through(calls, found).select("call_id", "length", "info")


_SPLIT = "select *, ref_end + 300 - qname % 9 * 100 as sa_start, case when qname % 2 = 0 then 0 else 16 end as sa_reverse, case shape when 0 then 2 * a when 1 then k + 2 * a when 2 then a else 2 * a + b end as read_end from alignments"


@query(f"""with s as (select *, ref_end - sa_start as ref_gap, read_end - k as read_gap from ({_SPLIT}) where flag & 16 = sa_reverse), d as (select *, ref_gap - read_gap as diff from s)
 select {_KEYS}, least(ref_end, sa_start) as pos, diff as size from d where diff < 0 and abs(read_gap) < 2000 union all
 select {_KEYS}, unnest([ref_end, sa_start]), diff from d where diff > 0 and abs(ref_gap) < 2000""")
def jn_09_split_reads(spark, sf_dir):
    """Reads with their other parts on one contig and strand, and the indels between them."""
    from readlake.sources.formats import supplementary

    part = lambda contig, at, strand: F.concat(contig, F.lit(","), (at + 1).cast("string"), F.lit(","), strand, F.lit(","), F.col("k").cast("string"), F.lit("S9M,60,0;"))
    at = F.col("ref_end") + 300 - F.col("qname") % 9 * 100
    sa = F.concat(part(F.col("contig"), at, F.when(F.col("qname") % 2 == 0, "+").otherwise("-")), part(F.lit("chrY"), at, F.lit("+")))
    s = supplementary(view(spark, sf_dir, "alignments").withColumn("sa", sa))
    own = F.when(fn.bit("flag", 16), "-").otherwise("+")
    same = s.filter((F.col("rname") == F.col("contig")) & (F.col("sa_strand") == own))
    found = signals.split_signals(F.col("ref_end"), F.col("sa_pos") - 1, signals.ends("cigar")["end"], signals.ends("sa_cigar")["start"])
    return same.select(*_COLS, F.inline(found)).select(*_COLS, "pos", "size")
