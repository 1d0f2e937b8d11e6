"""Sources, projections, filters and site aggregates of reads."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from readlake.functions import reads as fn
from readlake.operators import intervals as iv, pileup, windows as win
from readlake.plans.registry import query
from readlake.sources.views import table, view


@query("select contig, qname, ref_start, ref_end, flag from reads where contig = 'chr2' and ref_start < 9000 and ref_end > 4000")
def src_01_region_scan(spark, sf_dir):
    return pileup.overlapping(view(spark, sf_dir, "reads"), "chr2", 4000, 9000).select("contig", "qname", "ref_start", "ref_end", "flag")


@query("select qname, ref_start, ref_end, mapq, tlen from reads where mapq >= 30 order by qname, ref_start, ref_end, mapq, tlen limit 200")
def src_02_first_reads(spark, sf_dir):
    cols = ["qname", "ref_start", "ref_end", "mapq", "tlen"]
    return view(spark, sf_dir, "reads").filter("mapq >= 30").select(*cols).orderBy(*cols).limit(200)


@query("select contig, max(ref_end) as length, count(*) as mapped from reads group by contig")
def src_03_contig_statistics(spark, sf_dir):
    return view(spark, sf_dir, "reads").groupBy("contig").agg(F.max("ref_end").alias("length"), F.count("*").alias("mapped"))


@query("select contig, max(ref_end) as length from reads group by contig")
def src_04_header_contigs(spark, sf_dir):
    from readlake.sources.formats import header_contigs

    lines = view(spark, sf_dir, "reads").groupBy("contig").agg(F.max("ref_end").alias("n")).select(F.concat(F.lit("@SQ\tSN:"), "contig", F.lit("\tLN:"), F.col("n").cast("string")).alias("value"))
    return header_contigs(lines.union(spark.createDataFrame([("@HD\tVN:1.6",)], "value string")))


_COVER = "select contig, unnest(range(ref_start, ref_end)) as pos from reads"


@query(f"select contig, pos, least(count(*), 8000)::BIGINT as depth from ({_COVER} where flag & 256 = 0 and mapq >= 13) group by contig, pos")
def src_05_pileup_columns(spark, sf_dir):
    r = view(spark, sf_dir, "reads").filter("(flag & 256) = 0 and mapq >= 13")
    return pileup.depth(r, 8000)


@query("select b.contig, b.start_pos, b.end_pos, count(r.qname) as n from (select distinct contig, start_pos, end_pos from bed_b) b left join reads r on r.contig = b.contig and r.ref_start < b.end_pos and r.ref_end > b.start_pos group by all")
def src_06_region_count(spark, sf_dir):
    b = view(spark, sf_dir, "bed_b").distinct()
    r = view(spark, sf_dir, "reads").select("contig", F.col("ref_start").alias("start_pos"), F.col("ref_end").alias("end_pos"), "qname")
    n = iv.overlap_join(b, r).groupBy("contig", "start_pos", "end_pos").agg(F.count("*").alias("n"))
    return b.join(n, ["contig", "start_pos", "end_pos"], "left").select("contig", "start_pos", "end_pos", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(f"select contig, pos, count(*) as depth from ({_COVER}) group by contig, pos")
def src_07_base_coverage(spark, sf_dir):
    return pileup.depth(view(spark, sf_dir, "reads"))


@query("""with t as (select distinct contig, start_pos, end_pos from bed_a), k as (select *, unnest(range(start_pos // 50, (end_pos - 1) // 50 + 1)) as chunk_id from t),
 s as (select k.contig, k.start_pos, k.end_pos, string_agg(rpad(coalesce(c.seq, ''), 50, 'n'), '' order by k.chunk_id) as seq from k left join chunks c on c.contig = k.contig and c.chunk_id = k.chunk_id group by all)
 select contig, start_pos, end_pos, substring(seq, start_pos % 50 + 1, end_pos - start_pos) as bases from s""")
def src_08_sequence_fetch(spark, sf_dir):
    """Reference text of intervals, from a sequence that is kept in chunks."""
    from readlake.operators import signals

    at = view(spark, sf_dir, "bed_a").select("contig", F.col("start_pos").alias("first"), F.col("end_pos").alias("past")).distinct()
    return signals.fetch(at, view(spark, sf_dir, "chunks"), 50).select("contig", F.col("first").alias("start_pos"), F.col("past").alias("end_pos"), F.col("seq").alias("bases"))


@query("select chr as chrom, position as start_pos, position + 1000 as end_pos from score_windows where position > 0 and score > 5")
def src_09_candidates(spark, sf_dir):
    from readlake.sources.formats import normalise_candidates

    w = view(spark, sf_dir, "score_windows")
    raw = w.select(F.when(F.col("score") > 5, F.col("chr")).alias("chr"), F.col("position").cast("string").alias("position"), F.col("score").cast("string").alias("score"))
    return normalise_candidates(raw)



@query("select chr as contig, position as start_pos, position + 1000 as end_pos from score_windows")
def src_17_candidate_ranges(spark, sf_dir):
    return view(spark, sf_dir, "score_windows").select(F.col("chr").alias("contig"), F.col("position").alias("start_pos"), (F.col("position") + 1000).alias("end_pos"))


@query("select doc_id, sha256(text) as digest from documents")
def src_18_verified_content(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("select event_id, (props->>'$.k')::BIGINT as k from events")
def src_19_json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("select qname, ref_start, contig as rname, ref_start + 500 as sa_pos, case when flag & 16 <> 0 then '+' else '-' end as sa_strand from reads union all select qname, ref_start, 'chr9', ref_start + 7, '-' from reads")
def src_20_supplementary_tags(spark, sf_dir):
    from readlake.sources.formats import supplementary

    sa = F.concat("contig", F.lit(","), (F.col("ref_start") + 500).cast("string"), F.when(F.col("flag").bitwiseAND(16) != 0, ",+,").otherwise(",-,"), F.col("cigar"), F.lit(",60,0;chr9,"), (F.col("ref_start") + 7).cast("string"), F.lit(",-,5M,60,1;"))
    return supplementary(view(spark, sf_dir, "reads").withColumn("sa", sa)).select("qname", "ref_start", "rname", "sa_pos", "sa_strand")


_OPS = "select *, regexp_extract_all(cigar, '\\d+[MIDNSHP=X]') as ops from reads"
_LEN = "list_sum([case when x[-1:] in ({0}) then x[:-2]::BIGINT else 0 end for x in ops])::BIGINT"


@query(f"select qname, ref_start, mapq, {_LEN.format(chr(39) + 'M' + chr(39) + ',' + chr(39) + 'D' + chr(39))} as ref_len, {_LEN.format(chr(39) + 'M' + chr(39) + ',' + chr(39) + 'S' + chr(39))} as read_len from ({_OPS})")
def prj_01_cigar_spans(spark, sf_dir):
    return view(spark, sf_dir, "reads").select("qname", "ref_start", "mapq", fn.span("cigar", "MDN=X").alias("ref_len"), fn.span("cigar", "MIS=X").alias("read_len"))



@query("select qname, ref_start, case when flag & 16 <> 0 then 1 else 2 end as strand from reads")
def prj_03_strand(spark, sf_dir):
    return view(spark, sf_dir, "reads").select("qname", "ref_start", fn.strand("flag").alias("strand"))


@query("select event_id, round(ln(1 + greatest(value - 50, 0)) - ln(1 + greatest(50 - value, 0)), 6) as v from events")
def prj_04_signed_log(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(fn.signed_log(F.col("value") - 50), 6).alias("v"))


@query("select event_id, ceil(value - 0.5)::BIGINT as v from events")
def prj_05_nearest_int(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", fn.nearest_int("value").alias("v"))


@query("select contig, qname, ref_start, ref_end, mapq, tlen, row_number() over (partition by contig order by round((mapq - lo) / (hi - lo + 1e-7) + (tlen - lt) / (ht - lt + 1e-7), 9) desc, qname, ref_start, ref_end, mapq, tlen) as place from (select *, min(mapq) over w as lo, max(mapq) over w as hi, min(tlen) over w as lt, max(tlen) over w as ht from reads window w as (partition by contig))")
def prj_06_quality_order(spark, sf_dir):
    w = Window.partitionBy("contig")
    scaled = lambda c: (F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w) + 1e-7)
    r = view(spark, sf_dir, "reads").withColumn("q", F.round(scaled("mapq") + scaled("tlen"), 9))
    cols = ["contig", "qname", "ref_start", "ref_end", "mapq", "tlen"]
    return r.select(*cols, F.row_number().over(w.orderBy(F.desc("q"), "qname", "ref_start", "ref_end", "mapq", "tlen")).cast("long").alias("place"))


@query("select doc_id, coalesce(floor(255 * length(regexp_replace(seq, '[^gc]', '', 'g')) / nullif(length(seq), 0)), 0)::BIGINT as gc from texts")
def prj_07_gc_level(spark, sf_dir):
    return view(spark, sf_dir, "texts").select("doc_id", fn.gc_level("seq").alias("gc"))


@query("""select qname, ref_start, ref_end, case when (flag & 16 <> 0) = (mapq % 2 = 0) then 'LLRR' when (case when ref_start <= ref_start + tlen - 400 then flag & 16 <> 0 else mapq % 2 = 0 end) and abs(tlen - 400) > 5 then 'RL' else 'LR' end as kind from reads""")
def prj_08_pair_orientation(spark, sf_dir):
    r = view(spark, sf_dir, "reads")
    return r.select("qname", "ref_start", "ref_end", fn.pair_orientation(F.col("flag").bitwiseAND(16) != 0, F.col("mapq") % 2 == 0, "ref_start", F.col("ref_start") + F.col("tlen") - 400).alias("kind"))


@query("select r.qname, r.ref_start, r.tlen, case when tlen > m + 1.2 * s then 1 when tlen < m - 1.2 * s then 2 else 0 end as class from reads r cross join (select avg(tlen) as m, stddev_pop(tlen) * 0.6 as s from reads) x".replace("1.2", "2"))
def prj_09_insert_class(spark, sf_dir):
    r = view(spark, sf_dir, "reads")
    stats = r.agg(F.avg("tlen").alias("m"), (F.stddev_pop("tlen") * 0.6).alias("s"))
    return r.crossJoin(F.broadcast(stats)).select("qname", "ref_start", "tlen", fn.insert_class("tlen", "m", "s").alias("class"))


@query("select qname, ref_start, case when ref_start + 30 < ref_start + q then 'M' when ref_start + 30 < ref_start + q + d then 'D' when ref_start + 30 < ref_start + 2 * q + d then 'M' end as op from (select qname, ref_start, mapq - 10 as q, ref_end - ref_start - 2 * (mapq - 10) as d from reads)")
def prj_10_op_at_position(spark, sf_dir):
    walk = fn.cigar_walk("cigar", F.col("ref_start"))
    at = F.get(F.filter(walk, lambda s: s["op"].isin("M", "D", "N") & (s["ref_pos"] <= F.col("ref_start") + 30) & (s["ref_pos"] + s["n"] > F.col("ref_start") + 30)), F.lit(0))
    return view(spark, sf_dir, "reads").select("qname", "ref_start", at["op"].alias("op"))


@query("select qname, ref_start, mapq, abs(tlen - (ref_end - ref_start)) / (ref_end - ref_start) >= 0.1 as variant from reads")
def prj_11_length_variant(spark, sf_dir):
    return view(spark, sf_dir, "reads").select("qname", "ref_start", "mapq", fn.length_variant("tlen", F.col("ref_end") - F.col("ref_start")).alias("variant"))






@query("select distinct contig, regexp_replace(contig, '^chr', '')::INT as key from reads")
def prj_16_contig_key(spark, sf_dir):
    return view(spark, sf_dir, "reads").select("contig", fn.contig_key("contig").alias("key")).distinct()


@query("select event_id, regexp_replace(event_type || '_' || (event_id * 1000)::VARCHAR, '[^A-Za-z0-9_.-]', '_', 'g') as name from events")
def prj_17_artifact_name(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", fn.artifact_name("event_type", F.col("event_id") * 1000).alias("name"))



@query("select qname, ref_start, case when abs(tlen) >= 50 and abs(tlen) < 200 then '50-200' when abs(tlen) >= 200 and abs(tlen) < 700 then '200-700' when abs(tlen) >= 700 and abs(tlen) < 1000 then '700-1000' when abs(tlen) >= 1000 then '>=1000' else 'other' end as size from reads")
def prj_27_size_class(spark, sf_dir):
    return view(spark, sf_dir, "reads").select("qname", "ref_start", fn.size_class("tlen").alias("size"))


@query("select qname, ref_start, mapq, i as op_idx, (ref_start + case i when 1 then 0 when 2 then mapq - 10 else ref_end - ref_start - (mapq - 10) end)::BIGINT as pos from reads, (select unnest([1, 2, 3]) as i)")
def prj_29_reference_offsets(spark, sf_dir):
    ops = view(spark, sf_dir, "reads").select("qname", "ref_start", "mapq", F.posexplode(fn.cigar_walk("cigar", F.col("ref_start"))).alias("i", "s"))
    return ops.filter("s.op <> 'S'").select("qname", "ref_start", "mapq", F.col("i").alias("op_idx"), F.col("s.ref_pos").alias("pos"))



@query("select qname, ref_start, mapq from reads where flag & 256 = 0 and ref_end > ref_start")
def flt_01_primary_reads(spark, sf_dir):
    return view(spark, sf_dir, "reads").filter((F.col("flag").bitwiseAND(256) == 0) & (F.col("ref_end") > F.col("ref_start"))).select("qname", "ref_start", "mapq")





@query("select contig, (ref_start // 1000) * 1000 as win, sum(case when flag & 16 <> 0 then mapq - 30 else 0 end)::BIGINT as total from reads group by 1, 2 having sum(case when flag & 16 <> 0 then mapq - 30 else 0 end) <> 0")
def flt_05_nonzero_windows(spark, sf_dir):
    v = F.when(F.col("flag").bitwiseAND(16) != 0, F.col("mapq") - 30).otherwise(0)
    return view(spark, sf_dir, "reads").groupBy("contig", (F.floor(F.col("ref_start") / 1000) * 1000).alias("win")).agg(F.sum(v).alias("total")).filter("total <> 0")


@query("select contig, max(ref_end) as length from reads group by contig having max(ref_end) >= 20000 and regexp_replace(contig, '^chr', '') in ('1', '2', '3', 'X', 'Y')")
def flt_06_contigs(spark, sf_dir):
    g = view(spark, sf_dir, "reads").groupBy("contig").agg(F.max("ref_end").alias("length"))
    return g.filter((F.col("length") >= 20000) & F.regexp_replace("contig", "^chr", "").isin("1", "2", "3", "X", "Y"))


@query("select cand, count(*) as n from labels_seq group by cand having max(label) > 0")
def flt_07_all_zero(spark, sf_dir):
    return view(spark, sf_dir, "labels_seq").groupBy("cand").agg(F.count("*").alias("n"), F.max("label").alias("most")).filter("most <> 0").drop("most")


@query("select contig, start_pos, (qual % 4)::INT as label from bed_a where qual % 4 in (1, 2)")
def flt_08_label_whitelist(spark, sf_dir):
    b = view(spark, sf_dir, "bed_a").withColumn("label", F.expr("try_cast(cast(qual % 4 as string) as int)"))
    return b.filter(F.col("label").isin(1, 2)).select("contig", "start_pos", "label")


@query("select contig, sum(ref_end - ref_start)::BIGINT as bases, case when sum(ref_end - ref_start) < 10000 then 'empty' when sum(ref_end - ref_start) > 700000 then 'too_large_skip' else 'bam_ready' end as status from reads group by contig")
def flt_10_region_guards(spark, sf_dir):
    from readlake.operators.decide import region_status

    return region_status(view(spark, sf_dir, "reads").groupBy("contig").agg(F.sum(F.col("ref_end") - F.col("ref_start")).alias("bases")), 10_000, 700_000)


_RANKED = "select *, row_number() over (partition by contig order by mapq desc, qname, ref_start, ref_end, tlen, cigar) as rank from reads"


@query(f"""with r as ({_RANKED}), s as (
  select contig, rank, 'C' as kind, ref_start as pos, regexp_extract(cigar, '^(\\d+)S', 1)::BIGINT as size from r
  union all select contig, rank, 'D', ref_start + mapq - 10, ref_end - ref_start - 2 * (mapq - 10) from r
  union all select contig, rank, 'B', unnest(range(ref_start + mapq - 10, ref_end - (mapq - 10))), 1 from r
 ), k as (select s.*, (select count(*) from r x where x.contig = s.contig and x.rank < s.rank and x.ref_start <= s.pos and x.ref_end > s.pos) as before from s),
 d as (select contig, pos, count(*) as depth from (select contig, unnest(range(ref_start, ref_end)) as pos from r) group by contig, pos)
 select k.contig, k.pos, 0::BIGINT as mismatches, count(*) filter (where kind = 'B') as deleted, count(*) filter (where kind = 'C') as clips, 0::BIGINT as insertions, 0::BIGINT as ins_sum, 0::BIGINT as ins_max,
   coalesce(sum(size) filter (where kind = 'D'), 0)::BIGINT as del_sum, coalesce(max(size) filter (where kind = 'D'), 0)::BIGINT as del_max, coalesce(max(d.depth), 0)::BIGINT as depth
 from k left join d on d.contig = k.contig and d.pos = k.pos where before < 20 group by k.contig, k.pos""")
def agg_01_site_channels(spark, sf_dir):
    return pileup.site_channels(view(spark, sf_dir, "reads"), [(-F.col("mapq")).alias("mapq"), "qname", "ref_start", "ref_end", "tlen", "cigar"], 20)


@query("select contig, pos, round(s / (k + 1e-20), 6) as del_mean from (select contig, ref_start as pos, sum(ref_end - ref_start)::BIGINT as s, count(*) as k from reads group by contig, ref_start)")
def agg_02_ratio_columns(spark, sf_dir):
    g = view(spark, sf_dir, "reads").groupBy("contig", F.col("ref_start").alias("pos")).agg(F.sum(F.col("ref_end") - F.col("ref_start")).alias("del_sum"), F.count("*").alias("deleted"), F.lit(0).alias("ins_sum"), F.lit(0).alias("insertions"))
    return pileup.ratios(g).select("contig", "pos", F.round("del_mean", 6).alias("del_mean"))


@query("select contig, (pos // 1000) * 1000 as win_start, count(*) as sites, sum(depth)::BIGINT as total from (select contig, pos, count(*) as depth from (select contig, unnest(range(ref_start, ref_end)) as pos from reads) group by contig, pos) group by 1, 2")
def agg_04_window_rollup(spark, sf_dir):
    w = pileup.windows(pileup.depth(view(spark, sf_dir, "reads")), "depth")
    total = F.aggregate("feat", F.lit(0).cast("long"), lambda a, x: a + x["v"])
    return w.select("contig", "win_start", F.size("feat").cast("long").alias("sites"), total.alias("total"))


@query("select contig, round(avg(mapq), 6) as mapq, round(avg(tlen), 6) as tlen from reads group by contig")
def agg_05_channel_means(spark, sf_dir):
    return view(spark, sf_dir, "reads").groupBy("contig").agg(F.round(F.avg("mapq"), 6).alias("mapq"), F.round(F.avg("tlen"), 6).alias("tlen"))


@query("select trunc(avg(tlen))::BIGINT as mean, trunc(stddev_pop(tlen))::BIGINT as sd, count(*) as n from (select tlen, row_number() over (order by tlen, qname, ref_start) as i, count(*) over () as n from reads) where i > floor(n * 0.05) and i <= floor(n * 0.95)")
def agg_06_trimmed_insert(spark, sf_dir):
    from readlake.operators.stats import trimmed

    return trimmed(view(spark, sf_dir, "reads"), "tlen", 0.05, 0.95)


@query("select round(avg(tlen), 6) as mean, round(stddev_pop(tlen), 6) as sd, round(avg(ref_end - ref_start), 6) as read_len, round(count(*) * avg(ref_end - ref_start) / 100000, 6) as depth from reads where tlen > 50 and tlen < 6000")
def agg_07_alignment_stats(spark, sf_dir):
    from readlake.operators.stats import alignment_stats

    return alignment_stats(view(spark, sf_dir, "reads"), 100_000)



@query("select r.contig, count(*) as n from (select contig, mapq, quantile_cont(mapq, 0.33) over (partition by contig) as cut from reads) r where mapq > greatest(cut, 1.0) group by r.contig")
def agg_10_support(spark, sf_dir):
    from readlake.operators.stats import support

    return support(view(spark, sf_dir, "reads"), ["contig"], "mapq")




@query("select contig, start_pos, slice, start_pos + slice * 50 as slice_start, start_pos + slice * 50 + 50 as slice_end from (select contig, start_pos from bed_b), (select unnest(range(0, 20))::INT as slice)")
def win_06_slices(spark, sf_dir):
    return win.slices(view(spark, sf_dir, "bed_b").select("contig", "start_pos"), "start_pos")


@query("select contig, unnest(range(0, greatest(length, 1), 5000)) as start_pos, case when unnest(range(0, greatest(length, 1), 5000)) + 5000 > length then length + 10000 else unnest(range(0, greatest(length, 1), 5000)) + 5000 end as end_pos from (select contig, max(ref_end) as length from reads group by contig)")
def win_07_tiles(spark, sf_dir):
    return win.tiles(view(spark, sf_dir, "reads").groupBy("contig").agg(F.max("ref_end").alias("length")), 5000)


@query("select contig, qname, ref_start, ref_end, mapq, tlen, place from (select *, row_number() over (partition by contig, ref_start // 500 order by mapq desc, qname, ref_start, ref_end, tlen) as place from reads) where place <= 5")
def win_04_first_in_column(spark, sf_dir):
    w = Window.partitionBy("contig", F.floor(F.col("ref_start") / 500)).orderBy(F.desc("mapq"), "qname", "ref_start", "ref_end", "tlen")
    r = view(spark, sf_dir, "reads").withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 5")
    return r.select("contig", "qname", "ref_start", "ref_end", "mapq", "tlen", "place")


@query("with q as (select quantile_cont(score, 0.9) as cut from score_windows) select chr, position, score from score_windows cross join q where score >= cut and position > 0")
def top_01_top_decile(spark, sf_dir):
    return win.top_share(view(spark, sf_dir, "score_windows"), "score", 0.9).filter("position > 0").select("chr", "position", "score")


@query("select contig, max(ref_end) as length from reads group by contig order by length desc, contig limit 3")
def top_02_longest_contigs(spark, sf_dir):
    return view(spark, sf_dir, "reads").groupBy("contig").agg(F.max("ref_end").alias("length")).orderBy(F.desc("length"), "contig").limit(3)


@query("""with s as (select contig, (pos // 1000) * 1000 as win, sum(n)::BIGINT as total from (
   select contig, ref_start as pos, count(*) as n from reads group by 1, 2 union all select contig, ref_start + mapq - 10, count(*) from reads group by 1, 2 union all
   select contig, pos, count(*) from (select contig, unnest(range(ref_start + mapq - 10, ref_end - (mapq - 10))) as pos from reads) group by 1, 2) group by 1, 2),
 c as (select *, quantile_cont(total, 0.9) over () as cut from s), k as (select contig, win, row_number() over (partition by contig order by win) - win // 1000 as run from c where total >= cut)
 select contig, min(win) as start_pos, max(win) + 1000 as end_pos, count(*) as n from k group by contig, run""")
def flagship_candidate_regions(spark, sf_dir):
    """Reads to signals by position, windows, the top decile of them, and merged candidate regions."""
    events = pileup.signals(view(spark, sf_dir, "reads"))
    scored = events.groupBy("contig", (F.floor(F.col("pos") / 1000) * 1000).alias("win")).agg(F.count("*").alias("total"))
    top = win.top_share(scored, "total", 0.9)
    run = F.row_number().over(Window.partitionBy("contig").orderBy("win")) - F.floor(F.col("win") / 1000)
    return top.withColumn("run", run).groupBy("contig", "run").agg(F.min("win").alias("start_pos"), (F.max("win") + 1000).alias("end_pos"), F.count("*").alias("n")).drop("run")
