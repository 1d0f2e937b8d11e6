"""Sources and sinks of files, signals, clip targets, piles and sequence scores."""

from __future__ import annotations

import json

from pyspark.sql import Window, functions as F

from readlake.operators import intervals as iv, models, signals
from readlake.plans.registry import query
from readlake.sources import formats as fmt, sinks
from readlake.sources.views import table, view


@query("select contig, start_pos, end_pos from bed_b")
def src_10_interval_text(spark, sf_dir):
    """Intervals as text of both separators, under a header."""
    b = view(spark, sf_dir, "bed_b")
    sep = F.when(F.col("start_pos") % 2 == 0, ",").otherwise("\t")
    lines = b.select(F.concat(F.col("contig"), sep, F.col("start_pos").cast("string"), sep, F.col("end_pos").cast("string")).alias("value"))
    return fmt.parse_intervals(spark.createDataFrame([("chrom,start,end",)], "value string").union(lines))


@query("""with t as (select o_orderkey, o_custkey, case o_custkey % 3 when 0 then 'A' when 1 then 'C' else '?' end as x, case o_custkey % 4 when 0 then 'A' when 1 then 'C' when 2 then 'GG' else '?' end as y from orders where o_orderkey % 11 <> 0 and o_orderkey % 7 <> 0),
 m as (select *, case when y = 'GG' then 'N' else '' end as lead from t),
 c as (select *, lead || 'A' as ref, case when x = '?' then x else lead || x end as a, case when y = '?' then y else lead || y end as b from m)
 select concat('chr', (o_custkey % 5 + 1)::VARCHAR) as contig, o_orderkey * 7 + 1 as pos, ref,
  case when a = '?' and b = '?' then null when a = '?' then b when b = '?' then a when a = b and a = ref then '.' when a = b then a when a = ref then b when b = ref then a else a || ',' || b end as alt,
  greatest(case when a not in ('?', ref) then o_custkey % 50 else 0 end, case when b not in ('?', ref) then o_custkey % 37 else 0 end)::BIGINT as qual,
  'DP=' || (o_custkey % 60)::VARCHAR || ';CGDP2=' || ((case when a = ref then o_custkey % 23 else 0 end) + (case when b = ref then o_custkey % 19 else 0 end))::VARCHAR || ',' ||
   ((case when a not in ('?', ref) then o_custkey % 23 else 0 end) + (case when b not in ('?', ref) and a <> b then o_custkey % 19 else 0 end))::VARCHAR as info,
  case when a = '?' or b = '?' then './.' when a = b and a = ref then '0/0' when a = b then '1/1' when a = ref or b = ref then '0/1' else '1/2' end as gt,
  least(o_custkey % 50, o_custkey % 37)::BIGINT as gq from c""")
def src_15_master_var(spark, sf_dir):
    cells = {1: "2", 2: "concat('chr', o_custkey % 5 + 1)", 3: "o_orderkey * 7", 5: "if(o_orderkey % 11 = 0, 'no-call', 'het')", 6: "if(o_orderkey % 7 = 0, 'ref', 'snp')", 7: "'A'", 8: "element_at(array('A', 'C', '?'), int(o_custkey % 3) + 1)",
             9: "element_at(array('A', 'C', 'GG', '?'), int(o_custkey % 4) + 1)", 10: "o_custkey % 50", 11: "o_custkey % 37", 21: "o_custkey % 23", 22: "o_custkey % 19", 24: "o_custkey % 60"}
    text = ", ".join(f"cast({cells.get(i, 'o_orderkey' if i == 0 else repr(''))} as string)" for i in range(25))
    return fmt.master_var(table(spark, sf_dir, "orders").select(F.expr(f"concat_ws('\t', {text})").alias("value")))



@query("select contig, count(*) as n, sum(tlen)::BIGINT as tlen from reads group by contig")
def snk_01_blocks(spark, sf_dir):
    """Blocks written by contig and read back."""
    path = sinks.scratch(spark, "blocks")
    sinks.write_blocks(view(spark, sf_dir, "reads"), path)
    return spark.read.parquet(path).groupBy("contig").agg(F.count("*").alias("n"), F.sum("tlen").alias("tlen"))


@query("select round(avg(mapq), 6) as mapq, round(avg(tlen), 6) as tlen from reads")
def snk_02_mean_vector(spark, sf_dir):
    path = sinks.scratch(spark, "means")
    return sinks.stage(spark, path, lambda: view(spark, sf_dir, "reads").agg(F.round(F.avg("mapq"), 6).alias("mapq"), F.round(F.avg("tlen"), 6).alias("tlen")))


@query("select cand, string_agg(label::VARCHAR, ',' order by idx) as pred_sequence from labels_seq group by cand")
def snk_04_predictions(spark, sf_dir):
    """Label sequences as text, written and read again."""
    one = view(spark, sf_dir, "labels_seq").groupBy("cand").agg(F.array_sort(F.collect_list(F.struct("idx", "label"))).alias("s"))
    path = sinks.scratch(spark, "predictions")
    return sinks.stage(spark, path, lambda: one.select("cand", F.array_join(F.transform("s", lambda x: x["label"].cast("string")), ",").alias("pred_sequence")))


@query()
def snk_05_contact_sheets(spark, sf_dir):
    """An image for each window of 1000 bases: reads as grey strokes, 20 slices of 50 bases."""
    r = view(spark, sf_dir, "reads").withColumn("win", F.floor(F.col("ref_start") / 1000))
    rank = F.row_number().over(Window.partitionBy("contig", "ref_start").orderBy("qname", "tlen", "mapq")) - 1
    dots = r.select("contig", "win", F.floor((F.col("ref_start") % 1000) / 50).alias("slice"), (F.col("ref_start") % 50).alias("x"), (5 + 5 * rank).alias("y"), (F.col("mapq") * 4 % 256).alias("level"))
    return sinks.sheets(dots, "concat(contig, ':', win)").select("key", F.octet_length("png").alias("bytes"), F.hex(F.substr("png", F.lit(2), F.lit(3))).alias("kind"), F.sha2("png", 256).alias("sha256"))



@query("select asm_status as status, count(*) as n, sum(raw_support)::BIGINT as support from evidence group by asm_status")
def snk_13_json_records(spark, sf_dir):
    path = sinks.scratch(spark, "records")
    sinks.write_records(view(spark, sf_dir, "evidence").groupBy(F.col("asm_status").alias("status")).agg(F.count("*").alias("n"), F.sum("raw_support").alias("support")), path)
    return spark.read.schema("status string, n bigint, support bigint").json(path)


_REGIONS = "select contig || ':' || (start_pos // 1000)::VARCHAR as region, sum(end_pos - start_pos)::BIGINT as bases from bed_b group by 1"


@query(f"""select region, 'all: ' || region || '.assemble' || chr(10) || region || '.correct: ' || region || '.fq' || chr(10) || chr(9) || 'correct -t 4 -k 61 $< > $@' || chr(10) ||
 region || '.index: ' || region || '.correct' || chr(10) || chr(9) || 'index -t 4 -k 61 $< > $@' || chr(10) || region || '.assemble: ' || region || '.index' || chr(10) || chr(9) || 'assemble -t 4 -k 61 $< > $@' || chr(10) as job from ({_REGIONS})""")
def snk_15_job_text(spark, sf_dir):
    return _regions(spark, sf_dir).select("region", sinks.job_text(F.col("region"), F.concat("region", F.lit(".fq"))).alias("job"))


def _regions(spark, sf_dir):
    b = view(spark, sf_dir, "bed_b").withColumn("region", F.concat("contig", F.lit(":"), F.floor(F.col("start_pos") / 1000).cast("string")))
    return b.groupBy("region").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("bases"))


@query("select chr, (i // 100)::BIGINT as batch, count(*) as n, count(*) = 100 as whole, min(position) as first from (select *, row_number() over (partition by chr order by position) - 1 as i from score_windows) group by 1, 2")
def snk_16_batches(spark, sf_dir):
    """Windows of a contig written in batches of 100 and a tail, and read again by batch."""
    path = sinks.scratch(spark, "batches")
    sinks.write_batches(view(spark, sf_dir, "score_windows"), path, "chr", "position")
    w = spark.read.parquet(path).withColumn("i", F.col("batch") * 100)
    return w.groupBy("chr", F.floor(F.col("i") / 100).alias("batch")).agg(F.count("*").alias("n"), (F.count("*") == 100).alias("whole"), F.min("position").alias("first"))


@query()
def prj_28_padded_pile(spark, sf_dir):
    r = view(spark, sf_dir, "reads").withColumn("cigar", F.concat("cigar", F.col("qname") % 3 + 1, F.lit("I4M")))
    return signals.padded_pile(r)


@query("""with d as (select contig, ref_start + l as first, n from (select contig, ref_start, regexp_extract(cigar, 'S(\\d+)M', 1)::BIGINT as l, regexp_extract(cigar, 'M(\\d+)D', 1)::BIGINT as n from reads)),
 c as (select contig, unnest(range(ref_start, ref_end)) as pos from reads), x as (select distinct contig, unnest(range(first, first + n)) as pos from d)
 select c.contig, c.pos, count(*) as depth from c anti join x on x.contig = c.contig and x.pos = c.pos group by 1, 2 having count(*) >= 2""")
def prj_32_columns_kept(spark, sf_dir):
    return signals.columns_with(view(spark, sf_dir, "reads"), "D", 2)


@query("select cand, idx, row_number() over (partition by cand order by idx) - 1 as place from labels_seq")
def prj_34_sparse_coordinates(spark, sf_dir):
    one = view(spark, sf_dir, "labels_seq").groupBy("cand").agg(F.array_sort(F.collect_list("idx")).alias("s"))
    return one.select("cand", F.posexplode("s").alias("place", "idx")).select("cand", "idx", F.col("place").cast("bigint").alias("place"))


@query()
def agg_03_signal_clusters(spark, sf_dir):
    """Long indels and split reads together, clustered."""
    r = view(spark, sf_dir, "reads").withColumn("cigar", F.regexp_replace("cigar", "M(\\d+)D", "M2$1D"))
    at = signals.with_ends(r.select("contig", "qname", "ref_end", "tlen", "flag", "cigar"))
    parts = at.select("contig", "qname", "ref_end", (F.col("ref_end") + F.col("tlen")).alias("sa_start"), "read_end", (F.col("read_end") + F.col("tlen") * (F.col("flag") % 2)).alias("sa_read_start"))
    return signals.discover(r, parts)


@query("""with e as (select user_id, count(*) as done, count(*) filter (where event_type = 'error') as failed, max(value) as secs from events group by user_id)
 select user_id, round(done / secs, 6) as per_second, case when done > failed then round((done - failed) * secs / done, 6) else 0.0 end as left_seconds, done - failed as backlog from e where secs > 0""")
def agg_26_progress(spark, sf_dir):
    """Rate, backlog and time left from counters."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("done"), F.count_if(F.col("event_type") == "error").alias("failed"), F.max("value").alias("secs")).filter("secs > 0")
    left = F.col("done") - F.col("failed")
    return e.select("user_id", F.round(F.col("done") / F.col("secs"), 6).alias("per_second"), F.when(left > 0, F.round(left * F.col("secs") / F.col("done"), 6)).otherwise(0.0).alias("left_seconds"), left.alias("backlog"))


_TARGETS = """select row_number() over () as rid, contig, qname, ref_start, case when flag & 16 = 0 then ref_end else greatest(ref_start - tlen - 100, ref_start - 50000, 0) end as first,
  case when flag & 16 = 0 then least(ref_start + tlen + 250, ref_end + 50000) else ref_start end as past from reads"""


@query(f"""with t as ({_TARGETS}), k as (select *, unnest(range(first // 50, (past - 1) // 50 + 1)) as chunk_id from t where past > first),
 s as (select k.rid, k.contig, k.qname, k.ref_start, k.first, k.past, string_agg(rpad(coalesce(c.seq, ''), 50, 'n'), '' order by k.chunk_id) as seq from k left join chunks c on c.contig = k.contig and c.chunk_id = k.chunk_id group by all)
 select contig, qname, ref_start, first, past, md5(substring(seq, first % 50 + 1, past - first)) as seq from s""")
def jn_14_clip_targets(spark, sf_dir):
    """Reference text that a read's clip is looked for in, bounded by the mate."""
    r = view(spark, sf_dir, "reads")
    right = F.col("flag").bitwiseAND(16) == 0
    t = signals.clip_target(F.when(right, F.col("ref_end")).otherwise(F.col("ref_start")), F.when(right, F.col("ref_start") + F.col("tlen")).otherwise(F.col("ref_start") - F.col("tlen")), right)
    targets = r.select("contig", "qname", "ref_start", t["first"].alias("first"), t["past"].alias("past"))
    return signals.fetch(targets, view(spark, sf_dir, "chunks"), 50).select("contig", "qname", "ref_start", "first", "past", F.md5("seq").alias("seq"))


@query("""with l as (select distinct contig, start_pos // 1000 * 1000 as a from bed_b), j as (select l.contig, l.a, r.ref_start, r.ref_start // 20 as bin from l join reads r on r.contig = l.contig and r.ref_start >= l.a and r.ref_start < l.a + 1000),
 n as (select contig, a, bin, count(*) as n from j group by all), m as (select contig, a, arg_max(bin, n * 100000000 - bin) as bin from n group by all)
 select j.contig, j.a as locus, median(j.ref_start)::DOUBLE as pos, count(*) as support from j join m on m.contig = j.contig and m.a = j.a and abs(j.bin - m.bin) <= 1 group by j.contig, j.a""")
def jn_16_locus_signatures(spark, sf_dir):
    """Median place and support around the fullest bin of 20 bases of each locus."""
    loci = view(spark, sf_dir, "bed_b").select("contig", (F.floor(F.col("start_pos") / 1000) * 1000).alias("start_pos")).distinct().withColumn("end_pos", F.col("start_pos") + 1000)
    points = view(spark, sf_dir, "reads").select("contig", F.col("ref_start").alias("start_pos"), (F.col("ref_start") + 1).alias("end_pos"))
    return iv.locus_signatures(loci, points, 20)


@query("select o_orderstatus as status, count(*) as n from orders group by o_orderstatus")
def dec_05_stage_reuse(spark, sf_dir):
    """A stage that is there is read, not built again."""
    path = sinks.scratch(spark, "stage")
    sinks.stage(spark, path, lambda: table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")))
    return sinks.stage(spark, path, lambda: spark.range(0).select(F.lit("").alias("status"), F.col("id").alias("n")))



@query("select r_name as name, r_regionkey <> 4 as found, r_regionkey < 3 as valid from region")
def dec_10_manifest(spark, sf_dir):
    """Files against sizes and digests: one is changed and one is missing."""
    import hashlib

    names = [(r.r_regionkey, r.r_name) for r in table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect()]  # five rows, a fixed table
    wanted = {n: {"size": len(n), "sha256": hashlib.sha256((n if k != 3 else n + "x").encode()).hexdigest()} for k, n in names}
    files = table(spark, sf_dir, "region").filter("r_regionkey <> 4").select(F.concat(F.lit("/models/"), "r_name").alias("path"), F.octet_length("r_name").cast("bigint").alias("length"), F.encode("r_name", "utf-8").alias("content"))
    return sinks.manifest_valid(files, json.dumps(wanted))


@query("select qname, ref_start, contig, row_number() over (partition by contig, ref_start // 1000 order by mapq + tlen / 1000.0 desc, qname, ref_start) as place from reads")
def srt_03_read_priority(spark, sf_dir):
    w = Window.partitionBy("contig", F.floor(F.col("ref_start") / 1000)).orderBy(F.desc(F.col("mapq") + F.col("tlen") / 1000.0), "qname", "ref_start")
    return view(spark, sf_dir, "reads").select("qname", "ref_start", "contig", F.row_number().over(w).cast("bigint").alias("place"))


@query("""with s as (select cand, list(least(idx % 100, 50) / 50.0 order by idx) as v from labels_seq group by cand), k as (select *, unnest(range(0, (len(v) + 19) // 20)) as k from s), x as (select cand, k::INT as k, i::INT as i, coalesce(v[k * 20 + i + 1], 0.0)::DOUBLE as x from k, (select unnest(range(20)) as i)),
 e as (select cand, k, i, exp(0.5) as a, exp(x) as b, exp(1 - x) as c from x) select cand as key, k as block, i as slice, round(a / (a + b + c), 6) as p0, round(b / (a + b + c), 6) as p1, round(c / (a + b + c), 6) as p2 from e""")
def udf_02_sequence_scorer(spark, sf_dir):
    """Class probabilities of all values of each sequence, 20 slices at a time, by the default scorer."""
    seq = view(spark, sf_dir, "labels_seq").groupBy(F.col("cand").alias("key")).agg(F.array_sort(F.collect_list(F.struct("idx", (F.least(F.col("idx") % 100, F.lit(50)) / 50.0).cast("double").alias("v")))).alias("s"))
    got = models.score_sequences(seq.select("key", F.transform("s", lambda x: x["v"]).alias("values")))
    return got.select("key", "block", "slice", *[F.round(p, 6).alias(p) for p in ("p0", "p1", "p2")])
