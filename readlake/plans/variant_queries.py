"""Variant, sink and sequential operators."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from readlake.functions import variants as vf
from readlake.functions.reads import contig_key, phred
from readlake.operators import intervals as iv, sequential as seq, stats
from readlake.plans.interval_queries import _ISLANDS
from readlake.plans.registry import query
from readlake.sources import formats as fmt, sinks
from readlake.sources.views import table, view


def _calls(spark, sf_dir):
    bases = lambda text, n: F.substr(F.lit(text), F.lit(1), F.col(n).cast("int"))
    return view(spark, sf_dir, "variants").select("contig", "pos", bases("AAAAAA", "ref_len").alias("ref"), bases("ACACAC", "alt_len").alias("alt"), "info", "gt", "qual")


_CALLS = "select contig, pos, substring('AAAAAA', 1, ref_len::INT) as ref, substring('ACACAC', 1, alt_len::INT) as alt, info, gt, qual from variants"


@query(f"select contig, pos, ref, alt, regexp_extract(info, 'DP=(\\d+)', 1)::BIGINT as dp, gt from ({_CALLS})")
def src_12_vcf_scan(spark, sf_dir):
    rows = fmt.parse_vcf(fmt.vcf_lines(_calls(spark, sf_dir)).select("value"))
    return rows.select("contig", "pos", "ref", F.col("alts")[0].alias("alt"), F.col("info")["DP"].cast("long").alias("dp"), F.col("samples")[0].alias("gt"))


@query(f"with m as ({_ISLANDS.format(t='bed_b', more='', tie='')}), r as (select contig, count(*) as records from bed_b group by contig) select m.contig, any_value(r.records) as records, count(*) as merged, sum(end_pos - start_pos)::BIGINT as bases from m join r on r.contig = m.contig group by m.contig")
def src_13_bed_index(spark, sf_dir):
    """BED text as merged intervals by contig."""
    lines = view(spark, sf_dir, "bed_b").select(F.concat_ws("\t", "contig", F.col("start_pos").cast("string"), F.col("end_pos").cast("string")).alias("value"))
    rows = fmt.parse_intervals(lines)
    merged = iv.merge(rows).groupBy("contig").agg(F.count("*").alias("merged"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("bases"))
    return rows.groupBy("contig").agg(F.count("*").alias("records")).join(merged, "contig")



@query("select event_type as file, arg_max(value, event_id) as last_value, max(event_id) as line from events group by event_type")
def src_16_log_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select("event_type", "event_id", F.concat(F.lit("[M::run] value="), F.col("value").cast("string"), F.lit(" done")).alias("line"))
    got = lines.withColumn("v", F.regexp_extract("line", r"value=(\S+)", 1).cast("double"))
    return got.groupBy(F.col("event_type").alias("file")).agg(F.max_by("v", "event_id").alias("last_value"), F.max("event_id").alias("line"))


@query("select chr, position, score, row_number() over (order by chr, position) as line from score_windows")
def snk_03_candidate_rows(spark, sf_dir):
    """Candidate rows as numbered lines of text under a header, written and read again."""
    return sinks.csv_round_trip(_numbered(spark, sf_dir), sinks.scratch(spark, "candidates"))


def _numbered(spark, sf_dir):
    w = view(spark, sf_dir, "score_windows")
    # Numbered in two steps, so that no task sorts all rows: within a contig, plus those before it.
    own = w.withColumn("i", F.row_number().over(Window.partitionBy("chr").orderBy("position")))
    before = w.groupBy("chr").agg(F.count("*").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("chr")) - F.col("n"))
    return own.join(before, "chr").select("chr", "position", "score", (F.col("i") + F.col("base")).alias("line"))


@query("select contig, start_pos, end_pos, qual, dense_rank() over (order by regexp_replace(contig, '^chr', '')::INT, start_pos) as place from bed_a")
def snk_06_sorted_intervals(spark, sf_dir):
    """Intervals written in the order of contig key and start: files and rows of files follow it, which the ranks of rows read again show."""
    path = sinks.scratch(spark, "intervals")
    sinks.write_sorted(stats.ranked_by_contig(view(spark, sf_dir, "bed_a"), "start_pos"), path, [contig_key("contig"), F.col("start_pos")])
    return spark.read.parquet(path)


@query("select contig, start_pos, end_pos, qual from bed_a where qual % 3 <> 0")
def snk_07_validated_rows(spark, sf_dir):
    """Kept calls with the columns of the input only, written and read again."""
    rows = view(spark, sf_dir, "bed_a")
    kept = rows.withColumn("score", F.col("qual") / 10).filter("qual % 3 <> 0")
    return sinks.csv_round_trip(kept.select(*rows.columns), sinks.scratch(spark, "validated"))


@query(f"select contig || chr(9) || pos::VARCHAR || chr(9) || '.' || chr(9) || ref || chr(9) || alt || chr(9) || '999' || chr(9) || 'PASS' || chr(9) || info || chr(9) || 'GT' || chr(9) || gt as value from ({_CALLS}) union all select '##contig=<ID=' || contig || '>' from (select distinct contig from variants)")
def snk_08_vcf_lines(spark, sf_dir):
    return fmt.vcf_lines(_calls(spark, sf_dir)).filter("ord in (2, 4)").select("value")


@query("select contig, pos, info || ';SPRITES_LEN=' || (ref_len * 10)::VARCHAR || ';EVIDENCE=' || (case when qual % 2 = 0 then 'SR' else 'DP' end) as info from variants")
def snk_09_added_info(spark, sf_dir):
    v = view(spark, sf_dir, "variants").withColumn("evidence", F.when(F.col("qual") % 2 == 0, "SR").otherwise("DP"))
    return v.select("contig", "pos", F.concat_ws(";", "info", F.concat(F.lit("SPRITES_LEN="), (F.col("ref_len") * 10).cast("string")), F.concat(F.lit("EVIDENCE="), "evidence")).alias("info"))


@query("select contig, qname, ref_start, ref_end, (mapq % 7)::INT as source from reads")
def snk_11_merged_reads(spark, sf_dir):
    """Sorted files of seven sources merged in batches of three, then all batches, into one sorted set."""
    r = view(spark, sf_dir, "reads").select("contig", "qname", "ref_start", "ref_end", (F.col("mapq") % 7).cast("int").alias("source"))
    paths = []
    for i in range(7):
        paths.append(sinks.scratch(spark, f"source-{i}"))
        sinks.write_sorted(r.filter(F.col("source") == i), paths[-1], [F.col("contig"), F.col("ref_start")])
    return spark.read.parquet(sinks.merge_sorted(spark, paths, ["contig", "ref_start"], batch=3))



@query("with n as (select *, greatest(ref_len, alt_len) as hi from variants) select contig, pos, greatest(ref_len - k, 1) as ref_left, greatest(alt_len - k, 1) as alt_left from (select *, case when ref_len = 1 or alt_len = 1 then least(ref_len, alt_len) - 1 else least(ref_len, alt_len) - 1 end as k from n) where alt_len = 1 or ref_len = 1")
def prj_19_allele_trim(spark, sf_dir):
    t = vf.trim_alleles(F.col("ref"), F.col("alt"))
    c = _calls(spark, sf_dir).filter((F.length("alt") == 1) | (F.length("ref") == 1)).withColumn("t", t)
    return c.select("contig", "pos", F.length("t.ref").cast("long").alias("ref_left"), F.length("t.alt").cast("long").alias("alt_left"))




@query("select contig, pos, case when qual % 2 = 0 then '0/1' else gt end as gt from variants")
def prj_24_unphased_swap(spark, sf_dir):
    return view(spark, sf_dir, "variants").select("contig", "pos", vf.unphase(F.when(F.col("qual") % 2 == 0, "1/0").otherwise(F.col("gt"))).alias("gt"))


@query("select contig, pos, [gt, info] as samples from variants")
def prj_25_sample_subset(spark, sf_dir):
    v = view(spark, sf_dir, "variants").withColumn("samples", F.array("info", F.lit("x"), "gt"))
    return v.select("contig", "pos", F.transform(F.array(F.lit(2), F.lit(0)), lambda i: F.get("samples", i)).alias("samples"))




@query("select event_id, (case when value / 200 < 1e-10 then 0 else floor(-4.343 * ln(value / 200) + 0.499) end)::BIGINT as q from events where value > 0")
def fn_02_phred(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("value > 0").select("event_id", phred(F.col("value") / 200).alias("q"))







@query()
def win_08_drop_overlaps(spark, sf_dir):
    return seq.drop_overlaps(view(spark, sf_dir, "bed_a"))



@query()
def win_10_segments(spark, sf_dir):
    w = view(spark, sf_dir, "score_windows").select(F.col("chr").alias("contig"), F.col("position").alias("pos"), F.col("score").alias("value"))
    return seq.segments(w)


@query()
def set_04_cluster_signals(spark, sf_dir):
    r = view(spark, sf_dir, "reads").select("contig", F.col("ref_start").alias("pos"), F.when(F.col("flag").bitwiseAND(16) != 0, F.col("tlen")).otherwise(-F.col("tlen")).cast("long").alias("size"), F.when(F.col("mapq") > 55, F.col("qname")).otherwise(-1).cast("long").alias("split"))
    return seq.cluster_signals(r)


@query()
def prj_30_packed_rows(spark, sf_dir):
    r = view(spark, sf_dir, "reads").select("contig", F.col("ref_start").alias("start_pos"), F.col("ref_end").alias("end_pos"))
    return seq.pack_rows(r)


@query()
def fn_05_local_alignment(spark, sf_dir):
    c = view(spark, sf_dir, "chunks")
    return seq.align(c.select("chunk_id", F.substring("seq", 3, 12).alias("clip"), "seq"), "clip", "seq")
