"""Interval, set and join operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from readlake.operators import intervals as iv
from readlake.plans.registry import query
from readlake.sources.views import table, view

_ISLANDS = """select contig, min(start_pos) as start_pos, max(end_pos) as end_pos {more} from (
  select *, sum(case when start_pos < before then 0 else 1 end) over (partition by contig order by start_pos, end_pos {tie}) as island from (
    select *, max(end_pos) over (partition by contig order by start_pos, end_pos {tie} rows between unbounded preceding and 1 preceding) as before from {t})) group by contig, island"""


@query(_ISLANDS.format(t="bed_b", more="", tie=""))
def set_01_merge_intervals(spark, sf_dir):
    return iv.merge(view(spark, sf_dir, "bed_b"))


@query(f"select contig, sum(end_pos - start_pos)::BIGINT as bases, count(*) as n from ({_ISLANDS.format(t='bed_b', more='', tie='')}) group by contig")
def set_02_covered_bases(spark, sf_dir):
    return iv.merge(view(spark, sf_dir, "bed_b")).groupBy("contig").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("bases"), F.count("*").alias("n"))


@query(f"""with cut as (select contig, start_pos + 2 as start_pos, end_pos - 2 as end_pos from bed_b where end_pos - 2 > start_pos + 2), m as ({_ISLANDS.format(t='cut', more='', tie='')}),
 g as (select contig, coalesce(lag(end_pos) over (partition by contig order by start_pos), 0) as a, start_pos as b from m
       union all select l.contig, coalesce(max(m.end_pos), 0), l.length from (select contig, max(end_pos) + 100 as length from bed_b group by contig) l left join m on m.contig = l.contig group by l.contig, l.length)
 select contig, a as start_pos, b as end_pos from g where b - a >= 20""")
def set_03_complement(spark, sf_dir):
    b = view(spark, sf_dir, "bed_b")
    return iv.complement(b, b.groupBy("contig").agg((F.max("end_pos") + 100).alias("length")), shrink=2, least=20)


@query("select contig, start_pos, end_pos, 1 as label from bed_a union all select contig, start_pos, end_pos, 2 from bed_b")
def set_05_union_all(spark, sf_dir):
    cols = ["contig", "start_pos", "end_pos"]
    return view(spark, sf_dir, "bed_a").select(*cols, F.lit(1).alias("label")).unionByName(view(spark, sf_dir, "bed_b").select(*cols, F.lit(2).alias("label")))


@query("select source, count(*) as n, sum(end_pos - start_pos)::BIGINT as bases from (select 1 as source, start_pos, end_pos from bed_a union all select 2, start_pos, end_pos from bed_b) group by source")
def set_06_union_with_source(spark, sf_dir):
    both = view(spark, sf_dir, "bed_a").select(F.lit(1).alias("source"), "start_pos", "end_pos").union(view(spark, sf_dir, "bed_b").select(F.lit(2), "start_pos", "end_pos"))
    return both.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("bases"))


@query("select distinct contig from bed_a intersect select distinct contig from bed_b")
def set_07_common_contigs(spark, sf_dir):
    return view(spark, sf_dir, "bed_a").select("contig").intersect(view(spark, sf_dir, "bed_b").select("contig"))


@query("select distinct contig, flag, mapq from reads")
def set_08_distinct(spark, sf_dir):
    return view(spark, sf_dir, "reads").select("contig", "flag", "mapq").distinct()


@query("""select a.contig, a.start_pos, a.end_pos, b.start_pos as start_pos_b, b.end_pos as end_pos_b from bed_a a join bed_b b
 on a.contig = b.contig and a.start_pos < b.end_pos and a.end_pos > b.start_pos""")
def jn_01_overlap_join(spark, sf_dir):
    a = view(spark, sf_dir, "bed_a").select("contig", "start_pos", "end_pos")
    return iv.overlap_join(a, view(spark, sf_dir, "bed_b")).select("contig", "start_pos", "end_pos", "start_pos_b", "end_pos_b")


@query("select r.contig, r.ref_start, r.qname, coalesce(substring(c.seq, (r.ref_start % 50 + 1)::INT, 1), 'n') as base from reads r left join chunks c on c.contig = r.contig and c.chunk_id = r.ref_start // 50")
def jn_02_reference_base(spark, sf_dir):
    r, c = view(spark, sf_dir, "reads"), view(spark, sf_dir, "chunks").withColumnRenamed("contig", "c_contig")
    j = r.join(c, (F.col("contig") == F.col("c_contig")) & (F.floor(F.col("ref_start") / 50) == F.col("chunk_id")), "left")
    return j.select("contig", "ref_start", "qname", F.coalesce(F.substr("seq", F.col("ref_start") % 50 + 1, F.lit(1)), F.lit("n")).alias("base"))


@query("select r.contig, r.ref_start, r.qname, coalesce(k.n, 0) as clips from reads r left join (select contig, ref_start, count(*) as n from reads where mapq > 40 group by contig, ref_start) k on k.contig = r.contig and k.ref_start = r.ref_start")
def jn_03_clip_lookup(spark, sf_dir):
    r = view(spark, sf_dir, "reads")
    clips = r.filter("mapq > 40").groupBy("contig", "ref_start").agg(F.count("*").alias("n"))
    return r.join(clips, ["contig", "ref_start"], "left").select("contig", "ref_start", "qname", F.coalesce("n", F.lit(0)).cast("long").alias("clips"))


_WINDOWS = "(select contig, o_start as start_pos, o_start + 1000 as end_pos from (select distinct contig, (start_pos // 1000) * 1000 as o_start from bed_a))"


@query(f"select w.contig, w.start_pos from {_WINDOWS} w where exists (select 1 from bed_b b where b.contig = w.contig and b.end_pos > w.start_pos and b.start_pos < w.start_pos + 1000)")
def jn_04_window_truth_semi(spark, sf_dir):
    w = view(spark, sf_dir, "bed_a").select("contig", (F.floor(F.col("start_pos") / 1000) * 1000).alias("start_pos")).distinct().withColumn("end_pos", F.col("start_pos") + 1000)
    return iv.overlap_join(w, view(spark, sf_dir, "bed_b"), "semi").select("contig", "start_pos")


@query("""select case when not exists (select 1 from bed_b b where b.contig = a.contig) then 'no contig'
  when exists (select 1 from bed_b b where b.contig = a.contig and a.start_pos < b.end_pos and a.end_pos > b.start_pos) then 'overlap' else 'apart' end as class, count(*) as n from bed_a a group by 1""")
def jn_05_lines_against_bed(spark, sf_dir):
    b = view(spark, sf_dir, "bed_b")
    a = iv.overlap_join(view(spark, sf_dir, "bed_a"), b, "flag").join(b.select("contig").distinct().withColumn("known", F.lit(True)), "contig", "left")
    return a.groupBy(F.when(F.col("known").isNull(), "no contig").when(F.col("hit"), "overlap").otherwise("apart").alias("class")).agg(F.count("*").alias("n"))


@query("""select v.contig, v.pos, v.qual, exists (select 1 from bed_a x where x.contig = v.contig and x.start_pos < v.pos - 1 + v.ref_len and x.end_pos > v.pos - 1) as in_a,
  exists (select 1 from bed_b x where x.contig = v.contig and x.start_pos < v.pos - 1 + v.ref_len and x.end_pos > v.pos - 1) as in_b from variants v""")
def jn_06_flag_by_beds(spark, sf_dir):
    v = view(spark, sf_dir, "variants").withColumn("start_pos", F.col("pos") - 1).withColumn("end_pos", F.col("pos") - 1 + F.col("ref_len"))
    a = iv.overlap_join(v, view(spark, sf_dir, "bed_a"), "flag").withColumnRenamed("hit", "in_a")
    return iv.overlap_join(a, view(spark, sf_dir, "bed_b"), "flag").select("contig", "pos", "qual", "in_a", F.col("hit").alias("in_b"))


@query("select a.contig, a.start_pos, a.end_pos from bed_a a where not exists (select 1 from bed_b b where b.contig = a.contig and a.start_pos < b.end_pos and a.end_pos > b.start_pos)")
def jn_07_outside_bed_anti(spark, sf_dir):
    return iv.overlap_join(view(spark, sf_dir, "bed_a"), view(spark, sf_dir, "bed_b"), "anti").select("contig", "start_pos", "end_pos")


@query("""with t as (select contig, pos from variants where qual % 2 = 0), c as (select contig, pos + 3 as pos from variants where qual % 3 = 0)
 select 'truth' as side, (case when exists (select 1 from c where c.contig = t.contig and abs(c.pos - t.pos) <= 10) then 1 else 0 end)::INT as hit, count(*) as n from t group by 1, 2
 union all select 'call', (case when exists (select 1 from t where c.contig = t.contig and abs(c.pos - t.pos) <= 10) then 1 else 0 end)::INT, count(*) from c group by 1, 2""")
def jn_08_distance_match(spark, sf_dir):
    v = view(spark, sf_dir, "variants")
    t, c = v.filter("qual % 2 = 0").select("contig", "pos"), v.filter("qual % 3 = 0").select("contig", (F.col("pos") + 3).alias("pos"))
    one = lambda x, y, side: iv.nearest(x, y, 10).groupBy(F.lit(side).alias("side"), F.col("hit").cast("int").alias("hit")).agg(F.count("*").alias("n"))
    return one(t, c, "truth").union(one(c, t, "call"))


@query("""with b as (select (n_nationkey + 1) * 3000 as cum, n_name as sample from nation) select e.o_orderkey as id, (select arg_min(sample, cum) from b where b.cum > e.o_orderkey) as sample from orders e
 where (select count(*) from b where b.cum > e.o_orderkey) > 0""")
def jn_10_sample_as_of(spark, sf_dir):
    bounds = table(spark, sf_dir, "nation").select(((F.col("n_nationkey") + 1) * 3000).cast("long").alias("cum"), F.col("n_name").alias("sample"))
    return iv.as_of(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), bounds, "id", "cum", "sample")



@query("""with s as (select c_custkey, c_mktsegment from customer), wanted as (select unnest(['MACHINERY', 'NOTHING', 'BUILDING']) as name, unnest([0, 1, 2]) as place)
 select w.place, w.name, count(*) as n from wanted w join s on s.c_mktsegment = w.name group by w.place, w.name""")
def jn_13_ordered_name_join(spark, sf_dir):
    wanted = spark.createDataFrame([(0, "MACHINERY"), (1, "NOTHING"), (2, "BUILDING")], "place int, name string")
    return table(spark, sf_dir, "customer").join(F.broadcast(wanted), F.col("c_mktsegment") == F.col("name")).groupBy("place", "name").agg(F.count("*").alias("n"))


@query("select r.contig, r.qname, r.ref_start, round(r.tlen - m.mean, 6) as shifted from reads r cross join (select avg(tlen) as mean from reads) m")
def jn_15_global_stats(spark, sf_dir):
    r = view(spark, sf_dir, "reads")
    return r.crossJoin(F.broadcast(r.agg(F.avg("tlen").alias("mean")))).select("contig", "qname", "ref_start", F.round(F.col("tlen") - F.col("mean"), 6).alias("shifted"))


@query(f"""with beds as (select contig, start_pos, end_pos, 1 as bit from bed_a union all select contig, start_pos, end_pos, 2 from bed_b),
 m as ({_ISLANDS.format(t='beds', more=', bit_or(bit) as mask', tie=', bit')}) select k.mask::INT as mask, count(m.mask) as n, coalesce(sum(m.end_pos - m.start_pos), 0)::BIGINT as bases
 from (select unnest([1, 2, 3]) as mask) k left join m on m.mask = k.mask group by k.mask""")
def agg_18_label_masks(spark, sf_dir):
    return iv.label_masks([view(spark, sf_dir, "bed_a"), view(spark, sf_dir, "bed_b")])


@query("""select cand, label, min(idx) as first, max(idx) as last, count(*) as n from (
  select *, row_number() over (partition by cand order by idx) - row_number() over (partition by cand, label order by idx) as run from labels_seq) where label <> 0 group by cand, label, run""")
def win_01_label_runs(spark, sf_dir):
    return iv.runs(view(spark, sf_dir, "labels_seq"), ["cand"], "idx", "label").filter("label <> 0")


@query("""select chr, min(position) as first, max(position) as last, count(*) as n, max(score) as best from (
  select *, row_number() over (partition by chr order by position) - row_number() over (partition by chr, score > 40 order by position) as run from score_windows) where score > 40 group by chr, run having count(*) >= 2 and max(score) >= 70""")
def win_02_hysteresis(spark, sf_dir):
    from readlake.operators.windows import hysteresis

    return hysteresis(view(spark, sf_dir, "score_windows"), ["chr"], "position", "score", 40, 70, 2)
