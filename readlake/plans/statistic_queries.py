"""Aggregates, samples and model operators."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from readlake.functions import reads as fn
from readlake.operators import models, stats, windows as win
from readlake.plans.registry import query
from readlake.sources.views import table, view


@query("select l_quantity::BIGINT as value, count(*) as n from lineitem group by 1")
def agg_16_histogram(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("value")).agg(F.count("*").alias("n"))


@query("""with q as (select contig, ref_start as v, lag(ref_start) over (partition by contig order by ref_start) as before from reads), m as (select contig, v, sum(case when v - before <= 3 then 0 else 1 end) over (partition by contig order by v rows unbounded preceding) as c from q),
 g as (select contig, c, count(*) as n, median(v) as mid from m group by contig, c), b as (select contig, arg_max(mid, n * 1000000000 - c) as mid, max(n) as n, sum(n) as total from g group by contig)
 select contig, mid, n from b where n > 1 or total <= 3""")
def agg_15_largest_cluster(spark, sf_dir):
    return stats.largest_cluster(view(spark, sf_dir, "reads"), ["contig"], "ref_start")



@query("""with x as (select (case when value > 50 then 1 else 0 end)::INT as p, (case when event_type = 'error' then 1 else 0 end)::INT as t from events),
 m as (select c.c as class, count(*) filter (where t = c.c and p = c.c) as tp, count(*) filter (where t = c.c) as nt, count(*) filter (where p = c.c) as np from x, (select unnest([0, 1]) as c) c group by c.c)
 select class::INT as class, round(coalesce(tp / nullif(np, 0)::DOUBLE, 0), 6) as precision, round(tp / nt::DOUBLE, 6) as recall, round(coalesce(2.0 * tp / nullif(nt + np, 0), 0)::DOUBLE, 6) as f1 from m""")
def agg_20_class_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("value") > 50, 1).otherwise(0).alias("p"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("t"))
    return stats.class_metrics(e, "t", "p")


@query("""with x as (select least(value, 99.5) / 100 as s, (case when event_type = 'error' then 1 else 0 end)::INT as t from events), g as (select i / 100.0::DOUBLE as th, i from range(1, 100) r(i)),
 m as (select i, round(0.5 * (count(*) filter (where t = 1 and floor(s * 100) >= i) / (select count(*) from x where t = 1)::DOUBLE + 1 - count(*) filter (where t = 0 and floor(s * 100) >= i) / (select count(*) from x where t = 0)::DOUBLE), 9) as metric from g cross join x group by i)
 select (arg_max(i, metric * 1e6 - i * 1e-5) / 100.0)::DOUBLE as threshold, max(metric) as metric from m""")
def agg_21_threshold_search(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.least("value", F.lit(99.5)) / 100).alias("s"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("t"))
    return stats.best_threshold(e, "s", "t")



@query("select event_type as status, count(*) as n from events group by event_type")
def agg_25_status_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


@query("select decision, count(*) as n from (select case when raw_support >= 5 then 'KEEP' else 'DROP' end as decision from evidence) group by decision")
def agg_14_run_summary(spark, sf_dir):
    return view(spark, sf_dir, "evidence").groupBy(F.when(F.col("raw_support") >= 5, "KEEP").otherwise("DROP").alias("decision")).agg(F.count("*").alias("n"))



_SCORES = "select event_id, value / 100 as a, (event_id % 7) / 7.0::DOUBLE as b, (user_id % 5) / 5.0::DOUBLE as c from events"


@query(f"select event_id, round(exp(a) / (exp(a) + exp(b) + exp(c)), 6) as p0, round(exp(b) / (exp(a) + exp(b) + exp(c)), 6) as p1, round(exp(c) / (exp(a) + exp(b) + exp(c)), 6) as p2 from ({_SCORES})")
def fn_03_softmax(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 100).alias("a"), (F.col("event_id") % 7 / 7.0).alias("b"), (F.col("user_id") % 5 / 5.0).alias("c"))
    return e.select("event_id", *[F.round(p, 6).alias(f"p{i}") for i, p in enumerate(fn.softmax(["a", "b", "c"]))])


_K = win.gaussian(0.6)


@query(f"""with s as (select event_id // 20 as win, event_id % 20 as i, value as v from events), n as (select win, count(*) as n from s group by win),
 x as (select s.win, s.i, s.v, k.k, k.w, case when s.i + k.k < 0 then -(s.i + k.k) - 1 when s.i + k.k >= n.n then 2 * n.n - 1 - (s.i + k.k) else s.i + k.k end as j from s join n using (win), (select unnest([-2, -1, 0, 1, 2]) as k, unnest([{_K[2]!r}, {_K[1]!r}, {_K[0]!r}, {_K[1]!r}, {_K[2]!r}]) as w) k)
 select x.win, x.i, round(sum(x.w * t.v), 6) as v from x join s t on t.win = x.win and t.i = x.j group by x.win, x.i""")
def fn_04_smoothing(spark, sf_dir):
    s = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 20).alias("win"), (F.col("event_id") % 20).alias("i"), F.col("value").alias("v"))
    return s.select("win", "i", F.round(win.smooth(s, ["win"], "i", "v", 0.6), 6).alias("v"))


@query("select chr, position, rank() over (partition by chr order by score) + (count(*) over (partition by chr, score) - 1) / 2.0::DOUBLE as r from score_windows")
def win_10_average_rank(spark, sf_dir):
    return view(spark, sf_dir, "score_windows").select("chr", "position", win.average_rank(["chr"], "score").alias("r"))



@query("select contig, ref_start // 200 as win, qname, ref_start, mapq, i from (select *, row_number() over (partition by contig, ref_start // 200 order by mapq desc, qname, ref_start, tlen, ref_end) as i from reads) where i <= 18")
def top_04_rows_per_window(spark, sf_dir):
    r = view(spark, sf_dir, "reads").withColumn("win", F.floor(F.col("ref_start") / 200))
    i = F.row_number().over(Window.partitionBy("contig", "win").orderBy(F.desc("mapq"), "qname", "ref_start", "tlen", "ref_end"))
    return r.withColumn("i", i.cast("long")).filter("i <= 18").select("contig", "win", "qname", "ref_start", "mapq", "i")


@query("select event_type, arg_max(user_id, n * 1000000 - user_id) as user_id, max(n) as n from (select event_type, user_id, count(*) as n from events group by 1, 2) group by event_type")
def top_05_largest_group(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return g.groupBy("event_type").agg(F.max_by("user_id", F.struct(F.col("n"), -F.col("user_id"))).alias("user_id"), F.max("n").alias("n"))


@query("select contig, start_pos, end_pos, qual, dense_rank() over (order by regexp_replace(contig, '^chr', '')::INT, start_pos) as place from bed_a")
def srt_01_contig_order(spark, sf_dir):
    return stats.ranked_by_contig(view(spark, sf_dir, "bed_a"), "start_pos")


@query("select contig, ref_start, qname, mapq from reads")
def srt_02_coordinate_sort(spark, sf_dir):
    return view(spark, sf_dir, "reads").repartitionByRange("contig", "ref_start").sortWithinPartitions("contig", "ref_start").select("contig", "ref_start", "qname", "mapq")



_SAMPLED = "select user_id % 10 as file, (case when event_type = 'error' then 1 else 0 end)::INT as label, event_id, md5(event_id::VARCHAR) as h from events"


@query(f"""with x as ({_SAMPLED}), n as (select file, count(*) filter (where label = 1) as pos from x group by file), k as (select x.*, n.pos, row_number() over (partition by x.file, label order by h) as i from x join n using (file))
 select file, label, event_id from k where i <= case when pos = 0 then 100 else pos end""")
def smp_01_balanced_sample(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("file"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"), "event_id")
    return models.balanced(e, ["file"], "label", F.md5(F.col("event_id").cast("string"))).select("file", "label", "event_id")


@query("""with x as (select event_id, event_type = 'error' as y, greatest(1e-6, least(1 - 1e-6, value / 500)) as p from events), t as (select *, case when y then p else 1 - p end as pt from x)
 select event_id, round(-(case when y then 0.20 else 0.80 end)::DOUBLE * pow(1 - pt, 2) * ln(pt), 6) as loss from t""")
def udf_05_focal_loss(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 500).alias("p"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y"))
    return e.select("event_id", F.round(fn.focal_loss("p", "y"), 6).alias("loss"))


@query()
def udf_01_window_scorer(spark, sf_dir):
    """Windows of nine channels by the network, with weights from a seed."""
    from readlake.operators import networks, pileup

    order = [(-F.col("mapq")).alias("mapq"), "qname", "ref_start", "ref_end", "tlen", "cigar"]
    return pileup.score_sites(view(spark, sf_dir, "reads"), order, 20, networks.WindowNet.initial(filters=16, dense=32, reduction=4), [1.0] * 9)


@query()
def udf_06_parameter_search(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("value") / 100).alias("x"), F.when(F.col("event_type") == "error", 1.0).otherwise(0.0).alias("y"))
    return models.grid_search(e, [0.01, 0.1, 0.5], [0.0, 0.01])
