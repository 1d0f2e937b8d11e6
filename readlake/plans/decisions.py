"""Decisions, sinks of calls, and the streaming form."""

from __future__ import annotations

from pyspark.sql import functions as F

from readlake.operators import decide
from readlake.plans.registry import query
from readlake.sources.views import table, view

_EV = "select *, raw_support / raw_depth::DOUBLE as vaf, rp_abnormal / rp_total::DOUBLE as ratio, greatest(0.065, least(0.12, 0.002 * raw_depth)) as adaptive from evidence"


@query(f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey, raw_support, case asm_status when 'VERIFIED' then not (raw_support < 1 and rp_abnormal < 1) when 'REF' then vaf >= 0.10 and raw_support >= 5
  else (vaf >= adaptive and raw_support >= 5) or (ratio >= 0.08 and rp_abnormal >= 3) or (vaf >= 0.045 and raw_support >= 3 and ratio >= 0.045 and rp_abnormal >= 2) end as keep from ({_EV})""")
def dec_01_verdict(spark, sf_dir):
    e = view(spark, sf_dir, "evidence")
    keep = decide.verdict(*[F.col(c) for c in ("asm_status", "raw_support", "raw_depth", "rp_abnormal", "rp_total")])
    return e.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "raw_support", keep.alias("keep"))


_LEN = "select contig, pos, case when qual % 3 = 0 then ref_len * 100 end as sr, case when qual % 2 = 0 then alt_len * 90 end as dp, ref_len as known from variants"



@query("select contig, start_pos, (case when qual % 2 = 0 then 'DEL' else 'INS' end) as svtype, (case when qual % 2 = 0 then start_pos - end_pos else greatest(end_pos - start_pos, 50) end)::BIGINT as svlen, (case when qual % 2 = 0 then end_pos else start_pos + 1 end)::BIGINT as stop from bed_a")
def dec_03_call_fields(spark, sf_dir):
    gone = F.col("qual") % 2 == 0
    n = F.col("end_pos") - F.col("start_pos")
    return view(spark, sf_dir, "bed_a").select("contig", "start_pos", F.when(gone, "DEL").otherwise("INS").alias("svtype"), F.when(gone, -n).otherwise(F.greatest(n, F.lit(50))).alias("svlen"), F.when(gone, F.col("end_pos")).otherwise(F.col("start_pos") + 1).alias("stop"))



@query("with r as (select o_orderkey as idx, o_custkey % 40 as found from orders where o_custkey % 3 = 0) select o.o_orderkey as idx, r.found from orders o left join r on r.idx = o.o_orderkey")
def jn_12_refined_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    r = o.filter("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("idx"), (F.col("o_custkey") % 40).alias("found"))
    return o.select(F.col("o_orderkey").alias("idx")).join(r, "idx", "left")



@query("select event_type, date_trunc('hour', ts) as hour, count(*) as n from events group by 1, 2")
def str_01_event_hours(spark, sf_dir):
    """The batch form of the streaming window count."""
    from readlake.streaming.windows import hourly

    return hourly(table(spark, sf_dir, "events")).select("event_type", "hour", "n")
