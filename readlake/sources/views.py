"""Read-, interval- and variant-shaped relations as projections of base tables.

Each text is SQL that Spark and other engines accept unchanged; ``{table}`` names its table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "reads": """
        select concat('chr', cast(l_suppkey % 5 + 1 as string)) as contig, l_orderkey * 8 + l_linenumber as qname,
               l_partkey * 10 + l_linenumber as ref_start,
               l_partkey * 10 + l_linenumber + 2 * cast(l_quantity as bigint) + cast(round(l_discount * 100) as bigint) + 1 as ref_end,
               cast(l_quantity as int) + 10 as mapq,
               16 * (l_linenumber % 2) + (case when l_returnflag = 'N' then 2 else 0 end) + (case when l_linenumber = 7 then 256 else 0 end) as flag,
               200 + 60 * cast(round(l_tax * 100) as bigint) as tlen,
               concat(cast(l_linenumber as string), 'S', cast(cast(l_quantity as int) as string), 'M', cast(cast(round(l_discount * 100) as int) + 1 as string), 'D', cast(cast(l_quantity as int) as string), 'M') as cigar,
               concat(cast(cast(l_quantity as int) as string), '^', repeat('A', cast(round(l_discount * 100) as int) + 1), cast(cast(l_quantity as int) as string)) as md
        from {lineitem}""",
    # Reads with mates, all flag bits, mismatches and four shapes of CIGAR text: a matched bases, k clipped, b deleted or inserted.
    "alignments": """
        select contig, qname, flag, ref_start, ref_start + (case shape when 0 then 2 * a + b when 1 then 2 * a + b when 2 then a else 2 * a end) as ref_end, mapq, a, b, k, shape,
               case when flag & 1 = 0 then 0 when flag & 16 <> 0 then -size else size end as tlen,
               case when l_suppkey % 11 = 0 then concat('chr', cast((l_suppkey + 1) % 5 + 1 as string)) else contig end as mate_contig,
               case when flag & 16 <> 0 then ref_start - size + 100 else ref_start + size - 100 end as mate_start,
               (case shape when 0 then 2 * a when 1 then 2 * a + k when 2 then a + k else 2 * a + b end) as query_len, (case when shape < 2 then b + 1 when shape = 3 then b + 1 else 1 end) as nm,
               case shape when 0 then concat(cast(a as string), 'M', cast(b as string), 'D', cast(a as string), 'M') when 1 then concat(cast(k as string), 'S', cast(a as string), 'M', cast(b as string), 'D', cast(a as string), 'M')
                          when 2 then concat(cast(a as string), 'M', cast(k as string), 'S') else concat(cast(a as string), 'M', cast(b as string), 'I', cast(a as string), 'M') end as cigar,
               case when shape < 2 then concat(cast(a - 1 as string), 'C0^', repeat('A', cast(b as int)), cast(a as string)) when shape = 2 then concat(cast(a - 1 as string), 'G0') else concat(cast(a as string), 'T', cast(a - 1 as string)) end as md
        from (select concat('chr', cast(l_suppkey % 5 + 1 as string)) as contig, l_orderkey * 4 + cast(floor(l_linenumber / 2) as bigint) as qname, l_partkey * 10 + l_linenumber as ref_start, l_suppkey,
                     cast(l_quantity as bigint) as a, cast(round(l_discount * 100) as bigint) * 5 + 1 as b, cast(l_linenumber as bigint) * 4 as k, cast((l_orderkey + l_linenumber) % 4 as int) as shape, cast(l_quantity as int) % 45 + 3 as mapq,
                     200 + 60 * cast(round(l_tax * 100) as bigint) + (case when cast(l_quantity as int) > 47 then 2500 else 0 end) as size,
                     (case when l_returnflag = 'R' then 0 else 1 end) + (case when l_returnflag = 'N' then 2 else 0 end) + (case when l_partkey % 41 = 0 then 4 else 0 end) + (case when l_suppkey % 37 = 0 then 8 else 0 end)
                     + (case when l_linenumber % 2 = 0 then 32 else 16 end) + (case when l_orderkey % 2 = 0 then 64 else 128 end) + (case when l_linenumber = 7 then 256 else 0 end) + (case when l_orderkey % 29 = 0 then 1024 else 0 end)
                     + (case when l_partkey % 43 = 0 then 2048 else 0 end) as flag
              from {lineitem}) x""",
    "calls": "select p_partkey as call_id, concat('chr', cast(p_partkey % 5 + 1 as string)) as contig, p_partkey * 10 as start_pos, p_partkey * 10 + 60 + p_size * 5 as end_pos, case when p_size % 2 = 0 then 'DEL' else 'INS' end as svtype from {part}",
    # Calls of five kinds of callers, whose depths stand in different fields.
    "caller_rows": """
        select contig, pos, ref, alt, qual, kind, a, b, c, d, n,
               case kind when 0 then concat('DP=', n, ';DP4=', a, ',', b, ',', c, ',', d) when 1 then concat('DP=', n, ';CGDP2=', a, ',', c) when 2 then concat('SRF=', a, ';SRR=', b, ';SAF=', c, ';SAR=', d)
                         when 3 then concat('DP=', n, ';FS=', d) when 4 then concat('NF=', c, ',', a, ';NR=', d, ',', b, ';TCF=', n, ';TCR=', n) else concat('DP=', n) end as info,
               case kind when 3 then 'GT:AD' when 5 then 'GT:ADF:ADR' when 6 then 'GT:DP' else 'GT' end as format,
               concat(gt, case kind when 3 then concat(':', a, ',', b, ',', c) when 5 then concat(':', a, ',', c, ':', b, ',', d) when 6 then concat(':', n) else '' end) as sample, gt
        from (select concat('chr', cast(o_custkey % 5 + 1 as string)) as contig, o_orderkey * 7 + 1 as pos, substring('ACGTACGT', cast(o_custkey % 4 + 1 as int), cast(o_custkey % 3 + 1 as int)) as ref,
                     concat(substring('AGGCATCA', cast(o_orderkey % 4 + 1 as int), cast(o_orderkey % 3 + 1 as int)), case when o_orderkey % 7 = 0 then ',T' else '' end) as alt,
                     cast(round(o_totalprice / 2000) as bigint) as qual, cast(o_orderkey % 8 as int) as kind, cast(o_custkey % 60 as int) as n, cast(o_custkey % 23 as int) as a, cast(o_custkey % 17 as int) as b, cast(o_orderkey % 19 as int) as c,
                     cast(o_orderkey % 13 as int) as d, case o_orderstatus when 'F' then '0/1' when 'O' then '1/1' else './.' end as gt
              from {orders}) x""",
    "cohort": """
        select concat('chr', cast(o_custkey % 5 + 1 as string)) as contig, o_orderkey * 7 + 1 as pos, 'A' as ref, case when o_orderkey % 5 = 0 then 'C,G' else 'C' end as alt,
               concat(case o_custkey % 4 when 0 then '0/0' when 1 then '0/1' when 2 then './.' else '1|0' end, ':', cast(o_custkey % 19 as string), ',', cast(o_orderkey % 9 as string), case when o_orderkey % 5 = 0 then ',3' else '' end) as s1,
               concat(case when o_orderkey % 5 = 0 then '1/2' when o_custkey % 7 = 0 then '1/1' else '0/0' end, ':', cast(o_custkey % 13 as string), ',', cast(o_orderkey % 16 as string), case when o_orderkey % 5 = 0 then ',0' else '' end) as s2,
               concat(case o_orderkey % 3 when 0 then './.' when 1 then './1' else '0/0' end, ':', cast(o_custkey % 5 as string), ',', cast(o_orderkey % 7 as string), case when o_orderkey % 5 = 0 then ',5' else '' end) as s3
        from {orders}""",
    "labels_seq": "select user_id as cand, event_id as idx, case when event_type = 'error' then 1 when event_type = 'purchase' then 2 else 0 end as label from {events}",
    "score_windows": "select concat('chr', cast(user_id % 5 + 1 as string)) as chr, event_id * 1000 as position, value as score from {events}",
    "bed_a": """
        select concat('chr', cast(o_custkey % 5 + 1 as string)) as contig, o_orderkey * 3 as start_pos, o_orderkey * 3 + o_custkey % 40 + 1 as end_pos,
               cast(round(o_totalprice) as bigint) as qual from {orders}""",
    "bed_b": """
        select concat('chr', cast(l_suppkey % 4 + 1 as string)) as contig, l_orderkey * 3 + 1 as start_pos, l_orderkey * 3 + 1 + cast(l_quantity as bigint) as end_pos
        from {lineitem} where l_linenumber = 1""",
    "variants": """
        select concat('chr', cast(o_custkey % 5 + 1 as string)) as contig, o_orderkey * 7 + 1 as pos, 1 + o_custkey % 4 as ref_len, 1 + o_orderkey % 3 as alt_len,
               cast(round(o_totalprice / 5000) as bigint) as qual, case o_orderstatus when 'F' then '0/1' when 'O' then '1/1' else './.' end as gt,
               concat('DP=', cast(o_custkey % 60 as string), ';DP4=', cast(o_custkey % 23 as string), ',', cast(o_custkey % 17 as string), ',', cast(o_orderkey % 19 as string), ',', cast(o_orderkey % 13 as string)) as info
        from {orders}""",
    "evidence": """
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, case l_returnflag when 'R' then 'VERIFIED' when 'A' then 'REF' else 'AMBIGUOUS' end as asm_status,
               cast(l_quantity as bigint) % 9 as raw_support, 20 + l_partkey % 80 as raw_depth, l_linenumber % 5 as rp_abnormal, 10 + l_suppkey % 50 as rp_total
        from {lineitem}""",
    "texts": "select doc_id, lower(text) as seq from {documents} where length(text) > 0",
    "chunks": "select concat('chr', cast(p_partkey % 5 + 1 as string)) as contig, p_partkey as chunk_id, substring(concat(replace(lower(p_name), ' ', ''), repeat('n', 50)), 1, 50) as seq from {part}",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection over the tables of a folder."""
    text = VIEWS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text))})


def with_views(sql: str) -> str:
    """``sql`` with the projections that it names as common table expressions."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    ctes = ", ".join(f"{v} as ({re.sub(r'[{}]', '', VIEWS[v])})" for v in used)
    if not used:
        return sql
    head = re.match(r"\s*with\s+(recursive\s+)?", sql, re.I)
    return f"with {head[1] or ''}{ctes}, {sql[head.end():]}" if head else f"with {ctes} {sql}"
