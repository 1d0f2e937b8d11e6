"""Calls of several callers: depths, filters, atomic changes, strata, cohorts, half calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from readlake.functions import variants as vf
from readlake.operators import calls
from readlake.plans.registry import query
from readlake.sources.views import view


def _lchoose(n, k):
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


def _tails(tables: str) -> str:
    """Tables t(a, b, c, d) with the exact two-tailed, left and right probabilities."""
    return f"""tx as (select *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) as x from ({tables})),
 tp as (select a, b, c, d, x, exp({_lchoose('(a + b)', 'x')} + {_lchoose('(c + d)', '(a + c - x)')} - {_lchoose('(a + b + c + d)', '(a + c)')}) as p,
   exp({_lchoose('(a + b)', 'a')} + {_lchoose('(c + d)', 'c')} - {_lchoose('(a + b + c + d)', '(a + c)')}) as own from tx),
 fisher as (select a, b, c, d, least(1.0, sum(p) filter (where p <= own * (1 + 1e-7)))::DOUBLE as two, least(1.0, sum(p) filter (where x <= a))::DOUBLE as "left", least(1.0, sum(p) filter (where x >= a))::DOUBLE as "right" from tp group by a, b, c, d)"""


@query(f"""with {_tails("select distinct a, b, c, d from caller_rows")} select a, b, c, d, round(two, 6) as two, round("left", 6) as "left", round("right", 6) as "right" from fisher""")
def fn_01_fisher(spark, sf_dir):
    t = view(spark, sf_dir, "caller_rows").select("a", "b", "c", "d").distinct().withColumn("p", vf.fisher_tails("a", "b", "c", "d"))
    return t.select("a", "b", "c", "d", *[F.round(f"p.{x}", 6).alias(x) for x in ("two", "left", "right")])


_FOUR = """f as (select *, case when kind in (0, 2, 5) then a when kind = 4 then greatest(n - case when c + d >= a + b then c else a end, 0) end as w, case when kind in (0, 2, 5) then b when kind = 4 then greatest(n - case when c + d >= a + b then d else b end, 0) end as x,
  case when kind in (0, 2, 5) then c when kind = 4 then case when c + d >= a + b then c else a end end as y, case when kind in (0, 2, 5) then d when kind = 4 then case when c + d >= a + b then d else b end end as z from caller_rows),
 r as (select *, case when kind in (1, 3) then a else w + x end as refs, case kind when 1 then c when 3 then b + c else y + z end as alts from f)"""
_ANNO = f"""{_FOUR}, {_tails("select distinct w as a, x as b, y as c, z as d from r where w is not null")},
 p as (select r.*, coalesce(refs + alts, n) as dp, case when kind = 3 then pow(10, -0.1 * r.d) else fisher.two end as p from r left join fisher on fisher.a = r.w and fisher.b = r.x and fisher.c = r.y and fisher.d = r.z),
 anno as (select contig, pos, ref, alt, qual, dp::BIGINT as dp, least(y, z)::BIGINT as ds, (case when alts is not null then case when dp = 0 then 0 else floor(100.0 * alts / dp + 0.499) end end)::BIGINT as ab,
  (case when p is not null then case when p < 1e-10 then 0 else floor(-4.343 * ln(p) + 0.499) end end)::BIGINT as fs,
  (case when exists (select 1 from bed_a s where s.contig = p.contig and s.start_pos < pos - 1 + length(ref) and s.end_pos > pos - 1) then 1 else 0 end)::INT as bed1 from p)"""


def _annotated(spark, sf_dir):
    rows = view(spark, sf_dir, "caller_rows").select("contig", "pos", "ref", "alt", "qual", "info", "format", "sample")
    return calls.annotate(rows, (view(spark, sf_dir, "bed_a").select("contig", "start_pos", "end_pos"),))


@query(f"with {_ANNO} select contig, pos, dp, ds, ab, fs, bed1 from anno")
def prj_23_annotation(spark, sf_dir):
    return _annotated(spark, sf_dir).select("contig", "pos", "dp", "ds", "ab", "fs", "bed1")


@query(f"""with {_ANNO}, m as (select avg(dp) as mean from anno where qual >= 30 and dp >= 0), g as (select *, len(list_filter(string_split(alt, ','), lambda s: length(s) <> length(ref))) > 0 as gap from anno),
 t as (select contig, pos, concat_ws(';', case when dp > mean + 4 * sqrt(mean) then 'DPhigh' when dp < 3 then 'DPlow' end, case when fs > 30 then 'FShigh' end, case when not gap and ds < 1 then 'DSlow' end, case when ab < 30 then 'ABlow' end, case when bed1 = 1 then 'BED1' end) as x from g cross join m where qual >= 30)
 select contig, pos, case when x = '' then '.' else x end as filter from t""")
def flt_09_variant_filter(spark, sf_dir):
    return calls.filters(_annotated(spark, sf_dir), beds=1).select("contig", "pos", "filter")


_KIND = "case when u || v in ('AG', 'GA', 'CT', 'TC') then 0 else 1 end"
_ATOMS = f"""al as (select contig, pos - 1 as pos, qual, ref, unnest(string_split(alt, ',')) as alt, case when gt = './.' then 0 when gt = '0/1' then 1 else 0 end as het, kind from caller_rows),
 e as (select *, case when length(ref) >= 3 and length(alt) >= 3 and right(ref, 3) = right(alt, 3) then 3 when length(ref) >= 2 and length(alt) >= 2 and right(ref, 2) = right(alt, 2) then 2 when right(ref, 1) = right(alt, 1) then 1 else 0 end as e from al),
 s as (select *, least(length(ref), length(alt)) - e as m from e),
 st as (select *, length(alt) - length(ref) as gap, case when m >= 3 and left(ref, 3) = left(alt, 3) then 3 when m >= 2 and left(ref, 2) = left(alt, 2) then 2 when m >= 1 and left(ref, 1) = left(alt, 1) then 1 else 0 end as st from s),
 rest as (select *, st + greatest(-gap, 0) as rs, st + greatest(gap, 0) as a_s from st),
 j as (select *, unnest(range(0, length(ref) - rs)) as j from rest),
 uv as (select *, substring(ref, (rs + j + 1)::INT, 1) as u, substring(alt, (a_s + j + 1)::INT, 1) as v from j),
 atom as (select contig, pos + st as pos, qual, (case when gap > 0 then 3 else 4 end)::INT as type, het, gap::INT as len, case when gap > 0 then substring(alt, st + 1, gap) else substring(ref, st + 1, -gap) end as seq, kind from st where gap <> 0
  union all select contig, pos + rs + j, qual, ({_KIND})::INT, het, 0, '', kind from uv where u <> v)"""


def _changes(spark, sf_dir):
    return calls.atomic(view(spark, sf_dir, "caller_rows").select("contig", "pos", "ref", "alt", "qual", "info", "gt"))


@query(f"with {_ATOMS} select contig, pos, qual, type, het::INT as het, len, seq from atom")
def prj_20_atomic_alleles(spark, sf_dir):
    """Calls as single changed bases, insertions and deletions."""
    return _changes(spark, sf_dir)


_CLASSES = ", ".join(f"count(*) filter (where type = {i // 2} and het = {i % 2}) as c{i}" for i in range(10))
_NAMES = ", ".join(f"sum(c{i})::BIGINT as {calls.TYPES[i // 2]}_{'het' if i % 2 else 'hom'}" for i in range(10))


@query(f"""with recursive {_ATOMS}, lv as (select qual, count(*) as n, {_CLASSES}, row_number() over (order by qual desc) as i, sum(count(*)) over () as total from atom group by qual),
 w(i, bin, n) as (select i, 0, n from lv where i = 1 union all select lv.i, case when w.n > 0.02 * lv.total then w.bin + 1 else w.bin end, case when w.n > 0.02 * lv.total then lv.n else w.n + lv.n end from w join lv on lv.i = w.i + 1),
 b as (select w.bin, min(lv.qual)::DOUBLE as qual, sum(lv.n)::BIGINT as n, {_NAMES} from lv join w on w.i = lv.i group by w.bin)
 select * exclude (bin), sum(n) over (order by bin)::BIGINT as total from b""")
def agg_17_quality_strata(spark, sf_dir):
    return calls.strata(_changes(spark, sf_dir))


@query(r"""with s as (select contig, pos, len(string_split(alt, ',')) + 1 as m, unnest([s1, s2, s3]) as s from cohort), h as (select contig, pos, m, try_cast(regexp_extract(s, '^(\.|\d+)[/|](\.|\d+)', 1) as int) as a, try_cast(regexp_extract(s, '^(\.|\d+)[/|](\.|\d+)', 2) as int) as b, string_split(split_part(s, ':', 2), ',') as d from s),
 k as (select *, unnest(range(0, m)) as k from h), al as (select contig, pos, k, count(*) filter (where a = k) + count(*) filter (where b = k) as n, sum(coalesce(d[k + 1]::int, 0)) as ad, max(coalesce(d[k + 1]::int, 0)) as top from k group by contig, pos, k),
 g as (select *, unnest(range(0, m * (m + 1) // 2)) as g from h), gc as (select contig, pos, g, count(*) filter (where greatest(a, b) * (greatest(a, b) + 1) // 2 + least(a, b) = g and a is not null and b is not null) as n from g group by contig, pos, g),
 x as (select contig, pos, string_agg(n::varchar, ',' order by k) as ca, string_agg(ad::varchar, ',' order by k) as ad, string_agg(top::varchar, ',' order by k) as top, sum(n) filter (where k > 0) as alts, sum(n) as called, max(top) filter (where k > 0) as best from al group by contig, pos),
 y as (select contig, pos, string_agg(n::varchar, ',' order by g) as cg from gc group by contig, pos),
 z as (select x.contig, x.pos, ca, cg, ad, top, concat_ws(';', case when alts = 0 then 'NONVAR' end, case when best < 10 then 'LOWAD' end, case when called < 3 then 'HIGHNC' end) as f from x join y on y.contig = x.contig and y.pos = x.pos)
 select contig, pos, ca, cg, ad, top, case when f = '' then 'PASS' else f end as flags from z""")
def agg_09_genotype_counts(spark, sf_dir):
    """Alleles, genotypes and depths over samples, and the flags of a site."""
    c = calls.cohort(view(spark, sf_dir, "cohort").withColumn("samples", F.array("s1", "s2", "s3")))
    text = lambda n, a: F.array_join(F.transform(n, lambda x: x.cast("string")), ",").alias(a)
    return c.select("contig", "pos", text("alleles", "ca"), text("genotypes", "cg"), text("ad", "ad"), text("top", "top"), "flags")


_HALF = "select contig, (pos - 1) // 7 + 1 as pos, ref, split_part(alt, ',', 1) as alt, case when c < 9 then './1' when c < 14 then '1|.' else gt end as gt from caller_rows"


@query(f"""with recursive h as (select *, row_number() over (partition by contig order by pos, ref, alt, gt) as i, gt in ('./1', '1|.') as half, pos + length(ref) as past from ({_HALF})),
 w(contig, i, open, joined, past) as (select contig, i, half, false, past from h where i = 1 union all
  select h.contig, h.i, h.half and not (w.open and h.half and h.pos < w.past), w.open and h.half and h.pos < w.past, h.past from w join h on h.contig = w.contig and h.i = w.i + 1),
 r as (select h.*, w.joined, coalesce(lead(w.joined) over (partition by h.contig order by h.i), false) as taken from h join w on w.contig = h.contig and w.i = h.i),
 p as (select s.contig, s.pos as p, s.ref as r, s.alt as a, t.pos as q, t.ref as x, t.alt as b from r s join r t on t.contig = s.contig and t.i = s.i + 1 and t.joined),
 o as (select contig, case when p = q and length(r) > length(x) then {{q: p, r: x, a: b, x: r, b: a}} else {{q: q, r: r, a: a, x: x, b: b}} end as v, p from p),
 m as (select contig, p as pos, v.r as r, v.a as a, v.x as x, v.b as b, (v.q - p)::int as l, (v.q - p + length(v.x) - length(v.r))::int as k from o)
 select contig, pos, r || case when k > 0 then right(x, k) else '' end as ref, a || case when k > 0 then right(x, k) else '' end || ',' || left(r, l) || b || case when k < 0 then right(r, -k) else '' end as alt, '1/2' as gt from m
 union all select contig, pos, ref, alt, gt from r where not joined and not taken""")
def win_09_merge_half_calls(spark, sf_dir):
    one = F.split_part("alt", F.lit(","), F.lit(1))
    gt = F.when(F.col("c") < 9, "./1").when(F.col("c") < 14, "1|.").otherwise(F.col("gt"))
    return calls.merge_half_calls(view(spark, sf_dir, "caller_rows").select("contig", (F.floor((F.col("pos") - 1) / 7) + 1).alias("pos"), "ref", one.alias("alt"), gt.alias("gt")))


_LIKELY = "select contig, pos, kind, n, a, b, c, alt, case when kind % 2 = 0 then 'GT:PL' else 'DP:GL' end as format from caller_rows"


@query(r"""with x as (select contig, pos, (case kind % 2 when 0 then 1 else 0.5 end) as f, n, a, b, c, contains(alt, ',') as three, kind from caller_rows),
 v as (select contig, pos, kind, case when three then [n * f, a * f + 30, b * f, c * f + 30, 7 * f + 30, 9 * f] else [n * f, a * f + 30, b * f] end as v from x),
 s as (select contig, pos, kind, v, list_sort(v) as s from v)
 select contig, pos, case when kind = 7 then null else (['0/0', '0/1', '1/1', '0/2', '1/2', '2/2'])[list_position(v, s[1])] end as gt, (case when kind = 7 then null else floor(s[2] - s[1] + 0.499) end)::BIGINT as gq from s""")
def prj_22_genotype_quality(spark, sf_dir):
    """Genotypes and their quality from likelihoods, with a prior for two different alleles."""
    r = view(spark, sf_dir, "caller_rows")
    half = F.col("kind") % 2 == 1
    value = lambda c: F.when(half, (-(c * 0.05)).cast("string")).otherwise(c.cast("string"))
    some = [F.col("n"), F.col("a"), F.col("b"), F.col("c"), F.lit(7), F.lit(9)]
    three = F.contains("alt", F.lit(","))
    text = F.when(three, F.concat_ws(",", *[value(c) for c in some])).otherwise(F.concat_ws(",", *[value(c) for c in some[:3]]))
    fmt = F.when(F.col("kind") == 7, "GT:DP").when(half, "DP:GL").otherwise("GT:PL")
    sample = F.when(half, F.concat(F.lit("5:"), text)).otherwise(F.concat(F.lit("./.:"), text))
    return r.select("contig", "pos", vf.likely_genotype(fmt, sample, F.size(F.split("alt", ",")) + 1).alias("g")).select("contig", "pos", "g.gt", "g.gq")


@query("""with x as (select *, case kind % 4 when 0 then '0/1' when 1 then '2|2' when 2 then './.' else '.' end as g, case when kind >= 4 then 'FQ=' || (c - 9)::varchar end as fq from caller_rows)
 select contig, pos, (case kind % 4 when 0 then 0 when 1 then 2 end)::INT as a, (case kind % 4 when 0 then 1 when 1 then 2 end)::INT as b,
  (case kind % 4 when 0 then 1 when 1 then 0 else case when kind >= 4 then case when c - 9 > 0 then 1 else 0 end when kind % 4 = 2 then 0 else -1 end end)::INT as het from x""")
def prj_21_genotype(spark, sf_dir):
    gt = F.element_at(F.array(F.lit("0/1"), F.lit("2|2"), F.lit("./."), F.lit(".")), F.col("kind") % 4 + 1)
    info = F.when(F.col("kind") >= 4, F.concat(F.lit("DP=3;FQ="), (F.col("c") - 9).cast("string"))).otherwise("DP=3")
    r = view(spark, sf_dir, "caller_rows").withColumn("g", gt).withColumn("i", info)
    g = vf.genotype("g")
    return r.select("contig", "pos", g["a"].alias("a"), g["b"].alias("b"), vf.zygosity(F.col("g"), F.col("i")).alias("het"))


@query("""with x as (select *, unnest(string_split(alt, ',')) as one, unnest(range(0, len(string_split(alt, ',')))) as i from caller_rows),
 e as (select contig, pos, length(one) = length(ref) as sub, length(one) <> length(ref) and abs(length(one) - length(ref)) <= 1 and (i > 0 or kind = 0 or b <= 8) as gap from x)
 select contig, count(*) filter (where sub) as subs, count(*) filter (where gap) as gaps from (select contig, pos, bool_or(sub) as sub, bool_or(gap) as gap from e group by contig, pos) group by contig""")
def agg_23_eligible_counts(spark, sf_dir):
    """Calls with changed bases, and with short indels outside long homopolymers (HPL of INFO, one for each allele)."""
    r = view(spark, sf_dir, "caller_rows").withColumn("info", F.when(F.col("kind") == 0, "DP=1").otherwise(F.concat(F.lit("DP=1;HPL="), F.col("b").cast("string"), F.lit(",."))))
    return calls.eligible(r, 1, 1, 8)
