"""Grey levels, names of contigs, numbers as text, peaks with conflicts, errors of calls, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from readlake.functions import reads as fn, text
from readlake.operators import calls, intervals as iv, windows as win
from readlake.plans.call_queries import _ATOMS
from readlake.plans.registry import query
from readlake.sources import formats as fmt, sinks
from readlake.sources.views import table, view

_PILE = "case (qname + ref_start) % 5 when 0 then 'A' when 1 then 'C' when 2 then 'G' when 3 then 'T' else 'N' end"


@query(f"""with x as (select *, {_PILE} as base, ref_start % 41 as base_qual, (ref_start * 7) % 300 as gc, case when flag & 32 <> 0 then 0 else 1 end as pair, case when abs(tlen) > 700 then 1 when abs(tlen) < 260 then 2 else 0 end as ins from alignments)
 select contig, qname, flag, ref_start, case base when 'A' then 60 when 'T' then 120 when 'C' then 180 when 'G' then 240 else 0 end as c0, least(gc, 255)::INT as c1, case when flag & 2 <> 0 then 120 else 240 end as c2, least(255, mapq * 255 // 25)::INT as c3,
  case shape when 0 then 180 when 3 then 120 when 2 then 240 else 60 end as c4, least(255, base_qual * 255 // 40)::INT as c5, case pair when 0 then 80 else 240 end as c6, case when flag & 16 <> 0 then 120 else 240 end as c7, case ins when 1 then 240 when 2 then 160 else 80 end as c8,
  case when base = 'A' then 120 else 240 end as c9, (k * 8)::INT as c10, case when nm > 10 then 240 else 120 end as c11 from x""")
def prj_12_grey_levels(spark, sf_dir):
    """The twelve levels of a base of a pile."""
    r = view(spark, sf_dir, "alignments").withColumn("base", F.expr(_PILE)).withColumn("gc", F.col("ref_start") * 7 % 300).withColumn("ins", F.when(F.abs("tlen") > 700, 1).when(F.abs("tlen") < 260, 2).otherwise(0))
    op = F.when(F.col("shape") == 0, 2).when(F.col("shape") == 3, 1).when(F.col("shape") == 2, 4).otherwise(0)
    levels = fn.grey_levels("base", "gc", fn.bit("flag", 2), "mapq", F.lit(25), op, F.col("ref_start") % 41, F.when(fn.bit("flag", 32), "LR").otherwise("LLRR"), fn.bit("flag", 16), "ins", F.col("base") == "A", F.col("k") * 8, F.col("nm") > 10)
    return r.select("contig", "qname", "flag", "ref_start", *[c.cast("int").alias(f"c{i}") for i, c in enumerate(levels)])


_AT = "select contig, start_pos as pos, case start_pos % 4 when 0 then 'a' when 1 then 'n' when 2 then 'S' else 'e' end as base from bed_a"


@query(f"""select p.contig, p.pos, p.base, coalesce(substring(c.seq, (p.pos % 50 + 1)::INT, 1), 'N') as ref, p.base = coalesce(substring(c.seq, (p.pos % 50 + 1)::INT, 1), 'N') as same, upper(p.base) = upper(coalesce(substring(c.seq, (p.pos % 50 + 1)::INT, 1), 'N')) as same_letter
 from ({_AT}) p left join chunks c on c.contig = p.contig and c.chunk_id = p.pos // 50""")
def prj_13_equals_reference(spark, sf_dir):
    """Bases of reads against the reference, with and without regard to soft masking; N where there is none."""
    p = view(spark, sf_dir, "bed_a").select("contig", F.col("start_pos").alias("pos"), F.element_at(F.array(F.lit("a"), F.lit("n"), F.lit("S"), F.lit("e")), (F.col("start_pos") % 4 + 1).cast("int")).alias("base"))
    c = view(spark, sf_dir, "chunks").select("contig", F.col("chunk_id"), "seq")
    both = p.withColumn("chunk_id", F.floor(F.col("pos") / 50)).join(c, ["contig", "chunk_id"], "left").withColumn("ref", F.coalesce(F.substr("seq", (F.col("pos") % 50 + 1).cast("int"), F.lit(1)), F.lit("N")))
    return both.select("contig", "pos", "base", "ref", (F.col("base") == F.col("ref")).alias("same"), (F.upper("base") == F.upper("ref")).alias("same_letter"))


_NAMES = "select unnest(['chr1', '2', ' chrX ', 'MT', 'chrM', 'chrchr3', 'hs7', 'Y']) as name"


@query(f"""select name, upper(case when starts_with(trim(name), 'chr') then substring(trim(name), 4) else trim(name) end) as label, case name when 'chr1' then 'chr1' when '2' then 'chr2' when 'chrM' then 'chrM' end as listed,
 case name when 'chr1' then 'chr1' when '2' then 'chr2' when 'MT' then 'chrM' when 'chrM' then 'chrM' end as listed_mt, case when starts_with(name, 'chr') then name else 'chr' || name end as as_listed, replace(name, 'chr', '') as bare from ({_NAMES})""")
def prj_15_contig_alias(spark, sf_dir):
    """Five ways to bring names of contigs together; lists with chr1, chr2 and chrM."""
    names = spark.createDataFrame([(n,) for n in ("chr1", "2", " chrX ", "MT", "chrM", "chrchr3", "hs7", "Y")], "name string")
    return fmt.resolve_contigs(names, spark.createDataFrame([("chr1",), ("chr2",), ("chrM",)], "contig string"))


@query("""with x as (select event_id, value, (event_id * 7919) % 2000 * 100 + 7 as n from events)
 select event_id, case when n >= 1000 then format('{:,}', n) else n::VARCHAR end as commas, case when n * 100 >= 1000000 then printf('%.2fM', n * 100 / 1e6) when n * 100 >= 1000 then printf('%.1fk', n * 100 / 1e3) else (n * 100)::VARCHAR end as compact,
  case when n * 61 < 1024 then printf('%.1fB', (n * 61)::DOUBLE) when n * 61 < 1048576 then printf('%.1fKB', n * 61 / 1024.0::DOUBLE) else printf('%.1fMB', n * 61 / 1048576.0::DOUBLE) end as size,
  case when n >= 86400 then printf('%dd %02dh', n // 86400, n % 86400 // 3600) when n >= 3600 then printf('%dh %02dm', n // 3600, n % 3600 // 60) when n >= 60 then printf('%dm %02ds', n // 60, n % 60) else printf('%ds', n) end as duration,
  case when n >= 1000 then printf('%.1fk/s', n / 1e3) else printf('%.1f/s', n::DOUBLE) end as rate from x""")
def prj_31_human_numbers(spark, sf_dir):
    n = F.col("event_id") * 7919 % 2000 * 100 + 7
    return table(spark, sf_dir, "events").select("event_id", text.comma_count(n).alias("commas"), text.compact_count(n * 100).alias("compact"), text.size_text(n * 61).alias("size"), text.duration_text(n).alias("duration"), text.rate_text(n).alias("rate"))


@query("""with s as (select contig, pos, ref, unnest(string_split(alt, ',')) as alt, unnest(range(1, len(string_split(alt, ',')) + 1)) as i, [s1, s2, s3] as v from cohort), h as (select *, unnest(v) as x from s),
 a as (select *, regexp_extract(x, '^(\\.|\\d+)[/|](\\.|\\d+)', 1) as p, regexp_extract(x, '^(\\.|\\d+)[/|](\\.|\\d+)', 2) as q from h)
 select contig, pos - 1 as start_pos, pos - 1 + length(ref) as end_pos, alt, (count(*) filter (where p = i::VARCHAR) + count(*) filter (where q = i::VARCHAR))::BIGINT as alt_count, (count(*) filter (where p <> '.') + count(*) filter (where q <> '.'))::BIGINT as total from a group by contig, pos, ref, alt, i""")
def prj_26_unary_bed(spark, sf_dir):
    """A row for each allele of a site, with its count and that of all called alleles over samples."""
    c = calls.cohort(view(spark, sf_dir, "cohort").withColumn("samples", F.array("s1", "s2", "s3")))
    total = F.aggregate("alleles", F.lit(0), lambda a, x: a + x)
    each = c.select("contig", "pos", "ref", "alleles", total.alias("total"), F.posexplode(F.split("alt", ",")).alias("i", "one"))
    return each.select("contig", (F.col("pos") - 1).alias("start_pos"), (F.col("pos") - 1 + F.length("ref")).alias("end_pos"), F.col("one").alias("alt"), F.get("alleles", F.col("i") + 1).cast("bigint").alias("alt_count"), F.col("total").cast("bigint").alias("total"))


_SLICES = "select event_id // 20 as win, event_id % 20 as i, value / 100 as del, 1 - value / 100 as ins from events"


@query(f"""with s as ({_SLICES}), d as (select *, row_number() over (partition by win order by i) - row_number() over (partition by win, del > 0.40 order by i) as run, row_number() over (partition by win order by i) - row_number() over (partition by win, ins > 0.85 order by i) as jun from s),
 g as (select win, run, count(*) >= 2 and max(del) >= 0.70 as ok from d where del > 0.40 group by win, run),
 l as (select d.*, coalesce(g.ok, false) as gone from d left join g on g.win = d.win and g.run = d.run and d.del > 0.40),
 p as (select win, jun, count(*) as width, max(ins) as best, bool_or(gone) as conflict, arg_max(i, ins * 1e6 - i) as place from l where ins > 0.85 group by win, jun),
 k as (select win, place from p where width <= 10 and (not conflict or best > 0.92))
 select l.win, l.i, (case when k.place is not null then 2 when gone then 1 else 0 end)::INT as label from l left join k on k.win = l.win and k.place = l.i""")
def win_03_slice_labels(spark, sf_dir):
    """Labels of slices: deletions by hysteresis, insertions at the peaks of narrow runs, which need more where a deletion is."""
    s = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 20).alias("win"), (F.col("event_id") % 20).alias("i"), (F.col("value") / 100).alias("del"), (1 - F.col("value") / 100).alias("ins"))
    return win.slice_labels(s, ["win"], "i", "del", "ins")


_DOTS = "select contig, ref_start // 200 as win, (ref_start % 200)::INT as x, (qname % 256)::INT as y, (l % 12)::INT as channel from (select *, unnest([0, 1, 2, 3, 7, 10]) as l from reads)"


@query(f"select contig, win, (channel // 4)::INT as plane, (y + case when channel % 4 >= 2 then 511 - 2 * y else 0 end)::INT as y, (x + case when channel % 2 = 1 then 256 else 0 end)::INT as x from ({_DOTS})")
def win_05_tiled_channels(spark, sf_dir):
    """Pixels of twelve channels as three planes of two by two tiles, the lower two upside down."""
    dots = view(spark, sf_dir, "reads").select("contig", F.floor(F.col("ref_start") / 200).alias("win"), (F.col("ref_start") % 200).cast("int").alias("x"), (F.col("qname") % 256).cast("int").alias("y"), F.explode(F.array(*[F.lit(i) for i in (0, 1, 2, 3, 7, 10)])).alias("channel"))
    return win.tiled(dots).select("contig", "win", "plane", "y", "x")


@query("""with g as (select contig, pos, size, pos // 20 as bin from (select contig, ref_start + a as pos, b as size from alignments where shape < 2 and b > 20)), n as (select contig, bin, count(*) as n from g group by 1, 2), m as (select contig, arg_max(bin, n * 100000000 - bin) as bin, max(n) as support from n group by contig)
 select g.contig, floor(median(g.pos))::BIGINT as pos, floor(median(g.size))::BIGINT as size, any_value(m.support) as support from g join m on m.contig = g.contig and abs(g.bin - m.bin) <= 1 group by g.contig""")
def agg_19_mode_bin(spark, sf_dir):
    """Median place and size of long deletions around the fullest bin of 20 bases of each contig."""
    walk = F.filter(fn.cigar_walk("cigar", F.col("ref_start")), lambda s: (s["op"] == "D") & (s["n"] > 20))
    found = view(spark, sf_dir, "alignments").select("contig", F.inline(walk)).select("contig", F.col("ref_pos").alias("pos"), F.col("n").alias("size"))
    return iv.mode_bin(found, ["contig"], "pos", "size", 20)


def _het(name: str, where: str) -> str:
    return f"{name} as (select case when type < 2 then 'SNP' when abs(len) = 1 then '1-bp' else 'longer' end as class, count(*) as n from atom where het = 1 and {where} group by 1)"


@query(f"""with {_ATOMS}, {_het('x', 'kind % 2 = 0')}, {_het('y', 'kind % 2 = 1')}
 select coalesce(x.class, y.class) as class, coalesce(x.n, 0) as fp, coalesce(y.n, 0) - coalesce(x.n, 0) as tp from x full join y on x.class = y.class""")
def agg_22_het_counts(spark, sf_dir):
    """Two-allele calls of a sample that has none are errors; those of another, less these, are right."""
    r = view(spark, sf_dir, "caller_rows")
    one = lambda k: calls.atomic(r.filter(F.col("kind") % 2 == k).select("contig", "pos", "ref", "alt", "qual", "info", "gt"))
    return calls.het_errors(one(0), one(1))


@query("""with t as (select contig, start_pos as pos from bed_a), c as (select contig, end_pos + 5 as pos from bed_b), x as (select count(*) as n, count(*) filter (where exists (select 1 from c where c.contig = t.contig and abs(c.pos - t.pos) <= 10)) as tp from t),
 y as (select count(*) as n, count(*) filter (where exists (select 1 from t where t.contig = c.contig and abs(t.pos - c.pos) <= 10)) as tp1 from c)
 select x.tp, x.n - x.tp as fn, y.tp1, y.n - y.tp1 as fp, round(100.0 * (x.n - x.tp) / x.n, 6)::DOUBLE as fnr, round(100.0 * (y.n - y.tp1) / y.n, 6)::DOUBLE as fdr from x, y""")
def agg_24_error_rates(spark, sf_dir):
    """Shares of true points that no call is near, and of calls that no true point is near."""
    t = view(spark, sf_dir, "bed_a").select("contig", F.col("start_pos").alias("pos"))
    return calls.error_rates(t, view(spark, sf_dir, "bed_b").select("contig", (F.col("end_pos") + 5).alias("pos")), 10)


@query("""with h as (select contig, chunk_id * 7 + 1 as pos, substring('ACG', (chunk_id % 3 + 1)::INT, 1) as base, max(length(seq))::BIGINT as run from chunks group by 1, 2, 3),
 v as (select contig, pos, ref, split_part(alt, ',', 1) as alt from caller_rows), g as (select *, case when length(alt) > length(ref) then substring(alt, 2) when length(alt) < length(ref) then substring(ref, 2) end as more from v),
 k as (select *, case when more <> '' and more = repeat(left(more, 1), length(more)) then left(more, 1) end as base from g)
 select k.contig, k.pos, k.ref, k.alt, coalesce(h.run, 0) as run from k left join h on h.contig = k.contig and h.pos = k.pos and h.base = k.base""")
def jn_11_homopolymer_lookup(spark, sf_dir):
    """Indels of one repeated base with the run of that base at their place, from a table of runs as text."""
    c = view(spark, sf_dir, "chunks")
    lines = c.groupBy("contig", (F.col("chunk_id") * 7).alias("p"), F.substr(F.lit("ACG"), (F.col("chunk_id") % 3 + 1).cast("int"), F.lit(1)).alias("b")).agg(F.max(F.length("seq")).alias("n"))
    runs = fmt.parse_runs(lines.select(F.concat_ws("\t", "contig", F.col("p").cast("string"), (F.col("p") + F.col("n")).cast("string"), "b", F.col("n").cast("string")).alias("value")))
    v = view(spark, sf_dir, "caller_rows").select("contig", "pos", "ref", F.split_part("alt", F.lit(","), F.lit(1)).alias("alt"))
    return calls.with_runs(v, runs)


@query("select contig || ':' || (chunk_id * 50 + 1)::VARCHAR || upper(substring(seq, 1, 1)) as key, length(seq)::BIGINT as run from chunks")
def src_14_run_table(spark, sf_dir):
    """Homopolymer runs of BED text by place and base."""
    c = view(spark, sf_dir, "chunks")
    lines = c.select(F.concat_ws("\t", "contig", (F.col("chunk_id") * 50).cast("string"), (F.col("chunk_id") * 50 + F.length("seq")).cast("string"), F.upper(F.substr("seq", F.lit(1), F.lit(1))), F.length("seq").cast("string")).alias("value"))
    return fmt.parse_runs(lines).select("key", "run")


@query("""with f as (select o_orderkey % 50 as region, o_orderkey || case o_orderkey % 8 when 0 then '.unitig.fa' when 1 then '.ctg.fa' when 2 then '.mag.gz' when 3 then '.fa' when 4 then '.fasta' when 5 then '.pre.gz' when 6 then '.bam' else '.fq' end as name, o_custkey as t from orders)
 select region, count(*) filter (where name not like '%.bam' and name not like '%.fq') as outputs, min(name) filter (where name not like '%.bam' and name not like '%.fq') as first, arg_max(name, t * 100000000 + split_part(name, '.', 1)::BIGINT) as latest from f group by region""")
def src_21_assembly_outputs(spark, sf_dir):
    """Outputs of an assembly by their names, and the file that changed last."""
    ends = [".unitig.fa", ".ctg.fa", ".mag.gz", ".fa", ".fasta", ".pre.gz", ".bam", ".fq"]
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("region"), F.concat(F.col("o_orderkey").cast("string"), F.element_at(F.array(*[F.lit(e) for e in ends]), (F.col("o_orderkey") % 8 + 1).cast("int"))).alias("name"), "o_custkey", "o_orderkey")
    return sinks.assembly_outputs(o, ["region"], "name", F.struct("o_custkey", "o_orderkey"))


@query("select n_nationkey as cpus, (case when n_nationkey * 2 >= 32 then 4 when n_nationkey * 2 >= 24 then 3 when n_nationkey * 2 >= 12 then 2 else 1 end)::INT as workers, greatest(1, greatest(n_nationkey * 2, 1) // (case when n_nationkey * 2 >= 32 then 4 when n_nationkey * 2 >= 24 then 3 when n_nationkey * 2 >= 12 then 2 else 1 end))::INT as threads from nation")
def dec_06_parallelism(spark, sf_dir):
    """Workers and threads of stand-alone assemblies by the number of processors."""
    from readlake.operators.decide import parallelism

    n = table(spark, sf_dir, "nation")
    p = parallelism(F.col("n_nationkey") * 2)
    return n.select(F.col("n_nationkey").alias("cpus"), p[0].cast("int").alias("workers"), p[1].cast("int").alias("threads"))


@query("select contig, max(ref_end) as length, row_number() over (order by max(ref_end) desc, contig) as place from reads group by contig")
def top_03_longest_first(spark, sf_dir):
    """Contigs in the order in which they should start: the longest first."""
    from pyspark.sql import Window

    g = view(spark, sf_dir, "reads").groupBy("contig").agg(F.max("ref_end").alias("length"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("length"), "contig")).cast("bigint"))  # one row for each contig


@query("select chr as chrom, position as start_pos from score_windows")
def prj_33_batch_indexes(spark, sf_dir):
    """Places of windows from the four shapes in which batches name them: fields, a pair, text, and text with a range."""
    w = view(spark, sf_dir, "score_windows").withColumn("k", F.row_number().over(win.Window.partitionBy("chr").orderBy("position")) % 4)
    at = F.col("position").cast("string")
    shaped = w.select(F.when(F.col("k") == 0, F.concat("chr", F.lit(","), at)).when(F.col("k") == 1, F.concat(F.lit("('"), F.col("chr"), F.lit("', "), at, F.lit(")"))).when(F.col("k") == 2, F.concat("chr", F.lit(":"), at)).otherwise(F.concat("chr", F.lit(":"), at, F.lit("-"), (F.col("position") + 1000).cast("string"))).alias("index"))
    return fmt.batch_places(shaped, "index")


@query("select event_type as stage, count(*) as done, 'done ' || count(*)::VARCHAR || ' of ' || (count(*) * 2)::VARCHAR || ' [##########..........] 50.0%' as line from events group by event_type")
def snk_14_progress_lines(spark, sf_dir):
    """Lines of progress of stages."""
    g = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("done"))
    return g.select("stage", "done", sinks.progress_line(F.col("done"), F.col("done") * 2).alias("line"))


@query("select o_orderstatus as status, count(*) as n, true as reused from orders group by o_orderstatus")
def dec_09_reused_predictions(spark, sf_dir):
    """Of places where predictions may be, the first with the right columns is used."""
    good, bad = sinks.scratch(spark, "good"), sinks.scratch(spark, "bad")
    sinks.write_csv(table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")), good)
    sinks.write_csv(spark.range(3), bad)
    found = sinks.locate(spark, [bad + "-none", bad, good], {"status", "n"})
    return spark.read.schema("status string, n bigint").option("header", True).csv(found).withColumn("reused", F.lit(found == good))


@query("select r_name as name, r_regionkey % 2 = 1 as kept from region")
def dec_08_cleanup(spark, sf_dir):
    """Stale outputs are wiped before a stage starts; others stay."""
    paths = {r.r_name: (sinks.scratch(spark, "out"), r.r_regionkey % 2 == 1) for r in table(spark, sf_dir, "region").select("r_name", "r_regionkey").collect()}  # five rows, a fixed table
    for path, _ in paths.values():
        spark.range(1).write.parquet(path)
    sinks.wipe(spark, [path for path, keep in paths.values() if not keep])
    return spark.createDataFrame([(n, sinks.done(spark, path)) for n, (path, _) in paths.items()], "name string, kept boolean")


@query("select contig, coalesce(case when mapq > 40 then 1 end, 0)::INT as label, count(*) as n from reads where contig in ('chr1', 'chr3') group by 1, 2")
def src_11_block_scan(spark, sf_dir):
    """Written blocks of the contigs that are asked for under other names; a missing label is 0."""
    path = sinks.scratch(spark, "blocks")
    sinks.write_blocks(view(spark, sf_dir, "reads").withColumn("label", F.when(F.col("mapq") > 40, 1)), path)
    return fmt.read_blocks(spark, path, ["1", "chr3", "MT"]).groupBy("contig", F.coalesce("label", F.lit(0)).alias("label")).agg(F.count("*").alias("n"))


@query("select n_name as name from nation where n_name not in (select r_name from region where r_regionkey <> 2)")
def src_22_missing_files(spark, sf_dir):
    """Names that a bundle should have and its folder does not list."""
    path = sinks.scratch(spark, "bundle")
    table(spark, sf_dir, "region").filter("r_regionkey <> 2").select(F.lit("x").alias("value"), F.col("r_name").alias("name")).write.partitionBy("name").text(path)
    return sinks.missing(spark, table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), path)


@query(f"""with s as (select *, substring(repeat('ACGTTGCA', 40), 1, query_len::INT) as seq from alignments where contig = 'chr2' and ref_start < 900 and ref_end > 500)
 select unnest(['@' || qname::VARCHAR, seq, '+', repeat('I', length(seq))]) as value from s""")
def snk_10_region_records(spark, sf_dir):
    """Reads of a region written as four lines each, and the lines read again."""
    from readlake.operators import pileup

    r = pileup.overlapping(view(spark, sf_dir, "alignments"), "chr2", 500, 900).withColumn("seq", F.expr("substring(repeat('ACGTTGCA', 40), 1, cast(query_len as int))")).withColumn("q", F.expr("repeat('I', length(seq))"))
    path = sinks.scratch(spark, "fastq")
    r.select(sinks.fastq("qname", "seq", "q").alias("value")).write.text(path)
    return spark.read.text(path)


_PARTS = "select contig || ':' || (start_pos // 1000)::VARCHAR as region, start_pos::VARCHAR || '-' || end_pos::VARCHAR || '.fa' as name, any_value('>' || start_pos::VARCHAR) as content from bed_b group by 1, 2"


@query(f"select region, count(*) as files, sum(length(content))::BIGINT as bytes, string_agg(name, ',' order by name) as names from ({_PARTS}) group by region")
def snk_12_region_archives(spark, sf_dir):
    """An archive of each region's files with a manifest, written, and what is found in it when it is opened again."""
    b = view(spark, sf_dir, "bed_b").select(F.concat("contig", F.lit(":"), F.floor(F.col("start_pos") / 1000).cast("string")).alias("region"), F.concat(F.col("start_pos").cast("string"), F.lit("-"), F.col("end_pos").cast("string"), F.lit(".fa")).alias("name"), F.concat(F.lit(">"), F.col("start_pos").cast("string")).alias("content")).distinct()
    path = sinks.scratch(spark, "archives")
    sinks.archives(b).write.parquet(path)
    return sinks.archived(spark.read.parquet(path)).groupBy("region").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


_REGIONS = "select contig || ':' || (start_pos // 1000)::VARCHAR as region, sum(end_pos - start_pos)::BIGINT as bases from bed_b group by 1"


@query(f"select region, case when bases % 5 = 0 then 'cached' when bases < 30 then 'empty' when bases > 60 then 'oversized' else 'assembled' end as status from ({_REGIONS})")
def dec_07_region_status(spark, sf_dir):
    """What becomes of regions: known ones are reused, empty and oversized ones left out, the others' jobs run (here by a tool that does nothing)."""
    b = view(spark, sf_dir, "bed_b").withColumn("region", F.concat("contig", F.lit(":"), F.floor(F.col("start_pos") / 1000).cast("string")))
    r = b.groupBy("region").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("bases"))
    jobs = r.select("region", sinks.region_status(F.col("bases"), F.col("bases") % 5 == 0, 30, 60).alias("status"), sinks.job_text(F.col("region"), F.concat("region", F.lit(".fq"))).alias("job"))
    return sinks.run_jobs(jobs, "true")


_LABELLED = "with x as (select contig, (ref_start // 1000) * 1000 as start_pos, count(*) as n from reads group by 1, 2), l as (select x.*, (exists (select 1 from bed_b b where b.contig = x.contig and b.start_pos < x.start_pos + 1000 and b.end_pos > x.start_pos and b.start_pos % 7 < 2))::INT as label from x)"


@query(f"""{_LABELLED}, p as (select contig, count(*) filter (where label = 1) as pos from l group by contig), k as (select l.*, p.pos, row_number() over (partition by l.contig, label order by md5(l.contig || ':' || start_pos::VARCHAR)) as i from l join p on p.contig = l.contig)
 select contig, start_pos, n, label from k where i <= case when pos = 0 then 100 else pos end""")
def udf_07_labelled_windows(spark, sf_dir):
    """Windows labelled by what overlaps them, as many of each label in a contig."""
    from readlake.operators import models

    x = view(spark, sf_dir, "reads").groupBy("contig", (F.floor(F.col("ref_start") / 1000) * 1000).alias("start_pos")).agg(F.count("*").alias("n")).withColumn("end_pos", F.col("start_pos") + 1000)
    labelled = iv.overlap_join(x, view(spark, sf_dir, "bed_b").filter("start_pos % 7 < 2"), "flag").select("contig", "start_pos", "n", F.col("hit").cast("int").alias("label"))
    return models.balanced(labelled, ["contig"], "label", F.md5(F.concat("contig", F.lit(":"), F.col("start_pos").cast("string")))).select("contig", "start_pos", "n", "label")


@query("select n_name as name, n_nationkey % 3 < 2 as found from nation")
def udf_04_restored_weights(spark, sf_dir):
    """Weights under wrappers' prefixes by the names that a model wants, and which of these are missing."""
    from readlake.operators import models

    names = [(r.n_name, r.n_nationkey) for r in table(spark, sf_dir, "nation").select("n_name", "n_nationkey").collect()]  # 25 rows, a fixed table
    saved = {("module." if k % 3 else "module.model.") + n: k for n, k in names if k % 3 < 2}
    have, absent = models.restore(saved, [n for n, _ in names])
    return spark.createDataFrame([(n, n in have and n not in absent) for n, _ in names], "name string, found boolean")
