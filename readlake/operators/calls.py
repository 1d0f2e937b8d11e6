"""Small-variant calls: annotation, filters, atomic alleles, strata of quality, cohorts and half calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from readlake.functions import variants as vf
from readlake.functions.reads import phred
from readlake.operators import intervals as iv

# The names of atomic changes by their number.
TYPES = ("ts", "tv", "mnp", "ins", "del")


def annotate(rows: DataFrame, beds: tuple[DataFrame, ...] = ()) -> DataFrame:
    """``rows`` (contig, pos from 1, ref, info, format, sample) with dp, ds (alternate reads on the rarer strand), ab (their
    percentage), fs (strand bias) and bed1 ... for each of ``beds``; null where the depths do not say."""
    d = vf.with_depths(rows)
    given = F.regexp_extract("info", r";FS=([^;\t]+)", 1).try_cast("double")
    # A test for each table of counts, not for each call.
    four = [F.col("_four")[i].alias(c) for i, c in enumerate(("_a", "_b", "_c", "_e"))]
    tables = d.select(*four).distinct().withColumn("_p", vf.fisher_tails("_a", "_b", "_c", "_e")["two"])
    both = d.join(tables, (F.col("_four")[0] == F.col("_a")) & (F.col("_four")[1] == F.col("_b")) & (F.col("_four")[2] == F.col("_c")) & (F.col("_four")[3] == F.col("_e")), "left")
    p = F.coalesce(F.pow(F.lit(10.0), -0.1 * given), F.col("_p"))
    ab = F.when(F.col("_alt").isNotNull(), F.when(F.col("_depth") == 0, 0).otherwise(F.floor(100 * F.col("_alt") / F.col("_depth") + 0.499)))
    out = both.select(*rows.columns, F.col("_depth").alias("dp"), F.least(F.col("_four")[2], F.col("_four")[3]).alias("ds"), ab.cast("bigint").alias("ab"), F.when(p.isNotNull(), phred(p)).alias("fs"))
    for i, bed in enumerate(beds, 1):
        at = out.withColumn("start_pos", F.col("pos") - 1).withColumn("end_pos", F.col("pos") - 1 + F.length("ref"))
        out = iv.overlap_join(at, bed, "flag").drop("start_pos", "end_pos").withColumn(f"bed{i}", F.col("hit").cast("int")).drop("hit")
    return out


def info_text(beds: int = 0) -> Column:
    """INFO with the annotation in front."""
    own = [F.concat(F.lit(f"_{c.upper()}="), F.col(c).cast("string")) for c in ("dp", "ds", "ab", "fs", *[f"bed{i + 1}" for i in range(beds)])]
    return F.concat_ws(";", *own, F.when(~F.col("info").isin(".", ""), F.col("info")))


def filters(annotated: DataFrame, beds: int = 0, min_qual: float = 30, min_dp: int = 3, coefficient: float = 4, max_fs: int = 30, min_ds: int = 1, min_ab: int = 30, min_ab_gap: int | None = None) -> DataFrame:
    """``annotated`` calls of ``min_qual`` and more with ``filter``: DPhigh (above the mean by ``coefficient`` of its root), DPlow,
    noDP, FShigh, DSlow (changed bases only), ABlow and BEDn, or a point. -1 as depth counts as low."""
    rows = annotated.filter(F.col("qual") >= min_qual)
    # No filter here: it would be pushed below the annotation, and take all of its text with it.
    mean = rows.agg(F.avg(F.when(F.col("dp") >= 0, F.col("dp"))).alias("_mean"))
    gap = F.exists(F.split("alt", ","), lambda a: F.length(a) != F.length("ref"))
    dp, least = F.col("dp"), F.when(gap, min_ab if min_ab_gap is None else min_ab_gap).otherwise(min_ab)
    flags = [F.when(dp > F.col("_mean") + coefficient * F.sqrt("_mean"), "DPhigh").when(dp < min_dp, "DPlow").when(dp.isNull(), "noDP"), F.when(F.col("fs") > max_fs, "FShigh"),
             F.when(~gap & (F.col("ds") < min_ds), "DSlow"), F.when(F.col("ab") < least, "ABlow"), *[F.when(F.col(f"bed{i + 1}") != 0, f"BED{i + 1}") for i in range(beds)]]
    text = F.concat_ws(";", *flags)
    return rows.crossJoin(F.broadcast(mean)).withColumn("filter", F.when(text == "", ".").otherwise(text)).drop("_mean")


def atomic(rows: DataFrame) -> DataFrame:
    """One row for each atomic change of calls (contig, pos from 1, ref, alt, qual, info, gt): contig, pos (from 0), qual, type,
    het, len, seq. Symbolic alleles and calls of two reference alleles are left out."""
    ref, alt = F.upper("ref"), F.upper("alt")
    cigars = F.split(F.regexp_extract("info", r"(?:^|;)CIGAR=([^;\t]+)", 1), ",")
    each = rows.filter(~F.coalesce(F.regexp_extract("gt", r"^0[/|]0", 0) != "", F.lit(False))).select("contig", "pos", "qual", ref.alias("ref"), vf.zygosity(F.col("gt"), F.col("info")).alias("het"), cigars.alias("_c"), F.posexplode(F.split(alt, ",")).alias("_i", "_alt"))
    each = each.filter(~F.col("_alt").rlike(r"^<\S+>")).withColumn("_a", vf.atoms(F.col("ref"), F.col("_alt"), F.col("pos") - 1, F.get("_c", F.col("_i"))))
    return each.select("contig", "qual", "het", F.inline("_a")).select("contig", "pos", "qual", "type", "het", "len", "seq")


def strata(changes: DataFrame, share: float = 0.02) -> DataFrame:
    """Bins of quality from the best down: a bin ends where it holds more than ``share`` of all changes and quality changes.

    qual (the last of the bin), total and n (running and own counts), and counts of each type by hom and het. One
    task walks the distinct qualities, not the changes."""
    known = changes.filter("het >= 0").withColumn("class", F.col("type") * 2 + F.col("het"))
    counts = known.groupBy("qual").agg(F.count("*").alias("n"), *[F.count_if(F.col("class") == i).alias(f"c{i}") for i in range(10)])
    levels = counts.withColumn("all", F.sum("n").over(Window.partitionBy())).select(F.col("qual").alias("q"), "n", "all", *[f"c{i}" for i in range(10)])
    walked = levels.agg(F.reverse(F.sort_array(F.collect_list(F.struct("q", "n", "all")))).alias("v")).select(F.explode(F.aggregate(
        "v", F.struct(F.array().cast("array<struct<q:double,bin:int>>").alias("out"), F.lit(0).alias("bin"), F.lit(0).cast("bigint").alias("n")),
        lambda s, x: F.struct(
            F.concat(s["out"], F.array(F.struct(x["q"].cast("double").alias("q"), F.when(s["n"] > share * x["all"], s["bin"] + 1).otherwise(s["bin"]).alias("bin")))).alias("out"),
            F.when(s["n"] > share * x["all"], s["bin"] + 1).otherwise(s["bin"]).alias("bin"), F.when(s["n"] > share * x["all"], x["n"]).otherwise(s["n"] + x["n"]).alias("n")), lambda s: s["out"])).alias("x")).select("x.*")
    bins = levels.withColumn("q", F.col("q").cast("double")).join(walked, "q").groupBy("bin").agg(F.min("q").alias("qual"), F.sum("n").alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(10)])
    name = lambda i: TYPES[i // 2] + ("_het" if i % 2 else "_hom")
    return bins.select("qual", F.sum("n").over(Window.orderBy("bin")).alias("total"), "n", *[F.col(f"c{i}").alias(name(i)) for i in range(10)])


def cohort(rows: DataFrame, samples: str = "samples", min_top: int = 10, no_call: float = 0.5) -> DataFrame:
    """``rows`` (alt; samples: array of GT:AD texts) with alleles and genotypes (counts), ad and top (sums and best depths of
    alleles) and ``flags`` (NONVAR, LOWAD, HIGHNC, or PASS). Genotype k of alleles lo <= hi is hi (hi + 1) / 2 + lo."""
    n = F.size(F.split("alt", ",")) + 1
    hap = lambda i: F.transform(samples, lambda s: F.regexp_extract(s, r"^(\.|\d+)[/|](\.|\d+)", i).try_cast("int"))
    one = rows.withColumns({"_n": n, "_h": F.arrays_zip(hap(1).alias("a"), hap(2).alias("b")), "_ad": F.transform(samples, lambda s: F.transform(F.split(F.split(s, ":")[1], ","), lambda x: x.try_cast("int")))})
    upto = lambda m: F.sequence(F.lit(0), m - 1)
    count = lambda k: F.size(F.filter("_h", lambda h: h["a"] == k)) + F.size(F.filter("_h", lambda h: h["b"] == k))
    place = lambda h: vf.genotype_index(h["a"], h["b"])
    depth = lambda k: F.transform("_ad", lambda v: F.coalesce(F.get(v, k), F.lit(0)))
    total = lambda v: F.aggregate(v, F.lit(0), lambda s, x: s + x)
    out = one.withColumns({
        "alleles": F.transform(upto(F.col("_n")), count),
        "genotypes": F.transform(upto((F.col("_n") * (F.col("_n") + 1) / 2).cast("int")), lambda k: F.size(F.filter("_h", lambda h: h["a"].isNotNull() & h["b"].isNotNull() & (place(h) == k)))),
        "ad": F.transform(upto(F.col("_n")), lambda k: total(depth(k))), "top": F.transform(upto(F.col("_n")), lambda k: F.array_max(depth(k)))})
    alts = lambda c: F.slice(c, 2, 1 << 20)
    flags = F.concat_ws(";", F.when(total(alts("alleles")) == 0, "NONVAR"), F.when(F.array_max(alts("top")) < min_top, "LOWAD"), F.when(total(F.col("alleles")) < 2 * F.size(samples) * no_call, "HIGHNC"))
    return out.withColumn("flags", F.when(flags == "", "PASS").otherwise(flags)).drop("_n", "_h", "_ad")


def merge_half_calls(rows: DataFrame) -> DataFrame:
    """Half calls (gt ./1 or 1/.) of (contig, pos from 1, ref, alt, gt) whose reference bases overlap those of the half call
    before them as one row with both alleles and 1/2; others stay.

    A held half call waits for the next row in order. Rows stand in islands of overlapping half calls next to each
    other, so the alternation within an island is all that is sequential."""
    order = ["pos", "ref", "alt", "gt"]
    w = Window.partitionBy("contig").orderBy(*order)
    half = F.col("gt").rlike(r"^(\.[/|]1|1[/|]\.)")
    own = rows.withColumn("_half", half).withColumn("_end", F.col("pos") + F.length("ref"))
    joins = F.col("_half") & F.coalesce(F.lag("_half").over(w), F.lit(False)) & (F.col("pos") < F.lag("_end").over(w))
    # Of a run of rows that each meet the one before, the second joins the first, the fourth the third where it still meets it.
    run = own.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    i = F.row_number().over(Window.partitionBy("contig", "_run").orderBy(*order))
    placed = run.withColumn("_pair", F.floor((i - 1) / 2))
    pairs = placed.groupBy("contig", "_run", "_pair").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("_v"))
    s, t = F.col("_v")[0], F.get("_v", F.lit(1))
    swap = t.isNotNull() & (s["pos"] == t["pos"]) & (F.length(s["ref"]) > F.length(t["ref"]))
    two = pairs.withColumn("_s", F.when(swap, t).otherwise(s)).withColumn("_t", F.when(swap, s).otherwise(t))
    shift = F.col("_t.pos") - F.col("_s.pos")
    right_n = shift + F.length("_t.ref") - F.length("_s.ref")
    right = F.when(right_n > 0, F.substr("_t.ref", (F.length("_t.ref") - right_n + 1).cast("int"), right_n.cast("int"))).otherwise("")
    # Where the first reaches beyond the second, the second's allele takes what is left of it.
    tail = F.when(right_n < 0, F.substr("_s.ref", (F.length("_s.ref") + right_n + 1).cast("int"), (-right_n).cast("int"))).otherwise("")
    left = F.substr("_s.ref", F.lit(1), shift.cast("int"))
    joined = F.struct(F.col("_s.pos").alias("pos"), F.concat(F.col("_s.ref"), right).alias("ref"), F.concat(F.col("_s.alt"), right, F.lit(","), left, F.col("_t.alt"), tail).alias("alt"), F.lit("1/2").alias("gt"))
    return two.withColumn("_x", F.when(t.isNull(), s).otherwise(joined)).select("contig", "_x.*")


def eligible(rows: DataFrame, least: int = 0, most: int = 1 << 30, most_hpl: int = 1 << 30) -> DataFrame:
    """contig, subs, gaps: calls (contig, pos, ref, alt, info) with an allele as long as the reference, and with an indel of
    ``least`` to ``most`` bases whose homopolymer run (HPL of INFO, a list by allele) is not above ``most_hpl``."""
    hpl = F.split(F.regexp_extract("info", r"\bHPL=([^\s;]+)", 1), ",")
    gap = lambda a: F.abs(F.length(a) - F.length("ref"))
    run = lambda i: F.coalesce(F.get(hpl, i).try_cast("int"), F.lit(0))
    alts = F.split("alt", ",")
    fits = F.exists(F.transform(alts, lambda a, i: (gap(a) > 0) & (gap(a) >= least) & (gap(a) <= most) & (run(i) <= most_hpl)), lambda x: x)
    return rows.groupBy("contig").agg(F.count_if(F.exists(alts, lambda a: gap(a) == 0)).alias("subs"), F.count_if(fits).alias("gaps"))


def het_errors(without: DataFrame, with_: DataFrame) -> DataFrame:
    """class (SNP, 1-bp, longer), fp and tp: changes with two alleles in a sample that can have none, and those of another sample less these."""
    kind = F.when(F.col("type") < 2, "SNP").when(F.abs("len") == 1, "1-bp").otherwise("longer")
    count = lambda df, n: df.filter("het = 1").groupBy(kind.alias("class")).agg(F.count("*").alias(n))
    both = count(without, "fp").join(count(with_, "_n"), "class", "full").select("class", F.coalesce("fp", F.lit(0)).alias("fp"), F.coalesce("_n", F.lit(0)).alias("_n"))
    return both.select("class", "fp", (F.col("_n") - F.col("fp")).alias("tp"))


def error_rates(truth: DataFrame, found: DataFrame, distance: int = 10) -> DataFrame:
    """tp, fn of true points (contig, pos), tp1, fp of calls, by whether the other side has a point within ``distance``; fnr and fdr in percent."""
    hits = lambda a, b, yes, no: iv.nearest(a, b, distance).agg(F.count_if("hit").alias(yes), F.count_if(~F.col("hit")).alias(no))
    both = hits(truth, found, "tp", "fn").crossJoin(F.broadcast(hits(found, truth, "tp1", "fp")))
    share = lambda a, b: F.round(100.0 * F.col(a) / (F.col(a) + F.col(b)), 6)
    return both.select("tp", "fn", "tp1", "fp", share("fn", "tp").alias("fnr"), share("fp", "tp1").alias("fdr"))


def with_runs(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """``rows`` (contig, pos from 1, ref, alt) with the homopolymer run of ``runs`` (key, run) where the inserted or deleted bases are all
    the same; 0 otherwise."""
    more = F.when(F.length("alt") > F.length("ref"), F.substr("alt", F.lit(2))).when(F.length("alt") < F.length("ref"), F.substr("ref", F.lit(2)))
    same = (more != "") & (more == F.repeat(F.substr(more, F.lit(1), F.lit(1)), F.length(more)))
    key = F.when(same, F.concat("contig", F.lit(":"), F.col("pos").cast("string"), F.substr(more, F.lit(1), F.lit(1))))
    return rows.withColumn("_key", key).join(runs.select(F.col("key").alias("_k"), "run"), F.col("_key") == F.col("_k"), "left").select(*rows.columns, F.coalesce("run", F.lit(0)).cast("bigint").alias("run"))
