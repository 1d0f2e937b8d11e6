"""Text formats as relations: alignment headers, candidate tables, VCF, BED, FASTA, SAM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def header_contigs(lines: DataFrame) -> DataFrame:
    """contig, length of the @SQ lines of a header."""
    field = lambda k: F.regexp_extract("value", rf"(?:^|\t){k}:([^\t]*)", 1)
    return lines.filter(F.col("value").startswith("@SQ")).select(field("SN").alias("contig"), field("LN").cast("long").alias("length"))


def resolve_contigs(names: DataFrame, listed: DataFrame) -> DataFrame:
    """``name`` by five rules: label (blanks and a leading chr gone, upper case), listed (as in ``listed`` (contig), with or without
    chr), listed_mt (the same, M and MT as one), as_listed (with chr if the list has such names) and bare (every chr gone).

    The list is a small dimension; null where it has no such name."""
    strip = lambda c: F.when(c.startswith("chr"), F.substr(c, F.lit(4))).otherwise(c)
    plain, trimmed = strip(F.col("name")), F.trim("name")
    one = lambda c: F.when(c.isin("M", "MT"), "M").otherwise(c)
    have = listed.select(F.col("contig").alias("listed"), strip(F.col("contig")).alias("_p"), F.lit(True).alias("_has"))
    by = lambda df, key, name: df.groupBy(key.alias("_k")).agg(F.min("listed").alias(name))
    style = have.agg(F.bool_or(F.col("listed").startswith("chr")).alias("_chr"))
    out = names.withColumn("_a", plain).withColumn("_b", one(plain)).join(F.broadcast(by(have, F.col("_p"), "listed")), F.col("_a") == F.col("_k"), "left").drop("_k")
    out = out.join(F.broadcast(by(have, one(F.col("_p")), "listed_mt")), F.col("_b") == F.col("_k"), "left").crossJoin(F.broadcast(style))
    as_listed = F.when(F.col("_chr") & ~F.col("name").startswith("chr"), F.concat(F.lit("chr"), "name")).when(~F.col("_chr"), plain).otherwise(F.col("name"))
    return out.select("name", F.upper(strip(trimmed)).alias("label"), "listed", "listed_mt", as_listed.alias("as_listed"), F.replace("name", F.lit("chr"), F.lit("")).alias("bare"))


def read_blocks(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Blocks (by contig) of the contigs of these names, with or without chr, M and MT as one; only their folders are read."""
    plain = {n.strip().removeprefix("chr") for n in names}
    plain |= {"M", "MT"} if plain & {"M", "MT"} else set()
    return spark.read.parquet(path).filter(F.col("contig").isin(*sorted(plain | {"chr" + p for p in plain})))


def parse_runs(lines: DataFrame) -> DataFrame:
    """Homopolymer runs of BED text (contig, start, end, base, run): contig, pos (from 1), base, run and key (contig:posbase)."""
    f = F.split("value", "\t")
    rows = lines.select(f[0].alias("contig"), (f[1].cast("bigint") + 1).alias("pos"), F.upper(f[3]).alias("base"), f[4].cast("bigint").alias("run"))
    return rows.withColumn("key", F.concat("contig", F.lit(":"), F.col("pos").cast("string"), "base"))


def batch_places(df: DataFrame, index: str) -> DataFrame:
    """chrom, start_pos of ``index`` texts: fields, a pair, contig:start or contig:start-end. Other shapes fail."""
    found = F.regexp_extract(index, r"^\(?'?([^',:]+)'?[,:]\s*(\d+)(?:-\d+)?\)?$", 0) != ""
    part = lambda i: F.regexp_extract(index, r"^\(?'?([^',:]+)'?[,:]\s*(\d+)(?:-\d+)?\)?$", i)
    ok = lambda c: F.when(found, c).otherwise(F.raise_error(F.concat(F.lit("no place: "), F.col(index))))
    return df.select(ok(part(1)).alias("chrom"), part(2).cast("bigint").alias("start_pos"))


def normalise_candidates(raw: DataFrame, width: int = 1000) -> DataFrame:
    """chrom, start_pos, end_pos of either schema: (chr, position) or (chrom, start, end).

    Rows with a null, blank or non-positive field are left out."""
    names = set(raw.columns)
    if {"chr", "position"} <= names:
        out = raw.select(F.trim("chr").alias("chrom"), F.expr("try_cast(position as bigint)").alias("start_pos")).withColumn("end_pos", F.col("start_pos") + width)
    elif {"chrom", "start", "end"} <= names:
        out = raw.select(F.trim("chrom").alias("chrom"), F.expr("try_cast(start as bigint)").alias("start_pos"), F.expr("try_cast(`end` as bigint)").alias("end_pos"))
    else:
        raise ValueError(f"neither candidate schema: {sorted(names)}")
    return out.filter("chrom <> '' and start_pos > 0 and end_pos > start_pos")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return normalise_candidates(spark.read.csv(path, header=True))


def parse_intervals(lines: DataFrame) -> DataFrame:
    """contig, start_pos, end_pos of comma or tab separated text, with or without a header."""
    cut = F.split("value", "[,\t]")
    rows = lines.select(F.trim(cut[0]).alias("contig"), *[F.get(cut, F.lit(i)).try_cast("bigint").alias(n) for i, n in ((1, "start_pos"), (2, "end_pos"))])
    return rows.filter("start_pos is not null and end_pos is not null")


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    return parse_intervals(spark.read.text(path))


def master_var(lines: DataFrame) -> DataFrame:
    """Calls of a masterVar table (tab separated, one locus a line): contig, pos, ref, alt, qual, info, gt, gq.

    Loci without call and reference loci are left out. Where the alleles differ in length each gets an N in
    front; unknown alleles (``?``) are no call. Null alt where nothing is called."""
    f = F.split("value", "\t")
    at = lambda i: F.coalesce(F.get(f, F.lit(i)), F.lit(""))
    num = lambda i: F.coalesce(at(i).try_cast("bigint"), F.lit(0).cast("bigint"))
    rows = lines.filter(F.col("value").rlike("^[0-9]") & (F.size(f) >= 10)).filter((at(5) != "no-call") & (at(6) != "ref"))
    uneven = (F.length(at(7)) != F.length(at(8))) | (F.length(at(7)) != F.length(at(9)))
    allele = lambda i: F.when(uneven & (at(i) != "?"), F.concat(F.lit("N"), at(i))).otherwise(at(i))
    rows = rows.select(at(2).alias("contig"), (num(3) + 1).alias("pos"), allele(7).alias("ref"), allele(8).alias("a"), allele(9).alias("b"),
                       num(10).alias("qa"), num(11).alias("qb"), num(21).alias("da"), num(22).alias("db"), num(24).alias("dp"))
    ref, a, b = F.col("ref"), F.col("a"), F.col("b")
    has_a, has_b = a != "?", b != "?"
    zero = F.lit(0).cast("bigint")
    var_a, var_b = has_a & (a != ref), has_b & (b != ref)
    ref_depth = F.when(has_a & (a == ref), F.col("da")).otherwise(zero) + F.when(has_b & (b == ref), F.col("db")).otherwise(zero)
    alt_depth = F.when(var_a, F.col("da")).otherwise(zero) + F.when(var_b & (a != b), F.col("db")).otherwise(zero)
    both = has_a & has_b
    gt = F.when(~both, "./.").when((a == b) & (a == ref), "0/0").when(a == b, "1/1").when((a == ref) | (b == ref), "0/1").otherwise("1/2")
    alt = F.when(~both, F.when(has_a, a).when(has_b, b)).when((a == b) & (a == ref), ".").when(a == b, a).when(a == ref, b).when(b == ref, a).otherwise(F.concat_ws(",", a, b))
    info = F.format_string("DP=%d;CGDP2=%d,%d", F.col("dp"), ref_depth, alt_depth)
    qual = F.greatest(F.when(var_a, F.col("qa")).otherwise(zero), F.when(var_b, F.col("qb")).otherwise(zero))
    return rows.select("contig", "pos", "ref", alt.alias("alt"), qual.alias("qual"), info.alias("info"), gt.alias("gt"), F.least("qa", "qb").alias("gq"))


def supplementary(reads: DataFrame) -> DataFrame:
    """One row for each entry of the ``sa`` text: rname, sa_pos, sa_strand, sa_cigar, sa_mapq, sa_nm."""
    rows = reads.withColumn("_e", F.explode(F.filter(F.split("sa", ";"), lambda x: x != ""))).withColumn("_p", F.split("_e", ","))
    names = [("rname", "string"), ("sa_pos", "bigint"), ("sa_strand", "string"), ("sa_cigar", "string"), ("sa_mapq", "int"), ("sa_nm", "int")]
    return rows.select(*reads.columns, *[F.get("_p", F.lit(i)).cast(t).alias(n) for i, (n, t) in enumerate(names)])


def info_map(info: Column) -> Column:
    """INFO text as a map; flags map to the empty string."""
    return F.map_from_entries(F.transform(F.filter(F.split(info, ";"), lambda x: (x != "") & (x != ".")), lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("k"), F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).otherwise("").alias("v"))))


def parse_vcf(lines: DataFrame) -> DataFrame:
    """Rows of VCF text: contig, pos, id, ref, alts, qual, filter, info, format, samples."""
    f = F.split("value", "\t")
    rows = lines.filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    return rows.select(
        f[0].alias("contig"), f[1].cast("long").alias("pos"), f[2].alias("id"), f[3].alias("ref"), F.split(f[4], ",").alias("alts"), F.when(f[5] != ".", f[5]).cast("double").alias("qual"),
        f[6].alias("filter"), info_map(f[7]).alias("info"), F.get(f, F.lit(8)).alias("format"), F.slice(f, 10, 1 << 20).alias("samples"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    return parse_vcf(spark.read.text(path))


def vcf_lines(calls: DataFrame) -> DataFrame:
    """Text lines (value, ord) of calls: contig, pos, ref, alt, info (text), gt; header first."""
    head = ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSAMPLE"]
    spark = calls.sparkSession
    top = spark.createDataFrame([(i, v) for i, v in enumerate(head[:2])] + [(3, head[2])], "ord int, value string")
    contigs = calls.select("contig").distinct().select(F.lit(2).alias("ord"), F.concat(F.lit("##contig=<ID="), "contig", F.lit(">")).alias("value"))
    body = calls.select(F.lit(4).alias("ord"), F.concat_ws("\t", "contig", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("999"), F.lit("PASS"), "info", F.lit("GT"), "gt").alias("value"))
    return top.unionByName(contigs).unionByName(body)


def read_fasta(spark: SparkSession, path: str, chunk: int = 1000) -> DataFrame:
    """contig, chunk_id, seq: sequence in chunks, for access by position.

    A file is one row here (FASTA files are per contig or small); chunks are made in Spark."""
    whole = spark.read.text(path, wholetext=True)
    parts = whole.select(F.explode(F.filter(F.split("value", "(?m)^>"), lambda x: x != "")).alias("v"))
    one = parts.select(F.regexp_extract("v", r"^(\S+)", 1).alias("contig"), F.regexp_replace(F.regexp_replace("v", r"^[^\n]*\n", ""), r"\s", "").alias("s"))
    cut = one.select("contig", "s", F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.length("s") - 1) / chunk).cast("int"), F.lit(0)))).alias("chunk_id"))
    return cut.select("contig", F.col("chunk_id").cast("long").alias("chunk_id"), F.substr("s", F.col("chunk_id") * chunk + 1, F.lit(chunk)).alias("seq"))


def parse_sam(lines: DataFrame) -> DataFrame:
    """Alignments of SAM text, 0-based half-open, with MD, SA and NM tags."""
    from readlake.functions.reads import span

    f = F.split("value", "\t")
    tag = lambda t: F.when(F.col("value").rlike(rf"\t{t}:"), F.regexp_extract("value", rf"\t{t}:[^:]:([^\t]*)", 1))
    rows = lines.filter(~F.col("value").startswith("@") & (F.col("value") != "")).select(
        f[0].alias("qname"), f[1].cast("int").alias("flag"), f[2].alias("contig"), (f[3].cast("long") - 1).alias("ref_start"), f[4].cast("int").alias("mapq"), f[5].alias("cigar"),
        f[6].alias("mate_contig"), (f[7].cast("long") - 1).alias("mate_start"), f[8].cast("long").alias("tlen"), f[9].alias("seq"), f[10].alias("qual"), tag("MD").alias("md"), tag("SA").alias("sa"), tag("NM").cast("int").alias("nm"))
    return rows.withColumn("ref_end", F.col("ref_start") + span("cigar", "MDN=X"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return parse_sam(spark.read.text(path))
