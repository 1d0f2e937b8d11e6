"""Column functions of variants: genotypes, likelihoods, alleles, Fisher's test."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T


def genotype(gt) -> Column:
    """Struct of both allele indexes and their separator; null for missing alleles."""
    c = F.col(gt) if isinstance(gt, str) else gt
    at = lambda i: F.expr("cast(null as int)") if i is None else F.regexp_extract(c, r"^(\d+|\.)([/|])(\d+|\.)", i)
    number = lambda i: F.when(at(i).rlike(r"^\d+$"), at(i).cast("int"))
    return F.struct(number(1).alias("a"), number(3).alias("b"), F.nullif(at(2), F.lit("")).alias("sep"))


def is_hom_ref(gt, parity: bool = False) -> Column:
    """Both alleles 0. In parity mode the separator is compared instead, so nothing is."""
    g = genotype(gt)
    return F.lit(False) if parity else F.coalesce((g["a"] == 0) & (g["b"] == 0), F.lit(False))


def unphase(gt) -> Column:
    """Unphased b/a with b > a as a/b."""
    g = genotype(gt)
    return F.when((g["sep"] == "/") & (g["a"] > g["b"]), F.concat(g["b"].cast("string"), F.lit("/"), g["a"].cast("string"))).otherwise(F.col(gt) if isinstance(gt, str) else gt)


def best_genotype(pl: Column, prior: float = 0.0) -> Column:
    """Index of the smallest likelihood after a prior on the heterozygote, and the gap to the next."""
    shifted = F.transform(pl, lambda x, i: x + F.when(i == 1, F.lit(prior)).otherwise(F.lit(0.0)))
    ordered = F.array_sort(shifted)
    return F.struct((F.array_position(shifted, ordered[0]) - 1).cast("int").alias("gt"), (ordered[1] - ordered[0]).alias("gq"))


def likely_genotype(fmt: Column, sample: Column, alleles: Column, prior: float = 30.0) -> Column:
    """Struct gt, gq from PL, or GL times -10, of a sample: the first smallest likelihood after a prior for two different
    alleles, and the distance to the next; null without likelihoods or with a wrong number of them."""
    names = F.split(fmt, ":")
    at = F.when(F.array_position(names, "GL") > 0, F.array_position(names, "GL")).otherwise(F.array_position(names, "PL"))
    raw = F.transform(F.split(F.get(F.split(sample, ":"), (at - 1).cast("int")), ","), lambda x: x.try_cast("double"))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), alleles - 1), lambda i: F.transform(F.sequence(F.lit(0), i), lambda j: F.struct(j.alias("j"), i.alias("i")))))
    scale = F.when(F.array_position(names, "GL") > 0, -10.0).otherwise(1.0)
    shifted = F.transform(F.arrays_zip(raw.alias("v"), pairs.alias("p")), lambda x: x["v"] * scale + F.when(x["p"]["i"] != x["p"]["j"], F.lit(prior)).otherwise(0.0))
    ordered = F.sort_array(shifted)
    best = F.get(pairs, (F.array_position(shifted, ordered[0]) - 1).cast("int"))
    ok = (at > 0) & (F.size(raw) == (alleles * (alleles + 1) / 2).cast("int"))
    return F.when(ok, F.struct(F.concat(best["j"].cast("string"), F.lit("/"), best["i"].cast("string")).alias("gt"), F.floor(ordered[1] - ordered[0] + 0.499).cast("bigint").alias("gq")))


def genotype_index(a: Column, b: Column, parity: bool = False) -> Column:
    """Index of an unordered pair of alleles: hi (hi + 1) / 2 + lo; in parity mode lo and hi swap roles."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    return F.floor(lo * (lo + 1) / 2 + hi).cast("int") if parity else F.floor(hi * (hi + 1) / 2 + lo).cast("int")


def trim_alleles(ref: Column, alt: Column) -> Column:
    """Struct ref, alt, shift: common suffix, then common prefix gone, one base kept of each."""
    common = lambda a, b, most: F.aggregate(
        F.sequence(F.lit(1), F.greatest(most, F.lit(1))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, i: F.struct(F.when(s["on"] & (i <= most) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), s["n"] + 1).otherwise(s["n"]).alias("n"), (s["on"] & (i <= most) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1)))).alias("on")))["n"]
    most = lambda a, b: F.least(F.length(a), F.length(b)) - 1
    end = common(F.reverse(ref), F.reverse(alt), most(ref, alt))
    r, a = F.substr(ref, F.lit(1), F.length(ref) - end), F.substr(alt, F.lit(1), F.length(alt) - end)
    start = common(r, a, most(r, a))
    return F.struct(F.substr(r, start + 1, F.length(r)).alias("ref"), F.substr(a, start + 1, F.length(a)).alias("alt"), start.alias("shift"))


# Kinds of atomic alleles.
TRANSITION, TRANSVERSION, MULTIPLE, INSERTION, DELETION = range(5)


def allele_kind(ref: Column, alt: Column) -> Column:
    """Kind of a trimmed allele."""
    pair = F.concat(F.upper(ref), F.upper(alt))
    single = (F.length(ref) == 1) & (F.length(alt) == 1)
    return F.when(single & pair.isin("AG", "GA", "CT", "TC"), TRANSITION).when(single, TRANSVERSION).when(F.length(ref) == F.length(alt), MULTIPLE).when(F.length(ref) < F.length(alt), INSERTION).otherwise(DELETION)


def fisher_tests(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact probabilities of 2 x 2 tables (rows of two-tailed, left and right), all tables at once."""
    a, b, c, d = (np.asarray(x, np.int64) for x in (a, b, c, d))
    row, col, total = a + b, a + c, a + b + c + d
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, max(int(total.max(initial=0)), 1) + 1)))])
    choose = lambda n, k: logs[n] - logs[k] - logs[n - k]
    low, high = np.maximum(0, row + col - total), np.minimum(row, col)
    many = high - low + 1
    first = np.cumsum(many) - many
    of = np.repeat(np.arange(len(a)), many)
    x = np.arange(len(of)) - np.repeat(first - low, many)
    p = np.exp(choose(row[of], x) + choose((total - row)[of], col[of] - x) - choose(total[of], col[of]))
    own = p[first + a - low][of]
    tail = lambda keep: np.minimum(np.add.reduceat(np.where(keep, p, 0.0), first), 1.0) if len(a) else np.zeros(0)
    return np.stack([tail(p <= own * (1 + 1e-7)), tail(x <= a[of]), tail(x >= a[of])])


def fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-tailed exact probability of a 2 x 2 table."""
    return float(fisher_tests(*(np.array([v]) for v in (a, b, c, d)))[0, 0])


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("two", "left", "right")]))
def fisher_tails(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
    """Spark has no log-gamma, so this runs in Arrow batches, in numpy. Null where a count is."""
    some = (a.notna() & b.notna() & c.notna() & d.notna()).to_numpy()
    out = np.full((3, len(a)), np.nan)
    out[:, some] = fisher_tests(*(v[some].to_numpy(np.int64) for v in (a, b, c, d)))
    return pd.DataFrame(dict(zip(("two", "left", "right"), out, strict=True))).astype("Float64")


def _number(text: Column) -> Column:
    return text.try_cast("bigint")


def _info(info: str, name: str) -> Column:
    """The first number after ``name`` and = in INFO text."""
    return _number(F.nullif(F.regexp_extract(info, rf"{name}=(\d+)", 1), F.lit("")))


def _field(fmt: str, sample: str, name: str) -> Column:
    """A sample's field of a name that FORMAT lists, as numbers; null where it does not."""
    at = F.array_position(F.split(fmt, ":"), name)
    return F.when(at > 0, F.transform(F.split(F.get(F.split(sample, ":"), (at - 1).cast("int")), ","), _number))


def with_depths(rows: DataFrame) -> DataFrame:
    """``rows`` (info, format, sample) with _depth, _ref, _alt and _four (counts by strand: ref +, ref -, alt +, alt -) of each call.

    Fields of INFO that callers have of their own (DP4, CGDP2, SRF to SAR, NF to TCR) go before ADF and ADR, these before
    AD, and AD before FORMAT's DP; else DP of INFO, or -1. Texts are read once, into columns that the rules then share."""
    numbers = lambda c: F.transform(F.split(F.nullif(c, F.lit("")), ","), _number)
    by_allele = r"NF=([\d,]+).*NR=([\d,]+).*TCF=(\d+).*TCR=(\d+)"
    read = {f"_{n.lower()}": _field("format", "sample", n) for n in ("ADF", "ADR", "AD", "DP")} | {f"_{n.lower()}": _info("info", n) for n in ("SRF", "SRR", "SAF", "SAR")}
    read |= {"_dp4": numbers(F.regexp_extract("info", r"DP4=(\d+,\d+,\d+,\d+)", 1)), "_cg": numbers(F.regexp_extract("info", r"CGDP2=(\d+,\d+)", 1)), "_plain": _info("info", "DP")}
    read |= {f"_pl{i}": numbers(F.regexp_extract("info", by_allele, i)) for i in (1, 2, 3, 4)}
    c = F.col
    strands = c("_adf").isNotNull() & c("_adr").isNotNull()
    rest = lambda v: F.aggregate(F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))), F.lit(0).cast("bigint"), lambda s, x: s + x)
    tags = [c(f"_{n}") for n in ("srf", "srr", "saf", "sar")]
    # The allele with most reads of both strands, the first of equals; negative reference counts are 0.
    top = F.array_max(F.transform(F.arrays_zip(c("_pl1").alias("f"), c("_pl2").alias("r")), lambda x, i: F.struct((x["f"] + x["r"]).alias("n"), (-i).alias("i"), x["f"].alias("f"), x["r"].alias("r"))))
    zero = F.lit(0).cast("bigint")
    from_pl = F.array(F.greatest(c("_pl3")[0] - c("_top.f"), zero), F.greatest(c("_pl4")[0] - c("_top.r"), zero), c("_top.f"), c("_top.r"))
    own = c("_cg").isNull()
    four = F.when(c("_dp4").isNotNull(), c("_dp4")).when(own & tags[0].isNotNull() & tags[1].isNotNull() & tags[2].isNotNull() & tags[3].isNotNull(), F.array(*tags)).when(
        own & c("_pl1").isNotNull(), from_pl).when(strands, F.array(c("_adf")[0], c("_adr")[0], rest(c("_adf")), rest(c("_adr"))))
    known = c("_four").isNotNull()
    ref = F.when(known, c("_four")[0] + c("_four")[1]).when(~own, c("_cg")[0]).when(~strands, c("_ad")[0])
    alt = F.when(known, c("_four")[2] + c("_four")[3]).when(~own, c("_cg")[1]).when(~strands, rest(c("_ad")))
    plain = F.when(~strands & c("_ad").isNull() & c("_dp").isNotNull(), c("_dp")[0]).otherwise(F.coalesce("_plain", F.lit(-1).cast("bigint")))
    out = rows.withColumns(read).withColumn("_top", top).withColumn("_four", four).withColumns({"_ref": ref, "_alt": alt})
    out = out.withColumn("_depth", F.when(c("_ref").isNotNull() & c("_alt").isNotNull(), c("_ref") + c("_alt")).otherwise(plain))
    return out.select(*rows.columns, "_depth", "_ref", "_alt", "_four")


def allele_start(ref: Column, alt: Column) -> Column:
    """Bases at the left that agree, after those at the right that do."""
    same = lambda a, b, most: F.aggregate(
        F.sequence(F.lit(1), F.greatest(most, F.lit(1))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, i: F.struct((s["n"] + (s["on"] & (i <= most) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1)))).cast("int")).alias("n"), (s["on"] & (i <= most) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1)))).alias("on")))["n"]
    end = same(F.reverse(ref), F.reverse(alt), F.least(F.length(ref), F.length(alt)))
    return same(ref, alt, F.least(F.length(ref), F.length(alt)) - end)


def _bases(ref: Column, alt: Column, at: Column, other: Column, n: Column, pos: Column) -> Column:
    """Single changed bases of ``n`` aligned ones from ``at`` of ref and ``other`` of alt."""
    each = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda j: F.struct(F.substr(ref, at + j + 1, F.lit(1)).alias("u"), F.substr(alt, other + j + 1, F.lit(1)).alias("v"), j.alias("j")))
    changed = F.filter(each, lambda x: (x["j"] < n) & (x["u"] != x["v"]))
    return F.transform(changed, lambda x: F.struct(F.when(F.concat(x["u"], x["v"]).isin("AG", "GA", "CT", "TC"), TRANSITION).otherwise(TRANSVERSION).alias("type"), (pos + at + x["j"]).alias("pos"), F.lit(0).alias("len"), F.lit("").alias("seq")))


def atoms(ref: Column, alt: Column, pos: Column, cigar: Column) -> Column:
    """Atomic changes array<struct<type, pos, len, seq>> of one allele (pos from 0): by CIGAR text where there is one, else an
    indel after the common left part and then the changed bases of the rest."""
    empty = F.array().cast("array<struct<type:int,pos:bigint,len:int,seq:string>>")
    kind = lambda t, p, n, q: F.array(F.struct(F.lit(t).alias("type"), p.cast("bigint").alias("pos"), n.cast("int").alias("len"), q.alias("seq"))).cast(empty_type)
    empty_type = "array<struct<type:int,pos:bigint,len:int,seq:string>>"
    st, gap = allele_start(ref, alt), F.length(alt) - F.length(ref)
    indel = F.when(gap > 0, kind(INSERTION, pos + st, gap, F.substr(alt, st + 1, gap))).when(gap < 0, kind(DELETION, pos + st, gap, F.substr(ref, st + 1, -gap))).otherwise(empty)
    rest_ref, rest_alt = F.when(gap < 0, st - gap).otherwise(st), F.when(gap > 0, st + gap).otherwise(st)
    plain = F.concat(indel, _bases(ref, alt, rest_ref, rest_alt, F.length(ref) - rest_ref, pos).cast(empty_type))
    ops = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[MXID=])"), F.lit(1)), lambda x: F.struct(F.regexp_extract(x, r"^\d+", 0).cast("int").alias("n"), F.substring(x, -1, 1).alias("op")))

    def step(s: Column, x: Column) -> Column:
        own = F.when(x["op"] == "X", _bases(ref, alt, s["x"], s["y"], x["n"], pos).cast(empty_type)).when(x["op"] == "I", kind(INSERTION, pos + s["x"], x["n"], F.substr(alt, s["y"] + 1, x["n"]))).when(
            x["op"] == "D", kind(DELETION, pos + s["x"], -x["n"], F.substr(ref, s["x"] + 1, x["n"]))).otherwise(empty)
        return F.struct(F.concat(s["out"], own).alias("out"), (s["x"] + F.when(x["op"] == "I", 0).otherwise(x["n"])).alias("x"), (s["y"] + F.when(x["op"] == "D", 0).otherwise(x["n"])).alias("y"))

    walked = F.aggregate(ops, F.struct(empty.alias("out"), F.lit(0).alias("x"), F.lit(0).alias("y")), step, lambda s: s["out"])
    single = (F.length(ref) == 1) & (F.length(alt) == 1)
    return F.when(F.coalesce(cigar, F.lit("")) != "", F.when(single, plain).otherwise(walked)).otherwise(plain)


def zygosity(gt: Column, info: Column) -> Column:
    """1 for two different alleles, 0 for equal ones (two missing ones, too), -1 if unknown: from GT where both are known,
    else from the sign of FQ in INFO, else from GT as it stands."""
    full = F.regexp_extract(gt, r"^(\d+)[/|](\d+)", 0) != ""
    half = r"^(\.|\d+)[/|](\.|\d+)"
    fq = F.regexp_extract(info, r"FQ=([^;\t]+)", 1)
    differ = lambda: (F.regexp_extract(gt, half, 1) != F.regexp_extract(gt, half, 2)).cast("int")
    partly = F.when(F.regexp_extract(gt, half, 0) != "", differ()).otherwise(-1)
    return F.when(full, differ()).when(fq != "", (fq.try_cast("double") > 0).cast("int")).otherwise(partly)
