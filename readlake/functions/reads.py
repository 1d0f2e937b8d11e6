"""Column functions of aligned reads: CIGAR and MD text, flags, classes, grey levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cigar_ops(cigar) -> Column:
    """CIGAR text as array<struct<n, op>>."""
    return F.transform(F.regexp_extract_all(col(cigar), F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1)), lambda x: F.struct(F.regexp_extract(x, r"^\d+", 0).cast("long").alias("n"), F.substring(x, -1, 1).alias("op")))


def _moves(ops: str):
    return lambda x: F.when(x["op"].isin(*ops), x["n"]).otherwise(F.lit(0).cast("long"))


def span(cigar, ops: str) -> Column:
    """Length of the given operations together: ``MDN=X`` on the reference, ``MIS=X`` on the read."""
    return F.aggregate(F.transform(cigar_ops(cigar), _moves(ops)), F.lit(0).cast("long"), lambda a, x: a + x)


def cigar_walk(cigar, start) -> Column:
    """Segments array<struct<op, n, ref_pos, read_pos>>: cursor of both sides before each operation."""
    empty = F.array().cast("array<struct<op:string,n:bigint,ref_pos:bigint,read_pos:bigint>>")
    first = F.struct(empty.alias("out"), col(start).cast("long").alias("r"), F.lit(0).cast("long").alias("q"))
    step = lambda a, x: F.struct(
        F.concat(a["out"], F.array(F.struct(x["op"].alias("op"), x["n"].alias("n"), a["r"].alias("ref_pos"), a["q"].alias("read_pos")))).alias("out"),
        (a["r"] + _moves("MDN=X")(x)).alias("r"), (a["q"] + _moves("MIS=X")(x)).alias("q"))
    return F.aggregate(cigar_ops(cigar), first, step, lambda a: a["out"])


def md_walk(md, start) -> Column:
    """Signals array<struct<kind, pos>> of MD text: kind X for a mismatch, D for a deleted base."""
    tokens = F.regexp_extract_all(col(md), F.lit(r"(\d+|\^[A-Za-z]+|[A-Za-z])"), F.lit(1))
    empty = F.array().cast("array<struct<kind:string,pos:bigint>>")
    first = F.struct(empty.alias("out"), col(start).cast("long").alias("p"))

    def step(a: Column, x: Column) -> Column:
        number, deletion = x.rlike(r"^\d"), x.startswith("^")
        size = F.when(number, x.cast("long")).when(deletion, F.length(x).cast("long") - 1).otherwise(F.lit(1).cast("long"))
        gone = F.transform(F.sequence(F.lit(0).cast("long"), F.length(x).cast("long") - 2), lambda i: F.struct(F.lit("D").alias("kind"), (a["p"] + i).alias("pos")))
        own = F.when(number, empty).when(deletion, gone).otherwise(F.array(F.struct(F.lit("X").alias("kind"), a["p"].alias("pos"))))
        return F.struct(F.concat(a["out"], own).alias("out"), (a["p"] + size).alias("p"))

    return F.aggregate(tokens, first, step, lambda a: a["out"])


def strand(flag) -> Column:
    """1 for reverse, 2 for forward."""
    return F.when(col(flag).bitwiseAND(16) != 0, 1).otherwise(2)


def bit(flag, b: int) -> Column:
    return col(flag).bitwiseAND(b) != 0


def mapped(flag) -> Column:
    return ~bit(flag, 4)


def proper_inward(flag, start, mate_start) -> Column:
    """First reads of proper pairs (both mapped, no duplicate, primary) whose strands point at each other."""
    flags = bit(flag, 2) & bit(flag, 1) & bit(flag, 64) & mapped(flag) & ~bit(flag, 8) & ~bit(flag, 1024) & ~bit(flag, 256) & ~bit(flag, 2048)
    reverse, mate_reverse = bit(flag, 16), bit(flag, 32)
    return flags & (((col(start) < col(mate_start)) & ~reverse & mate_reverse) | ((col(start) > col(mate_start)) & reverse & ~mate_reverse))


def usable_pair(flag, mapq, tlen, start, mate_start, least: int = 9) -> Column:
    """The left reads of mapped pairs that are no duplicates."""
    return bit(flag, 1) & mapped(flag) & ~bit(flag, 8) & ~bit(flag, 1024) & (col(mapq) >= least) & (col(tlen) != 0) & (col(start) < col(mate_start))


def usable_split(flag, mapq, contig, mate_contig, least: int = 20) -> Column:
    """Mapped proper reads that are no duplicates, with their mates on one contig."""
    return mapped(flag) & ~bit(flag, 1024) & (col(mapq) >= least) & bit(flag, 2) & (col(contig) == col(mate_contig))


def soft_clip(cigar, start, end, seq=None, least: int = 5) -> Column:
    """Struct side, n, anchor (and clip_seq) of a read's clip: the last operation if it is S, else the first; null without."""
    ops = cigar_ops(cigar)
    last, first = F.element_at(ops, -1), F.get(ops, F.lit(0))
    right, left = (last["op"] == "S") & (last["n"] >= least), (first["op"] == "S") & (first["n"] >= least)

    def told(side: str, n: Column, anchor) -> Column:
        cut = () if seq is None else ((F.substr(col(seq), (-n).cast("int")) if side == "right" else F.substr(col(seq), F.lit(1), n.cast("int"))).alias("clip_seq"),)
        return F.struct(F.lit(side).alias("side"), n.alias("n"), col(anchor).alias("anchor"), *cut)

    return F.when(right, told("right", last["n"], end)).when(left, told("left", first["n"], start))


def signed_log(x) -> Column:
    return F.signum(col(x)) * F.log1p(F.abs(col(x)))


def nearest_int(x) -> Column:
    """Nearest integer, ties down."""
    return F.ceil(col(x) - 0.5)


def gc_level(seq) -> Column:
    """Share of g and c times 255, truncated; 0 for empty text."""
    s = F.lower(col(seq))
    return F.coalesce(F.floor(F.try_divide(255 * F.length(F.regexp_replace(s, "[^gc]", "")), F.length(s))), F.lit(0)).cast("long")


def pair_orientation(reverse, mate_reverse, start, mate_start) -> Column:
    """LLRR on one strand; RL if the pair points outward by over 5; else LR."""
    left_reverse = F.when(col(start) <= col(mate_start), col(reverse)).otherwise(col(mate_reverse))
    return F.when(col(reverse) == col(mate_reverse), "LLRR").when(left_reverse & (F.abs(col(start) - col(mate_start)) > 5), "RL").otherwise("LR")


def insert_class(tlen, mean, sd) -> Column:
    """1 above, 2 below two deviations, else 0."""
    return F.when(F.abs(col(tlen)) > col(mean) + 2 * col(sd), 1).when(F.abs(col(tlen)) < col(mean) - 2 * col(sd), 2).otherwise(0)


def length_variant(query_len, ref_len) -> Column:
    return F.coalesce(F.try_divide(F.abs(col(query_len) - col(ref_len)).cast("double"), col(ref_len)) >= 0.1, F.lit(False))


# Grey levels of bases.
GREY = {"A": 60, "T": 120, "C": 180, "G": 240}


def base_grey(base) -> Column:
    out = F.lit(0)
    for b, v in GREY.items():
        out = F.when(F.upper(col(base)) == b, v).otherwise(out)
    return out


def scaled_grey(value, most) -> Column:
    """value / most as a grey level, cut to 0..255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(255 * col(value) / most))).cast("long")


def grey_levels(base, gc, proper, mapq, mapq_mean, op, base_qual, pair, reverse, insert, same, clip, variant) -> list[Column]:
    """The twelve levels of a base of a pile: base, GC level, proper pair, mapping quality, operation (0 M, 1 I, 2 D, 4 S), base
    quality, pair orientation, strand, insert class, equal to the reference, clip signal, length variant."""
    cut = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), c))
    named = lambda c, values, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in values.items() for x in p]), col(c)), F.lit(other))
    yes = lambda c: F.when(col(c), 120).otherwise(240)
    return [base_grey(base), cut(col(gc)), yes(proper), cut(F.floor(255 * col(mapq) / F.greatest(col(mapq_mean), F.lit(1)))), named(op, {0: 60, 1: 120, 2: 180, 4: 240}, 60), cut(F.floor(255 * col(base_qual) / 40)),
            named(pair, {"LR": 80, "LLRR": 240, "RL": 160}, 80), yes(reverse), named(insert, {1: 240, 2: 160, 0: 80}, 80), yes(same), cut(col(clip)), F.when(col(variant), 240).otherwise(120)]


def code_grey(code) -> Column:
    """Codes 0, 1, 2 as 80, 160, 240."""
    return 80 * (col(code) + 1)


def flag_grey(b) -> Column:
    return F.when(col(b), 240).otherwise(120)


# Numbers of the CIGAR operations.
OP_CODES = {"M": 0, "I": 1, "D": 2, "N": 3, "S": 4, "H": 5, "P": 6, "=": 7, "X": 8}


def clip_scores(reads: DataFrame) -> DataFrame:
    """contig, pos, clips (reads that are clipped there), parity: the floored quarter of the sum of the negative
    operation numbers, in which a read reaches from its first base, clips included, over as many positions as it
    has bases, and every operation moves on."""
    walk = F.aggregate(
        cigar_ops("cigar"), F.struct(F.array().cast("array<struct<op:string,a:bigint,n:bigint>>").alias("out"), F.lit(0).cast("bigint").alias("p")),
        lambda a, x: F.struct(F.concat(a["out"], F.array(F.struct(x["op"].alias("op"), a["p"].alias("a"), x["n"].alias("n")))).alias("out"), (a["p"] + x["n"]).alias("p")), lambda a: a["out"])
    first = F.get(cigar_ops("cigar"), F.lit(0))
    begin = F.col("ref_start") - F.when(first["op"].isin("S", "I"), first["n"]).otherwise(0)
    seg = reads.select("contig", begin.alias("b"), span("cigar", "MIS=X").alias("len"), F.inline(F.filter(walk, lambda x: x["op"] != "M")))
    upto = F.least(F.col("a") + F.col("n"), F.col("len"))
    code = F.element_at(F.create_map(*[F.lit(x) for p in OP_CODES.items() for x in p]), F.col("op"))
    at = seg.filter(upto > F.col("a")).select("contig", "op", code.alias("code"), F.explode(F.sequence(F.col("b") + F.col("a"), F.col("b") + upto - 1)).alias("pos"))
    return at.groupBy("contig", "pos").agg(F.count_if(F.col("op") == "S").alias("clips"), F.floor(-F.sum("code") / 4).cast("long").alias("parity"))


def contig_key(contig) -> Column:
    """Sort key: numbers first, X 23, Y 24, M 25, others 999."""
    name = F.regexp_replace(col(contig), "^chr", "")
    return F.coalesce(F.try_to_number(F.when(name.rlike(r"^\d{1,9}$"), name), F.lit("999999999")).cast("int"), F.when(name == "X", 23).when(name == "Y", 24).when(name.isin("M", "MT"), 25).otherwise(999))


def artifact_name(*parts) -> Column:
    return F.regexp_replace(F.concat_ws("_", *[col(p).cast("string") for p in parts]), r"[^A-Za-z0-9_.-]", "_")


def size_class(n) -> Column:
    n = F.abs(col(n))
    return F.when((n >= 50) & (n < 200), "50-200").when((n >= 200) & (n < 700), "200-700").when((n >= 700) & (n < 1000), "700-1000").when(n >= 1000, ">=1000").otherwise("other")


def phred(p) -> Column:
    return F.when(col(p) < 1e-10, F.lit(0)).otherwise(F.floor(-4.343 * F.log(col(p)) + 0.499)).cast("long")


def focal_loss(p, y, alpha: float = 0.20, gamma: float = 2.0) -> Column:
    """Focal loss of a probability for a 0/1 label; ``alpha`` weighs label 1 and what is left of 1 label 0."""
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), col(p)))
    pt = F.when(col(y) == 1, q).otherwise(1 - q)
    return -F.when(col(y) == 1, alpha).otherwise(1 - alpha) * F.pow(1 - pt, F.lit(gamma)) * F.log(pt)


def softmax(scores: list) -> list[Column]:
    e = [F.exp(col(s) - F.greatest(*[col(x) for x in scores])) for s in scores]
    total = sum(e[1:], e[0])
    return [x / total for x in e]
