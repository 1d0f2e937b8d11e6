"""Quality rules with adaptive thresholds from mergeable quantile sketches.

DataFrame functions only. For every language and source a sketch of each signal is kept: a
histogram over logarithmic bins (relative error ``GAMMA`` - 1), held as (lang, source, signal,
bin, count) rows. Sketches merge by adding counts, so partial aggregation builds them and
coarser ones (language, all) come from the finer ones. A threshold is a fence above the
upper quartile: q3 + ``REACH`` * max(q3 - q1, ``SPREAD`` of the signal); a group of
fewer than ``FEW`` documents uses its language's, and that of all where this is small too.
The thresholds are then joined to the signals, and a document is kept if it passes the base
rules and none of its signals is above its fence.

Signals: symbols per word, capital letters per word character, characters per word, share of
repeated lines, share of words in repeated windows, and bangs per word.

Defined results: null text counts as empty and fails by its number of words. Null lang and
source are groups of their own. Repeated rows are judged each alone. Repeated windows within
one text are told apart by 64-bit hashes of their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from readlake.llm.common import broadcast_if_small, materialize

# Fixed values of the base rules.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
_SPACE = " \t\n\x0b\x0c\r"
#: Bins of a sketch: values of a bin differ by this factor at most.
GAMMA = 1.05
#: Values below this share a bin.
ZERO = 1e-4
#: Fences: this many spreads above the upper quartile.
REACH = 3.0
#: Least spread of each signal.
SPREAD = {"symbols": 0.05, "capitals": 0.08, "word_length": 1.5, "dup_lines": 0.1, "repeats": 0.1, "bangs": 0.05}
#: Documents that a group needs for its own thresholds.
FEW = 50


def _windows(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_h``, a hash of each ``WINDOW`` consecutive ``_words``, by doubling: words, pairs, fours, eights."""
    out = rows.withColumn("n_words", F.size("_words").cast("long")).withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w))).drop("_words")
    span = 1
    while span < WINDOW:
        # The shorter side ends in nulls, which only windows beyond the last whole one hold.
        out = out.withColumn("_h", F.zip_with("_h", F.slice("_h", F.lit(span + 1), F.size("_h")), lambda a, b: F.xxhash64(a, b)))
        span *= 2
    return out.withColumn("_h", F.when(F.col("n_words") >= WINDOW, F.slice("_h", F.lit(1), F.size("_h") - (WINDOW - 1))))


def _count(text: Column, chars: str) -> Column:
    return F.regexp_count(text, F.lit(chars)).cast("long")


def signals(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts of the contract and the signals."""
    text = F.coalesce("text", F.lit(""))
    one = text
    for c in _SPACE[1:]:
        one = F.replace(one, F.lit(c), F.lit(" "))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    base = documents.select(
        "doc_id", "lang", "source",
        (F.length(text) - _count(text, r"[\x20\x09-\x0D]")).alias("word_chars"), _count(text, r"[#*$%&|<>]").alias("n_symbols"),
        _count(text, "!").alias("n_bangs"), _count(text, "[A-Z]").alias("n_capitals"),
        lines.alias("_lines"), F.array_remove(F.split(one, " "), "").alias("_words"),
    )
    counted = base.withColumn("n_lines", F.size("_lines").cast("long")).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    # Windows are sorted with their places only in texts that repeat one.
    placed = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_ = _windows(counted).withColumn("_w", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), placed)).drop("_h")
    same = lambda i, j: F.coalesce(F.get(F.col("_w"), i)["h"] == F.get(F.col("_w"), j)["h"], F.lit(False))
    twice = F.filter("_w", lambda x, i: same(i, i - 1) | same(i, i + 1))
    placed = sorted_.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("_w")
    # Each window covers up to the next one's start, or all of its words.
    cover = F.transform("_p", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_p"), i + 1) - x, F.lit(WINDOW))))
    counted = placed.withColumn("n_repeat_words", F.coalesce(F.aggregate(cover, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("_p")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return counted.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.struct(
            share("n_symbols", "n_words").alias("symbols"), share("n_capitals", "word_chars").alias("capitals"), share("word_chars", "n_words").alias("word_length"),
            share("n_dup_lines", "n_lines").alias("dup_lines"), share("n_repeat_words", "n_words").alias("repeats"), share("n_bangs", "n_words").alias("bangs"),
        ).alias("signals"),
    )


def _bin(x: Column) -> Column:
    return F.when(x < ZERO, 0).otherwise(F.ceil(F.log(x / ZERO) / F.log(F.lit(GAMMA))) + 1).cast("int")


def sketch(rows: DataFrame, keys: list[str] = ("lang", "source")) -> DataFrame:
    """Sketches of the signals: keys, signal, bin, n."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), _bin(F.col(f"signals.{s}")).alias("bin")) for s in SPREAD])).alias("x")
    return rows.select(*keys, each).groupBy(*keys, "x.signal", "x.bin").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Coarser sketches of the given keys."""
    return sketches.groupBy(*keys, "signal", "bin").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_docs, and a fence for each signal."""
    value = lambda b: F.when(b == 0, 0.0).otherwise(F.lit(ZERO) * F.pow(F.lit(GAMMA), b - 1))
    groups = sketches.groupBy(*keys, "signal").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("total"))

    def quantile(q: float) -> Column:
        # The first bin at which the running count reaches the rank.
        step = F.aggregate(
            "bins", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).alias("bin")),
            lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when((a["bin"] < 0) & (a["seen"] + x["n"] >= F.ceil(F.col("total") * q)), x["bin"]).otherwise(a["bin"]).alias("bin")),
        )
        return value(step["bin"])

    spread = F.create_map(*[F.lit(x) for pair in SPREAD.items() for x in pair])
    fenced = groups.withColumn("q1", quantile(0.25)).withColumn("q3", quantile(0.75)).withColumn("fence", F.col("q3") + REACH * F.greatest(F.col("q3") - F.col("q1"), spread[F.col("signal")]))
    return fenced.groupBy(*keys).agg(F.max("total").alias("n_docs"), *[F.max(F.when(F.col("signal") == s, F.col("fence"))).alias(s) for s in SPREAD])


def thresholds(sketches: DataFrame) -> DataFrame:
    """lang, source and the fences that hold for it."""
    own, lang, every = fences(sketches, ["lang", "source"]), fences(merge(sketches, ["lang"]), ["lang"]), fences(merge(sketches, []), [])
    as_ = lambda df, p, keys=(): df.select(*keys, *[F.col(c).alias(p + c) for c in ["n_docs", *SPREAD]])
    wide = as_(own, "a_", ["lang", "source"]).join(as_(lang, "b_", [F.col("lang").alias("b_lang")]), F.col("lang").eqNullSafe(F.col("b_lang")), "left").crossJoin(F.broadcast(as_(every, "c_")))
    return wide.select("lang", "source", *[F.when(F.col("a_n_docs") >= FEW, F.col("a_" + s)).when(F.col("b_n_docs") >= FEW, F.col("b_" + s)).otherwise(F.col("c_" + s)).alias("max_" + s) for s in SPREAD])


def judge(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    rows = materialize(signals(documents.select("doc_id", "text", "lang", "source")), "quality-signals")
    limits = materialize(thresholds(materialize(sketch(rows), "quality-sketch")), "quality-limits")
    limits = broadcast_if_small(limits.withColumnsRenamed({"lang": "_lang", "source": "_source"}), 200)
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    above = F.lit(False)
    for s in SPREAD:
        above = above | (F.col(f"signals.{s}") > F.col("max_" + s))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~above).alias("kept"))


def _fence_sql(keys: str, name: str) -> str:
    cut = lambda q: f"list(b order by b)[ceil(count(*) * {q})::int]"
    value = lambda b: f"(case when {b} = 0 then 0.0::double else {ZERO}::double * pow({GAMMA}::double, {b} - 1) end)"
    group = f"group by {keys + ', ' if keys else ''}sig"
    q = f"select {keys + ', ' if keys else ''}sig, count(*) as n, {value(cut(0.25))} as q1, {value(cut(0.75))} as q3 from v {group}"
    least = "case sig " + " ".join(f"when '{k}' then {v}::double" for k, v in SPREAD.items()) + " end"
    return f"{name} as (select {keys + ', ' if keys else ''}sig, n, q3 + {REACH}::double * greatest(q3 - q1, {least}) as fence from ({q}))"


#: ``judge`` as SQL, over whole tables.
ORACLE = rf"""
with d as (select row_number() over () as u, doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
g as (select u, unnest(range(1, len(w) - {WINDOW} + 2)) as p, unnest(list_transform(range(1, len(w) - {WINDOW} + 2), lambda p: array_to_string(w[p:p + {WINDOW} - 1], ' '))) as t from w where len(w) >= {WINDOW}),
r as (select u, p from (select u, p, count(*) over (partition by u, t) as n from g) where n > 1),
c as (select u, count(distinct p) as n from (select u, unnest(range(p, p + {WINDOW})) as p from r) group by u),
s as (select w.u, doc_id, lang, source, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
  length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as n_capitals, length(text) - length(replace(text, '!', '')) as n_bangs, len(l) as n_lines from w left join c on c.u = w.u),
x as (select u, lang, source, unnest(['symbols', 'capitals', 'word_length', 'dup_lines', 'repeats', 'bangs']) as sig, unnest([
  coalesce(n_symbols::double / nullif(n_words, 0), 0), coalesce(n_capitals::double / nullif(word_chars, 0), 0), coalesce(word_chars::double / nullif(n_words, 0), 0),
  coalesce(n_dup_lines::double / nullif(n_lines, 0), 0), coalesce(n_repeat_words::double / nullif(n_words, 0), 0), coalesce(n_bangs::double / nullif(n_words, 0), 0)]) as val from s),
v as (select *, case when val < {ZERO}::double then 0 else ceil(ln(val / {ZERO}::double) / ln({GAMMA}::double))::int + 1 end as b from x),
{_fence_sql('lang, source', 'fa')}, {_fence_sql('lang', 'fb')}, {_fence_sql('', 'fc')},
k as (select v.u, bool_or(v.val > case when fa.n >= {FEW} then fa.fence when fb.n >= {FEW} then fb.fence else fc.fence end) as above from v
  join fa on fa.lang is not distinct from v.lang and fa.source is not distinct from v.source and fa.sig = v.sig join fb on fb.lang is not distinct from v.lang and fb.sig = v.sig join fc on fc.sig = v.sig group by v.u)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed,
  not (n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words) and not above as kept
from s join k on k.u = s.u
"""
