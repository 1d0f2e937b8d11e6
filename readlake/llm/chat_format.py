r"""Chat formatting with a grammar round trip. DataFrame functions only.

Grammar (deterministic, line ends are part of it):

    conversation := "<chat " level ">\n" turn*
    turn         := "### " role ": " text "</turn>\n"

At level 0 role and text stand as they are; at level 1 their control strings are escaped:
``\`` as ``\b``, ``### `` as ``\h## ``, ``</turn>`` as ``\l/turn>``, and in roles ``: ``
as ``\c ``. Every conversation is rendered at level 0, reparsed, and compared with its
source; one that does not come back identical (its texts hold control strings) is escaped,
that is rendered at level 1, reparsed and compared again. Should that differ, the job
fails rather than writing it.

The loss mask is a list of spans (start, length) over ``formatted``, in characters from 0: the
texts of turns whose role is ``assistant``, as they stand there, so escaped at level 1.

Defined results: null text and null role are empty; turns are ordered by (turn, role, text)
with nulls first, repeated rows stay as turns of their own, and a null conv_id is a
conversation. A conversation is one string, so its size is bounded by one Spark value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# The template's control strings.
HEAD, ROLE, END, STOP = "### ", ": ", "</turn>", "</turn>\n"
#: A conversation whose texts hold control strings.
TRICKY = r"\### Assistant: </turn> ok"


def _swap(c: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _escaped(c: Column, role: bool) -> Column:
    out = _swap(c, ("\\", "\\b"), (HEAD, "\\h## "), (END, "\\l/turn>"))
    return _swap(out, (ROLE, "\\c ")) if role else out


def _plain(c: Column, role: bool) -> Column:
    out = _swap(c, ("\\c ", ROLE)) if role else c
    return _swap(out, ("\\h## ", HEAD), ("\\l/turn>", END), ("\\b", "\\"))


def _placed(rows: DataFrame, level: int) -> DataFrame:
    """``rows`` with the span (start, length) of each text where ``level`` renders it."""
    own = _escaped if level else (lambda c, role: c)
    before, length = F.length(own(F.col("role"), True)) + len(HEAD) + len(ROLE), F.length(own(F.col("text"), False))
    earlier = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(before + length + len(STOP)).over(earlier), F.lit(0)) + len("<chat 0>\n") + before
    return rows.withColumn(f"at{level}", F.struct(start.cast("int").alias("start"), length.alias("length")))


def render(turns: Column, level: int) -> Column:
    """Text of an array of (role, text)."""
    own = _escaped if level else (lambda c, role: c)
    body = F.transform(turns, lambda t: F.concat(F.lit(HEAD), own(t["role"], True), F.lit(ROLE), own(t["text"], False), F.lit(STOP)))
    return F.concat(F.lit(f"<chat {level}>\n"), F.array_join(body, ""))


def pieces(formatted: Column) -> Column:
    """The turns between the header and the end, without their end marks."""
    return F.slice(F.split(F.substr(formatted, F.lit(len("<chat 0>\n") + 1)), STOP), 1, F.size(F.split(formatted, STOP)) - 1)


def parse(cut: Column, level: int) -> Column:
    """Array of (role, text) from ``pieces``; null where the grammar does not hold."""
    own = _plain if level else (lambda c, role: c)
    bad = F.exists(cut, lambda p: ~p.startswith(HEAD) | (F.instr(p, ROLE) == 0) | F.contains(F.substr(p, F.lit(len(HEAD) + 1)), F.lit(HEAD)) | F.contains(p, F.lit(END)))
    role = lambda p: F.substr(p, F.lit(len(HEAD) + 1), F.instr(p, ROLE) - F.lit(len(HEAD) + 1))
    text = lambda p: F.substr(p, F.instr(p, ROLE) + F.lit(len(ROLE)))
    turns = F.transform(cut, lambda p: F.struct(own(role(p), True).alias("role"), own(text(p), False).alias("text")))
    return F.when(~bad, turns)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, level, formatted, ``turns`` as read back from it, and ``loss``, the mask's spans."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    placed = _placed(_placed(conversations.select("conv_id", "turn", text("role"), text("text")), 0), 1)
    mask = lambda level: F.transform(F.filter("rows", lambda t: t["role"] == "assistant"), lambda t: t[f"at{level}"]).alias(f"loss{level}")
    source = (
        placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "at0", "at1"))).alias("rows"))
        .select("conv_id", F.transform("rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"), mask(0), mask(1))
    )
    tried = source.withColumn("f0", render(F.col("source"), 0)).withColumn("c0", pieces(F.col("f0"))).withColumn("p0", parse(F.col("c0"), 0))
    ok = F.coalesce(F.col("p0") == F.col("source"), F.lit(False))
    chosen = tried.withColumn("level", F.when(ok, 0).otherwise(1)).withColumn("formatted", F.when(F.col("level") == 0, F.col("f0")).otherwise(render(F.col("source"), 1)))
    again = chosen.withColumn("c1", F.when(F.col("level") == 1, pieces(F.col("formatted")))).withColumn("p1", parse(F.col("c1"), 1))
    read = again.withColumn("turns", F.when(F.col("level") == 0, F.col("p0")).otherwise(F.col("p1")))
    same = F.coalesce(F.col("turns") == F.col("source"), F.lit(False))
    return read.select(
        "conv_id", "level", "formatted",
        F.when(same, F.col("turns")).otherwise(F.raise_error(F.lit("a conversation did not come back identical"))).alias("turns"),
        F.when(F.col("level") == 0, F.col("loss0")).otherwise(F.col("loss1")).alias("loss"),
    )


def under_mask() -> Column:
    """The texts under the mask, cut from ``formatted`` and unescaped."""
    cut = F.transform("loss", lambda s: F.substr(F.col("formatted"), s["start"] + 1, s["length"]))
    return F.when(F.col("level") == 0, cut).otherwise(F.transform(cut, lambda t: _plain(t, False)))


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.withColumn("loss", F.array_join(under_mask(), "")).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_tricky(conversations: DataFrame) -> DataFrame:
    """Adds conversation -7."""
    turn = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("turn"), F.lit(role).alias("role")) for i, role in enumerate(("user", "assistant"))])).alias("x")
    own = conversations.sparkSession.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), turn).select("conv_id", "x.turn", "x.role", F.lit(TRICKY).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(own)


ORACLE = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t as (
  select *, contains(role || ': ' || text, '### ') or contains(role || ': ' || text, '</turn>') or contains(role, ': ') as odd from c
), f as (select conv_id, max(odd) as odd from t group by conv_id)
select t.conv_id, count(*)::BIGINT as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(case when role = 'assistant' then length(text) end), 0)::BIGINT as loss_chars,
       sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
       (9 + sum(14 + length(case when f.odd then replace(replace(replace(replace(role, '\', '\b'), '### ', '\h## '), '</turn>', '\l/turn>'), ': ', '\c ') else role end)
              + length(case when f.odd then replace(replace(replace(text, '\', '\b'), '### ', '\h## '), '</turn>', '\l/turn>') else text end)))::BIGINT as formatted_chars
from t join f on t.conv_id = f.conv_id group by t.conv_id
"""
