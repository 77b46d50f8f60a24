"""Preference formatting: a shared prompt and two masked completions from a chosen and a rejected conversation.

The longest common prefix of turns is rendered once as the prompt; what follows in either conversation is its completion.
A completion's mask lists what a model is trained on, the texts of the assistant's turns with their end mark, as places in
code points from the completion's start, ends exclusive.

Roles and texts can't forge a turn: the beginning of a mark, ``<|``, is rendered as ``<\\|`` inside of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.spans import running

HEAD, MIDDLE, END = "<|", "|>\n", "<|end|>\n"


def escaped(text: Column) -> Column:
    """A role or text without the beginning of a mark; null counts as empty."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<\\|"))


def render(turns: Column) -> Column:
    """The text of an array of turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), t["role"], F.lit(MIDDLE), t["text"], F.lit(END))), "")


def trained(turns: Column) -> Column:
    """``array<struct<s,e>>``: the assistant's texts with their end marks, in the rendered turns."""
    size = lambda t: len(HEAD + MIDDLE) + F.length(t["role"]) + F.length(t["text"]) + len(END)

    def place(t: Column, at: Column) -> Column:
        s = at + len(HEAD + MIDDLE) + F.length(t["role"])
        return F.struct(s.alias("s"), (s + F.length(t["text"]) + len(END)).alias("e"), (t["role"] == "assistant").alias("ours"))

    every = running(turns, "array<struct<s:int,e:int,ours:boolean>>", size, place)
    return F.transform(F.filter(every, lambda x: x["ours"]), lambda x: F.struct(x["s"], x["e"]))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading turns of two arrays are equal."""
    n = F.least(F.size(a), F.size(b))
    apart = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & ((F.get(a, i)["role"] != F.get(b, i)["role"]) | (F.get(a, i)["text"] != F.get(b, i)["text"])))
    return F.coalesce(F.array_min(apart), n)


def preferences(turns: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``pair_id, n_prompt, n_chosen, n_rejected, prompt, chosen, rejected, chosen_mask, rejected_mask``, one row for each pair.

    ``turns``: conv_id, turn, role, text. ``pairs``: pair_id, chosen_id, rejected_id; without it conversation 2 n is the chosen
    and 2 n + 1 the rejected one of pair n. Turns are ordered by number, then role and text; null roles and texts count as
    empty, turns without a number come first, repeated rows count once, and turns without a conversation are no pair's. A
    conversation that is missing has no turns, so its pair still gives a row, as long as the other side is there.
    """
    t = turns.select("conv_id", "turn", escaped(F.col("role")).alias("role"), escaped(F.col("text")).alias("text")).where("conv_id is not null")
    if pairs is None:
        sided = t.withColumns({"pair_id": F.floor(F.col("conv_id") / 2).cast("bigint"), "second": F.pmod("conv_id", F.lit(2)) == 1})
    else:
        sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.col("chosen_id").alias("conv_id"), F.lit(False).alias("second")), F.struct(F.col("rejected_id").alias("conv_id"), F.lit(True).alias("second")))).alias("side")).select("pair_id", "side.*")
        sided = t.join(sides, "conv_id")
    turn = F.struct("turn", "role", "text")
    both = sided.groupBy("pair_id").agg(F.array_sort(F.collect_set(F.when(~F.col("second"), turn))).alias("a"), F.array_sort(F.collect_set(F.when(F.col("second"), turn))).alias("b"))
    both = both.withColumn("n_prompt", common_prefix(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("n_prompt") + 1, F.greatest(F.size(c) - F.col("n_prompt"), F.lit(0)))
    both = both.select("pair_id", "n_prompt", F.slice("a", F.lit(1), F.col("n_prompt")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    return both.select("pair_id", "n_prompt", F.size("a").alias("n_chosen"), F.size("b").alias("n_rejected"), render(F.col("p")).alias("prompt"), render(F.col("a")).alias("chosen"), render(F.col("b")).alias("rejected"), trained(F.col("a")).alias("chosen_mask"), trained(F.col("b")).alias("rejected_mask"))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts, masks as ``start:end`` comma-joined, and hashes of the three texts."""
    mask = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["s"], x["e"])), ",").alias(c)
    return formatted.select("pair_id", *[F.col(c).cast("bigint").alias(c) for c in ("n_prompt", "n_chosen", "n_rejected")], *[F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")], mask("chosen_mask"), mask("rejected_mask"))


ORACLE_SQL = """
with t as (select distinct conv_id // 2 as pair_id, conv_id % 2 as side, turn, replace(coalesce(role, ''), '<|', '<\\|') as role, replace(coalesce("text", ''), '<|', '<\\|') as txt from conversations where conv_id is not null),
n as (select *, row_number() over (partition by pair_id, side order by turn nulls first, role, txt) - 1 as i from t),
same as (select pair_id, i, count(distinct (role, txt)) = 1 and count(*) = 2 as eq from n group by pair_id, i),
pre as (select s.pair_id, coalesce(min(s.i) filter (not eq), max(s.i) + 1) as n_prompt from same s group by s.pair_id),
r as (select n.*, p.n_prompt, '<|' || role || '|>' || chr(10) || txt || '<|end|>' || chr(10) as line from n join pre p using (pair_id)),
o as (select *, coalesce(sum(length(line)) over (partition by pair_id, side order by i rows between unbounded preceding and 1 preceding), 0)::bigint as ofs from r where i >= n_prompt),
c as (select pair_id, side, count(*) as n, string_agg(line, '' order by i) as body,
  coalesce(string_agg((ofs + 5 + length(role)) || ':' || (ofs + length(line)), ',' order by i) filter (role = 'assistant'), '') as mask from o group by pair_id, side),
p as (select pair_id, string_agg(line, '' order by i) as body from r where i < n_prompt and side = 0 group by pair_id)
select pre.pair_id, n_prompt::bigint as n_prompt, coalesce(a.n, 0)::bigint as n_chosen, coalesce(b.n, 0)::bigint as n_rejected,
  sha256(coalesce(p.body, '')) as prompt_sha256, sha256(coalesce(a.body, '')) as chosen_sha256, sha256(coalesce(b.body, '')) as rejected_sha256,
  coalesce(a.mask, '') as chosen_mask, coalesce(b.mask, '') as rejected_mask
from pre left join p using (pair_id) left join c a on a.pair_id = pre.pair_id and a.side = 0 left join c b on b.pair_id = pre.pair_id and b.side = 1
"""
