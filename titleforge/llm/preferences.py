"""Preference formatting, in DataFrame functions only.

A pair holds a chosen and a rejected conversation, each an array of (role, text) turns. Their longest
common turn prefix is rendered once as the prompt; what follows is rendered twice, as completions, with
the character spans that a loss counts (the texts of assistant turns; headers and other roles are masked).

Defined results: a null conversation counts as one without turns, a null role or text as an empty one.
Equal conversations leave two empty completions (``usable`` is false, as it is when a completion has no
assistant turn). Repeated pairs are formatted one by one; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titleforge.llm.common import table

OPEN, CLOSE = "<|", "|>\n"
END = "<|end|>\n"


def _turns(column: Column) -> Column:
    kind = "array<struct<role:string,text:string>>"
    clean = F.transform(column, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    return F.coalesce(clean, F.array().cast(kind))


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE), turn["text"], F.lit("\n" + END))


def _completion(turns: Column, skip: Column) -> Column:
    """Text of the turns after ``skip``, and [start, end) of each assistant text in it."""
    rest = F.slice(turns, skip + 1, F.greatest(F.size(turns) - skip, F.lit(0)))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + len(OPEN) + F.length(t["role"]) + len(CLOSE)
        end = start + F.length(t["text"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + 1 + len(END)).alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.struct(F.array_join(F.transform(rest, _rendered), "").alias("text"), F.aggregate(rest, empty, step)["spans"].alias("spans"))


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Adds n_prefix, prompt, chosen_text, chosen_mask, rejected_text, rejected_mask and usable."""
    out = pairs.withColumn("_a", _turns(F.col(chosen))).withColumn("_b", _turns(F.col(rejected)))
    a, b = F.col("_a"), F.col("_b")
    shared = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(0), shared), lambda i: (i == shared) | (F.get(a, i) != F.get(b, i)))
    out = out.withColumn("n_prefix", F.array_min(differs))
    out = out.withColumn("prompt", F.array_join(F.transform(F.slice(a, F.lit(1), F.col("n_prefix")), _rendered), ""))
    out = out.withColumn("_c", _completion(a, F.col("n_prefix"))).withColumn("_r", _completion(b, F.col("n_prefix")))
    for name, col in (("chosen", "_c"), ("rejected", "_r")):
        out = out.withColumn(f"{name}_text", F.col(col)["text"]).withColumn(f"{name}_mask", F.col(col)["spans"])
    return out.withColumn("usable", (F.size("chosen_mask") > 0) & (F.size("rejected_mask") > 0)).drop("_a", "_b", "_c", "_r")


def pairs_of(conversations: DataFrame) -> DataFrame:
    """One pair for each conversation that has an assistant turn.

    Chosen is the conversation; rejected is the same up to its last assistant turn, which is replaced by the
    last assistant turn of the conversation whose id differs in the lowest bit (without such a partner, by an
    empty text). Turns go by turn number; rows that repeat a turn count once, the smallest (role, text) first.
    """
    turns = (
        conversations.where(F.col("conv_id").isNotNull())
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_set(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    )
    last = F.array_max(F.transform(F.col("turns"), lambda t, i: F.when(t["role"] == "assistant", i)))
    turns = turns.withColumn("last", last)
    both = (
        turns.groupBy(F.shiftright("conv_id", 1).alias("pair"))
        .agg(F.collect_list(F.struct("conv_id", "turns", "last")).alias("convs"))
        .withColumn("conv", F.explode("convs"))
    )
    both = both.withColumn("other", F.try_element_at(F.filter("convs", lambda c: c["conv_id"] != F.col("conv.conv_id")), F.lit(1))).where("conv.last is not null")
    reply = F.coalesce(F.get(F.col("other.turns"), F.col("other.last"))["text"], F.lit(""))
    bare = F.transform("conv.turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    rejected = F.concat(F.slice(bare, F.lit(1), F.col("conv.last")), F.array(F.struct(F.lit("assistant").alias("role"), reply.alias("text"))))
    return both.select(F.col("conv.conv_id").alias("conv_id"), F.slice(bare, F.lit(1), F.col("conv.last") + 1).alias("chosen"), rejected.alias("rejected"))


def op4_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = lambda m: F.array_join(F.transform(m, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), " ")
    out = format_preferences(pairs_of(table(spark, sf_dir, "conversations")))
    return out.select("conv_id", F.col("n_prefix").cast("long").alias("n_prefix"), "prompt", "chosen_text", "rejected_text", spans("chosen_mask").alias("chosen_spans"), spans("rejected_mask").alias("rejected_spans"), "usable")


def _sql_turn(t: str) -> str:
    return f"'<|' || {t}.role || '|>' || chr(10) || {t}.text || chr(10) || '<|end|>' || chr(10)"


OP4_SQL = f"""
with t0 as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
t as (select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from t0),
lasts as (select conv_id, max(i) as last from t where role = 'assistant' group by conv_id),
pick as (select l.conv_id, l.last, coalesce(o.text, '') as reply, own.text as own from lasts l
  join t own on own.conv_id = l.conv_id and own.i = l.last
  left join lasts ol on ol.conv_id = xor(l.conv_id, 1)
  left join t o on o.conv_id = ol.conv_id and o.i = ol.last),
head as (select p.conv_id, string_agg({_sql_turn('t')}, '' order by t.i) as prompt from pick p join t on t.conv_id = p.conv_id and t.i < p.last group by p.conv_id),
res as (select p.conv_id, p.last - 1 + (case when own = reply then 1 else 0 end) as n_prefix, own = reply as same, own, reply, coalesce(prompt, '') as prompt from pick p left join head h using (conv_id))
select conv_id, n_prefix::bigint as n_prefix,
  prompt || case when same then '<|assistant|>' || chr(10) || own || chr(10) || '<|end|>' || chr(10) else '' end as prompt,
  case when same then '' else '<|assistant|>' || chr(10) || own || chr(10) || '<|end|>' || chr(10) end as chosen_text,
  case when same then '' else '<|assistant|>' || chr(10) || reply || chr(10) || '<|end|>' || chr(10) end as rejected_text,
  case when same then '' else '14-' || (14 + length(own)) end as chosen_spans,
  case when same then '' else '14-' || (14 + length(reply)) end as rejected_spans, not same as usable from res
"""
