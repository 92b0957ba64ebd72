"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns (role and text equal) is rendered once, as the prompt. What follows on either side is
rendered as that side's completion, with a mask as run lengths: `0:n` for n code points without loss (headers, turns of others) and
`1:n` for the text and the end mark of an assistant turn.

All work is on arrays within a row, after one aggregation by pair; a pair's two conversations are one record and
one output row. Turns are ordered by turn, role and text, so repeated rows are repeated turns. Null role and text count
as empty; rows without pair or side take no part. A pair with one side has an empty other side and complete = false. Equal sides
leave both completions empty. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planlake.llm.common import table

HEAD, END = ("<|", "|>\n"), "<|end|>\n"


def _header(t: Column) -> Column:
    return F.concat(F.lit(HEAD[0]), t["role"], F.lit(HEAD[1]))


def _body(t: Column) -> Column:
    return F.concat(t["text"], F.lit(END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def mask(turns: Column) -> Column:
    flag = lambda t: F.when(t["role"] == "assistant", F.lit("1")).otherwise(F.lit("0"))
    runs = lambda t: F.concat(F.lit("0:"), F.char_length(_header(t)).cast("string"), F.lit(","), flag(t), F.lit(":"), F.char_length(_body(t)).cast("string"))
    return F.array_join(F.transform(turns, runs), ",")


def common_turns(a: Column, b: Column) -> Column:
    """How many first turns are equal."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))

    def step(acc: Column, i: Column) -> Column:
        x, y = F.get(a, i), F.get(b, i)
        on = acc["on"] & (x["role"] == y["role"]) & (x["text"] == y["text"])
        return F.struct((acc["n"] + on.cast("int")).alias("n"), on.alias("on"))

    shorter = F.least(F.size(a), F.size(b))
    places = F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda acc: acc["n"])


def preference_pairs(turns: DataFrame) -> DataFrame:
    """turns: pair_id, side (chosen or rejected), turn, role, text."""
    row = F.struct("side", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = turns.where(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected")).groupBy("pair_id").agg(F.array_sort(F.collect_list(row)).alias("t"))
    side = lambda name: F.filter("t", lambda x: x["side"] == name)
    pairs = pairs.select("pair_id", side("chosen").alias("c"), side("rejected").alias("r")).withColumn("n", common_turns(F.col("c"), F.col("r")))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c), F.lit(1)))
    return pairs.select(
        "pair_id",
        F.col("n").cast("bigint").alias("prompt_turns"),
        rendered(F.slice("c", 1, F.col("n"))).alias("prompt"),
        rendered(rest("c")).alias("chosen"),
        mask(rest("c")).alias("chosen_mask"),
        rendered(rest("r")).alias("rejected"),
        mask(rest("r")).alias("rejected_mask"),
        ((F.size("c") > 0) & (F.size("r") > 0)).alias("complete"),
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) make pair k."""
    conv = table(spark, sf_dir, "conversations")
    side = F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected")
    return preference_pairs(conv.select(F.shiftright("conv_id", 1).alias("pair_id"), side.alias("side"), "turn", "role", "text"))


ORACLE = r"""
with t as (select conv_id // 2 as pair_id, conv_id % 2 as side, turn, coalesce(role,'') as role, coalesce(text,'') as text from conversations),
o as (select *, row_number() over (partition by pair_id, side order by turn, role, text) as i,
      '<|' || role || '|>' || chr(10) as head, text || '<|end|>' || chr(10) as body from t),
d as (select coalesce(a.pair_id, b.pair_id) as pair_id, coalesce(a.i, b.i) as i, a.i is not null and b.i is not null and a.role = b.role and a.text = b.text as same
      from (select * from o where side = 0) a full join (select * from o where side = 1) b on a.pair_id = b.pair_id and a.i = b.i),
f as (select pair_id, coalesce(min(i) filter (where not same), max(i) + 1) - 1 as n from d group by 1),
x as (select o.*, f.n, head || body as s, '0:' || length(head) || ',' || (case when role = 'assistant' then '1' else '0' end) || ':' || length(body) as m from o join f using (pair_id))
select pair_id, any_value(n) as prompt_turns,
       coalesce(string_agg(s, '' order by i) filter (where side = 0 and i <= n), '') as prompt,
       coalesce(string_agg(s, '' order by i) filter (where side = 0 and i > n), '') as chosen,
       coalesce(string_agg(m, ',' order by i) filter (where side = 0 and i > n), '') as chosen_mask,
       coalesce(string_agg(s, '' order by i) filter (where side = 1 and i > n), '') as rejected,
       coalesce(string_agg(m, ',' order by i) filter (where side = 1 and i > n), '') as rejected_mask,
       count(*) filter (where side = 0) > 0 and count(*) filter (where side = 1) > 0 as complete
from x group by pair_id
"""
