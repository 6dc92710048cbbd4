"""Chat formatting by prefix-target expansion: one training example for each reply of the assistant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, STOP, TARGET = "<|", "|>\n", "<|end|>\n", "assistant"
#: What an opening mark within a text or role becomes, so that no turn can forge another.
ESCAPED = "< |"


def prefix_targets(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target: str = TARGET) -> DataFrame:
    """(conv_id, turn, position, n_context, text, train_start, train_end) for each turn whose role is `target`.

    text holds all turns before it and the reply itself, each as  <|role|> line feed, words, <|end|> line feed. Only the
    characters from train_start, counted from 0, to before train_end are to be learnt: the reply and its end mark. Opening
    marks within texts and roles are escaped. Texts of any length are kept whole.

    Turns go by number, then role, then text; a null number comes first. position counts them from 1, so repeated turns stay
    apart, each being context of the next. Roles are trimmed and put in lower case; a null or blank one is "unknown". A null
    text is an empty one, and an empty reply is an example of the end mark alone. Rows with a null conversation are left out.
    Other columns are not read; an empty table gives none.
    """
    escape = lambda x: F.replace(x, F.lit(OPEN), F.lit(ESCAPED))
    role = escape(F.lower(F.trim(F.coalesce(F.col(role_col).cast("string"), F.lit("")))))
    turns = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn_col).cast("long").alias("turn"), F.when(role == "", "unknown").otherwise(role).alias("role"), escape(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("words")
        ).alias("turn"),
    ).filter("conv_id is not null")
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    pieces = F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["words"], F.lit(STOP)))
    found = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == target)
    # one prefix at a time is put together, row by row, so a long conversation never holds all of its prefixes
    rows = grouped.select("conv_id", "turns", pieces.alias("pieces"), F.explode(found).alias("position"))
    own = F.element_at("turns", F.col("position"))
    rows = rows.select("conv_id", own["turn"].alias("turn"), "position", own["words"].alias("words"), F.array_join(F.slice("pieces", 1, F.col("position") - 1), "").alias("context"))
    head = OPEN + target + CLOSE
    start = F.length("context") + len(head)
    return rows.select(
        "conv_id",
        "turn",
        F.col("position").cast("long").alias("position"),
        (F.col("position") - 1).cast("long").alias("n_context"),
        F.concat("context", F.lit(head), "words", F.lit(STOP)).alias("text"),
        start.cast("long").alias("train_start"),
        (start + F.length("words") + len(STOP) - 1).cast("long").alias("train_end"),
    )


#: DuckDB SQL of `prefix_targets` over the table conversations.
SQL = """
with turns as (
  select conv_id, turn, case when r = '' then 'unknown' else r end as role, replace(coalesce(text, ''), '<|', '< |') as words
  from (select *, replace(lower(trim(coalesce(role, ''))), '<|', '< |') as r from conversations where conv_id is not null)
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, words) as position,
    '<|' || role || '|>' || chr(10) || words || '<|end|>' || chr(10) as piece
  from turns
), prefixed as (
  select *, coalesce(string_agg(piece, '') over (partition by conv_id order by position rows between unbounded preceding and 1 preceding), '') as context
  from placed
)
select conv_id, turn, position, position - 1 as n_context,
  context || '<|assistant|>' || chr(10) || words || '<|end|>' || chr(10) as text,
  cast(length(context) + 14 as bigint) as train_start,
  cast(length(context) + 14 + length(words) + 7 as bigint) as train_end
from prefixed where role = 'assistant'
"""
