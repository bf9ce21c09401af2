"""Preference formatting: chosen and rejected conversations with their common turns rendered once.

``format_preferences`` takes both sides of every pair as turn rows, finds the longest prefix of turns that are alike (role and
text), renders it once as the prompt, and renders what follows of each side as its completion. A completion's mask holds the character ranges
start:end (end exclusive) of assistant texts with their end mark, which a trainer takes the loss over; all else is masked.

``answer_pairs`` makes pairs from plain conversations: ``chosen`` is a conversation up to its last assistant turn, ``rejected`` the same
with that turn's text taken from the last assistant turn of the next conversation, in order of id within a block of
``BLOCK`` ids (after the block's last: its first). Conversations without an assistant turn make no pair.

Turns stay rows and are compared and aggregated by pair, in DataFrame expressions only; what is gathered together is one conversation.
Null texts and roles count as empty. Repeated (conversation, turn) rows are kept once, the smallest (role, text) of them. Rows with a
null id or turn are left out. Extra columns are not read. Sides that are alike throughout have empty completions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
BLOCK = 1024


def turns_of(conversations: DataFrame) -> DataFrame:
    """(pair, at, role, text), one row a turn; ``at`` counts a conversation's turns from 1."""
    t = conversations.where("conv_id is not null and turn is not null").select(
        F.col("conv_id").alias("pair"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    once = t.groupBy("pair", "turn").agg(F.min(F.struct("role", "text")).alias("m"))
    return once.select("pair", F.row_number().over(W.partitionBy("pair").orderBy("turn")).alias("at"), "m.role", "m.text")


def answer_pairs(turns: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Turn rows of the chosen and of the rejected sides."""
    said = F.col("role") == "assistant"
    last = turns.where(said).groupBy("pair").agg(F.max("at").alias("last"), F.max_by("text", "at").alias("answer"))
    order = W.partitionBy(F.floor(F.col("pair") / block)).orderBy("pair")
    last = last.select("pair", "last", F.coalesce(F.lead("answer").over(order), F.first("answer").over(order)).alias("other"))
    held = turns.join(last, "pair").where("at <= last")
    text = F.when(F.col("at") == F.col("last"), F.col("other")).otherwise(F.col("text"))
    return held.select("pair", "at", "role", "text"), held.select("pair", "at", "role", text.alias("text"))


def rendered() -> F.Column:
    return F.concat(F.lit(START), F.col("role"), F.lit(MIDDLE), F.col("text"), F.lit(END))


def _joined(pieces: F.Column) -> F.Column:
    return F.array_join(F.transform(pieces, lambda x: x["whole"]), "")


def _mask(pieces: F.Column) -> F.Column:
    """Ranges of assistant texts with their end marks; the line feed after the mark is not learnt."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("mask"))

    def step(acc: F.Column, x: F.Column) -> F.Column:
        end = acc["at"] + F.char_length(x["whole"])
        span = F.array(F.concat((acc["at"] + x["head"]).cast("string"), F.lit(":"), (end - 1).cast("string")))
        return F.struct(end.alias("at"), F.when(x["learn"], F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    return F.array_join(F.aggregate(pieces, start, step, lambda acc: acc["mask"]), ",")


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row a pair: n_prefix, prompt, and completion and mask of both sides. Both inputs: pair, at, role, text."""
    rows = chosen.withColumn("side", F.lit("c")).unionByName(rejected.withColumn("side", F.lit("r")))
    # A turn is common if both sides have it alike; the prefix ends before the first that is not.
    turn = rows.groupBy("pair", "at").agg(
        F.count("*").alias("n"), F.min(F.struct("role", "text")).alias("lo"), F.max(F.struct("role", "text")).alias("hi")
    )
    prefix = turn.groupBy("pair").agg(
        F.coalesce(F.min(F.when((F.col("n") < 2) | (F.col("lo") != F.col("hi")), F.col("at"))) - 1, F.max("at")).alias("n_prefix")
    )
    head = F.char_length("role") + len(START) + len(MIDDLE)
    piece = F.struct("at", rendered().alias("whole"), head.alias("head"), (F.col("role") == "assistant").alias("learn"))
    after = F.col("at") > F.col("n_prefix")
    gather = lambda keep: F.sort_array(F.collect_list(F.when(keep, piece)))
    parts = rows.join(prefix, "pair").groupBy("pair", "n_prefix").agg(
        gather(~after & (F.col("side") == "c")).alias("p"),
        gather(after & (F.col("side") == "c")).alias("c"),
        gather(after & (F.col("side") == "r")).alias("r"),
    )
    return parts.select(
        "pair",
        F.col("n_prefix").cast("long").alias("n_prefix"),
        _joined(F.col("p")).alias("prompt"),
        _joined(F.col("c")).alias("chosen_completion"),
        _mask(F.col("c")).alias("chosen_mask"),
        _joined(F.col("r")).alias("rejected_completion"),
        _mask(F.col("r")).alias("rejected_mask"),
    )


def op9_preference_format(conversations: DataFrame) -> DataFrame:
    return format_preferences(*answer_pairs(turns_of(conversations))).withColumnRenamed("pair", "conv_id")


ORACLE_SQL = r"""
WITH m AS (SELECT conv_id, turn, min({'role': coalesce(role, ''), 'text': coalesce(text, '')}) AS m FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, m.role AS role, m.text AS text FROM m),
l AS (SELECT conv_id, max(pos) AS last, arg_max(text, pos) AS answer FROM t WHERE role = 'assistant' GROUP BY conv_id),
o AS (SELECT conv_id, last, coalesce(lead(answer) OVER w, first_value(answer) OVER w) AS other
  FROM l WINDOW w AS (PARTITION BY conv_id // 1024 ORDER BY conv_id)),
s AS (SELECT t.conv_id, pos, role, text, CASE WHEN pos = last THEN other ELSE text END AS text2 FROM t JOIN o USING (conv_id)
  WHERE pos <= last),
n AS (SELECT conv_id, coalesce(min(pos) FILTER (WHERE text <> text2) - 1, max(pos)) AS n_prefix FROM s GROUP BY conv_id),
w AS (SELECT conv_id, pos, n_prefix, role, length('<|' || role || '|>' || chr(10)) AS h, '<|' || role || '|>' || chr(10) || text ||
  '<|end|>' || chr(10) AS a, '<|' || role || '|>' || chr(10) || text2 || '<|end|>' || chr(10) AS b FROM s JOIN n USING (conv_id)),
q AS (SELECT conv_id, n_prefix, string_agg(a, '' ORDER BY pos) AS prompt FROM w WHERE pos <= n_prefix GROUP BY ALL),
c AS (SELECT *, coalesce(sum(length(a)) OVER v, 0) AS x, coalesce(sum(length(b)) OVER v, 0) AS y FROM w
  WHERE pos > n_prefix WINDOW v AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT conv_id, string_agg(a, '' ORDER BY pos) AS ca, string_agg(b, '' ORDER BY pos) AS cb,
  string_agg((x + h)::BIGINT::VARCHAR || ':' || (x + length(a) - 1)::BIGINT::VARCHAR, ','
  ORDER BY pos) FILTER (WHERE role = 'assistant') AS ma,
  string_agg((y + h)::BIGINT::VARCHAR || ':' || (y + length(b) - 1)::BIGINT::VARCHAR, ','
  ORDER BY pos) FILTER (WHERE role = 'assistant') AS mb FROM c GROUP BY conv_id)
SELECT n.conv_id, n.n_prefix::BIGINT AS n_prefix, coalesce(prompt, '') AS prompt, coalesce(ca, '') AS chosen_completion, coalesce(ma, '')
  AS chosen_mask, coalesce(cb, '') AS rejected_completion, coalesce(mb, '') AS rejected_mask
FROM n LEFT JOIN q USING (conv_id) LEFT JOIN g USING (conv_id)
"""
