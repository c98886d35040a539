"""Chat formatting: one rendering of a dialogue per participant, in DataFrame functions only.

In the view of participant p, p's turns are the assistant's and the only ones
to train on; other speakers are users under their names, system turns stay
system turns and have no view.  A view is text of segments
  <|assistant|>\\n ... <|end|>\\n   or   <|user name=NAME|>\\n ... <|end|>\\n
and target spans: character ranges [start, end) of p's own words and the closing
tag.  In words and names "<|" becomes "< |", so no turn can forge a tag.

Dialogues are rendered in parts of PART turn numbers, so no task gathers a
dialogue of unbounded length; parts in order are the whole view, and offsets
count within a part.  Turn numbers are taken to be nearly unique in a dialogue.

Nulls: a null text is empty, a null role is the speaker "unknown", null turns
form part -1 at the start, a null conv_id is one dialogue.  Ties of a turn
number go by role, then text.  Repeated rows are repeated turns.  An empty table
gives an empty result.  Extra input columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PART = 256
SYSTEM = "system"


def _safe(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def _head(role: Column, speaker: Column) -> Column:
    return F.when(role == speaker, F.lit("<|assistant|>\n")).when(role == SYSTEM, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), _safe(role), F.lit("|>\n")))


def views(turns: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, speaker, part, n_turns, rendered, target_spans ("a-b,c-d") and n_target_chars."""
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = said.withColumn("part", F.coalesce(F.floor(F.col("turn") / part), F.lit(-1)))
    speakers = said.filter(F.col("role") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct()
    lines = said.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("line"))
    both = lines.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    speaker = F.col("speaker")
    seg = F.transform("line", lambda x: F.struct(_head(x["role"], speaker).alias("head"), F.concat(_safe(x["text"]), F.lit("<|end|>\n")).alias("body"), (x["role"] == speaker).alias("own")))
    both = both.withColumn("seg", seg)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).alias("own"))

    def step(acc, s):
        a = acc["at"] + F.length(s["head"])
        z = a + F.length(s["body"])
        span = F.concat_ws("-", a.cast("string"), z.cast("string"))
        return F.struct(z.alias("at"), F.when(s["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"), (acc["own"] + F.when(s["own"], z - a).otherwise(0)).alias("own"))

    both = both.withColumn("mask", F.aggregate("seg", start, step))
    return both.select(
        "conv_id", "speaker", F.col("part").cast("long").alias("part"), F.size("line").cast("long").alias("n_turns"),
        F.array_join(F.transform("seg", lambda s: F.concat(s["head"], s["body"])), "").alias("rendered"),
        F.array_join("mask.spans", ",").alias("target_spans"), F.col("mask.own").cast("long").alias("n_target_chars"),
    )


def op4_perspectives(spark, sf_dir: str) -> DataFrame:
    return views(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP4_SQL = r"""
WITH s AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, coalesce(floor(turn / 256.0), -1)::BIGINT AS part FROM conversations
), p AS (SELECT DISTINCT conv_id, role AS speaker FROM s WHERE role <> 'system'
), v AS (
  SELECT s.conv_id, p.speaker, s.part, s.turn, s.role, s.text, s.role = p.speaker AS own,
    CASE WHEN s.role = p.speaker THEN E'<|assistant|>\n' WHEN s.role = 'system' THEN E'<|system|>\n' ELSE '<|user name=' || replace(s.role, '<|', '< |') || E'|>\n' END AS head,
    replace(s.text, '<|', '< |') || E'<|end|>\n' AS body
  FROM s JOIN p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, row_number() OVER w AS i, sum(length(head) + length(body)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS z
  FROM v WINDOW w AS (PARTITION BY conv_id, speaker, part ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, speaker, part, count(*) AS n_turns, string_agg(head || body, '' ORDER BY i) AS rendered,
  coalesce(string_agg((z - length(body))::BIGINT || '-' || z::BIGINT, ',' ORDER BY i) FILTER (own), '') AS target_spans,
  coalesce(sum(length(body)) FILTER (own), 0)::BIGINT AS n_target_chars
FROM o GROUP BY conv_id, speaker, part
"""
