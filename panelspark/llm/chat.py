"""Chat formatting: a dialogue seen by each of its participants, with DataFrame functions only.

For every participant (a distinct role of the conversation other than ``system``) the whole dialogue is
rendered once: that participant's turns as the assistant, the turns of others as user turns with their
names, system turns as they are. A result row is one turn in one perspective: its rendered segment, where
it starts and ends in the rendered dialogue (code points), and the range to learn, which is the content and
end mark of the assistant's own turns. Joining a perspective's segments in order gives the dialogue; no task
holds a whole dialogue, however long.

What stands in a text or a name cannot forge a turn: a mark's opening ``<|im_`` there gets a backslash, ``<|\\im_``, and one more if it
has some already, so that taking one away gives the text back (``unescaped``); line ends in a name become spaces.

Places come from sums in two levels: within chunks of ``CHUNK`` turn numbers, then over a conversation's chunks.

Edge cases: a null text is rendered as empty, a null role as ``unknown``, a null turn comes first; null conv_ids form one
conversation. Turns with the same number are ordered by role and text; equal rows keep their number. A
conversation with system turns only has no perspective and no rows. Columns other than the four are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import table

CHUNK = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|(\\*)im_", r"<|\\$1im_")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|\\(\\*)im_", r"<|$1im_")


def perspectives(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, seq, turn, speaker, shown_role, segment, start, end, learn_from, learn_to."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62))))
    speakers = rows.where("speaker <> 'system'").select("conv_id", F.col("speaker").alias("perspective")).distinct()
    seen = rows.alias("r").join(speakers.alias("p"), F.col("r.conv_id").eqNullSafe(F.col("p.conv_id"))).select("r.*", "p.perspective")
    own, system = F.col("speaker") == F.col("perspective"), F.col("speaker") == "system"
    role = F.when(own, "assistant").when(system, "system").otherwise("user")
    head = F.concat(F.lit(OPEN), role, F.when(~own & ~system, F.concat(F.lit(" name="), F.translate(escaped(F.col("speaker")), "\n", " "))).otherwise(""), F.lit("\n"))
    seen = seen.select("conv_id", "perspective", "chunk", "turn", "speaker", "text", role.alias("shown_role"), F.length(head).alias("head_size"), F.concat(head, escaped(F.col("text")), F.lit(CLOSE)).alias("segment"))
    seen = seen.withColumn("size", F.length("segment").cast("long"))
    within = Window.partitionBy("conv_id", "perspective", "chunk").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, 0)
    seen = seen.withColumns({"upto": F.sum("size").over(within), "nth": F.count("*").over(within)})
    chunks = seen.groupBy("conv_id", "perspective", "chunk").agg(F.sum("size").alias("chunk_size"), F.count("*").alias("chunk_n"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("*", F.coalesce(F.sum("chunk_size").over(before), F.lit(0)).alias("size_before"), F.coalesce(F.sum("chunk_n").over(before), F.lit(0)).alias("n_before"))
    same = F.col("s.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("s.perspective") == F.col("c.perspective")) & (F.col("s.chunk") == F.col("c.chunk"))
    both = seen.alias("s").join(chunks.alias("c"), same).select("s.*", "size_before", "n_before")
    end = F.col("size_before") + F.col("upto")
    start = end - F.col("size")
    learns = F.col("shown_role") == "assistant"
    return both.select(
        "conv_id", "perspective", (F.col("n_before") + F.col("nth") - 1).alias("seq"), "turn", "speaker", "shown_role", "segment", start.alias("start"), end.alias("end"),
        F.when(learns, start + F.col("head_size")).alias("learn_from"), F.when(learns, end - 1).alias("learn_to"))


def op8(spark, sf_dir):
    return perspectives(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
speakers AS (SELECT DISTINCT conv_id, speaker AS perspective FROM rows WHERE speaker <> 'system'),
seen AS (
  SELECT r.*, perspective, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS shown_role
  FROM rows r JOIN speakers p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
headed AS (
  SELECT *, '<|im_start|>' || shown_role || CASE WHEN shown_role = 'user' THEN ' name=' || translate(regexp_replace(speaker, '<\|(\\*)im_', '<|\\\1im_', 'g'), chr(10), ' ') ELSE '' END || chr(10) AS head FROM seen),
cut AS (SELECT *, head || regexp_replace(text, '<\|(\\*)im_', '<|\\\1im_', 'g') || '<|im_end|>' || chr(10) AS segment FROM headed),
placed AS (
  SELECT *, sum(length(segment)) OVER w AS ending, count(*) OVER w - 1 AS seq FROM cut
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, CAST(seq AS BIGINT) AS seq, turn, speaker, shown_role, segment,
  CAST(ending - length(segment) AS BIGINT) AS start, CAST(ending AS BIGINT) AS "end",
  CASE WHEN shown_role = 'assistant' THEN CAST(ending - length(segment) + length(head) AS BIGINT) END AS learn_from,
  CASE WHEN shown_role = 'assistant' THEN CAST(ending - 1 AS BIGINT) END AS learn_to
FROM placed
"""
