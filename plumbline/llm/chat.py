"""Preference formatting of conversations (operator 6), with DataFrame functions only.

Two conversations, chosen and rejected, share the longest common prefix of their turns; it is rendered
once as the prompt, the rest of each as its completion.  The spans of a completion are the character
ranges [start, end) that are trained on: the text and end mark of assistant turns.  Everything else is
masked.

Defined cases: turns are ordered by (turn, role, text), so ties and repeated turns have one order; null
roles and texts count as empty; rows without a conversation id are left out; a conversation without a
partner is rendered whole with null on the other side; equal conversations have empty completions; an
empty table gives no rows; a very long text is one value like others; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>"


def neighbours(conversations: DataFrame) -> DataFrame:
    """Pair conversation 2k (chosen) with 2k + 1 (rejected): adds pair_id and side (0, 1)."""
    rows = conversations.where("conv_id is not null")
    return rows.select(
        F.shiftright("conv_id", 1).alias("pair_id"), F.col("conv_id").bitwiseAND(1).cast("int").alias("side"), "conv_id", "turn", "role", "text"
    )


def format_preferences(turns: DataFrame) -> DataFrame:
    """turns: pair_id, side (0 chosen, 1 rejected), conv_id, turn, role, text.

    Returns pair_id, chosen_id, rejected_id, n_common, prompt, chosen, rejected, chosen_spans,
    rejected_spans.  One exchange by pair_id serves all steps.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = turns.select("pair_id", "side", "conv_id", "turn", role.alias("role"), text.alias("text")).repartition("pair_id")
    t = t.withColumn("pos", F.row_number().over(Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text")))
    at = Window.partitionBy("pair_id", "pos")
    same = (F.count(F.lit(1)).over(at) == 2) & (F.min("role").over(at) == F.max("role").over(at)) & (F.min("text").over(at) == F.max("text").over(at))
    t = t.withColumn("same", same)
    pair = Window.partitionBy("pair_id")
    first = F.min(F.when(~F.col("same"), F.col("pos"))).over(pair)
    t = t.withColumn("n_common", (F.coalesce(first, F.max("pos").over(pair) + 1) - 1).cast("int"))
    head = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))
    t = t.withColumn("piece", F.concat(head, F.col("text"), F.lit(END + "\n"))).withColumn("common", F.col("pos") <= F.col("n_common"))
    before = Window.partitionBy("pair_id", "side", "common").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(F.char_length("piece")).over(before)
    start = stop - F.char_length("piece") + F.char_length(head)
    t = t.withColumn("span", F.when(F.col("role") == "assistant", F.concat_ws(":", start.cast("string"), (stop - 1).cast("string"))))

    def joined(when: Column, value: str, mark: str = "") -> Column:
        rows = F.sort_array(F.collect_list(F.when(when & F.col(value).isNotNull(), F.struct("pos", value))))
        return F.array_join(F.transform(rows, lambda x: x[value]), mark)

    def side(k: int, c: Column) -> Column:
        return F.when(F.max((F.col("side") == k).cast("int")) == 1, c)

    rest = ~F.col("common")
    return t.groupBy("pair_id").agg(
        F.max(F.when(F.col("side") == 0, F.col("conv_id"))).alias("chosen_id"),
        F.max(F.when(F.col("side") == 1, F.col("conv_id"))).alias("rejected_id"),
        F.max("n_common").alias("n_common"),
        joined(F.col("common") & (F.col("side") == 0), "piece").alias("prompt"),
        side(0, joined(rest & (F.col("side") == 0), "piece")).alias("chosen"),
        side(1, joined(rest & (F.col("side") == 1), "piece")).alias("rejected"),
        side(0, joined(rest & (F.col("side") == 0), "span", ",")).alias("chosen_spans"),
        side(1, joined(rest & (F.col("side") == 1), "span", ",")).alias("rejected_spans"),
    )


SQL = """
WITH t AS (
  SELECT conv_id >> 1 AS pair_id, (conv_id & 1)::INT AS side, conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
m AS (SELECT pair_id, pos, count(*) = 2 AND min(role) = max(role) AND min(text) = max(text) AS same FROM t GROUP BY pair_id, pos),
n AS (SELECT pair_id, (coalesce(min(CASE WHEN NOT same THEN pos END), max(pos) + 1) - 1)::INT AS n_common FROM m GROUP BY pair_id),
p AS (SELECT t.*, n_common, pos <= n_common AS common, '<|' || role || '|>' || chr(10) AS head,
             '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS piece FROM t JOIN n USING (pair_id)),
s AS (SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, common ORDER BY pos)::BIGINT AS stop FROM p),
q AS (SELECT *, CASE WHEN role = 'assistant' THEN (stop - length(piece) + length(head))::VARCHAR || ':' || (stop - 1)::VARCHAR END AS span FROM s)
SELECT pair_id, max(conv_id) FILTER (side = 0) AS chosen_id, max(conv_id) FILTER (side = 1) AS rejected_id, max(n_common) AS n_common,
       coalesce(string_agg(piece, '' ORDER BY pos) FILTER (common AND side = 0), '') AS prompt,
       CASE WHEN count(*) FILTER (side = 0) > 0 THEN coalesce(string_agg(piece, '' ORDER BY pos) FILTER (NOT common AND side = 0), '') END AS chosen,
       CASE WHEN count(*) FILTER (side = 1) > 0 THEN coalesce(string_agg(piece, '' ORDER BY pos) FILTER (NOT common AND side = 1), '') END AS rejected,
       CASE WHEN count(*) FILTER (side = 0) > 0 THEN coalesce(string_agg(span, ',' ORDER BY pos) FILTER (NOT common AND side = 0), '') END AS chosen_spans,
       CASE WHEN count(*) FILTER (side = 1) > 0 THEN coalesce(string_agg(span, ',' ORDER BY pos) FILTER (NOT common AND side = 1), '') END AS rejected_spans
FROM q GROUP BY pair_id
"""
