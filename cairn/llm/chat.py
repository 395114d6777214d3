"""Chat formatting by rotating the perspective over a dialogue's participants (operator 3; native operations only).

For every participant the whole dialogue is rendered with that speaker as the assistant and all others as named users.
The rendering is a table of segments, one for each turn and perspective: concatenated by position they are the dialogue,
and ``start``, ``end`` are their places in it. ``loss`` is true on the assistant's own turns. So no dialogue, however long,
has to fit one row or one task, and neither do turns that share a number: rows are dealt by ranges of dialogue, perspective,
turn, speaker and text, and places are sums over a range and over the ranges before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.running import running

#: Roles that take no perspective and keep their own header.
NARRATORS = ("system",)


def rotated(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """conv_id, perspective, turn, speaker, copy, position, header, body, loss, start, end (long, in code points).

    A turn is rendered as ``<|im_start|>`` header, newline, text, ``<|im_end|>``, newline; header is ``assistant`` for the
    perspective's own turns, ``system`` for a narrator's, else ``user name=`` and the speaker. ``body_start`` and ``body_end``
    are the text's places: the mask covers them if loss is true.

    Order: by turn (nulls first), then speaker, then text; repeated rows stay, numbered by ``copy``. A null speaker is
    ``unknown``, a null text is empty, a null conversation is one of its own. ``<|`` in a speaker's name or text becomes ``< |``,
    so that no marker can be forged. A dialogue of narrators alone has no rows, as
    nobody's perspective can be taken; so has an empty table. Other columns are not read.
    """
    # what a speaker writes can't open or close a turn
    safe = lambda c, default: F.replace(F.coalesce(turns[c].cast("string"), F.lit(default)), F.lit("<|"), F.lit("< |"))
    rows = turns.select(turns[conv].alias("conv_id"), turns[turn].cast("long").alias("turn"), safe(speaker, "unknown").alias("speaker"), safe(text, "").alias("body"))
    # repeated rows are counted, not ordered
    rows = rows.groupBy("conv_id", "turn", "speaker", "body").agg(F.count("*").alias("copies"))
    roles = rows.select("conv_id", "speaker").where(~F.col("speaker").isin(*NARRATORS)).distinct().select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective"))
    seen = rows.join(roles, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own = F.col("speaker") == F.col("perspective")
    header = F.when(own, F.lit("assistant")).when(F.col("speaker").isin(*NARRATORS), F.col("speaker")).otherwise(F.concat(F.lit("user name="), "speaker"))
    seen = seen.withColumn("header", header).withColumn("loss", own)
    before, behind = F.length(F.concat(F.lit("<|im_start|>"), "header", F.lit("\n"))), F.length(F.lit("<|im_end|>\n"))
    seen = seen.withColumn("lead", before.cast("long")).withColumn("size", (before + F.length("body") + behind).cast("long"))
    # places are sums up to a turn, over ranges of turns and then over the ranges before
    placed = running(seen, ["conv_id", "perspective"], [F.col("turn"), F.col("speaker"), F.col("body")], {"chars": F.col("size") * F.col("copies"), "messages": F.col("copies")})
    joined = placed.withColumn("chars_before", F.col("chars") - F.col("size") * F.col("copies")).withColumn("messages_before", F.col("messages") - F.col("copies"))
    one = joined.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    start = F.col("chars_before") + F.col("size") * F.col("copy")
    return one.select(
        "conv_id", "perspective", "turn", "speaker", "copy", (F.col("messages_before") + F.col("copy")).alias("position"), "header", "body", "loss",
        start.alias("start"), (start + F.col("size")).alias("end"), (start + F.col("lead")).alias("body_start"), (start + F.col("lead") + F.length("body")).alias("body_end"),
    )


ROTATED_SQL = """
WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, turn, speaker, body ORDER BY conv_id) - 1 AS BIGINT) AS copy FROM t),
r AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM t WHERE speaker <> 'system'),
s AS (
  SELECT n.*, r.perspective,
    CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN speaker ELSE 'user name=' || speaker END AS header,
    speaker = perspective AS loss
  FROM n JOIN r ON n.conv_id IS NOT DISTINCT FROM r.c),
z AS (SELECT *, length('<|im_start|>' || header || chr(10)) AS lead, length('<|im_start|>' || header || chr(10)) + length(body) + 11 AS size FROM s),
w AS (SELECT *, sum(size) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body, copy) AS finish,
  row_number() OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body, copy) - 1 AS position FROM z)
SELECT conv_id, perspective, turn, speaker, copy, CAST(position AS BIGINT) AS position, header, body, loss,
  CAST(finish - size AS BIGINT) AS start, CAST(finish AS BIGINT) AS "end", CAST(finish - size + lead AS BIGINT) AS body_start, CAST(finish - size + lead + length(body) AS BIGINT) AS body_end
FROM w
"""
