"""Preference formatting of chat conversations, in DataFrame functions only.

A chosen and a rejected conversation of one pair share their longest common prefix of turns (equal role and text, nulls
equal to each other). It is rendered once, as the prompt; what each has after it is rendered as a completion, with the
spans of characters that training counts: the texts and end marks of assistant turns.

Defined results: a pair without turns on one side gives no row; equal conversations give two empty completions; a null
role is `unknown`, a null text is empty, turns with a null number come first, ties are in the order of role and text,
and repeated turns stay. Marks inside roles and texts are defused. Rows whose pair or side is null are left out. Other
columns are not touched. An empty table gives an empty result. The unit is the conversation: its turns meet in one row,
as the result has them in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, SHUT, END = "<|", "|>", "<|end|>"
ASSISTANT = "assistant"


def _defused(text: Column) -> Column:
    return F.replace(text, F.lit(OPEN), F.lit("< |"))


def _header(turn) -> Column:
    role = F.replace(_defused(F.coalesce(turn["role"], F.lit("unknown"))), F.lit(SHUT), F.lit("| >"))
    return F.concat(F.lit(OPEN), role, F.lit(SHUT + "\n"))


def _body(turn) -> Column:
    return F.concat(_defused(F.coalesce(turn["text"], F.lit(""))), F.lit(END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t), F.lit("\n"))), "")


def mask(turns: Column) -> Column:
    """The spans [start, stop) of assistant texts and their end marks in rendered(turns); turns carry where they begin."""
    begin = F.get(turns, 0)["at"]
    own = F.filter(turns, lambda t: F.coalesce(t["role"] == ASSISTANT, F.lit(False)))
    return F.transform(own, lambda t: F.struct((t["at"] - begin + t["head"]).cast("int").alias("start"), (t["at"] - begin + t["size"] - 1).cast("int").alias("stop")))


def common_prefix(a: Column, b: Column) -> Column:
    """How many turns at the start are equal."""
    least = F.least(F.size(a), F.size(b))
    differs = lambda i: ~(F.get(a, i)["role"].eqNullSafe(F.get(b, i)["role"]) & F.get(a, i)["text"].eqNullSafe(F.get(b, i)["text"]))
    return F.coalesce(F.array_min(F.filter(F.when(least > 0, F.sequence(F.lit(0), least - 1)), differs)), least)


def pairs(turns: DataFrame, pair: Column, rejected: Column, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each pair with both sides: pair_id, n_prompt (turns), prompt, chosen, rejected, chosen_mask, rejected_mask."""
    rows = turns.select(pair.alias("pair_id"), rejected.alias("side"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).where("pair_id IS NOT NULL AND side IS NOT NULL")
    here = {"role": F.col("role"), "text": F.col("text")}
    rows = rows.repartition("pair_id").withColumn("head", F.length(_header(here))).withColumn("size", F.col("head") + F.length(_body(here)) + 1)
    # Where each turn begins in its whole conversation: one running sum, dealt as the pairs are.
    before = Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    rows = rows.select("pair_id", "side", F.struct("turn", "role", "text", "at", "head", "size").alias("entry"))
    sides = rows.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.when(~F.col("side"), F.col("entry")))).alias("a"), F.sort_array(F.collect_list(F.when(F.col("side"), F.col("entry")))).alias("b"))
    sides = sides.where("size(a) > 0 AND size(b) > 0").withColumn("n", common_prefix(F.col("a"), F.col("b")))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    a, b = rest(F.col("a")), rest(F.col("b"))
    return sides.select("pair_id", F.col("n").alias("n_prompt"), rendered(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"), rendered(a).alias("chosen"), rendered(b).alias("rejected"), mask(a).alias("chosen_mask"), mask(b).alias("rejected_mask"))


ORACLE = """
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 = 1 AS side, role, text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM conversations),
s AS (SELECT pair_id, count(*) FILTER (NOT side) AS na, count(*) FILTER (side) AS nb FROM t GROUP BY pair_id),
d AS (SELECT a.pair_id, min(a.k) AS k FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.k = b.k AND NOT a.side AND b.side
      WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text GROUP BY a.pair_id),
n AS (SELECT s.pair_id, coalesce(d.k - 1, least(na, nb)) AS n FROM s LEFT JOIN d USING (pair_id) WHERE na > 0 AND nb > 0),
r AS (SELECT pair_id, side, k, n, role, k <= n AS shared, '<|' || replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '|>', '| >') || '|>' || chr(10) AS head,
        replace(coalesce(text, ''), '<|', '< |') || '<|end|>' AS body FROM t JOIN n USING (pair_id)),
o AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY pair_id, side, shared ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start FROM r)
SELECT pair_id, any_value(n)::INT AS n_prompt,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY k) FILTER (shared AND NOT side), '') AS prompt,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY k) FILTER (NOT shared AND NOT side), '') AS chosen,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY k) FILTER (NOT shared AND side), '') AS rejected,
  coalesce(string_agg(start::BIGINT || '-' || (start + length(body))::BIGINT, ',' ORDER BY k) FILTER (NOT shared AND NOT side AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(start::BIGINT || '-' || (start + length(body))::BIGINT, ',' ORDER BY k) FILTER (NOT shared AND side AND role = 'assistant'), '') AS rejected_mask
FROM o GROUP BY pair_id
"""
