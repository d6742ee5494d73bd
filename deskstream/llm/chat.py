"""Chat formatting of logged conversations after collapsing cumulative snapshots.

Logs often hold a conversation again each time it grows. Every turn gets the rolling hash of the turns
up to it (128 bits: an exclusive-or of seeded hashes of position, role and text, so a prefix extends
the one before it). Conversations with equal hashes are one; those whose whole hash is the proper
prefix hash of a longer one go by an anti-join; what is left is maximal and is rendered. Prefix hashes
are made distinct before the join, so a first turn that a third of all conversations share is one row.

Defined results: rows without conv_id belong to no conversation and are left out. Exact repeats of a
row count once. Turns stand in the order of turn, role, text, missing values first; a missing role or
text is rendered as empty but differs from an empty one in comparison. Of equal conversations the
least conv_id stays. Only conv_id, turn, role and text are read. A conversation becomes one string, so
it must fit a row, whatever its number of turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deskstream.llm import common as c

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _turn_hash(seed: int):
    parts = [F.lit(seed), F.col("at")]
    for name in ("role", "text"):
        parts += [F.col(name).isNull(), F.col(name)]
    return F.xxhash64(*parts)


def positioned(turns: DataFrame) -> DataFrame:
    """(conv_id, at, turns, role, text, h1, h2): place, length and rolling prefix hashes."""
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text").dropDuplicates()
    conversation = Window.partitionBy("conv_id")
    ordered = conversation.orderBy(*[F.col(x).asc_nulls_first() for x in ("turn", "role", "text")])
    rows = rows.withColumn("at", F.row_number().over(ordered)).withColumn("turns", F.count("*").over(conversation))
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    hashes = [F.bit_xor(_turn_hash(seed)).over(so_far).alias(f"h{seed}") for seed in (1, 2)]
    return rows.select("conv_id", "at", "turns", "role", "text", *hashes)


def maximal(rows: DataFrame) -> DataFrame:
    """(conv_id, turns, n_logged) of maximal conversations; ``rows`` as ``positioned`` gives them."""
    key = ["at", "h1", "h2"]
    whole = rows.where("at = turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged"))
    prefixes = rows.where("at < turns").select(*key).distinct()
    return whole.join(prefixes, key, "left_anti").select("conv_id", F.col("at").cast("bigint").alias("n_turns"), "n_logged")


def render(rows: DataFrame) -> DataFrame:
    """(conv_id, rendered): turns between markers; markers inside texts are broken up."""
    plain = [F.replace(F.coalesce(x, F.lit("")), F.lit("<|"), F.lit("< |")) for x in ("role", "text")]
    turn = F.concat(F.lit(OPEN), plain[0], F.lit("\n"), plain[1], F.lit(CLOSE))
    joined = F.sort_array(F.collect_list(F.struct("at", turn.alias("turn"))))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(joined, lambda x: x["turn"]), "").alias("rendered"))


def chat_format(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_logged, rendered) of every maximal conversation."""
    rows = c.saved(positioned(turns), "turns")
    kept = c.saved(maximal(rows), "maximal")
    texts = rows.select("conv_id", "at", "role", "text").join(kept.select("conv_id"), "conv_id", "left_semi")
    return kept.join(render(texts), "conv_id")


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
l AS (
    SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
    FROM t GROUP BY conv_id
),
g AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS n_logged FROM l GROUP BY turns),
p AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM g))
SELECT conv_id, len(turns) AS n_turns, n_logged,
       list_aggregate(list_transform(turns, lambda x: '<|im_start|>' || replace(coalesce(x.r, ''), '<|', '< |') || chr(10)
           || replace(coalesce(x.t, ''), '<|', '< |') || '<|im_end|>' || chr(10)), 'string_agg', '') AS rendered
FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.turns = g.turns)
"""
