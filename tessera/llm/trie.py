"""Conversation prefix trie by partition refinement.

All conversations start in one class. Each round splits the active classes by the next turn; a class that holds one
sequence only is retired, and what is left of that sequence is emitted at once as a unary chain. When no class is
active, counts are folded back from the deepest level to the root. Conversations of equal turns are one sequence from the
start, so copies cost no rounds; there are as many rounds as turns that two different sequences share, plus one.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize, table

#: Ids that are joined to one text at a time before a node's ids become one text.
ID_SPAN = 1000
#: Turns that a conversation takes from its hundred's first, in the query.
MOST_TAKEN = 5


class Trie(NamedTuple):
    """nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens; (conv_id, depth) is its key,
    and its last turn is turn number depth of conversation conv_id. sequences: seq (smallest conversation of the sequence), n_turns, copies.
    ends: seq, depth and node, where each sequence ends. members: conv_id and seq of every conversation."""

    nodes: DataFrame
    sequences: DataFrame
    ends: DataFrame
    members: DataFrame


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), role and text: by turn, null first, ties by role and text; null roles and texts are empty, rows without conv_id are left out."""
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")).alias("pos"), "role", "text")


def _halves(*cols) -> list:
    """Sums of the halves of two hashes: a digest of a set of rows that partial sums can build, far from a long's end."""
    out = []
    for seed in (1, 2):
        h = F.xxhash64(F.lit(seed), *cols)
        out += [F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"d{seed}a"), F.sum(F.shiftrightunsigned(h, 32)).alias(f"d{seed}b")]
    return out


DIGEST = ["n_turns", "d1a", "d1b", "d2a", "d2b"]


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None) -> Trie:
    """The trie of all conversations (conv_id, turn, role, text), other columns ignored; conversations adds ids that may have no turn.

    Order, nulls and ties as numbered(); a repeated row is a turn of its own. Saved tokens count code points. A conversation is
    numbered by one task; all else is dealt by sequence or class, pre-aggregated. Without conversations all tables are empty.
    """
    spark = turns.sparkSession
    running = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    chars = F.length("text").cast("long")
    placed = materialize(numbered(turns).select("conv_id", "pos", key.alias("key"), chars.alias("chars")).withColumn("through", F.sum("chars").over(running)), "turns")
    digests = placed.groupBy("conv_id").agg(F.count("*").alias("n_turns"), *_halves("pos", "key"), F.sum("chars").alias("total"))
    if conversations is not None:
        bare = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id")).distinct().join(placed.select("conv_id").distinct(), "conv_id", "left_anti")
        digests = digests.unionByName(bare.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in [*DIGEST, "total"]]))
    digests = materialize(digests, "conversations")
    sequences = materialize(digests.groupBy(*DIGEST).agg(F.min("conv_id").alias("seq"), F.count("*").alias("copies"), F.min("total").alias("total")), "sequences")
    members = materialize(digests.select("conv_id", *DIGEST).join(sequences.select("seq", *DIGEST), DIGEST).select("conv_id", "seq"), "members")
    steps = materialize(placed.withColumnRenamed("conv_id", "seq").join(sequences.select("seq", "n_turns", "total", "copies"), "seq").sortWithinPartitions("pos"), "steps")
    discard(placed, digests)

    whole = sequences.agg(F.min("seq").alias("root"), F.count("*").alias("n_seqs"))
    levels = [materialize(
        sequences.agg(F.min("seq").alias("conv_id"), F.sum("copies").alias("n_convs"), F.count("*").alias("n_seqs"), F.min("n_turns").alias("n_turns"), F.min("total").alias("total")).where("n_seqs > 0")
        .select("conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_seqs", F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("through"), "n_turns", "total"), "level")]
    found = whole.first()
    ends, active = [], None
    if found.n_seqs > 1:
        active = materialize(sequences.select("seq", "n_turns", F.lit(found.root).cast("long").alias("node")), "active")
    depth = 0
    while active is not None:
        ends.append(active.where(F.col("n_turns") == depth).select("seq", F.col("n_turns").alias("depth"), "node"))
        depth += 1
        step = materialize(active.select("seq", "node").join(steps.where(F.col("pos") == depth), "seq"), "step")
        split = step.groupBy("node", "key").agg(F.min("seq").alias("child"), F.sum("copies").alias("n_convs"), F.count("*").alias("n_seqs"), *[F.min(c).alias(c) for c in ("chars", "through", "n_turns", "total")])
        split = materialize(split, "split")
        levels.append(split.select(F.col("child").alias("conv_id"), F.col("node").alias("parent_conv_id"), "n_convs", "n_seqs", "chars", "through", "n_turns", "total"))
        still = split.where("n_seqs > 1").select("node", "key", "child")
        active = None if still.isEmpty() else materialize(step.select("seq", "node", "key", "n_turns").join(still, ["node", "key"]).select("seq", "n_turns", F.col("child").alias("node")), "active")
        discard(step)

    # retired classes: one sequence each, so the rest of it is a chain
    closed = [lv.where("n_seqs = 1").select(F.col("conv_id").alias("seq"), F.lit(d).cast("long").alias("top")) for d, lv in enumerate(levels)]
    closed_all = closed[0]
    for c in closed[1:]:
        closed_all = closed_all.unionByName(c)
    closed_all = materialize(closed_all, "closed")
    more = (F.col("copies") - 1) * (F.col("total") - F.col("through") + F.col("chars"))
    chains = steps.join(closed_all, "seq").where("pos > top").select(
        F.col("seq").alias("conv_id"), F.col("pos").cast("long").alias("depth"), F.col("seq").alias("parent_conv_id"), F.col("copies").alias("n_convs"),
        (F.col("pos") < F.col("n_turns")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), more.alias("saved_tokens"))
    nodes, below = chains, None
    for d in range(len(levels) - 1, -1, -1):
        folded = materialize(_folded(levels[d], below, d), "folded")
        nodes = nodes.unionByName(folded)
        below = folded
    tail_ends = closed_all.join(sequences.select("seq", F.col("n_turns").alias("depth")), "seq").select("seq", "depth", F.col("seq").alias("node"))
    for e in ends:
        tail_ends = tail_ends.unionByName(e)
    return Trie(nodes, sequences.select("seq", "n_turns", "copies"), tail_ends, members)


def _folded(level: DataFrame, below: DataFrame | None, depth: int) -> DataFrame:
    """A level's nodes with what lies below them: chains of retired classes in closed form, the others from their children."""
    one = F.col("n_seqs") == 1
    own = (F.col("n_convs") - 1) * F.col("chars")
    tail = (F.col("n_convs") - 1) * (F.col("total") - F.col("through"))
    if below is None:
        level = level.select("*", *[F.lit(None).cast("long").alias(c) for c in ("_children", "_leaves", "_saved")])
    else:
        sums = below.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("_children"), F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))
        level = level.join(sums, "conv_id", "left")
    return level.select(
        "conv_id", F.lit(depth).cast("long").alias("depth"), "parent_conv_id", "n_convs",
        F.when(one, (F.col("n_turns") > depth).cast("long")).otherwise(F.col("_children")).alias("n_children"),
        F.when(one, F.lit(1).cast("long")).otherwise(F.col("_leaves")).alias("n_leaves"),
        (own + F.when(one, tail).otherwise(F.col("_saved"))).alias("saved_tokens"))


def end_digests(trie: Trie) -> DataFrame:
    """depth, conv_id and ends_sha256 of the nodes where conversations end: SHA-256 of their decimal ids, ascending, joined by commas."""
    some = trie.members.groupBy("seq", F.floor(F.col("conv_id") / ID_SPAN).alias("at")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ids = some.groupBy("seq").agg(F.array_join(F.sort_array(F.collect_list(F.struct("at", "ids"))).getField("ids"), ",").alias("ids"))
    return trie.ends.join(ids, "seq").select("depth", F.col("node").alias("conv_id"), F.sha2("ids", 256).alias("ends_sha256"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The query's conversations (conv_id, turn, role, text), and their ids: the first h turns of the hundred's first one, then the own turns after the first h."""
    rows = materialize(numbered(turns), "numbered")
    ids = rows.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % (MOST_TAKEN + 1)).alias("h"))
    first = rows.where((F.col("pos") <= MOST_TAKEN) & (F.col("conv_id") % 100 == 0)).select(F.col("conv_id").alias("base"), "pos", "role", "text")
    taken = ids.join(first, "base").where("pos <= h").select("conv_id", "pos", "role", "text")
    own = rows.where(F.col("pos") > F.crc32(F.col("conv_id").cast("string")) % (MOST_TAKEN + 1))
    return taken.unionByName(own).withColumnRenamed("pos", "turn"), ids.select("conv_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    trie = prefix_trie(*rebuilt(table(spark, sf_dir, "conversations")))
    return trie.nodes.join(end_digests(trie), ["depth", "conv_id"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


#: The same from each conversation's list of turns; the CRC goes bit by bit over the decimal's characters.
OP11_SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t),
crc AS (
  SELECT conv_id, s, 0 AS step, CAST(4294967295 AS BIGINT) AS r FROM ids
  UNION ALL
  SELECT conv_id, s, step + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END
  FROM (SELECT conv_id, s, step, CASE WHEN step % 8 = 0 THEN xor(r, CAST(ascii(substr(s, step // 8 + 1, 1)) AS BIGINT)) ELSE r END AS x FROM crc WHERE step < 8 * length(s)) y),
h AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(r, CAST(4294967295 AS BIGINT)) % 6 AS h FROM crc WHERE step = 8 * length(s)),
r AS (
  SELECT h.conv_id, t.pos, t.role, t.text FROM h JOIN t ON t.conv_id = h.base AND t.pos <= h.h
  UNION ALL SELECT h.conv_id, t.pos, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id AND t.pos > h.h),
seq AS (
  SELECT h.conv_id, coalesce(list({'r': r.role, 't': r.text} ORDER BY r.pos) FILTER (WHERE r.pos IS NOT NULL), []) AS p
  FROM h LEFT JOIN r ON r.conv_id = h.conv_id GROUP BY h.conv_id),
m AS (SELECT conv_id, d, p[1:d] AS path, len(p) AS n FROM seq, unnest(range(0, len(p) + 1)) u(d)),
node AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d)), sha256('')) AS ends_sha256 FROM m GROUP BY path, d),
kids AS (SELECT path[1:d - 1] AS up, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT node.*, coalesce(kids.n, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * length(path[d].t) ELSE 0 END AS saved FROM node LEFT JOIN kids ON kids.up = node.path),
sub AS (SELECT path[1:a] AS up, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM full_, unnest(range(0, d + 1)) u(a) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM full_ f JOIN sub s ON s.up = f.path LEFT JOIN node p ON p.d = f.d - 1 AND p.path = f.path[1:f.d - 1]
"""
