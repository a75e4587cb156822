"""N-gram Jaccard join: count vectors of hashed tokens in R-trees bound overlaps; surviving pairs are verified.

A document's set holds the 64-bit hashes of its distinct shingles. Jaccard of 0.8 or more leaves |A & B| >= 0.8 max(|A|, |B|), so
under any one order of all shingles two linked sets share one of their first n - ceil(0.8 n) + 1 shingles (the
prefix). Shingles of prefixes deal the documents to blocks; within a block, count vectors (of how many shingles hash to
each of GROUPS groups) are points: min-sums of coordinates bound overlaps, node by node in an R-tree. What survives is
verified on the whole sets. The order puts shingles last that a bounded sample shows to be frequent; it changes the
work, never the result.

Copies of one set are one class from the start. A block's smallest class is compared with all its others first, then
its PIVOTS smallest with those of other components than theirs; in what is left of large blocks only pairs of unlike
components are looked for. Links within a component can't change it, so no group's pairs are ever all made. Before
whole sets travel, finer count vectors (of FINE shingles a group) must allow the link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize, small_batches, table, word_count
from tessera.llm.components import components
from tessera.llm.kernels import give_back, mix, signed, word_hashes

SHINGLE = 5
#: Linked from so many hundredths of the union on.
PERCENT = 80
#: Groups of the count vectors.
GROUPS = 64
#: Shingles of a group of the finer vectors, on the average.
FINE = 4
#: Documents whose shingles show which are frequent, how often they must occur there, and how many are kept.
SAMPLE_DOCS, FREQUENT, MOST_FREQUENT = 4000, 8, 100_000
#: Classes of a block that all others are compared with first.
PIVOTS = 8
#: Rows of a block that meet at once; larger blocks are cut, and each pair of cuts meets.
CUT_ROWS = 256
#: Points of an R-tree's leaf, children of a node.
LEAF, FAN = 16, 8
#: Pairs whose whole sets are in a Python worker at once.
SET_ROWS = 50
#: From here on are the ids of classes whose smallest document stands for another class too.
OWN_IDS = 1 << 62
#: Bits of the filter that tells which documents' sets are needed.
FILTER_BITS = 20


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles; fewer words make one shingle, none an empty set."""
    hashes, first = word_hashes([t.encode().lower() for t in texts])
    joint = np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if len(hashes) >= SHINGLE:
            joint = np.zeros(len(hashes) - SHINGLE + 1, np.uint64)
            for k in range(SHINGLE):
                joint = joint * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(joint)]
            joint = mix(joint)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                out.append(np.unique(joint[a : b - SHINGLE + 1]))
            elif b > a:
                h = np.uint64(b - a)
                for x in hashes[a:b]:
                    h = h * np.uint64(0xD6E8FEB86659FD93) + x
                out.append(mix(np.array([h])))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def prefix_size(n: int) -> int:
    """Shingles of a set of n that must be looked at."""
    return n - (PERCENT * n + 99) // 100 + 1 if n else 0


def count_vector(s: np.ndarray) -> np.ndarray:
    """How many of a set fall to each group."""
    return np.bincount((s >> np.uint64(64 - GROUPS.bit_length() + 1)).astype(np.int64), minlength=GROUPS).astype("<i4")


def fine_vector(s: np.ndarray) -> bytes:
    """Counts over as many groups (a power of two) as the set has FINE shingles each; 255 stands for 255 or more."""
    bits = min(16, max(3, (len(s) // FINE).bit_length()))
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def fine_bound(a: bytes, b: bytes) -> int:
    """Greatest overlap that two finer vectors allow; the longer is folded to the other's groups."""
    x, y = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (a, b))
    x[x == 255], y[y == 255] = 1 << 40, 1 << 40
    if len(x) < len(y):
        x, y = y, x
    return int(np.minimum(x.reshape(len(y), -1).sum(axis=1), y).sum())


def _digest(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0).to_pylist()
        sets = shingle_sets(batch.column(1).to_pylist())
        rows = []
        for k, s in zip(keys, sets, strict=True):
            order = mix(s ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(8)
            if len(frequent) and len(s):
                at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                order |= np.where(frequent[at] == s, rank[at], 0).astype(np.uint64) << np.uint64(56)
            p = prefix_size(len(s))
            first = s[np.argpartition(order, p - 1)[:p]] if p and p < len(s) else s[:p]
            with np.errstate(over="ignore"):
                h1 = _first_hash(s)
                h2 = int(signed(np.array([np.bitwise_xor.reduce(mix(s + np.uint64(0x2545F4914F6CDD1D)))]))[0]) if len(s) else 0
            rows.append((k, len(s), h1, h2, signed(first), count_vector(s).tobytes(), fine_vector(s)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.list_(pa.int64())), pa.array(cols[5], pa.binary()), pa.array(cols[6], pa.binary())], names=["doc_id", "n", "h1", "h2", "prefix", "counts", "fine"])
    give_back()


def _all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in shingle_sets(batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(signed(s))], names=["shingle"])


def frequent_shingles(docs: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample of about SAMPLE_DOCS documents, at most MOST_FREQUENT, and the class of their frequency (1 to 60)."""
    share = max(1, n_docs // SAMPLE_DOCS)
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(share)) == 0)
    counts = sample.mapInArrow(_all_shingles, "shingle long").groupBy("shingle").count().where(F.col("count") >= FREQUENT)
    rows = counts.orderBy(F.desc("count"), "shingle").limit(MOST_FREQUENT).toPandas()
    values = rows["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], np.minimum(60, 1 + np.log2(rows["count"].to_numpy(np.float64) + 1) * 3).astype(np.int64)[order]


def _needed(a, b):
    """Least overlap of linked sets of a and b shingles: 100 i >= 80 (a + b - i)."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


class RTree:
    """Count vectors packed to leaves of LEAF points, in the order of their sizes and largest coordinates; nodes know their bounds."""

    def __init__(self, n: np.ndarray, counts: np.ndarray):
        self.order = np.lexsort((counts.argmax(axis=1), n))
        n, counts = n[self.order], counts[self.order]
        self.n, self.counts = n, counts
        self.levels = []
        low, high, top = n, n, counts
        width = LEAF
        while True:
            cuts = np.arange(0, len(low), width)
            low, high, top = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(top, cuts, axis=0)
            self.levels.append((low, high, top))
            if len(low) == 1:
                break
            width = FAN

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child and number of children of nodes of a level."""
        width, below = (LEAF, len(self.n)) if level == 0 else (FAN, len(self.levels[level - 1][0]))
        first = node * width
        return first, np.minimum(width, below - first)


def _expand(tree: RTree, level: int, node: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, size = tree.children(level, node)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(first, size) + at, np.repeat(other, size)


def tree_join(x: RTree, y: RTree) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of points of two trees whose min-sums reach the overlap that a link needs; nodes that can't hold such a pair are never opened."""
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    la, lb = len(x.levels) - 1, len(y.levels) - 1
    while True:
        bounds = [(t.levels[k] if k >= 0 else (t.n, t.n, t.counts)) for t, k in ((x, la), (y, lb))]
        (alo, ahi, atop), (blo, bhi, btop) = bounds
        kept = []
        for i in range(0, len(a), 1 << 15):
            p, q = a[i : i + (1 << 15)], b[i : i + (1 << 15)]
            ok = (100 * ahi[p] >= PERCENT * blo[q]) & (100 * bhi[q] >= PERCENT * alo[p])
            p, q = p[ok], q[ok]
            most = np.minimum(atop[p], btop[q]).sum(axis=1, dtype=np.int64)
            ok = most >= _needed(np.maximum(alo[p], PERCENT * blo[q] // 100), np.maximum(blo[q], PERCENT * alo[p] // 100))
            kept.append((p[ok], q[ok]))
        a, b = np.concatenate([k[0] for k in kept]) if kept else a[:0], np.concatenate([k[1] for k in kept]) if kept else b[:0]
        if la < 0 and lb < 0:
            return x.order[a], y.order[b]
        if not len(a):
            return a, b
        if la >= lb:
            a, b = _expand(x, la, a, b)
            la -= 1
        else:
            b, a = _expand(y, lb, b, a)
            lb -= 1


def _points(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i4").reshape(-1, GROUPS)


def _block_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs of unlike components within a cut, or between two cuts, of a block that the trees can't rule out."""
    sides = [rows[rows["side"] == s] for s in (0, 1)]
    if not len(sides[0]) or (rows["i"].iloc[0] != rows["j"].iloc[0] and not len(sides[1])):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    trees = [RTree(s["n"].to_numpy(), _points(s["counts"])) if len(s) else None for s in sides]
    other = trees[1] or trees[0]
    u, v = tree_join(trees[0], other)
    far = sides[1] if len(sides[1]) else sides[0]
    a, b = sides[0]["doc"].to_numpy()[u], far["doc"].to_numpy()[v]
    ok = (sides[0]["component"].to_numpy()[u] != far["component"].to_numpy()[v]) & (a != b)
    a, b = a[ok], b[ok]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _bounded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in frames:
        need = _needed(x["na"].to_numpy(), x["nb"].to_numpy())
        ok = np.fromiter((fine_bound(f, g) for f, g in zip(x["fa"], x["fb"], strict=True)), np.int64, len(x)) >= need
        yield x.loc[ok, ["a", "b", "da", "ha", "db", "hb"]]


def _first_hash(s: np.ndarray) -> int:
    """A hash of a whole set."""
    with np.errstate(over="ignore"):
        return int(signed(np.array([mix(s).sum(dtype=np.uint64)]))[0])


def _sets(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        place = filter_place(keys)
        wanted = np.flatnonzero(bits[place >> 3] >> (place & 7) & 1)
        if len(wanted):
            sets = shingle_sets(batch.column(1).take(pa.array(wanted)).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(keys[wanted]), pa.array([_first_hash(s) for s in sets], pa.int64()), pa.array([signed(s).tobytes() for s in sets], pa.binary())], names=["doc", "h1", "set"])
    give_back()


def filter_place(ids: np.ndarray) -> np.ndarray:
    """The bit of each id in the filter."""
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in frames:
        yield pd.DataFrame({"place": np.unique(filter_place(x["doc"].to_numpy()))})


def _verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in frames:
        ok = np.zeros(len(x), bool)
        for i, (s, t) in enumerate(zip(x["sa"], x["sb"], strict=True)):
            s, t = np.frombuffer(s, np.int64).view(np.uint64), np.frombuffer(t, np.int64).view(np.uint64)
            if len(s) > len(t):
                s, t = t, s
            both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
            ok[i] = 100 * both >= PERCENT * (len(s) + len(t) - both)
        yield x.loc[ok, ["a", "b"]]
    give_back()


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links, itself included) of each document.

    docs: doc_id (long) and text. Null and blank texts have no shingles and link with nothing; nor do rows without an
    id, whose component is null. Rows that share an id count as linked. Repeated rows come back as often as given.
    """
    spark = docs.sparkSession
    small_batches(spark, 1000)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(rows, rows.count()))  # at most MOST_FREQUENT
    digests = materialize(rows.mapInArrow(lambda b: _digest(b, *frequent.value), "doc_id long, n long, h1 long, h2 long, prefix array<long>, counts binary, fine binary"), "digests")

    # classes of equal sets, known by their smallest document; where that stands for more than one set, all but one get ids of their own
    real = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    key = ["n", "h1", "h2"]
    # written first, so that the join below is dealt by itself and a class of very many copies can be split
    classes = materialize(digests.where(real).groupBy(*key).agg(F.min("doc_id").alias("lead")), "classes")
    if not classes.groupBy("lead").count().where("count > 1").isEmpty():
        first = classes.groupBy("lead").agg(F.min(F.struct(*key)).alias("first"))
        own = F.when(F.struct(*key) == F.col("first"), F.col("lead")).otherwise(F.lit(OWN_IDS) + F.monotonically_increasing_id())
        classes = materialize(classes.join(first, "lead").select(*key, "lead", own.alias("doc")), "classes")
    else:
        classes = classes.withColumn("doc", F.col("lead"))
    members = materialize(digests.where(real).select("doc_id", *key).join(classes, key).select("doc_id", "doc", "n"), "members")
    # rows that share an id tie their classes
    many = members.groupBy("doc_id").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("doc_id", "a")
    ties = materialize(members.join(many, "doc_id").where("doc <> a").select("a", F.col("doc").alias("b")).distinct(), "ties")
    points = digests.where(real).withColumnRenamed("doc_id", "lead").join(classes, ["lead", *key]).select("doc", "lead", "h1", "n", "prefix", "counts", "fine")
    points = materialize(points.dropDuplicates(["doc"]), "points")

    heads = materialize(digests.select("doc_id", "n"), "heads")
    discard(digests, classes)

    # blocks: the classes whose prefixes share a shingle
    dealt = points.select("doc", "n", F.explode("prefix").alias("shingle"))
    shared = dealt.groupBy("shingle").agg(F.count("*").alias("size")).where("size > 1")
    blocks = materialize(dealt.join(shared, "shingle"), "blocks")
    rank = F.row_number().over(Window.partitionBy("shingle").orderBy("doc"))
    pivots = materialize(blocks.select("shingle", F.col("doc").alias("pivot"), F.col("n").alias("pn"), rank.alias("r")).where(F.col("r") <= PIVOTS), "pivots")
    alike = (100 * F.col("n") >= PERCENT * F.col("pn")) & (100 * F.col("pn") >= PERCENT * F.col("n")) & (F.col("doc") != F.col("pivot"))

    def tried(rows: DataFrame, pivots: DataFrame) -> DataFrame:
        return rows.join(pivots, "shingle").where(alike).select(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b")).distinct()

    def verify(pairs: DataFrame) -> DataFrame:
        """The pairs that link."""
        side = lambda x: points.select(F.col("doc").alias(x), F.col("lead").alias(f"d{x}"), F.col("h1").alias(f"h{x}"), F.col("n").alias(f"n{x}"), F.col("fine").alias(f"f{x}"))
        bounded = materialize(pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(_bounded, "a long, b long, da long, ha long, db long, hb long"), "pairs")
        held = bounded.select(F.explode(F.array("da", "db")).alias("doc")).mapInPandas(_places, "place long").distinct().toPandas()["place"].to_numpy(np.int64)  # at most 2 ** FILTER_BITS
        bits = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
        np.bitwise_or.at(bits, held >> 3, (1 << (held & 7)).astype(np.uint8))
        sent = spark.sparkContext.broadcast(bits)
        # the filter lets a few others through; the joins by document leave them out
        sets = materialize(rows.where("doc_id IS NOT NULL").mapInArrow(lambda b: _sets(b, sent.value), "doc long, h1 long, set binary"), "sets")
        whole = lambda x: sets.select(F.col("doc").alias(f"d{x}"), F.col("h1").alias(f"h{x}"), F.col("set").alias(f"s{x}"))
        small_batches(spark, SET_ROWS)
        links = materialize(bounded.join(whole("b"), ["db", "hb"]).join(whole("a"), ["da", "ha"]).mapInPandas(_verified, "a long, b long").distinct(), "links")
        small_batches(spark, 1000)
        discard(bounded, sets)
        return links

    def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
        """Pairs whose components differ."""
        of = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
        return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    links = verify(tried(blocks, pivots.where("r = 1")))
    found = materialize(components(links.unionByName(ties)), "components")
    more = materialize(apart(tried(blocks.where("size > 2"), pivots.where("r > 1")), found), "more")
    if not more.isEmpty():
        links = links.unionByName(verify(more))
        found = materialize(components(links.unionByName(ties)), "components")
    # what is left of blocks in which the pivots didn't meet all
    large = blocks.where(F.col("size") > PIVOTS + 1).join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    split = large.groupBy("shingle").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("shingle")
    cuts = F.ceil(F.col("size") / CUT_ROWS).cast("int")
    left = large.join(split, "shingle").join(points.select("doc", "counts"), "doc").withColumn("cuts", cuts).withColumn("cut", F.pmod(F.xxhash64("doc"), F.col("cuts")).cast("int"))
    meets = left.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select(
        "shingle", F.least("cut", "k").alias("i"), F.greatest("cut", "k").alias("j"), F.when(F.col("cut") <= F.col("k"), 0).otherwise(1).alias("side"), "doc", "n", "component", "counts"
    )
    rest = meets.groupBy("shingle", "i", "j").applyInPandas(_block_pairs, "a long, b long").distinct()
    rest = materialize(rest, "rest")
    discard(blocks, pivots, more)
    if not rest.isEmpty():
        found = materialize(components(links.unionByName(ties).unionByName(verify(rest))), "components")
    linked = members.join(found.withColumnRenamed("node", "doc"), "doc", "left").select("doc_id", F.coalesce("component", "doc").alias("component")).groupBy("doc_id").agg(F.min("component").alias("component"))
    discard(points, rest)
    return heads.join(linked, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs of the smallest doc_id of each component, one for each such id; rows without an id or without words stay."""
    groups = near_components(docs)
    first = groups.where("n_shingles > 0 AND doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    first = materialize(first, "representatives")
    empty = F.col("doc_id").isNull() | (word_count(F.col("text")) == 0)
    # the ids grow with the table, so texts and ids are dealt alike at every size
    kept = docs.where(~empty).join(first.where("rows = 1").select("doc_id").hint("merge"), "doc_id", "left_semi")
    again = first.where("rows > 1").select("doc_id")
    if not again.isEmpty():
        order = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
        twice = docs.where(~empty).join(again, "doc_id", "left_semi").select(F.struct("*").alias("_row"), "doc_id", "text")
        kept = kept.unionByName(twice.withColumn("_r", order).where("_r = 1").select("_row.*"))
    return kept.unionByName(docs.where(empty))


def op10_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents."""
    return near_components(table(spark, sf_dir, "documents"))


#: The same by all pairs that share a shingle, in DuckDB.
OP10_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS m FROM n UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.v),
c AS (SELECT v, min(m) AS m FROM r GROUP BY v)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.m, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.v = w.doc_id
"""
