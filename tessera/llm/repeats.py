"""Suffix-array dedup over a run-length index: bytes covered by a string of LEAST bytes that an older document holds too.

A window is LEAST bytes of one text. Equal windows have equal anchors (the smallest hash of their KMER-byte parts), so
consecutive windows of one anchor travel as a piece; anchors that a single document holds can't matter and go first: pieces are
dealt by anchor, packed, and each deal keeps those of anchors that two documents hold, equal pieces as one row with all their
places. Anchors go in PARTS rounds over the texts; each ends with its marks, so one round's steps lie on disk at once. Equal
pieces become one, held by their oldest document; a piece that is its anchor's only one has no older window anywhere. All
others are dealt to buckets by anchor; a bucket's pieces become a run-length index (runindex), and each piece streams its
matching statistics against it: a window that matches LEAST bytes whose oldest holder is older than the piece's is marked.
All later holders of a piece have every window of it in an older document. An anchor of very many unlike pieces (the rims of a passage that is everywhere) would make a bucket without
bound; windows of those are dealt one by one instead, by their own hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize, small_batches, table
from tessera.llm.kernels import SpanHashes, give_back, signed
from tessera.llm.runindex import RunIndex

#: Bytes of a window, of the parts whose smallest hash is its anchor, and most windows of a piece (their marks are bits of a long).
LEAST, KMER, MOST_WINDOWS = 50, 20, 31
#: Bytes of a bucket and of the buckets of a task, on the average.
BUCKET_BYTES, TASK_BYTES = 1 << 19, 2 << 20
#: Most unlike pieces of an anchor that go to one bucket, of which they fill a part; the windows of larger groups are dealt one by one.
CROWD = 16384
#: Those windows are judged by portions of anchors, with about one window for so many bytes of text.
WINDOW_TEXT = 80
#: Texts are hashed together up to so many bytes.
HASH_BYTES = 1 << 21
#: Anchors are done in so many parts, one after the other, each from the texts anew, so that not all pieces lie on disk at once.
PARTS = 2
#: Texts are cut in pieces' bytes by so many portions of documents, so that not all texts are shuffled at once.
CUTS = 2
#: Bytes of text whose pieces (of one part) make a deal, and a task.
DEAL_TEXT, DEAL_TASK = 8 << 20, 32 << 20
#: Texts in a worker at once.
TEXT_ROWS = 500


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each width neighbours, by doubling."""
    if len(h) < width:
        return h[:0]
    m, have = h, 1
    while 2 * have <= width:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def pieces_of(texts: list[bytes], whole: bool = True, part: tuple[int, int] = (0, 1)) -> tuple[np.ndarray, ...]:
    """Of each piece (whose anchor is of one part of so many): which text, where it starts in it, how many windows it has, its anchor and, if whole, its own hash."""
    size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    first = np.concatenate([[0], np.cumsum(size)])
    buf = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(buf) < LEAST:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    hashes = SpanHashes(buf)
    low = window_minima(hashes.sliding(KMER), LEAST - KMER + 1)
    of = np.repeat(np.arange(len(texts)), size)[: len(low)]
    real = np.arange(len(low)) + LEAST <= first[1:][of]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (of[1:] != of[:-1])
    head = np.flatnonzero(new)
    # a run is cut after MOST_WINDOWS; which cuts it gets changes how windows travel, not what they meet
    within = np.arange(len(low)) - np.repeat(head, np.diff(np.append(head, len(low))))
    head = np.flatnonzero((within % MOST_WINDOWS == 0) & real)
    count = np.add.reduceat(real.astype(np.int64), np.flatnonzero(within % MOST_WINDOWS == 0))
    count = count[count > 0]
    if part[1] > 1:
        mine = low[head] % np.uint64(part[1]) == part[0]
        head, count = head[mine], count[mine]
    return of[head], head - first[of[head]], count, low[head], hashes(head, head + count + LEAST - 1) if whole else low[:0]


#: Equal pieces of a deal: all their places by document, that of the oldest document first.
PLACES = "anchor long, piece long, n int, docs array<long>, ths array<long>, starts array<int>"
#: Pieces of a group of texts that go to one deal, each column as one array; n is negative where the group itself shows two documents of the anchor.
DEALT = "deal int, doc array<long>, th array<long>, anchor array<long>, piece array<long>, start array<int>, n array<tinyint>"


def _runs(anchor: np.ndarray, doc: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by anchor, where each anchor's run begins in it, and whether it is known or has two documents."""
    order = np.argsort(anchor, kind="stable")
    begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(anchor)), bool), np.diff(anchor[order]) != 0]))
    if not len(begin):
        return order, begin, np.zeros(0, bool)
    d = doc[order]
    return order, begin, np.logical_or.reduceat(known[order], begin) | (np.minimum.reduceat(d, begin) < np.maximum.reduceat(d, begin))


def _cut(deals: int, part: int):
    """The pieces of texts whose anchors are of one part of PARTS, in deals by anchor.

    Of an anchor that a group of texts already shows in two documents one piece goes to the anchor's deal, to tell it, and
    the others anywhere; so an anchor that is everywhere fills no deal.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            text = batch.column(2).cast(pa.binary())
            size = np.array(pa.compute.binary_length(text).to_numpy(zero_copy_only=False), np.int64)
            group = np.cumsum(size) // HASH_BYTES
            for a, b in _ranges(group):
                of, start, n, anchor, piece = pieces_of(text.slice(a, b - a).to_pylist(), True, (part, PARTS))
                d, own = doc[a:b][of], signed(anchor)
                to = (anchor // np.uint64(PARTS) % np.uint64(deals)).astype(np.int32)
                order, begin, two = _runs(own, d, np.zeros(len(d), bool))
                two = np.repeat(two, np.diff(np.append(begin, len(d))))
                known = np.zeros(len(d), bool)
                known[order] = two
                two[begin] = False
                spare = order[two]
                to[spare] = spare % deals
                by = np.argsort(to, kind="stable")
                deal, first = np.unique(to[by], return_index=True)
                at = pa.array(np.append(first, len(by)).astype(np.int32))
                n = np.where(known, -n, n).astype(np.int8)
                cols = [pa.ListArray.from_arrays(at, pa.array(x[by])) for x in (d, th[a:b][of], own, signed(piece), start.astype(np.int32), n)]
                yield pa.RecordBatch.from_arrays([pa.array(deal), *cols], names=["deal", "doc", "th", "anchor", "piece", "start", "n"])
        give_back()

    return cut


def _shared(deal: pa.Table) -> pa.Table:
    """Of a deal: the pieces whose anchor two documents hold, equal ones as one row (seldom as several)."""
    doc, th, anchor, piece, start, n = (np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in deal.column(i).chunks]) for i in range(1, 7))
    order, begin, held = _runs(anchor, doc, n < 0)
    keep = order[np.repeat(held, np.diff(np.append(begin, len(order))))]
    # one number for both hashes tells the order alone; rows are cut where either changes
    mixed = anchor[keep] * np.int64(0x9E3779B97F4A7C1) + piece[keep]
    keep = keep[np.lexsort((doc[keep], mixed))]
    anchor, piece, n = anchor[keep], piece[keep], np.abs(n[keep]).astype(np.int32)
    new = np.ones(len(keep), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1]) | (n[1:] != n[:-1])
    first = np.flatnonzero(new)
    at = pa.array(np.append(first, len(keep)).astype(np.int32))
    lists = {name: pa.ListArray.from_arrays(at, pa.array(x[keep])) for name, x in (("docs", doc), ("ths", th), ("starts", start))}
    return pa.table({"anchor": anchor[first], "piece": piece[first], "n": n[first], **lists})


def _ranges(group: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(group)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)], strict=True)) if len(group) else []


def _bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each text's asked pieces (anchor, piece, start, n)."""
    for batch in batches:
        doc, asked = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
        text, sizes = batch.column(1).cast(pa.binary()).to_pylist(), asked.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = asked.flatten()
        cols = [flat.field(i).to_numpy(zero_copy_only=False) for i in range(4)]
        of = np.repeat(np.arange(len(text)), sizes)
        made = [text[t][s : s + n + LEAST - 1] for t, s, n in zip(of.tolist(), cols[2].tolist(), cols[3].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(doc[of]), pa.array(cols[0]), pa.array(cols[1]), pa.array(made, pa.binary())], names=["doc", "anchor", "piece", "bytes"])
    give_back()


def _bits(hit: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each piece, the bits of its windows that are hit; hit is over all places, a piece's windows begin at start."""
    out = np.zeros(len(start), np.int64)
    for k in range(int(n.max(initial=0))):
        ok = n > k
        out[ok] |= hit[start[ok] + k].astype(np.int64) << k
    return out


def _judge(x: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket's pieces: the windows that an older document holds, by matching statistics against the bucket's index."""
    texts, doc = x["bytes"].tolist(), x["doc"].to_numpy(np.int64)
    index = RunIndex(texts, doc, LEAST)
    length, rows, starts = index.statistics(texts)
    hit = np.zeros(len(length), bool)
    long = np.flatnonzero(length >= LEAST)
    of = np.repeat(np.arange(len(texts)), np.diff(starts))
    hit[long] = index.oldest_owner(rows[long]) < doc[of[long]]
    n = np.diff(starts) - LEAST + 1
    return pd.DataFrame({"anchor": x["anchor"].to_numpy(), "piece": x["piece"].to_numpy(), "marks": _bits(hit, starts[:-1], n)})


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of each piece by two hashes."""
    for batch in batches:
        texts = batch.column(3).to_pylist()
        n = np.array([len(t) - LEAST + 1 for t in texts], np.int64)
        first = np.concatenate([[0], np.cumsum(n + LEAST - 1)])[:-1]
        hashes = [SpanHashes(np.frombuffer(b"".join(texts), np.uint8)), SpanHashes(np.frombuffer(b"".join(texts), np.uint8) ^ np.uint8(0xA5))] if texts else []
        of = np.repeat(np.arange(len(texts)), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        at = first[of] + k
        w = [pa.array(signed(h(at, at + LEAST))) for h in hashes] or [pa.array([], pa.int64())] * 2
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(of)) for i in range(3)), pa.array(k.astype(np.int32)), *w], names=["doc", "anchor", "piece", "k", "w1", "w2"])


SPANS = "array<struct<start:long,end:long>>"


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed spans and kept bytes of each text from its marks (start, marks)."""
    for batch in batches:
        text, asked = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2)
        sizes = pa.compute.fill_null(asked.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = asked.flatten()
        start, marks = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        ends = np.cumsum(sizes)
        kept, lo, hi, count = [], [], [], [0]
        for t, a, b in zip(text, (ends - sizes).tolist(), ends.tolist(), strict=True):
            if a == b:
                kept.append(t)
                count.append(0)
                continue
            on = (marks[a:b, None] >> np.arange(MOST_WINDOWS)[None]) & 1
            piece, k = np.nonzero(on)
            at = start[a:b][piece] + k
            turn = np.zeros(len(t) + 1, np.int64)
            np.add.at(turn, at, 1)
            np.add.at(turn, at + LEAST, -1)
            gone = np.concatenate([[0], np.cumsum(turn[:-1]) > 0, [0]]).astype(np.int8)
            edge = np.diff(gone)
            lo.append(np.flatnonzero(edge == 1))
            hi.append(np.flatnonzero(edge == -1))
            count.append(len(lo[-1]))
            kept.append(np.frombuffer(t, np.uint8)[gone[1:-1] == 0].tobytes())
        pair = pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (lo, hi)], names=["start", "end"])
        spans = pa.ListArray.from_arrays(pa.array(np.cumsum(count), pa.int32()), pair)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in text], pa.int64()), spans, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])
    give_back()


def _marked(rows: DataFrame, long: DataFrame, again: bool, size: int, deals: int, tasks: int, part: int) -> DataFrame:
    """doc, th, start and marks of the pieces of one part of the anchors that have marks; nothing else of it stays on disk."""
    spark = rows.sparkSession
    small_batches(spark, TEXT_ROWS)
    shared = materialize(long.mapInArrow(_cut(deals, part), DEALT).repartition(tasks, "deal").groupBy("deal").applyInArrow(_shared, PLACES), "shared")
    oldest = F.min(F.struct(F.col("docs")[0].alias("doc"), F.col("ths")[0].alias("th"), F.col("starts")[0].alias("start")))
    unlike = materialize(shared.groupBy("anchor", "piece").agg(oldest.alias("at"), F.min("n").alias("n")).select("anchor", "piece", "at.doc", "at.th", "at.start", "n"), "unlike")
    counts = materialize(unlike.groupBy("anchor").agg(F.count("*").alias("count"), F.sum(F.col("n") + LEAST).alias("size"), F.sum("n").alias("windows")).where("count > 1"), "counts")

    asked = unlike.join(counts, "anchor", "left_semi").groupBy("doc", "th").agg(F.collect_list(F.struct("anchor", "piece", "start", "n")).alias("asked"))
    cuts = []
    for k in range(CUTS):
        mine = F.pmod(F.xxhash64("doc"), F.lit(CUTS)) == k
        holders = rows.where(mine).join(asked.where(mine), ["doc", "th"])
        if again:
            holders = holders.dropDuplicates(["doc", "th"])
        cuts.append(materialize(holders.select("doc", "text", "asked").mapInArrow(_bytes_of, "doc long, anchor long, piece long, bytes binary"), "cut"))
    cut = reduce(DataFrame.unionByName, cuts)
    crowd = materialize(counts.where(F.col("count") > CROWD).select("anchor"), "crowd")
    bucketed, crowded = (counts.agg(F.sum(F.when(F.col("count") <= CROWD, F.col("size"))), F.sum(F.when(F.col("count") > CROWD, F.col("windows")))).first()[i] or 0 for i in (0, 1))
    dealt = cut.join(crowd, "anchor", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(-(-bucketed // BUCKET_BYTES) or 1)))
    judged = dealt.repartition(-(-bucketed // TASK_BYTES) or 1, "bucket").groupBy("bucket").applyInPandas(_judge, "anchor long, piece long, marks long")
    judged = [materialize(judged, "judged")]
    small_batches(spark, 10_000)
    portions = -(-crowded * WINDOW_TEXT // size) if crowded else 0
    for k in range(portions):
        some = cut.join(crowd.where(F.pmod(F.xxhash64("anchor"), F.lit(portions)) == k), "anchor", "left_semi")
        alone = materialize(some.select("doc", "anchor", "piece", "bytes").mapInArrow(_windows, "doc long, anchor long, piece long, k int, w1 long, w2 long"), "windows")
        first = materialize(alone.groupBy("w1", "w2").agg(F.min("doc").alias("oldest"), F.max("doc").alias("newest")).where("oldest < newest").select("w1", "w2", "oldest"), "oldest")
        hit = alone.join(first, ["w1", "w2"]).where("oldest < doc").groupBy("anchor", "piece").agg(F.expr("bit_or(shiftleft(1L, k))").alias("marks"))
        judged.append(materialize(hit, "judged"))
        discard(alone, first)
    discard(*cuts, crowd, counts)
    ruled = unlike.join(reduce(DataFrame.unionByName, judged), ["anchor", "piece"], "left").select("anchor", "piece", F.col("doc").alias("holder"), F.coalesce("marks", F.lit(0).cast("long")).alias("marks"))
    ruled = materialize(ruled, "ruled")
    discard(unlike, *judged)
    places = shared.join(ruled.hint("shuffle_hash"), ["anchor", "piece"]).where("marks <> 0 OR docs[size(docs) - 1] > holder")
    each = places.select("n", "holder", "marks", "ths", "starts", F.posexplode("docs").alias("at", "doc"))
    marks = F.when(F.col("doc") > F.col("holder"), F.expr("shiftleft(1L, n) - 1L")).otherwise(F.col("marks"))
    marked = materialize(each.select("doc", F.col("ths")[F.col("at")].alias("th"), F.col("starts")[F.col("at")].alias("start"), marks.alias("marks")).where("marks <> 0"), "marked")
    discard(shared, ruled)
    return marked


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (removed bytes, from start to before end, ascending, apart) and kept (binary) of each row of docs (doc_id, text).

    Windows are judged on the texts as given; only documents of a smaller doc_id count. Rows that share an id don't see each
    other. Null texts are empty; rows without an id are kept whole and remove nothing. Repeated rows come back as often as
    given; other columns are ignored; an empty table gives no rows. kept may cut a character in two.
    """
    spark = docs.sparkSession
    small_batches(spark, TEXT_ROWS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    # texts that share an id are told apart by a hash
    again = not rows.where("doc IS NOT NULL").groupBy("doc").count().where("count > 1").isEmpty()
    rows = rows.select("doc", (F.xxhash64("text") if again else F.lit(0).cast("long")).alias("th"), "text")
    long = rows.where(F.col("doc").isNotNull() & (F.octet_length("text") >= LEAST))
    # written first, so that the joins are dealt by themselves and an anchor or a piece that is everywhere can be split
    size = long.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
    deals, tasks = -(-size // DEAL_TEXT) or 1, -(-size // DEAL_TASK) or 1
    marked = [_marked(rows, long, again, size, deals, tasks, part) for part in range(PARTS)]
    small_batches(spark, TEXT_ROWS)
    marks = reduce(DataFrame.unionByName, marked).groupBy("doc", "th").agg(F.collect_list(F.struct("start", "marks")).alias("marked"))
    return rows.join(marks, ["doc", "th"], "left").select("doc", "text", "marked").mapInArrow(_finish, f"doc_id long, n_bytes long, spans {SPANS}, kept binary")


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from each document, and the digest of what is kept."""
    out = without_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The same window by window, over the hexadecimal digits of the texts' bytes, cut in parts of 64 windows.
OP12_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, c, substr(h, 128 * c + 1, 226) AS p FROM d, unnest(range(0, len(h) // 128 + 1)) u(c)),
w AS MATERIALIZED (SELECT doc_id, 64 * c + j AS i, substr(p, 2 * j + 1, 100) AS s FROM c, unnest(range(0, least(64, len(p) // 2 - 49))) u(j)),
f AS (SELECT s, min(doc_id) AS oldest FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
m AS (SELECT w.doc_id, w.i FROM w JOIN f ON f.s = w.s AND f.oldest < w.doc_id),
g AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM m),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM g),
r AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, k),
e AS (SELECT doc_id, k, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS nx FROM r),
t AS (
  SELECT e.doc_id, sum(b - a) AS gone, count(*) AS spans,
         string_agg(substr(d.h, 2 * p + 1, 2 * (a - p)) || CASE WHEN nx IS NULL THEN substr(d.h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS h
  FROM e JOIN d ON d.doc_id = e.doc_id GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(t.gone, 0) AS BIGINT) AS n_removed, coalesce(t.spans, 0) AS n_spans, sha256(unhex(coalesce(t.h, d.h))) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""
