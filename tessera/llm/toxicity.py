"""Toxicity scores of whole documents by the recurrent network of gru.py."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, small_batches, table, word_count
from tessera.llm.gru import Toxicity, train
from tessera.llm.langid import held_out

#: Bounds of the training sample, for each label: documents (those of the smallest hashes), and words after which no more documents are taken; words of the vocabulary.
SAMPLE_DOCS, SAMPLE_WORDS, MODEL_WORDS = 1500, 600_000, 20_000
#: A document counts as toxic from this score on.
THRESHOLD = 0.7


def training_rows(docs: DataFrame, labels: DataFrame) -> list:
    """(text, toxic, known) of at most SAMPLE_DOCS labelled documents of each label, in the order of their hashes, until they have SAMPLE_WORDS words; known is how many documents have the label in all.

    Labels of other rows than docs' are never looked at, not even counted. Null texts teach nothing; a document with
    unlike labels counts as toxic, equal rows count once.
    """
    known = labels.where("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = materialize(known.join(docs.select("doc_id"), "doc_id", "left_semi"), "labelled")
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 40))
    share = F.when(F.col("toxic") == 1, min(1.0, 2 * SAMPLE_DOCS / max(1, n.get(1, 0)))).otherwise(min(1.0, 2 * SAMPLE_DOCS / max(1, n.get(0, 0))))
    near = known.withColumn("place", place).where(F.col("place") < share * (1 << 40))
    first = Window.partitionBy("toxic").orderBy("place", "doc_id")
    some = near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= 2 * SAMPLE_DOCS).drop("r")
    # the ids are few; the texts stay where they are until it is known which are taken
    hashed = docs.where(F.col("text").isNotNull()).join(F.broadcast(some), "doc_id").withColumn("h", F.xxhash64("text"))
    sized = hashed.select("doc_id", "h", "toxic", "place", word_count(F.col("text")).alias("n")).dropDuplicates(["doc_id", "h"])
    order = Window.partitionBy("toxic").orderBy("place", "doc_id", "h")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = materialize(sized.withColumns({"r": F.row_number().over(order), "before": before}).where((F.col("r") <= SAMPLE_DOCS) & (F.col("before") < SAMPLE_WORDS)).select("doc_id", "h", F.col("r"), "toxic"), "sample")
    texts = docs.where(F.col("text").isNotNull()).withColumn("h", F.when(F.col("doc_id").isNotNull(), F.xxhash64("text"))).join(F.broadcast(taken), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])
    known = F.when(F.col("toxic") == 1, n.get(1, 0)).otherwise(n.get(0, 0)).cast("long").alias("known")
    return texts.orderBy("toxic", "r").select("text", "toxic", known).collect()


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """doc_id, held_out, score and predicted of each document, by its whole text alone.

    Null texts and those without words score 0. Rows are scored one by one, so repeated texts score alike; an empty table
    gives no rows, and without labelled rows all scores are those of the untrained network. Other columns don't matter.
    """
    small_batches(docs.sparkSession, 1000)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MODEL_WORDS
    return docs.select("doc_id", "held_out", "text").mapInArrow(lambda b: _score(b, sent.value), "doc_id long, held_out boolean, score double, predicted int")


def _score(batches: Iterator[pa.RecordBatch], model: Toxicity) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s = np.round(model.score(batch.column(2).to_pylist()).astype(np.float64), 6)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from the labels of those not held out."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    test = held_out(3, 1)
    rows = training_rows(docs.where(~test & F.col("doc_id").isNotNull()), table(spark, sf_dir, "labels"))
    model = train([r.text for r in rows], np.array([r.toxic for r in rows], np.int64), MODEL_WORDS, known_labels={r.toxic: r.known for r in rows})
    return score(docs.withColumn("held_out", test), model)
