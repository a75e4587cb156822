"""Language identification: word frequencies first, then progressively shorter character n-grams for unseen words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, small_batches, table
from tessera.llm.kernels import HashTable, Words, hash_spans, mix

#: Bounds of the learned model: labelled documents for each language (those of the smallest hashes), and for all languages together (one for each at least).
SAMPLE_DOCS, SAMPLE_ALL = 1200, 40_000
#: A word seen less often in the sample counts as unseen; it still teaches n-grams.
LEAST_COUNT = 2
#: Lengths of the n-grams that unseen words fall back to, in turn. Word ends count as a character.
NGRAMS = (5, 4, 3, 2, 1)
_LETTER = regex.compile(r"\p{L}")
#: Bytes between words: all of ASCII but letters.
_BETWEEN = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


def fold(text: str) -> bytes:
    """Lower-cased UTF-8."""
    return text.lower().encode()


def held_out(parts: int, rest: int):
    """Whether crc32(doc_id as text) mod parts is rest; a null id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == rest, F.lit(False))


def word_counts(labelled: DataFrame, per_language: int = SAMPLE_DOCS) -> list[tuple[str, str, int]]:
    """(lang, word, count) of all words of a bounded sample of labelled documents (doc_id, text, lang), every language among them."""
    per = materialize(labelled.groupBy("lang").agg(F.count("*").alias("docs")), "languages")
    n_languages = per.count()
    if not n_languages:
        return []
    per_language = max(1, min(per_language, SAMPLE_ALL // n_languages))
    # hashes below a share of their range first, so that ranks are taken over few rows even of a language with a third of all; a small language comes whole
    share = per.select("lang", F.when(F.col("docs") <= 16 * per_language, F.lit(1.0)).otherwise(4.0 * per_language / F.col("docs")).alias("share"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    near = labelled.select("doc_id", "lang", place.alias("place")).join(share, "lang").where(F.col("place") < F.col("share") * (1 << 40))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    picked = near.withColumn("r", rank).where(F.col("r") <= per_language).select("doc_id", "lang").distinct()
    sample = labelled.join(F.broadcast(picked), ["doc_id", "lang"], "left_semi")  # at most SAMPLE_ALL ids, or one for each language
    words = sample.select("lang", F.explode(F.split("text", r"[\x00-\x40\x5b-\x60\x7b-\x7f]+")).alias("word")).where("word <> ''").groupBy("lang", "word").count()
    # folded here as texts are folded for a prediction
    out: dict[tuple[str, str], int] = {}
    for r in words.toLocalIterator():
        key = r.lang, r.word.lower()
        out[key] = out.get(key, 0) + r["count"]
    return [(lang, word, n) for (lang, word), n in sorted(out.items())]


def _gram_hashes(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of words, ends counted as a character each, and the words' numbers."""
    codes = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le"), "<u4").astype(np.uint64) if words else np.zeros(0, np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + codes[k : k + m] + np.uint64(1)
        h = mix(h + np.uint64(n) * np.uint64(0x9E3779B97F4A7C15))
    ok = owner[:m] == owner[n - 1 : n - 1 + m]
    return h[ok], owner[:m][ok]


class Model:
    """Log frequencies of words and n-grams for each language."""

    def __init__(self, counts: list[tuple[str, str, int]]):
        self.langs = sorted({c[0] for c in counts})
        place = {x: i for i, x in enumerate(self.langs)}
        words = sorted({c[1] for c in counts})
        at = {w: i for i, w in enumerate(words)}
        seen = np.zeros((len(words), len(self.langs)))
        for lang, word, n in counts:
            seen[at[word], place[lang]] = n
        total = seen.sum(axis=0)
        self.grams = {}
        for n in NGRAMS:
            h, owner = _gram_hashes(words, n)
            unique, back = np.unique(h, return_inverse=True)
            sums = np.stack([np.bincount(back, weights=seen[owner, k], minlength=len(unique)) for k in range(len(self.langs))], axis=1) if len(unique) else np.zeros((0, len(self.langs)))
            self.grams[n] = HashTable(unique), np.log((sums + 0.5) / (sums.sum(axis=0) + 0.5 * max(1, len(unique)))).astype(np.float32)
        keep = seen.sum(axis=1) >= LEAST_COUNT
        raw = [w.encode() for w, k in zip(words, keep, strict=True) if k]
        ends = np.cumsum([len(w) for w in raw]).astype(np.int64)
        starts = ends - [len(w) for w in raw] if raw else ends
        self.words = HashTable(hash_spans(np.frombuffer(b"".join(raw) or b" ", np.uint8), starts, ends))
        self.word_scores = np.log((seen[keep] + 0.1) / (total + 0.1 * max(1, len(raw)))).astype(np.float32)

    def _word_scores(self, hashes: np.ndarray, words) -> np.ndarray:
        """Scores per language of words: of a known word its log frequency; else the mean over its known n-grams of the greatest n that has any."""
        scores = np.zeros((len(hashes), len(self.langs)), np.float32)
        known = np.zeros(len(hashes), bool)
        which, where = self.words.find(hashes)
        scores[which] = self.word_scores[where]
        known[which] = True
        unseen = np.flatnonzero(~known)
        texts = [w.decode() for w in words(unseen)]
        left = np.arange(len(unseen))
        for n in NGRAMS:
            if not len(left):
                break
            h, owner = _gram_hashes([texts[i] for i in left], n)
            hit, where = self.grams[n][0].find(h)
            if not len(hit):
                continue
            found = np.bincount(owner[hit], minlength=len(left))
            values = self.grams[n][1][where]
            sums = np.stack([np.bincount(owner[hit], weights=values[:, k], minlength=len(left)) for k in range(len(self.langs))], axis=1)
            done = found > 0
            scores[unseen[left[done]]] = sums[done] / found[done, None]
            left = left[~done]
        return scores

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each whole text and its share of the likelihood; und and 0 for null texts and those without a letter."""
        sane = [t if t is not None and _LETTER.search(t) else "" for t in texts]
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        found = Words([fold(t) for t in sane], _BETWEEN)
        total = np.zeros((len(texts), len(self.langs)))
        if len(found.hashes):
            unique, first, back = np.unique(found.hashes, return_index=True, return_inverse=True)
            scores = self._word_scores(unique, lambda i: found.word(first[i]))
            counts = np.diff(found.first)
            full = np.flatnonzero(counts)
            starts = found.first[:-1][full]
            for k in range(len(self.langs)):
                total[full, k] = np.add.reduceat(scores[back, k].astype(np.float64), starts)
        best = total.argmax(axis=1)
        share = 1 / np.exp(np.minimum(total - total.max(axis=1, keepdims=True), 0)).sum(axis=1)
        return [self.langs[b] if s else "und" for b, s in zip(best, sane, strict=True)], np.where([bool(s) for s in sane], share, 0.0)


def learn(docs: DataFrame, test) -> Model:
    """The model of the documents with a language that `test` (a column) doesn't hold out."""
    return Model(word_counts(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~test).select("doc_id", "text", "lang")))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document, by its text alone; held_out is passed through.

    Null texts and those without a letter are und, as are all where nothing was learned. Of equally likely languages the
    first by name wins. Rows are judged one by one, whole; an empty table gives no rows; other columns don't matter.
    """
    small_batches(docs.sparkSession, 2000)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    return docs.select("doc_id", "held_out", "text").mapInArrow(lambda b: _identify(b, sent.value), "doc_id long, held_out boolean, lang_pred string, score double")


def _identify(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, score = model.predict(batch.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those not held out."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    test = held_out(4, 2)
    return identify(docs.withColumn("held_out", test), learn(docs, test))
