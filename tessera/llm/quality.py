"""Quality rules: base counts of a text, and how far its histograms diverge from references of its language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, materialize, table, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: A language has references of its own if so many of its documents pass the base rules and are long enough; all others use those of the whole table.
LEAST_DOCS = 30
#: Texts of fewer words are not held against a histogram: of character classes, of common words.
LEAST_WORDS_CLASSES, LEAST_WORDS_COMMON = 20, 50
#: A text fails whose Jensen-Shannon distance from its reference of character classes (0 to 1) is above this.
MOST_CLASSES = 0.3
#: A text is held against common words if its language lets so many of them be expected in it: none at all then comes about once in 3,000 texts.
LEAST_EXPECTED = 8
#: A limit for common words lies so many times the way from the lowest tenth to the median above the median, but at most at this share of the distance of a text without common words.
SPREADS, MOST_OF_NONE = 6, 0.98
#: Lengths are classed by the binary digits of the number of words; a class of under LEAST_DOCS documents takes the limit of the next shorter one.
LENGTHS = 24
#: Distances are counted in bins of this width.
BIN = 0.004
#: References and limits are sent to all tasks for at most so many languages, and joined by a shuffle beyond.
BROADCAST_LANGUAGES = 4096

#: The twenty most frequent function words of English, German, French and Spanish: the bins of the common-word histogram.
COMMON = {
    "en": "the of and to a in is that it for on was with as be by this are at from",
    "de": "der die und in den von zu das mit sich des auf für ist im nicht dem ein eine als",
    "fr": "de la le et les des en un du une que pour est par qui dans avec sur pas au",
    "es": "de la que el en y los se del las un por con no su una para es al lo",
}
#: Marks of prose, and signs that prose has few of besides SYMBOLS.
MARKS = ".,;:!?'\"()-"
_MARKS, _SIGNS = r".,;:!?'\"()\-", r"@^~_=+/\\\[\]{}`"
#: Lower-case and uncased letters and the space: the bulk of a text, taken out at once before its rarer characters are counted.
_BULK = r"[a-z\x20\p{Ll}\p{Lo}\p{Lm}\p{M}]+"
_RARE = {"capitals": r"[\p{Lu}\p{Lt}]", "digits": "[0-9]", "marks": f"[{_MARKS}]", "symbols": "[#*$%&|<>]", "signs": f"[{_SIGNS}]"}
_ELSE = rf"[^\p{{L}}\p{{M}}0-9{_MARKS}#*$%&|<>{_SIGNS}\x20\x09-\x0D]"


def _common_words() -> list[str]:
    return list(dict.fromkeys(w for ws in COMMON.values() for w in ws.split()))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _taken(text: Column, pattern: str) -> Column:
    """Characters of a class."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern + "+", ""))).cast("long")


def base_counts(text: Column, ws: Column, rest: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text, its words and what is left without _BULK; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return {
        "n_words": F.size(ws).cast("long"),
        "word_chars": F.length(F.array_join(ws, "")).cast("long"),
        "n_symbols": _taken(rest, "[#*$%&|<>]"),
        "n_dup_lines": _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": repeated_words(ws),
    }


def repeated_words(ws: Column) -> Column:
    """Words within windows of WINDOW words that occur twice or more in the array ws, the first included.

    Windows are told apart by 64-bit hashes; only where some are equal are the windows themselves compared.
    """
    return _let(ws, _repeated)


def _repeated(ws: Column) -> Column:
    # the last hashes are of fewer words and never count: a window has WINDOW words
    joint = lambda h: F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))
    hashes = _let(F.transform(ws, lambda w: F.xxhash64(w)), joint)

    def exact(h: Column) -> Column:
        """Places whose window equals a neighbour's in the order of hashes, then the words that they cover."""
        placed = F.sort_array(F.filter(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))), lambda x: x["i"] <= F.size(ws) - WINDOW))
        words_ = lambda x, y: [F.get(ws, x["i"] + k) == F.get(ws, y["i"] + k) for k in range(WINDOW)]

        def same(x: Column, y: Column) -> Column:
            out = x["h"] == y["h"]
            for one in words_(x, y):
                out = out & one
            return F.coalesce(out, F.lit(False))

        again = _let(placed, lambda s: F.filter(F.transform(s, lambda x, k: F.when(same(x, F.get(s, k + 1)) | same(x, F.get(s, k - 1)), x["i"])), lambda i: i.isNotNull()))
        return _let(F.sort_array(again), lambda a: F.aggregate(F.transform(a, lambda i, k: F.least(F.coalesce(F.get(a, k + 1) - i, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda t, x: t + x))

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact(h)).cast("long"))


def histograms(text: Column, ws: Column, rest: Column, word_chars: Column) -> dict[str, Column]:
    """Counts by character class (lower case and uncased letters, capitals, digits, marks of prose, SYMBOLS, other signs, white space, all else) and by common word.

    A word counts lower-cased and without marks at its ends.
    """
    text = F.coalesce(text, F.lit(""))

    space = F.length(text).cast("long") - word_chars
    letters = F.length(text).cast("long") - F.length(rest) - (space - _taken(rest, r"[\x09-\x0D]"))
    classes = F.array(letters, *[_taken(rest, p) for p in _RARE.values()], space, _taken(rest, _ELSE))
    hits = F.filter(F.transform(ws, lambda w: F.lower(F.btrim(w, F.lit(MARKS)))), lambda w: w.isin(_common_words()))

    def runs(s: Column) -> Column:
        """Of sorted words: each unlike one and how often it comes."""
        last = F.filter(F.transform(s, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.coalesce(x["w"] != F.get(s, x["i"] + 1), F.lit(True)))
        return _let(last, lambda e: F.struct(F.transform(e, lambda x: x["w"]).alias("w"), F.transform(e, lambda x, k: (x["i"] - F.coalesce(F.get(e, k - 1)["i"], F.lit(-1))).cast("long")).alias("n")))

    every = F.array(*map(F.lit, _common_words()))
    found = _let(_let(F.sort_array(hits), runs), lambda r: F.transform(every, lambda c: F.coalesce(F.get(r["n"], (F.array_position(r["w"], c) - 1).cast("int")), F.lit(0).cast("long"))))
    return {"classes": classes, "found": found}


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda t, x: t + x)
    return _let(F.struct(counts.alias("c"), total.alias("n")), lambda s: F.transform(s["c"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(0.0)))


def _with_others(found: Column, n_words: Column) -> Column:
    used = F.aggregate(found, F.lit(0).cast("long"), lambda t, x: t + x)
    return F.concat(found, F.array(F.greatest(n_words - used, F.lit(0).cast("long"))))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance in base 2 of two arrays of shares: 0 for equal, 1 for disjoint ones."""
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    total = F.aggregate(F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x)), F.lit(0.0), lambda t, x: t + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


_WIDTHS = {"a": 8, "b": len(_common_words()) + 1}


def features(docs: DataFrame) -> DataFrame:
    """docs with the base counts, base_failed, classes and found (histograms) of each whole text; of the names in use already, the new columns win."""
    text, ws, rest = F.col("text"), F.col("_words"), F.col("_rest")
    parted = docs.withColumns({"_words": words(text), "_rest": F.regexp_replace(F.coalesce(text, F.lit("")), _BULK, "")})
    counted = parted.withColumns(base_counts(text, ws, rest))
    return counted.withColumns(histograms(text, ws, rest, F.col("word_chars")) | {"base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))}).drop("_words", "_rest")


def language_references(counted: DataFrame) -> DataFrame:
    """key, n, ra and rb: mean shares of classes and of common words of each language's documents that pass the base rules and have LEAST_WORDS_COMMON words or more.

    key is "=" and the language, for languages of LEAST_DOCS such documents or more, and "*" for the whole table. Sums are
    pre-aggregated to a row for each language, and rounded so that the order of summing doesn't matter.
    """
    sane = counted.where(~F.col("base_failed") & (F.col("n_words") >= LEAST_WORDS_COMMON))
    shares = sane.select("lang", _shares(F.col("classes")).alias("a"), _shares(_with_others(F.col("found"), F.col("n_words"))).alias("b"))
    per = shares.groupBy("lang").agg(F.count("*").alias("n"), *[F.sum(F.col(c)[i]).alias(f"{c}{i}") for c, w in _WIDTHS.items() for i in range(w)])
    own = per.where(F.col("lang").isNotNull() & (F.col("n") >= LEAST_DOCS)).select(F.concat(F.lit("="), "lang").alias("key"), *per.columns[1:])
    whole = per.agg(*[F.sum(c).alias(c) for c in per.columns[1:]]).where("n > 0").select(F.lit("*").alias("key"), "*")
    return own.unionByName(whole).select("key", "n", *[F.array(*[F.round(F.col(f"{c}{i}") / F.col("n"), 9) for i in range(w)]).alias(f"r{c}") for c, w in _WIDTHS.items()])


def _length_class(n: Column) -> Column:
    return F.least(F.length(F.bin(n)), F.lit(LENGTHS - 1)).cast("int")


def common_limits(held: DataFrame, references: DataFrame) -> DataFrame:
    """key, k and most: the greatest js_common of each language with a reference of its own, by class of length.

    held: _key, n_words and js_common of all documents. A limit follows from the median and the lowest tenth of a class,
    which junk hardly moves, and is wider for short texts, whose distances scatter more; it is always below the distance of
    a text without any common word. Where few common words are to be expected there is no row, and no limit.
    """
    none = distance(F.array(*[F.lit(0.0)] * (_WIDTHS["b"] - 1), F.lit(1.0)), F.col("rb"))
    own = references.where("key <> '*'").select("key", F.round(none * MOST_OF_NONE, 6).alias("none"), F.round(1 - F.col("rb")[_WIDTHS["b"] - 1], 9).alias("share"))
    bins = held.where((F.col("_key") != "*") & F.col("js_common").isNotNull()).groupBy(F.col("_key").alias("key"), _length_class(F.col("n_words")).alias("k"), F.floor(F.col("js_common") / BIN).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    group = Window.partitionBy("key", "k")
    upto = F.sum("n").over(group.orderBy("bin"))
    marked = bins.withColumns({"upto": upto, "whole": F.sum("n").over(group)})
    at = lambda share: (F.min(F.when(F.col("upto") >= share * F.col("whole"), F.col("bin"))) + 0.5) * BIN
    sums = marked.groupBy("key", "k").agg(F.max("whole").alias("whole"), at(0.5).alias("mid"), at(0.1).alias("low"))
    wide = F.col("mid") + SPREADS * F.greatest(F.col("mid") - F.col("low"), F.lit(BIN))
    limit = F.when(F.col("whole") >= LEAST_DOCS, F.least(F.col("none"), wide))
    carried = F.last(limit, ignorenulls=True).over(Window.partitionBy("key").orderBy("k"))
    return sums.join(own, "key").select("key", "k", "share", F.round(F.coalesce(carried, F.col("none")), 6).alias("most"))


def verdicts(counted: DataFrame) -> DataFrame:
    """counted with js_classes, js_common and kept; classes and found go."""
    references = materialize(language_references(counted), "references")
    n_keys = references.count()
    sent = F.broadcast if n_keys <= BROADCAST_LANGUAGES else lambda x: x
    known = references.where("key <> '*'").select(F.col("key").alias("_own"))
    n = F.col("n_words")
    keyed = counted.join(sent(known), F.concat(F.lit("="), F.col("lang")) == F.col("_own"), "left").withColumn("_key", F.coalesce("_own", F.lit("*")))
    held = keyed.join(sent(references.select(F.col("key").alias("_key"), F.col("ra").alias("_ra"), F.col("rb").alias("_rb"))), "_key", "left").withColumns(
        {
            "js_classes": F.when(n >= LEAST_WORDS_CLASSES, F.round(distance(_shares(F.col("classes")), F.col("_ra")), 6)),
            "js_common": F.when(n >= LEAST_WORDS_COMMON, F.round(distance(_shares(_with_others(F.col("found"), n)), F.col("_rb")), 6)),
        }
    )
    limits = common_limits(held, references).select(F.col("key").alias("_key"), F.col("k").alias("_k"), F.col("share").alias("_share"), F.col("most").alias("_most"))
    judged = held.withColumn("_k", _length_class(n)).join(sent(limits), ["_key", "_k"], "left")
    off = F.coalesce((n * F.col("_share") >= LEAST_EXPECTED) & (F.col("js_common") > F.col("_most")), F.lit(False))
    verdict = ~F.col("base_failed") & ~(F.coalesce("js_classes", F.lit(0.0)) > MOST_CLASSES) & ~off
    return judged.withColumn("kept", verdict).drop("_key", "_own", "_k", "_ra", "_rb", "_share", "_most", "classes", "found")


#: The columns that judge() adds.
JUDGED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "js_classes", "js_common", "kept")


def _counted(docs: DataFrame) -> DataFrame:
    """The whole rows as _row, lang and the counts, written down: a filter on counts must not pull their expressions apart, and texts are counted once."""
    return materialize(features(docs.select(F.struct("*").alias("_row"), "lang", "text")).drop("text"), "quality")


def judge(docs: DataFrame) -> DataFrame:
    """docs with JUDGED: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, js_classes, js_common and kept.

    A null text counts as empty and fails the base rules. A text below a guard's number of words isn't held against
    that histogram (its distance is null). How far a text's common words may be off follows from the distances of its
    language's documents of about its length (common_limits). A language that is null or rare is held against the
    whole table's reference for its classes and has no limit for common words, as it may have others; without any
    reference (an empty table, no document that passes the base rules) nothing is rejected for its divergence. Other
    columns stay, those of the names in JUDGED are replaced. Rows are judged one by one: repeated rows get equal verdicts.
    """
    rest = [c for c in docs.columns if c not in JUDGED]
    return verdicts(_counted(docs)).select(*[F.col("_row")[c].alias(c) for c in rest], *JUDGED)


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with the columns they had."""
    return verdicts(_counted(docs)).where("kept").select("_row.*")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' counts and verdicts; the texts are read once, their counts kept for the verdicts."""
    counted = materialize(features(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).drop("text"), "quality")
    return verdicts(counted).select("doc_id", *JUDGED)


def _sql() -> str:
    """op1_quality in DuckDB."""
    words_, common = r"[^\x20\x09-\x0D]+", _common_words()
    q = lambda p: p.replace("'", "''")
    count = lambda p: f"len(regexp_extract_all(t, '{q(p)}'))"
    of = [count(p) for p in _RARE.values()] + ["length(t) - length(array_to_string(w, ''))", count(_ELSE)]
    found = ", ".join(f"len(list_filter(x, lambda y: y = '{w}'))" for w in common)
    shares = lambda c: f"list_transform({c}, lambda x: x / greatest(list_sum({c}), 1))"
    mean = lambda c, n: ", ".join(f"round(sum({c}[{i + 1}]) / count(*), 9)" for i in range(n))
    js = lambda p, r: f"sqrt(greatest(list_sum(list_transform(range(1, len({r}) + 1), lambda i: CASE WHEN {p}[i] > 0 THEN {p}[i] * log2(2 * {p}[i] / ({p}[i] + {r}[i])) ELSE 0 END + CASE WHEN {r}[i] > 0 THEN {r}[i] * log2(2 * {r}[i] / ({p}[i] + {r}[i])) ELSE 0 END)) / 2, 0))"
    none = f"[{', '.join(['0.0::DOUBLE'] * len(common) + ['1.0::DOUBLE'])}]"
    at = lambda share: f"(min(bin) FILTER (upto >= {share} * whole) + 0.5::DOUBLE) * {BIN}::DOUBLE"
    ref = f"[{mean('a', 8)}] AS ra, [{mean('b', len(common) + 1)}] AS rb"
    return f"""
WITH c AS MATERIALIZED (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{words_}') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 3, 1))) AS i, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM c),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g), (SELECT unnest(range({WINDOW})) AS k) WHERE c > 1 GROUP BY doc_id),
f AS (SELECT c.doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {count("[#*$%&|<>]")} AS n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{words_}'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{words_}')))) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words, [{", ".join(of)}] AS kinds, length(t) AS size, list_transform(w, lambda y: lower(trim(y, '{q(MARKS)}'))) AS x FROM c LEFT JOIN r ON r.doc_id = c.doc_id),
h AS (SELECT * EXCLUDE (x), n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, [{found}] AS hits FROM f),
s AS MATERIALIZED (SELECT * EXCLUDE (kinds, size, hits), {shares("list_prepend(size - list_sum(kinds), kinds)")} AS a, {shares("list_append(hits, greatest(n_words - list_sum(hits), 0))")} AS b FROM h),
z AS (SELECT * FROM s WHERE NOT base_failed AND n_words >= {LEAST_WORDS_COMMON}),
m AS (SELECT lang, {ref} FROM z WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= {LEAST_DOCS}),
d AS (SELECT {ref} FROM z HAVING count(*) > 0),
j AS (SELECT s.*, m.lang AS own, coalesce(m.ra, d.ra) AS ra, coalesce(m.rb, d.rb) AS rb FROM s LEFT JOIN m ON m.lang = s.lang LEFT JOIN d ON true),
v AS MATERIALIZED (SELECT * EXCLUDE (a, b, ra, rb), CASE WHEN n_words >= {LEAST_WORDS_CLASSES} THEN round({js("a", "ra")}, 6) END AS js_classes, CASE WHEN n_words >= {LEAST_WORDS_COMMON} THEN round({js("b", "rb")}, 6) END AS js_common, least(length(bin(n_words)), {LENGTHS - 1}) AS k FROM j),
e AS (SELECT own, k, CAST(floor(js_common / {BIN}::DOUBLE) AS INTEGER) AS bin, count(*) AS n FROM v WHERE own IS NOT NULL AND js_common IS NOT NULL GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY own, k ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY own, k) AS whole FROM e),
p AS (SELECT own, k, max(whole) AS whole, {at(0.5)} AS mid, {at(0.1)} AS low FROM u GROUP BY own, k),
o AS (SELECT own, k, round(1 - rb[{len(common) + 1}], 9) AS share, round({MOST_OF_NONE}::DOUBLE * {js(none, "rb")}, 6) AS none, whole, mid, low FROM p JOIN m ON m.lang = p.own),
i AS (SELECT own, k, share, round(coalesce(last_value(CASE WHEN whole >= {LEAST_DOCS} THEN least(none, mid + {SPREADS} * greatest(mid - low, {BIN}::DOUBLE)) END IGNORE NULLS) OVER (PARTITION BY own ORDER BY k), none), 6) AS most FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, js_classes, js_common,
  NOT base_failed AND NOT coalesce(js_classes, 0) > {MOST_CLASSES} AND NOT coalesce(n_words * share >= {LEAST_EXPECTED} AND js_common > most, false) AS kept FROM v LEFT JOIN i USING (own, k)"""


OP1_SQL = _sql()
