"""Secret scans: candidates by pattern, false positives removed by a random forest over what they look like and where they stand."""

from __future__ import annotations

import random
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

#: A run of key characters of at least LEAST characters with a digit and a letter among them.
LEAST = 12
_SET = r"A-Za-z0-9_+/\-"
CANDIDATE = rf"(?<![{_SET}])(?=[{_SET}]{{{LEAST}}})(?=[A-Za-z_+/\-]*[0-9])(?=[0-9_+/\-]*[A-Za-z])[{_SET}]+={{0,2}}"
#: Characters before and after a candidate that are looked at.
BEFORE, AFTER = 48, 24
#: A candidate is a secret from this mean vote of the trees on.
THRESHOLD = 0.5
TREES, DEPTH, FINDINGS, SEED = 15, 5, 2400, 7
MASK = "[SECRET]"

# Words that stand before secrets, words that stand before other long tokens, prefixes of issued keys, words that names are made of.
SECRET_WORDS = "secret token password passwd pwd api_key apikey api-key access_key auth bearer credential private_key"
OTHER_WORDS = "commit sha sha1 sha256 md5 checksum digest uuid guid revision etag build version isbn doi image file path id"
ISSUED = "AKIA ASIA ghp_ gho_ ghs_ xoxb- xoxp- sk_live_ sk- rk_live_ AIza eyJ glpat- npm_"
NAME_WORDS = "user name test file image version build model index page data value item list table update config server client module package release section chapter report photo draft final backup copy document session order product number sample"

FEATURES = ("length", "digits", "capitals", "smalls", "changes", "distinct", "vowels", "hex", "words", "slashes", "path", "issued", "secret_word", "other_word", "assigned", "quoted")


def _any(words: str) -> str:
    return "|".join(w.replace("-", r"\-") for w in words.split())


def features(value: Column, before: Column, after: Column) -> list[Column]:
    """FEATURES of a candidate and the text around it, as doubles."""
    n = F.length(value).cast("double")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    changes = r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [
        n,
        share("[0-9]"),
        share("[A-Z]"),
        share("[a-z]"),
        F.regexp_count(value, F.lit(changes)) / (n - 1),
        F.size(F.array_distinct(F.split(value, ""))) / n,
        share("[aeiouAEIOU]"),
        flag(value.rlike("^[0-9a-fA-F]+$")),
        1 - F.length(F.regexp_replace(F.lower(value), _any(NAME_WORDS), "")) / n,
        share("[/_\\-]"),
        flag(before.rlike(r"(?:https?://\S*|[/\\])$") | after.rlike(r"^(?:/|\.[a-z]{2,4}\b)")),
        flag(value.rlike(f"^(?:{_any(ISSUED)})")),
        flag(before.rlike(rf"(?i)(?:{_any(SECRET_WORDS)})\W{{0,6}}$")),
        flag(before.rlike(rf"(?i)\b(?:{_any(OTHER_WORDS)})\W{{0,6}}$")),
        flag(before.rlike(r"[=:]\s*[\"']?$")),
        flag(before.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]")),
    ]


def labelled_findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, str, str, int]]:
    """(value, before, after, label): n findings of known label, half of them secrets, made by rule from a seed."""
    rng = random.Random(seed)
    hexes, upper, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    names, prose = NAME_WORDS.split(), "the of and to in was that with for on as by from then here".split()
    words = lambda k: " ".join(rng.choice(prose + ["thon", "ering", "heit", "leaux", "osado"]) for _ in range(k))

    def secret() -> tuple[str, str, str]:
        kind = rng.randrange(6)
        if kind == 0:
            return rng.choice(["AKIA", "ASIA"]) + some(upper, 16), words(4) + " ", " " + words(2)
        if kind == 1:
            return rng.choice(["ghp_", "sk_live_", "xoxb-", "npm_", "glpat-", "AIza"]) + some(mixed, rng.choice([24, 30, 36])), words(3) + rng.choice([" ", "=", ": ", ' "']), " " + words(2)
        if kind == 2:
            return some(hexes, rng.choice([32, 40, 64])), f'{words(2)} {rng.choice(SECRET_WORDS.split())} = "', '" ' + words(2)
        if kind == 3:
            return some(rng.choice([hexes, mixed]), rng.randrange(14, 26)), f"{words(2)} {rng.choice(['password', 'passwd', 'pwd', 'secret'])}{rng.choice(['=', ': ', ' = '])}", " " + words(2)
        if kind == 4:
            return some(mixed + "+/", rng.randrange(32, 64)), f"{words(2)} {rng.choice(SECRET_WORDS.split())}{rng.choice([': ', '=', ' = ', ' '])}", rng.choice([" ", "\n"]) + words(1)
        return "eyJ" + some(mixed + "_-", rng.randrange(30, 80)), f"{words(1)} Authorization: Bearer ", " " + words(1)

    def other() -> tuple[str, str, str]:
        kind = rng.randrange(7)
        if kind == 0:
            return some(hexes, rng.choice([32, 40, 64])), f"{words(2)} {rng.choice(OTHER_WORDS.split())}{rng.choice([' ', ': ', '='])}", " " + words(2)
        if kind == 1:
            return "-".join(some(hexes, k) for k in (8, 4, 4, 4, 12)), words(3) + rng.choice([" ", " id "]), " " + words(2)
        if kind == 2:
            return rng.choice("_-").join(rng.choice(names) for _ in range(rng.randrange(2, 4))) + rng.choice("_-") + some("0123456789", rng.randrange(1, 7)), words(3) + rng.choice([" ", " file ", "/"]), rng.choice([" ", ".png", ".html "]) + words(1)
        if kind == 3:
            return "/".join(rng.choice(names) + some("0123456789", rng.randrange(0, 3)) for _ in range(rng.randrange(2, 5))) + some("0123456789", 2), f"{words(2)} https://", rng.choice([" ", ".html ", "/"]) + words(1)
        if kind == 4:
            return some(hexes, 40), f"{words(1)} https://example.org/{rng.choice(['commit', 'blob', 'tree'])}/", " " + words(2)
        if kind == 5:
            return "".join(rng.choice(names).capitalize() for _ in range(rng.randrange(2, 5))) + some("0123456789", rng.randrange(1, 4)), words(3) + " ", rng.choice([" ", "(", ". "]) + words(1)
        return some("0123456789", rng.randrange(10, 16)) + rng.choice(["px", "ms", "th", "EUR", "km"]), words(3) + " ", " " + words(2)

    made = [(*(secret() if i % 2 == 0 else other()), 1 - i % 2) for i in range(n)]
    return [(v, b[-BEFORE:], a[:AFTER], y) for v, b, a, y in made]


class Forest:
    """Decision trees as complete binary trees: node i's children are 2 i + 1 and 2 i + 2."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.depth = depth
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            size = (1 << (depth + 1)) - 1
            feature, cut, vote = [0] * size, [float("inf")] * size, [0.0] * size
            held = {0: rows}
            for node in range(size):
                own = held.get(node, rows[:0])
                vote[node] = float(y[own].mean()) if len(own) else vote[(node - 1) // 2]
                if node < (1 << depth) - 1 and len(own) >= 8 and 0 < vote[node] < 1:
                    best = min((self._split(x[own, f], y[own]) + (f,) for f in rng.choice(x.shape[1], 4, replace=False)), key=lambda s: (s[0], s[2]))
                    if np.isfinite(best[0]):
                        feature[node], cut[node] = int(best[2]), float(best[1])
                        left = x[own, best[2]] <= best[1]
                        held[2 * node + 1], held[2 * node + 2] = own[left], own[~left]
                        continue
                if node < (1 << depth) - 1:
                    held[2 * node + 1] = own
            self.trees.append((feature, cut, vote))

    @staticmethod
    def _split(v: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """Least Gini impurity of a cut, and the cut."""
        order = np.argsort(v, kind="stable")
        v, y = v[order], y[order].astype(float)
        left = np.cumsum(y)[:-1]
        n = np.arange(1, len(y))
        ok = v[1:] > v[:-1]
        if not ok.any():
            return float("inf"), 0.0
        right = y.sum() - left
        m = len(y) - n
        score = np.where(ok, 2 * (left * (1 - left / n) + right * (1 - right / m)), np.inf)
        at = int(score.argmin())
        return float(score[at]), float((v[at] + v[at + 1]) / 2)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean vote of the trees."""
        total = np.zeros(len(x))
        for feature, cut, vote in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = np.where(x[np.arange(len(x)), np.array(feature)[node]] <= np.array(cut)[node], 2 * node + 1, 2 * node + 2)
            total += np.array(vote)[node]
        return total / len(self.trees)

    def column(self, x: Column) -> Column:
        """The same for an array column of features, by array look-ups alone."""
        inner = (1 << self.depth) - 1

        def vote(feature: list[int], cut: list[float], votes: list[float]) -> Column:
            asked, cuts = F.array(*map(F.lit, feature[:inner])), F.array(*[F.lit(min(c, 1e300)) for c in cut[:inner]])
            down = lambda n, _: F.when(F.get(x, F.get(asked, n)) <= F.get(cuts, n), 2 * n + 1).otherwise(2 * n + 2)
            leaf = F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), F.lit(0), down)
            return F.get(F.array(*[F.lit(round(v, 9)) for v in votes]), leaf)

        total = sum((vote(*tree) for tree in self.trees), F.lit(0.0))
        return total / len(self.trees)


@cache
def _trained(app: str) -> Forest:
    spark = SparkSession.active()
    rows = spark.createDataFrame(labelled_findings(), "value string, before string, after string, label int")
    got = rows.select("label", F.array(*features(F.col("value"), F.col("before"), F.col("after"))).alias("x")).collect()  # FINDINGS rows
    return Forest(np.array([r.x for r in got]), np.array([r.label for r in got]))


def forest(spark: SparkSession) -> Forest:
    """The forest learned from the labelled findings, whose features are taken by the same columns as the texts'."""
    return _trained(spark.sparkContext.applicationId)


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per candidate of each whole text: key, ord (from 0), value, and up to BEFORE and AFTER characters around it, as far as the neighbouring candidates."""
    body = F.coalesce(F.col(text), F.lit(""))
    hit = docs.select(F.col(key), body.alias("_text")).where(F.col("_text").rlike(CANDIDATE))
    parts = hit.select(key, F.regexp_extract_all("_text", F.lit(CANDIDATE), F.lit(0)).alias("_values"), F.split("_text", CANDIDATE, -1).alias("_between"))
    each = parts.select(key, "_between", F.posexplode("_values").alias("ord", "value"))
    return each.select(key, "ord", "value", F.right(F.get("_between", F.col("ord")), F.lit(BEFORE)).alias("_b"), F.left(F.get("_between", F.col("ord") + 1), F.lit(AFTER)).alias("_a"))


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per candidate of each whole text: key, ord (from 0), value, score (mean vote) and secret.

    Null and empty texts and empty tables have none; a value that comes again in a text is a candidate each time, and
    repeated rows are each searched. A score of just THRESHOLD makes a secret. Other columns don't matter.
    """
    scored = candidates(docs, key, text).withColumn("_x", F.array(*features(F.col("value"), F.col("_b"), F.col("_a")))).withColumn("score", F.round(forest(docs.sparkSession).column(F.col("_x")), 6))
    return scored.select(key, "ord", "value", "score", (F.col("score") >= THRESHOLD).alias("secret"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every secret of a text turned to MASK; all rows and columns stay."""
    body = F.coalesce(F.col("text"), F.lit(""))
    model = forest(docs.sparkSession)

    def masked(s: Column) -> Column:
        """The parts between candidates and the candidates, each as it is or masked."""
        around = lambda v, i: features(v, F.right(F.get(s["between"], i), F.lit(BEFORE)), F.left(F.get(s["between"], i + 1), F.lit(AFTER)))
        one = lambda v, i: F.transform(F.array(F.array(*around(v, i))), lambda x: F.when(F.round(model.column(x), 6) >= THRESHOLD, MASK).otherwise(v))[0]
        return F.concat(F.get(s["between"], F.lit(0)), F.array_join(F.transform(s["found"], lambda v, i: F.concat(one(v, i), F.get(s["between"], i + 1))), ""))

    parts = F.struct(F.regexp_extract_all(body, F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split(body, CANDIDATE, -1).alias("between"))
    return docs.withColumn("text", F.when(body.rlike(CANDIDATE), F.transform(F.array(parts), masked)[0]).otherwise(F.col("text")))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of all documents and their verdicts; the values as their SHA-256 and length, so that no secret leaves in clear."""
    found = findings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "ord", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), F.length("value").alias("length"), "score", "secret")
