"""The operators against plain Python versions of the same."""

import collections
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.llm import gru, hostrank, langid, mixing, secretscan, toxicity


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("aeioubcdfgklmnprst"), rng.integers(2, 8))) for _ in range(n))


# ---- link graph


def test_propagation(spark):
    """Trust and distrust of a made graph against whole matrices, and verdicts of hosts that only links can judge."""
    rng = np.random.default_rng(1)
    n = 300
    links = [(f"h{a}.io", f"h{b}.io") for a, b in rng.integers(0, n, (1500, 2)) if a != b]
    links += [(f"many{k}.io", "bad.net") for k in range(200)]  # one blocked host that many link to
    links += [("list.io", f"h{k}.io") for k in range(99)] + [("list.io", "bad.net")]
    links += [("good.net", "kept.io"), ("kept.io", "bad.net")]
    html = collections.defaultdict(list)
    for a, b in links:
        html[a].append(f'<a data-href="//no.net/" href="http://{b}/x">')
    html["bad.net"], html["good.net"] = html["bad.net"] or [""], html["good.net"]
    hosts = sorted(set(html) | {b for _, b in links})
    rows = [(i, f"http://{h}/" + ("en/" if h == "good.net" else ""), " ".join(html[h])) for i, h in enumerate(hosts)]
    rules = (("net/", "block"), ("good.net/en/", "allow"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"score": F.lit(1), "trust": F.lit("x"), "seed": F.lit(2)})
    got = {r.host: r for r in hostrank.judge_urls(pages, rules).collect()}
    place = {h: i for i, h in enumerate(hosts)}
    w = np.zeros((len(hosts), len(hosts)))
    for a, b in links:
        w[place[a], place[b]] += 1
    share = w / np.maximum(w.sum(axis=1, keepdims=True), 1)
    eye = np.eye(len(hosts))
    blocked, allowed = np.array([float(h == "bad.net") for h in hosts]), np.array([float(h == "good.net") for h in hosts])
    distrust = np.linalg.solve(eye - hostrank.DAMPING * share, blocked)
    trust = np.linalg.solve(eye - hostrank.DAMPING * share.T, allowed)
    for h, i in place.items():
        assert abs(got[h].distrust - distrust[i]) < 0.02 and abs(got[h].trust - trust[i]) < 0.02
        if h not in ("bad.net", "good.net"):
            assert abs(distrust[i] - trust[i] - hostrank.MARGIN) < 0.02 or got[h].verdict == ("block" if distrust[i] - trust[i] >= hostrank.MARGIN else "allow")
    assert {got[f"many{k}.io"].verdict for k in range(200)} == {"block"} and got["list.io"].verdict == got["kept.io"].verdict == "allow"
    assert len(got) == len(hosts) and "no.net" not in got


# ---- source mix


def plain_mix(sized, hashes, targets, reverse):
    """taken and first slot of each row by walking the schedule."""
    needed = {k: targets[k]["slots"] for k in sorted(targets) if targets[k]["slots"]}
    bits = next(b for b in range(6, 64) if sum(needed.values()) + len(needed) * b <= 1 << b)
    n = sum(needed.values()) + len(needed) * bits
    slots, ranks = [], collections.Counter()
    for slot in range(n):
        place = Fraction(int(f"{slot:0{bits}b}"[::-1], 2) if reverse else slot, 1 << bits) * n
        for k, want in needed.items():
            if place < want + bits:
                break
            place -= want + bits
        if ranks[k] < want:
            slots.append((slot, k, ranks[k]))
        ranks[k] += 1
    taken, first = collections.Counter(), {}
    laid = {k: [] for k in targets}
    for uid, doc_id, k, size in sorted(sized, key=lambda x: (hashes[x[0]], x[1], x[3], x[0])):
        laid[k] += [uid] * size
    for slot, k, r in sorted(slots):
        t = targets[k]
        block = laid[k][(r % t["blocks"]) * mixing.BLOCK :][: mixing.BLOCK]
        if r == t["slots"] - 1 and t["rest"]:
            block = block[: t["rest"] - (-(-t["rest"] // mixing.BLOCK) - 1) * mixing.BLOCK]
        for uid in block:
            taken[uid] += 1
            first.setdefault(uid, slot)
    return taken, first


def test_mix_row_by_row(spark, monkeypatch):
    rng = np.random.default_rng(5)
    sized = [(i, i // 2, "=" + "abcd"[min(3, int(rng.integers(0, 9)) // 2)], int(rng.integers(0, 3000))) for i in range(300)]
    df = spark.createDataFrame([(u, d, k[1:], s) for u, d, k, s in sized], "uid long, doc_id long, source string, size long")
    hashes = {r.uid: r.h for r in df.select("uid", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("mix")), 16).alias("h")).collect()}
    targets = {r.k: r.asDict() for r in mixing.source_targets(df.withColumn("k", F.concat(F.lit("="), "source"))).collect()}
    seen = []
    for reverse in (True, False):
        if not reverse:
            monkeypatch.setattr(mixing, "_reversed_bits", lambda x, bits: x.cast("long"))
        got = {r.uid: (r.taken, r.slots[0] if r.slots else None) for r in mixing.mix(df).collect()}
        taken, first = plain_mix(sized, hashes, targets, reverse)
        assert got == {u: (taken[u], first.get(u)) for u, *_ in sized}
        seen.append(got)
    assert any(seen[0][u][0] != seen[1][u][0] for u in seen[0])  # the sequence of points decides what is taken
    got = collections.Counter()
    for u, _, k, _ in sized:
        got[k] += seen[0][u][0]
    assert got == {k: t["quota"] for k, t in targets.items()}  # an even one meets the targets


def test_even_points_meet_all_targets(spark):
    """Many sources of few and of many slots: each has exactly the slots it needs."""
    rows = [(f"={i}", 10 * s, s, s, 0) for i, s in enumerate([1, 1, 2, 3, 1000, 1, 7, 250, 1, 31, 2, 1, 64, 5000, 3] * 3)]
    targets = spark.createDataFrame(rows, "k string, source_size long, slots long, blocks long, rest long")
    got = {r.k: (r.n, r.top) for r in mixing.schedule(targets).groupBy("k").agg(F.count("*").alias("n"), F.max("rank").alias("top")).collect()}
    assert got == {k: (s, s - 1) for k, _, s, _, _ in rows}


def test_mixed_files_are_in_the_schedules_order(spark):
    docs = spark.createDataFrame([(i, prose(i, 400), "ab"[i % 4 == 0], i) for i in range(200)], "doc_id long, text string, source string, slot long").repartition(1)
    out = mixing.mixed(docs).coalesce(1)
    assert out.columns == docs.columns
    order = [r.source for r in out.select("source").collect()]
    share = order.count("a") / len(order)
    assert abs(order[: len(order) // 2].count("a") / (len(order) // 2) - share) < 0.25


# ---- secrets


def test_candidates(spark):
    """Values, places and contexts as the pattern finds them in Python."""
    rng = np.random.default_rng(2)
    texts = [None, "", "a1" * 6, "a1" * 6 + " " + "b2" * 7, "x" * 40, "1" * 40, "k=" + "Ab3_" * 5 + "==" + "é" + "9z" * 8, "ab1-" * 4000]
    texts += ["".join(rng.choice(list("aZ09_/=+ \né.")) for _ in range(400)) for _ in range(60)]
    got = collections.defaultdict(list)
    for r in secretscan.candidates(spark.createDataFrame([(i, t, "v", 1) for i, t in enumerate(texts)], "doc_id long, text string, value string, ord int")).collect():
        got[r.doc_id].append((r.ord, r.value, r._b, r._a))
    for i, t in enumerate(texts):
        found = list(re.finditer(secretscan.CANDIDATE, t or ""))
        edge = [0, *[m.end() for m in found]], [*[m.start() for m in found], len(t or "")]
        want = [(k, m.group(), t[edge[0][k] : m.start()][-secretscan.BEFORE :], t[m.end() : edge[1][k + 1]][: secretscan.AFTER]) for k, m in enumerate(found)]
        assert sorted(got[i]) == want
    docs = spark.createDataFrame([(1, "a token = 0f3a9b1c0f3a9b1c0f3a9b1c0f3a9b1c0f3a9b1c here")], "doc_id long, text string")
    assert secretscan.findings(docs).count() == 1 and secretscan.findings(docs.where("false")).count() == 0


# ---- languages


def plain_language(counts, word):
    """Scores of a word for each language."""
    langs = sorted({c[0] for c in counts})
    seen = {w: [sum(n for x, y, n in counts if x == g and y == w) for g in langs] for w in {c[1] for c in counts}}
    total = [sum(s[i] for s in seen.values()) for i in range(len(langs))]
    known = {w: s for w, s in seen.items() if sum(s) >= langid.LEAST_COUNT}
    if word in known:
        return [math.log((known[word][i] + 0.1) / (total[i] + 0.1 * len(known))) for i in range(len(langs))]
    grams = lambda w, n: [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]
    for n in langid.NGRAMS:
        sums = collections.defaultdict(lambda: [0.0] * len(langs))
        for w, s in seen.items():
            for g in grams(w, n):
                sums[g] = [a + b for a, b in zip(sums[g], s, strict=True)]
        whole = [sum(s[i] for s in sums.values()) for i in range(len(langs))]
        hit = [[math.log((sums[g][i] + 0.5) / (whole[i] + 0.5 * len(sums))) for i in range(len(langs))] for g in grams(word, n) if g in sums]
        if hit:
            return [sum(h[i] for h in hit) / len(hit) for i in range(len(langs))]
    return [0.0] * len(langs)


def test_language_word_by_word():
    rng = np.random.default_rng(3)
    make = lambda letters: "".join(rng.choice(list(letters), rng.integers(1, 7)))
    counts = {(g, make(letters)): int(rng.integers(1, 5)) for g, letters in (("x", "abcde"), ("y", "cdefgé"), ("z", "aegij")) for _ in range(60)}
    counts = [(*k, n) for k, n in counts.items()]
    model = langid.Model(counts)
    texts = [" ".join([*rng.choice([c[1] for c in counts], 3), *[make("abcdefgijé") for _ in range(rng.integers(0, 9))]]) for _ in range(60)]
    langs, share = model.predict([*texts, None, "12 !"])
    assert langs[-2:] == ["und"] * 2
    for t, lang, p in zip(texts, langs, share, strict=False):
        score = np.sum([plain_language(counts, w) for w in t.split()], axis=0)
        want = np.exp(score - score.max())
        assert ["x", "y", "z"][int(score.argmax())] == lang or np.sort(score)[-1] - np.sort(score)[-2] < 1e-3
        assert abs(want.max() / want.sum() - p) < 1e-3
    tie = langid.Model([("b", "same", 3), ("a", "same", 3)])
    assert tie.predict(["same"]) [0] == ["a"] and abs(tie.predict(["same"])[1][0] - 0.5) < 1e-6


def test_no_language_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ALL", 20)
    rows = [(i, prose(i, 5), f"l{i % 300}") for i in range(900)]
    counts = langid.word_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {c[0] for c in counts} == {f"l{k}" for k in range(300)}


# ---- toxicity


def test_forward_pass():
    """The network window by window and step by step."""
    model = gru.Toxicity(["idiot", "words", "good"], np.array([1.0, -0.5, 0.2], np.float32))
    p = {k: v.astype(np.float64) for k, v in model.net.p.items()}
    text = "the idiot of words and moron " * 9
    split = text.split()
    sig = lambda x: 1 / (1 + np.exp(-x))
    h_ = gru.HIDDEN

    def vector(w):
        raw = f"<{w}>".encode()
        grams = [raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16 for i in range(len(raw) - 2)]
        place = [int(gru.mix(np.array([g], np.uint64))[0] >> np.uint64(52)) for g in grams]
        at, hit = model.vocabulary.find(gru.hash_spans(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)])))
        return np.concatenate([p["word"][hit[0] + 1 if len(at) else 0], np.mean([p["char"][x] for x in place], axis=0)])

    def run(gates, u):
        h, out = np.zeros(h_), []
        for g in gates:
            a = h @ u
            z, r = sig(g[:h_] + a[:h_]), sig(g[h_ : 2 * h_] + a[h_ : 2 * h_])
            h = z * h + (1 - z) * np.tanh(g[2 * h_ :] + r * a[2 * h_ :])
            out.append(h)
        return out

    want = []
    for at in range(0, max(len(split) - (gru.WINDOW - gru.STRIDE), 1), gru.STRIDE):
        gates = [vector(w) @ p["in"] + p["bias"] for w in split[at : at + gru.WINDOW]]
        f, b = run([g[: 3 * h_] for g in gates], p["uf"]), run([g[3 * h_ :] for g in gates[::-1]], p["ub"])[::-1]
        h = np.array([np.concatenate(x) for x in zip(f, b, strict=True)])
        e = np.tanh(h @ p["att"] + p["attb"]) @ p["v"]
        a = np.exp(e - e.max())
        want.append((a / a.sum()) @ h @ p["out"] + p["outb"][0])
    got, doc = model.logits([text, ""])
    assert len(got) == len(want) and (doc == 0).all() and np.abs(got - want).max() < 1e-4


def test_held_out_labels_are_not_read(spark, tmp_path):
    rng = np.random.default_rng(4)
    docs = pd.DataFrame([(i, prose(i, 30) + (" idiot" if rng.random() < 0.4 else "")) for i in range(200)], columns=["doc_id", "text"])
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in docs.doc_id])
    seen = []
    for k in range(2):
        toxic = docs.text.str.contains("idiot").astype(int)
        if k:
            toxic = toxic.where(~held, 1)
        (tmp_path / str(k)).mkdir()
        docs.to_parquet(tmp_path / str(k) / "documents.parquet")
        pd.DataFrame({"doc_id": docs.doc_id, "quality": 1, "toxic": toxic}).to_parquet(tmp_path / str(k) / "labels.parquet")
        seen.append(toxicity.op9_toxicity(spark, str(tmp_path / str(k))).orderBy("doc_id").toPandas())
    assert seen[0].equals(seen[1]) and (seen[0].held_out == held).all()


def test_sample_of_labelled_rows(spark, monkeypatch):
    """Long documents are in the sample like others; it ends when its words are up."""
    docs = spark.createDataFrame([(i, prose(i, 4000 if i % 5 == 0 else 20)) for i in range(100)] + [(None, "x"), (7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1)], "doc_id long, toxic int")
    assert len(toxicity.training_rows(docs, labels)) == 100
    monkeypatch.setattr(toxicity, "SAMPLE_WORDS", 9000)
    some = toxicity.training_rows(docs, labels)
    assert 2 <= len(some) < 100 and any(len(r.text.split()) == 4000 for r in some)
