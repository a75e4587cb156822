"""Every operator on a small table with nulls, empty and long texts, repeated rows, extra columns; against brute force or SQL."""

import collections
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tessera.llm import gru, hostrank, kernels, langid, mixing, nearjoin, pieces, quality, records, secretscan, topk, toxicity

P = pytest.importorskip("public_tokenizers")
PROSE = "the quick brown fox and the lazy dog ran to the old house of the king in a small town by the river it was late".split()


def text(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(PROSE[i] if rng.random() < 0.6 else f"w{rng.integers(0, 4000)}" for i in rng.integers(0, len(PROSE), n))


def rows():
    base = text(1, 120)
    docs = [(k, text(k, 60 + k), "en" if k % 3 else "fr", f"s{k % 4}", None) for k in range(40)]
    docs += [(100, base, "en", "s0", "x"), (101, base, "en", "s1", "x"), (102, base + " more", "en", None, "x"), (103, "q " + base + " more", None, "s1", "x")]
    docs += [(110, None, "en", "s1", None), (111, "", "en", "s1", None), (112, " \n\t", "en", None, None), (113, "two words", "en", "s1", None), (114, "Two WORDS", "de", "s1", None), (115, "É é Two", None, "s2", None)]
    docs += [(120, text(7, 30_000), "en", "s0", None), (121, "ab " * 400, "en", "s0", None), (122, "ÄÖ▁ <|endoftext|>\r\n x  y　z 😀 \x00", "de", "s3", None), (123, "x" * 5000, "en", "s0", None)]
    docs += [docs[3], docs[3], (None, text(9, 50), "en", "s1", None)]
    docs += [(130, f'some prose here and token = "{"0f3a" * 10}" and more prose of it commit {"9b1c" * 10} end', "en", "s2", None)]
    return docs


COLUMNS = ["doc_id", "text", "lang", "source", "kept"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("llm")
    pd.DataFrame(rows(), columns=COLUMNS).astype({"doc_id": "Int64", "kept": "string"}).to_parquet(d / "documents.parquet")
    pd.DataFrame({"doc_id": range(40), "quality": 1, "toxic": [k % 2 for k in range(40)]}).to_parquet(d / "labels.parquet")
    return str(d)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    d = tmp_path_factory.mktemp("none")
    pd.DataFrame(rows(), columns=COLUMNS).astype({"doc_id": "Int64", "kept": "string"}).head(0).to_parquet(d / "documents.parquet")
    pd.DataFrame({"doc_id": [1], "quality": [1], "toxic": [1]}).astype("int64").head(0).to_parquet(d / "labels.parquet")
    pd.DataFrame({"page_id": [1], "url": ["u"], "html": ["h"]}).head(0).to_parquet(d / "pages.parquet")
    pq.write_table(pa.table({"vec_id": pa.array([], pa.int64()), "embedding": pa.array([], pa.list_(pa.float32()))}), d / "embeddings.parquet")
    return str(d)


QUERIES = [quality.op1_quality, pieces.op2_sentencepiece, hostrank.op3_url_filter, topk.op4_exact_topk, records.op5_token_records, mixing.op6_source_mix, secretscan.op7_secrets, langid.op8_language, toxicity.op9_toxicity, nearjoin.op10_near_join, corpus_pipeline.run]


@pytest.mark.parametrize("query", QUERIES, ids=lambda q: q.__name__)
def test_empty_tables(spark, empty, query):
    assert query(spark, empty).count() == 0


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", t or "")


def test_quality(spark, folder):
    got = quality.op1_quality(spark, folder).toPandas()
    assert len(got) == len(rows())
    for k, t, *_ in rows():
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = collections.Counter(grams)
        again = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(5)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w))
        own = got[got.doc_id.isna()] if k is None else got[got.doc_id == k]
        assert tuple(own.iloc[0][["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]]) == want, k
    assert not got[got.base_failed].kept.any()
    assert quality.accepted(spark.read.parquet(f"{folder}/documents.parquet")).columns == COLUMNS


def test_divergence(spark):
    prose = [(k, "en", text(k, 200)) for k in range(30)]
    junk = [(100, "en", " ".join(f"{w.upper()}!!" for w in text(1, 200).split())), (101, "en", " ".join(f"{w}#$%" for w in text(2, 200).split())), (102, "xx", text(3, 200)), (103, "en", "!! ## !!")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(prose + junk, "doc_id long, lang string, text string")).collect()}
    assert all(got[k].kept for k in range(30)) and not got[100].kept and not got[101].kept
    assert got[102].kept and got[102].js_classes is not None and got[103].js_classes is None


def test_pieces(spark, folder):
    path = P.path("piece_bpe_32k.model")
    got = pieces.op2_sentencepiece(spark, folder).toPandas()
    assert got.lossless.all() and len(got) == len(rows())
    assert got[got.doc_id.isin([110, 111])].n_tokens.tolist() == [0, 0]
    assert got[got.doc_id == 3][["n_tokens", "ids_crc32"]].drop_duplicates().shape[0] == 1
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    a = pieces.encode(docs, path)
    again = {(r.doc_id, r.text): r.ids for r in pieces.encode(docs.repartition(7), path).collect()}
    assert all(again[r.doc_id, r.text] == r.ids for r in a.collect())
    assert sorted(map(str, pieces.decode(a, path).collect())) == sorted(map(str, a.select("doc_id", "text").collect()))


def test_sampling_has_the_lattice_distribution():
    model = pieces.sampler(P.path("piece_bpe_32k.model"))
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    weight = {model.bytes[i]: (2 - sp.get_score(i)) ** -pieces.ALPHA for i in range(259, 32000) if sp.get_score(i) > -1e8} | {b" ": 32002.0**-pieces.ALPHA}

    def all_of(s):
        if not s:
            yield (), 1.0
        for k in range(1, len(s) + 1):
            if s[:k] in weight:
                for rest, p in all_of(s[k:]):
                    yield (s[:k], *rest), weight[s[:k]] * p

    want = dict(all_of(b" thing"))
    n = 20_000
    seen = collections.Counter(tuple(model.bytes[i] for i in ids) for ids in model.encode(["thing"] * n, pieces.row_seeds(list(range(n)))))
    whole = sum(want.values())
    assert set(seen) <= set(want) and max(abs(seen[k] / n - p / whole) for k, p in want.items()) < 0.015


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\ta▁bcé日😀　\x00'"), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=4))
def test_round_trips(texts):
    model = pieces.sampler(P.path("piece_bpe_32k.model"))
    ids = model.encode(texts, pieces.row_seeds(list(range(len(texts)))))
    assert [model.decode(x) for x in ids] == texts
    coder = test_round_trips.__dict__.setdefault("coder", records.Encoder(P.path("byte_bpe_50k.json")))
    assert [x.tolist() for x in coder.encode(texts)] == [coder.model.encode(t, add_special_tokens=False).ids for t in texts]


def test_url_filter(spark, same, tmp_path):
    pages = [(1, "http://a.net/x", '<a href="https://b.com/1"><A HREF=\'//c.com/2\'>'), (2, "http://b.com/", '<a href="http://x.org/fr/">'), (3, "https://x.org/fr/y?x", '<a class=z href=http://d.com>'), (4, None, None), (5, "http://c.com", '<a href="http://a.net/">'), (6, "http://d.com?x#y", None), (7, "HTTP://A.NET:80/p", ""), (8, "no scheme", ""), (8, "no scheme", ""), (9, "http://m.example.net/en/a", ""), (10, "http://example.net/de/", "")]
    pd.DataFrame(pages, columns=["page_id", "url", "html"]).to_parquet(tmp_path / "pages.parquet")
    df = hostrank.op3_url_filter(spark, str(tmp_path))
    same(df, hostrank.OP3_SQL, str(tmp_path))
    got = {r.page_id: r for r in df.collect()}
    assert (got[1].verdict, got[5].verdict, got[6].verdict, got[9].verdict, got[9].rule, got[10].verdict) == ("block", "block", "allow", "allow", "example.net/en/", "block")
    assert (got[4].host, got[4].path, got[7].host, got[2].path) == ("", "", "a.net:80", "/")


def test_topk(spark, same, tmp_path):
    rng = np.random.default_rng(4)
    vectors = [(k, (rng.integers(-40, 40, 8) / 256).tolist()) for k in range(400)] + [(k, [0.25] * 8) for k in range(400, 460)]
    vectors += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (550, [0.5] * 3)]
    pd.DataFrame(vectors, columns=["vec_id", "embedding"]).to_parquet(tmp_path / "embeddings.parquet")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.op4_exact_topk(spark, str(tmp_path)).collect()}
    real = {k: np.floor(256 * np.array(v)).astype(int) for k, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q in real:
        if q % 50 == 0:
            dot = lambda a, b: int(sum(x * y for x, y in zip(a, b, strict=False)))
            best = sorted(((-dot(real[q], v), k) for k, v in real.items() if k != q))[:5]
            want |= {(q, i + 1): (k, -s) for i, (s, k) in enumerate(best)}
    assert got == want
    huge = np.array([[1 << 40]], dtype=object)
    assert topk.score_block(huge, huge)[0][0] == 1 << 80


def test_records(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    path = P.path("byte_bpe_50k.json")
    manifest = records.write_records(docs, path, f"file://{tmp_path}/rec")
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.start, r.n_tokens, tuple(r.ids)) for r in records.read_records(manifest).collect())
    from tokenizers import Tokenizer

    model, start, want = Tokenizer.from_file(path), 0, []
    for k, t in sorted(((-1 if k is None else k), t or "") for k, t, *_ in rows()):
        ids = model.encode(t, add_special_tokens=False).ids + [0]
        want.append((k, start, len(ids), tuple(ids)))
        start += len(ids)
    assert got == want
    shard = manifest.first()
    for k, offset, length in records.read_index(shard["index"]):
        again, ids = records.read_at(shard.path, offset, length)
        assert (again or 0) == k and ids[-1] == 0
    digest = {(r.doc_id, r.start): r.ids_crc32 for r in records.op5_token_records(spark, folder).collect()}
    assert all(digest[(None if k < 0 else k), s] == zlib.crc32(np.array(ids, "<u4").tobytes()) for k, s, _, ids in want)
    made = bytearray(records.frame(5, np.array([1, 70_000], np.uint32)))
    assert records.unframe(records._reader(bytes(made)))[1].tolist() == [1, 70_000]
    made[20] ^= 1
    with pytest.raises(ValueError):
        records.unframe(records._reader(bytes(made)))


def test_mix(spark, folder):
    got = mixing.op6_source_mix(spark, folder).toPandas()
    assert len(got) == len(rows()) and (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()
    sizes = collections.Counter()
    for _, t, _, s, _ in rows():
        sizes[s] += len(words(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = dict(zip(order, [5, 2, 1] * 9, strict=False))
    full, total = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        share = {s: (total - sum(full.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 2.0 * sizes[s] for s in free if share[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    want = full | share
    for s in order:
        own = got[got.source.isna()] if s is None else got[got.source == s]
        assert own.target.iloc[0] == pytest.approx(want[s]) and own.source_size.iloc[0] == sizes[s] and abs(own.taken.sum() - want[s]) <= 1
    key = ["doc_id", "size", "source", "taken"]
    again = mixing.op6_source_mix(spark, folder).toPandas()
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))


def test_schedule_is_even(spark):
    sized = spark.createDataFrame([(i, i, "abc"[i % 3], f"={'abc'[i % 3]}", 5000) for i in range(60)], "uid long, doc_id long, source string, k string, size long")
    slots = mixing.schedule(mixing.source_targets(sized)).orderBy("slot").toPandas()
    assert (slots.groupby("k")["rank"].apply(lambda r: sorted(r) == list(range(len(r))))).all()
    assert slots.sort_values("slot").groupby("k")["rank"].apply(lambda r: r.is_monotonic_increasing).all()
    half = slots.head(len(slots) // 2).k.value_counts() / slots.k.value_counts()
    assert half.between(0.4, 0.6).all()


def test_secrets(spark, folder):
    found = secretscan.op7_secrets(spark, folder).toPandas()
    own = found[found.doc_id == 130].sort_values("ord")
    assert own.secret.tolist() == [True, False]
    forest = secretscan.forest(spark)
    other = spark.createDataFrame(secretscan.labelled_findings(400, 99), "value string, before string, after string, label int")
    from pyspark.sql import functions as F

    x = other.select("label", F.array(*secretscan.features(F.col("value"), F.col("before"), F.col("after"))).alias("x")).withColumn("p", forest.column(F.col("x"))).toPandas()
    p = forest.predict(np.array(x.x.tolist()))
    assert abs(p - x.p).max() < 1e-6 and ((p >= 0.5) == x.label).mean() > 0.97
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    masked = secretscan.redact(docs).toPandas()
    assert len(masked) == len(rows()) and masked.columns.tolist() == COLUMNS
    t = masked[masked.doc_id == 130].text.iloc[0]
    assert "[SECRET]" in t and "0f3a" not in t and "9b1c" in t
    clean = masked[masked.doc_id != 130].merge(pd.DataFrame(rows(), columns=COLUMNS).drop_duplicates("doc_id"), on="doc_id")
    assert (clean.text_x.fillna("") == clean.text_y.fillna("")).all()


def test_language(spark, folder):
    got = langid.op8_language(spark, "/root/testdata/sf0.001").toPandas()
    lang = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(lang, on="doc_id")
    assert (both[both.held_out].lang == both[both.held_out].lang_pred).mean() > 0.95
    assert (both.held_out == [zlib.crc32(str(k).encode()) % 4 == 2 for k in both.doc_id]).all()
    small = langid.op8_language(spark, folder).toPandas()
    assert len(small) == len(rows()) and small.score.between(0, 1).all()
    assert small[small.doc_id.isin([110, 111, 112])].lang_pred.tolist() == ["und"] * 3
    model = langid.Model([("a", "house", 5), ("b", "maison", 5)])
    assert model.predict(["house", "hous", "maiso x", "123"])[0] == ["a", "a", "b", "und"]


def test_gradient():
    model = gru.Toxicity(["idiot", "words", "good"], np.zeros(3))
    for k in model.net.p:
        model.net.p[k] = model.net.p[k].astype(np.float64)
    batch = gru.Batch(["the idiot of words and moron", "clean words here are good and nice", "x"], model.vocabulary)
    y, which = np.array([1.0, 0, 0]), np.arange(3)
    g, _ = model.net.gradient(batch, which, y)
    for k, p in model.net.p.items():
        flat, own = p.reshape(-1), g[k].reshape(-1)
        for i in np.argsort(-np.abs(own))[:3]:
            kept = flat[i]
            flat[i] = kept + 0.01
            up = model.net.gradient(batch, which, y)[1]
            flat[i] = kept - 0.01
            down = model.net.gradient(batch, which, y)[1]
            flat[i] = kept
            assert abs((up - down) / 0.02 - own[i]) < 1e-4, k


def test_toxicity_learns(spark, folder):
    rng = np.random.default_rng(3)
    bad = ["idiot", "moron", "trash"]
    texts, labels = [], []
    for k in range(240):
        w = text(1000 + k, 120).split()
        if k % 2:
            for i in rng.integers(0, len(w), 6):
                w[i] = bad[rng.integers(0, 3)]
        texts.append(" ".join(w))
        labels.append(k % 2)
    model = gru.train(texts[:200], np.array(labels[:200]), 2000, steps=90)
    s = model.score(texts[200:])
    assert ((s >= 0.5) == np.array(labels[200:])).mean() > 0.9
    assert model.score(["", None, "..."]).tolist() == [0, 0, 0]
    long = text(5, 3000) + " " + " ".join(["idiot moron trash you"] * 8)
    assert model.score([long])[0] > 0.5  # the end of a long text counts
    got = toxicity.op9_toxicity(spark, folder).toPandas()
    assert len(got) == len(rows()) and got.score.between(0, 1).all() and set(got.predicted) <= {0, 1}


def brute_components(docs):
    sets = {}
    for k, t, *_ in docs:
        w = [x.decode() for x in (t or "").encode().lower().split()]
        sets.setdefault(k, []).append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    keys = [k for k in sets if k is not None and any(sets[k])]
    label = {k: k for k in sets}
    links = [(a, b) for a in keys for b in keys if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])]
    for _ in keys:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return sets, label


def near_rows():
    rng = np.random.default_rng(11)
    base = text(50, 90).split()
    out = []
    for k in range(60):  # near copies of one text, of all degrees
        w = list(base)
        for i in rng.choice(len(w), rng.integers(0, 6), replace=False):
            w[i] = f"z{rng.integers(0, 50)}"
        out.append((1000 - k, " ".join(w)))
    line = "this very line stands in a great many of the texts here"
    out += [(2000 + k, f"{text(300 + k, 25)} {line} {text(400 + k, 25)}") for k in range(40)]
    out += [(3000 + k, line) for k in range(3)]
    return [(*r, None, None, None) for r in out]


@pytest.mark.parametrize("docs", [rows(), near_rows()], ids=["odd", "near"])
@pytest.mark.parametrize("pivots", [1, 8])
def test_near_join(spark, docs, pivots, monkeypatch):
    monkeypatch.setattr(nearjoin, "PIVOTS", pivots)
    monkeypatch.setattr(nearjoin, "CUT_ROWS", 16)
    got = nearjoin.near_components(spark.createDataFrame([(d[0], d[1]) for d in docs], "doc_id long, text string")).collect()
    sets, label = brute_components(docs)
    assert len(got) == len(docs)
    for r in got:
        assert r.n_shingles in {len(s) for s in sets[r.doc_id]} and r.component_id == label[r.doc_id]


def test_trees():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).view(np.uint64) << np.uint64(1)) for n in rng.integers(5, 60, 150)]
    sets += [np.unique(np.concatenate([s[: len(s) - 1], s[:0]])) for s in sets[:30]]
    n, c = np.array([len(s) for s in sets]), np.array([nearjoin.count_vector(s) for s in sets]).astype(np.int32)
    a, b = nearjoin.tree_join(nearjoin.RTree(n, c), nearjoin.RTree(n, c))
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            both = len(np.intersect1d(x, y))
            if 100 * both >= 80 * (len(x) + len(y) - both):
                assert (i, j) in found
                assert nearjoin.fine_bound(nearjoin.fine_vector(x), nearjoin.fine_vector(y)) >= both
    assert len(found) < len(sets) ** 2 / 4


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té\x0b\x1c ", max_size=60), max_size=6), st.integers(4, 40))
def test_words(texts, limit):
    raw = [t.encode() for t in texts]
    found = kernels.Words(raw)
    want = [w for t in raw for w in t.split()]
    assert found.word(np.arange(len(found.hashes))) == want
    assert np.diff(found.first).tolist() == [len(t.split()) for t in raw]
    assert (len(set(found.hashes.tolist()))) == len(set(want))
    assert b"".join(p.replace(b"\n", b"") for p, _, _ in kernels.pieces(raw, limit)) == b"".join(t.replace(b"\n", b"") for t in raw)


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        path = f"{folder}/{name.replace(' ', '-')}"
        docs.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs.toPandas()
        assert name == "sentencepiece" or docs.columns == COLUMNS
    rules = quality.op1_quality(spark, folder).toPandas()
    assert len(kept["quality rules"]) == rules.kept.sum()
    near = kept["near duplicates"]
    _, label = brute_components(kept["quality rules"].astype(object).where(kept["quality rules"].notna(), None).values.tolist())
    assert sorted(near.doc_id.dropna().astype(int)) == sorted({v for k, v in label.items() if k is not None})
    assert len(kept["secret scan"]) == len(near)
    model = pieces.sampler(P.path("piece_bpe_32k.model"))
    last = kept["sentencepiece"]
    assert all(model.decode(np.asarray(r.ids)) == r.text for r in last.itertuples())
    assert len(corpus_pipeline.run(spark, folder).toPandas()) == len(last)


def test_scores_go_tile_by_tile():
    """Dense, sparse and large terms give the products' sums; a tile's arrays are no larger than the bound."""
    rng = np.random.default_rng(2)
    for high, share in ((90, 1.0), (90, 0.1), (1 << 24, 0.3)):
        q, r = (rng.integers(-high, high, (n, 9)) * (rng.random((n, 9)) < share) for n in (topk.TILE[0] + 3, topk.TILE[1] + 5))
        got = topk.score_block(q, r)
        assert got.dtype == np.int64 and (got == q @ r.T).all()
    assert topk.score_block(np.zeros((0, 0), np.int64), r).shape == (0, len(r))
