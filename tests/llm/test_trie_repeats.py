"""Prefix trie and suffix-array dedup: odd tables against plain Python, SQL, and the index against substring search."""

import hashlib
import os
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tessera.llm import repeats, trie
from tessera.llm.queries import QUERIES, SQL
from tessera.llm.runindex import RunIndex

SMALL = "/root/testdata/sf0.01"
TURNS = "conv_id long, turn long, role string, text string, depth int, node string"


def turns():
    rng = random.Random(4)
    rows = []
    for c in [0, 1, 2, 5, 7, 50, 99, 100, 101, 102, 150, 305, 306, 400, 401, 402, 403, 404, 405, 406]:
        for t in range(rng.choice([1, 1, 2, 3, 7, 9])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "hello there", "é😀", ""]), 1, "x"))
    copy = [("user", "same"), ("assistant", "same too"), ("user", None), (None, "end")] * 5  # two sequences that share twenty turns, many copies of one
    for c in range(1000, 1400, 100):
        rows += [(c, t, r, x, None, None) for t, (r, x) in enumerate(copy)]
    rows += [(1500, t, r, x, None, None) for t, (r, x) in enumerate([*copy, ("user", "x" * 100_000)])]
    rows += [(600, None, "user", "null turn", 1, "x"), (600, 0, None, None, 1, "x"), (600, 0, None, None, 1, "x"), (None, 0, "user", "no id", 1, "x"), (-5, 0, "user", "below zero", 1, "x"), (700, 1, "b", "tie", 1, "x"), (700, 1, "a", "tie", 1, "x")]
    return rows


def plain_trie(rows):
    own = {}
    for c, t, r, x, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, (r or "").encode(), (x or "").encode()))
    own = {c: [(r.decode(), x.decode()) for _, _, r, x in sorted(v)] for c, v in own.items()}
    made = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(np.fmod(c, 100))
        made[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    member = {}
    for c, p in made.items():
        for d in range(len(p) + 1):
            member.setdefault(p[:d], []).append(c)
    out = []
    for p, cs in member.items():
        below = [q for q in member if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(1 for q in below if not any(len(z) == len(q) + 1 and z[: len(q)] == q for z in below))
        saved = sum((len(member[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in cs if made[c] == p)))
        out.append((min(cs), len(p), min(member[p[:-1]]) if p else None, len(cs), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()], key=str)


def test_trie_on_odd_turns(spark, tmp_path, same):
    spark.createDataFrame(turns(), TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    found = got(trie.op11_prefix_trie(spark, str(tmp_path)))
    assert found == plain_trie(turns())
    assert any(n[1] > 20 for n in found) and any(n[3] > 3 for n in found)


def test_trie_without_turns_and_members(spark):
    convs = spark.createDataFrame([(3,), (9,), (12,), (12,), (None,)], "conv_id long")
    rows = spark.createDataFrame([(3, 0, "u", "a"), (9, 0, "u", "a"), (9, 1, "u", "b"), (14, 0, "u", "a")], "conv_id long, turn int, role string, text string")
    t = trie.prefix_trie(rows, convs)
    assert {tuple(r) for r in t.members.collect()} == {(3, 3), (14, 3), (9, 9), (12, 12)}
    assert {tuple(r) for r in t.ends.collect()} == {(3, 1, 3), (9, 2, 9), (12, 0, 3)}
    assert {(r.conv_id, r.depth, r.n_convs) for r in t.nodes.collect()} == {(3, 0, 4), (3, 1, 3), (9, 2, 1)}
    none = trie.prefix_trie(rows.where("false"))
    assert none.nodes.count() == 0 and none.members.count() == 0
    assert trie.prefix_trie(rows.where("conv_id = 9")).nodes.count() == 3


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_repeats"])
def test_whole_tables_against_sql(spark, duck, name):
    a, b = QUERIES[name](spark, SMALL).toPandas(), duck(SQL[name], SMALL)
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    rows = [sorted(map(str, x[cols].astype({c: "Int64" for c in cols if "sha" not in c}).itertuples(index=False, name=None))) for x in (a, b)]
    assert rows[0] == rows[1] and len(rows[0]) > 300


def test_matching_statistics():
    rng = random.Random(1)
    for _ in range(150):
        k = rng.choice([8, 9, 13, 14, 16])
        letters = bytes(rng.sample(range(256), rng.choice([1, 2, 4])))
        texts = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 12))]
        owners = np.array([rng.randint(0, 5) for _ in texts], np.int64)
        index = RunIndex(texts, owners, k)
        asked = texts + [bytes(rng.choice(letters + b"z") for _ in range(rng.randint(0, 30))) for _ in range(4)]
        length, rows, starts = index.statistics(asked)
        for q, at in zip(asked, starts, strict=False):
            for i in range(len(q)):
                best = max((n for n in range(len(q) - i + 1) if n == 0 or any(q[i : i + n] in t for t in texts)), default=0)
                assert length[at + i] == best
                if best >= k:
                    assert index.oldest_owner(rows[at + i : at + i + 1])[0] == min(o for t, o in zip(texts, owners, strict=True) if q[i : i + k] in t)
    assert len(RunIndex([b"the same line of text"] * 200, np.arange(200), 8).run) < 60  # repetition costs no runs
    with pytest.raises(ValueError):
        RunIndex([b"a"], np.zeros(1, np.int64), 3)


def plain_repeats(rows):
    seen = {}
    for d, x in rows:
        b = (x or "").encode()
        if d is not None:
            for i in range(len(b) - 49):
                w = b[i : i + 50]
                seen[w] = min(seen.get(w, d), d)
    out = []
    for d, x in rows:
        b = (x or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - 49):
            if d is not None and seen[b[i : i + 50]] < d:
                gone[i + 1 : i + 51] = True
        out.append((d, len(b), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(bytes(v for v, g in zip(b, gone[1:-1], strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def documents():
    rng = random.Random(3)
    prose = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage = prose(180)
    rows = [(k, prose(rng.randint(0, 120)) + passage[rng.randint(0, 60) : rng.randint(100, 180)] + prose(rng.randint(0, 90))) for k in range(60)]
    rows += [(100 + k, prose(3) + passage[:60] + prose(3)) for k in range(40)]
    rows += [(200, passage), (201, passage), (201, passage), (202, passage[:49]), (203, passage[:50]), (204, None), (205, ""), (None, passage), (None, None), (206, "a" * 3000), (207, "a" * 49), (208, "a" * 2000 + passage)]
    rows += [(209, prose(120_000)), (210, prose(10) + passage), (210, prose(40) + passage[3:]), (210, "q" * 70), (211, "q" * 60), (5, "x" + passage)]
    return rows


@pytest.mark.parametrize("crowd", [2000, 3])
def test_repeats_on_odd_texts(spark, tmp_path, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 4000)
    rows = [(d, x, 1, "z", b"k") for d, x in documents()]
    spark.createDataFrame(rows, "doc_id long, text string, anchor int, th string, kept binary").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    out = repeats.op12_repeats(spark, str(tmp_path))
    assert sorted(map(tuple, out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str) == plain_repeats(documents())


def test_repeats_spans_and_empty(spark):
    docs = spark.createDataFrame([(2, "." * 10 + "m" * 55 + "!" * 5), (1, "m" * 55)], "doc_id long, text string")
    rows = {r.doc_id: r for r in repeats.without_repeats(docs).collect()}
    assert [tuple(s) for s in rows[2].spans] == [(10, 65)] and bytes(rows[2].kept) == b"." * 10 + b"!" * 5
    assert rows[1].spans == [] and repeats.without_repeats(docs.where("false")).count() == 0


def test_pieces_cover_each_window_once():
    texts = [b"a" * 200, b"", b"x" * 49, b"abc" * 40, bytes(np.random.default_rng(1).integers(0, 9, 700, np.uint8))]
    of, start, n, anchor, _ = repeats.pieces_of(texts)
    for t, x in enumerate(texts):
        own = of == t
        assert sorted(k for s, c in zip(start[own], n[own], strict=True) for k in range(s, s + c)) == list(range(max(0, len(x) - 49)))
    assert n.max() <= repeats.MOST_WINDOWS and len(set(anchor[of == 0])) == 1
    assert pd.Series(repeats.window_minima(np.array([5, 3, 4, 1, 2], np.uint64), 3)).tolist() == [3, 1, 1]


def test_an_anchor_that_is_everywhere_fills_no_deal():
    """Pieces of texts that all hold one passage: the parts together are all pieces, and a deal gets one piece of an anchor that its group shows to be held twice."""
    rng = np.random.default_rng(3)
    same = rng.bytes(400)
    texts = [rng.bytes(60) + same + rng.bytes(60) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array([0] * 300, pa.int64()), pa.array(texts)], names=["doc", "th", "text"])
    rows, most = [], 0
    for part in range(repeats.PARTS):
        for out in repeats._cut(64, part)(iter([batch])):
            for r in out.to_pylist():
                one = list(zip(r["doc"], r["anchor"], r["piece"], r["start"], [abs(n) for n in r["n"]], strict=True))
                rows += one
                most = max(most, len(one))
    of, start, n, anchor, piece = repeats.pieces_of(texts)
    assert sorted(rows) == sorted(zip(of.tolist(), anchor.view(np.int64).tolist(), piece.view(np.int64).tolist(), start.tolist(), n.tolist(), strict=True))
    assert most < 2 * len(rows) / repeats.PARTS / 64


@pytest.mark.parametrize("parts", [1, 3])
def test_repeats_in_parts_and_deals(spark, tmp_path, monkeypatch, parts):
    for name, v in (("PARTS", parts), ("DEAL_TEXT", 500), ("DEAL_TASK", 4000), ("HASH_BYTES", 1000)):
        monkeypatch.setattr(repeats, name, v)
    spark.createDataFrame([(d, x) for d, x in documents()], "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    out = repeats.op12_repeats(spark, str(tmp_path))
    assert sorted(map(tuple, out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str) == plain_repeats(documents())


def test_rounds_end_with_their_marks(spark, monkeypatch):
    """Of all steps only the marks stay on disk, equal pieces are one row, and single windows are judged by portions."""
    from tessera.llm import common

    paths, new_folder, tables, materialize = [], common.new_folder, {}, common.materialize
    monkeypatch.setattr(common, "new_folder", lambda s, name: paths.append(new_folder(s, name)) or paths[-1])

    def written(df, name):
        out = materialize(df, name)
        tables.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(repeats, "materialize", written)
    for name, v in (("CROWD", 3), ("WINDOW_TEXT", 200)):
        monkeypatch.setattr(repeats, name, v)
    rows = documents()
    out = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {os.path.basename(p).split("-")[0] for p in paths if os.path.exists(p)} == {"marked"} and len(tables["marked"]) == repeats.PARTS
    assert len(tables["windows"]) > repeats.PARTS and len(tables["cut"]) == repeats.PARTS * repeats.CUTS
    assert sum(tables["shared"]) == sum(tables["unlike"])  # a deal has all of a piece's places
    assert sorted((r.doc_id, r.n_bytes, sum(b - a for a, b in r.spans), len(r.spans)) for r in out.collect() if r.doc_id is not None) == sorted(x[:4] for x in plain_repeats(rows) if x[0] is not None)
