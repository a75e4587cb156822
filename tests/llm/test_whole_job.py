"""What a review found the operators to leave out."""

import collections

import numpy as np
import pytest

from tessera.llm import gru, pieces, quality

P = pytest.importorskip("public_tokenizers")

COMMON = {"en": "the of and to in is", "fr": "le la les de des et"}


def prose(lang, seed, n, share=0.18):
    rng = np.random.default_rng(seed)
    known = COMMON[lang].split()
    return " ".join(known[rng.integers(len(known))] if rng.random() < share else f"{'aeiou'[rng.integers(5)]}{'bcdfg'[rng.integers(5)]}{'klmnp'[rng.integers(5)]}{'aeiou'[rng.integers(5)]}{'rstvw'[rng.integers(5)]}" for _ in range(n))


def test_common_words(spark):
    sizes = [60, 100, 200, 400, 900]
    clean = [(1000 * i + k, lang, prose(lang, 1000 * i + k, sizes[k % 5])) for i, lang in enumerate(COMMON) for k in range(200)]
    odd = [(5000 + i, "en", prose("en", 5000 + i, n, 0.0)) for i, n in enumerate(sizes)] + [(6000 + i, "en", prose("fr", 6000 + i, n)) for i, n in enumerate(sizes)]
    # a rare language and a null one may have common words of their own
    other = [(7000, "xx", prose("en", 7000, 200, 0.0)), (7001, None, prose("en", 7001, 200, 0.0))]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(clean + odd + other, "doc_id long, lang string, text string")).collect()}
    assert not any(got[k].base_failed or got[k].js_classes > quality.MOST_CLASSES or got[k].js_common > 0.5 for k in got)
    assert [k for k, *_ in clean if not got[k].kept] == []
    assert [k for k, *_ in odd if got[k].kept] == []
    assert got[7000].js_common is not None and got[7001].js_common is not None


@pytest.mark.parametrize("text", [" {\r\n", "a();\r\n\r\n", "    if", "x   \n", "\r\r\r", "a\x0cb", "\r\n      })\r\n", "é  \r日", "   "])
def test_lattice_with_white_space(text):
    """CRLF, indented and other text in which pieces hold white space: sampled with the whole text's lattice's weights."""
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    model, sp = pieces.sampler(path), sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    own = {sp.id_to_piece(i).replace("▁", " "): (i, (2 + n if not sp.id_to_piece(i).strip("▁") else 2 - sp.get_score(i)) ** -pieces.ALPHA) for i in range(3, n) if not sp.is_byte(i) and (sp.get_score(i) > -1e8 or not sp.id_to_piece(i).strip("▁"))}
    byte = (n + 2.0) ** -pieces.ALPHA

    def all_of(s):
        if not s:
            yield (), 1.0
            return
        if s[0] not in own:
            b = s[0].encode()
            for rest, p in all_of(s[1:]):
                yield (*(int(model.byte_id[x]) for x in b), *rest), byte ** len(b) * p
        for k in range(1, len(s) + 1):
            if s[:k] in own:
                for rest, p in all_of(s[k:]):
                    yield (own[s[:k]][0], *rest), own[s[:k]][1] * p

    want = dict(all_of(" " + text))
    whole, many = sum(want.values()), 20_000
    got = model.encode([text] * many, pieces.row_seeds(list(range(many))))
    seen = collections.Counter(tuple(x.tolist()) for x in got)
    assert set(seen) <= set(want) and max(abs(seen[k] / many - p / whole) for k, p in want.items()) < 0.015
    assert model.decode(got[0]) == text
    mixed = ["", text, "a ", text, "", " b", text + " "]
    assert [model.decode(x) for x in model.encode(mixed, pieces.row_seeds(list(range(7))))] == mixed


def test_passages_lie_whole_in_a_window():
    """A passage of half a window, across every border of windows, in texts of many lengths."""
    vocabulary = gru.Toxicity([], np.zeros(0)).vocabulary
    half = gru.WINDOW // 2
    for n in [*range(half, 4 * gru.WINDOW), 500]:
        batch = gru.Batch([" ".join(["word"] * n)], vocabulary)
        end = batch.start + batch.length
        assert (batch.start == np.arange(len(end)) * gru.STRIDE).all() and end.max() == n
        assert all(((batch.start <= at) & (at + half <= end)).any() for at in range(n - half + 1))


def test_kept_lattices_change_nothing(monkeypatch):
    texts = [prose("en", i % 30, 200) + " " + "word " * (i % 4) + "z" * (90 * (i % 3)) for i in range(60)]
    path = P.path("piece_bpe_32k.model")
    want = pieces.Sampler(path).encode(texts, pieces.row_seeds(list(range(60))))
    for group, arcs in ((4000, 500), (900, 10_000), (1 << 20, 0)):
        monkeypatch.setattr(pieces, "GROUP_BYTES", group)
        monkeypatch.setattr(pieces, "KEPT_ARCS", arcs)
        model = pieces.Sampler(path)
        got = model.encode(texts, pieces.row_seeds(list(range(60))))
        assert all(a.tolist() == b.tolist() for a, b in zip(got, want, strict=True))


def test_encoder_gives_the_tokenizers_ids(monkeypatch):
    """Letters and signs that are encoded by themselves, words that aren't, odd white space, and what is kept from text to text."""
    from tokenizers import Tokenizer

    from tessera.llm import records

    path = P.path("byte_bpe_50k.json")
    parts = ["the", "Ünï", "naïve,", "x%%%", "end.\n", "\n\n", "\r\n", "\t", "don't", "it's,", "<|endoftext|>", "foo<|endoftext|>", "日本語", "é", "42a", "ab,cd", "a×b", "...", "“q”", "\x85", "　", "  ", " ", "\n"]
    rng = np.random.default_rng(3)
    texts = ["", " ", "\n", " a", "a "] + ["".join(parts[i] + " " * int(rng.integers(0, 2)) for i in rng.integers(0, len(parts), rng.integers(1, 25))) for _ in range(3000)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for kept in (records.CACHE_WORDS, 50):
        monkeypatch.setattr(records, "CACHE_WORDS", kept)
        encoder = records.Encoder(path)
        got = [x.tolist() for at in range(0, len(texts), 300) for x in encoder.encode(texts[at : at + 300])]
        assert got == want


def test_lattice_falls_apart_where_it_is_cut():
    """No piece of the model crosses a cut, and no cut lies inside a character."""
    model = pieces.Sampler(P.path("piece_bpe_32k.model"))
    text = "Ünïted state's (x%%%) a,b;c 日本語 é 42a\r\n\tend.  two   three".encode()
    body = np.frombuffer(b" " + text, np.uint8)
    cuts = {i + 1 for i, c in enumerate(model.cut[(body[:-1].astype(np.uint16) << 8) | body[1:]]) if c}
    assert cuts and not any(body[i] & 0xC0 == 0x80 for i in cuts)
    raw = body.tobytes()
    whole = {p for i, p in enumerate(model.bytes) if len(p) > 1 and p.strip(b" ")}
    for start in range(len(raw)):
        for stop in range(start + 2, min(len(raw), start + 20) + 1):
            if raw[start:stop] in whole:
                assert not cuts & set(range(start + 1, stop))
