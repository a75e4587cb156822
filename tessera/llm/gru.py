"""A bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy."""

from __future__ import annotations

import numpy as np

from tessera.llm.kernels import HashTable, Words, hash_spans, mix
from tessera.llm.langid import _BETWEEN, fold

#: Words of a window, and from one window's start to the next: windows overlap by half, so a passage of up to that many words and one more is whole in one of them.
WINDOW, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 8, 8, 8
#: Buckets of hashed character trigrams.
BUCKETS = 4096
_CHUNK = 4096
#: How far the first dimension of a word's embedding starts from 0, for each unit of its odds.
HINT = 1.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Batch:
    """The words of texts as places in a list of unlike words, with their vocabulary entries and trigrams, and all windows."""

    def __init__(self, texts: list[str], vocabulary: HashTable):
        found = Words([fold(t) for t in texts], _BETWEEN)
        unique, first, self.word = np.unique(found.hashes, return_index=True, return_inverse=True)
        self.entry = np.zeros(len(unique), np.int64)  # 0: not in the vocabulary
        which, where = vocabulary.find(unique)
        self.entry[which] = where + 1
        raw = found.word(first)
        sizes = np.array([len(w) + 2 for w in raw], np.int64)
        codes = np.frombuffer(b"".join(b"<" + w + b">" for w in raw) or b"<>", np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(len(raw)), sizes)
        m = max(0, len(codes) - 2) if raw else 0
        ok = owner[:m] == owner[2 : m + 2]
        grams = codes[:m] | (codes[1 : m + 1] << np.uint64(8)) | (codes[2 : m + 2] << np.uint64(16))
        self.gram = (mix(grams[ok]) >> np.uint64(52)).astype(np.int64)
        self.gram_owner = owner[:m][ok]
        self.gram_count = np.maximum(np.bincount(self.gram_owner, minlength=len(raw)), 1).astype(np.float32)
        starts, lengths, docs = [], [], []
        for d, (a, b) in enumerate(zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True)):
            at = np.arange(a, max(b - (WINDOW - STRIDE), a + 1), STRIDE) if b > a else np.zeros(0, np.int64)
            starts.append(at)
            lengths.append(np.minimum(b - at, WINDOW))
            docs.append(np.full(len(at), d))
        self.start, self.length, self.doc = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (starts, lengths, docs))

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words (time first) of windows and a mask of those that are real."""
        t = np.arange(WINDOW)[:, None]
        mask = t < self.length[which][None, :]
        return self.word[np.where(mask, self.start[which][None, :] + t, self.start[which][None, :])], mask.astype(np.float32)


class Network:
    """The parameters, the forward pass and its gradient."""

    def __init__(self, n_words: int, seed: int = 9):
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        d = WORD_DIM + CHAR_DIM
        self.p = {
            "word": (rng.standard_normal((n_words + 1, WORD_DIM)) * 0.05).astype(np.float32),
            "char": (rng.standard_normal((BUCKETS, CHAR_DIM)) * 0.1).astype(np.float32),
            "in": np.concatenate([init(d, 3 * HIDDEN) for _ in range(2)], axis=1),
            "bias": np.zeros(6 * HIDDEN, np.float32),
            "uf": init(HIDDEN, 3 * HIDDEN),
            "ub": init(HIDDEN, 3 * HIDDEN),
            "att": init(2 * HIDDEN, ATTENTION),
            "attb": np.zeros(ATTENTION, np.float32),
            "v": init(ATTENTION, 1)[:, 0],
            "out": init(2 * HIDDEN, 1)[:, 0],
            "outb": np.zeros(1, np.float32),
        }

    def inputs(self, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        """Of each unlike word: word and mean trigram embedding, and what both directions' gates get of it."""
        p = self.p
        chars = np.zeros((len(batch.entry), CHAR_DIM), np.float32)
        for k in range(CHAR_DIM):
            chars[:, k] = np.bincount(batch.gram_owner, weights=p["char"][batch.gram, k], minlength=len(batch.entry)) / batch.gram_count
        x = np.concatenate([p["word"][batch.entry], chars], axis=1)
        return x, x @ p["in"] + p["bias"]

    def _run(self, gates: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        h = np.zeros((gates.shape[1], HIDDEN), np.float32)
        out = np.empty((gates.shape[0], gates.shape[1], HIDDEN), np.float32)
        saved = []
        for t in range(gates.shape[0]):
            g = h @ u
            zr = _sigmoid(gates[t, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(gates[t, :, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            step = (1 - z) * mask[t][:, None]
            if keep:
                saved.append((h, z, r, n, g[:, 2 * HIDDEN :], step))
            h = h + step * (n - h)
            out[t] = h
        return out, saved

    def forward(self, gates: np.ndarray, word: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows."""
        p = self.p
        x = gates[word]
        f, sf = self._run(x[:, :, : 3 * HIDDEN], p["uf"], mask, keep)
        b, sb = self._run(x[::-1, :, 3 * HIDDEN :], p["ub"], mask[::-1], keep)
        h = np.concatenate([f, b[::-1]], axis=2)
        a = np.tanh(h @ p["att"] + p["attb"])
        e = a @ p["v"]
        e = np.where(mask > 0, e, -1e9)
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        c = (w[:, :, None] * h).sum(axis=0)
        logit = c @ p["out"] + p["outb"][0]
        return (logit, (h, a, w, c, sf, sb)) if keep else logit

    def _back(self, dout: np.ndarray, saved: list, u: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dx = np.empty((dout.shape[0], dout.shape[1], 3 * HIDDEN), np.float32)
        du = np.zeros_like(u)
        dh = np.zeros(dout.shape[1:], np.float32)
        for t in range(dout.shape[0] - 1, -1, -1):
            h, z, r, n, hn, step = saved[t]
            dh = dh + dout[t]
            dz = -dh * (n - h) * mask[t][:, None] * z * (1 - z)
            dn = dh * step * (1 - n * n)
            dr = dn * hn * r * (1 - r)
            dg = np.concatenate([dz, dr, dn * r], axis=1)
            dx[t] = np.concatenate([dz, dr, dn], axis=1)
            du += h.T @ dg
            dh = dh * (1 - step) + dg @ u.T
        return dx, du

    def gradient(self, batch: Batch, which: np.ndarray, target: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Gradient of the mean log loss over windows, and the loss."""
        p = self.p
        x, gates = self.inputs(batch)
        word, mask = batch.windows(which)
        logit, (h, a, w, c, sf, sb) = self.forward(gates, word, mask, True)
        prob = _sigmoid(logit)
        d = ((prob - target) / len(which)).astype(np.float32)
        g = {"out": c.T @ d, "outb": d.sum(keepdims=True)}
        dc = d[:, None] * p["out"]
        dw = (h * dc[None]).sum(axis=2)
        de = w * (dw - (w * dw).sum(axis=0))
        da = de[:, :, None] * p["v"] * (1 - a * a)
        g["v"] = np.einsum("tn,tnk->k", de, a)
        flat = lambda y: y.reshape(-1, y.shape[-1])
        g["att"], g["attb"] = flat(h).T @ flat(da), flat(da).sum(axis=0)
        dh = w[:, :, None] * dc[None] + da @ p["att"].T
        dxf, g["uf"] = self._back(dh[:, :, :HIDDEN], sf, p["uf"], mask)
        dxb, g["ub"] = self._back(np.ascontiguousarray(dh[::-1, :, HIDDEN:]), sb, p["ub"], mask[::-1])
        dgates = flat(np.concatenate([dxf, dxb[::-1]], axis=2))
        per = np.zeros_like(gates)
        np.add.at(per, word.ravel(), dgates)
        g["in"], g["bias"] = x.T @ per, per.sum(axis=0)
        dx = per @ p["in"].T
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], batch.entry, dx[:, :WORD_DIM])
        g["word"][0] = 0
        g["char"] = np.zeros_like(p["char"])
        np.add.at(g["char"], batch.gram, (dx[:, WORD_DIM:] / batch.gram_count[:, None])[batch.gram_owner])
        loss = -np.mean(target * np.log(prob + 1e-7) + (1 - target) * np.log(1 - prob + 1e-7))
        return g, float(loss)


class Toxicity:
    """The network, its vocabulary and the calibration of documents' scores."""

    def __init__(self, words: list[str], hint: np.ndarray):
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(w) for w in raw]).astype(np.int64) if raw else np.zeros(0, np.int64)
        starts = ends - np.array([len(w) for w in raw], np.int64) if raw else ends
        self.vocabulary = HashTable(hash_spans(np.frombuffer(b"".join(raw) or b" ", np.uint8), starts, ends))
        self.net = Network(len(words))
        if len(words):
            self.net.p["word"][1:, 0] = hint
        self.scale = 1.0, 0.0

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all overlapping windows of whole texts, and their texts' numbers."""
        batch = Batch(texts, self.vocabulary)
        _, gates = self.net.inputs(batch)
        out = np.zeros(len(batch.start), np.float32)
        for at in range(0, len(out), _CHUNK):
            which = np.arange(at, min(at + _CHUNK, len(out)))
            out[which] = self.net.forward(gates, *batch.windows(which))
        return out, batch.doc

    def best(self, texts: list[str]) -> np.ndarray:
        """The highest logit of each text's windows; -inf without words."""
        logit, doc = self.logits(texts)
        out = np.full(len(texts), -np.inf)
        np.maximum.at(out, doc, logit)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated scores (0 to 1) of whole texts; 0 without words."""
        top = self.best([t or "" for t in texts])
        a, b = self.scale
        return np.where(np.isfinite(top), _sigmoid(a * np.where(np.isfinite(top), top, 0) + b), 0.0)


def train(texts: list[str], labels: np.ndarray, most_words: int, least_docs: int = 2, steps: int = 300, epochs: int = 10, seed: int = 9, known_labels: dict[int, int] | None = None) -> Toxicity:
    """Learns from documents' labels, in three rounds of a third of the steps, or of so many epochs, which keeps few documents from being learned by heart.

    First the windows of a toxic document count as toxic whose words have the highest sure odds, then those that the
    network finds so, and its highest; the clean windows that look most toxic then come more often. Of the windows
    an epoch takes at most 8,000 toxic ones (at random), twice as many clean ones, and the 4,000 clean ones that look worst.
    A fifth of the documents is kept from the gradient and fits the calibration; where the sample holds other shares of
    the labels than known_labels counts, the scores are set right for those.
    """
    rng = np.random.default_rng(seed)
    seen = [set(w for w in _split(t)) for t in texts]
    counts: dict[str, list[int]] = {}
    for words, y in zip(seen, labels.tolist(), strict=True):
        for w in words:
            counts.setdefault(w, [0, 0])[y] += 1
    known = sorted((w for w, c in counts.items() if sum(c) >= least_docs), key=lambda w: (-sum(counts[w]), w))[:most_words]
    n = np.bincount(labels, minlength=2)
    odds = np.array([_sure_odds(counts[w], n) for w in known])
    model = Toxicity(known, odds * HINT)
    part = rng.random(len(texts)) < 0.2
    fit = np.flatnonzero(~part)
    batch = Batch([texts[i] for i in fit], model.vocabulary)
    target = labels[fit][batch.doc].astype(np.float32)
    use = _likely(batch, target, np.concatenate([[0.0], odds]))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.net.p.items()}
    start = {k: model.net.p[k].copy() for k in ("word", "char")}
    step, rounds, passes, hard = 0, 0, 0, use[:0]
    while step < steps and rounds < 3 and len(target):
        if step >= (rounds + 1) * steps // 3 or passes == epochs:
            rounds, passes = rounds + 1, 0
            _, gates = model.net.inputs(batch)
            logit = np.concatenate([model.net.forward(gates, *batch.windows(np.arange(a, min(a + _CHUNK, len(target))))) for a in range(0, len(target), _CHUNK)])
            top = np.full(len(fit), -np.inf)
            np.maximum.at(top, batch.doc, logit)
            use = np.flatnonzero((target == 0) | (logit > 0) | (logit == top[batch.doc]))
            clean = np.flatnonzero(target == 0)
            hard = clean[np.argsort(-logit[clean])[:4000]]  # those that look most toxic, again beside the others
        passes += 1
        order = rng.permutation(use)
        toxic, clean = order[target[order] == 1][:8000], order[target[order] == 0]
        order = rng.permutation(np.concatenate([toxic, hard, clean[: max(2 * len(toxic) - len(hard), 1)]]))
        for a in range(0, len(order), 512):
            some = np.sort(order[a : a + 512])
            if step >= (rounds + 1) * steps // 3:
                break
            g, _ = model.net.gradient(_narrow(batch, some), np.arange(len(some)), target[some])
            step += 1
            rate = 0.01 * 0.5**rounds
            for k, v in model.net.p.items():
                m, s = moments[k]
                m += 0.1 * (g[k] - m)
                s += 0.01 * (g[k] * g[k] - s)
                if k in ("word", "char"):  # rare words and trigrams shouldn't be learned by heart
                    v -= np.float32(rate * 0.3) * (v - start[k])
                v -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    held = np.flatnonzero(part)
    if len(held):
        a, b = _calibrate(model.best([texts[i] for i in held]), labels[held])
        known_labels = known_labels or {}
        if n.min() and known_labels.get(0) and known_labels.get(1):
            b += float(np.log(known_labels[1] / known_labels[0]) - np.log(n[1] / n[0]))
        model.scale = a, b
    return model


def _sure_odds(c: list[int], n: np.ndarray) -> float:
    """How much a word's log odds of toxic documents are above 1 beyond chance, by its counts in clean and toxic ones; 0 for all others."""
    odds = np.log((c[1] + 3) / (n[1] + 6)) - np.log((c[0] + 3) / (n[0] + 6))
    return float(max(odds - 1 - 1.5 * np.sqrt(1 / (c[1] + 3) + 1 / (c[0] + 3)), 0.0))


def _likely(batch: Batch, target: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """All windows of clean documents, and of each toxic one those whose words speak for it most: their odds' sum is the document's highest, or near it."""
    word, mask = batch.windows(np.arange(len(target)))
    weight = (odds[batch.entry[word]] * mask).sum(axis=0)
    top = np.zeros(batch.doc.max(initial=-1) + 1)
    np.maximum.at(top, batch.doc, weight)
    return np.flatnonzero((target == 0) | (weight >= 0.7 * top[batch.doc]))


def _narrow(batch: Batch, which: np.ndarray) -> Batch:
    """A batch of some windows, with their words alone."""
    out = object.__new__(Batch)
    word, mask = batch.windows(which)
    unique, back = np.unique(word.T.ravel(), return_inverse=True)
    out.word, out.start, out.length, out.doc = back, np.arange(len(which)) * WINDOW, batch.length[which], batch.doc[which]
    out.entry, out.gram_count = batch.entry[unique], batch.gram_count[unique]
    place = np.full(len(batch.entry), -1)
    place[unique] = np.arange(len(unique))
    ok = place[batch.gram_owner] >= 0
    out.gram, out.gram_owner = batch.gram[ok], place[batch.gram_owner[ok]]
    return out


def _split(text: str) -> list[str]:
    return [w.decode() for w in fold(text).translate(bytes(32 if b < 128 and not chr(b).isalpha() else b for b in range(256))).split()]


def _calibrate(top: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through documents' highest logits, slightly smoothed."""
    ok = np.isfinite(top)
    x, t = top[ok], y[ok].astype(float)
    if not len(x) or t.min() == t.max():
        return 1.0, 0.0
    t = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
    mid, spread = x.mean(), x.std() + 1e-6
    z = np.stack([(x - mid) / spread, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    loss = lambda w: np.logaddexp(0, z @ w).sum() - (t * (z @ w)).sum() + 0.005 * w[0] ** 2
    for _ in range(100):
        p = _sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag([0.01, 1e-6]), z.T @ (p - t) + np.array([0.01 * w[0], 0.0]))
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0] / spread), float(w[1] - w[0] * mid / spread)
