"""Sampled SentencePiece segmentations by forward filtering and backward sampling; lossless decoding."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, table
from tessera.llm.kernels import HashTable, SpanHashes, give_back, hash_spans, mix

#: How strongly likelier pieces are preferred: weights are (rank + 2) ** -ALPHA.
ALPHA = 1.0
SEED = 20
#: Texts are sampled together in groups of about so many bytes.
GROUP_BYTES = 3 << 19
#: Lattices of units that come again are kept for the next texts: of units of at most so many bytes, and until they have so many arcs; then a worker starts anew. Results don't depend on it.
KEPT_BYTES, KEPT_ARCS = 64, 4_000_000
#: Probabilities are rounded to so many bits, so that they add up alike in any batch.
_SHARE_BITS = 32
_SPACE_MARK = "▁"


class Lattices:
    """Forward-filtered lattices of units, from which segmentations are drawn backwards."""

    def __init__(self, node0: np.ndarray, length: np.ndarray, rank: np.ndarray, key: np.ndarray, back: np.ndarray, ids: np.ndarray):
        #: Of each unit: its first node and its bytes. Of each node: its rank. Of each arc: rank of its end and cumulative probability, start node, piece.
        self.node0, self.length, self.rank, self.key, self.back, self.ids = node0, length, rank, key, back, ids

    def joined(self, other: Lattices) -> Lattices:
        """These units and behind them the other's."""
        nodes, ranks = len(self.rank), int(self.key[-1] >> _SHARE_BITS) if len(self.key) else 0
        both = lambda a, b: np.concatenate([a, b])
        # a cumulative probability of one carries to the next rank
        return Lattices(both(self.node0, other.node0 + nodes), both(self.length, other.length), both(self.rank, (other.rank + ranks).astype(np.int32)), both(self.key, other.key + (ranks << _SHARE_BITS)), both(self.back, (other.back + nodes).astype(self.back.dtype)), both(self.ids, other.ids))

    def sample(self, units: np.ndarray, state: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each step back from the end: which draws take a piece, and the pieces. A draw is a unit and its state of chance."""
        out = []
        stop = self.node0[units]
        node = stop + self.length[units]
        live = np.argsort(units)  # neighbours look up neighbouring nodes
        step = 0
        while len(live):
            with np.errstate(over="ignore"):
                u = (mix(state[live] + np.uint64(step) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(64 - _SHARE_BITS)).astype(np.int64)
            arc = np.searchsorted(self.key, (self.rank[node[live]].astype(np.int64) << _SHARE_BITS) + u, side="right")
            out.append((live, self.ids[arc]))
            node[live] = self.back[arc]
            live = live[node[live] > stop[live]]
            step += 1
        return out


class Sampler:
    """The piece lattice of a SentencePiece model.

    The model's scores are merge ranks, not log probabilities, so a piece of rank r weighs (r + 2) ** -ALPHA. Spaces
    stand for the model's space mark; a text starts with one more. The mark alone and its runs, to which the model gives
    no score, stand behind all others. Texts are cut between characters that no piece of the model holds side by side, where
    the lattice falls apart; what lies between the cuts (words with the spaces before them, runs of signs) is sampled one by one.
    Characters without a piece of their own, and the mark itself where the text has it, go as byte pieces.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int32)
        plain: dict[bytes, tuple[int, float]] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[i], self.byte_id[value] = bytes([value]), i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes[i] = piece.replace(_SPACE_MARK, " ").encode()
                if not self.bytes[i].strip(b" "):
                    plain[self.bytes[i]] = i, float(n)
                elif model.get_score(i) > -1e8:
                    plain[self.bytes[i]] = i, -model.get_score(i)
        #: All pieces' bytes end to end, and each piece's place and size.
        self.pool = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.size = np.array([len(p) for p in self.bytes])
        self.begin = np.cumsum(self.size) - self.size
        plain[b" "] = model.piece_to_id(_SPACE_MARK), float(n)
        white, used, joined = np.zeros(256, bool), np.zeros(256, bool), np.zeros((256, 256), bool)
        white[[9, 10, 11, 12, 13, 32]] = True
        joined[:, 0x80:0xC0] = True  # the bytes of one character stay together
        for p in plain:
            b = np.frombuffer(p, np.uint8)
            used[b] = joined[b[:-1], b[1:]] = True
        joined[32] |= ~white
        #: White space that no piece but its byte's holds; whether to cut between two bytes (the first counts 256 times).
        self.alone = white & ~used
        self.cut = ~joined.ravel()
        self.single = {p for p in plain if len(p.decode()) == 1}
        self.tables = {}
        for length in sorted({len(p) for p in plain}):
            own = [p for p in plain if len(p) == length]
            buf = np.frombuffer(b"".join(own), np.uint8)
            at = np.arange(len(own)) * length
            self.tables[length] = HashTable(hash_spans(buf, at, at + length)), np.array([plain[p][0] for p in own], np.int32), -ALPHA * np.log(np.array([plain[p][1] for p in own]) + 2)
        self.kept: Lattices | None = None
        self.places: HashTable | None = None
        self.hashes = np.zeros(0, np.uint64)
        self.byte_logp = -ALPHA * np.log(n + 2)
        singles = sorted(self.single)
        by_length = {k: sorted(p for p in singles if len(p) == k) for k in (1, 2, 3, 4)}
        self.single_hashes = {}
        for k, own in by_length.items():
            at = np.arange(len(own)) * k
            self.single_hashes[k] = HashTable(hash_spans(np.frombuffer(b"".join(own), np.uint8), at, at + k))

    def _lattice(self, buf: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arcs of the units that buf holds end to end (first: offsets, one more at the end): end node, start node, piece, weight's log; nodes are byte offsets plus the unit's number."""
        n = len(buf)
        unit = np.repeat(np.arange(len(first) - 1), np.diff(first))
        end = first[1:][unit]
        place = np.arange(n)
        src, dst, ids, logp = [], [], [], []
        head = (buf & 0xC0) != 0x80
        known = np.zeros(n, bool)
        length = np.where(buf < 0x80, 1, np.where(buf < 0xE0, 2, np.where(buf < 0xF0, 3, 4)))
        span = SpanHashes(buf)
        for k, singles in self.single_hashes.items():
            at = np.flatnonzero(head & (length == k) & (place + k <= end))
            known[at[singles.find(span(at, at + k))[0]]] = True
        # a character without a piece of its own: all its bytes; those bytes' nodes lie inside the character
        owner = np.maximum.accumulate(np.where(head, place, 0))
        loose = np.flatnonzero(~known[owner])
        src.append(loose)
        dst.append(loose + 1)
        ids.append(self.byte_id[buf[loose]])
        logp.append(np.full(len(loose), self.byte_logp))
        at = np.flatnonzero(head)
        for k, (known_pieces, pieces, weights) in self.tables.items():
            at = at[at + k <= end[at]]
            if not len(at):
                break
            hit, where = known_pieces.find(span(at, at + k))
            src.append(at[hit])
            dst.append(at[hit] + k)
            ids.append(pieces[where])
            logp.append(weights[where])
        src, dst, ids, logp = (np.concatenate(x) for x in (src, dst, ids, logp))
        u = unit[src]
        return (dst + u).astype(np.int32), (src + u).astype(np.int32), ids.astype(np.int32), logp

    def _forward(self, first: np.ndarray, dst: np.ndarray, src: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, ...]:
        """For backward sampling: first nodes, nodes' ranks, arcs' keys (rank of their end node plus cumulative probability), start nodes and order."""
        starts = first[:-1] + np.arange(len(first) - 1)
        nodes = int(first[-1]) + len(first) - 1
        unit_of = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first) + 1)
        depth = (dst - starts[unit_of[dst]]).astype(np.int64)
        # by depth, end node and start node: one order, whatever else is in the batch
        if depth.max(initial=0) < 1 << 25:
            order = np.argsort((depth << 38) | (dst.astype(np.int64) << 7) | (dst - src))
        else:
            order = np.lexsort((-src, dst, depth))
        dst, src, logp, depth = dst[order], src[order], logp[order], depth[order]
        heads = np.concatenate([[True], dst[1:] != dst[:-1]]) if len(dst) else np.zeros(0, bool)
        group = np.flatnonzero(heads)
        alpha = np.full(nodes, -np.inf)
        alpha[starts] = 0.0
        rank = np.zeros(nodes, np.int32)
        rank[dst[group]] = np.arange(len(group))
        share = np.zeros(len(dst), np.int64)
        edges = np.flatnonzero(np.concatenate([[True], depth[1:] != depth[:-1], [True]])) if len(dst) else np.zeros(1, int)
        del depth
        cuts = np.searchsorted(group, edges)
        for a, b, ga, gb in zip(edges[:-1], edges[1:], cuts[:-1], cuts[1:], strict=True):
            at = group[ga:gb] - a
            size = np.diff(np.append(at, b - a))
            w = alpha[src[a:b]] + logp[a:b]
            top = np.maximum.reduceat(w, at)
            e = np.exp(w - np.repeat(top, size))
            whole = np.add.reduceat(e, at)
            alpha[dst[a:b][at]] = top + np.log(whole)
            share[a:b] = e / np.repeat(whole, size) * 2.0**_SHARE_BITS
        # whole numbers add up alike in any batch
        last = np.append(group[1:], len(dst)) - 1 if len(dst) else group
        total = np.cumsum(share)
        before = np.concatenate([[0], total[last[:-1]]]) if len(dst) else total
        total -= np.repeat(before, np.diff(np.append(group, len(dst))))
        total[last] = 1 << _SHARE_BITS
        key = (np.repeat(np.arange(len(group)), np.diff(np.append(group, len(dst)))) << _SHARE_BITS) + total
        return starts, rank, key, src, order

    def encode(self, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
        """A sampled segmentation of each text, fixed by its seed (uint64) alone; an empty text gives none."""
        out: list[np.ndarray] = []
        group: list[bytes] = []
        size = 0
        done = 0
        for t in texts:
            b = t.encode()
            if group and size + len(b) > GROUP_BYTES:
                out += self._encode(group, seeds[done : done + len(group)])
                done, group, size = done + len(group), [], 0
            group.append(b)
            size += len(b)
        if group:
            out += self._encode(group, seeds[done : done + len(group)])
        return out

    def _filtered(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Lattices:
        """The lattices of the units at the given places of buf, in their order."""
        first = np.concatenate([[0], np.cumsum(ends - starts)])
        place = np.arange(first[-1]) + np.repeat(starts - first[:-1], np.diff(first))
        dst, src, ids, logp = self._lattice(buf[place], first)
        node0, rank, key, back, order = self._forward(first, dst, src, logp)
        return Lattices(node0, np.diff(first), rank, key, back, ids[order])

    def _known(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[Lattices, np.ndarray, Lattices, np.ndarray]:
        """Lattices of all units: kept ones and the places in them (-1: none), and fresh ones with the places of the other units."""
        if self.kept is not None and len(self.kept.key) > KEPT_ARCS:
            self.kept = self.places = None
        at = np.full(len(starts), -1)
        if self.kept is not None:
            hit, where = self.places.find(hashes)
            at[hit] = where
        left = np.flatnonzero(at < 0)
        _, some, which, times = np.unique(hashes[left], return_index=True, return_inverse=True, return_counts=True)
        some = left[some]
        again = (times > 1) & (ends[some] - starts[some] <= KEPT_BYTES)
        place = np.cumsum(again) - 1
        if again.any():
            made = self._filtered(buf, starts[some[again]], ends[some[again]])
            old = 0 if self.kept is None else len(self.kept.node0)
            self.kept = made if self.kept is None else self.kept.joined(made)
            self.hashes = np.concatenate([self.hashes[:old], hashes[some[again]]])
            self.places = HashTable(self.hashes)
            at[left] = np.where(again[which], old + place[which], -1)
        place = np.where(again, -1, np.cumsum(~again) - 1)
        rest = np.full(len(starts), -1)
        rest[left] = place[which]
        fresh = self._filtered(buf, starts[some[~again]], ends[some[~again]])
        return self.kept, at, fresh, rest

    def _encode(self, texts: list[bytes], seeds: np.ndarray) -> list[np.ndarray]:
        # each text as a space and its bytes; a last space ends the buffer
        big = b"".join(b" " + t if t else b"" for t in texts) + b" "
        buf = np.frombuffer(big, np.uint8)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts])
        begin = np.cumsum(sizes) - sizes
        body = buf[:-1]
        fresh = np.ones(len(body), bool)
        fresh[1:] = self.cut[(body[:-1].astype(np.uint16) << 8) | body[1:]]
        fresh[begin[sizes > 0]] = True
        items = np.flatnonzero(fresh)
        alone = self.alone[body[items]]
        units = np.flatnonzero(~alone)
        starts = items[units]
        ends = np.append(items[1:], len(body))[units]
        doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, np.append(begin, len(body)))))
        with np.errstate(over="ignore"):
            state = mix(seeds[doc] + (starts - begin[doc]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        kept, at_kept, new, at_new = self._known(buf, starts, ends, hash_spans(buf, starts, ends))
        drawn = []
        for lattices, at in ((kept, at_kept), (new, at_new)):
            mine = np.flatnonzero(at >= 0)
            if len(mine):
                drawn += [(mine[x], y, k) for k, (x, y) in enumerate(lattices.sample(at[mine], state[mine]))]
        sizes_ = np.ones(len(items), np.int64)
        count = np.zeros(len(starts), np.int64)
        for x, _, _ in drawn:
            count[x] += 1
        sizes_[units] = count
        offset = np.cumsum(sizes_) - sizes_
        total = np.zeros(int(sizes_.sum()), np.int32)
        last = offset[units] + count - 1
        for x, y, k in drawn:
            total[last[x] - k] = y
        gaps = np.flatnonzero(alone)
        total[offset[gaps]] = self.byte_id[body[items[gaps]]]
        cuts = np.append(offset, len(total))[np.searchsorted(items, np.append(begin, len(body)))]
        return [total[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of a segmentation, whichever was sampled."""
        return self.decode_all([ids])[0]

    def decode_all(self, ids: list[np.ndarray]) -> list[str]:
        """The texts of segmentations."""
        if not ids:
            return []
        whole = np.concatenate(ids)
        size = self.size[whole]
        upto = np.concatenate([[0], np.cumsum(size)])
        raw = self.pool[np.repeat(self.begin[whole] - upto[:-1], size) + np.arange(upto[-1])].tobytes()
        ends = upto[np.concatenate([[0], np.cumsum([len(x) for x in ids])])].tolist()
        return [raw[a + 1 : b].decode() for a, b in zip(ends, ends[1:], strict=False)]


_samplers: dict[str, Sampler] = {}


def sampler(path: str) -> Sampler:
    """The worker's sampler of a model file."""
    if path not in _samplers:
        _samplers[path] = Sampler(path)
    return _samplers[path]


def row_seeds(keys: list[int | None], seed: int = SEED) -> np.ndarray:
    """A seed for each row key; null has one of its own."""
    raw = np.array([0 if k is None else k for k in keys], np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        return mix(raw + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)) + np.array([k is None for k in keys], np.uint64)


def _encode(batches: Iterator[pa.RecordBatch], path: str, seed: int, digest: bool) -> Iterator[pa.RecordBatch]:
    model = sampler(path)
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        ids = model.encode(texts, row_seeds(keys, seed))
        if digest:
            sound = []
            for at in range(0, len(ids), 200):
                sound += [x == t for x, t in zip(model.decode_all(ids[at : at + 200]), texts[at : at + 200], strict=True)]
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array(sound)], names=["doc_id", "n_tokens", "ids_crc32", "lossless"])
        else:
            values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, values)], names=[*batch.schema.names, "ids"])
        give_back()


def encode(docs: DataFrame, path: str, seed: int = SEED) -> DataFrame:
    """doc_id, text and ids (array of int): a segmentation of each whole text, sampled by seed and doc_id.

    A null text counts as empty and has no ids; a text that comes again under the same id has the same ids. Rows are
    encoded one by one, so partitioning, retries and order change nothing.
    """
    small_batches(docs.sparkSession, 2000)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(lambda b: _encode(b, path, seed, False), "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of encoded rows' ids."""
    return encoded.select("doc_id", "ids").mapInPandas(lambda b: _decode(b, path), "doc_id long, text string")


def _decode(frames, path: str):
    model = sampler(path)
    for x in frames:
        yield x.assign(text=[model.decode(np.asarray(i)) for i in x.ids])[["doc_id", "text"]]


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's sampled segmentation: number and checksum of its ids, and whether decoding gave the text back."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents")
    small_batches(spark, 2000)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(lambda b: _encode(b, path, SEED, True), "doc_id long, n_tokens long, ids_crc32 long, lossless boolean")
