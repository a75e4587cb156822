"""Token ids as length-delimited binary records with masked checksums, and an offset index for shuffled reads.

A shard file is a sequence of records:

    uint64 n | uint32 masked crc32 of those 8 bytes | n bytes of payload | uint32 masked crc32 of the payload

all little-endian. The mask rotates a checksum right by 15 bits and adds 0xA282EAD8, so that checksums of data that
hold checksums stay sound. A payload is int64 doc_id, uint8 flags (1: the id is null, 2: ids of 4 bytes), 3 bytes of
padding, uint32 number of ids, then the ids, 2 bytes each where all fit. The index file beside a shard holds, for each
record, int64 doc_id, uint64 offset and uint64 length of the whole record.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, new_folder, small_batches, table

_HEAD = struct.Struct("<QI")
_PAYLOAD = struct.Struct("<qB3xI")
_INDEX = struct.Struct("<qQQ")
#: Words whose ids a worker keeps in each of two generations; the memory stays bounded, the results don't depend on it.
CACHE_WORDS = 400_000
#: Texts are encoded together in groups of about so many characters.
GROUP_CHARS = 1 << 22
_ODD = r"\s\x00-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u3000\ufeff"
#: A space or line end after a character that is no kind of white space: no token of the vocabulary's pattern crosses it.
_CUT = re.compile(rf"(?<=[^{_ODD}])(?= (?!\n)|\n)")
#: Words that end in what may be white space.
_LAST = re.compile(rf"[{_ODD}]$")


def masked_crc(data: bytes) -> int:
    """The rotated checksum plus a constant."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record."""
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    payload = _PAYLOAD.pack(doc_id or 0, (doc_id is None) + 2 * wide, len(ids)) + ids.astype("<u4" if wide else "<u2").tobytes()
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked_crc(head)) + payload + struct.pack("<I", masked_crc(payload))


def unframe(read: Callable[[int], bytes]) -> tuple[int | None, np.ndarray] | None:
    """The next record by a read function, or None at the end; raises ValueError on damage."""
    head = read(_HEAD.size)
    if not head:
        return None
    if len(head) < _HEAD.size:
        raise ValueError("a record is cut off")
    n, crc = _HEAD.unpack(head)
    if crc != masked_crc(head[:8]):
        raise ValueError("a record's length is damaged")
    body = read(n + 4)
    if len(body) < n + 4 or struct.unpack("<I", body[n:])[0] != masked_crc(body[:n]):
        raise ValueError("a record's payload is damaged")
    doc_id, flags, count = _PAYLOAD.unpack_from(body)
    ids = np.frombuffer(body, "<u4" if flags & 2 else "<u2", count, _PAYLOAD.size).astype("<u4")
    return None if flags & 1 else doc_id, ids


def read_at(path: str, offset: int, length: int) -> tuple[int | None, np.ndarray]:
    """One record by its place in the index."""
    files, at = fs.FileSystem.from_uri(path)
    with files.open_input_file(at) as f:
        f.seek(offset)
        return unframe(_reader(f.read(length)))


def _reader(data: bytes) -> Callable[[int], bytes]:
    at = 0

    def read(n: int) -> bytes:
        nonlocal at
        out = data[at : at + n]
        at += n
        return out

    return read


def read_index(path: str) -> list[tuple[int, int, int]]:
    """doc_id, offset and length of each record of an index file."""
    files, at = fs.FileSystem.from_uri(path)
    with files.open_input_stream(at) as f:
        return list(_INDEX.iter_unpack(f.read()))


#: Bytes of ASCII that may be white space, and beginnings of wider characters that may be.
_PLAIN = bytes(32 if b <= 32 or b == 127 else b for b in range(256))
_WIDE = (b"\xc2", b"\xe1\x9a", b"\xe1\xa0", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80", b"\xef\xbb")
#: A word of Latin letters, behind a line end or not, and the signs after it, which the vocabulary's pattern parts from the letters.
_LETTERS = re.compile(r"(\n?)([A-Za-zÀ-ÖØ-öø-ɏ]+)([#*$%&|<>.,;:!?]*)")


def _is_plain(text: str) -> bool:
    """Whether each space and line end of a text is a place to cut at."""
    raw = text.encode()
    return b"  " not in raw.translate(_PLAIN) and text[:1] not in " \n" and text[-1:] != " " and (text.isascii() or not any(w in raw for w in _WIDE))


def cut(text: str) -> list[str]:
    """A text's words as one list: the first as it is, the others without the space before them but with a line end before them."""
    if _is_plain(text):
        return text.replace("\n", " \n").split(" ")
    head, *rest = _CUT.split(text)
    return [head, *[w if w[0] == "\n" else w[1:] for w in rest]]


def _joined(word: str) -> str:
    """A word with what stands before it; none but those after a line end begin with one."""
    return word if word[:1] == "\n" else " " + word


def _byte_letters() -> str:
    """The characters by which byte-level vocabularies write the 256 bytes: themselves where they show, else from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(hidden)) for b in range(256))


class Encoder:
    """Token ids of whole texts by the tokenizers library; ids of words that come again are kept."""

    def __init__(self, path: str):
        # a worker has one core; the library's own threads would only wait for each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        # what is asked for is new to this class, so the library's own table of words would only cost
        self.merges = self.model.model
        self.merges._resize_cache(0)
        self.letters = dict(enumerate(_byte_letters()))
        self.raw = [struct.pack("<I", i) for i in range(self.model.get_vocab_size())]
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # a byte-level token is written with one character for each of its bytes, an added one as it is
        added = {t.content for t in self.model.get_added_tokens_decoder().values()}
        self.sizes = np.zeros(self.model.get_vocab_size(), np.int64)
        for token, i in self.model.get_vocab().items():
            self.sizes[i] = len(token.encode()) if token in added else len(token)

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _pretoken(self, before: str, shown: str) -> bytes:
        """Ids of letters or signs that the vocabulary's pattern takes as one with the space (or nothing) before them, as the vocabulary writes it."""
        if not shown.isascii():
            shown = shown.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.raw[t.id] for t in self.merges.tokenize(before + shown)])

    def _learn(self, fresh: list[str]) -> None:
        """Encodes words that follow a space or line end: letters and the signs after them each by itself, any others by the whole tokenizer."""
        others = []
        kept, pretoken = self.kept, self._pretoken
        signs: dict[str, bytes] = {"": b""}
        space, line = self.letters[32], pretoken(self.letters[10], "")
        for w in fresh:
            if not (found := _LETTERS.fullmatch(w)):
                others.append(w)
                continue
            end, letters, after = found.groups()
            base = end + letters
            if (ids := kept.get(base) or self.older.get(base)) is None:
                ids = kept[base] = line + pretoken("", letters) if end else pretoken(space, letters)
            if after:
                if (tail := signs.get(after)) is None:
                    tail = signs[after] = pretoken("", after)
                ids += tail
            kept[w] = ids
        self._learn_others(others)

    def _learn_others(self, fresh: list[str]) -> None:
        """Encodes words, many joined in one text where no token can cross from one to the next."""
        loose = [w for w in fresh if not w or _LAST.search(w)]
        self.kept.update(zip(loose, self._plain([_joined(w) for w in loose]), strict=True))
        tight = [w for w in fresh if w not in self.kept] if loose else fresh
        groups = [tight[i : i + 512] for i in range(0, len(tight), 512)]
        spaced = [[_joined(w) for w in g] for g in groups]
        texts = ["".join(g) for g in spaced]
        for group, whole, text, e in zip(groups, spaced, texts, self.model.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, "<u4")
            lengths = map(len, whole) if text.isascii() else [len(w.encode()) for w in whole]
            at = (np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(np.fromiter(lengths, np.int64, len(group)))) + 1) * 4
            data, at = ids.tobytes(), at.tolist()
            self.kept.update(zip(group, map(data.__getitem__, map(slice, [0, *at], at)), strict=False))

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of unlike words that follow a space or line end."""
        if len(self.kept) > CACHE_WORDS:
            self.kept, self.older = {}, self.kept
        kept, older = self.kept, self.older
        fresh = []
        for w in words:
            if w not in kept:
                if (ids := older.get(w)) is None:
                    fresh.append(w)
                else:
                    kept[w] = ids
        self._learn(fresh)
        return list(map(kept.__getitem__, words))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """As encode(text, add_special_tokens=False).ids of each text. Texts are cut before spaces and line ends that no token crosses."""
        if not texts:
            return []
        plain = [_is_plain(t) for t in texts]
        order = sorted(range(len(texts)), key=lambda i: not plain[i])
        whole = pa.array([texts[i] for i in order if plain[i]], pa.large_string())
        split = pc.split_pattern(pc.replace_substring(whole, "\n", " \n"), " ")
        odd = [cut(texts[i]) for i in order if not plain[i]]
        rest = pa.array([w for ws in odd for w in ws], pa.large_string())
        flat = pa.chunked_array([split.flatten(), rest]).combine_chunks()
        first = np.concatenate([[0], np.cumsum(np.concatenate([pc.list_value_length(split).to_numpy(), np.fromiter(map(len, odd), np.int64, len(odd))]))]).astype(np.int64)
        # the first word of a text follows neither space nor line end, so it isn't looked up among the others
        heads = self._plain(flat.take(pa.array(first[:-1])).to_pylist())
        inner = np.ones(len(flat), bool)
        inner[first[:-1]] = False
        found = flat.filter(pa.array(inner)).dictionary_encode()
        known = [*self._ids(found.dictionary.to_numpy(zero_copy_only=False).tolist()), *heads]
        code = np.empty(len(flat), np.int64)
        code[inner] = found.indices.to_numpy()
        code[first[:-1]] = len(known) - len(heads) + np.arange(len(heads))
        pool = np.frombuffer(b"".join(known), "<u4")
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        begin = np.cumsum(size) - size
        counts = size[code]
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = pool[np.repeat(begin[code] - upto[:-1], counts) + np.arange(upto[-1])]
        out: list[np.ndarray] = [ids] * len(texts)
        ends = upto[first].tolist()
        for i, a, b in zip(order, ends, ends[1:], strict=False):
            out[i] = ids[a:b]
        return out


_encoders: dict[str, Encoder] = {}


def write_records(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes docs and writes shards to folder, ids ascending over all shards; returns the manifest: shard, path, index, records, ids.

    Nulls encode as empty texts, each document ends with end_id; null keys come first, and equal keys in the order of
    their texts' hashes. An empty table gives no shard. A task writes under a fresh name and only the attempts that
    Spark commits are in the manifest, so retries and lost executors leave no double records.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    return materialize(dealt.mapInArrow(lambda b: _write(b, tokenizer, folder, end_id), "shard long, path string, index string, records long, ids long"), "manifest")


def _groups(keys: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts by groups of about GROUP_CHARS."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > GROUP_CHARS:
            yield keys[start:i], texts[start:i]
            start, size = i, 0
        size += len(t)
    yield keys[start:], texts[start:]


def _write(batches: Iterator[pa.RecordBatch], tokenizer: str, folder: str, end_id: int) -> Iterator[pa.RecordBatch]:
    if tokenizer not in _encoders:
        _encoders[tokenizer] = Encoder(tokenizer)
    encoder = _encoders[tokenizer]
    shard = TaskContext.get().partitionId()
    out = index = None
    at = records = total = 0
    for batch in batches:
        if out is None:
            name = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}"
            files, place = fs.FileSystem.from_uri(name)
            files.create_dir(place.rpartition("/")[0], recursive=True)
            out, index = files.open_output_stream(place + ".rec"), files.open_output_stream(place + ".idx")
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for some, group in _groups(keys, texts):
            for k, ids in zip(some, encoder.encode(group), strict=True):
                made = frame(k, np.append(ids, np.uint32(end_id)))
                out.write(made)
                index.write(_INDEX.pack(k or 0, at, len(made)))
                at, records, total = at + len(made), records + 1, total + len(ids) + 1
    if out is not None:
        out.close()
        index.close()
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [name + ".rec"], "index": [name + ".idx"], "records": [records], "ids": [total]})


def read_records(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of each record of the shards, read back and checked."""
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("shard", "path", before.alias("start"))
    return shards.repartition(max(1, manifest.count()), "shard").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids array<long>")


def _read(batches: Iterator[pa.RecordBatch], digest: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            files, place = fs.FileSystem.from_uri(row["path"])
            start = row["start"]
            with files.open_input_stream(place, buffer_size=1 << 20) as f:
                held: list[tuple] = []
                size = 0
                while (record := unframe(f.read)) is not None:
                    doc_id, ids = record
                    held.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()) if digest else ids))
                    start += len(ids)
                    size += 64 if digest else len(ids)
                    if size > 1 << 20:
                        yield _batch(held, digest)
                        held, size = [], 0
                if held:
                    yield _batch(held, digest)


def _batch(held: list[tuple], digest: bool) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.int64() if digest else pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])


def digest_records(manifest: DataFrame) -> DataFrame:
    """As read_records, with the checksum of the ids as 32-bit integers in their place."""
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("shard", "path", before.alias("start"))
    return shards.repartition(max(1, manifest.count()), "shard").mapInArrow(lambda b: _read(b, True), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token records on disk, read back."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    manifest = write_records(docs, public_tokenizers.path("byte_bpe_50k.json"), new_folder(spark, "records"))
    return digest_records(manifest)
