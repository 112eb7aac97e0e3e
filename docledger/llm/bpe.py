"""Byte-level BPE encoding and decoding with contiguous rank arrays.

A short word is held as an array of part ids and an array of the ranks of adjacent
parts. Again and again the smallest rank is found by a scan, one boundary is deleted
and the two neighbouring ranks are looked up anew. The arrays of all new words of one
length form a matrix, so that numpy does each of these steps for all of them at once. Long
words use a heap over linked parts instead, as the scan is quadratic. Results equal those of
the public ``tokenizers`` library."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the public pre-tokenisation pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = (1 << 31) - 1
LONG_WORD = 64
BATCH_BYTES = 1 << 24  # of texts encoded together
#: Where a cut before each space could fall inside a run of white space.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
RUNS = f"{SPACE} (?:{SPACE}|$)"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a vocabulary file."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and beginnings of a string or binary column's values, and their bytes."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.diff(ends), ends[:-1], np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def _spread(start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for ``counts`` places each, one after the other."""
    return np.repeat(start - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _gathered(flat: np.ndarray, start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return flat[_spread(start, counts)]


def batches_of(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(offset, length) of slices with about BATCH_BYTES of text."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // BATCH_BYTES
    at = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b > a:
            yield a, b - a


class _Pairs:
    """(left id, right id) -> rank, by open addressing, for whole arrays at once."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        self.bits = max(4, (4 * len(merges)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        self.made = np.zeros(len(merges) + 1, np.int32)
        for (left, right), (rank, new) in merges.items():
            k = self._slot(np.array([left << 32 | right]))[0]
            while self.keys[k] >= 0:
                k = (k + 1) & ((1 << self.bits) - 1)
            self.keys[k], self.ranks[k], self.made[rank] = left << 32 | right, rank, new

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.ranks[at], NONE)
        todo = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a plain byte-level vocabulary")
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.byte_ids = [vocab[s] for s in symbols]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = rank, vocab[left + right]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for s, i in vocab.items():
            self.tokens[i] = bytes(byte_of[c] for c in s)
        for s, i in self.special.items():
            self.tokens[i] = s.encode()
        self.words = regex.compile(PATTERN)
        self.pairs = _Pairs(self.merges)
        self.first = np.array(self.byte_ids, np.int32)

    def _ranked(self, size: np.ndarray, begin: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words of UTF-8 bytes, one after the other, and how many each has."""
        counts, parts, order = np.zeros(len(size), np.int64), [], []
        for n in np.unique(size).tolist():
            same = np.flatnonzero(size == n)
            for k in range(0, len(same), 1 << 14):
                rows = same[k : k + (1 << 14)]
                cells = data[begin[rows][:, None] + np.arange(n)]
                if n > LONG_WORD:
                    long = [self._heap([self.byte_ids[b] for b in row.tolist()]) for row in cells]
                    counts[rows] = [len(x) for x in long]
                    parts.append(np.array([i for x in long for i in x], np.uint32))
                else:
                    ids, counts[rows] = self._scan(self.first[cells])
                    parts.append(ids[np.arange(n) < counts[rows][:, None]].astype(np.uint32))
                order.append(rows)
        if not parts:
            return np.zeros(0, np.uint32), counts
        order = np.concatenate(order)
        start = np.zeros(len(size), np.int64)
        start[order] = np.cumsum(counts[order]) - counts[order]
        return _gathered(np.concatenate(parts), start, counts), counts

    def _scan(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every row of part ids; the rows and how many parts each has left."""
        rows, n = ids.shape
        out, sizes = ids.copy(), np.full(rows, n)
        if n < 2:
            return out, sizes
        live = np.arange(rows)
        ranks = self.pairs.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(rows, n - 1)
        column = np.arange(n - 1)
        while True:
            k = ranks.argmin(1)
            best = ranks[np.arange(len(live)), k]
            going = best < NONE
            if not going.all():
                stop = live[~going]
                out[stop, : ids.shape[1]] = ids[~going]
                live, ids, ranks, k, best = live[going], ids[going], ranks[going], k[going], best[going]
            if not len(live):
                return out, sizes
            every, width = np.arange(len(live)), ids.shape[1]
            sizes[live] -= 1
            ids[every, k] = self.pairs.made[best]
            ids = np.where(column[: width - 1] <= k[:, None], ids[:, :-1], ids[:, 1:])
            if width == 2:
                out[live, :1] = ids
                return out, sizes
            ranks = np.where(column[: width - 2] < k[:, None], ranks[:, :-1], ranks[:, 1:])
            here = sizes[live]  # parts left of each row
            for at in (k, k - 1):
                ok = np.flatnonzero((at >= 0) & (at < width - 2))
                r, c = every[ok], at[ok]
                ranks[r, c] = np.where(c + 1 < here[ok], self.pairs.rank(ids[r, c], ids[r, c + 1]), NONE)

    def _heap(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.merges.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*m, k, ids[k], ids[k + 1]) for k in range(n - 1) if (m := get((ids[k], ids[k + 1])))]
        heapq.heapify(heap := [(r, k, new, a, b) for r, new, k, a, b in heap])
        while heap:
            _, k, new, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j], after[k] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right >= 0 and (m := get((ids[left], ids[right]))):
                    heapq.heappush(heap, (m[0], left, m[1], ids[left], ids[right]))
        return [x for x in ids if x >= 0]

    def _words(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts by the pattern alone, each as one array."""
        found = [self.words.findall(t) for t in texts]
        column = pa.array([w for f in found for w in f], pa.string()).dictionary_encode()
        flat, counts = self._ranked(*_bytes(column.dictionary))
        start = np.cumsum(counts) - counts
        codes = column.indices.to_numpy(zero_copy_only=False)
        ids = _gathered(flat, start[codes], counts[codes])
        ends = np.concatenate([[0], np.cumsum(counts[codes])])[np.cumsum([0, *map(len, found)])]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _special(self, text: str) -> np.ndarray:
        parts = self.split_special.split(text) if self.split_special else [text]
        plain = iter(self._words([p for p in parts if p not in self.special]))
        return np.concatenate([np.array([self.special[p]], np.uint32) if p in self.special else next(plain) for p in parts])

    def encode_many(self, texts: pa.Array) -> list[np.ndarray]:
        """For each text its ids; a null text has none.

        Texts are cut before each space, which is where a word begins unless the space stands in
        a run of white space; texts with such runs or special tokens go by the pattern as a
        whole. Equal pieces are encoded once, and most pieces are one word and maybe a full
        stop or comma, which columns tell without a look at each."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, RUNS)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for k in np.flatnonzero(odd).tolist():
            out[k] = self._special(texts[k].as_py())
        good = np.flatnonzero(~odd)
        if not len(good):
            return out
        cut = pc.split_pattern(texts.take(pa.array(good)), " ")
        offsets, column = cut.offsets.to_numpy().astype(np.int64), cut.values.dictionary_encode()
        codes, pieces = column.indices.to_numpy(zero_copy_only=False).astype(np.int64), column.dictionary
        # distinct pieces after a space: a word, a word and a mark, or anything else
        alone = pc.match_substring_regex(pieces, r"^\p{L}+$").to_numpy(zero_copy_only=False)
        marked = pc.match_substring_regex(pieces, r"^\p{L}+[.,]$").to_numpy(zero_copy_only=False)
        size, begin, data = _bytes(pieces)
        simple = np.flatnonzero(alone | marked)
        ids, counts = self._distinct((size - marked)[simple], begin[simple], data)
        n_ids = np.zeros(len(pieces) + len(good), np.int64)
        n_ids[simple] = counts + marked[simple]
        other = np.flatnonzero(~(alone | marked))
        rest = self._words([" " + p for p in pieces.take(pa.array(other)).to_pylist()])
        heads = self._words(pieces.take(pa.array(codes[offsets[:-1]])).to_pylist())
        n_ids[other], n_ids[len(pieces) :] = [len(x) for x in rest], [len(x) for x in heads]
        start = np.cumsum(n_ids) - n_ids
        table = np.zeros(int(n_ids.sum()), np.uint32)
        table[_spread(start[simple], counts)] = ids
        ends = np.flatnonzero(marked)
        table[start[ends] + n_ids[ends] - 1] = self.first[data[begin[ends] + size[ends] - 1]]
        for k, x in [*zip(other.tolist(), rest, strict=True), *zip(range(len(pieces), len(n_ids)), heads, strict=True)]:
            table[start[k] : start[k] + len(x)] = x
        codes[offsets[:-1]] = len(pieces) + np.arange(len(good))
        flat = _gathered(table, start[codes], n_ids[codes])
        ends = np.concatenate([[0], np.cumsum(n_ids[codes])])[offsets]
        for k, a, b in zip(good.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out[k] = flat[a:b]
        return out

    def _distinct(self, size: np.ndarray, begin: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``_ranked`` for words with a space before each, where words repeat."""
        flat = data[_spread(begin, size)]
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        column = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(flat)]).dictionary_encode()
        codes = column.indices.to_numpy(zero_copy_only=False)
        n, b, d = _bytes(column.dictionary)
        spaced = np.full(int(n.sum() + len(n)), 32, np.uint8)
        at = np.cumsum(n + 1) - (n + 1)
        spaced[_spread(at + 1, n)] = d[_spread(b, n)]
        ids, counts = self._ranked(n + 1, at, spaced)
        return _gathered(ids, (np.cumsum(counts) - counts)[codes], counts[codes]), counts[codes]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        return [x.astype("<u4").tobytes() for x in self.encode_many(pa.array(texts, pa.string()))]

    def encode(self, text: str | None) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


_LOADED: dict[str, ByteBPE] = {}


def tokenizer(path: str) -> ByteBPE:
    """One tokenizer for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers, binary) for every row.

    Null and empty texts have no ids; repeated rows are encoded each; very long words go
    by the heap; an empty table gives an empty result; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            for at, n in batches_of(b.column(1)):
                part = b.slice(at, n)
                ids = pa.array([x.astype("<u4").tobytes() for x in bpe.encode_many(part.column(1))], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text (decoded) for every row of ``encode``'s result; null ids give ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts = pa.array([bpe.decode(i or b"") for i in part.column(1).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def round_trip_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row."""
    both = decode(encode(docs, path, doc_id, text), path)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
