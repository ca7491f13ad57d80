"""Token counts of byte-level BPE vocabularies without emitting tokens.

A text is cut at the vocabulary's special strings (each is one token), then into words by the published byte-level
pattern. A word of n bytes starts as n symbols in a linked list; a heap holds the adjacent pairs by merge rank. The pair
of lowest rank (leftmost on ties) is merged until none is left; the count is the initial symbols minus the merges.

Words repeat within and across texts, so the words of a slice of texts are found and hashed with array operations. Each
word is compared with the one that stands for its hash in the slice; each worker remembers the counts of up to ``MEMORY``
distinct words by 128 bits of hash of their characters and places.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from duskline.llm.arrow_map import append_columns
from duskline.llm.hashing import segment_hashes

#: Distinct words a worker remembers, at 28 bytes each; when there are more it starts afresh. It bounds memory, not results.
MEMORY = 1 << 20
#: The published pattern of byte-level BPE (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CONTRACTION = regex.compile(r"'(?:[stmd]|re|ve|ll)")
#: Characters of texts handled at once.
SLICE_CHARS = 1 << 18


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 characters for
    themselves, the others for characters from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class WordMemory:
    """Counts by 128-bit hash, in an open-addressing table of fixed size."""

    def __init__(self, size: int = MEMORY):
        self.size, self.shift = size, np.uint64(64 - max(2 * size - 1, 1).bit_length())
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.slots = np.full(1 << 64 - int(self.shift), -1, np.int32)
        self.keys, self.tokens = np.empty((2, self.size), np.uint64), np.empty(self.size, np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The remembered count of each key ``[2, words]``, -1 if there is none, and the slot where its search ended."""
        at = (keys[0] >> self.shift).astype(np.int64)
        row = self.slots[at]
        other = lambda r, w: (r >= 0) & ((self.keys[0][r] != keys[0][w]) | (self.keys[1][r] != keys[1][w]))
        todo = np.flatnonzero(other(row, slice(None)))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
            row[todo] = self.slots[at[todo]]
            todo = todo[other(row[todo], todo)]
        return np.where(row >= 0, self.tokens[row], -1), at

    def add(self, keys: np.ndarray, tokens: np.ndarray, at: np.ndarray) -> None:
        """Remember distinct new keys whose searches ended at the free slots ``at``."""
        if self.n + len(tokens) > self.size:
            self.clear()
            keys, tokens = keys[:, : self.size], tokens[: self.size]
            at = (keys[0] >> self.shift).astype(np.int64)
        rows = np.arange(self.n, self.n + len(tokens), dtype=np.int32)
        self.keys[:, rows], self.tokens[rows] = keys, tokens
        self.n += len(tokens)
        while len(rows):
            free = self.slots[at] < 0
            self.slots[at[free]] = rows[free]
            left = self.slots[at] != rows
            rows, at = rows[left], (at[left] + 1) & (len(self.slots) - 1)


class MergeCounter:
    """Merge ranks and special strings of one ``tokenizers`` file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        pre = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE without normaliser and prefix space is counted")
        vocab = model["vocab"]
        byte_id = [vocab[s] for s in byte_symbols()]
        self.rank: dict[int, dict[int, int]] = {}  # left symbol -> right symbol -> rank of their merge
        self.merged: list[int] = []  # rank -> merged symbol
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.rank.setdefault(vocab[a], {}).setdefault(vocab[b], len(self.merged))
            self.merged.append(vocab[a + b])
        self.byte_id = byte_id
        # Rank of each two bytes' merge, -1 if there is none.
        self.pair_rank = [self.rank.get(x, {}).get(y, -1) for x in byte_id for y in byte_id]
        special = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.kinds = _kinds()
        self.known = WordMemory()

    def word(self, word: str) -> int:
        """Tokens of one word."""
        raw = word.encode()
        n = left = len(raw)
        if n == 1:
            return 1
        bits = n.bit_length()
        pair_rank = self.pair_rank
        heap = [r << bits | i for i in range(n - 1) if (r := pair_rank[raw[i] << 8 | raw[i + 1]]) >= 0]
        if not heap:
            return n
        heapify(heap)
        mask = (1 << bits) - 1
        rank, merged, byte_id = self.rank, self.merged, self.byte_id
        symbol = [byte_id[b] for b in raw]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            i = top & mask
            j = after[i]
            r = top >> bits
            if j >= n or symbol[i] not in rank or rank[symbol[i]].get(symbol[j]) != r:
                continue  # one of the two has been merged since
            symbol[i] = s = merged[r]
            symbol[j] = -1
            after[i] = k = after[j]
            after[j] = n
            left -= 1
            if k < n:
                before[k] = i
                if s in rank and (r := rank[s].get(symbol[k])) is not None:
                    heappush(heap, r << bits | i)
            if (h := before[i]) >= 0 and (t := symbol[h]) in rank and (r := rank[t].get(s)) is not None:
                heappush(heap, r << bits | h)
        return left

    def count(self, text: str) -> int:
        """Tokens of a text, word by word."""
        parts = [text] if self.special is None else self.special.split(text)
        return len(parts) - 1 + sum(self.word(w) for part in parts for w in self.pattern.findall(part))

    def count_all(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text. Texts with contractions or special strings go word by word."""
        total = np.zeros(len(texts), np.int64)
        plain = []
        for i, text in enumerate(texts):
            if ("'" in text and _CONTRACTION.search(text)) or (self.special and self.special.search(text)):
                total[i] = self.count(text)
            elif text:
                plain.append(i)
        at = 0
        while at < len(plain):
            last, size = at, 0
            while last < len(plain) and (size < SLICE_CHARS or last == at):
                size += len(texts[plain[last]])
                last += 1
            total[plain[at:last]] = self._slice([texts[i] for i in plain[at:last]])
            at = last
        return total

    def _slice(self, texts: list[str]) -> np.ndarray:
        whole = "".join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(codes)
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        begin = np.zeros(n + 1, bool)
        begin[offsets] = True  # the first character of each text, and the end
        kind = self.kinds[codes]
        cut = begin[:n].copy()
        cut[1:] |= kind[1:] != kind[:-1]
        # The last white space before a word stands apart from the white space before it; a plain space joins the word.
        joint = np.flatnonzero((kind[:-1] == 0) & (kind[1:] != 0) & ~begin[1:n])
        cut[joint] = True
        cut[joint[codes[joint] == 32] + 1] = False
        starts = np.flatnonzero(cut)
        stops = np.append(starts[1:], n)
        keys = segment_hashes(codes, starts, stops, 2)
        _, first, back = np.unique(keys[0], return_index=True, return_inverse=True)
        if not _same_words(codes, starts, stops, starts[first][back], stops[first][back]):
            return np.array([self.count(t) for t in texts])  # two words have one hash
        keys = keys[:, first]
        tokens, at = self.known.find(keys)
        new = np.flatnonzero(tokens < 0)
        tokens[new] = [self.word(whole[a:b]) for a, b in zip(starts[first[new]].tolist(), stops[first[new]].tolist(), strict=True)]
        self.known.add(keys[:, new], tokens[new], at[new])
        return np.add.reduceat(tokens[back].astype(np.int64), np.searchsorted(starts, offsets[:-1]))


def _same_words(codes: np.ndarray, starts: np.ndarray, stops: np.ndarray, as_starts: np.ndarray, as_stops: np.ndarray) -> bool:
    """Whether each segment equals its stand-in; the segments ``starts``..``stops`` cover ``codes``."""
    size = stops - starts
    if (size != as_stops - as_starts).any():
        return False
    return bool((codes == codes[np.arange(len(codes)) + np.repeat(as_starts - starts, size)]).all())


def _kinds() -> np.ndarray:
    """Kind of every code point as the pattern sees it: 0 white space, 1 letter, 2 number, 3 other."""
    every = "".join(map(chr, range(0x110000)))
    kind = np.full(0x110000, 3, np.uint8)
    for value, pattern in ((0, r"\s+"), (1, r"\p{L}+"), (2, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            kind[m.start() : m.end()] = value
    return kind


_LOADED: dict[str, MergeCounter] = {}


def load(path: str) -> MergeCounter:
    """The counter of a vocabulary file, read once a process."""
    if path not in _LOADED:
        with open(path, encoding="utf-8") as f:
            _LOADED[path] = MergeCounter(json.load(f))
    return _LOADED[path]


def count_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text", limit: int = 512, without: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``vocabulary`` is the path of a ``tokenizers`` file that every executor has. Null and empty texts have 0 bytes and
    tokens. Texts of any length are counted whole. Repeated rows are counted each, equal texts alike. An empty table gives
    an empty result. Extra columns stay; ones named like the new ones are replaced.
    """
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        counter = load(vocabulary)
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        tokens = counter.count_all([t or "" for t in texts])
        return [pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(tokens), pa.array(tokens > limit)]

    return append_columns(docs, fields, compute, without)
