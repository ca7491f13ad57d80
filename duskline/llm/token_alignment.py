"""Alignment of two tokenizers on each text: groups between shared cuts, and how often token ids are linked corpus-wide.

Tokenizer A is a byte-level BPE of a ``tokenizers`` file, read on a space and the text; tokenizer B is a ``sentencepiece``
model, which adds that space itself. Both cover the same bytes, and a byte offset where a token of A and one of B end is a
shared cut. Cuts are found by divide and conquer: in an interval the token end of A in the middle is looked up among the
ends of B by bisection; where it is none, the next end of B is looked up among those of A, and so on to the right, then to
the left of the middle, until an end is common. Both halves are then searched in the same way, and an interval without a cut
becomes a leaf group. All intervals of one depth are searched together, over all texts of a slice.

A token of A and one of B are linked where their byte ranges overlap. Counts of linked id pairs are summed over the corpus
by Spark; the frequent pairs (``HEAD``, bounded) go to every task as a table, the rest meet their documents in a join.

Texts are encoded piece by piece. A piece ends before a space that follows a character other than white space: neither
vocabulary's words cross such a place, so the pieces' tokens are the text's. Pieces repeat, so each worker remembers the
tokens of those it has seen; where white space stands in another way, the text is one piece.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskline.llm.arrow_map import bound_batches
from duskline.llm.token_counts import PATTERN, byte_symbols
from duskline.session import cut

#: Pieces and tokens that a worker remembers before it starts afresh; characters of texts handled at once.
PIECES, POOL, SLICE_CHARS = 800_000, 8_000_000, 1 << 20
#: Pairs of ids whose counts are handed to every task, at 17 bytes each.
HEAD = 1 << 20
#: Distinct pairs that a counting task holds before it hands them on.
HELD = 1 << 21
#: A pair of ids is (id of A) * 2**BITS + (id of B).
BITS = 20


class Tokenizers:
    """Both vocabularies, the bytes of their tokens, and the tokens of remembered pieces."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tokenizers

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {s: bytes([b]) for b, s in enumerate(byte_symbols())}
        bytes_a = {i: b"".join(byte_of[c] for c in entry) for entry, i in spec["model"]["vocab"].items() if all(c in byte_of for c in entry)}
        for added in spec.get("added_tokens", ()):
            bytes_a.pop(added["id"], None)
        self.a = tokenizers.Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.quick = _as_ranks(spec, bytes_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        bytes_b = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces) if not (self.b.is_control(i) or self.b.is_unknown(i))}
        #: No piece of B has a space after another character, so no merge of B goes over such a place.
        self.splits_b = not any("▁" in p.lstrip("▁") for p in pieces) and self.b.encode("ab  c") == [*self.b.encode("ab"), *self.b.encode(" c")]
        self.bytes = [_by_id(bytes_a), _by_id(bytes_b)]
        if max(map(len, self.bytes)) > 1 << BITS:
            raise ValueError(f"vocabularies of more than {1 << BITS} tokens are not aligned")
        self.size = [np.array([len(b or b"") for b in table]) for table in self.bytes]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.good = np.zeros(0, bool)
        self.pool = [_Pool(), _Pool()]

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        if self.quick:
            return [self.quick.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]

    def pieces(self, text: str) -> list[str]:
        """The text cut before its spaces (which are left out); the whole text where that would change its tokens."""
        if not self.splits_b or "▁" in text:
            return [text]
        parts = text.split(" ")
        if all(parts) and not any(p[-1].isspace() for p in parts[:-1]):
            return parts
        out, piece = [], parts[0]
        for p in parts[1:]:
            if piece and not piece[-1].isspace():
                out.append(piece)
                piece = p
            else:
                piece = f"{piece} {p}"
        if piece or not out:
            return [*out, piece]
        return [*out[:-1], f"{out[-1]} "]

    def learn(self, pieces: set[str]) -> None:
        """Remember the tokens of pieces."""
        new = [p for p in pieces if p not in self.known]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        texts = [" " + p for p in new]
        sides = [self.encode_a(texts), self.b.encode(new, num_threads=1)]
        table_a, table_b = self.bytes
        good = [(raw := t.encode()) == b"".join([table_a[i] or b"" for i in a]) and raw == b"".join([table_b[i] or b"" for i in b]) for t, a, b in zip(texts, *sides, strict=True)]
        self.good = np.append(self.good, good).astype(bool)
        for pool, ids in zip(self.pool, sides, strict=True):
            pool.add(ids)

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and for B: ids of all texts, one after another, and how many each text has. Texts that either side does not
        give back byte by byte have none."""
        if len(self.known) > PIECES or sum(p.used for p in self.pool) > POOL:
            self.forget()
        cut_up = [self.pieces(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(cut_up))
        self.learn(set(flat))
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        text = np.repeat(np.arange(len(texts)), [len(c) for c in cut_up])
        bad = np.zeros(len(texts), bool)
        bad[text[~self.good[at]]] = True
        at, text = at[~bad[text]], text[~bad[text]]
        out = []
        for pool in self.pool:
            n = pool.size[at]
            ids = pool.ids[np.repeat(pool.begin[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            out.append((ids.astype(np.int64), np.bincount(text, n, len(texts)).astype(np.int64)))
        return out


class _Pool:
    """Lists of ids, one after another in an array that grows."""

    def __init__(self):
        self.ids, self.used, self.begin, self.size = np.empty(1 << 16, np.int32), 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, lists: list[list[int]]) -> None:
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.int32, size.sum())
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.empty(self.used + 2 * len(flat), np.int32)))
        self.ids[self.used : self.used + len(flat)] = flat
        self.begin, self.size = np.append(self.begin, self.used + np.cumsum(size) - size), np.append(self.size, size)
        self.used += len(flat)


def _by_id(table: dict[int, bytes]) -> list[bytes | None]:
    return [table.get(i) for i in range(max(table) + 1)]


def _as_ranks(spec: dict, table: dict[int, bytes]):
    """The same vocabulary for the faster library, if its ids follow its merges; None otherwise."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer") and not model.get("ignore_merges")
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", ())]
    if not plain or any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or len(table) != 256 + len(merges):
        return None
    import tiktoken

    return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={v: k for k, v in table.items()}, special_tokens={})


def shared_cuts(a: np.ndarray, b: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Indices in ``a`` of the ends that ``b`` has too, by divide and conquer.

    ``a`` and ``b`` are ascending byte ends of the tokens of several texts on end; ``last`` are the indices in ``a`` of the
    texts' last tokens, whose ends are common.
    """
    found = [last]
    low, high = np.concatenate(([-1], last)).astype(np.int64)[:-1] + 1, last  # ends low..high-1 of each interval are open
    while True:
        some = high > low
        low, high = low[some], high[some]
        if not len(low):
            return np.sort(np.concatenate(found))
        middle = (low + high) // 2
        right = _bisect(a, b, middle, high)
        left = np.full(len(low), -1)
        none = np.flatnonzero(right < 0)
        left[none] = _bisect_left(a, b, middle[none] - 1, low[none])
        hit = np.maximum(right, left)
        cut_here = hit >= 0
        low, high, hit, left, middle = (x[cut_here] for x in (low, high, hit, left, middle))
        found.append(hit)
        # Right of a cut found left of the middle there is none: that interval is a leaf.
        whole = left < 0
        low, high = np.concatenate((low, (hit + 1)[whole])), np.concatenate((np.minimum(hit, middle), high[whole]))


def _bisect(a: np.ndarray, b: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """First index from ``at`` below ``stop`` whose end is common, -1 if there is none."""
    out, live, at = np.full(len(at), -1), np.arange(len(at)), at.copy()
    while len(live):
        live = live[at[live] < stop[live]]
        ends = a[at[live]]
        met = b[np.searchsorted(b, ends)]
        same = met == ends
        out[live[same]] = at[live[same]]
        live, met = live[~same], met[~same]
        at[live] = np.searchsorted(a, met)
    return out


def _bisect_left(a: np.ndarray, b: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Last index down from ``at`` to ``stop`` whose end is common, -1 if there is none."""
    out, live, at = np.full(len(at), -1), np.arange(len(at)), at.copy()
    while len(live):
        live = live[at[live] >= stop[live]]
        ends = a[at[live]]
        place = np.searchsorted(b, ends, "right") - 1
        met = np.where(place >= 0, b[np.maximum(place, 0)], -1)
        same = met == ends
        out[live[same]] = at[live[same]]
        live, met = live[~same], met[~same]
        at[live] = np.searchsorted(a, met, "right") - 1
    return out


class Aligned:
    """Groups and links of the texts of a slice; ``ids`` and ``n`` as ``Tokenizers.encode`` gives them."""

    def __init__(self, sides: list[tuple[np.ndarray, np.ndarray]], sizes: list[np.ndarray]):
        self.ids, self.n = [s[0] for s in sides], [s[1] for s in sides]
        # Texts stand on end; both sides have the same bytes of each.
        self.ends = [np.cumsum(size[ids]) for (ids, _), size in zip(sides, sizes, strict=True)]
        a, b = self.ends
        texts = np.flatnonzero(self.n[0])
        last = np.cumsum(self.n[0])[texts] - 1
        cuts = shared_cuts(a, b, last)
        cuts_b = np.searchsorted(b, a[cuts])
        self.group = [np.searchsorted(c, np.arange(len(e))) for c, e in zip((cuts, cuts_b), (a, b), strict=True)]
        owner = np.repeat(np.arange(len(self.n[0])), self.n[0])
        self.n_groups = np.bincount(owner[cuts], minlength=len(self.n[0]))
        # Between two neighbouring ends of either side lies one overlap of one token of A and one of B.
        every = np.sort(np.concatenate((a, b)), kind="stable")
        every = every[np.append(every[1:] != every[:-1], True)] if len(every) else every
        self.links = np.searchsorted(a, every), np.searchsorted(b, every)
        self.text_of_link = owner[self.links[0]]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct ``(text, pair)`` in order and how many links each has."""
        key = np.sort(self.text_of_link << 2 * BITS | self.ids[0][self.links[0]] << BITS | self.ids[1][self.links[1]])
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        return key[new] >> 2 * BITS, key[new] & (1 << 2 * BITS) - 1, np.diff(np.append(new, len(key)))

    def written(self) -> Iterator[bytes]:
        """``a1,a2|b1;a3|b2`` of each text."""
        n_a, n_b = (len(i) for i in self.ids)
        group = np.concatenate(self.group)
        # Tokens of a group: those of A, then those of B; each is followed by the sign that comes next.
        order = np.argsort(group * 2 + np.repeat([0, 1], [n_a, n_b]), kind="stable")
        ids, group, side = np.concatenate(self.ids)[order], group[order], (order >= n_a)
        sign = np.full(len(ids), ord(","), np.uint8)
        if len(ids):
            change = np.append(group[1:] != group[:-1], True)
            turn = np.append(side[1:] & ~side[:-1], False)
            sign[turn], sign[change] = ord("|"), ord(";")
        width = len(str(int(ids.max()))) if len(ids) else 1
        digits = np.empty((len(ids), width + 1), np.uint8)
        for k in range(width):
            digits[:, width - 1 - k] = ids // 10**k % 10 + 48
        digits[:, width] = sign
        used = 1 + np.searchsorted(10 ** np.arange(1, width), ids, "right")
        flat = digits[np.arange(width + 1) >= width - used[:, None]].tobytes()
        stops = np.concatenate(([0], np.cumsum(used + 1)))[np.concatenate(([0], np.cumsum(self.n[0] + self.n[1])))]
        for i in range(len(self.n[0])):
            yield flat[stops[i] : max(stops[i + 1] - 1, stops[i])]


_LOADED: dict[tuple[str, str], Tokenizers] = {}


def load(path_a: str, path_b: str) -> Tokenizers:
    """Both tokenizers, read once a process."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Tokenizers(path_a, path_b)
    return _LOADED[path_a, path_b]


def slices(texts: list[str | None], chars: int = SLICE_CHARS) -> Iterator[list[str | None]]:
    """Consecutive texts of about ``chars`` characters; a longer text is a slice of its own."""
    some, size = [], 0
    for t in texts:
        if some and size + len(t or "") > chars:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t or "")
    if some:
        yield some


def _pack(pairs: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending pairs and their numbers, compressed."""
    step = np.diff(pairs, prepend=0).view(np.uint64)
    return pa.compress(np.concatenate((step, n.astype(np.uint64))).view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True) + (2 * len(pairs) * 8).to_bytes(8, "little") if len(pairs) else b""


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not packed:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = int.from_bytes(packed[-8:], "little")
    raw = np.frombuffer(pa.decompress(packed[:-8], decompressed_size=size, codec="zstd", asbytes=True), np.uint8).reshape(8, -1).T
    both = np.ascontiguousarray(raw).view(np.int64).reshape(2, -1)
    return np.cumsum(both[0]), both[1].copy()


def align_texts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs)`` per row, with ``groups`` (text) if wanted. ``pairs`` holds
    the distinct linked id pairs of the row in a compressed form."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = load(path_a, path_b)
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1).to_pylist()):
                found = Aligned(both.encode(texts), both.size)
                text, pair, n = found.pairs()
                bounds = np.searchsorted(text, np.arange(len(texts) + 1))
                written = list(found.written())
                columns = [
                    batch.column(0).slice(at, len(texts)), pa.array(found.n[0]), pa.array(found.n[1]), pa.array(found.n_groups.astype(np.int64)), pa.array(np.bincount(found.text_of_link, minlength=len(texts)).astype(np.int64)),
                    pa.array([hashlib.sha256(w).hexdigest() if w else "" for w in written]), pa.array([_pack(pair[p:q], n[p:q]) for p, q in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                ]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns + ([pa.array([w.decode() for w in written])] if groups else []), names=names)

    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary" + (", groups string" if groups else "")
    names = [f.split()[0] for f in schema.split(", ")]
    return plain.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, held: int = HELD) -> DataFrame:
    """``(pair, n, best)``: links of each id pair over all rows, and whether no other pair of its id of B has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every, n = np.concatenate([keys, *(w[0] for w in waiting)]), np.concatenate([sums, *(w[1] for w in waiting)])
            order = np.argsort(every, kind="stable")
            every, n = every[order], n[order]
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
            return every[first], np.add.reduceat(n, first) if len(first) else n

        hand = lambda: pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["pair", "n"])
        for batch in batches:
            for packed in batch.column(0):
                waiting.append(_unpack(packed.as_py()))
                size += len(waiting[-1][0])
                if size > held:
                    keys, sums = merged()
                    waiting, size = [], 0
                    if len(keys) > held:
                        yield hand()
                        keys, sums = keys[:0], sums[:0]
        keys, sums = merged()
        yield hand()

    counts = cut(aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.col("pair").bitwiseAND((1 << BITS) - 1)
    top = counts.groupBy(b.alias("b")).agg(F.max("n").alias("top"))  # one row an id of B: bounded by the vocabulary
    return cut(counts.withColumn("b", b).join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best")))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` per row of ``docs``.

    A reads a space and the text, B the text; special strings are plain text. ``n_links`` counts overlapping pairs of token
    occurrences, ``count_sum`` adds up the corpus-wide counts of their id pairs, and ``n_best`` counts links whose count is the
    highest of their id of B (ties included). ``groups_sha256`` is of ``a1,a2|b1;a3|b2,b3``, ids of A and B group by group.

    Null and empty texts, and texts that either vocabulary does not give back byte by byte, have no tokens: zeros and an
    empty string. Repeated rows count each, null ids like any. An empty table gives an empty result. Other columns, whatever
    their names, are ignored.
    """
    spark = docs.sparkSession
    aligned = cut(align_texts(docs, path_a, path_b, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    counts = pair_counts(aligned)
    # The most frequent pairs, as many as ``head``, are those with at least so many links (a power of two).
    level = F.length(F.bin("n"))
    sizes = sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    least, room = 65, head
    for at, n in sizes:
        room -= n
        if room < 0:
            break
        least = at
    frequent = level >= least
    table = counts.where(frequent).toArrow()
    order = np.argsort(table.column("pair").to_numpy())
    shared = spark.sparkContext.broadcast([table.column(c).to_numpy()[order] for c in ("pair", "n", "best")])

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, count, best = shared.value
        for batch in batches:
            sums, rare, rare_n = [], [], []
            for packed in batch.column(1):
                pair, n = _unpack(packed.as_py())
                at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
                hit = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
                sums.append((int(n[hit] @ best[at[hit]].astype(np.int64)) if hit.any() else 0, int(n[hit] @ count[at[hit]]) if hit.any() else 0))
                rare.append(pair[~hit].tolist())
                rare_n.append(n[~hit].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*sums, strict=True)), pa.array(rare, pa.list_(pa.int64())), pa.array(rare_n, pa.list_(pa.int64()))], names=["row", "n_best", "count_sum", "rare", "rare_n"])

    first = cut(aligned.select("row", "pairs").mapInArrow(known, "row long, n_best long, count_sum long, rare array<long>, rare_n array<long>"))
    links = first.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("z")).select("row", F.col("z.rare").alias("pair"), F.col("z.rare_n").alias("m"))
    rest = links.join(counts.where(~frequent), "pair").select("row", F.expr("if(best, m, 0L)").alias("n_best"), (F.col("m") * F.col("n")).alias("count_sum"))
    sums = first.select("row", "n_best", "count_sum").unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
