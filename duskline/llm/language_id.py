"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of order 3: for every context of up to three bytes, how often each byte followed it in
that language's training texts. A byte is coded with the longest context seen; where the byte never followed, an escape
is coded (method C: q / (n + q), with n bytes seen in the context, q of them distinct) and the next shorter context is
tried, down to a uniform code over 256 bytes. The statistics are frozen after training, so the code length of a byte
depends on the four bytes ending in it only. Code lengths are multiples of 2**-18 bits: their sums are exact in any order,
so a text's score does not depend on the texts around it.

The fit takes a bounded hash sample of whole labelled texts (``TRAIN_DOCS`` documents a language, none longer than
``TRAIN_BYTES``, or the shortest text of a language that has only longer ones) and keeps every context seen in it. Only what a language has seen takes room: some 30 bytes for each
distinct four-byte string of the sample and some 6 for each language that has it. Scoring covers all bytes of all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskline.llm.arrow_map import append_columns, byte_slices, hashed_sample, spare_name
from duskline.session import cut

#: Bound of the fit: documents of each language, about, and the bytes of the longest one. Of a language whose texts are all
#: longer, the shortest text is learnt from.
TRAIN_DOCS, TRAIN_BYTES = 400, 1 << 18
ORDER = 3


def _grams(labelled: DataFrame) -> DataFrame:
    """``(lang, gram, n)``: the four-byte windows of the texts; bytes before a text's start count as 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                texts = batch.column(1).filter(pa.array(langs == lang))
                for _, _, data, offsets in byte_slices(texts):
                    if not len(data):
                        continue
                    gram, n = np.unique(_windows(data.astype(np.uint32), offsets, 8), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counted = labelled.select(F.col("lang").cast("string"), F.col("text")).mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _windows(symbols: np.ndarray, offsets: np.ndarray, bits: int) -> np.ndarray:
    """For each position the symbol and the three before it in the same text, packed with ``bits`` bits each."""
    out = symbols.copy()
    for back in range(1, ORDER + 1):
        out[back:] |= symbols[:-back] << np.uint32(bits * back)
    for at in range(ORDER):  # the first symbols of a text see nothing of the text before
        here = (offsets[:-1] + at)[np.diff(offsets) > at]
        out[here] &= np.uint32((1 << bits * (at + 1)) - 1)
    return out


class SparseCosts:
    """Code lengths of (key, language) pairs, of those that occur only.

    Keys are found by an open-addressing hash table. A key has one bit for each language, and the costs of the languages
    that have it one after the other.
    """

    def __init__(self, keys: np.ndarray, lang: np.ndarray, cost: np.ndarray, langs: int):
        order = np.lexsort((lang, keys))
        keys, lang = keys[order], lang[order]
        self.cost = np.append(np.rint(cost[order] * 2**18) / 2**18, 0).astype(np.float32)
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        self.keys = keys[new].astype(np.uint32)
        row = np.cumsum(new) - 1
        self.bits = np.zeros((-(-langs // 64), len(self.keys)), np.uint64)
        np.bitwise_or.at(self.bits, (lang >> 6, row), np.uint64(1) << (lang & 63).astype(np.uint64))
        held = np.bitwise_count(self.bits).astype(np.int32)
        self.start = (np.flatnonzero(new) + np.cumsum(held, axis=0) - held).astype(np.int32)
        self.power = max(4, (2 * len(self.keys)).bit_length())
        self.slots = np.full(1 << self.power, -1, np.int32)
        todo, at = np.arange(len(self.keys), dtype=np.int32), self._home(self.keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            left = self.slots[at] != todo
            todo, at = todo[left], self._next(at[left])

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.power)).astype(np.int64)

    def _next(self, at: np.ndarray) -> np.ndarray:
        return (at + 1) & ((1 << self.power) - 1)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 for those that no language has."""
        at = self._home(keys)
        out = self.slots[at]
        todo = np.flatnonzero((self.keys[out] != keys) & (out >= 0))
        while len(todo):
            at[todo] = self._next(at[todo])
            out[todo] = self.slots[at[todo]]
            todo = todo[(self.keys[out[todo]] != keys[todo]) & (out[todo] >= 0)]
        return out

    def of(self, rows: np.ndarray, lang: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether the language has the key of each row, and its cost there."""
        word, bit = divmod(lang, 64)
        held = self.bits[word][rows]
        below = np.bitwise_count(held & np.uint64((1 << bit) - 1))
        return ((held >> np.uint64(bit)) & np.uint64(1)).astype(bool) & (rows >= 0), self.cost[self.start[word][rows] + below]

    def size(self) -> int:
        """Bytes in memory."""
        return sum(x.nbytes for x in (self.cost, self.keys, self.bits, self.start, self.slots))


class ByteContexts:
    """Frozen statistics of all languages: of each order the direct code lengths and those of the escapes."""

    def __init__(self, lang: np.ndarray, grams: np.ndarray, n: np.ndarray):
        names, lang = np.unique(lang.astype(str), return_inverse=True)
        self.langs = names.tolist()
        self.direct, self.escape = [], []
        for order in range(ORDER + 1):
            pair, at = np.unique(lang.astype(np.int64) << 32 | grams & _mask(order), return_inverse=True)
            count = np.bincount(at, n)
            context, at = np.unique(pair >> 8, return_inverse=True)  # the language's number moves along
            total, distinct = np.bincount(at, count), np.bincount(at)
            both = (total + distinct)[at]
            self.direct.append(SparseCosts(pair & 0xFFFFFFFF, pair >> 32, -np.log2(count / both), len(names)))
            self.escape.append(SparseCosts(context & 0xFFFFFF, context >> 24, -np.log2(distinct / (total + distinct)), len(names)))

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each four-byte string under each language: ``[languages, strings]``."""
        out = np.zeros((len(self.langs), len(keys)))
        at, open_ = np.arange(len(keys)), np.ones(out.shape, bool)  # strings whose byte a language has still to code
        for order in range(ORDER, -1, -1):
            keys = keys & np.uint32(_mask(order))
            rows = self.direct[order].rows(keys)
            for x in range(len(self.langs)):
                has, cost = self.direct[order].of(rows, x)
                here = has & open_[x]
                out[x, at[here]] += cost[here]
                open_[x] &= ~has
            some = open_.any(0)
            keys, at, open_ = keys[some], at[some], open_[:, some]
            rows = self.escape[order].rows(keys >> np.uint32(8))
            for x in range(len(self.langs)):
                has, cost = self.escape[order].of(rows, x)
                here = has & open_[x]
                out[x, at[here]] += cost[here]
        for x in range(len(self.langs)):
            out[x, at[open_[x]]] += 8
        return out

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text under each language, in bits: ``[texts, languages]``. Each distinct string is costed once."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        full = np.flatnonzero(np.diff(offsets) > 0)
        if not len(full):
            return out
        windows = _windows(data.astype(np.uint32), offsets, 8)
        rows = self.direct[ORDER].rows(windows)
        known = rows >= 0
        seen = np.zeros(len(self.direct[ORDER].keys), bool)
        seen[rows[known]] = True
        number = np.cumsum(seen, dtype=np.int32) - 1
        at = number[rows]
        at[~known] = np.arange(np.count_nonzero(~known)) + np.count_nonzero(seen)
        table = self.costs(np.concatenate((self.direct[ORDER].keys[seen], windows[~known])))
        for x in range(len(self.langs)):
            out[full, x] = np.add.reduceat(table[x][at], offsets[full])
        return out

    def size(self) -> int:
        """Bytes in memory."""
        return sum(t.size() for t in (*self.direct, *self.escape))


def _mask(order: int) -> int:
    return (1 << 8 * (order + 1)) - 1


def fit(labelled: DataFrame, docs_per_lang: int = TRAIN_DOCS, longest: int = TRAIN_BYTES) -> ByteContexts | None:
    """Fit on the non-null ``lang`` of ``(doc_id, text, lang)``; None if there is no labelled text. Rows that repeat an id or
    a text are learnt from each; other columns are ignored."""
    usable = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null and doc_id is not null")
    size = F.octet_length("text")
    sample = hashed_sample(usable.where(size <= longest), "lang", docs_per_lang)
    shortest = usable.groupBy("lang").agg(F.min(F.struct(size.alias("size"), "doc_id")).alias("s")).where(F.col("s.size") > longest)
    shortest = cut(shortest.select("lang", "s.doc_id", F.col("s.size").alias("size")))
    if not shortest.isEmpty():
        sample = sample.unionByName(usable.withColumn("size", size).join(shortest, ["lang", "doc_id", "size"]).select("doc_id", "text", "lang"))
    counts = _grams(sample).toArrow()  # bounded by the sample
    if not counts.num_rows:
        return None
    return ByteContexts(counts["lang"].to_numpy(), counts["gram"].to_numpy(), counts["n"].to_numpy())


def identify(docs: DataFrame, model: ByteContexts | None, text_col: str = "text", without: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``bits_per_byte``.

    ``lang_pred`` is the language of least code length (ties: the first by name), ``score`` its share of probability
    with all languages equally likely before. Null texts and texts without a letter: ``und``, score 0. Very short texts
    get what their bytes give. Without a model every text is ``und``. Repeated rows are judged each, equal texts alike. An
    empty table gives an empty result. Extra columns stay; ones named like the three new columns are replaced.
    """
    letter = spare_name(docs, "_has_letter")
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        model = shared.value
        texts, letters = batch.column(batch.schema.get_field_index(text_col)), batch.column(batch.schema.get_field_index(letter)).to_numpy(False)
        lang, score, rate = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts))
        for first, last, data, offsets in byte_slices(texts) if model else ():
            bits = model.bits(data, offsets)
            best = bits.argmin(1)
            least = bits.min(1)
            ok = letters[first:last].astype(bool)
            lang[first:last] = np.where(ok, np.array(model.langs, object)[best], "und")
            score[first:last] = np.where(ok, 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1), 0)
            rate[first:last] = np.where(ok, least / np.maximum(np.diff(offsets), 1), 0)
        return [pa.array(lang, pa.string()), pa.array(score), pa.array(rate)]

    marked = docs.withColumn(letter, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    return append_columns(marked, fields, compute, (letter, *without))


def held_out(id_col: str, parts: int, part: int):
    """Whether crc32 of the id as text leaves ``part`` modulo ``parts``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(parts)) == part, F.lit(False))
