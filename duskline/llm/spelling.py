"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

A word is a vector of letter counts. One replaced letter changes two counts (squared distance 2), one inserted or deleted
letter changes one (squared distance 1); nothing else can be one edit. Squared distances come from NumPy products,
``|x|^2 + |y|^2 - 2 x.y``, block by block, and what is at most 2 is verified letter by letter.

Blocks keep the products small without losing a pair. Spark deals words by length and by how many of their letters have an
odd code: words one edit apart differ by at most one in both, so a block meets itself and three neighbours. A large block is
cut into parts, and parts meet part by part. Inside a task words are sorted by the counts of eight classes of letters; one
edit moves at most one letter from one class to another (or adds one), so a run of equal class counts meets only the runs
that are one such move away. No pair leaves a task: each word leaves with the number of its near words and the best one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskline.llm.arrow_map import bound_batches
from duskline.session import cut

#: Words of at least so many letters and occurrences take part; one in ``MISPRINT`` (document, run) pairs loses a letter.
LEAST_LENGTH, LEAST_COUNT, MISPRINT = 6, 5, 199
#: A word's form must be so many times as frequent.
RATIO = 5
#: Words of a part of a block; entries of one product; distinct words a counting task holds before it hands them on.
PART, ENTRIES, HELD = 40_000, 1 << 22, 200_000
_LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
_PLACE = np.zeros(0x100, np.int64)
_PLACE[_LETTERS] = np.arange(len(_LETTERS))
#: Letters with an odd code, which are counted for the block.
_ODD = "".join(chr(c) for c in _LETTERS if c % 2)
CLASSES = 8


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)``: words of at least ``LEAST_LENGTH`` letters that occur at least ``LEAST_COUNT`` times.

    Words are the maximal runs of ``A-Za-z`` and U+00C0 to U+00FF with A-Z lower-cased. Let h be the CRC-32 of
    ``<doc_id>:<run>``: where ``MISPRINT`` divides h, the run loses its letter at place h modulo its length. Null texts have
    no words; a null id is written as ``null``. Rows that repeat count each. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    find = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            out = [(w, n) for w, n in total.items() if n and len(w) >= LEAST_LENGTH]
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], names=["word", "n"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                runs = find(text.encode().lower().decode())  # lower() of bytes knows A-Z only
                total.update(runs)
                start = crc32(f"{'null' if i is None else i}:".encode())
                for r in [r for r in set(runs) if not crc32(r.encode(), start) % MISPRINT]:
                    n, at = runs.count(r), crc32(r.encode(), start) % len(r)
                    total[r] -= n
                    total[r[:at] + r[at + 1 :]] += n
                if len(total) > HELD:
                    yield handed()
        yield handed()

    part = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class _Side:
    """Words of one part as letter counts and codes, sorted by the counts of their letter classes."""

    def __init__(self, words: list[str], n: np.ndarray):
        size = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(len(words)), size)
        counts = np.bincount(owner * len(_LETTERS) + _PLACE[codes], minlength=len(words) * len(_LETTERS)).reshape(len(words), -1)
        # Counts of classes modulo 128, packed: words that are near stay near, and long words only meet more often.
        self.classes = np.stack([counts[:, c::CLASSES].sum(axis=1) for c in range(CLASSES)], axis=1) % 128
        key = pack(self.classes)
        order = np.argsort(key, kind="stable")
        self.words, self.n, self.key = [words[i] for i in order], n[order], key[order]
        self.length = int(size[0])
        self.counts = counts[order].astype(np.float32 if self.length <= 4000 else np.float64)  # squares are exact below 2**24
        self.norm = (self.counts * self.counts).sum(axis=1)
        self.keys, self.start = np.unique(self.key, return_index=True)
        self.stop = np.append(self.start[1:], len(words))
        self.classes = self.classes[order][self.start]
        at = np.concatenate(([0], np.cumsum(size)))[:-1][order]
        self.codes = codes[at[:, None] + np.arange(self.length)].astype(np.uint16)


def pack(classes: np.ndarray) -> np.ndarray:
    """Class counts below 128 as one integer."""
    return classes.astype(np.int64) @ (np.int64(1) << (7 * np.arange(CLASSES, dtype=np.int64)))


def moves(longer: int) -> np.ndarray:
    """What one edit can do to the class counts: nothing or one letter moved, or one letter added."""
    eye = np.eye(CLASSES, dtype=np.int64)
    if longer:
        return eye
    return np.concatenate((np.zeros((1, CLASSES), np.int64), (eye[:, None, :] - eye[None, :, :])[~np.eye(CLASSES, dtype=bool)]))


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows of letter codes differ by exactly one replaced letter, or one letter more in ``long``."""
    m = short.shape[1]
    if long.shape[1] == m:
        return (short != long).sum(axis=1) == 1
    head = np.cumprod(short == long[:, :m], axis=1).sum(axis=1)
    tail = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= m


def near_pairs(a: _Side, b: _Side) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the words of ``a`` and ``b`` that are one edit apart; ``b``'s words are as long or one letter longer."""
    longer = b.length - a.length
    delta, used = moves(longer), (a.counts.any(axis=0) | b.counts.any(axis=0))
    x, y = a.counts[:, used], b.counts[:, used]
    out = [(np.zeros(0, np.int64),) * 2]
    checked = max(1, ENTRIES // b.length)
    for first in range(0, len(a.keys), 1024):
        wanted = pack(((a.classes[first : first + 1024, None, :] + delta) % 128).reshape(-1, CLASSES)).reshape(-1, len(delta))
        hit = np.minimum(np.searchsorted(b.keys, wanted), len(b.keys) - 1)
        for r, h in enumerate(np.where(b.keys[hit] == wanted, hit, -1), first):
            cols = np.concatenate([np.arange(b.start[t], b.stop[t]) for t in h if t >= 0] or [np.zeros(0, np.int64)])
            for u in range(0, len(cols), 1 << 14):
                some = cols[u : u + (1 << 14)]
                step = max(1, ENTRIES // len(some))
                for s in range(a.start[r], a.stop[r], step):
                    e = min(s + step, a.stop[r])
                    distance = a.norm[s:e, None] + b.norm[None, some] - 2 * (x[s:e] @ y[some].T)
                    i, j = np.nonzero(distance == (1 if longer else 2))
                    i, j = i + s, some[j]
                    for v in range(0, len(i), checked):
                        p, q = i[v : v + checked], j[v : v + checked]
                        sure = one_edit(a.codes[p], b.codes[q])
                        out.append((p[sure], q[sure]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _near_in_part(group: pd.DataFrame) -> pd.DataFrame:
    """``(word, n_near, best_n, best)`` of the words that have near words in this meeting of two parts."""
    sides = [group[group.side == s] for s in (0, 1)]
    same = bool(group.same.iat[0])
    if not len(sides[0]) or not (same or len(sides[1])):
        return pd.DataFrame({"word": group.word[:0], "n_near": group.n[:0], "best_n": group.n[:0], "best": group.word[:0]})
    a = _Side(sides[0].word.tolist(), sides[0].n.to_numpy())
    b = a if same else _Side(sides[1].word.tolist(), sides[1].n.to_numpy())
    i, j = near_pairs(a, b)
    if not same:
        j = j + len(a.words)
        words, n = np.array(a.words + b.words, object), np.concatenate((a.n, b.n))
        i, j = np.concatenate((i, j)), np.concatenate((j, i))
    else:  # each pair was met from both of its ends
        words, n = np.array(a.words, object), a.n
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(words, kind="stable")] = np.arange(len(words))
    order = np.lexsort((rank[j], -n[j], i))
    i, j = i[order], j[order]
    who, first, many = np.unique(i, return_index=True, return_counts=True)
    return pd.DataFrame({"word": words[who], "n_near": many, "best_n": n[j[first]], "best": words[j[first]]})


def near_words(words: DataFrame, part: int = PART) -> DataFrame:
    """``(word, n_near, best_n, best)`` of the words of ``(word, n)`` that have near ones; ``best`` is the near word of largest
    n, of equal ones the smallest in code-point order."""
    odd = F.length("word") - F.length(F.translate("word", _ODD, ""))
    dealt = cut(words.select("word", "n", F.length("word").alias("len"), odd.alias("odd")))
    blocks = cut(dealt.groupBy("len", "odd").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")))
    # A block meets itself, its neighbour with one odd letter more, and the two with one letter more.
    ahead = F.explode(F.array(*[F.struct((F.col("len") + d).alias("len2"), (F.col("odd") + o).alias("odd2")) for d, o in ((0, 0), (0, 1), (1, 0), (1, 1))]))
    meets = blocks.withColumn("to", ahead).select("len", "odd", "parts", "to.*").join(blocks.select(F.col("len").alias("len2"), F.col("odd").alias("odd2"), F.col("parts").alias("parts2")), ["len2", "odd2"])
    meets = cut(meets.withColumn("kind", (F.col("len2") - F.col("len")) * 2 + F.col("odd2") - F.col("odd")))
    own = lambda n: F.pmod(F.xxhash64("word"), F.col(n).cast("long")).cast("int")
    key = ["len", "odd", "kind", "i", "j"]
    left = dealt.join(meets, ["len", "odd"]).withColumn("i", own("parts"))
    left = left.withColumn("j", F.explode(F.expr("sequence(if(kind = 0, i, 0), parts2 - 1)"))).select(*key, F.lit(0).alias("side"), (F.expr("kind = 0 and i = j")).alias("same"), "word", "n")
    right = dealt.withColumnsRenamed({"len": "len2", "odd": "odd2"}).join(meets, ["len2", "odd2"]).withColumn("j", own("parts2"))
    right = right.withColumn("i", F.explode(F.expr("case when kind <> 0 then sequence(0, parts - 1) when j > 0 then sequence(0, j - 1) end"))).select(*key, F.lit(1).alias("side"), F.lit(False).alias("same"), "word", "n")
    found = left.unionByName(right).groupBy(*key).applyInPandas(_near_in_part, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def group_variants(words: DataFrame, part: int = PART) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` per row of ``words`` (distinct ``word`` of at least ``LEAST_LENGTH`` letters, ``n``).

    Two words are near if one inserted, deleted or replaced letter turns one into the other. A word's form is its near word
    of largest n (ties: smallest in code-point order) if that n is at least ``RATIO`` times its own, else null. The root is
    the last form of forms, or the word itself. Forms are more frequent each time, so they make no circles. An empty table
    gives an empty result; columns other than the two are ignored.
    """
    words = cut(words.select("word", "n"))
    forms = words.join(near_words(words, part), "word", "left")
    good = F.col("best_n") >= RATIO * F.col("n")
    forms = cut(forms.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")))
    # Pointers are doubled until none leads on.
    step = cut(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = cut(step.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        step = further.select("word", "root")
        if further.where("moved").isEmpty():
            break
    return forms.join(step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
