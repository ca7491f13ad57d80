"""Document fingerprints by randomised edit embedding, their likeness, and banding with verification.

The embedding (Chakraborty, Goldenberg, Koucky 2016) walks over a text by shared random bits: at step j the current
character is written and, if the bit of (j, character) is 1, the walk moves on to the next character. Texts a few edits
apart soon walk in step again, so their embeddings differ in few places: edit distance becomes Hamming distance. The
bits repeat with period ``PERIOD``, so a character's stay is one table look-up.

A fingerprint samples ``SLOTS`` places of the embedding and keeps four bits of a hash of the character written there.
Slot k looks at the last of its record places r0 < r1 < ... (shared, growing geometrically) that the embedding reaches.
Two embeddings of lengths m <= n choose the same place with probability m/n, so texts of any and of different length
are comparable, and a longer text needs no longer fingerprint. Likeness is the share of equal slots, corrected for the
equality that chance gives.
"""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from duskline.llm.arrow_map import append_columns, bound_batches, spare_name
from duskline.operators.components import connected_components
from duskline.session import cut, let_go

PERIOD, SLOTS = 4096, 128
#: Share of slots that agree by chance between unlike texts: frequent characters and four-bit hashes.
CHANCE = 0.12
#: The same between texts of one language, as banding has to expect it.
STRANGE = 0.2
#: Members above which a bucket is compared in blocks, and the members of a block.
SMALL_BUCKET, BLOCK = 24, 512
#: Likeness from which documents are near.
LEAST = 0.8
#: Bands whose buckets are formed in one pass, which bounds the disk of their shuffle.
BANDS_AT_ONCE = 12


class EditEmbedding:
    """The shared random bits as tables; the same in every process."""

    def __init__(self, seed: int = 11):
        rng = random.Random(seed)
        places = list(range(PERIOD))
        self.next: list[list[int]] = []
        for _ in range(256):
            bits = rng.getrandbits(PERIOD) | 1 << rng.randrange(PERIOD)
            after, then = [0] * PERIOD, None
            for at in range(2 * PERIOD - 1, -1, -1):  # the place after the next 1 bit, cyclic
                if bits >> at % PERIOD & 1:
                    then = places[(at + 1) % PERIOD]
                if at < PERIOD:
                    after[at] = then
            self.next.append(after)
        self.records = np.full((SLOTS, 64), np.iinfo(np.int64).max)
        for k in range(SLOTS):
            at = 0
            for i in range(64):
                self.records[k, i] = at
                at = int(at / (1 - rng.random())) + 1 if at else 1
                if at > 1 << 50:
                    break
        self.nibble = np.array([rng.randrange(16) for _ in range(256)], np.uint8)

    def walk(self, codes: bytes, start: int = 0) -> list[int]:
        """The place, modulo ``PERIOD``, after each character."""
        table, at = self.next, start
        return [at := table[c][at] for c in codes]

    def sample(self, codes: np.ndarray, places: np.ndarray) -> str:
        """The fingerprint of the text with these character codes and walk, as hex digits; of no text: zeros."""
        if not len(codes):
            return "0" * SLOTS
        stay = np.diff(places, prepend=0) % PERIOD
        stay[stay == 0] = PERIOD
        end = np.cumsum(stay)
        reached = (self.records < end[-1]).sum(1) - 1
        place = self.records[np.arange(SLOTS), reached]
        here = codes[np.searchsorted(end, place, "right")]
        slot = np.arange(SLOTS) * 37
        return "".join("0123456789abcdef"[v] for v in self.nibble[(here + slot) & 255])


_EMBEDDING: list[EditEmbedding] = []


def embedding() -> EditEmbedding:
    if not _EMBEDDING:
        _EMBEDDING.append(EditEmbedding())
    return _EMBEDDING[0]


def _codes(text: str) -> np.ndarray:
    """Code points folded to a byte."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((points ^ points >> 8 ^ points >> 16) & 255).astype(np.uint8)


def fingerprint(text: str) -> str:
    """The fingerprint of one text."""
    return _walked(text)[2]


def likeness(a: str, b: str) -> float:
    """Likeness 0 to 1 of two fingerprints; 1 if equal."""
    same = sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
    return max(0.0, (same - CHANCE) / (1 - CHANCE))


def add_fingerprints(docs: DataFrame, text_col: str = "text", without: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``fingerprint`` of every whole text; a null text counts as empty. Extra columns stay; one named like the
    new one is replaced."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        return [pa.array([fingerprint(t or "") for t in texts], pa.string())]

    return append_columns(docs, [T.StructField("fingerprint", T.StringType())], compute, without)


def banding(classes: int, least: float, miss: float = 0.01) -> tuple[int, int]:
    """``(bands, width)``: a width at which a text shares a band with a fifth of a stranger at most, however many ``classes``
    there are, and the bands with which a pair of likeness ``least`` shares none with probability ``miss`` (its slots agree
    with ``CHANCE + (1 - CHANCE) * least``)."""
    width = min(16, max(6, math.ceil(math.log(5 * max(classes, 1)) / -math.log(STRANGE))))
    agree = CHANCE + (1 - CHANCE) * least
    return max(1, math.ceil(math.log(miss) / math.log1p(-min(agree**width, 1 - 1e-9)))), width


def _unlike(a: str, b: str) -> Column:
    """Number of unequal slots of the packed fingerprints ``a`` and ``b`` (arrays of longs, 16 slots each)."""
    total = F.lit(0)
    for i in range(SLOTS // 16):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        total = total + F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def _block_links(group: pd.DataFrame, most: int) -> pd.DataFrame:
    """Links of one block of minority members (side 0) with one block of all members (side 1) of a bucket; of the pairs
    with at most ``most`` unequal slots those that join two components not joined by an earlier pair."""
    rows = [group[group.side == side].reset_index(drop=True) for side in (0, 1)]
    slots = [np.array(r.print.tolist(), np.int64).reshape(len(r), -1).view(np.uint8) for r in rows]
    slots = [np.concatenate((s & 15, s >> 4), 1) for s in slots]
    comp = [r["comp"].to_numpy() for r in rows]
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out = []
    for i in range(len(rows[0])):
        unlike = (slots[0][i] != slots[1]).sum(1)
        for j in np.flatnonzero((unlike <= most) & (comp[0][i] != comp[1])):
            x, y = root(comp[0][i]), root(comp[1][j])
            if x != y:
                parent[x] = y
                out.append((rows[0].node.iat[i], rows[1].node.iat[j], unlike[j]))
    return pd.DataFrame(out, columns=["a", "b", "unlike"]).astype({"a": group.node.dtype, "b": group.node.dtype, "unlike": "int32"})


def candidate_pairs(docs: DataFrame, id_col: str = "doc_id", bands: int | None = None, width: int | None = None, least: float = LEAST, seed: int = 5) -> DataFrame:
    """``(doc_id, center_id, near)``: links, verified by likeness, that join every two documents which share a band.

    Bands are ``bands`` sets of ``width`` sampled slots of ``fingerprint``; if not given, ``banding`` chooses them for
    ``least``. Documents of equal fingerprint form a class, linked to its smallest id. In each bucket every class is
    compared with one pivot; where that leaves more than one component, the members outside the largest are compared
    with all members, in large buckets block by block in bounded groups. No bucket is capped, and the links of a group
    are about as many as members, not their square: their components are those of all like pairs that share a band.
    Rows without id: none; rows that repeat an id count as one document. An empty table gives an empty result. Other
    columns are ignored. ``docs`` is read several times and should be materialised.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), "fingerprint")
    words = F.array(*[F.conv(F.substring("fingerprint", 16 * i + 1, 16), 16, -10).cast("long") for i in range(SLOTS // 16)])
    classes = cut(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("node")).select("fingerprint", "node", words.alias("print")))
    if bands is None or width is None:
        bands, width = banding(classes.count(), least)
    rng = random.Random(seed)
    picks = [rng.sample(range(SLOTS), width) for _ in range(bands)]
    masks = [[sum(15 << 4 * (15 - p % 16) for p in pick if p // 16 == i) for i in range(SLOTS // 16)] for pick in picks]
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
    keys = [F.xxhash64(F.lit(n), *[F.get("print", F.lit(i)).bitwiseAND(signed(m)) for i, m in enumerate(mask) if m]) for n, mask in enumerate(masks)]
    most = math.floor(SLOTS * (1 - CHANCE) * (1 - least) + 1e-9)
    near = F.greatest(F.lit(0.0), (1 - F.col("unlike") / SLOTS - CHANCE) / (1 - CHANCE)).alias("near")

    # Classes are numbered by their prints' hash, so that rows of buckets are two numbers.
    numbered = lambda *more: classes.select(F.xxhash64("print").alias("class"), *more)
    parts = []
    for at in range(0, bands, BANDS_AT_ONCE):
        named = numbered(F.explode(F.array(*keys[at : at + BANDS_AT_ONCE])).alias("bucket"))
        shared = named.groupBy("bucket").agg(F.count("*").cast("int").alias("members"), F.min("class").alias("pivot")).where("members > 1")
        parts.append(cut(named.join(shared, "bucket")))
        del named, shared
        let_go(docs.sparkSession)
    members = reduce(DataFrame.unionAll, parts)
    prints = numbered("node", "print")
    of = lambda s: prints.select(F.col("class").alias(s), F.col("print").alias(f"p{s}"))
    alike = lambda pairs: pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", _unlike("pa", "pb").alias("unlike")).where(F.col("unlike") <= most)
    star = cut(alike(members.where("class <> pivot").select(F.col("class").alias("a"), F.col("pivot").alias("b")).distinct()))

    let_go(docs.sparkSession)
    joined = cut(connected_components(star, "a", "b"))
    let_go(docs.sparkSession)
    # Two members were compared as member and pivot.
    placed = members.where("members > 2").join(joined.select(F.col("node").alias("class"), F.col("component").alias("comp")), "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    per = placed.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
    split = per.groupBy("bucket").agg(F.max(F.struct("c", "comp")).getField("comp").alias("major"), F.count("*").alias("comps"), (F.sum("c") - F.max("c")).alias("minors"))
    rest = cut(placed.join(split.where("comps > 1"), "bucket").withColumn("minor", F.expr("comp <> major")))
    let_go(docs.sparkSession)
    small = rest.where(F.col("members") <= SMALL_BUCKET)
    side = lambda df, s: df.select("bucket", F.col("class").alias(s), F.col("comp").alias(f"c{s}"), F.col("minor").alias(f"m{s}"), "pivot")
    pairs = side(small.where("minor"), "a").join(side(small, "b").drop("pivot"), "bucket").where("ca <> cb and (not mb or a < b) and a <> pivot and b <> pivot")
    more = alike(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    large = rest.where(F.col("members") > SMALL_BUCKET)
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = lambda n: F.pmod(F.xxhash64("class"), blocks(n).cast("long")).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    dealt = large.where("minor").select("bucket", "class", "comp", F.lit(0).alias("side"), own("minors").alias("i"), all_of("members").alias("j"))
    dealt = dealt.unionByName(large.select("bucket", "class", "comp", F.lit(1).alias("side"), all_of("minors").alias("i"), own("members").alias("j")))
    dealt = dealt.join(prints.drop("node"), "class").withColumnRenamed("class", "node")
    blocked = dealt.groupBy("bucket", "i", "j").applyInPandas(lambda g: _block_links(g, most), star.schema)

    ids = lambda s: prints.select(F.col("class").alias(s), F.col("node").alias(f"n{s}"))
    links = star.unionByName(more).unionByName(blocked).join(ids("a"), "a").join(ids("b"), "b").where("na <> nb")
    links = links.select(F.greatest("na", "nb").alias("doc_id"), F.least("na", "nb").alias("center_id"), near)
    copies = rows.join(classes.select("fingerprint", F.col("node").alias("center_id")), "fingerprint").where("doc_id <> center_id").select("doc_id", "center_id", F.lit(1.0).alias("near"))
    return links.unionByName(copies).groupBy("doc_id", "center_id").agg(F.max("near").alias("near"))


def add_near_groups(prints: DataFrame, least: float = LEAST) -> DataFrame:
    """``prints`` (doc_id, fingerprint, ...) with ``near_group``: the smallest id of the documents joined to it by
    ``candidate_pairs``, its own if there are none, null without id. Each row stays; rows that repeat an id have one group, and
    of rows with equal fingerprints the smallest id is the group. An empty table gives an empty result. A column named
    ``near_group`` is replaced, other columns stay whatever their names. ``prints`` should be materialised."""
    let_go(prints.sparkSession)  # what the fingerprints were made with
    kept = [c for c in prints.columns if c.lower() != "near_group"]
    joined, component = spare_name(prints, "_node"), spare_name(prints, "_component")
    groups = connected_components(candidate_pairs(prints.select("doc_id", "fingerprint"), least=least), "doc_id", "center_id")
    groups = groups.select(F.col("node").alias(joined), F.col("component").alias(component))
    return prints.join(groups, F.col("doc_id") == F.col(joined), "left").select(*kept, F.coalesce(component, "doc_id").alias("near_group"))


def _edit(text: str, codes: np.ndarray, walk: np.ndarray, then: str) -> tuple[str, str]:
    """Digest and fingerprint of ``text`` (character codes and walk given) with its last quarter replaced by the first
    characters of ``then``."""
    tables = embedding()
    keep = len(text) - len(text) // 4
    tail = then[: len(text) // 4]
    more = _codes(tail)
    places = np.concatenate((walk[:keep], np.array(tables.walk(more.tobytes(), int(walk[keep - 1]) if keep else 0), np.int64)))
    digest = hashlib.sha256((text[:keep] + tail).encode("utf-8", "surrogatepass")).hexdigest()
    return digest, tables.sample(np.concatenate((codes[:keep], more)), places)


def _walked(text: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Character codes, walk and fingerprint of a text."""
    codes = _codes(text)
    walk = np.array(embedding().walk(codes.tobytes()), np.int64)
    return codes, walk, embedding().sample(codes, walk)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text: the last floor(n_chars / 4) code points replaced by the first as
    many (or all) of the next document by id (after the last: the first).

    Columns: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``, materialised in
    the checkpoint folder. Null texts count as empty. Rows of equal id follow each other in the order of a hash of their
    texts; null ids come first. A table of one row has itself as next document. An empty table gives an empty result.

    Texts are shuffled once, compressed each, into ranges of ids as many as the session has shuffle partitions, and streamed
    through in order. What meets at the ends of two ranges, one text of each, is set aside and joined afterwards; of that the driver
    holds the numbers of the ranges only.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([zlib.compress(t.encode(), 1) for t in batch.column(2).to_pylist()], pa.binary())], names=["doc_id", "tie", "packed"])

    packed = docs.select("doc_id", "tie", "text").mapInArrow(pack, T.StructType([docs.schema["doc_id"], T.StructField("tie", T.LongType()), T.StructField("packed", T.BinaryType())]))
    spread = packed.repartitionByRange(ranges, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "packed")
    done = [docs.schema["doc_id"], T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]
    #: A range's first and last text; null in all other rows.
    ends = [T.StructField("range", T.IntegerType()), T.StructField("first", T.BooleanType()), T.StructField("text", T.StringType())]
    schema = T.StructType(done + ends)
    plain = to_arrow_schema(T.StructType(done))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, arrow = TaskContext.get().partitionId(), to_arrow_schema(schema)
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
        last = None  # the row that waits for its next one
        for batch in batches:
            rows = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = zlib.decompress(raw).decode()
                codes, walk, own = _walked(text)
                if last is None:
                    rows.append((doc_id, None, None, own, None, None, None, part, True, text))
                else:
                    digest, edited = _edit(*last[1:4], text)
                    rows.append((last[0], len(last[1]), digest, last[4], edited, likeness(last[4], edited), likeness(last[4], own), None, None, None))
                last = (doc_id, text, codes, walk, own)
            if rows:
                yield give(rows)
        if last is not None:
            yield give([(last[0], None, None, last[4], None, None, None, part, False, last[1])])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, own, then, then_own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest, edited = _edit(text, *_walked(text)[:2], then)
                rows.append((doc_id, len(text), digest, own, edited, likeness(own, edited), likeness(own, then_own)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), plain, strict=True)], schema=plain)

    walked = cut(spread.mapInArrow(run, schema))
    first = walked.where("first")
    held = sorted(r.range for r in first.select("range").collect())
    order = spark.createDataFrame(list(zip(held, held[1:] + held[:1], strict=True)), "range int, then_range int")
    then = first.select(F.col("range").alias("then_range"), F.col("text").alias("then"), F.col("fingerprint").alias("then_own"))
    met = walked.where("not first").join(order, "range").join(then, "then_range").select("doc_id", "text", "fingerprint", "then", "then_own")
    return walked.where("range is null").select(*[f.name for f in done]).unionByName(cut(met.mapInArrow(close, T.StructType(done))))
