"""Near-duplicate groups by SuperMinHash signatures, banding, exact verification and union of the verified links.

A document's set is its distinct k-word shingles. Documents with equal sets form one class and are compared once. Each
class gets a SuperMinHash signature (Ertl 2017: the ranks an element gives the slots are one random permutation, so a
slot's values are negatively correlated; elements stop early once no slot can improve). Signatures are cut into bands;
classes that share a band are candidates. Candidate pairs are confirmed on the full sets:

1. In each bucket every member is compared with one pivot, the member with most bucket company. In a large group this
   joins most members with as many comparisons as members.
2. Buckets that still hold more than one component are compared completely, without the pairs already joined. Small
   buckets do so as pairs; large ones block against block inside bounded groups, which emit only links that join
   something. No bucket is capped and no link between different components is lost.

The components of the links are found by contraction (``duskline.operators.components``).

At similarity exactly 0.8, 24 bands of 4 rows miss a pair with probability (1 - 0.8**4)**24 = 3e-6, less above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskline.llm.arrow_map import bound_batches, byte_slices, filter_by_ids
from duskline.llm.hashing import mix, shingle_sets
from duskline.operators.components import connected_components
from duskline.session import cut

#: Members above which a bucket is compared in blocks, and the members of a block.
SMALL_BUCKET, BLOCK = 24, 512
_UNSET = np.uint32(0xFFFFFFFF)


def superminhash(elements: np.ndarray, doc: np.ndarray, n_docs: int, slots: int) -> np.ndarray:
    """Signatures ``[n_docs, slots]``: step number above, 25 random bits below; documents without elements stay unset.

    Step j gives each live element one random number and one new slot of its own permutation. A document drops out as
    soon as its largest value has a lower step than the next one: the permutations are held of documents of few elements
    only, as some ten times ``slots`` elements fill all slots in the first step.
    """
    signature = np.full(n_docs * slots, _UNSET, np.uint32)
    order = None
    for j in range(slots):
        if not len(elements):
            break
        drawn = mix(elements + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        swap = j + (((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        value = (drawn >> np.uint64(39)).astype(np.uint32) | np.uint32(j << 25)
        if order is None:
            slot = swap
        else:
            row = np.arange(len(elements))
            slot = order[row, swap]
            order[row, swap] = order[:, j]
        np.minimum.at(signature, doc * slots + slot, value)
        live = (signature.reshape(n_docs, slots).max(axis=1) >> np.uint32(25)) > j
        keep = live[doc]
        if order is None:
            elements, doc, swap = elements[keep], doc[keep], swap[keep]
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(elements), 1))
            order[np.arange(len(elements)), swap] = 0
        elif not keep.all():
            elements, doc, order = elements[keep], doc[keep], order[keep]
    return signature.reshape(n_docs, slots)


def _sketch(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    slots = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in byte_slices(batch.column(1)):
                n_docs = last - first
                elements, doc = shingle_sets(data, offsets, k)
                size = np.bincount(doc, minlength=n_docs)
                some = size > 0
                starts = (np.cumsum(size) - size)[some]
                s1, s2 = np.zeros(n_docs, np.uint64), np.zeros(n_docs, np.uint64)
                if len(elements):
                    s1[some] = np.add.reduceat(mix(elements), starts)
                    s2[some] = np.add.reduceat(mix(elements ^ np.uint64(0x5851F42D4C957F2D)), starts)
                signature = superminhash(elements, doc, n_docs, slots).reshape(n_docs, bands, rows)
                key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n_docs, bands)).copy()
                for i in range(rows):
                    key = mix(key * np.uint64(0xD1342543DE82EF95) + signature[:, :, i])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n_docs + 1, dtype=np.int32) * bands), pa.array(key.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n_docs), pa.array(size.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), lists],
                    names=["doc_id", "n", "s1", "s2", "bands"],
                )

    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n", "s1", "s2")), T.StructField("bands", T.ArrayType(T.LongType()))]))


def _full_sets(docs: DataFrame, k: int) -> DataFrame:
    """``(node, elements)``: the sorted shingle hashes of each document as packed 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in byte_slices(batch.column(1)):
                elements, doc = shingle_sets(data, offsets, k)
                cuts = np.searchsorted(doc, np.arange(last - first + 1))
                packed = [elements[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(packed, pa.binary())], names=["node", "elements"])

    return docs.mapInArrow(run, T.StructType([T.StructField("node", docs.schema["doc_id"].dataType), T.StructField("elements", T.BinaryType())]))


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` with den * intersection >= num * union of their full sets."""
    left, right = sets.select(F.col("node").alias("a"), F.col("elements").alias("ea")), sets.select(F.col("node").alias("b"), F.col("elements").alias("eb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ea", "eb")
    return joined.mapInArrow(run, joined.select("a", "b").schema)


def _block_links(group: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Links of one block of minority members (side 0) with one block of all members (side 1) of a bucket.

    Shared elements are counted as a matrix product over the elements both blocks have, in bounded column chunks. Of
    the confirmed pairs only those that join two components not joined by an earlier pair are emitted.
    """
    rows = [group[group.side == side].drop_duplicates("node") for side in (0, 1)]
    if not len(rows[0]) or not len(rows[1]):
        return pd.DataFrame({"a": group.node[:0], "b": group.node[:0]})
    sets = [[np.frombuffer(e, np.uint64) for e in r.elements] for r in rows]
    flat = [np.concatenate(s) for s in sets]
    shared = np.intersect1d(flat[0], flat[1])
    common = np.zeros((len(sets[0]), len(sets[1])), np.float64)
    for at in range(0, len(shared), 4096):
        part = shared[at : at + 4096]
        member = []
        for s, f in zip(sets, flat, strict=True):
            where = np.minimum(np.searchsorted(part, f), len(part) - 1)
            hit = part[where] == f
            m = np.zeros((len(s), len(part)), np.float32)
            m[np.repeat(np.arange(len(s)), [len(e) for e in s])[hit], where[hit]] = 1
            member.append(m)
        common += member[0] @ member[1].T
    sizes = [np.array([len(e) for e in s], float) for s in sets]
    linked = den * common >= num * (sizes[0][:, None] + sizes[1][None, :] - common)
    comp = [r.comp.to_numpy() for r in rows]
    linked &= comp[0][:, None] != comp[1][None, :]
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        x, y = root(comp[0][i]), root(comp[1][j])
        if x != y:
            parent[x] = y
            out.append((rows[0].node.iat[i], rows[1].node.iat[j]))
    return pd.DataFrame(out, columns=["a", "b"]).astype({"a": group.node.dtype, "b": group.node.dtype})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, bands: int = 24, rows: int = 4) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row of ``docs``.

    Documents are linked if ``den * |A & B| >= num * |A | B|`` on their sets of distinct k-word shingles (A-Z
    lower-cased, words split at ASCII white space, short texts as one shingle). Sets hold 64-bit hashes of the shingles;
    links are confirmed on them, whole: two of the shingles of a pair of 20,000 words each have one hash with probability
    4e-11.

    Defined cases: null or word-less text: 0 shingles, linked with nothing, a component of its own. Null id: the row
    keeps null ids, is linked with nothing and kept. Rows that repeat an id count as one document, whose texts' links
    add up; each row is returned. Ties do not occur: the smallest id represents its component. An empty table gives an
    empty result. Other columns are ignored.
    """
    if bands * rows > 128:
        raise ValueError("bands * rows must be at most 128")
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = cut(_sketch(docs, k, bands, rows))
    usable = sketch.where("n > 0 and doc_id is not null")
    classes = cut(usable.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")))
    exploded = classes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = cut(exploded.join(shared, "bucket"))

    sets = cut(_full_sets(filter_by_ids(docs, members.select("node"), "doc_id", keep=True), k))
    weight = members.groupBy("node").agg(F.sum("members").alias("weight"))
    pivots = members.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", F.negative("node").alias("order"), "node", "n")).alias("p")).select("bucket", F.col("p.node").alias("b"), F.col("p.n").alias("nb"))
    alike = F.expr(f"{den} * least(na, nb) >= {num} * greatest(na, nb)")
    star = members.select("bucket", F.col("node").alias("a"), F.col("n").alias("na")).join(pivots, "bucket").where("a <> b").where(alike).select("a", "b").distinct()
    links = _confirmed(star, sets, num, den)
    joined = cut(connected_components(links, "a", "b"))
    placed = members.join(joined.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    per = placed.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
    split = per.groupBy("bucket").agg(F.max(F.struct("c", "comp")).getField("comp").alias("major"), F.count("*").alias("comps"), (F.sum("c") - F.max("c")).alias("minors")).where("comps > 1").drop("comps")
    rest = cut(placed.join(split, "bucket").withColumn("minor", F.expr("comp <> major")))

    small = rest.where(F.col("members") <= SMALL_BUCKET)
    side = lambda df, s: df.select("bucket", F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("comp").alias(f"c{s}"), F.col("minor").alias(f"m{s}"))
    pairs = side(small.where("minor"), "a").join(side(small, "b"), "bucket").where("ca <> cb and (not mb or a < b)").where(alike)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = _confirmed(pairs, sets, num, den)

    large = rest.where(F.col("members") > SMALL_BUCKET)
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = lambda n: F.pmod(F.xxhash64("node"), blocks(n).cast("long")).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    dealt = large.where("minor").select("bucket", "node", "comp", F.lit(0).alias("side"), own("minors").alias("i"), all_of("members").alias("j"))
    dealt = dealt.unionByName(large.select("bucket", "node", "comp", F.lit(1).alias("side"), all_of("minors").alias("i"), own("members").alias("j")))
    ends = pairs.schema
    blocked = dealt.join(sets, "node").groupBy("bucket", "i", "j").applyInPandas(lambda g: _block_links(g, num, den), ends)

    # The texts of one id are one document: their classes are linked, and the id has one component.
    key = F.struct("n", "s1", "s2")
    several = cut(sketch.where("doc_id is not null").groupBy("doc_id").agg(F.min(key).alias("x"), F.max(key).alias("y")).where("x <> y").select("doc_id"))
    repeats = not several.isEmpty()
    if repeats:
        held = usable.join(several, "doc_id", "left_semi").select("doc_id", "n", "s1", "s2").distinct().join(classes.drop("bands"), ["n", "s1", "s2"]).select("doc_id", "node")
        own_links = held.join(held.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")
        more = more.unionByName(own_links)

    # What the second comparison found is contracted to the components of the first before it is joined up.
    late = more.unionByName(blocked).join(joined.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(joined.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    late = connected_components(late.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), "a", "b")
    early = joined.select("node", F.col("component").alias("first")).unionByName(late.join(joined, "node", "left_anti").select("node", F.col("node").alias("first")))
    final = early.join(late.select(F.col("node").alias("first"), F.col("component").alias("then")), "first", "left").select("node", F.coalesce("then", "first").alias("component_id"))
    known = classes.select(F.col("n").alias("n_"), F.col("s1").alias("s1_"), F.col("s2").alias("s2_"), "node")
    placed = known.join(final, "node", "left").select("n_", "s1_", "s2_", F.coalesce("component_id", "node").alias("component_id"))
    out = sketch.select("doc_id", "n", "s1", "s2").join(placed, (F.col("n") == F.col("n_")) & (F.col("s1") == F.col("s1_")) & (F.col("s2") == F.col("s2_")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    if repeats:  # a row without words has the component of its id's other rows
        out = cut(out)
        least = out.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("least"))
        out = out.join(least, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("least", "component_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
