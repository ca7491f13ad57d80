"""Benchmark decontamination: size-partitioned MinHash containment search, confirmed by exact shingle containment.

A benchmark item is found in a document if the document holds at least 80 % of the item's distinct k-word shingles. Items
are short and documents long, so similarity of the two sets says nothing; containment of the item does, and only the
smaller set has to be sketched. Items are partitioned by set size in powers of two. In a partition with at most u
shingles an item's sketch is the floor(0.2 * u) + 1 shingles of least hash. A document that holds 80 % of an item cannot
miss all of its sketch, so looking up every shingle of a document among the sketches finds all candidates, at any ratio
of lengths. Each candidate is confirmed on the full sets.

Everything is DataFrame expressions: hashes of a document are an array, exploded and joined to the sketches, whose
number is counted. Sketches and full sets of the items are tables of one shingle a row, linear in the items' length.
They are broadcast in slices of at most ``MAX_BROADCAST_ROWS`` rows, one pass each, by a hash of item and shingle, so a
slice has a size bound whatever the size of the benchmark or of one item. Documents are not shuffled; to confirm, only
the shingles of candidate documents are, by document and shingle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskline.llm.arrow_map import filter_by_ids
from duskline.session import cut

#: Rows of a broadcast slice: an item's key and one number, about 100 bytes, so some 20 MB.
MAX_BROADCAST_ROWS = 200_000
#: Words: runs of letters and digits, lower-cased.
BETWEEN_WORDS = r"[^\p{L}\p{N}]+"


def shingle_hashes(text: Column, k: int) -> Column:
    """Hashes of the k-word shingles of a text; its whole sequence as one if it has fewer words; none without words."""
    words = F.filter(F.split(F.lower(text), BETWEEN_WORDS), lambda w: w != "")
    slide = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    # A let-binding: the words are split once and passed on as the only element of an array.
    bound = F.transform(F.array(words), lambda w: F.when(F.size(w) >= k, slide(w)).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>")))
    return F.coalesce(bound[0], F.array().cast("array<bigint>"))


def _index(items: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``(item, n_item, h, sketched)``: one row per shingle of each item row, keyed by id and text; ``sketched``: in the
    item's sketch, which depends on its size partition."""
    text = F.col("text")
    sets = items.select(F.struct("item_id", F.xxhash64(text).alias("text")).alias("item"), F.array_distinct(shingle_hashes(text, k)).alias("hashes"))
    sets = sets.where(F.size("hashes") > 0).withColumn("n_item", F.size("hashes"))
    largest = F.pow(F.lit(2), F.ceil(F.log2(F.col("n_item").cast("double")))).cast("int")
    sketch = F.floor(largest * (den - num) / den).cast("int") + 1
    ranked = F.array_sort(F.transform("hashes", lambda h: F.struct(F.xxhash64(h).alias("rank"), h.alias("h"))))
    return sets.select("item", "n_item", sketch.alias("sketch"), F.posexplode(ranked).alias("at", "s")).select("item", "n_item", F.col("s.h").alias("h"), (F.col("at") < F.col("sketch")).alias("sketched"))


def _slices(rows: DataFrame, max_rows: int) -> list[DataFrame]:
    """``rows`` (item, h, ...) in as many parts as keep each at about ``max_rows`` rows, one item's rows apart too."""
    n = max(1, -(-rows.count() // max_rows))
    return [rows.where(F.pmod(F.xxhash64("item", "h"), F.lit(n)) == i) for i in range(n)] if n > 1 else [rows]


def find_contaminated(docs: DataFrame, items: DataFrame, k: int = 5, num: int = 80, den: int = 100, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``(doc_id, item_id, n_item, n_common)`` of each document and item with ``den * n_common >= num * n_item``.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored. Null or word-less texts and items
    match nothing; an item of fewer than k words has its whole sequence as one shingle, which only an equally short
    document can hold. Repeated rows give repeated matches once each per (doc_id, item_id). Null ids are kept as ids.
    Empty tables give an empty result.
    """
    index = cut(_index(items.select("item_id", "text"), k, num, den).distinct())
    hashed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text")).alias("doc"), shingle_hashes(F.col("text"), k).alias("hashes"))
    looked_up = hashed.select("doc", F.explode_outer("hashes").alias("h"))
    sketches = _slices(index.where("sketched").select("item", "h"), max_rows)
    pairs = cut(reduce(DataFrame.unionAll, [looked_up.join(F.broadcast(part), "h").select("doc", "item") for part in sketches]).distinct())
    # Candidates meet the items' shingles in broadcast slices, so that an item of many documents is no hot key.
    wanted = reduce(DataFrame.unionAll, [pairs.join(F.broadcast(part), "item") for part in _slices(index.drop("sketched"), max_rows)])
    held = filter_by_ids(hashed, pairs.select("doc"), "doc", keep=True).select("doc", F.explode(F.array_distinct("hashes")).alias("h")).distinct()
    common = wanted.join(held, ["doc", "h"]).groupBy("doc", "item", "n_item").agg(F.count("*").cast("int").alias("n_common"))
    found = common.where(F.col("n_common") * den >= F.col("n_item") * num)
    return found.select(F.col("doc.doc_id").alias("doc_id"), F.col("item.item_id").alias("item_id"), "n_item", "n_common").distinct()


def drop_contaminated(docs: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; all columns stay. Rows without an id are kept."""
    return filter_by_ids(docs, find_contaminated(docs, items, k).where("doc_id is not null").select("doc_id"), "doc_id", keep=False)
