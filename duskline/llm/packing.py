"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents are cut into pieces of at most the largest length. Pieces are dealt to shards by hash, as many as the corpus
needs for ``SHARD_TOKENS`` a shard, and each shard is packed on its own, longest piece first:

* a piece goes to the open bin with the least room that still takes it (best fit);
* if none does, a bin of the length with the least cost per token is opened. For each permitted length the bin is filled
  on trial, from the sizes that are left and not spoken for, largest first; the cost of the length that this content needs
  is divided by the content. The content of the chosen trial is then spoken for, so that the lengths of all bins are
  settled against one stock of pieces;
* at last each bin shrinks to the shortest permitted length that holds its contents.

The cost of a bin (``bin_cost``) is that of a training step on its sequence: a fixed part, one for each token, and
attention, which grows with the square of the length. Without the square the largest length would always do, as two bins
can be joined to one of twice the length at no cost; with it a long bin has to earn its length by what it holds.

A shard's state is its open bins, indexed by room, and the stock of sizes; both are bounded by ``SHARD_TOKENS``, not by the
corpus. Each shard leaves a few bins part-filled, a share of about (largest length) / (tokens of a shard).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskline.session import cut

LENGTHS = (512, 1024, 2048, 4096)
#: Tokens of a shard, about; the fixed cost of a bin in tokens; the length at which attention costs as much as the tokens.
SHARD_TOKENS, OVERHEAD, ATTENTION = 4_000_000, 16, 32_768
#: Rows of one id and size that are numbered in one task.
COPIES = 10_000
SCHEMA = "doc_id {id}, piece int, piece_tokens int, shard int, bin int, bin_length int, bin_tokens long, bin_offset int"


def bin_cost(length: int) -> float:
    return OVERHEAD + length + length * length / ATTENTION


class _Stock:
    """Sizes of the pieces not yet placed: those free, and those spoken for by open bins."""

    def __init__(self, sizes: list[int]):
        self.free, self.spoken = Counter(sizes), Counter()
        self.sizes = sorted(self.free)

    def trial(self, room: int) -> list[tuple[int, int]]:
        """Free sizes that fill ``room``, largest first, and how many of each."""
        content, at = [], bisect_right(self.sizes, room)
        while at:
            size = self.sizes[at - 1]
            n = min(room // size, self.free[size])
            content.append((size, n))
            room -= n * size
            at = bisect_right(self.sizes, room, 0, at - 1)
        return content

    def take(self, size: int, n: int = 1) -> None:
        self.free[size] -= n
        if not self.free[size]:
            del self.sizes[bisect_left(self.sizes, size)]

    def place(self, size: int) -> None:
        """A piece of this size is placed now; pieces of one size stand for each other."""
        if self.spoken[size]:
            self.spoken[size] -= 1
        else:
            self.take(size)

    def speak_for(self, content: list[tuple[int, int]]) -> None:
        for size, n in content:
            self.take(size, n)
            self.spoken[size] += n


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece (in the given order, which should be longest first), and the length of each bin."""
    lengths = tuple(sorted(lengths))
    cost = {c: bin_cost(c) for c in lengths}
    least = lambda used: lengths[bisect_left(lengths, used)]
    stock = _Stock(sizes)
    rooms: list[int] = []  # rooms that open bins have, ascending
    by_room: dict[int, list[int]] = {}
    used: list[int] = []
    capacity: list[int] = []
    bins, offsets = [], []
    for size in sizes:
        if not 0 < size <= lengths[-1]:
            raise ValueError(f"a piece has {size} tokens; 1 to {lengths[-1]} are permitted")
        stock.place(size)
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        else:
            best = None
            for c in lengths:
                if c >= size:
                    content = stock.trial(c - size)
                    tokens = size + sum(s * n for s, n in content)
                    per_token = cost[least(tokens)] / tokens
                    if best is None or per_token < best[0]:
                        best = per_token, c, content
            stock.speak_for(best[2])
            b = len(used)
            used.append(0)
            capacity.append(best[1])
        bins.append(b)
        offsets.append(used[b])
        used[b] += size
        room = capacity[b] - used[b]
        if room:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append(b)
    return bins, offsets, [least(u) for u in used]


def pack_documents(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """``(doc_id, piece, piece_tokens, shard, bin, bin_length, bin_tokens, bin_offset)`` per piece.

    A document of n tokens has ceil(n / largest) pieces, all but the last of the largest length; nothing is dropped.
    Documents with null, zero or negative tokens get one row with piece null and no bin. Null ids are packed like any.
    Repeated rows are packed each. Ties in size are ordered by id, then piece. Other columns are ignored. An empty table
    gives an empty result.

    Rows of one id, or without one, are dealt to all shards: those of equal id and size stand for each other, so they are
    counted, the copies numbered, and the number is part of what is hashed.
    """
    top = max(lengths)
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(size_col).cast("long").alias("n"))
    counted = cut(sized.groupBy("doc_id", "n").agg(F.count("*").alias("copies")))
    tokens = counted.agg(F.sum(F.when(F.col("n") > 0, F.col("n") * F.col("copies")))).first()[0] or 0
    shards = max(1, -(-tokens // shard_tokens))
    blocks = counted.withColumn("block", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})"))).repartition("doc_id", "n", "block")
    numbered = blocks.withColumn("copy", F.explode(F.expr(f"sequence(block * {COPIES}, least(copies, (block + 1) * {COPIES}) - 1)")))
    cut_up = numbered.select("doc_id", "n", "copy", F.explode_outer(F.expr(f"case when n > 0 then sequence(0, cast((n - 1) div {top} as int)) end")).alias("piece"))
    cut_up = cut_up.withColumn("piece_tokens", F.expr(f"case when piece is not null then cast(least(n - cast(piece as bigint) * {top}, {top}) as int) end"))
    shard = F.pmod(F.xxhash64("doc_id", "piece", "copy"), F.lit(shards)).cast("int")
    dealt = cut_up.select("doc_id", "piece", "piece_tokens", shard.alias("shard"))
    schema = SCHEMA.format(id=docs.schema[id_col].dataType.simpleString())

    def run(group: pa.Table) -> pa.Table:  # Arrow keeps ids as they are, a null beside large numbers too
        group = group.sort_by([("piece_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sizes = group["piece_tokens"].to_pylist()
        bins, offsets, length = pack(sizes, lengths)
        tokens = [0] * len(length)
        for b, n in zip(bins, sizes, strict=True):
            tokens[b] += n
        int32 = lambda values: pa.array(values, pa.int32())
        placed = [int32(bins), int32([length[b] for b in bins]), pa.array([tokens[b] for b in bins], pa.int64()), int32(offsets)]
        return pa.table([*(group[c] for c in ("doc_id", "piece", "piece_tokens", "shard")), *placed], ["doc_id", "piece", "piece_tokens", "shard", "bin", "bin_length", "bin_tokens", "bin_offset"])

    packed = dealt.where("piece is not null").groupBy("shard").applyInArrow(run, schema)
    return packed.unionByName(dealt.where("piece is null").selectExpr("doc_id", "piece", "piece_tokens", "cast(null as int) shard"), allowMissingColumns=True)
