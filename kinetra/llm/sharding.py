"""Shards of near equal bytes from indivisible groups, by Karmarkar-Karp differencing."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinetra.llm.common import free_name, require
from kinetra.operators.sequence import cut_lineage

#: Groups differenced by one task, on average.
CELL = 8192
#: Small groups held back, on average, to even out what the cells leave.
LAST = 4096
#: A group is large if it has more than this part of an even shard's bytes or rows.
PART = 64
#: Bytes that a row counts besides its text.
ROW = 16
#: Rows of one slice of a shard, on average: what one task numbers at a time.
SLICE = 4096


def difference(sizes, ways: int, start=None) -> np.ndarray:
    """The bin, 0 to ways - 1, of each item by the differencing method.

    Each item begins as a partial partition of its own: its size in one bin, nothing in the others. The two
    partitions with the largest spread (greatest bin less smallest) are combined, the fullest bins of one with the
    emptiest of the other, until one is left; ties go to the older one. `start` may give a partition to begin with:
    what the bins hold already.
    """
    n = len(sizes)
    if n == 0:
        return np.zeros(0, np.int64)
    vectors: dict[int, np.ndarray] = {}
    heap = [(-int(s), i) for i, s in enumerate(sizes)] if ways > 1 else [(0, i) for i in range(n)]
    first = n
    if start is not None:
        held = np.asarray(start, np.int64)
        by_size = np.argsort(held, kind="stable")
        vectors[n] = held[by_size] - held.min()
        heap.append((-int(vectors[n][-1]), n))
        first += 1
    heapify(heap)

    def vector(node: int) -> np.ndarray:
        if node in vectors:
            return vectors.pop(node)
        alone = np.zeros(ways, np.int64)
        alone[-1] = sizes[node]
        return alone

    joined: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        a, b = heappop(heap)[1], heappop(heap)[1]
        sums = vector(a) + vector(b)[::-1]
        order = sums.argsort(kind="stable")
        sums = sums[order]
        sums -= sums[0]
        node = first + len(joined)
        joined.append((a, b, order.astype(np.int32)))
        vectors[node] = sums
        heappush(heap, (-int(sums[-1]), node))

    # From the last partition back to the items: place[j] is the bin of a partition's j-th smallest part.
    bins = np.empty(n, np.int64)
    places = {heap[0][1]: np.arange(ways)}
    for k in range(len(joined) - 1, -1, -1):
        a, b, order = joined[k]
        back = np.empty(ways, np.int64)
        back[order] = places.pop(first + k)
        places[a], places[b] = back, back[::-1]
        for node in (a, b):
            if node < n:
                bins[node] = places.pop(node)[-1]
    if start is None:
        for node, place in places.items():  # a single item
            bins[node] = place[-1]
        return bins
    label = np.empty(ways, np.int64)
    label[places[n]] = by_size
    return label[bins]


def level_with(held: np.ndarray, more: float) -> np.ndarray:
    """`held` cut at the level to which `more` fills its lower bins."""
    order = np.sort(np.asarray(held, float))
    n = np.arange(1, len(order) + 1)
    levels = (more + np.cumsum(order)) / n
    # The level over the n lowest bins counts where it doesn't reach the next one.
    fits = np.flatnonzero(levels <= np.r_[order[1:], np.inf])
    return np.minimum(np.asarray(held, float), levels[fits[0]])


def _binned(items: DataFrame, ways: int, held: np.ndarray | None = None, total: float = 0.0) -> DataFrame:
    """key, bytes and shard of items (cell, key, bytes), each cell by differencing.

    With `held`, a cell begins with the part of `held` that its bytes are of `total`.
    """
    def pack(table: pa.Table) -> pa.Table:
        table = table.drop_columns(["cell"]).sort_by([("bytes", "descending"), ("key", "ascending")])
        sizes = table.column("bytes").to_numpy()
        start = None if held is None else np.floor(held * (float(sizes.sum()) / total)).astype(np.int64)
        return table.append_column("shard", pa.array(difference(sizes, ways, start), pa.int32()))

    return items.select("cell", "key", "bytes").groupBy("cell").applyInArrow(pack, "key binary, bytes long, shard int")


def _sums(placed: DataFrame, ways: int) -> np.ndarray:
    got = np.zeros(ways, np.int64)
    for r in placed.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect():  # one row per shard
        got[r.shard] = r.bytes
    return got


def balance_groups(groups: DataFrame, shards: int, cell: int = CELL, last: int = LAST, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """key, bytes and shard of groups (key binary, bytes, rows), the large groups and the others.

    Three rounds of differencing, so that no task holds more than a bounded number of groups at any size of input:

    1. Large groups, at most 2 * part * shards by what large means, are differenced in one task.
    2. The other groups are dealt to cells by hash. Each cell starts from its share of what the first round
       left uneven, so that a cell's groups fill the shards that large groups left empty and pass by the full ones.
    3. About `last` small groups, chosen by hash, are held back; they are differenced against the sums of all the
       others, which takes out what the cells' small spreads add up to.

    Keys must be unique. No groups in, none out.
    """
    groups = cut_lineage(groups.select("key", F.col("bytes").cast("long").alias("bytes"), F.col("rows").cast("long").alias("rows")))
    total = groups.agg(F.coalesce(F.sum(F.col("bytes").cast("double")), F.lit(0.0)).alias("bytes"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    is_large = ((F.col("bytes") * F.lit(float(shards * part)) > F.lit(total.bytes))
                | (F.col("rows") * F.lit(float(shards * part)) > F.lit(float(total.rows))))
    large = cut_lineage(_binned(groups.where(is_large).withColumn("cell", F.lit(0)), shards))
    held = _sums(large, shards)

    small = groups.where(~is_large)
    n = small.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("bytes").cast("double")), F.lit(0.0)).alias("bytes")).first()
    kept_back = F.pmod(F.xxhash64(F.lit("last"), "key"), F.lit(max(1, n.n))) < last
    cells = max(1, -(-n.n // cell))
    most = small.where(~kept_back).withColumn("cell", F.pmod(F.xxhash64(F.lit("cell"), "key"), F.lit(cells)))
    placed = cut_lineage(_binned(most, shards, level_with(held, n.bytes), max(1.0, n.bytes)))

    held = held + _sums(placed, shards)
    rest = small.where(kept_back).withColumn("cell", F.lit(0))
    left = float(rest.agg(F.sum("bytes")).first()[0] or 0)
    placed = placed.unionByName(_binned(rest, shards, level_with(held, left), max(1.0, left)))
    return large, cut_lineage(placed)


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def shard_documents(docs: DataFrame, shards: int = 40, **options) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for each row of `docs` (doc_id, text).

    The law is `bytes`: shards are as equal in bytes as whole groups allow. A row's size is its text's UTF-8 bytes plus
    16; rows with equal texts (null counts as empty, so its size is 16) are one group and share a shard. A group
    above the mean of all shards fills one by itself. slot numbers a shard's rows without gaps from 0, by slices
    of a hash of the row, so that no task orders a whole shard. grown_shard is null under this law.

    Repeated rows count and come out as often as they go in; doc_id may be null. Other columns are ignored.
    Texts are read once; what is shuffled are digests and sizes. No rows in, no rows out.
    """
    require(docs, "doc_id", "text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(text).alias("key"),
                                   (F.octet_length(text) + ROW).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    large, others = (df.select(F.col("key").alias("g_key"), "shard") for df in balance_groups(groups, shards, **options))
    # Large groups are few by what they are, so they travel to the rows; no other key is hot.
    large = F.broadcast(large)
    slim = rows.groupBy("doc_id", "key", "size", "text_crc32").agg(F.count("*").alias("copies"))
    same = F.col("key") == F.col("g_key")
    placed = cut_lineage(slim.join(large, same).unionByName(slim.join(large, same, "left_anti").join(others, same)).drop("g_key"))

    n = placed.count()
    slice_ = F.pmod(F.xxhash64("doc_id", "key"), F.lit(max(1, -(-n // (shards * SLICE)))))
    sliced = placed.withColumn("at", F.struct("shard", slice_.alias("slice")))
    before = Window.partitionBy("at").orderBy("doc_id", "key").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("at.shard").orderBy("at.slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sliced.groupBy("at").agg(F.sum("copies").alias("n"))
               .select("at", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")))
    numbered = (sliced.withColumn("upto", F.coalesce(F.sum("copies").over(before), F.lit(0))).join(offsets, "at")
                .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                           (F.col("offset") + F.col("upto") + F.col("copy")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, folder: str, shards: int = 40, **options) -> None:
    """Writes `docs`, all columns, as Parquet into one folder per shard below `folder`; no column may be called `shard`."""
    require(docs, "text")
    if any(c.lower() == "shard" for c in docs.columns):
        raise ValueError("a column is called shard")
    key, g_key = free_name(docs, "key"), free_name(docs, "gkey")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn(key, _digest(text))
    groups = rows.groupBy(F.col(key).alias("key")).agg(F.sum((F.octet_length(text) + ROW).cast("long")).alias("bytes"), F.count("*").alias("rows"))
    large, others = (df.select(F.col("key").alias(g_key), "shard") for df in balance_groups(groups, shards, **options))
    same = F.col(key) == F.col(g_key)
    placed = rows.join(F.broadcast(large), same).unionByName(rows.join(F.broadcast(large), same, "left_anti").join(others, same))
    placed.drop(key, g_key).write.partitionBy("shard").parquet(folder)
