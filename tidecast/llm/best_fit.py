"""Best-fit packing of whole documents in synchronous rounds.

Documents are placed from the longest to the shortest, and each goes to the open sequence with the smallest
gap that holds it. A round takes the documents of one band of lengths, where the longest is at most a third
longer than the shortest, and all gaps that may hold one of them:

1. Documents and gaps are range-sorted by size, the largest first. A gap that is larger than any document of
   the band offers as many slots as surely fit.
2. Every partition is swept once. Slots go on a stack; a document takes the last slot put there, which is
   the smallest that holds it. Where several documents have the same smallest gap, their rank decides, and the
   next one takes the next larger gap.
3. What a partition could not match is matched across partitions: a document takes the last free slot of the
   nearest partition of larger sizes. Only the numbers of free slots and waiting documents by partition
   go through the driver; rows meet by their ranks.
4. Gaps shrink by what they got. Documents that are still waiting open new sequences, as many as they need
   together, and the round is repeated for them.

Lengths are whole numbers up to the limit, so the number of rounds follows the limit and not the documents.
Texts and ids of tokens are never shuffled, only their places, lengths and checksums.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.llm.packing import encoder
from tidecast.llm.textbytes import frugal, text_blocks
from tidecast.session import stage

#: The id that ends every document (fixed by the query's contract).
END_ID = 1
LIMIT = 4096
#: A band goes from a length down to this share of it.
BAND = 0.75
PIECES = "item long, doc_id long, piece int, start long, length int, ids_crc32 long"
#: Roles of a row in a sweep, and what a sweep says about it.
ITEM, GAP = 0, 1
MATCHED, WAITING, FREE = 0, 1, 2
SWEPT = "state int, part int, first long, n int, gap long, free int, item long, size int"


def pieces(documents: DataFrame, tokenizer: str, limit: int) -> DataFrame:
    """One row per piece (``PIECES``): documents, those beyond the limit cut into pieces of that length."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        serial = (context.partitionId() if context else 0) << 40
        encode = encoder(tokenizer)
        for batch in batches:
            for first, last, data, offsets in text_blocks(batch.column(1)):
                flat, ends = encode.encode(data, offsets)
                rows: list[tuple] = []
                for i in range(last - first):
                    ids = np.append(flat[ends[i] : ends[i + 1]], np.uint32(END_ID)).astype("<u4")
                    for piece, start in enumerate(range(0, ids.size, limit)):
                        part = ids[start : start + limit]
                        rows.append((serial, first + i, piece, start, part.size, zlib.crc32(part.tobytes())))
                        serial += 1
                items, texts, numbers, starts, sizes, checks = zip(*rows)
                columns = [
                    pa.array(items, pa.int64()),
                    batch.column(0).take(pa.array(texts, pa.int64())),
                    pa.array(numbers, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(sizes, pa.int32()),
                    pa.array(checks, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "piece", "start", "length", "ids_crc32"])

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, PIECES)


def _sweep(rows: DataFrame, largest: int) -> DataFrame:
    """Match the sorted documents and gaps of every partition (``SWEPT``).

    ``rows`` has ``kind, id, size``. A matched row names its gap and item. A waiting one has its number
    ``first`` among the partition's. A free one has ``n`` slots from number ``first`` on, the last free slot of
    the partition first.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        stack: list[list[int]] = []  # [gap, slots left, size]
        waiting = 0

        def table(out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out) if out else [[]] * 8
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
            names = [field.split()[0] for field in SWEPT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            out = []
            for kind, one, size in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == GAP:
                    stack.append([one, max(1, size // largest), size])
                elif stack:
                    top = stack[-1]
                    top[1] -= 1
                    out.append((MATCHED, part, None, None, top[0], top[2], one, size))
                    if not top[1]:
                        stack.pop()
                else:
                    out.append((WAITING, part, waiting, None, None, None, one, size))
                    waiting += 1
            yield table(out)
        out, number = [], 0
        for gap, slots, size in reversed(stack):
            out.append((FREE, part, number, slots, gap, size, None, None))
            number += slots
        yield table(out)

    order = [F.desc("size"), F.desc("kind"), "id"]
    sorted_rows = rows.select("kind", "id", "size").repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_rows.mapInArrow(run, SWEPT)


def _plan(counts: list) -> list[tuple[int, int, int, int, int]]:
    """Which waiting documents meet which free slots: ``(kind, partition, first, past the last, shift)``.

    Partitions come with the largest sizes first. Number plus shift is what both sides meet by.
    """
    stack, plan, met = [], [], 0
    for part, waiting, free in counts:
        done = 0
        # Documents of a partition cannot take its own free slots: these come after its last waiting one.
        while done < waiting and stack:
            owner, taken, slots = stack.pop()
            n = min(waiting - done, slots - taken)
            plan.append((ITEM, part, done, done + n, met - done))
            plan.append((GAP, owner, taken, taken + n, met - taken))
            done, met = done + n, met + n
            if taken + n < slots:
                stack.append((owner, taken + n, slots))
        if free:
            stack.append((part, 0, free))
    return plan


def _round(items: DataFrame, gaps: DataFrame, smallest: int, largest: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """One round for items of lengths from ``smallest`` to ``largest``.

    Gives placements ``item, gap, size``, all gaps, the items that are still waiting, and their number.
    """
    spark = items.sparkSession
    able = gaps.filter(F.col("free") >= smallest)
    rows = items.select(F.lit(ITEM).alias("kind"), F.col("item").alias("id"), "size").unionByName(
        able.select(F.lit(GAP).alias("kind"), F.col("gap").alias("id"), F.col("free").alias("size"))
    )
    swept = stage(_sweep(rows, largest))
    sums = swept.filter(F.col("state") > MATCHED).groupBy("part").agg(
        F.sum((F.col("state") == WAITING).cast("long")).alias("waiting"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("free"),
    )
    # As many rows as there are partitions.
    counts = sorted((r.part, r.waiting, r.free) for r in sums.collect())
    plan = _plan(counts)
    left = sum(waiting for _, waiting, _ in counts) - sum(p[3] - p[2] for p in plan if p[0] == ITEM)
    matched = swept.filter(F.col("state") == MATCHED).select("item", "gap", "size", "free")
    waiting = swept.filter(F.col("state") == WAITING).select("part", F.col("first").alias("number"), "item", "size")
    still = waiting.select("item", "size")
    if plan:
        table = spark.createDataFrame(plan, "kind int, owner int, low long, high long, shift long")
        # At most two rows per partition and one per partition that runs out.
        chosen = F.broadcast(table.filter(F.col("kind") == ITEM))
        placed = waiting.join(chosen, (F.col("part") == F.col("owner")) & (F.col("number") >= F.col("low")) & (F.col("number") < F.col("high")), "left")
        placed = placed.select("item", "size", (F.col("number") + F.col("shift")).alias("meeting"))
        still = placed.filter("meeting is null").select("item", "size")
        offered = F.broadcast(table.filter(F.col("kind") == GAP))
        last = F.col("first") + F.col("n")
        slots = swept.filter(F.col("state") == FREE).join(
            offered, (F.col("part") == F.col("owner")) & (F.col("first") < F.col("high")) & (last > F.col("low"))
        )
        numbers = F.sequence(F.greatest("first", "low"), F.least(last, F.col("high")) - 1)
        slots = slots.select("gap", "free", "shift", F.explode(numbers).alias("slot"))
        slots = slots.select("gap", "free", (F.col("slot") + F.col("shift")).alias("meeting"))
        met = placed.filter("meeting is not null").join(slots, "meeting").select("item", "gap", "size", "free")
        matched = matched.unionByName(met)
    matched = stage(matched)
    used = matched.groupBy("gap").agg(F.sum("size").cast("int").alias("used"))
    after = able.join(used, "gap", "left").select("gap", (F.col("free") - F.coalesce("used", F.lit(0))).alias("free"))
    gaps = stage(gaps.filter(F.col("free") < smallest).unionByName(after).filter("free > 0"))
    return matched.select("item", "gap", "size"), gaps, still, left


def _new_gaps(spark: SparkSession, opened: int, count: int, limit: int) -> DataFrame:
    return spark.range(opened, opened + count).select((-1 - F.col("id")).alias("gap"), F.lit(limit).alias("free"))


def best_fit(items: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``item, gap, size``: the sequence ``gap`` of every row of ``items(item, size)``, sizes from 1 to ``limit``.

    Items longer than half the limit open sequences of their own number; sequences that others open have
    negative numbers.
    """
    spark = items.sparkSession
    # At most ``limit`` rows: how many items there are of each size.
    counted = {r["size"]: r["count"] for r in items.groupBy("size").count().collect()}
    sizes, half = sorted(counted, reverse=True), limit // 2
    alone = items.filter(F.col("size") > half)
    placed = [alone.select("item", F.col("item").alias("gap"), "size")]
    gaps = alone.filter(F.col("size") < limit).select(F.col("item").alias("gap"), (limit - F.col("size")).alias("free"))
    # What the gaps cannot hold together needs new sequences in any case.
    room = sum(n * (limit - size) for size, n in counted.items() if size > half)
    opened = max(0, -(-(sum(n * size for size, n in counted.items() if size <= half) - room) // limit))
    gaps = gaps.unionByName(_new_gaps(spark, 0, opened, limit))
    sizes = [size for size in sizes if size <= half]
    while sizes:
        largest = sizes[0]
        band = [size for size in sizes if size >= largest * BAND]
        sizes, smallest = sizes[len(band) :], band[-1]
        waiting = items.filter(F.col("size").between(smallest, largest))
        matched, gaps, still, left = _round(waiting, gaps, smallest, largest)
        placed.append(matched)
        if left:
            needed = -(-left // (limit // largest))
            new = _new_gaps(spark, opened, needed, limit)
            opened += needed
            matched, gaps, _, left = _round(still, gaps.unionByName(new), smallest, largest)
            placed.append(matched)
            if left:
                raise AssertionError("a new sequence holds as many items as it has slots")
    every = placed[0]
    for one in placed[1:]:
        every = every.unionByName(one)
    return every


def pack_whole(documents: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = LIMIT) -> DataFrame:
    """Pack ``documents(doc_id, text)`` into few sequences of at most ``limit`` tokens; one row per piece.

    Gives ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A document is its ids and ``END_ID``;
    only longer ones than ``limit`` are cut, into pieces of that length and a last one. A null or empty text is
    ``END_ID`` alone. Repeated rows and repeated or null ``doc_id`` are documents of their own. No row gives no
    piece; other columns are ignored. Pieces of a sequence lie from the longest to the shortest.
    """
    table = stage(pieces(documents, tokenizer, limit))
    places = best_fit(table.select("item", F.col("length").alias("size")), limit)
    places = places.select("item", F.col("gap").alias("sequence_id"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "item")
    before = F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    return table.join(places, "item").select(
        "doc_id",
        "piece",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        "sequence_id",
        F.coalesce(before, F.lit(0)).cast("long").alias("offset"),
    )
