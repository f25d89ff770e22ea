"""Best-fit packing into fixed sequences by hierarchical residual packing (op 8).

A document is its ids and an end id; documents longer than a sequence, and no
others, are cut into full pieces and a rest.  Pieces are dealt out at random to
tasks, and each task packs blocks of ``BLOCK`` of them by best fit, longest first.
Bins with less room than ``SLACK`` are done.  Underfull bins are the items of the next
round, which has an eighth of the tasks, until one block is left.

Of the underfull bins, a block passes on all that a later round can join.  No two bins
of a packed block fit together, so one at most is no more than half full, and a join
needs such a bin: when n blocks meet, there are n - 1 joins at most, each with one bin
that was more than half full.  Over all rounds ahead, that is less than two blocks for
each of the ``FAN_IN`` tasks that meet, a round.  So ``enough`` bins of a block, the
emptiest, are as good as all: where any other bin would do, one of these is left and
has as much room.  What a task gets is bounded by that, whatever the sizes are.
Nothing but rows of a few numbers is shuffled; a bin number is looked up once a round.

Defined cases: a null or empty text is the end id alone; a text of any length is cut
into as many pieces as it takes; rows with the same doc_id, repeated rows among them, are
packed each; ties go to the item that came first; without rows there are no sequences.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsift.llm.shared import keep, ship

CAPACITY, END = 2048, 0
#: Pieces that a task packs at once; a bin with less room than ``SLACK`` is done.
BLOCK, FAN_IN = 1 << 16, 8
SLACK = CAPACITY // 64


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and what each bin holds: best fit, longest first.

    Bit r of ``free`` is set while a bin has room r, so the tightest fit is one shift away.
    """
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    room: list[int] = []
    by_room: dict[int, list[int]] = {}
    free = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = free >> size
        if fitting:
            r = size + (fitting & -fitting).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                free &= ~(1 << r)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i], room[b] = b, capacity - r, r - size
        if room[b]:
            by_room.setdefault(room[b], []).append(b)
            free |= 1 << room[b]
    return bins, offsets, capacity - np.array(room, np.int64)


def rounds(tasks: int) -> int:
    """Rounds after one of so many tasks."""
    ahead = 0
    while tasks > 1:
        tasks, ahead = -(-tasks // FAN_IN), ahead + 1
    return ahead


def enough(tasks: int) -> int:
    """Underfull bins of a block that the rounds ahead can use."""
    return 2 * FAN_IN * rounds(tasks)


def _pack(capacity: int, last: bool, most: int):
    """(item, size) batches -> (item, bin, offset, held, open)."""

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0

        def block(parts):
            nonlocal made
            items, sizes = (np.concatenate([b.column(c).to_numpy() for b in parts]) for c in ("item", "size"))
            bins, offsets, held = best_fit(sizes, capacity)
            unfinished = np.flatnonzero(held < capacity - SLACK)
            passed = np.zeros(len(held), bool)
            if not last:
                passed[unfinished[np.argsort(held[unfinished], kind="stable")][:most]] = True
            number = (task << 34) + made + np.arange(len(held))
            made += len(held)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (items, number[bins], offsets, held[bins], passed[bins])], ["item", "bin", "offset", "held", "open"])

        parts, rows = [], 0
        for batch in batches:
            parts.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK and not last:
                yield block(parts)
                parts, rows = [], 0
        if rows:
            yield block(parts)

    return run


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(item, size), item unique and 0 < size <= capacity -> (item, sequence_id, offset)."""
    n = items.count()
    tasks, level, done = max(1, -(-n // BLOCK)), 0, None
    while True:
        last = tasks == 1
        placed = keep(items.select("item", F.col("size").cast("long").alias("size")).repartition(tasks).mapInArrow(_pack(capacity, last, enough(tasks)), "item long, bin long, offset long, held long, open boolean"), "packed")
        number = F.col("bin") + (level << 58)
        if done is None:
            done = placed.select("item", number.alias("sequence_id"), "offset")
        else:
            up = placed.select(F.col("item").alias("sequence_id"), number.alias("__up"), F.col("offset").alias("__at"))
            done = done.join(up, "sequence_id", "left").select("item", F.coalesce("__up", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("__at", F.lit(0))).alias("offset"))
        if last:
            return done
        items = placed.where("open").groupBy(number.alias("item")).agg(F.max("held").alias("size"))
        tasks, level = -(-tasks // FAN_IN), level + 1


def _pieces(path: str | None, capacity: int, end: int):
    def run(batches):
        from depsift.llm.tokens import word_bpe

        encoder, tail = word_bpe(path), np.array([end], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for row, ids in enumerate(encoder.ids_of(t.as_py() for t in batch.column("__text"))):
                ids += tail
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((row, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            at, piece, start, length, crc = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def pack_documents(docs: DataFrame, *, id_col="doc_id", text_col="text", vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of all documents with the sequence and the offset that hold them."""
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    cut = rows.mapInArrow(_pieces(vocabulary, capacity, end), f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")
    pieces = keep(cut.withColumn("item", F.monotonically_increasing_id()), "pieces")
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -F.col("item") - 1, "offset": F.lit(0).cast("long")})
    rest = pieces.where(F.col("length") < capacity)
    packed = rest.join(pack(rest.select("item", F.col("length").alias("size")), capacity), "item")
    return full.unionByName(packed).drop("item")


def query(spark, sf_dir):
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = None
