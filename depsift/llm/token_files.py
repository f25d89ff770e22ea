r"""Token ids in binary files with Elias-Fano document boundaries (op 7).

A file holds the ids of a run of documents in doc_id order, one after another:

    magic "DSTK0001"
    header   8 integers of 64 bits: documents, ids, rows without an id, least doc_id,
             bytes of the three parts that follow, bytes of one token id
    ends     Elias-Fano code of the position after each document's last id
    doc_ids  Elias-Fano code of doc_id - least doc_id
    ids      little-endian unsigned integers, 16 bits if the vocabulary allows it

An Elias-Fano code of n rising numbers below u keeps the low log2(u / n) bits of each
in an array and the high bits in unary: about 2 + log2(u / n) bits a number.  The
place of every 256th one bit is stored, so number i is found by looking at a few
bytes: ``EliasFano.select``.

Rows are range-partitioned by doc_id and sorted, so file numbers follow doc_ids.  A
task opens a new file after ``FILE_IDS`` ids.  It writes to a name of its own and
renames, so a repeated task replaces what a lost one wrote, and only files of the
table of finished files are read back.

Documents are read back one by one: where each ends is selected from the code, so a
reader holds no table of offsets.

Defined cases: a null or empty text is the end id alone; a text of any length is one
document of one file; rows with the same doc_id, repeated rows among them, follow one
another, in any order; rows without doc_id come first; no rows, no files.  Other columns
are not read, whatever their names.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depsift.llm.shared import keep, scratch, ship

MAGIC = b"DSTK0001"
END, FILE_IDS, STEP = 2, 1 << 22, 256


class EliasFano:
    """A code of ``n`` numbers that never fall."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, marks: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.marks = np.frombuffer(marks, "<u4")

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, low.tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::STEP].astype("<u4").tobytes())

    def to_bytes(self) -> bytes:
        parts = [x.tobytes() for x in (self.low, self.high, self.marks)]
        return np.array([self.n, self.low_bits, *map(len, parts)], "<i8").tobytes() + b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, low_bits, *sizes = np.frombuffer(raw[:40], "<i8").tolist()
        ends = 40 + np.cumsum([0, *sizes])
        return cls(n, low_bits, *(raw[a:b] for a, b in zip(ends, ends[1:], strict=False)))

    def _low(self, i: int) -> int:
        a, b = i * self.low_bits, (i + 1) * self.low_bits
        word = int.from_bytes(self.low[a // 8 : -(-b // 8)].tobytes(), "little")
        return word >> a % 8 & (1 << self.low_bits) - 1

    def select(self, i: int) -> int:
        """Number i, from the stored place before it on."""
        at, left = int(self.marks[i // STEP]), i % STEP
        byte = at // 8
        seen = int(self.high[byte]) >> at % 8 << at % 8
        while (ones := seen.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            seen = int(self.high[byte])
        for _ in range(left):
            seen &= seen - 1
        place = 8 * byte + (seen & -seen).bit_length() - 1
        return place - i << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        """All numbers, as 64-bit integers."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.uint64)
        return high + (bits << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)


def encode_file(doc_ids: list[int | None], counts: list[int], ids: bytes, width: int) -> bytes:
    """One file; ``ids`` are little-endian 32-bit integers, ``doc_ids`` rise, nulls first."""
    missing = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[missing:], np.int64)
    least = int(known[0]) if len(known) else 0
    ends = EliasFano.of(np.cumsum(counts)).to_bytes()
    names = EliasFano.of(known.astype(np.uint64) - np.uint64(least & (1 << 64) - 1)).to_bytes()
    body = np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()
    head = np.array([len(counts), sum(counts), missing, least, len(ends), len(names), len(body), width], "<i8")
    return b"".join((MAGIC, head.tobytes(), ends, names, body))


class TokenFile:
    """Reads what ``encode_file`` wrote."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token file")
        head = np.frombuffer(raw[8:72], "<i8").tolist()
        self.documents, self.tokens, self.missing, self.least, a, b, c, width = head
        self.ends = EliasFano.from_bytes(raw[72 : 72 + a])
        self.names = EliasFano.from_bytes(raw[72 + a : 72 + a + b])
        self.ids = np.frombuffer(raw, f"<u{width}", count=self.tokens, offset=72 + a + b)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.missing + (self.names.all() + np.uint64(self.least & (1 << 64) - 1)).astype(np.int64).tolist()

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def _writer(folder: str, vocabulary: str | None, end: int):
    def run(batches):
        from depsift.llm.tokens import byte_bpe

        encoder, tail, context = byte_bpe(vocabulary), np.array([end], "<u4").tobytes(), TaskContext.get()
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4
        store, root = fs.FileSystem.from_uri(folder)
        doc_ids: list = []
        counts: list[int] = []
        parts: list[bytes] = []
        number = 0

        def close():
            nonlocal number
            name = f"{context.partitionId():08d}-{number:06d}.tok"
            raw = encode_file(doc_ids, counts, b"".join(parts), width)
            own = f"{root}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                out.write(raw)
            store.move(own, f"{root}/{name}")
            row = pa.RecordBatch.from_pydict({"file": [name], "documents": [len(counts)], "ids": [sum(counts)]})
            number += 1
            doc_ids.clear(), counts.clear(), parts.clear()
            return row

        held = 0
        for batch in batches:
            texts = encoder.ids_of(t.as_py() for t in batch.column("__text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                ids += tail
                doc_ids.append(doc_id), counts.append(len(ids) // 4), parts.append(ids)
                held += counts[-1]
                if held >= FILE_IDS:
                    yield close()
                    held = 0
        if counts:
            yield close()

    return run


def write_tokens(docs: DataFrame, folder: str, *, id_col="doc_id", text_col="text", vocabulary: str | None = None, end: int = END) -> DataFrame:
    """Write all documents; return the finished files: file, documents, ids."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return keep(rows.mapInArrow(_writer(folder, vocabulary, end), "file string, documents long, ids long"), "files")


def _reader(batches):
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            file = TokenFile(content.as_py())
            starts, counts, crcs, start = array("q"), array("q"), array("q"), 0
            for i in range(file.documents):
                end = file.ends.select(i)
                starts.append(start), counts.append(end - start)
                crcs.append(zlib.crc32(file.ids[start:end].astype("<u4").tobytes()))
                start = end
            columns = (pa.array(np.frombuffer(x, np.int64)) for x in (starts, counts, crcs))
            names = pa.array([os.path.basename(path)] * file.documents)
            yield pa.RecordBatch.from_arrays([names, pa.array(file.doc_ids(), pa.int64()), *columns], ["__file", "doc_id", "__start", "n_tokens", "ids_crc32"])


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """A row a document from the files that ``write_tokens`` listed."""
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before = keep(files.withColumn("__before", F.coalesce(F.sum("ids").over(order), F.lit(0))), "starts")
    found = files.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder)
    rows = found.select("path", "content").mapInArrow(_reader, "__file string, doc_id long, __start long, n_tokens long, ids_crc32 long")
    return rows.join(before.withColumnRenamed("file", "__file"), "__file").select("doc_id", (F.col("__before") + F.col("__start")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir):
    folder = f"{scratch(spark)}/tokens-{uuid.uuid4().hex}"
    files = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_tokens(files, folder)


SQL = None
