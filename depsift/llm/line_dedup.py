"""Line dedup by overlapping three-line windows (op 6).

The lines of a document that hold a word form windows of three lines in a row.  Each
window has a 128-bit hash.  For every hash that comes more than once, the first place
is the one in the document with the smallest doc_id, and there the first line; the
windows at all later places go.  The lines that removed windows cover are merged, so
overlapping windows take a passage out as a whole.

First places and counts are aggregated in the mappers before the shuffle, so a window
that a third of all documents share is a few rows; hashes that come once are dropped
there.  What is handed back is one short row for each document and repeated window,
by a sort-merge join that adaptive execution splits.  Texts are read twice and
shuffled once.

Defined cases: a null text counts as empty; lines without a word neither count nor go;
documents of fewer than three lines keep all; lines and texts are read whole, whatever
their length; rows with the same doc_id, repeated rows among them, stand at the same
places and remove nothing from one another there; a null doc_id is below all others; an
empty table gives an empty one.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsift.llm.shared import keep, settle, ship

LINES = 3
NULL_ID = -(1 << 63)


def windows(text: str | None) -> tuple[list[str], list[int], list[tuple[int, int]]]:
    """All lines, which of them hold a word, and the hash of each window of these."""
    lines = (text or "").split("\n")
    full = [i for i, line in enumerate(lines) if line.strip(" \t\n\x0b\x0c\r")]
    digests = [xxhash.xxh3_128_digest(lines[i].encode("utf-8", "surrogatepass")) for i in full]
    hashes = [struct.unpack("<qq", xxhash.xxh3_128_digest(b"".join(digests[p : p + LINES]))) for p in range(len(full) - LINES + 1)]
    return lines, full, hashes


def _emit(batches):
    for batch in batches:
        rows = [(a, b, d, p) for d, t in zip(batch.column("__id").to_pylist(), batch.column("__text"), strict=True) for p, (a, b) in enumerate(windows(t.as_py())[2])]
        columns = zip(*rows, strict=True) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "__id", "at"])


def _remove(batches):
    for batch in batches:
        out: list[tuple] = []
        for text, found in zip(batch.column("__text"), batch.column("__found"), strict=True):
            lines, full, hashes = windows(text.as_py())
            stays = {(x["a"], x["b"]): x["stays"] for x in found.as_py() or ()}
            gone = [False] * len(full)
            for p, h in enumerate(hashes):
                if h in stays and stays[h] != p:
                    gone[p : p + LINES] = [True] * LINES
            dropped = {i for i, g in zip(full, gone, strict=True) if g}
            kept = "\n".join(line for i, line in enumerate(lines) if i not in dropped)
            spans = sum(g and not before for g, before in zip(gone, [False, *gone], strict=False))
            out.append((len(full), len(dropped), spans, hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest(), kept))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("__row"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["__row", "n_lines", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id as ``__row`` with n_lines (lines with a word), n_removed, n_spans,
    kept_sha256 and ``kept``, the remaining text."""
    spark = docs.sparkSession
    ship(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("__row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("__id"), F.col(text_col).alias("__text"))
    places = keep(rows.select("__id", "__text").mapInArrow(_emit, "a long, b long, __id long, at long"), "windows")
    repeated = places.groupBy("a", "b").agg(F.min(F.struct("__id", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = places.select("a", "b", "__id").distinct().join(repeated, ["a", "b"])
    stays = F.when(F.col("__id") == F.col("first.__id"), F.col("first.at")).otherwise(F.lit(-1).cast("long"))
    found = keep(met.groupBy("__id").agg(F.collect_list(F.struct("a", "b", stays.alias("stays"))).alias("__found")), "found")
    settle(spark)
    out = rows.join(found.hint("merge"), "__id", "left").select("__row", "__text", "__found")
    return out.mapInArrow(_remove, f"__row {id_type}, n_lines long, n_removed long, n_spans long, kept_sha256 string, kept string")


def query(spark, sf_dir):
    """op6: doc_id, n_lines, n_removed, n_spans, kept_sha256 of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_lines(docs).select(F.col("__row").alias("doc_id"), "n_lines", "n_removed", "n_spans", "kept_sha256")


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT doc_id, p, line AS a, lead(line) OVER d AS b, lead(line, 2) OVER d AS c FROM n WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS k FROM w WHERE c IS NOT NULL),
g AS (SELECT DISTINCT doc_id, p + j AS p FROM f, (VALUES (0), (1), (2)) t(j) WHERE k > 1),
s AS (SELECT n.doc_id, n.i, n.p, g.p IS NOT NULL AS gone FROM n LEFT JOIN g USING (doc_id, p)),
t AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS span FROM s),
c AS (SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_removed, count_if(span)::BIGINT AS n_spans FROM t GROUP BY doc_id),
k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS kept FROM l LEFT JOIN s ON s.doc_id = l.doc_id AND s.i = l.i WHERE NOT coalesce(gone, false) GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""
