r"""Repeated passages removed with suffix arrays (op 2).

Every byte that a string of ``SPAN`` bytes covers goes, if that string also starts in
a document with a smaller doc_id.  Strings are those of the input.

A suffix array over all texts at once has no place on any one machine, so strings
are dealt to shards by their own content.  The least hash among the 31 substrings
of 20 bytes within a string is its key; equal strings have equal keys.  Following
strings of a document mostly share their key, so they form a segment, named by a
64-bit hash.  Keys of one document only are dropped before any text moves.  In all
documents but the first that have a segment, all of it goes.  Where a key has several
different segments, their texts (one of each) meet in a shard and are sorted by
induced sorting of their suffixes (``suffix_sort``); runs of suffixes whose permuted
common prefixes reach ``SPAN`` are one string each, and the smallest doc_id of the run
is where the string comes first.  What a segment's first document has to drop are the
strings that come from even earlier ones.

Names tell apart what is the same and what may differ: the sort sees one text of each
different segment of a key, and segments that are the same as a whole need no order.

Skew: a task that has a segment of several documents keeps one row for the key, that of
the least doc_id; the others are known to have an earlier document, go to any task and
meet nothing.  So a passage that a third of all documents have is a row a task and
``HELD`` rows.  A shard is sorted a chunk of ``CHUNK`` bytes at a time, cut between keys.
A key with more than ``MOST`` different segments (one string of ``GRAM`` bytes in very
many surroundings) is not for one task: the strings of its segments become rows, and the
least doc_id of each is found by an aggregate and a join over the strings themselves.
Texts are shuffled twice: to cut segments out of them, and to remove what was found.

Defined cases: a null text counts as empty; texts under ``SPAN`` bytes keep all; a text
of any length is read whole, by itself if it is longer than ``READ``; rows with the same
doc_id, repeated rows among them, are looked at each and remove nothing from one
another; a null doc_id is below all others; an empty table gives an empty one.  Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsift.llm.shared import keep, settle, ship
from depsift.llm.suffix_sort import permuted_common, suffix_array

SPAN, GRAM = 50, 20
WINDOW = SPAN - GRAM + 1
#: Bytes of text that are read, and sorted, at once (one document or key at least).
READ, CHUNK = 1 << 18, 1 << 21
#: Rows of segments that a task looks at before it hands them on; different segments of a
#: key that are sorted together at most.
HELD, MOST = 1 << 18, 1 << 13
NULL_ID = -(1 << 63)
#: Keys are not negative; numbers below 0 take their place in rows that meet nothing.
KEY_BITS = (1 << 63) - 1
_U = np.uint64


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of all substrings of ``GRAM`` bytes."""
    n = len(raw) - GRAM + 1
    first, second = (np.ndarray((n,), "<u8", raw, offset=k, strides=(1,)) for k in (0, 8))
    third = np.ndarray((n,), "<u4", raw, offset=16, strides=(1,))
    h = first * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(29)
    h += second * _U(0xC2B2AE3D27D4EB4F)
    h ^= h >> _U(32)
    h += third * _U(0x165667B19E3779F9)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h * _U(0xA0761D6478BD642F)


def least_in_windows(h: np.ndarray) -> np.ndarray:
    """The least of every ``WINDOW`` values in a row, by doubling."""
    out, width = h, 1
    while 2 * width <= WINDOW:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = WINDOW - width
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def segments(raws: list[bytes]) -> tuple[np.ndarray, ...]:
    """(document, start, strings, key, name) of the segments of several texts."""
    ends = np.cumsum([len(r) for r in raws])
    whole = np.frombuffer(b"".join(raws), np.uint8)
    if len(whole) < SPAN:
        return (np.empty(0, np.int64),) * 5
    h = gram_hashes(whole)
    key = least_in_windows(h)
    doc = np.repeat(np.arange(len(raws)), [len(r) for r in raws])[: len(key)]
    inside = np.arange(len(key)) + SPAN <= ends[doc]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    at = first[inside[first]]
    # Strings of a document are followed by the places that cross its end.
    stop = np.minimum(np.append(first, len(key))[np.searchsorted(first, at) + 1], ends[doc[at]] - SPAN + 1)
    # The name depends on all substrings of GRAM bytes and on their places in the segment.
    one = np.concatenate([np.zeros(1, _U), np.cumsum(h)])
    two = np.concatenate([np.zeros(1, _U), np.cumsum(h * (2 * np.arange(len(h), dtype=_U) + _U(1)))])
    a, b = at, stop + SPAN - GRAM
    flat = one[b] - one[a]
    name = (two[b] - two[a]) - _U(2) * a.astype(_U) * flat
    name = (name ^ (name >> _U(31))) * _U(0x9E3779B97F4A7C15) + flat
    name = (name ^ (name >> _U(29))) * _U(0xBF58476D1CE4E5B9) + (b - a).astype(_U)
    name ^= name >> _U(32)
    starts = at - np.concatenate([[0], ends[:-1]])[doc[at]]
    return doc[at], starts, stop - at, key[at].view(np.int64) & KEY_BITS, name.view(np.int64)


def _read(batch: pa.RecordBatch, column: str):
    """Slices of a batch with about ``READ`` bytes of text, and these texts."""
    texts = batch.column(column)
    start, size, raws = 0, 0, []
    for i, text in enumerate(texts):
        raws.append(text.as_buffer().to_pybytes() if text.is_valid else b"")
        size += len(raws[-1])
        if size >= READ:
            yield batch.slice(start, i + 1 - start), raws
            start, size, raws = i + 1, 0, []
    if raws:
        yield batch.slice(start), raws


def _keys(batches):
    """A row for each segment and document of some texts; of a segment that several have,
    all but that with the least id get a number below 0 for their key."""
    held: list[tuple] = []

    def hand_on():
        key, name, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((ids, name, key))
        key, name, ids = key[order], name[order], ids[order]
        same = np.zeros(len(key), bool)
        same[1:] = (key[1:] == key[:-1]) & (name[1:] == name[:-1])
        new = ~same
        new[1:] |= ids[1:] != ids[:-1]
        key = np.where(same, (name ^ ids * np.int64(0x5851F42D4C957F2D)) | np.int64(-1 << 63), key)
        return pa.RecordBatch.from_arrays([pa.array(x[new]) for x in (key, name, ids)], ["key", "name", "__id"])

    rows = 0
    for batch in batches:
        for part, raws in _read(batch, "__text"):
            doc, _, _, key, name = segments(raws)
            held.append((key, name, part.column("__id").to_numpy()[doc]))
            rows += len(key)
            if rows >= HELD:
                yield hand_on()
                rows = 0
    if held:
        yield hand_on()


def _shared(batches):
    """Of rows sorted by key, name and id: those whose segment an earlier document has
    (``sort`` false), and the first of each segment where the key has several (true)."""
    last, several, held = None, False, None  # the last row's key, name and first id; its key's state
    for batch in batches:
        key, name, ids = (batch.column(c).to_numpy() for c in ("key", "name", "__id"))
        if known := int(np.searchsorted(key, 0)):
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:known]) for x in (key, name, ids)), pa.array(np.zeros(known, bool))], ["key", "name", "__id", "sort"])
        key, name, ids = key[known:], name[known:], ids[known:]
        n = len(key)
        if not n:
            continue
        new_key, new_name = np.ones(n, bool), np.ones(n, bool)
        new_key[1:] = key[1:] != key[:-1]
        new_name[1:] = new_key[1:] | (name[1:] != name[:-1])
        if last is not None:
            new_key[0] = key[0] != last[0]
            new_name[0] = new_key[0] or name[0] != last[1]
        starts = np.flatnonzero(new_name)
        run = np.cumsum(new_name) - 1
        first_id = np.where(run < 0, last[2] if last is not None else 0, ids[starts[np.maximum(run, 0)]] if len(starts) else 0)
        whole = ids != first_id
        group = np.cumsum(new_key)  # 0: the key of the batch before
        names = np.bincount(group[starts], minlength=int(group[-1]) + 1)
        many = names > 1
        many[0] |= several or (last is not None and not new_key[0] and names[0] > 0)
        out = starts[many[group[starts]]]
        rows = [(key[whole], name[whole], ids[whole], False), (key[out], name[out], ids[out], True)]
        if held is not None and many[0]:
            rows.append((*(np.array([x], np.int64) for x in held), True))
            held = None
        if new_key.any():
            held = None  # of the key before, which had one segment only
        # The last key may go on: its only segment so far waits.
        several = bool(many[group[-1]])
        if not several and len(starts) and group[starts[-1]] == group[-1] and names[group[-1]] == 1:
            held = (key[starts[-1]], name[starts[-1]], ids[starts[-1]])
        last = (key[-1], name[-1], first_id[-1])
        k, m, i, sort = (np.concatenate([np.full(len(r[0]), r[3]) if c == 3 else r[c] for r in rows]) for c in range(4))
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(m), pa.array(i), pa.array(sort)], ["key", "name", "__id", "sort"])


def _wanted(batches):
    """key, name, text and id of the segments whose names are asked for, once a slice."""
    for batch in batches:
        for part, raws in _read(batch, "__text"):
            doc, start, strings, key, name = segments(raws)
            wanted = part.column("__names")
            offsets, values = np.asarray(wanted.offsets), wanted.values.to_numpy()
            ids = part.column("__id").to_pylist()
            bounds = np.searchsorted(doc, np.arange(len(raws) + 1))
            rows: dict = {}
            for i, raw in enumerate(raws):
                a, b = bounds[i], bounds[i + 1]
                hit = np.flatnonzero(np.isin(name[a:b], values[offsets[i] : offsets[i + 1]])) + a
                for m, k, p, n in zip(name[hit].tolist(), key[hit].tolist(), start[hit].tolist(), strings[hit].tolist(), strict=True):
                    rows[m] = (k, m, raw[p : p + n + SPAN - 1], ids[i])
            yield list(rows.values())


def _cut(batches):
    """The texts of segments that are to be sorted."""
    for rows in _wanted(batches):
        keys, names, texts, firsts = zip(*rows, strict=True) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(names, pa.int64()), pa.array(texts, pa.binary()), pa.array(firsts, pa.int64())], ["key", "name", "segment", "first"])


def _strings(batches):
    """The strings of segments that are too many to be sorted together."""
    for rows in _wanted(batches):
        for _, name, text, first in rows:
            n = len(text) - SPAN + 1
            columns = [pa.array([text[p : p + SPAN] for p in range(n)], pa.binary()), pa.array([name] * n, pa.int64()), pa.array([first] * n, pa.int64()), pa.array(range(n), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["string", "name", "__id", "at"])


def _of_hot_keys(texts: DataFrame, names: DataFrame) -> DataFrame:
    """What ``_sort`` finds, for the segments of ``names``, string by string."""
    cut = texts.join(names.hint("merge"), "__id").select("__id", "__text", "__names")
    strings = keep(cut.mapInArrow(_strings, "string binary, name long, __id long, at long"), "strings")
    least = keep(strings.groupBy("string").agg(F.min("__id").alias("least"), F.max("__id").alias("most")).where("least < most"), "least")
    old = strings.join(least, "string").where("__id > least")
    return old.groupBy("name", "__id").agg(F.flatten(F.collect_list(F.array("at", F.lit(1).cast("long")))).alias("runs"))


def earlier(texts: list[bytes], first: np.ndarray) -> list[list[int]]:
    """For each text, [start, strings, ...] of the strings that some text with a smaller
    ``first`` holds."""
    sizes = np.array([len(t) for t in texts])
    whole = np.frombuffer(b"\xff".join(texts) + b"\xff\xfe", np.uint8)
    s = whole + np.uint8(2)  # UTF-8 has neither ff nor fe: ends become 1, the last byte 0
    order = suffix_array(s)
    prefix = permuted_common(s, order, SPAN)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    of = np.repeat(np.arange(len(texts) + 1), [*(sizes + 1), 1])
    valid = np.zeros(len(s), bool)
    for_all = np.arange(len(s))
    inside = of < len(texts)
    valid[inside] = for_all[inside] + SPAN <= begin[of[inside]] + sizes[of[inside]]
    run = np.cumsum(prefix[order] < SPAN)
    mine = valid[order]
    at, run = order[mine], run[mine]
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    least = np.minimum.reduceat(first[of[at]], starts) if len(at) else np.empty(0, np.int64)
    old = np.zeros(len(s) + 1, bool)
    old[at] = np.repeat(least, np.diff(starts, append=len(at))) < first[of[at]]
    step = np.diff(old.astype(np.int8), prepend=0)
    lows, highs = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    out: list[list[int]] = [[] for _ in texts]
    for a, b in zip(lows.tolist(), highs.tolist(), strict=True):
        t = int(of[a])
        out[t] += [a - int(begin[t]), b - a]
    return out


def _sort(batches):
    """Segments sorted by key and name -> the strings that earlier documents have, for
    the first document of each segment that has any."""
    rows: list[tuple] = []
    size = 0

    def flush():
        # One text of a segment is enough: it comes twice where a doc_id does.
        some = list({row[1]: row for row in rows}.values())
        runs = earlier([r[2] for r in some], np.array([r[3] for r in some], np.int64))
        found = [(r[1], r[3], x) for r, x in zip(some, runs, strict=True) if x]
        names, ids, lists = zip(*found, strict=True) if found else ((),) * 3
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(ids, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["name", "__id", "runs"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "name", "segment", "first")), strict=True):
            if size >= CHUNK and row[0] != rows[-1][0]:
                yield flush()
                rows, size = [], 0
            rows.append(row)
            size += len(row[2]) + 1
    if rows:
        yield flush()


def _remove(batches):
    for batch in batches:
        for part, raws in _read(batch, "__text"):
            out: dict = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            doc, start, strings, _, name = segments(raws)
            bounds = np.searchsorted(doc, np.arange(len(raws) + 1))
            whole = part.column("__whole").to_pylist()
            some = part.column("__some").to_pylist()
            for i, raw in enumerate(raws):
                a, b = bounds[i], bounds[i + 1]
                gone = np.zeros(len(raw) + 1, np.int32)
                if whole[i]:
                    hit = np.flatnonzero(np.isin(name[a:b], np.array(whole[i], np.int64))) + a
                    np.add.at(gone, start[hit], 1)
                    np.add.at(gone, start[hit] + strings[hit] + SPAN - 1, -1)
                if some[i]:
                    runs = {x["name"]: x["runs"] for x in some[i]}
                    for j in (np.flatnonzero(np.isin(name[a:b], np.array(list(runs), np.int64))) + a).tolist():
                        found = runs[int(name[j])]
                        for q, m in zip(found[::2], found[1::2], strict=True):
                            gone[start[j] + q] += 1
                            gone[start[j] + q + m + SPAN - 1] -= 1
                off = np.cumsum(gone[:-1]) > 0
                left = np.frombuffer(raw, np.uint8)[~off].tobytes()
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(int(off.sum()))
                out["n_spans"].append(int((np.diff(off.astype(np.int8), prepend=0) == 1).sum()))
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                out["kept"].append(left)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("__row"), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], ["__row", *out])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id with n_bytes, n_removed, n_spans, kept_sha256 and ``kept``, the
    remaining bytes."""
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("__row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("__id"), F.col(text_col).alias("__text"))
    texts = rows.select("__id", "__text")

    spark = docs.sparkSession
    keys = texts.mapInArrow(_keys, "key long, name long, __id long").repartition("key").sortWithinPartitions("key", "name", "__id")
    shared = keep(keys.mapInArrow(_shared, "key long, name long, __id long, sort boolean"), "shared")
    del keys
    settle(spark)

    sort = shared.where("sort").select("key", "name", "__id")
    hot = keep(sort.groupBy("key").agg(F.count_distinct("name").alias("n")).where(F.col("n") > MOST).select("key"), "hot")
    some_hot = not hot.isEmpty()
    names = (sort.join(hot, "key", "left_anti") if some_hot else sort).groupBy("__id").agg(F.collect_list("name").alias("__names"))
    cut = texts.join(names.hint("merge"), "__id").select("__id", "__text", "__names").mapInArrow(_cut, "key long, name long, segment binary, first long")
    ordered = cut.repartition("key").sortWithinPartitions("key", "name")
    some = keep(ordered.mapInArrow(_sort, "name long, __id long, runs array<long>"), "some")
    if some_hot:
        hot_names = sort.join(hot, "key", "left_semi").groupBy("__id").agg(F.collect_list("name").alias("__names"))
        some = some.unionByName(keep(_of_hot_keys(texts, hot_names), "some-hot"))
    del names, cut, ordered
    settle(spark)

    whole = shared.where("NOT sort").groupBy("__id").agg(F.collect_list("name").alias("__whole"))
    part = some.groupBy("__id").agg(F.collect_list(F.struct("name", "runs")).alias("__some"))
    found = whole.join(part, "__id", "full")
    out = rows.join(found.hint("merge"), "__id", "left").select("__row", "__text", "__whole", "__some")
    return out.mapInArrow(_remove, f"__row {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select(F.col("__row").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


SQL = None
