"""Pattern statistics of all single-column candidates, without a shuffle of their counts.

Counts of a key against each other column are about as many as rows, for each of these
columns.  So rows are dealt instead, once for each column of many values: a task that has
all rows of a value counts it against all other columns at once.  What it hands on of a
pattern is its shape (rows, valid rows, largest count, sum of k ln k) and how many have it.

Values are split in two.  Those of columns with few values, nulls, and of other columns
those that fill more than 1 / ``SHARE`` of a chunk of rows, are known: they get codes.  The others
are dealt, so no task gets more than its share of them.  A count of two known values is a
cell of an array in the mappers.  A count with a dealt value is made where that value is;
for a known value on the other side it is a part of its pattern, and parts are added up.
Which values are known only decides where they are counted.

The dealt rows are packed as columns, a binary a chunk and task: a dealt value as its distance
from the least of the chunk, in as few bytes as that needs, and one or two bytes for a code.
Of a table of many rows a shuffle has a few of the other columns, so that it holds a part of
a row's bytes; it goes before the next comes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsift.operators.counts import CHUNK, _chunks
from depsift.operators.kept import keep, settle

#: Most values of a column that has a code for each, most cells of all such pairs of columns,
#: the share of a chunk that makes a value known, and rows that a task counts at once.
LOW, CELLS, SHARE, DEALT = 4096, 1 << 24, 64, 400_000
#: Rows up to which a column's rows are dealt whole, and bytes of a longer table's row dealt at once.
WHOLE, WIDE = 4_000_000, 20
_PARTS = "cand int, lhs int, n long, eff long, mx long, kl double, times long"


@dataclass
class Column:
    """The known values of a column; ``high`` if it has others, which are dealt."""

    values: np.ndarray
    nulls: bool
    high: bool

    @property
    def codes(self) -> int:
        return len(self.values) + self.nulls


def survey(table: DataFrame) -> tuple[int, dict[str, Column]]:
    """The number of rows, and what is known of each column."""
    chunks, low, share = _chunks(CHUNK), LOW, SHARE

    def run(batches):
        for chunk in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.array([chunk.num_rows], pa.int64()), pa.array([False])], ["at", "v", "k", "over"])
            for at, column in enumerate(chunk.columns):
                found = pc.value_counts(column)
                values, k, over = found.field("values"), found.field("counts"), len(found) > low
                if over:
                    some = pc.or_(pc.greater_equal(k, chunk.num_rows // share), pc.is_null(values))
                    # A row without a count marks the column.
                    values, k = pa.concat_arrays([values.filter(some), pa.array([None], pa.int64())]), pa.concat_arrays([k.filter(some), pa.array([0], pa.int64())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), at, np.int32)), values, k, pa.array(np.full(len(k), over))], ["at", "v", "k", "over"])

    seen = keep(table.mapInArrow(run, "at int, v long, k long, over boolean").groupBy("at", "v").agg(F.sum("k").alias("k"), F.max("over").alias("over")), "survey")
    facts = {r["at"]: r for r in seen.groupBy("at").agg(F.sum("k").alias("rows"), F.count("v").alias("values"), F.max("over").alias("over"), F.max(F.col("v").isNull() & (F.col("k") > 0)).alias("nulls")).collect()}
    rows, few, codes, cells = (facts[-1]["rows"] if -1 in facts else 0), [], 0, 0
    for at in sorted((at for at in facts if at >= 0 and not facts[at]["over"]), key=lambda at: (facts[at]["values"], at)):
        own = facts[at]["values"] + facts[at]["nulls"]
        if facts[at]["values"] <= LOW and cells + codes * own <= CELLS:
            few, codes, cells = [*few, at], codes + own, cells + codes * own
    values: dict[int, list[int]] = {at: [] for at in facts}
    for r in seen.where(F.col("v").isNotNull() & (F.col("at").isin(few) | ((F.col("at") >= 0) & (F.col("k") >= max(2, rows // SHARE))))).select("at", "v").collect():
        values[r["at"]].append(r["v"])
    empty = Column(np.zeros(0, np.int64), False, False)
    return rows, {c: Column(np.array(sorted(values[at]), np.int64), facts[at]["nulls"], at not in few) if at in facts else empty for at, c in enumerate(table.columns)}


def _coder(columns: Sequence[Column]) -> Callable:
    """Codes of the columns of a chunk: known values by place, then null, then others."""
    sets = [pa.array([*map(int, c.values), None], pa.int64()) for c in columns]

    def run(chunk: pa.Table, at: int) -> np.ndarray:
        last = len(sets[at])
        found = pc.fill_null(pc.index_in(chunk.column(at), value_set=sets[at]), last)
        return found.to_numpy().astype(np.uint8 if last < 256 else np.uint16)

    return run


def _logs() -> Callable:
    """k ln k, 0 for 0."""

    def run(k: np.ndarray) -> np.ndarray:
        k = k.astype(np.float64)
        return k * np.log(np.maximum(k, 1.0))

    return run


def _records() -> Callable:
    names = ["cand", "lhs", "n", "eff", "mx", "kl", "times"]

    def run(cand: int, lhs, n, eff, mx, kl, times) -> pa.RecordBatch:
        kinds = (np.int32, np.int32, np.int64, np.int64, np.int64, np.float64, np.int64)
        columns = (np.full(len(n), cand), lhs, n, eff, mx, kl, times)
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x).astype(t)) for x, t in zip(columns, kinds, strict=True)], names)

    return run


def _known_parts(table: DataFrame, known: list[Column], pairs: list[tuple[int, int, int, int]], tasks: int) -> DataFrame:
    """Parts of patterns from counts of known values.  A pair is (column, column, number of
    first -> second, number of second -> first)."""
    chunks, code, logs, records = _chunks(CHUNK), _coder(known), _logs(), _records()
    # Others have a code too, the last, which is cut away where the column has any.
    widths, sizes = [len(c.values) + 1 for c in known], [len(c.values) for c in known]
    high = [c.high for c in known]
    used = sorted({x for p in pairs for x in p[:2]})

    def count(batches):
        cells = [np.zeros(widths[i] * widths[j], np.int32) for i, j, *_ in pairs]
        for chunk in chunks(batches):
            codes = {at: code(chunk, at) for at in used}
            inside = {at: codes[at] < widths[at] for at in used if high[at]}
            for number, (i, j, *_) in enumerate(pairs):
                x, y = codes[i], codes[j]
                both_known = inside[i] & inside[j] if i in inside and j in inside else inside.get(i, inside.get(j))
                if both_known is not None:
                    x, y = x[both_known], y[both_known]
                cells[number] += np.bincount(x.astype(np.int64) * widths[j] + y, minlength=len(cells[number])).astype(np.int32)
        for number, k in enumerate(cells):
            at = np.flatnonzero(k).astype(np.uint32)
            if len(at):
                packed = np.diff(at, prepend=np.uint32(0)).tobytes() + k[at].astype(np.uint32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([zlib.compress(packed, 1)], pa.binary())], ["pair", "cells"])

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(zlib.decompress(packed), np.uint32).reshape(2, -1)
                i, j, *_ = pairs[number]
                if number not in sums:
                    sums[number] = np.zeros(widths[i] * widths[j], np.int64)
                sums[number][np.cumsum(got[0], dtype=np.int64)] += got[1]
        for number in sorted(sums):
            i, j, forward, back = pairs[number]
            both = sums.pop(number).reshape(widths[i], widths[j])
            for cand, k, own, other in ((forward, both, sizes[i], sizes[j]), (back, both.T, sizes[j], sizes[i])):
                if cand >= 0:
                    n, valid = k[:own].sum(1), k[:own, :other]
                    lhs = np.flatnonzero(n)
                    mx = valid.max(1, initial=0)
                    yield records(cand, lhs, n[lhs], valid.sum(1)[lhs], mx[lhs], logs(valid).sum(1)[lhs], np.ones(len(lhs)))

    return table.mapInArrow(count, "pair int, cells binary").repartitionById(tasks, F.col("pair") % tasks).mapInArrow(total, _PARTS)


def _dealing(known: list[Column], lead: int, others: Sequence[int], tasks: int, every: bool) -> tuple[Callable, Callable]:
    """Functions that pack rows for the tasks of a column's values, and that unpack them there
    as the columns' numbers, by the column's.  ``every`` has known values dealt too."""
    chunks, code = _chunks(CHUNK), _coder(known)
    sizes, high = [len(c.values) for c in known], [c.high for c in known]
    kinds = [np.dtype(np.uint8 if n + 1 < 256 else np.uint16) for n in sizes]
    # A kind of None: the blob's head has the least of its numbers, and the bytes of each.
    layout = [(~lead, None)]
    for at in others:
        layout += [(at, kinds[at]), *([(~at, None)] if high[at] else [])]
    offsets = [np.dtype(x) for x in (np.uint8, np.uint16, np.uint32, np.uint64)]

    def numbers(chunk, at):
        return pc.fill_null(chunk.column(at), 0).to_numpy()

    def narrow(x):
        least = x.min()
        away = x.view(np.uint64) - least.view(np.uint64)
        most = int(away.max())
        return int(least), away.astype(next(kind for kind in offsets if most < 1 << 8 * kind.itemsize))

    def deal(batches):
        for chunk in chunks(batches):
            leads = code(chunk, lead)
            rows = np.flatnonzero(leads != sizes[lead] if every else leads > sizes[lead])
            if not len(rows):
                continue
            lead_values = numbers(chunk, lead)[rows]
            # Mixed, as whole numbers may have steps.
            mixed = lead_values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
            part = (mixed % np.uint64(tasks)).astype(np.uint16 if tasks < 65536 else np.uint32)
            order = np.argsort(part, kind="stable")
            rows, part = rows[order], part[order]
            head, columns = [], []
            for name, kind in layout:
                if kind is None:
                    least, column = narrow(numbers(chunk, ~name)[rows])
                    head += [least, column.itemsize]
                else:
                    column = code(chunk, name)[rows]
                columns.append(column)
            begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            ends = np.append(begin[1:], len(part))
            blobs = [np.array([y - x, *head], np.int64).tobytes() + b"".join(c[x:y].tobytes() for c in columns) for x, y in zip(begin, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[begin].astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "rows"])

    def unpack(batches):
        parts: dict = {name: [] for name, _ in layout}
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                at = 8 * (1 + 2 * sum(kind is None for _, kind in layout))
                n, *head = np.frombuffer(blob, np.int64, at // 8).tolist()
                for name, kind in layout:
                    if kind is None:
                        least, wide = head[:2]
                        column = np.frombuffer(blob, offsets[wide.bit_length() - 1], n, at)
                        parts[name].append((column.astype(np.uint64) + np.int64(least).view(np.uint64)).view(np.int64))
                        at, head = at + n * wide, head[2:]
                    else:
                        parts[name].append(np.frombuffer(blob, kind, n, at))
                        at += n * kind.itemsize
        return parts

    return deal, unpack


def _right_side(sizes: list[int], high: list[bool]) -> Callable:
    """Numbers of a dealt column's values: known ones by code, then null, then others; and how
    many there are."""

    def run(parts: dict, at: int, order: np.ndarray) -> tuple[np.ndarray, int]:
        right, span = np.concatenate(parts.pop(at))[order].astype(np.int64), sizes[at] + 1
        if high[at]:
            hashes, beyond = np.concatenate(parts.pop(~at))[order], right > sizes[at]
            distinct, which = np.unique(hashes[beyond], return_inverse=True)
            right[beyond] = which + sizes[at] + 1
            span += len(distinct)
        return right, span

    return run


def _shapes_of() -> Callable:
    """Shapes and how many patterns have each, from patterns' rows and their counts of a right
    side: places of patterns that rise from 0, counts, and counts without null."""
    logs = _logs()

    def run(n, a, k_valid):
        begin = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        # Rounded, so that equal counts in another order have one shape.
        eff, mx, sums = np.add.reduceat(k_valid, begin), np.maximum.reduceat(k_valid, begin), np.round(np.add.reduceat(logs(k_valid), begin), 10)
        mark = n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ eff.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) ^ mx.astype(np.uint64) * np.uint64(0x165667B19E3779F9) ^ sums.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        _, some, times = np.unique(mark, return_index=True, return_counts=True)
        return np.full(len(some), -1), n[some], eff[some], mx[some], sums[some], times

    return run


def _counted() -> Callable:
    """Places of patterns, right sides and counts, from a row's pattern and right side."""

    def run(place, right, span):
        cells = np.sort(place * span + right)
        new = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
        return *np.divmod(cells[new], span), np.diff(np.append(new, len(cells)))

    return run


def _dealt_parts(table: DataFrame, known: list[Column], lead: int, others: list[tuple[int, int, int]], tasks: int) -> DataFrame:
    """Shapes of the dealt values of a column, and parts of the patterns of known values on
    the other side.  Of the others: (column, number of lead -> it, number of it -> lead)."""
    sizes = [len(c.values) for c in known]
    logs, records, counted, shapes_of, right_side = _logs(), _records(), _counted(), _shapes_of(), _right_side(sizes, [c.high for c in known])
    deal, unpack = _dealing(known, lead, [at for at, *_ in others], tasks, False)

    def count(batches):
        parts = unpack(batches)
        if not parts[~lead]:
            return
        values = np.concatenate(parts.pop(~lead))
        order = np.argsort(values)
        values = values[order]
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        n = np.diff(np.append(first, len(values)))
        place = np.repeat(np.arange(len(first)), n)
        for at, forward, back in others:
            right, span = right_side(parts, at, order)
            a, b, k = counted(place, right, span)
            if forward >= 0:
                yield records(forward, *shapes_of(n, a, np.where(b == sizes[at], 0, k)))
            if back >= 0 and sizes[at]:
                coded = b < sizes[at]
                b, k = b[coded], k[coded]
                total, mx = np.bincount(b, k, sizes[at]), np.zeros(sizes[at], np.int64)
                np.maximum.at(mx, b, k)
                lhs = np.flatnonzero(total)
                yield records(back, lhs, total[lhs], total[lhs], mx[lhs], np.bincount(b, logs(k), sizes[at])[lhs], np.ones(len(lhs)))

    return table.mapInArrow(deal, "part int, rows binary").repartitionById(tasks, F.col("part")).mapInArrow(count, _PARTS)


def _groups(known: list[Column], others: list[tuple[int, int, int]], rows: int) -> list[list[tuple[int, int, int]]]:
    """The other columns of a dealt one, in groups of about as many bytes that are dealt one by one."""
    if rows <= WHOLE:
        return [others]
    width = {at: 1 + (len(known[at].values) >= 255) + 8 * known[at].high for at, *_ in others}
    groups: list[list[tuple[int, int, int]]] = [[] for _ in range(min(len(others), -(-sum(width.values()) // WIDE)))]
    for other in sorted(others, key=lambda x: -width[x[0]]):
        min(groups, key=lambda group: sum(width[at] for at, *_ in group)).append(other)
    return groups


def _wide_parts(table: DataFrame, known: list[Column], lead: int, sides: list[tuple[list[int], list[tuple[int, int]]]], tasks: int) -> DataFrame:
    """Shapes of left sides that have a column in common, whose rows are dealt by it once.
    Of the sides: the other columns on the left, and (number, column) of the right sides."""
    sizes = [len(c.values) for c in known]
    records, counted, shapes_of, right_side = _records(), _counted(), _shapes_of(), _right_side(sizes, [c.high for c in known])
    used = sorted({x for more, rights in sides for x in (*more, *(at for _, at in rights))})
    deal, unpack = _dealing(known, lead, used, tasks, True)

    def count(batches):
        parts = unpack(batches)
        if not parts[~lead]:
            return
        _, lead_at = np.unique(np.concatenate(parts.pop(~lead)), return_inverse=True)
        coded = {at: right_side(parts, at, slice(None)) for at in used}
        for more, rights in sides:
            left, whole = lead_at, None
            for at in more:
                # Numbered anew, as the product of all spans may be beyond 64 bits.
                if left is not lead_at:
                    _, left = np.unique(left, return_inverse=True)
                left = left * coded[at][1] + coded[at][0]
                known_here = coded[at][0] != sizes[at]
                whole = known_here if whole is None else whole & known_here
            rows = np.flatnonzero(whole)
            if not len(rows):
                continue
            rows = rows[np.argsort(left[rows])]
            left = left[rows]
            first = np.flatnonzero(np.append(True, left[1:] != left[:-1]))
            n = np.diff(np.append(first, len(left)))
            place = np.repeat(np.arange(len(first)), n)
            for number, at in rights:
                right, span = coded[at]
                a, b, k = counted(place, right[rows], span)
                yield records(number, *shapes_of(n, a, np.where(b == sizes[at], 0, k)))

    return table.mapInArrow(deal, "part int, rows binary").repartitionById(tasks, F.col("part")).mapInArrow(count, _PARTS)


def wide_shapes(table: DataFrame, wanted: Sequence[tuple[Sequence[str], str]], leads: Sequence[str]) -> DataFrame:
    """``pattern_shapes`` of left sides of several columns; each has the first of ``leads`` that
    it contains dealt, so that should be a column without very frequent values."""
    rows, facts = survey(table)
    names = list(facts)
    known, at = [facts[c] for c in names], {c: i for i, c in enumerate(names)}
    spark = table.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // DEALT))
    groups: dict[str, dict[tuple, list]] = {}
    for i, (lhs, rhs) in enumerate(wanted):
        lead = next(c for c in leads if c in lhs)
        groups.setdefault(lead, {}).setdefault(tuple(at[c] for c in lhs if c != lead), []).append((i, at[rhs]))
    found = None
    for lead, sides in groups.items():
        part = keep(_wide_parts(table, known, at[lead], [(list(more), rights) for more, rights in sides.items()], tasks), "parts")
        found = part if found is None else found.unionByName(part)
    return found.drop("lhs")


def pattern_shapes(table: DataFrame, wanted: Sequence[tuple[Sequence[str], str]], surveyed: tuple[int, dict[str, Column]] | None = None) -> tuple[int, DataFrame]:
    """The number of rows, and cand, n, eff, mx, kl, times of all (lhs column, rhs) over a
    table of hashed columns that is read several times: how many patterns of a candidate,
    numbered by its place, have how many rows, rows with a right side, rows with the
    commonest one, and sum of k ln k over counts.  Rows with a null on the left are left out.
    ``surveyed`` is the table's ``survey``, if it is known, or that of a table that has its rows."""
    rows, facts = surveyed or survey(table)
    names = list(facts)
    known, at = [facts[c] for c in names], {c: i for i, c in enumerate(names)}
    number = {(at[lhs[0]], at[rhs]): i for i, (lhs, rhs) in enumerate(wanted)}
    spark = table.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // DEALT))
    pairs = sorted({(min(p), max(p)) for p in number})
    cells = [(i, j, number.get((i, j), -1), number.get((j, i), -1)) for i, j in pairs if known[i].codes and known[j].codes]
    parts = [keep(_known_parts(table, known, cells, tasks), "parts")] if cells else []
    for lead in (i for i, c in enumerate(known) if c.high):
        others = [(j, number.get((lead, j), -1), number.get((j, lead), -1) if len(known[j].values) else -1) for j in range(len(known))]
        if others := [x for x in others if x[0] != lead and max(x[1:]) >= 0]:
            for group in _groups(known, others, rows):
                used = [lead, *(j for j, *_ in group)]
                some = table.select(*("`" + names[j].replace("`", "``") + "`" for j in used))
                parts.append(keep(_dealt_parts(some, [known[j] for j in used], 0, [(i, *x[1:]) for i, x in enumerate(group, 1)], tasks), "parts"))
                settle(spark)
    if not parts:
        return rows, spark.createDataFrame([], _PARTS).drop("lhs")
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    added = found.where("lhs >= 0").groupBy("cand", "lhs").agg(F.sum("n").alias("n"), F.sum("eff").alias("eff"), F.max("mx").alias("mx"), F.sum("kl").alias("kl"), F.lit(1).cast("long").alias("times"))
    return rows, found.where("lhs < 0").drop("lhs").unionByName(added.drop("lhs"))


def shape_stats(shapes: DataFrame) -> DataFrame:
    """cand, n, eff, entropy, top1, non_null_ratio as ``counts.pattern_stats`` has them, and
    how many patterns have them."""
    return shapes.select(
        "cand", "n", "eff",
        F.when(F.col("eff") > 0, F.greatest(F.lit(0.0), F.log(F.col("eff").cast("double")) - F.col("kl") / F.col("eff"))).otherwise(0.0).alias("entropy"),
        F.when(F.col("eff") > 0, F.col("mx") / F.col("eff")).otherwise(0.0).alias("top1"),
        (F.col("eff") / F.col("n")).alias("non_null_ratio"), "times",
    )


def shape_marginals(shapes: DataFrame, wanted: Sequence[tuple[Sequence[str], str]], rows: int) -> DataFrame:
    """``counts.marginal_stats`` of the columns on the left: the rows of a candidate's
    patterns are those of the values of its left side."""
    first = {}
    for i, (lhs, _) in enumerate(wanted):
        first.setdefault(lhs[0], i)
    spark = shapes.sparkSession
    names = spark.createDataFrame([(i, c) for c, i in first.items()], "cand int, column string")
    n, times = F.col("n").cast("double"), F.col("times")
    total = shapes.groupBy("cand").agg(F.sum(F.col("n") * times).alias("valid"), F.sum(times).alias("vocabulary"), F.max("n").alias("mx"), F.sum(n * F.log(n) * times).alias("kl"))
    some = total.join(F.broadcast(names), "cand", "right").na.fill(0, ["valid", "vocabulary"])
    known = F.col("valid") > 0
    return some.select(
        "column", F.lit(rows).cast("long").alias("total"), "valid", "vocabulary",
        F.when(known, F.log(F.col("valid").cast("double")) - F.col("kl") / F.col("valid")).otherwise(0.0).alias("entropy"), F.when(known, F.col("mx") / F.col("valid")).otherwise(0.0).alias("top1"),
    )


def marginal_profile(marginals: DataFrame) -> DataFrame:
    """``profile.column_stats`` from marginals: null is one value."""
    nulls = F.col("total") - F.col("valid")
    unique = F.col("vocabulary") + F.when(nulls > 0, 1).otherwise(0)
    return marginals.select(
        "column", F.col("total").alias("rows"), unique.alias("unique_count"), (unique / F.col("total")).alias("unique_ratio"),
        (F.greatest(F.round(F.col("top1") * F.col("valid")), nulls.cast("double")) / F.col("total")).alias("marginal_top1"),
    )
