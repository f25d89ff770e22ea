"""Scores' sums, and holdouts, of candidates with several columns on the left.

A level has thousands of candidates, so nothing of a pattern leaves the task that counts it
but its part of the sums that scores are made of.  Rows are dealt by few columns, once for all
candidates (``shapes`` says how), and a candidate is counted in one of three ways:

* where rows are dealt by a column that its left side determines, its patterns are whole;
* a left side of few values against a right side that determines the dealt column has whole
  counts there, and its patterns' rows, largest counts and sums of k ln k are added up;
* if both sides have few values, the cells of all counts are added up.

Left sides that tell the same rows apart are one side: a column that another determines
in all rows adds nothing, and columns that determine each other are one.  What a left side
determines is not counted, and patterns of one row are alike for every right side.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsift.operators.shapes import Column, _dealing
from depsift.settings import Settings

#: Most values of a left side whose patterns are added up, and most cells of such a side and a right side.
SIDE, SQUARE = 4096, 1 << 18
#: What is summed of a candidate's patterns; from the fifth on, weighted by rows.
SUMS = (
    "support_rows", "effective_support_rows", "n", "eff", "model_s_ent", "model_s_acc", "empirical_s_ent", "empirical_s_acc", "weighted_non_null_ratio",
    "expected_entropy", "expected_top1", "empirical_expected_entropy", "empirical_expected_top1",
)
_WHOLE, _ADDED, _CELLS = 0, 1, 2


@dataclass(frozen=True)
class Unit:
    """What is counted once: columns on the left by place, the one on the right, whether they
    determine it, and what its scores need: the support rule for high cardinality, and the right
    side's commonest share, entropy and least entropy to divide by."""

    left: tuple[int, ...]
    right: int
    pure: bool
    high: bool
    top1: float
    entropy: float
    norm: float


@dataclass
class Dealing:
    """Numbers of units that are counted where rows are dealt by ``lead``, by how they are."""

    lead: int
    ways: dict[int, list[int]] = field(default_factory=lambda: {_WHOLE: [], _ADDED: [], _CELLS: []})


def dealings(units: Sequence[Unit], known: Sequence[Column], implied: Sequence[frozenset[int]], leads: Sequence[int], many: int) -> tuple[list[Dealing], list[int]]:
    """How units are counted with few dealings, and the numbers of those that can't be.  ``implied``
    has the columns that each determines, itself included; leads with ``many`` values spread best."""
    spans = [len(c.values) + 1 for c in known]
    wide = lambda columns: any(known[c].high for c in columns)
    cells, choices = [], {}
    for i, u in enumerate(units):
        product = np.prod([float(spans[c]) for c in u.left])
        small = not wide(u.left) and product <= SIDE
        if small and not known[u.right].high and product * spans[u.right] <= SQUARE:
            cells.append(i)
            continue
        ways = {d: _WHOLE for d in leads if any(d in implied[c] for c in u.left)}
        if small:
            ways = {d: _ADDED for d in leads if d in implied[u.right] and not known[d].nulls} | ways
        choices[i] = ways
    chosen: list[Dealing] = []
    open_to = dict(choices)
    while open_to and (found := {d: sum(d in w for w in open_to.values()) for d in leads}) and max(found.values()):
        lead = max(found, key=lambda d: (found[d] > 0, len(known[d].values) >= many or known[d].high, found[d], -d))
        one = Dealing(lead)
        for i in [i for i, w in open_to.items() if lead in w]:
            one.ways[open_to.pop(i)[lead]].append(i)
        chosen.append(one)
    left_out = list(open_to)
    # Cells are counted wherever all rows are.
    if cells and not (place := next((x for x in chosen if not known[x.lead].nulls), None)):
        if place := next((Dealing(d) for d in leads if not known[d].nulls), None):
            chosen.append(place)
    if cells and place:
        place.ways[_CELLS] += cells
    elif cells:
        left_out += cells
    return chosen, sorted(left_out)


def _numbers(known: Sequence[Column]) -> Callable:
    """A column of dealt rows: numbers, how many there are, and the value of each; of the known
    ones by place, then null, then the others."""
    sizes, high, values = [len(c.values) for c in known], [c.high for c in known], [c.values for c in known]

    def run(parts: dict, at: int) -> tuple[np.ndarray, int, np.ndarray]:
        codes = np.concatenate(parts.pop(at)).astype(np.int64)
        own = np.append(values[at], 0)
        if high[at]:
            raw, beyond = np.concatenate(parts.pop(~at)), codes > sizes[at]
            distinct, which = np.unique(raw[beyond], return_inverse=True)
            codes[beyond] = which + sizes[at] + 1
            own = np.append(own, distinct)
        return codes, len(own), own

    return run


def _sides(known: Sequence[Column]) -> Callable:
    """The number of each row's left side, how many numbers there may be, and which rows have no null in it."""
    sizes, nulls = [len(c.values) for c in known], [c.nulls for c in known]

    def run(coded: dict, left: tuple[int, ...]) -> tuple[np.ndarray, int, np.ndarray | None]:
        code, space, whole = None, 1, None
        for at in left:
            own, span = coded[at][:2]
            if space * span >= 1 << 62:
                found, code = np.unique(code, return_inverse=True)
                space = len(found)
            code, space = own if code is None else code * span + own, space * span
            if nulls[at]:
                here = own != sizes[at]
                whole = here if whole is None else whole & here
        return code, space, whole

    return run


def _tools() -> SimpleNamespace:
    """What tasks use; made here, it is sent to them and need not be installed there."""

    def placed(code: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of numbers that rise from 0, and how many rows each has."""
        if space <= 4 * len(code) + 65536:
            n = np.bincount(code, minlength=1)
            place = np.cumsum(n > 0) - 1
            return place[code], n[n > 0]
        _, place, n = np.unique(code, return_inverse=True, return_counts=True)
        return place, n

    def counted(place: np.ndarray, right: np.ndarray, patterns: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of patterns, right sides and counts, by both."""
        both = place * span + right
        if patterns * span <= 4 * len(both) + 65536:
            k = np.bincount(both, minlength=1)
            cells = np.flatnonzero(k)
            return *np.divmod(cells, span), k[cells]
        both.sort()
        new = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
        return *np.divmod(both[new], span), np.diff(np.append(new, len(both)))

    def logs(k: np.ndarray) -> np.ndarray:
        """k ln k, 0 for 0."""
        k = k.astype(np.float64)
        return k * np.log(np.maximum(k, 1.0))

    def batch(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        units, ways, blobs = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(units, pa.int32()), pa.array(ways, pa.int32()), pa.array(blobs, pa.binary())], ["unit", "way", "rows"])

    def sums(unit: int, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([unit], pa.int32()), pa.array([sums.tolist()], pa.list_(pa.float64()))], ["unit", "sums"])

    return SimpleNamespace(placed=placed, counted=counted, logs=logs, batch=batch, sums=sums)


def _summing(s: Settings) -> Callable:
    """``score.core_scores`` up to its sums: of patterns' rows, valid rows, largest counts, sums
    of k ln k and how many have them."""
    least, floors = s.min_support_count, [(max(s.min_effective_support_count, x), max(s.min_pure_support_count, x)) for x in (0, s.high_card_min_effective_support_count)]
    purity, non_null, strength = s.min_row_purity, s.min_non_null_ratio, None if s.estimator == "empirical" else s.backoff_strength

    def run(u: Unit, n, eff, mx, kl, times=None) -> np.ndarray:
        floor, pure = floors[u.high]
        safe = np.maximum(eff, 1).astype(np.float64)
        top1, share = mx / safe, eff / n
        counts = (n >= least) | (eff >= floor) | ((top1 >= purity) & (eff >= pure))
        if non_null > 0:
            counts &= share >= non_null
        n, eff, safe, top1, share, kl = (x[counts] for x in (n, eff, safe, top1, share, kl))
        times = np.ones(len(n)) if times is None else times[counts].astype(np.float64)
        entropy = np.maximum(0.0, np.log(safe) - kl / safe)
        if strength is None:
            model_top1, model_entropy = top1, entropy
        else:
            others = np.maximum(eff - 1, 0).astype(np.float64)
            lean = strength / (others + strength)
            rest = np.where(others > 0, (top1 * eff - 1) / np.maximum(others, 1.0), 0.0)
            model_top1, model_entropy = (1 - lean) * rest + lean * u.top1, (1 - lean) * entropy + lean * u.entropy
        away = max(1 - u.top1, 1e-12)
        rows = n * times

        def gone(x):
            return rows @ np.clip(1 - x / u.norm, 0.0, 1.0)

        def right(x):
            return rows @ np.clip((x - u.top1) / away, 0.0, 1.0)

        sums = [times.sum(), times @ (eff > 0), rows.sum(), times @ eff, gone(model_entropy), right(model_top1)]
        sums += [gone(entropy), right(top1)] if strength is not None else sums[-2:]
        sums += [rows @ share, rows @ model_entropy, rows @ model_top1]
        sums += [rows @ entropy, rows @ top1] if strength is not None else sums[-2:]
        return np.array(sums)

    return run


def unit_sums(table: DataFrame, known: Sequence[Column], units: Sequence[Unit], dealing: Dealing, settings: Settings, tasks: int) -> DataFrame:
    """unit and the ``SUMS`` of its patterns as an array, of a dealing's units; ``known`` has the table's columns in order."""
    lead, units, do = dealing.lead, [SimpleNamespace(**vars(u)) for u in units], _tools()
    summed, number, side = _summing(settings), _numbers(known), _sides(known)
    sizes, nulls = [len(c.values) for c in known], [c.nulls for c in known]
    by_left: dict[int, dict[tuple, list[int]]] = {way: {} for way in dealing.ways}
    for way, some in dealing.ways.items():
        for i in some:
            by_left[way].setdefault(units[i].left, []).append(i)
    used = sorted({x for some in dealing.ways.values() for i in some for x in (*units[i].left, units[i].right)} - {lead})
    # A lead with nulls has left sides only that have it.
    deal, unpack = _dealing(list(known), lead, used, tasks, True)
    told = any(lead in (*units[i].left, units[i].right) for way in (_ADDED, _CELLS) for i in dealing.ways[way])
    spaces = {i: int(np.prod([sizes[c] + 1 for c in units[i].left])) for way in (_ADDED, _CELLS) for i in dealing.ways[way]}

    def whole(coded, left, some):
        code, space, ok = side(coded, left)
        rows = None if ok is None or ok.all() else np.flatnonzero(ok)
        place, n = do.placed(code if rows is None else code[rows], space)
        if not len(n):
            return
        alike, times = np.unique(n, return_counts=True)
        # Patterns of one row are alike for every right side without nulls.
        more = np.flatnonzero(n[place] > 1)
        again, n_again = (np.cumsum(n > 1) - 1)[place[more]], n[n > 1]
        at_rows = more if rows is None else rows[more]
        one, alone = np.ones(1, np.int64), np.array([len(n) - len(n_again)])
        for i in some:
            u = units[i]
            if u.pure:
                yield i, summed(u, alike, alike, alike, do.logs(alike), times)
                continue
            right, span, _ = coded[u.right]
            if nulls[u.right]:
                own, own_n = right if rows is None else right[rows], n
                a, b, k = do.counted(place, own, len(n), span)
                k = np.where(b == sizes[u.right], 0, k)
                begin = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                yield i, summed(u, own_n, np.add.reduceat(k, begin), np.maximum.reduceat(k, begin), np.add.reduceat(do.logs(k), begin))
                continue
            total = summed(u, one, one, one, np.zeros(1), alone) if alone[0] else 0.0
            if len(n_again):
                a, b, k = do.counted(again, right[at_rows], len(n_again), span)
                begin = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                total = total + summed(u, n_again, n_again, np.maximum.reduceat(k, begin), np.add.reduceat(do.logs(k), begin))
            yield i, total

    def count(batches):
        parts = unpack(batches)
        if not parts[~lead]:
            return
        values = np.concatenate(parts.pop(~lead))
        distinct, lead_at = np.unique(values, return_inverse=True)
        coded = {at: number(parts, at) for at in used}
        # Known values of a lead keep their numbers, which cells of other tasks have too.
        if told:
            place = np.searchsorted(known[lead].values, distinct)
            inside = place < sizes[lead]
            inside[inside] = known[lead].values[place[inside]] == distinct[inside]
            codes = np.where(inside, place, sizes[lead] + np.cumsum(~inside))
            coded[lead] = codes[lead_at], sizes[lead] + 1 + int((~inside).sum()), distinct
        else:
            coded[lead] = lead_at + sizes[lead] + 1, sizes[lead] + 1 + len(distinct), distinct
        out: list[tuple[int, int, bytes]] = []
        for left, some in by_left[_WHOLE].items():
            out += [(i, _WHOLE, x.tobytes()) for i, x in whole(coded, left, some)]
        for way in (_ADDED, _CELLS):
            for left, some in by_left[way].items():
                code, space, ok = side(coded, left)
                rows = None if ok is None else np.flatnonzero(ok)
                code = code if rows is None else code[rows]
                n = np.bincount(code, minlength=space) if way == _ADDED else None
                for i in some:
                    right, span, _ = coded[units[i].right]
                    right, null = right if rows is None else right[rows], sizes[units[i].right]
                    if way == _CELLS:
                        blob = np.bincount(code * span + right, minlength=space * span).tobytes()
                    else:
                        a, b, k = do.counted(code, right, space, span)
                        a, k = a[b != null], k[b != null]
                        begin = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
                        mx = np.zeros(space, np.int64)
                        mx[a[begin]] = np.maximum.reduceat(k, begin) if len(a) else 0
                        eff = np.bincount(a, k, space).astype(np.int64)
                        blob = b"".join(x.tobytes() for x in (n, eff, mx, np.bincount(a, do.logs(k), space)))
                    out.append((i, way, zlib.compress(blob, 1)))
            if sum(len(x[2]) for x in out) > 1 << 24:
                yield do.batch(out)
                out = []
        yield do.batch(out)

    def total(batches):
        now, way, held = -1, _WHOLE, None

        def done():
            u = units[now]
            if way == _WHOLE:
                return held
            if way == _CELLS:
                k = held.reshape(spaces[now], -1)
                n = k.sum(1)
                k = k[n > 0]
                k[:, sizes[u.right]] = 0
                return summed(u, n[n > 0], k.sum(1), k.max(1), do.logs(k).sum(1))
            n, eff, mx, kl = held
            return summed(u, *(x[n > 0] for x in (n, eff, mx, kl)))

        for batch in batches:
            for i, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i != now:
                    if held is not None:
                        yield do.sums(now, done())
                    now, way, held = i, kind, None
                if kind == _WHOLE:
                    got = np.frombuffer(blob, np.float64)
                    held = got if held is None else held + got
                elif kind == _CELLS:
                    got = np.frombuffer(zlib.decompress(blob), np.int64)
                    held = got.copy() if held is None else held + got
                else:
                    data, size = zlib.decompress(blob), 8 * spaces[i]
                    n, eff, mx = (np.frombuffer(data, np.int64, spaces[i], size * x) for x in range(3))
                    kl = np.frombuffer(data, np.float64, spaces[i], 3 * size)
                    held = (n, eff, mx, kl) if held is None else (held[0] + n, held[1] + eff, np.maximum(held[2], mx), held[3] + kl)
        if held is not None:
            yield do.sums(now, done())

    dealt = table.mapInArrow(deal, "part int, rows binary").repartitionById(tasks, F.col("part")).mapInArrow(count, "unit int, way int, rows binary")
    return dealt.repartitionById(tasks, F.col("unit") % tasks).sortWithinPartitions("unit").mapInArrow(total, "unit int, sums array<double>")


def held_out(table: DataFrame, known: Sequence[Column], lead: int, split: int, wanted: Sequence[tuple[int, Sequence[int], int]], tasks: int) -> DataFrame:
    """cand, all, n, ok of (number, left, right) that all have ``lead`` on the left: rows with a
    right side that the column ``split`` puts at 1, those whose pattern is among the rows at 0, and
    those that have its commonest right side there; ties go to the smaller value."""
    wanted, number, side, do = [(i, tuple(left), right) for i, left, right in wanted], _numbers(known), _sides(known), _tools()
    used = sorted({split, *(x for _, left, right in wanted for x in (*left, right))} - {lead})
    deal, unpack = _dealing(list(known), lead, used, tasks, True)
    sizes = [len(c.values) for c in known]

    def count(batches):
        parts = unpack(batches)
        if not parts[~lead]:
            return
        distinct, lead_at = np.unique(np.concatenate(parts.pop(~lead)), return_inverse=True)
        coded = {at: number(parts, at) for at in used}
        coded[lead] = lead_at + sizes[lead] + 1, sizes[lead] + 1 + len(distinct), distinct
        train = coded[split][0] == 0
        for i, left, at in wanted:
            code, space, ok = side(coded, left)
            right, span, values = coded[at]
            rank = np.argsort(np.argsort(values, kind="stable"), kind="stable")
            here = right != sizes[at] if ok is None else ok & (right != sizes[at])
            rows = np.flatnonzero(here)
            if not len(rows):
                continue
            place, n = do.placed(code[rows], space)
            own, first = rank[right[rows]], train[rows]
            common = np.full(len(n), -1)
            if first.any():
                a, b, k = do.counted(place[first], own[first], len(n), span)
                begin = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                most = np.repeat(np.maximum.reduceat(k, begin), np.diff(np.append(begin, len(k))))
                a, b = a[k == most], b[k == most]
                begin = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                common[a[begin]] = b[begin]
            told = common[place[~first]]
            counts = (len(told), int((told >= 0).sum()), int((told == own[~first]).sum()))
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([x], pa.int64()) for x in counts)], ["cand", "all", "n", "ok"])

    dealt = table.mapInArrow(deal, "part int, rows binary").repartitionById(tasks, F.col("part")).mapInArrow(count, "cand int, all long, n long, ok long")
    return dealt.groupBy("cand").agg(*(F.sum(c).alias(c) for c in ("all", "n", "ok")))
