r"""N-gram Jaccard self-join with PartEnum signatures (op 10).

A document's set holds the 64-bit hashes of its distinct shingles: of four words, with
a similarity of 0.85, if the caller says nothing else.  Sets
are nodes, so equal sets are one node from the start and copies never meet.

Signatures.  Set sizes fall into bands; sets whose Jaccard similarity reaches the
threshold are in the same band or in neighbouring ones, so a set takes part in its
own band and, near the upper end, in the next.  Within a band with sizes up to r,
similar sets differ in at most k = 2 r (1 - s) / (1 + s) elements.  The hash domain
is cut into n1 parts, so that at least ``SPARE`` + 1 parts differ by one element at
most; each part is cut into three, and the three choices of two sub-parts are the
signatures of that part: one of them leaves the difference out, so it is the same
for both sets.  A choice of two empty sub-parts says nothing and is left out, which
is safe as long as a set has at most ``SPARE`` parts with such a choice (then
another of the agreeing parts is not empty); a set with more of them emits all.

Candidates.  Each set that shares a signature gets a parity sketch: a bit for each
bucket of hashes, telling whether it holds an odd number of elements.  Sets differ in
at least as many elements as their sketches differ in bits, so a pair whose sketches
differ in more than k bits is no link.  Sketches are compared within a signature's
group, in blocks of ``BLOCK`` sets, and what passes is checked on the whole sets, in
three rounds.  The first compares each block within itself and with the group's first
``LEADERS`` sets, in all n * (BLOCK + LEADERS) sketches for a group of n sets; each set
is checked with the first one that passes.  This joins nearly all that belongs together.
The second does so between the blocks of groups that still have several components,
the third checks all passing pairs whose sets are still in different ones.  In both, a
set meets only blocks that hold another component than its own; so a group of near
copies and m other sets costs about n * m sketches instead of n * n / 2, and no link
between different components is missed.  Only a group whose sets stay apart although
they share a signature is compared as a whole.

Shuffles: signature rows (hash, node, size) once, in parts if the caller says so; one map task emits each set once,
however many copies it has read; then rows of shared signatures with sketches.  Whole sets move for nodes
that are in a passing pair only.  Texts are read once for sets, once for signatures
and once a round for the sets of such nodes.

Defined cases: null text counts as empty; a document without words has no set and
is its own component; one with fewer words than a shingle has its whole sequence as
its only shingle; a text of any length gives all its shingles.  Rows with the same
doc_id, repeated rows among them, are rows of their own, and linked as their texts are.
An empty table gives an empty one.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depsift.llm.components import components
from depsift.llm.shared import keep, settle, ship

#: Words of a shingle; similarity as a fraction (op 10's query).
WORDS, NUM, DEN = 4, 85, 100
SPARE = 1
#: Sets of a signature's group that are compared at once.
BLOCK = 4096
#: Sets of a group that all others of it are compared with first.
LEADERS = 64
#: Bytes of text that a task holds as words at once (one document at least).
CHUNK = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finisher)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one text."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, _U)
    h = mix(np.fromiter(map(xxhash.xxh3_64_intdigest, found), _U, len(found)))
    n = min(words, len(found))
    total = np.full(len(found) - n + 1, n, _U)
    for k in range(n):
        total = mix(total * _U(0x9E3779B97F4A7C15) + h[k : len(found) - n + 1 + k])
    return np.unique(total)


@lru_cache(None)
def bands(upto: int, num: int = NUM, den: int = DEN) -> list[tuple[int, int, int]]:
    """(first size, last size, parts) of each band up to one that holds ``upto``."""
    out, first = [], 1
    while not out or out[-1][1] < upto:
        last = max(first, first * den * den // (num * num))
        k = 2 * last * (den - num) // (den + num)
        out.append((first, last, -(-(k + 1) // 2) + SPARE if k else 0))
        first = last + 1
    return out


def node_of(s: np.ndarray) -> int:
    """One number for a set, the same for equal sets."""
    raw = np.array([mix(s).sum(dtype=_U) if len(s) else _U(0), mix(s + _U(0x51ED270B)).sum(dtype=_U), _U(len(s))], _U)
    return xxhash.xxh3_64_intdigest(raw.tobytes()) - (1 << 63)


def _sums(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2^64 by place; halves of 32 bits are exact in doubles."""
    low = np.bincount(at, (values & _U(0xFFFFFFFF)).astype(np.float64), n)
    high = np.bincount(at, (values >> _U(32)).astype(np.float64), n)
    return low.astype(_U) + (high.astype(_U) << _U(32))


def signatures(sets: list[np.ndarray], num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of the set) for every signature of every set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if not len(sizes) or not sizes.max():
        return np.empty(0, _U), np.empty(0, np.int64)
    table = bands(int(sizes.max()) * den // num + 1, num, den)
    firsts, parts = (np.array([b[i] for b in table], np.int64) for i in (0, 2))
    own = np.searchsorted(firsts, sizes, "right") - 1
    up = np.minimum(own + 1, len(table) - 1)
    reach = (sizes * den // num >= firsts[up]) & (up > own) & (sizes > 0)
    out_sig, out_of = [], []
    for tag, chosen in ((own, np.flatnonzero((sizes > 0) & (parts[own] > 0))), (up, np.flatnonzero(reach & (parts[up] > 0)))):
        if not len(chosen):
            continue
        flat = np.concatenate([sets[i] for i in chosen])
        n1 = parts[tag[chosen]]
        base = np.concatenate([[0], np.cumsum(n1)])
        doc = np.repeat(np.arange(len(chosen)), sizes[chosen])
        place = mix(flat ^ _U(0xA24BAED4963EE407))
        part = ((place >> _U(32)) * n1[doc].astype(_U) >> _U(32)).astype(np.int64)
        third = ((place & _U(0xFFFFFFFF)) * _U(3) >> _U(32)).astype(np.int64)
        at, slots = (base[doc] + part) * 3 + third, 3 * int(base[-1])
        sums = _sums(mix(flat + _U(0x2545F4914F6CDD1D)), at, slots).reshape(-1, 3)
        held = np.bincount(at, minlength=slots).reshape(-1, 3)
        of = np.repeat(np.arange(len(chosen)), n1)
        number = np.arange(base[-1]) - base[of]
        empty = (held == 0) & (held[:, [1, 2, 0]] == 0)
        keep_empty = np.bincount(of, empty.any(1), len(chosen)) > SPARE
        for j in range(3):
            emit = ~empty[:, j] | keep_empty[of]
            head = mix(tag[chosen][of[emit]].astype(_U) << _U(40) | number[emit].astype(_U) << _U(2) | _U(j))
            a, b = sums[emit, j], sums[emit, (j + 1) % 3]
            out_sig.append(mix(mix(head + a) + mix(b + _U(1))))
            out_of.append(chosen[of[emit]])
    return (np.concatenate(out_sig), np.concatenate(out_of)) if out_sig else (np.empty(0, _U), np.empty(0, np.int64))


def _chunks(batch: pa.RecordBatch, column: str):
    """Slices of a batch that hold about ``CHUNK`` bytes of text."""
    sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)], np.int64) if batch.num_rows else np.empty(0, np.int64)
    cut = np.cumsum(sizes) // CHUNK
    starts = np.flatnonzero(np.diff(cut, prepend=-1))
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def _node_batches(words: int):
    def run(batches):
        for batch in batches:
            for part in _chunks(batch, "__text"):
                sets = [shingles(t, words) for t in part.column("__text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("__row"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([node_of(s) for s in sets], pa.int64()),
                        pa.array([sketch(s) if len(s) else b"" for s in sets], pa.binary()),
                    ],
                    ["__row", "__n", "__node", "__sketch"],
                )

    return run


def _signature_batches(words: int, num: int, den: int, part: int, parts: int):
    """The signatures whose remainder by ``parts`` is ``part``."""
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for piece in _chunks(batch, "__text"):
                if len(seen) > 1_000_000:
                    seen.clear()  # sets emitted again are told apart from others later
                fresh = {}
                for text in piece.column("__text").to_pylist():
                    s = shingles(text, words)
                    if len(s) and (node := node_of(s)) not in seen:
                        seen.add(node)
                        fresh[node] = s
                nodes, sets = np.fromiter(fresh, np.int64, len(fresh)), list(fresh.values())
                sig, of = signatures(sets, num, den)
                if parts > 1:
                    mine = sig % _U(parts) == _U(part)
                    sig, of = sig[mine], of[mine]
                sizes = np.array([len(s) for s in sets], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(nodes[of]), pa.array(sizes[of])], ["sig", "node", "n"])

    return run


def sketch(s: np.ndarray) -> bytes:
    """A parity bit for each of 2^j buckets of hashes, at least as many as elements."""
    bits = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((mix(s ^ _U(0x8CB92BA72F3D8DD7)) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _set_batches(words: int):
    def run(batches):
        for batch in batches:
            for part in _chunks(batch, "__text"):
                sets = [shingles(t, words) for t in part.column("__text").to_pylist()]
                flat = np.concatenate(sets) if sets else np.empty(0, _U)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([node_of(s) for s in sets], pa.int64()),
                        pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat.view(np.int64))).cast(pa.list_(pa.int64())),
                    ],
                    ["node", "shingles"],
                )

    return run


def _folded(sketches: list[bytes], words: int) -> np.ndarray:
    """Sketches as rows of ``words`` 64-bit words; longer ones fold onto that many buckets."""
    out = np.zeros((len(sketches), words), _U)
    for i, raw in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(raw, "<u8").reshape(-1, words), 0)
    return out


def _passing(key: np.ndarray, block: np.ndarray, node: np.ndarray, n: np.ndarray, c: np.ndarray, sketches: list[bytes], every: bool, num: int, den: int):
    """Pairs of rows with the same key that may be links: the first for each row, or
    every one in different components."""
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    group = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(key)))
    words = np.minimum.reduceat(np.array([len(x) // 8 for x in sketches]), starts)[group]
    two = block != block[starts][group]  # the second block of a pair of blocks
    paired = np.add.reduceat(two.astype(np.int64), starts)[group] > 0
    out_a, out_b = [], []
    for width in np.unique(words).tolist():
        rows = np.flatnonzero(words == width)
        x, g = _folded([sketches[i] for i in rows.tolist()], width), group[rows]
        best = np.full(len(rows), -1)
        alive, d = np.arange(len(rows)), 1
        while True:
            alive = alive[alive + d < len(rows)]
            alive = alive[g[alive] == g[alive + d]]
            if not len(alive):
                break
            i, j = rows[alive], rows[alive + d]
            size_a, size_b = n[i], n[j]
            near = (den * np.minimum(size_a, size_b) >= num * np.maximum(size_a, size_b)) & (c[i] != c[j]) & (~paired[i] | (two[i] != two[j]))
            p = alive[near]
            for q in np.array_split(p, max(1, len(p) * width >> 20)):
                differ = np.bitwise_count(x[q] ^ x[q + d]).sum(1, dtype=np.int64)
                ok = q[differ * (den + num) <= (n[rows[q]] + n[rows[q + d]]) * (den - num)]
                if every:
                    out_a.append(rows[ok])
                    out_b.append(rows[ok + d])
                else:
                    best[ok + d] = ok
            d += 1
        if not every:
            found = np.flatnonzero(best >= 0)
            out_a.append(rows[best[found]])
            out_b.append(rows[found])
    a, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (out_a, out_b))
    return np.unique(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])], 1), axis=0)


def _pair_batches(every: bool, num: int, den: int):
    def run(batches):
        held: pa.Table | None = None

        def compare(rows: pa.Table):
            rows = rows.combine_chunks()
            sig, lo, hi, block, node, n, c = (rows.column(x).to_numpy() for x in ("sig", "lo", "hi", "block", "node", "n", "c"))
            _, key = np.unique(np.stack([sig, lo, hi], 1), axis=0, return_inverse=True)
            order = np.lexsort((node, block, key))
            sketches = rows.column("sketch").to_pylist()
            pairs = _passing(key[order], block[order], node[order], n[order].astype(np.int64), c[order], [sketches[i] for i in order.tolist()], every, num, den)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            new = pa.Table.from_batches([batch])
            rows = new if held is None else pa.concat_tables([held, new])
            if not rows.num_rows:
                continue
            same = np.ones(rows.num_rows, bool)
            for x in ("sig", "lo", "hi"):
                v = rows.column(x).to_numpy()
                same &= v == v[-1]
            cut = rows.num_rows - int(np.argmin(same[::-1]) or (rows.num_rows if same.all() else 0))
            if cut:
                yield compare(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None and held.num_rows:
            yield compare(held)

    return run


def similar(pairs: DataFrame, sets: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """Of (a, b), the pairs of nodes whose sets reach the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    return pairs.join(left, "a").join(right, "b").where(den * both >= num * (F.size("x") + F.size("y") - both)).select("a", "b")


def _seats(rows: DataFrame) -> DataFrame:
    """Rows of groups with several components -> a row for each block they meet.  Ranks
    run along components, so most blocks of a large component hold nothing else, and a
    row stays away from the blocks that are wholly of its own component."""
    group = Window.partitionBy("sig")
    rows = rows.withColumn("rank", F.dense_rank().over(group.orderBy("c", "node")))
    own = Window.partitionBy("sig", "c")
    rows = rows.withColumns({"r0": F.min("rank").over(own), "r1": F.max("rank").over(own)})
    end = F.floor((F.col("last") - 1) / BLOCK).cast("int")
    first = F.ceil((F.col("r0") - 1) / BLOCK).cast("int")
    final = F.greatest(F.when(F.col("r1") == F.col("last"), end).otherwise(F.floor(F.col("r1") / BLOCK).cast("int") - 1), first - 1)
    none = F.array().cast("array<int>")
    before = F.when(first > 0, F.sequence(F.lit(0), first - 1)).otherwise(none)
    after = F.when(final < end, F.sequence(final + 1, end)).otherwise(none)
    rows = rows.withColumn("block", F.floor((F.col("rank") - 1) / BLOCK).cast("int")).withColumn("other", F.explode(F.concat(before, after)))
    return rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})


def links(parts: list[DataFrame], sketches: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int = NUM, den: int = DEN) -> DataFrame | None:
    """(sig, rank, node, n) of all signatures that two sets or more share, as tables of
    disjoint signatures -> (node, root) of linked sets, None if there are none.
    ``sets_of`` gets the sets of a table of nodes."""

    def passing(groups: DataFrame, step: str, roots: DataFrame | None) -> DataFrame:
        rows = groups.withColumn("c", F.col("node"))
        if roots is not None:
            rows = groups.join(roots, "node", "left").withColumn("c", F.coalesce("root", "node")).drop("root")
        size = rows.groupBy("sig").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.max("rank").alias("last"))
        size = size.where("c0 <> c1" if step != "blocks" else f"c0 <> c1 and last > {BLOCK}")
        rows = rows.join(size.select("sig", "last"), "sig")
        if step == "leaders":
            # A block is compared within itself and with the first sets of the group.
            block, end = (F.floor((F.col(x) - 1) / BLOCK).cast("int") for x in ("rank", "last"))
            rows = rows.withColumn("block", F.explode(F.when(F.col("rank") <= LEADERS, F.sequence(F.lit(0), end)).otherwise(F.array(block))))
            rows = rows.withColumns({"lo": F.col("block"), "hi": F.col("block")})
        else:
            rows = _seats(rows)
        rows = rows.join(sketches, "node").select("sig", "lo", "hi", "block", "node", "n", "c", "sketch")
        rows = rows.repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi")
        return rows.mapInArrow(_pair_batches(step == "every", num, den), "a long, b long").distinct()

    roots = checked = found = None
    for step in ("leaders", "blocks", "every"):
        pairs = None
        for groups in parts:
            new = keep(passing(groups, step, roots), "passing")
            settle(groups.sparkSession)
            pairs = new if pairs is None else pairs.unionByName(new)
        pairs = pairs.distinct()
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        pairs = keep(pairs, "pairs")
        checked = pairs if checked is None else checked.unionByName(pairs)
        if pairs.isEmpty():
            continue
        sets = sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        new = keep(similar(pairs, sets, num, den), "linked")
        found = new if found is None else found.unionByName(new)
        if not new.isEmpty():
            roots = keep(components(found), "roots")
    return roots


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: tuple[int, int] = (NUM, DEN), parts: int = 1) -> DataFrame:
    """A row for every row of ``docs``: its id as ``__row`` and a struct ``__near`` of
    n_shingles and component_id, the least id that links reach.  The id may be of any
    type that has an order.  Links are sets of ``words``-word shingles whose Jaccard
    similarity is the fraction ``similarity`` or more.  With ``parts`` above 1, signatures
    are shuffled and compared in that many parts, one after the other: the same rows with
    that much less on disk at once, for one more reading of the texts a part."""
    num, den = similarity
    ship(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("__text"))
    rows = docs.select(F.col(id_col).alias("__row"), F.col(text_col).alias("__text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    members = keep(rows.mapInArrow(_node_batches(words), f"__row {id_type}, __n long, __node long, __sketch binary"), "members")

    group = Window.partitionBy("sig")

    def groups(part: int) -> DataFrame:
        emitted = texts.mapInArrow(_signature_batches(words, num, den, part, parts), "sig long, node long, n int")
        shared = emitted.withColumns({"lo": F.min("node").over(group), "hi": F.max("node").over(group)}).where("lo < hi")
        out = keep(shared.select("sig", F.dense_rank().over(group.orderBy("node")).alias("rank"), "node", "n").distinct(), "groups")
        settle(docs.sparkSession)
        return out

    shared = [groups(part) for part in range(parts)]

    def sets_of(nodes: DataFrame) -> DataFrame:
        """One document for each node is read again."""
        nodes = keep(nodes, "nodes")
        first = members.join(nodes, members["__node"] == nodes["node"], "left_semi").groupBy("__node").agg(F.min("__row").alias("__r")).select("__r").distinct()
        first = keep(first.orderBy("__r"), "firsts")
        some = rows.join(first, F.col("__row").eqNullSafe(F.col("__r")), "left_semi")
        return keep(some.select("__text").mapInArrow(_set_batches(words), "node long, shingles array<long>").dropDuplicates(["node"]).join(nodes, "node", "left_semi"), "sets")

    sketches = keep(members.select(F.col("__node").alias("node"), F.col("__sketch").alias("sketch")).dropDuplicates(["node"]), "sketches")
    roots = links(shared, sketches, sets_of, num, den)
    if roots is None:
        joined = members.withColumn("__c", F.col("__node"))
    else:
        joined = members.join(roots.withColumnRenamed("node", "__node"), "__node", "left").withColumn("__c", F.coalesce("root", "__node"))
    # Most documents are alone; only components of two rows or more are handed back.
    least = joined.where("__n > 0").groupBy("__c").agg(F.struct(F.min("__row").alias("id")).alias("__least"), F.count(F.lit(1)).alias("__rows")).where("__rows > 1")
    least = keep(least, "least")  # a join of two tables is split where a component is large
    component = F.when((F.col("__n") > 0) & F.col("__least").isNotNull(), F.col("__least.id")).otherwise(F.col("__row"))
    return joined.join(least, "__c", "left").select("__row", F.struct(F.col("__n").alias("n_shingles"), component.alias("component_id")).alias("__near"))


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(F.col("__row").alias("doc_id"), "__near.*")


SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS sh
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM g a JOIN g b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE {DEN} * common >= {NUM} * (a.n + b.n - common)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)
"""
