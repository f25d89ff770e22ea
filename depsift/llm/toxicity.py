"""Toxicity from class-conditional Kneser-Ney models (op 4).

Events are the bytes of words and their ends, each after the ``ORDER`` - 1 bytes
before it in the same word.  Toxic and ordinary training documents have counts of
their own at the highest order; below it, both share one chain of continuation
counts (how many different longer expressions end in this one), so an expression
that one class has hardly seen is judged by what both know.  With discount D,

    P(x | h) = (max(c(hx) - D, 0) + D types(h) Q(x | h')) / c(h),   Q likewise below.

A document's values are the difference of its two log-likelihoods over its number
of events, and over the root of that number (how far the first is from chance).  A
logistic curve turns them into a score.  It is fitted on the values that models of three
quarters of the training documents give to the others, of which ``FITTED`` are taken at
most, the first by a hash of their ids.  The models that score then count all training
documents.

Labelled documents are read once and counted in the mappers first, then by n-gram, and
the probabilities are joined as tables.  What scoring needs is the log ratio of each
seen n-gram, and of each context for unseen ones; both are kept whole.  Up to
``MODEL`` of them are broadcast as sorted keys and ratios, 16 bytes each (64 MB at
most).  A larger model stays a table: documents become rows of their n-grams with
counts, which are joined with it and summed by document.

Defined cases: null or blank texts have no events and the values 0; a text of any length
is read whole, by itself if it is longer than ``CHUNK``; a document with several labels
is toxic if one of them is; null labels don't count; without documents of both classes
to train on and to fit, every score is the share of toxic ones (0 without any, as with
empty tables).  Repeated rows are scored alike.  Other columns are not read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsift.llm.shared import keep, ship, table

ORDER, DISCOUNT = 4, 0.75
#: Labelled documents at most that the logistic curve is fitted on.
FITTED = 50_000
#: N-grams and contexts at most that are broadcast.
MODEL = 1 << 22
#: Bytes of text that a task holds as events at once (one document at least).
CHUNK = 1 << 20
_PAD = b" " * (ORDER - 1)


def events(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of the texts, oldest byte first in a 64-bit integer, and their documents."""
    padded = [_PAD + _PAD.join(w) + _PAD if (w := (t or "").lower().encode("utf-8", "surrogatepass").split()) else b"" for t in texts]
    raw = np.frombuffer(b"".join(padded), np.uint8)
    doc = np.repeat(np.arange(len(texts)), [len(p) for p in padded])
    if not len(raw):
        return np.empty(0, np.int64), doc
    gram = np.zeros(len(raw), np.int64)
    for back in range(ORDER):
        gram[back:] |= raw[: len(raw) - back].astype(np.int64) << 8 * back
    blank = raw == 32
    use = ~blank
    use[1:] |= ~blank[:-1]
    return gram[use], doc[use]


def _chunks(batch: pa.RecordBatch):
    start = size = 0
    for i, text in enumerate(batch.column("__text")):
        size += len(text.as_buffer()) if text.is_valid else 0
        if size >= CHUNK:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _count(batches):
    for batch in batches:
        for part in _chunks(batch):
            gram, doc = events(part.column("__text").to_pylist())
            kind = part.column("__kind").to_numpy()[doc]
            seen, at = np.unique(gram, return_inverse=True)
            counts = [np.bincount(at, kind == k, len(seen)).astype(np.int64) for k in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(seen), *map(pa.array, counts)], ["g", "n0", "n1", "n2", "n3"])


def count(texts: DataFrame) -> DataFrame:
    """(``__text``, ``__kind``) -> g, n0 ... n3: the counts of each n-gram in texts of each
    kind; 0 and 1 are ordinary and toxic texts, 2 and 3 those that fit the curve."""
    kinds = [f"n{k}" for k in range(4)]
    found = texts.mapInArrow(_count, "g long, " + ", ".join(f"{k} long" for k in kinds))
    return keep(found.groupBy("g").agg(*(F.sum(k).alias(k) for k in kinds)), "grams")


def _shared(grams: DataFrame, order: int) -> DataFrame:
    """Q at this order and below: (g, q) of every n-gram of ``order`` bytes that ends a
    longer one."""
    if order == 0:
        return None
    last = (1 << 8 * order) - 1
    here = grams.groupBy(F.col("g").bitwiseAND(F.lit(last)).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    here = keep(here, f"order{order}")
    total = here.groupBy(F.shiftright("g", 8).alias("h")).agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("types"))
    below = _shared(here, order - 1)
    rows = here.withColumn("h", F.shiftright("g", 8)).join(total, "h")
    if below is None:
        back = F.lit(1 / 256)
    else:
        rows = rows.withColumn("s", F.col("g").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))).join(below.select(F.col("g").alias("s"), F.col("q").alias("b")), "s")
        back = F.col("b")
    return keep(rows.select("g", ((F.col("n") - DISCOUNT + DISCOUNT * F.col("types") * back) / F.col("all")).alias("q")), f"shared{order}")


def train(grams: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(g, n0, n1) -> log ratios (g, ratio) of all n-grams, (h, other) of all contexts,
    and how many they are."""
    contexts = grams.groupBy(F.shiftright("g", 8).alias("h")).agg(
        *(f(c).alias(f"{name}{c[1]}") for c in ("n0", "n1") for f, name in ((F.sum, "all"), (lambda c: F.count_if(F.col(c) > 0), "types")))
    )
    contexts = keep(contexts, "contexts")
    backoff = _shared(grams, ORDER - 1).select(F.col("g").alias("s"), "q")
    rows = grams.withColumns({"h": F.shiftright("g", 8), "s": F.col("g").bitwiseAND(F.lit((1 << 8 * (ORDER - 1)) - 1))}).join(contexts, "h").join(backoff, "s")

    def weight(k):
        return F.when(F.col(f"all{k}") > 0, DISCOUNT * F.col(f"types{k}") / F.col(f"all{k}")).otherwise(F.lit(1.0))

    def p(k):
        return F.when(F.col(f"all{k}") > 0, F.greatest(F.col(f"n{k}") - DISCOUNT, F.lit(0.0)) / F.col(f"all{k}")).otherwise(F.lit(0.0)) + weight(k) * F.col("q")

    ratios = rows.select("g", F.log(p(1) / p(0)).alias("ratio"))
    unseen = contexts.select("h", F.log(weight(1) / weight(0)).alias("other"))
    return ratios, unseen, grams.count() + contexts.count()


def _sorted(ratios: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    found = ratios.toArrow()
    keys, values = (c.to_numpy() for c in found.columns)
    order = np.argsort(keys)
    return keys[order], values[order]


def _look(g: np.ndarray, keys: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
    return keys[at] == g, ratios[at]


def _values(model):
    def run(batches):
        grams, contexts = model.value
        for batch in batches:
            for part in _chunks(batch):
                gram, doc = events(part.column("__text").to_pylist())
                seen, at = np.unique(gram, return_inverse=True)
                hit, value = _look(seen, *grams)
                known, other = _look(seen >> 8, *contexts)
                value = np.where(hit, value, np.where(known, other, 0.0))[at]
                n = np.bincount(doc, minlength=part.num_rows)
                total, n = np.bincount(doc, value, part.num_rows), np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([part.column("__row"), pa.array(total / n), pa.array(total / np.sqrt(n))], ["__row", "__mean", "__far"])

    return run


def _document_grams(batches):
    for batch in batches:
        for part in _chunks(batch):
            gram, doc = events(part.column("__text").to_pylist())
            seen, n = np.unique(doc << 8 * ORDER | gram, return_counts=True)
            doc, gram = seen >> 8 * ORDER, seen & ((1 << 8 * ORDER) - 1)
            # Documents without events get a row that no n-gram matches.
            blank = np.setdiff1d(np.arange(part.num_rows), doc)
            of = pa.array(np.concatenate([doc, blank]))
            gram, n = np.concatenate([gram, np.full(len(blank), -1)]), np.concatenate([n, np.zeros(len(blank), np.int64)])
            yield pa.RecordBatch.from_arrays([part.column("__uid").take(of), part.column("__row").take(of), pa.array(gram), pa.array(n)], ["__uid", "__row", "g", "n"])


def _joined(rows: DataFrame, ratios: DataFrame, unseen: DataFrame) -> DataFrame:
    id_type = rows.schema["__row"].dataType.simpleString()
    found = rows.withColumn("__uid", F.monotonically_increasing_id()).mapInArrow(_document_grams, f"__uid long, __row {id_type}, g long, n long")
    found = found.join(ratios, "g", "left").withColumn("h", F.shiftright("g", 8)).join(unseen, "h", "left")
    value = F.col("n") * F.coalesce("ratio", "other", F.lit(0.0))
    each = found.groupBy("__uid").agg(F.first("__row").alias("__row"), F.sum(value).alias("total"), F.greatest(F.sum("n"), F.lit(1)).alias("n"))
    return each.select("__row", (F.col("total") / F.col("n")).alias("__mean"), (F.col("total") / F.sqrt("n")).alias("__far"))


def valued(grams: DataFrame) -> Callable[[DataFrame], DataFrame] | None:
    """Trains on the counts of n-grams; what it returns turns (``__row``, ``__text``) into
    (``__row``, ``__mean``, ``__far``).  None if there is nothing to learn from."""
    ratios, unseen, size = train(grams)
    if not size:
        return None
    if size > MODEL:
        ratios, unseen = keep(ratios, "ratios"), keep(unseen, "unseen")
        return lambda rows: _joined(rows, ratios, unseen)
    model = grams.sparkSession.sparkContext.broadcast((_sorted(ratios), _sorted(unseen)))
    return lambda rows: rows.mapInArrow(_values(model), f"__row {rows.schema['__row'].dataType.simpleString()}, __mean double, __far double")


def _logistic(values: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and intercept by Newton's method, on standardised values with a slight ridge."""
    mid, spread = values.mean(0), values.std(0)
    spread = np.where(spread > 0, spread, 1.0)
    x = np.column_stack([(values - mid) / spread, np.ones(len(values))])
    ridge = np.array([*[1e-2] * values.shape[1], 1e-9])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - toxic) + ridge * w)
        w -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    slopes = w[:-1] / spread
    return slopes, float(w[-1] - slopes @ mid)


def fold(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def score(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(``__row``: the id, ``held_out``, ``score``) of every row."""
    ship(docs.sparkSession)
    toxic = labels.where("toxic IS NOT NULL").groupBy(F.col("doc_id").alias("__row")).agg(F.max("toxic").cast("int").alias("__toxic"))
    rows = docs.select(F.col(id_col).alias("__row"), F.col(text_col).alias("__text"))
    held = F.coalesce(fold("__row"), F.lit(0)) == 0
    # Labels grow with the documents, so they are not for a broadcast at any size.
    training = rows.join(toxic.hint("merge"), "__row").withColumn("__fold", fold("__row")).where("__fold > 0")
    fits = F.col("__fold") == 4
    grams = count(training.select("__text", (F.col("__toxic") + F.when(fits, 2).otherwise(0)).alias("__kind")))
    values_of, curve = valued(grams.where("n0 + n1 > 0").select("g", "n0", "n1")), None
    if values_of:
        tried = values_of(training.where(fits).select("__row", "__text")).join(toxic, "__row")
        found = tried.orderBy(F.xxhash64("__row"), "__row").limit(FITTED).select("__mean", "__far", "__toxic").toArrow()
        mean, far, flag = (found.column(c).to_numpy() for c in ("__mean", "__far", "__toxic"))
        if len(set((flag > 0).tolist())) == 2:
            curve = _logistic(np.column_stack([mean, far]), (flag > 0).astype(float))
            values = valued(grams.select("g", (F.col("n0") + F.col("n2")).alias("n0"), (F.col("n1") + F.col("n3")).alias("n1")))(rows)
    if not curve:
        share = training.agg(F.avg("__toxic")).first()[0] or 0.0
        return rows.select("__row", held.alias("held_out"), F.lit(float(share)).alias("score"))
    (a, b), c = curve
    return values.select("__row", held.alias("held_out"), (1 / (1 + F.exp(-(float(a) * F.col("__mean") + float(b) * F.col("__far") + c)))).alias("score"))


def query(spark, sf_dir):
    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(F.col("__row").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


SQL = None
