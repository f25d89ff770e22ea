r"""Quality rules with risk-controlled thresholds (op 5).

Two base rules are fixed (too few words, too many repeated words).  Four further
rules reject a document when a ratio is above a cutoff: symbols to words, repeated
lines to lines, characters to words, repeated words to words.  The cutoffs are
learned.  For every stratum (language) and candidate cutoff, count how many
labelled good documents the rule would reject; x of n rejections bound the true
rate from above by the exact binomial test, P(Bin(n, risk) <= x).  A cutoff is
certified if that probability is at most ``error`` / (strata * rules * cutoffs)
(Bonferroni), and each rule gets its share ``risk`` / rules, so that with
probability 1 - ``error`` no stratum loses more than ``risk`` of its good
documents.  Of its certified cutoffs, a rule uses the one that rejects the most
labelled bad documents, and of those that reject as many the highest; a rule that
has none (too few labels), or whose certified cutoffs reject no bad document, rejects
nothing.

Everything is built-in SQL functions.  Words, lines and three-word windows are
arrays inside the row; only one short row a document is shuffled (to meet the
labels), and counts per stratum are aggregated before the shuffle.  Windows are
compared by their 64-bit hash within one document.

Defined cases: null text has no words and fails; null language is a stratum; a
document with several labels is good if all of them are 1; null labels don't
count.  Without labels, nothing but the base rules applies; an empty table gives an
empty one.  Texts are measured whole, whatever their length.  Repeated rows are judged
alike.  Of cutoffs that tie, the higher counts.  Other columns pass through untouched,
whatever their names, but for one named ``__quality``, which is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depsift.llm.shared import keep, table

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: rule -> numerator, denominator, candidate cutoffs in hundredths.
RULES = {
    "symbols": ("n_symbols", "n_words", (10, 20, 30, 50, 80, 120)),
    "lines": ("n_dup_lines", "n_lines", (10, 20, 30, 40, 50, 60)),
    "length": ("word_chars", "n_words", (600, 700, 800, 900, 1000, 1200)),
    "repeats": ("n_repeat_words", "n_words", (5, 10, 15, 20, 30, 40)),
}
MIN_WORDS, REPEAT_PERCENT = 50, 50


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``__f``: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    raw = F.coalesce(F.col(text_col), F.lit(""))
    body = F.btrim(raw, F.lit(BLANKS))
    plain = raw
    for symbol in SYMBOLS:
        plain = F.replace(plain, F.lit(symbol), F.lit(""))
    none = F.array().cast("array<string>")
    lines = F.filter(F.split(raw, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    step1 = docs.withColumns(
        {
            "__words": F.when(body == "", none).otherwise(F.split(body, r"[\x20\x09-\x0D]+")),
            "__lines": lines,
            "__symbols": (F.char_length(raw) - F.char_length(plain)).cast("long"),
        }
    )
    n = F.greatest(F.size("__words") - 2, F.lit(0))
    windows = F.arrays_zip(*(F.slice("__words", k, n).alias(f"w{k}") for k in (1, 2, 3)))
    step2 = step1.withColumn("__hash", F.transform(windows, lambda w: F.xxhash64(w["w1"], w["w2"], w["w3"])))
    twice = F.size(F.array_distinct("__hash")) < F.size("__hash")
    empty = F.array().cast("array<struct<h:bigint,at:int>>")
    placed = F.transform("__hash", lambda h, i: F.struct(h.alias("h"), i.alias("at")))
    step3 = step2.withColumn("__sorted", F.when(twice, F.sort_array(placed)).otherwise(empty))
    m = F.greatest(F.size("__sorted") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice("__sorted", 1, m).alias("a"), F.slice("__sorted", 2, m).alias("b"))
    same = F.filter(pairs, lambda p: p["a"]["h"] == p["b"]["h"])
    covered = F.flatten(F.transform(same, lambda p: F.flatten(F.array(*(F.array(*(p[s]["at"] + k for k in range(3))) for s in "ab")))))
    return step3.withColumn(
        "__f",
        F.struct(
            F.size("__words").cast("long").alias("n_words"),
            F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
            F.col("__symbols").alias("n_symbols"),
            F.size("__lines").cast("long").alias("n_lines"),
            (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
            F.size(F.array_distinct(covered)).cast("long").alias("n_repeat_words"),
        ),
    ).drop("__words", "__lines", "__symbols", "__hash", "__sorted")


def base_failed() -> Column:
    f = F.col("__f")
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > REPEAT_PERCENT * f["n_words"])


def _above(rule: str, cutoff: Column) -> Column:
    top, bottom, _ = RULES[rule]
    return 100 * F.col("__f")[top] > cutoff * F.col("__f")[bottom]


def _log_factorial(n: Column) -> Column:
    """Stirling's series at n + 11, carried back ten steps."""
    y, steps = n + 11.0, F.lit(0.0)
    for k in range(1, 11):
        steps = steps + F.log(n + float(k))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - steps


def binomial_tail(x: Column, n: Column, risk: float) -> Column:
    """P(Bin(n, risk) <= x) for x up to the mean, 1 above it.  The sum runs down from
    its largest term; 40 standard deviations below, terms are under 1e-300."""
    x, n = x.cast("double"), n.cast("double")
    first = F.exp(_log_factorial(n) - _log_factorial(x) - _log_factorial(n - x) + x * math.log(risk) + (n - x) * math.log1p(-risk))
    steps = F.sequence(F.lit(0).cast("long"), F.least(x, 40 * F.sqrt(x) + 50).cast("long"))
    start = F.struct(first.alias("t"), F.lit(0.0).alias("s"))
    total = F.aggregate(
        steps, start,
        lambda a, i: F.struct((a["t"] * (x - i) * (1 - risk) / ((n - x + i + 1.0) * risk)).alias("t"), (a["s"] + a["t"]).alias("s")),
        lambda a: a["s"],
    )
    return F.when(x > n * risk, F.lit(1.0)).otherwise(total)


def cutoffs(measured: DataFrame, labels: DataFrame, *, risk: float, error: float) -> DataFrame:
    """(``__id``, ``__stratum``, ``__f``) and labels -> a row a stratum: the certified
    cutoff of each rule, null if it has none."""
    verdicts = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg((F.min("quality") == 1).alias("__good"))
    tried = [(rule, c) for rule, (_, _, cs) in RULES.items() for c in cs]
    good = F.col("__good")
    counts = (
        measured.where(~base_failed()).join(verdicts, "__id").groupBy("__stratum")
        .agg(
            F.count_if(good).alias("n"),
            *(F.count_if(good & _above(rule, F.lit(c))).alias(f"good_{rule}_{c}") for rule, c in tried),
            *(F.count_if(~good & _above(rule, F.lit(c))).alias(f"bad_{rule}_{c}") for rule, c in tried),
        )
        .where("n > 0")
        .withColumn("__tests", F.count(F.lit(1)).over(Window.partitionBy()) * len(tried))
    )

    def certified(rule: str, c: int) -> Column:
        return binomial_tail(F.col(f"good_{rule}_{c}"), F.col("n"), risk / len(RULES)) <= error / F.col("__tests")

    chosen = {
        rule: F.array_max(F.array(*(F.when(certified(rule, c) & (F.col(f"bad_{rule}_{c}") > 0), F.struct(F.col(f"bad_{rule}_{c}").alias("caught"), F.lit(c).alias("cut"))) for c in cs)))["cut"]
        for rule, (_, _, cs) in RULES.items()
    }
    return counts.select(F.col("__stratum").alias("__s"), *(v.alias(f"__cut_{k}") for k, v in chosen.items()))


def quality_rules(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", stratum_col="lang", carry: list[str] | None = None, risk=0.02, error=0.05) -> DataFrame:
    """The ``carry`` columns (all, if none are named) of every row of ``docs`` with a
    struct ``__quality``: the features, ``base_failed`` and ``kept``.  The carried columns
    are written once with the features, so every text is measured once."""
    carry = [c for c in docs.columns if c != "__quality"] if carry is None else carry
    rows = docs.select(F.struct(*(f"`{c}`" for c in carry)).alias("__row"), F.col(id_col).alias("__id"), F.col(stratum_col).alias("__stratum"), F.col(text_col).alias("__text"))
    measured = keep(features(rows, "__text").drop("__text"), "features")
    cuts = keep(cutoffs(measured.select("__id", "__stratum", "__f"), labels, risk=risk, error=error), "cutoffs")
    passed = ~base_failed()
    for rule in RULES:
        passed = passed & ~F.coalesce(_above(rule, F.col(f"__cut_{rule}")), F.lit(False))
    joined = measured.join(cuts, F.col("__stratum").eqNullSafe(F.col("__s")), "left")
    return joined.select("__row.*", F.struct("__f.*", base_failed().alias("base_failed"), passed.alias("kept")).alias("__quality"))


def query(spark, sf_dir):
    rows = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])
    return rows.select("doc_id", *(f"__quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def _sql() -> str:
    tried = [(rule, c) for rule, (_, _, cs) in RULES.items() for c in cs]
    values = ", ".join(f"('{r}', {c})" for r, c in tried)
    top = " ".join(f"WHEN '{r}' THEN {a}" for r, (a, _, _) in RULES.items())
    bottom = " ".join(f"WHEN '{r}' THEN {b}" for r, (_, b, _) in RULES.items())
    risk = 0.02 / len(RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT uid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 2),
h AS (SELECT uid, i, count(*) OVER (PARTITION BY uid, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g),
r AS (SELECT uid, count(DISTINCT i + k) AS n FROM h, (VALUES (0), (1), (2)) k(k) WHERE c > 1 GROUP BY uid),
f AS (SELECT doc_id, lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r USING (uid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM f),
v AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
x AS (SELECT lang, rule, c, count_if(good)::BIGINT AS n, count_if(good AND above)::BIGINT AS x, count_if(NOT good AND above) AS y
      FROM (SELECT *, 100 * (CASE rule {top} END) > c * (CASE rule {bottom} END) AS above FROM b JOIN v USING (doc_id), (VALUES {values}) t(rule, c) WHERE NOT base_failed)
      GROUP BY lang, rule, c HAVING count_if(good) > 0),
p AS (SELECT *, CASE WHEN x > n * {risk} THEN 1.0 ELSE list_sum(list_transform(range(x + 1), lambda i:
             exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk})))) END AS p,
             count(*) OVER () AS tests FROM x),
k AS (SELECT lang, rule, arg_max(c, (y, c)) AS cut FROM p WHERE p <= 0.05 / tests AND y > 0 GROUP BY lang, rule)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM k WHERE k.lang IS NOT DISTINCT FROM b.lang
         AND 100 * (CASE rule {top} END) > cut * (CASE rule {bottom} END)) AS kept
FROM b
"""


SQL = _sql()
