"""The engine's queries by name, and the same in SQL for DuckDB.

Queries run over the joined sales table or over tables of the star schema.  Doubles
are rounded to six places on both sides.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depsift.functions import canonical, cleaning
from depsift.functions.scores import accuracy_strength, coverage_factor, entropy_strength, identifier_value
from depsift.operators import counts, estimate, masking, profile, tokens
from depsift.operators.kept import drop_kept
from depsift.operators.score import candidate_meta, core_scores, reverse_margins
from depsift.operators.shapes import marginal_profile, pattern_shapes, shape_marginals, shape_stats
from depsift.plans.search import Search
from depsift.settings import Settings
from depsift.sources.rules import evaluate
from depsift.sources.tables import SALES, SALES_FAMILIES, SALES_KEY, complete_rows, first_rows, kept_sales, sales

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

EMPIRICAL = Settings(estimator="empirical")
#: All single-column candidates of the sales table, as (lhs columns, rhs).
PAIRS = [((a,), b) for a in SALES for b in SALES if a != b]
SALES_SQL = f"""w AS MATERIALIZED (SELECT {', '.join(SALES)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return register


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- sources and cleaning -----------------------------------------------------


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 100")
def read_first_rows(spark, sf_dir):
    return first_rows(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), 100, "event_id")


_DIRTY = "concat('$', floor(o_totalprice / 1000), ',', lpad((floor(o_totalprice) % 1000)::BIGINT::VARCHAR, 3, '0'), '.50')"


@query("SELECT o_orderkey, (floor(o_totalprice)::BIGINT)::DOUBLE + 0.5 AS amount FROM orders")
def clean_currency(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    dirty = F.concat(F.lit(" $"), F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit(","), F.lpad((F.floor("o_totalprice") % 1000).cast("string"), 3, "0"), F.lit(".50 "))
    return o.select("o_orderkey", cleaning.currency(dirty).alias("amount"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE date_diff('day', DATE '2000-01-01', o_orderdate::DATE) END::DOUBLE AS days FROM orders")
def clean_date_days(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 7 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", cleaning.days_since_2000(text).cast("double").alias("days"))


@query("SELECT p_partkey, TRY_CAST(nullif(regexp_extract(p_name || ' x-' || p_size || 'y7', '-?\\d+', 0), '') AS DOUBLE) AS first FROM part")
def clean_first_int(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", cleaning.first_integer(F.concat("p_name", F.lit(" x-"), F.col("p_size").cast("string"), F.lit("y7"))).alias("first"))


@query("SELECT p_partkey, TRY_CAST(CASE WHEN p_size % 5 = 0 THEN 'n/a' ELSE p_size::VARCHAR END AS DOUBLE) AS number FROM part")
def clean_number(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", cleaning.to_number(F.when(F.col("p_size") % 5 == 0, "n/a").otherwise(F.col("p_size").cast("string"))).alias("number"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN c_mktsegment ELSE c_name END AS value FROM customer")
def clean_text_nulls(spark, sf_dir):
    k = F.col("c_custkey") % 4
    dirty = F.when(k == 0, " NaN ").when(k == 1, "none").when(k == 2, F.concat(F.lit("  "), F.col("c_mktsegment"))).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", cleaning.text_or_null(dirty).alias("value"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE NULL END::DOUBLE AS flag, CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS label FROM orders")
def clean_booleans_and_labels(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    flag = cleaning.boolean(F.when(k == 0, "False ").when(k == 1, "T").otherwise("maybe"))
    label = cleaning.labelled(F.when(F.col("o_totalprice") > 100000, " >100K").otherwise("<=100K "), ">100K", "<=100K")
    return table(spark, sf_dir, "orders").select("o_orderkey", flag.cast("double").alias("flag"), label.alias("label"))


_SPARSE = "CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_quantity END AS a, CASE WHEN l_orderkey % 2 = 0 THEN NULL ELSE l_tax END AS b, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_discount END AS c"


def _sparse(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", *_SPARSE.split(", CASE")[:1], *("CASE" + x for x in _SPARSE.split(", CASE")[1:]))


@query(f"SELECT * FROM (SELECT l_orderkey, l_linenumber, {_SPARSE} FROM lineitem) WHERE 2 + (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT >= 4")
def drop_sparse_rows(spark, sf_dir):
    return cleaning.drop_sparse_rows(_sparse(spark, sf_dir), 0.7)


@query(f"SELECT * FROM (SELECT l_orderkey, l_linenumber, {_SPARSE} FROM lineitem) WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")
def drop_incomplete_rows(spark, sf_dir):
    return complete_rows(_sparse(spark, sf_dir))


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal FROM customer")
def zscore_columns(spark, sf_dir):
    return rounded(cleaning.zscore(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]))


# --- profiles -----------------------------------------------------------------

_CELLS = "c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, {c}::VARCHAR AS v FROM w" for c in SALES) + ")"
_STATS = f"""s AS (SELECT col AS "column", sum(n)::BIGINT AS rows, count(*) AS unique_count, count(*) / sum(n) AS unique_ratio, max(n) / sum(n) AS marginal_top1
  FROM (SELECT col, v, count(*) AS n FROM c GROUP BY ALL) GROUP BY col)"""
_FAMILY = "CASE WHEN \"column\" IN ('l_shipdate', 'o_orderdate') THEN 'date' WHEN \"column\" IN ('l_quantity', 'l_discount', 'l_tax', 'p_retailprice') THEN 'numeric' WHEN \"column\" IN ('l_returnflag', 'l_linestatus', 'o_orderstatus', 'o_orderpriority', 'c_mktsegment', 'n_name', 'r_name', 'p_name', 'p_brand', 'p_type') THEN 'categorical' ELSE 'discrete_numeric' END"
_IDS = " OR ".join(f"\"column\" LIKE '%{x}%'" for x in profile.ID_WORDS)
_ROLES = f"""f AS (SELECT *, {_FAMILY} AS family, unique_count >= 256 OR unique_ratio >= .01 AS high, unique_count >= 1024 AND unique_ratio >= .03 AS quasi, {_IDS} AS idlike,
    CASE WHEN {_FAMILY} = 'numeric' THEN 'continuous_numeric' ELSE 'discrete_numeric' END AS num FROM s),
r AS (SELECT *, CASE WHEN unique_count <= 1 THEN ['constant', 'excluded', 'excluded', '0'] WHEN unique_ratio >= .98 THEN ['identifier', 'excluded', 'excluded', '1']
    WHEN family = 'categorical' AND unique_ratio >= .5 AND idlike THEN ['quasi_identifier', 'exact', 'exact', '.95'] WHEN family = 'categorical' AND unique_ratio >= .5 THEN ['near_identifier', 'excluded', 'excluded', '0']
    WHEN family = 'categorical' AND high AND idlike AND quasi THEN ['quasi_identifier', 'exact', 'exact', '.95']
    WHEN family = 'categorical' AND high AND ("column" LIKE '%zip%' OR "column" LIKE '%postal%') THEN ['geo_code', 'exact', 'exact', '.7']
    WHEN family = 'categorical' AND high AND ("column" LIKE '%avg%' OR "column" LIKE '%code%') THEN ['code_categorical', 'exact', 'exact', '.8']
    WHEN family = 'categorical' AND high AND ("column" LIKE '%city%' OR "column" LIKE '%county%' OR "column" LIKE '%state%' OR "column" LIKE '%country%') THEN ['location_categorical', 'exact', 'exact', '.55']
    WHEN family = 'categorical' AND high AND "column" LIKE '%name%' THEN ['entity_name', 'exact', 'exact', '.65'] WHEN family = 'categorical' AND high THEN ['high_card_categorical', 'exact', 'exact', '.7']
    WHEN family = 'categorical' THEN ['semantic_categorical', 'exact', 'exact', '0']
    WHEN family = 'date' AND unique_ratio >= .5 THEN ['temporal', 'excluded', 'excluded', '0'] WHEN family = 'date' AND unique_count <= 32 AND unique_ratio <= .05 THEN ['temporal', 'exact', 'exact', '0'] WHEN family = 'date' THEN ['temporal', 'binned', 'binned', '0']
    WHEN unique_ratio >= .5 THEN [num, 'excluded', 'excluded', '0'] WHEN unique_count <= 128 AND unique_ratio <= .05 THEN [num, 'exact', 'exact', '0'] ELSE [num, 'binned', 'binned', '0'] END AS x FROM f),
m AS (SELECT "column", family, unique_ratio, x[1] AS role, x[2] AS analysis_mode, x[3] AS rhs_mode, x[4]::DOUBLE AS empirical_weight,
    CASE WHEN family = 'categorical' THEN 'categorical' WHEN (family = 'numeric' AND x[2] <> 'exact') OR x[2] = 'binned' THEN 'continuous_bucket' ELSE 'discrete_numeric' END AS model_type FROM r)"""


@query(f'WITH {SALES_SQL}, {_CELLS}, {_STATS} SELECT "column", rows, unique_count, round(unique_ratio, 6) AS unique_ratio, round(marginal_top1, 6) AS marginal_top1 FROM s')
def profile_columns(spark, sf_dir):
    return rounded(profile.column_stats(sales(spark, sf_dir)))


@query(f"""WITH {SALES_SQL}, {_CELLS}, {_STATS} SELECT "column", CASE WHEN marginal_top1 >= .95 THEN 'dominant_value' ELSE 'few_values' END AS reason FROM s WHERE marginal_top1 >= .95 OR unique_count BETWEEN 1 AND 2""")
def degenerate_columns(spark, sf_dir):
    return profile.degenerate(profile.column_stats(sales(spark, sf_dir)))


@query(f'WITH {SALES_SQL}, {_CELLS}, {_STATS}, {_ROLES} SELECT "column", family, role, analysis_mode, rhs_mode, empirical_weight, model_type FROM m')
def column_roles(spark, sf_dir):
    w = sales(spark, sf_dir)
    stats = profile.with_families(profile.column_stats(w), profile.families(w))
    return profile.model_type(profile.roles(stats)).select("column", "family", "role", "analysis_mode", "rhs_mode", "empirical_weight", "model_type")


_FLAGS = """g AS (SELECT "column", analysis_mode IN ('exact', 'binned') AS lp, rhs_mode = 'exact' AS rp,
    CASE WHEN role = 'constant' THEN false WHEN role = 'near_identifier' THEN true WHEN role IN ('identifier', 'quasi_identifier') THEN unique_ratio < 1 ELSE true END AS lhs,
    CASE WHEN role = 'constant' THEN false WHEN role = 'near_identifier' THEN true WHEN role IN ('identifier', 'quasi_identifier') THEN unique_ratio < 1 AND rhs_mode = 'exact' ELSE rhs_mode = 'exact' OR model_type IN ('categorical', 'discrete_numeric') END AS rhs FROM m)"""


@query(f'WITH {SALES_SQL}, {_CELLS}, {_STATS}, {_ROLES}, {_FLAGS} SELECT "column", lp AS lhs_policy, rp AS rhs_policy, lhs, rhs FROM g')
def searchable_flags(spark, sf_dir):
    return profile.profile(sales(spark, sf_dir)).select("column", "lhs_policy", "rhs_policy", "lhs", "rhs")


@query(f"""WITH {SALES_SQL}, {_CELLS}, {_STATS}, {_ROLES}, {_FLAGS} SELECT "column", CASE WHEN lhs AND lp THEN 'policy' WHEN lhs THEN 'relaxed' ELSE 'disabled' END AS lhs_search,
  CASE WHEN rhs AND rp THEN 'policy' WHEN rhs THEN 'relaxed' ELSE 'disabled' END AS rhs_search FROM g""")
def searchability_report(spark, sf_dir):
    return profile.searchability(profile.profile(sales(spark, sf_dir)))


# --- tokens -------------------------------------------------------------------

_CANON = "nullif(regexp_replace(replace(lower(trim({}, ' ' || chr(9) || chr(10) || chr(13))), '`', ''''), '\\s+', ' ', 'g'), '')"


@query(f"SELECT doc_id, {_CANON.format('source')} AS source, {_CANON.format('lang')} AS lang, {_CANON.format('text')} AS text FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE '  ' || source END AS source, lang, text FROM documents)")
def canonical_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    source = F.when(F.col("doc_id") % 9 == 0, F.lit(None)).otherwise(F.concat(F.lit("  "), F.col("source")))
    return d.select("doc_id", canonical.canonical_text(source).alias("source"), canonical.canonical_text(F.col("lang")).alias("lang"), F.nullif(F.regexp_replace(F.translate(F.lower(F.btrim("text", F.lit(" \t\n\r"))), "`", "'"), r"\s+", " "), F.lit("")).alias("text"))


@query("SELECT l_orderkey, l_linenumber, trunc(l_extendedprice)::BIGINT::VARCHAR AS token FROM lineitem")
def discrete_tokens(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", canonical.canonical_integer(F.col("l_extendedprice").cast("string")).alias("token"))


_SPLIT = "CASE WHEN b < 8 THEN 'train' WHEN b = 8 THEN 'val' ELSE 'test' END AS split"
_BUCKET = "(('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey)), 1, 8))::BIGINT % 10) AS b"
_WSPLIT = f"ws AS (SELECT *, {_SPLIT} FROM (SELECT *, {_BUCKET} FROM w))"


def split_sales(spark, sf_dir) -> DataFrame:
    return sales(spark, sf_dir).withColumn("split", tokens.split_of(tokens.row_key(*SALES_KEY)))


@query(f"WITH {SALES_SQL}, {_WSPLIT} SELECT split, count(*) AS n FROM ws GROUP BY split")
def split_counts(spark, sf_dir):
    return split_sales(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SALES_SQL}, {_WSPLIT} SELECT p_type AS token, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) + 3 AS token_id FROM ws WHERE split = 'train' GROUP BY p_type")
def vocabulary_topk(spark, sf_dir):
    return tokens.vocabulary(split_sales(spark, sf_dir).where("split = 'train'"), "p_type")


_EDGES = "e AS (SELECT list_distinct(list_transform(range(33), lambda i: quantile_cont(l_extendedprice, i / 32.0))) AS x FROM lineitem)"
_QUANTILES = "q AS (SELECT unnest(quantile_cont(l_extendedprice, [" + ", ".join(f"{i / 32}" for i in range(33)) + "])) AS x FROM lineitem)"


@query(f"WITH {_QUANTILES} SELECT DISTINCT round(x, 8) AS edge FROM q")
def quantile_edges(spark, sf_dir):
    # Prices have two places and quantiles lie at 32nds between them: eight places hold them without ties.
    edges = tokens.quantile_edges(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return spark.createDataFrame([(e,) for e in edges], "edge double").select(F.round("edge", 8).alias("edge")).distinct()


@query(f"WITH {_QUANTILES}, d AS (SELECT list(DISTINCT x ORDER BY x) AS xs FROM q) SELECT len(list_filter(xs[2:len(xs) - 1], lambda e: e <= l_extendedprice))::INTEGER AS bucket, count(*) AS n FROM lineitem, d GROUP BY 1")
def bucket_counts(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy(tokens.bucket_of(F.col("l_extendedprice"), tokens.quantile_edges(l, "l_extendedprice")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SALES_SQL}, {_WSPLIT}, t AS (SELECT p_type AS token, row_number() OVER (ORDER BY count(*) DESC, p_type) + 3 AS id FROM ws WHERE split = 'train' GROUP BY p_type HAVING count(*) >= 20)
  SELECT token_id, token, count(*) AS n FROM (SELECT coalesce(t.id, 3) AS token_id, coalesce(t.token, '[RARE]') AS token FROM ws LEFT JOIN t ON p_type = t.token WHERE split = 'val') GROUP BY ALL""")
def encoded_tokens(spark, sf_dir):
    w = split_sales(spark, sf_dir)
    words = tokens.vocabulary(w.where("split = 'train'"), "p_type", min_count=20)
    coded = tokens.encode(w.where("split = 'val'").select("p_type"), "p_type", words, rare=True, out="token_id")
    return tokens.decode(coded.groupBy("token_id").agg(F.count(F.lit(1)).alias("n")), "token_id", words).select("token_id", "token", "n")


@query("SELECT c_mktsegment AS value, row_number() OVER (ORDER BY min(c_custkey), c_mktsegment) - 1 AS code FROM customer GROUP BY 1")
def label_codes(spark, sf_dir):
    return tokens.label_codes(table(spark, sf_dir, "customer"), "c_mktsegment", F.col("c_custkey"))


@query(f"WITH {SALES_SQL}, {_WSPLIT}, r AS (SELECT p_type AS value, pow(1 / (count(*) + 1), .5) AS w FROM ws WHERE split = 'train' GROUP BY 1) SELECT value, round(w / avg(w) OVER (), 6) AS weight FROM r")
def class_weights(spark, sf_dir):
    return rounded(masking.class_weights(split_sales(spark, sf_dir).where("split = 'train'"), "p_type"))


_UNIT = "('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0"
_MASKED = ["c_mktsegment", "c_nationkey", "c_name"]


@query(f"""WITH k AS (SELECT *, c_custkey::VARCHAR AS k FROM customer), r AS (SELECT *, [.2, .5, .8][floor({_UNIT.format("concat_ws('|', k, 'ratio', '0')")} * 3)::INT + 1] AS share FROM k),
  u AS (SELECT *, greatest(1, least(2, round(share * 3)))::INT AS visible, list_sort([{', '.join(f"{{'u': {_UNIT.format(f'''concat_ws('|', k, '{c}', '0')''')}, 'c': '{c}'}}" for c in _MASKED)}]) AS o FROM r),
  v AS (SELECT *, list_transform(o[1:visible], lambda x: x.c) AS seen FROM u)
  SELECT c_custkey, {', '.join(f"CASE WHEN list_contains(seen, '{c}') THEN {c}::VARCHAR ELSE '[MASK]' END AS {c}" for c in _MASKED)} FROM v""")
def masked_rows(spark, sf_dir):
    seen = masking.observed(table(spark, sf_dir, "customer"), F.col("c_custkey").cast("string"), _MASKED)
    return masking.masked(seen, _MASKED).select("c_custkey", *_MASKED)


# --- counting -----------------------------------------------------------------


@query(f"""WITH {SALES_SQL}, x AS (SELECT CASE WHEN l_linenumber > 5 THEN NULL ELSE p_brand END AS b FROM w),
  a AS (SELECT 'all' AS kind, b AS value, count(*) AS n FROM x GROUP BY b), v AS (SELECT 'valid' AS kind, b AS value, count(*) AS n FROM x WHERE b IS NOT NULL GROUP BY b)
  SELECT kind, value, n, round(n / sum(n) OVER (PARTITION BY kind), 6) AS p FROM (FROM a UNION ALL FROM v)""")
def marginals(spark, sf_dir):
    rows = sales(spark, sf_dir).select(F.when(F.col("l_linenumber") > 5, F.lit(None)).otherwise(F.col("p_brand")).alias("b"))
    both = counts.marginal(rows, "b").withColumn("kind", F.lit("all")).unionByName(counts.marginal(rows, "b", valid=True).withColumn("kind", F.lit("valid")))
    return rounded(both.select("kind", "value", "n", "p"))


#: A right side with nulls, for some patterns nothing but nulls.
_RHS_SQL = "CASE WHEN l_quantity > 40 OR l_suppkey % 50 = 0 THEN NULL ELSE p_brand END"


def _holed(df: DataFrame) -> DataFrame:
    return df.withColumn("rhs_col", F.when((F.col("l_quantity") > 40) | (F.col("l_suppkey") % 50 == 0), F.lit(None)).otherwise(F.col("p_brand")))


def _support_sql(lhs: list[str]) -> str:
    cols = ", ".join(lhs)
    return f"""WITH {SALES_SQL}, x AS (SELECT *, {_RHS_SQL} AS rhs_col FROM w), c AS (SELECT {cols}, rhs_col, count(*) AS k FROM x GROUP BY ALL),
  p AS (SELECT {cols}, sum(k)::BIGINT AS n, coalesce(sum(k) FILTER (rhs_col IS NOT NULL), 0)::BIGINT AS eff, max(k) FILTER (rhs_col IS NOT NULL) AS mx, sum(k * ln(k)) FILTER (rhs_col IS NOT NULL) AS kl FROM c GROUP BY {cols}),
  q AS (SELECT {cols}, n, eff, CASE WHEN eff > 0 THEN greatest(0, ln(eff) - kl / eff) ELSE 0 END AS entropy, coalesce(mx / eff, 0) AS top1, eff / n AS non_null_ratio FROM p),
  r AS (SELECT * FROM q WHERE n >= 3 OR eff >= 1 OR (top1 >= .98 AND eff >= 1))
  SELECT {cols}, n, eff, round(entropy, 6) AS entropy, round(top1, 6) AS top1, round(non_null_ratio, 6) AS non_null_ratio, round(pow(eff + 1, .75) * pow(greatest(1e-6, non_null_ratio), .5), 6) AS priority,
  round(n / sum(n) OVER (), 6) AS weight, round(n / (n + 12.0), 6) AS empirical_weight FROM r"""


def _support_query(name: str, lhs: list[str]) -> None:
    @query(_support_sql(lhs), name)
    def run(spark, sf_dir):
        return rounded(counts.support(_holed(sales(spark, sf_dir)), lhs, "rhs_col"))


for _name, _lhs in (("support_single", ["l_suppkey"]), ("support_pair", ["l_suppkey", "l_returnflag"]), ("support_triple", ["c_nationkey", "l_returnflag", "o_orderpriority"])):
    _support_query(_name, _lhs)


@query(f"""WITH {SALES_SQL}, x AS (SELECT *, {_RHS_SQL} AS rhs_col FROM w), p AS (SELECT l_partkey, count(*) AS n, count(rhs_col) AS eff FROM x GROUP BY 1 HAVING count(*) >= 3 OR count(rhs_col) >= 2)
  SELECT count(*) AS patterns, round(sum(n) / (SELECT count(*) FROM w), 6) AS retained_mass, round(sum(eff) / (SELECT count(*) FROM w), 6) AS effective_retained_mass FROM p""")
def support_mass(spark, sf_dir):
    w = _holed(sales(spark, sf_dir))
    return rounded(counts.support_mass(counts.support(w, ["l_partkey"], "rhs_col", high_card=True), w.count()))


@query(f"""WITH {SALES_SQL}, p AS (SELECT c_mktsegment, l_returnflag, count(*) AS n FROM w GROUP BY ALL) SELECT round(max(n) FILTER (c_mktsegment = 'BUILDING' AND l_returnflag = 'A') / sum(n), 6) AS probability FROM p""")
def support_probability(spark, sf_dir):
    t = counts.support(sales(spark, sf_dir), ["c_mktsegment", "l_returnflag"], "p_brand")
    return rounded(counts.support_probability(t, {"l_returnflag": "A", "c_mktsegment": "BUILDING"}))


@query(f"""WITH {SALES_SQL}, p AS (SELECT l_returnflag, o_orderstatus, count(*) AS n FROM w GROUP BY ALL), a AS (SELECT l_returnflag, count(*) / (SELECT count(*) FROM w) AS pa FROM w GROUP BY 1), b AS (SELECT o_orderstatus, count(*) / (SELECT count(*) FROM w) AS pb FROM w GROUP BY 1),
  x AS (SELECT p.*, n / (SELECT count(*) FROM w) + .25 * (1 - n / (n + 12.0)) * pa * pb AS raw FROM p JOIN a USING (l_returnflag) JOIN b USING (o_orderstatus)) SELECT l_returnflag, o_orderstatus, n, round(raw / sum(raw) OVER (), 6) AS weight FROM x""")
def support_independence(spark, sf_dir):
    t = counts.support(sales(spark, sf_dir), ["l_returnflag", "o_orderstatus"], "p_brand", Settings(independence_weight=0.25))
    return rounded(t.select("l_returnflag", "o_orderstatus", "n", "weight"))


#: Roles over the plain families; x is the profile's row with the identifier signal of the tuning.
_SUMMARY = f"""WITH {SALES_SQL}, {_CELLS}, {_STATS}, {_ROLES}, {_FLAGS},
  x AS (SELECT m.*, g.lhs, g.rhs, s.unique_count, s.rows, greatest(0, least(1, (m.unique_ratio - .02) / .18)) AS u1, greatest(0, least(1, (m.unique_ratio - .65) / .25)) AS u2 FROM m JOIN g USING ("column") JOIN s USING ("column")),
  i AS (SELECT *, CASE WHEN role IN ('identifier', 'quasi_identifier') THEN 1 WHEN role IN ('code_categorical', 'entity_name', 'geo_code', 'high_card_categorical') THEN greatest(u1, empirical_weight) ELSE greatest(u1, u2) END AS signal FROM x),
  pt AS (SELECT least(greatest(unique_count, unique_ratio * rows), rows)::DOUBLE AS n FROM i WHERE lhs AND analysis_mode <> 'binned' AND signal >= .6 AND unique_count >= 128),
  op AS (SELECT * FROM i WHERE rhs AND role NOT IN ('identifier', 'quasi_identifier', 'near_identifier')),
  lo AS (SELECT 1 - greatest(0, least(1, (unique_ratio - .02) / .10)) AS v FROM op WHERE unique_ratio < .3),
  hi AS (SELECT sqrt(u1) AS v FROM op WHERE unique_ratio < .3 UNION ALL SELECT .5 * sqrt((unique_ratio - .2) / .4) FROM op WHERE unique_ratio >= .3 AND unique_ratio < .6),
  t AS (SELECT (SELECT max(rows) FROM x)::DOUBLE AS rows, (SELECT count(*) FROM x WHERE lhs)::DOUBLE AS lhs_columns, (SELECT count(*) FROM x WHERE rhs)::DOUBLE AS rhs_columns,
    (SELECT coalesce(greatest(avg(signal), quantile_cont(signal, .75)), 0) FROM i WHERE lhs) AS identifier_strength, (SELECT coalesce(greatest(avg(v), quantile_cont(v, .75)), 0) FROM lo) AS low_card_strength,
    (SELECT coalesce(greatest(avg(v), quantile_cont(v, .75)), 0) FROM hi) AS high_card_strength, (SELECT coalesce(quantile_cont(n, .5), 0) FROM pt) AS pattern_median, (SELECT coalesce(quantile_cont(n, .75), 0) FROM pt) AS pattern_p75),
  d AS (SELECT *, identifier_strength * low_card_strength AS ids, greatest(high_card_strength, identifier_strength * low_card_strength) AS need, greatest(.7, least(.88, .88 - .18 * greatest(high_card_strength, .5 * low_card_strength))) AS bar FROM t),
  z AS (SELECT rows, lhs_columns, rhs_columns, identifier_strength, low_card_strength, high_card_strength, pattern_median, pattern_p75, greatest(12, least(48, 12 + 36 * high_card_strength)) AS support_beta,
    CASE WHEN high_card_strength >= .45 THEN 2 ELSE 3 END::DOUBLE AS min_support_count, greatest(.01, least(.02, .02 - .01 * high_card_strength)) AS min_retained_mass, bar AS min_s_ent, bar AS min_s_acc, bar AS min_score,
    greatest(.35, least(.8, .8 - .45 * need)) AS model_score_weight, greatest(.04, least(.1, .04 + .06 * high_card_strength)) AS delta_gain,
    greatest(-.02, least(.08, -.02 + .1 * greatest(identifier_strength, .3 * high_card_strength))) AS min_direction_margin, greatest(0, least(.25, .25 * least(1, pattern_p75 / 5000) * least(1, lhs_columns / 15))) AS min_weighted_non_null_ratio,
    CASE WHEN lhs_columns >= 8 AND high_card_strength >= .3 THEN 3 ELSE 2 END::DOUBLE AS max_lhs_size FROM d)
  SELECT name, round(value, 6) AS value FROM (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM z) ON COLUMNS(*) INTO NAME name VALUE value)"""


@query(_SUMMARY)
def profile_summary(spark, sf_dir):
    """What the profile says about the table, and the settings tuned to it."""
    rows = profile.profile(sales(spark, sf_dir)).collect()
    summary = profile.summarize(rows, max(r["rows"] for r in rows), Settings())
    fitted = profile.tuned(Settings(), summary)
    names = ["support_beta", "min_support_count", "min_retained_mass", "min_s_ent", "min_s_acc", "min_score", "model_score_weight", "delta_gain", "min_direction_margin", "min_weighted_non_null_ratio", "max_lhs_size"]
    pairs = [(k, float(v)) for k, v in vars(summary).items()] + [(n, float(getattr(fitted, n))) for n in names]
    return rounded(spark.createDataFrame(pairs, "name string, value double"))


@query(f"""WITH {SALES_SQL}, c AS (SELECT l_partkey, l_returnflag AS a, count(*) AS k FROM w GROUP BY ALL),
  p AS (SELECT l_partkey, sum(k)::BIGINT AS n, greatest(0, ln(sum(k)) - sum(k * ln(k)) / sum(k)) AS entropy, max(k) / sum(k) AS top1, pow(sum(k) + 1, .75) AS priority FROM c GROUP BY 1),
  o AS (SELECT *, row_number() OVER (ORDER BY priority DESC, l_partkey) AS pos, count(*) OVER () AS total FROM p), tail AS (SELECT * FROM o WHERE pos > 100),
  r AS (SELECT *, floor(sum(priority) OVER (ORDER BY pos) / sum(priority) OVER () * 200 + .5) AS step FROM tail), h AS (SELECT *, step > coalesce(lag(step) OVER (ORDER BY pos), 0) AS hit FROM r),
  f AS (SELECT *, sum((NOT hit)::INT) OVER (ORDER BY pos) - 1 AS f, sum((NOT hit)::INT) OVER () AS frees, 200 - sum(hit::INT) OVER () AS want FROM h),
  i AS (SELECT *, -((-f * (want - 1)) // greatest(frees - 1, 1)) AS i0 FROM f),
  chosen AS (SELECT l_partkey FROM o WHERE pos <= 100 OR total <= 300 UNION SELECT l_partkey FROM i WHERE hit OR (want > 0 AND (f = 0 OR (want > 1 AND i0 < want AND i0 * (frees - 1) // (want - 1) = f)))),
  q AS (SELECT p.* FROM p SEMI JOIN chosen USING (l_partkey))
  SELECT l_partkey, n, n AS eff, round(entropy, 6) AS entropy, round(top1, 6) AS top1, 1::DOUBLE AS non_null_ratio, round(priority, 6) AS priority, round(n / sum(n) OVER (), 6) AS weight, round(n / (n + 12.0), 6) AS empirical_weight FROM q""")
def support_budget(spark, sf_dir):
    """Head and tail of a capped support table."""
    s = Settings(max_support_rows=300, support_head_rows=100)
    return rounded(counts.support(sales(spark, sf_dir), ["l_partkey"], "l_returnflag", s))


# --- scores -------------------------------------------------------------------


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


def _counts_sql(wanted) -> str:
    """c: cand, lhs, rhs, x (left values), a (right value), k of all candidates."""
    parts = [f"SELECT {i} AS cand, '{','.join(lhs)}' AS lhs, '{rhs}' AS rhs, concat_ws('|', {', '.join(lhs)}) AS x, {rhs}::VARCHAR AS a, count(*) AS k FROM w GROUP BY {', '.join(lhs)}, {rhs}" for i, (lhs, rhs) in enumerate(wanted)]
    return f"c AS MATERIALIZED ({_union(parts)})"


def _scores_sql(wanted, keeps: str = "true", before: str = "") -> str:
    """c and what follows from it: m (marginals), p (patterns), z (strengths), y (coverage)."""
    return f"""{SALES_SQL}, {before}{_counts_sql(wanted)},
  mc AS (SELECT cand, a, sum(k) AS k FROM c GROUP BY ALL),
  m AS (SELECT cand, ln(sum(k)) - sum(k * ln(k)) / sum(k) AS h, max(k) / sum(k) AS t, count(*) AS v FROM mc GROUP BY cand),
  p AS (SELECT cand, lhs, rhs, x, sum(k) AS n, greatest(0, ln(sum(k)) - sum(k * ln(k)) / sum(k)) AS ent, max(k) / sum(k) AS top FROM c GROUP BY ALL HAVING {keeps}),
  z AS (SELECT cand, lhs, rhs, count(*) AS support_rows, sum(n) AS tot, sum(n) / (SELECT count(*) FROM w) AS retained_mass,
    sum(n * greatest(0, least(1, 1 - ent / greatest(h, .05 * ln(greatest(v + 4, 2)), 1e-12)))) / sum(n) AS s_ent, sum(n * greatest(0, least(1, (top - t) / greatest(1 - t, 1e-12)))) / sum(n) AS s_acc
    FROM p JOIN m USING (cand) GROUP BY cand, lhs, rhs),
  y AS (SELECT *, .75 + .25 * (2 * least(1, ln(1 + support_rows) / ln(65)) + least(1, retained_mass / .1) + 1) / 4 AS coverage FROM z)"""


_LEVEL1 = _scores_sql(PAIRS)


def pair_scores(spark, sf_dir, wanted=PAIRS, settings: Settings = EMPIRICAL, facts: dict | None = None, shapes: tuple[int, DataFrame] | None = None) -> DataFrame:
    """Scores of candidates over all rows of the sales table.  ``facts`` has the profile's
    row of each column; without it, no column counts as an identifier or as high-card.
    ``shapes`` has what ``pair_shapes`` gives, if it is there already."""
    meta = []
    for i, (lhs, rhs) in enumerate(wanted):
        signal = sum(identifier_value(facts[c]["role"], facts[c]["unique_ratio"], settings) for c in lhs) / len(lhs) if facts else 0.0
        sparse = any(facts[c]["unique_ratio"] > settings.high_card_lhs_unique_ratio for c in lhs) if facts else False
        meta.append((i, list(lhs), rhs, signal, facts[rhs]["unique_ratio"] if facts else 0.5, facts[rhs]["unique_count"] if facts else 100, sparse, 1.0))
    if wanted is PAIRS and not settings.max_support_rows:
        rows, found = shapes or pair_shapes(spark, sf_dir)
        return core_scores(shape_stats(found), shape_marginals(found, PAIRS, rows), candidate_meta(spark, meta), rows, settings)
    w = counts.hashed(sales(spark, sf_dir), sorted({c for lhs, rhs in wanted for c in (*lhs, rhs)}))
    patterns = counts.pattern_stats(counts.contingencies(w, wanted), ["cand", "lhs"])
    return core_scores(patterns, counts.marginal_stats(w, w.columns), candidate_meta(spark, meta), w.count(), settings)


def pair_shapes(spark, sf_dir) -> tuple[int, DataFrame]:
    """The number of rows of the sales table, and the shapes of the patterns of all pairs."""
    w = kept_sales(spark, sf_dir, lambda df: counts.exact(df, SALES), cells=counts.exact)
    out = pattern_shapes(w, PAIRS)
    drop_kept(w)
    return out


def _sides() -> list:
    """Names for both sides of a candidate."""
    return [F.concat_ws(",", "lhs_columns").alias("lhs"), F.col("rhs_column").alias("rhs")]


@query(f"""WITH {_LEVEL1} SELECT lhs, rhs, support_rows, round(retained_mass, 6) AS retained_mass, round(s_ent, 6) AS s_ent, round(s_acc, 6) AS s_acc, round(coverage, 6) AS coverage_factor,
  round(greatest(0, least(1, (.6 * s_ent + .4 * s_acc) * coverage)), 6) AS score FROM y""")
def fd_level1_scores(spark, sf_dir):
    found = pair_scores(spark, sf_dir)
    return rounded(found.select(*_sides(), "support_rows", "retained_mass", "s_ent", "s_acc", "coverage_factor", "score"))


@query(f"""WITH {_LEVEL1}, q AS (SELECT cand, x, sum(k) AS n, (max(k) - 1) AS mx, greatest(0, ln(sum(k)) - sum(k * ln(k)) / sum(k)) AS ent FROM c GROUP BY ALL),
  l AS (SELECT cand, n, t, h, v, CASE WHEN n > 1 THEN .25 / (n - 1 + .25) ELSE 1 END AS lean, CASE WHEN n > 1 THEN mx / (n - 1) ELSE 0 END AS lo, ent FROM q JOIN m USING (cand)),
  o AS (SELECT cand, sum(n * greatest(0, least(1, ((1 - lean) * lo + lean * t - t) / greatest(1 - t, 1e-12)))) / sum(n) AS acc,
    sum(n * greatest(0, least(1, 1 - ((1 - lean) * ent + lean * h) / greatest(h, .05 * ln(greatest(v + 4, 2)), 1e-12)))) / sum(n) AS e FROM l GROUP BY cand)
  SELECT lhs, rhs, round(o.e, 6) AS model_s_ent, round(o.acc, 6) AS model_s_acc, round(s_ent, 6) AS empirical_s_ent, round(s_acc, 6) AS empirical_s_acc FROM z JOIN o USING (cand)""")
def fd_backoff_scores(spark, sf_dir):
    found = pair_scores(spark, sf_dir, settings=Settings())
    return rounded(found.select(*_sides(), "model_s_ent", "model_s_acc", "empirical_s_ent", "empirical_s_acc"))


@query(f"WITH {_LEVEL1} SELECT lhs, rhs, round(1 - sum(mx) / sum(n), 6) AS g3 FROM (SELECT lhs, rhs, x, max(k) AS mx, sum(k) AS n FROM c GROUP BY ALL) GROUP BY ALL")
def fd_g3_error(spark, sf_dir):
    _, found = pair_shapes(spark, sf_dir)
    g = found.groupBy("cand").agg((1 - F.sum(F.col("mx") * F.col("times")) / F.sum(F.col("eff") * F.col("times"))).alias("g3"))
    return rounded(g.join(_named(spark), "cand").select("lhs", "rhs", "g3"))


def _named(spark) -> DataFrame:
    return spark.createDataFrame([(i, ",".join(lhs), rhs) for i, (lhs, rhs) in enumerate(PAIRS)], "cand int, lhs string, rhs string")


@query(f"WITH {_LEVEL1} SELECT lhs, rhs, round(coverage, 6) AS coverage FROM y")
def fd_coverage_factor(spark, sf_dir):
    t = pair_scores(spark, sf_dir)
    c = coverage_factor(F.col("support_rows"), F.col("effective_support_rows"), F.col("effective_retained_mass"), F.col("weighted_non_null_ratio"), EMPIRICAL)
    return rounded(t.select(*_sides(), c.alias("coverage")))


_PROFILE = f"{_CELLS}, {_STATS}, {_ROLES}".replace("c AS (", "cells AS (", 1).replace("FROM c GROUP", "FROM cells GROUP").replace("m AS (SELECT", "roles AS (SELECT", 1) + ", "


@query(f"""WITH {_scores_sql(PAIRS, 'sum(k) >= CASE WHEN lhs IN (SELECT "column" FROM s WHERE unique_ratio > .01) THEN 2 ELSE 1 END', _PROFILE)},
  l AS (SELECT cand, n, h, t, v, ent, top, CASE WHEN n > 1 THEN .25 / (n - 1 + .25) ELSE 1 END AS lean, CASE WHEN n > 1 THEN (top * n - 1) / (n - 1) ELSE 0 END AS lo FROM p JOIN m USING (cand)),
  o AS (SELECT cand, sum(n * greatest(0, least(1, ((1 - lean) * lo + lean * t - t) / greatest(1 - t, 1e-12)))) / sum(n) AS model_s_acc,
    sum(n * greatest(0, least(1, 1 - ((1 - lean) * ent + lean * h) / greatest(h, .05 * ln(greatest(v + 4, 2)), 1e-12)))) / sum(n) AS model_s_ent FROM l GROUP BY cand),
  f0 AS (SELECT y.lhs, y.rhs, o.model_s_ent, o.model_s_acc, y.s_ent AS empirical_s_ent, y.s_acc AS empirical_s_acc, support_rows AS effective_support_rows, coverage AS cov, sr.unique_ratio AS u,
    CASE WHEN ml.role IN ('identifier', 'quasi_identifier') THEN 1 ELSE greatest(0, least(1, (ml.unique_ratio - .65) / .25)) END AS identifier, sr.unique_count AS rhs_unique
    FROM y JOIN o USING (cand) JOIN roles ml ON ml."column" = y.lhs JOIN s sr ON sr."column" = y.rhs),
  f1 AS (SELECT *, greatest(0, least(1, (u - .02) / .18)) AS high, 1 - greatest(0, least(1, (u - .02) / .10)) AS low, u <= .02 OR rhs_unique BETWEEN 1 AND 16 AS few,
    greatest(model_s_ent, model_s_acc) >= .3 AS backed, greatest(empirical_s_acc - model_s_acc, 0) AS gap FROM f0),
  g AS (SELECT *, NOT few OR backed AS trusted, greatest(0, least(.9, (.05 + .12 * sqrt(greatest(high, .25 * low)) + .55 * high * identifier + CASE WHEN identifier >= .65 THEN (.6 * high + .15 * low * cov) * identifier ELSE 0 END) * cov)) AS b FROM f1),
  h AS (SELECT *, gap > .15 AND empirical_s_acc >= .9 AND effective_support_rows >= 10 AND trusted AS boosted FROM g),
  i AS (SELECT *, CASE WHEN boosted THEN greatest(0, least(.9, b + least(gap, .75) * greatest(CASE WHEN few THEN .35 ELSE 1 END, high))) ELSE b END * (1 - CASE WHEN boosted THEN .24 ELSE .8 END) AS wt FROM h),
  j AS (SELECT *, model_s_ent + (empirical_s_ent - model_s_ent) * CASE WHEN empirical_s_ent >= model_s_ent THEN wt ELSE wt / 2 END AS e0, model_s_acc + (empirical_s_acc - model_s_acc) * CASE WHEN empirical_s_acc >= model_s_acc THEN wt ELSE wt / 2 END AS a0,
    CASE WHEN identifier >= .65 AND empirical_s_acc >= .9 AND trusted THEN .7 * identifier * greatest(high, .35) ELSE 0 END AS pull FROM i),
  k AS (SELECT *, greatest(0, least(1, e0 + pull * greatest(empirical_s_ent - e0, 0))) AS s_ent, greatest(0, least(1, a0 + pull * greatest(empirical_s_acc - a0, 0))) AS s_acc FROM j)
  SELECT lhs, rhs, round(wt, 6) AS empirical_bonus_weight, round(s_ent, 6) AS s_ent, round(s_acc, 6) AS s_acc, round(greatest(0, least(1, (.6 * s_ent + .4 * s_acc) * cov)), 6) AS score FROM k""")
def fd_fused_scores(spark, sf_dir):
    """Every pair as the search scores it, with the roles and ratios of the profile."""
    shapes = pair_shapes(spark, sf_dir)
    stats = marginal_profile(shape_marginals(shapes[1], PAIRS, shapes[0]))
    facts = {r["column"]: r for r in profile.profile(sales(spark, sf_dir), stats=stats).collect()}
    found = pair_scores(spark, sf_dir, settings=Settings(), facts=facts, shapes=shapes)
    return rounded(found.select(*_sides(), "empirical_bonus_weight", "s_ent", "s_acc", "score"))


@query(f"WITH {_LEVEL1} SELECT f.lhs, f.rhs, round(f.s_acc, 6) AS model_s_acc, round(coalesce(b.s_acc, 0), 6) AS reverse_score, round(f.s_acc - coalesce(b.s_acc, 0), 6) AS direction_margin FROM z f LEFT JOIN z b ON f.lhs = b.rhs AND f.rhs = b.lhs")
def fd_reverse_margin(spark, sf_dir):
    t = reverse_margins(pair_scores(spark, sf_dir))
    return rounded(t.select(*_sides(), "model_s_acc", "reverse_score", "direction_margin"))


def _holdout_sql(lhs: list[str], rhs: str) -> str:
    cols = ", ".join(lhs)
    return f"""SELECT coalesce(avg((j.a = v.{rhs})::INT) FILTER (j.a IS NOT NULL), 0) AS accuracy, count(j.a) / count(*) AS coverage, count(j.a) AS examples
  FROM (SELECT * FROM ws WHERE split = 'val') v LEFT JOIN (SELECT * FROM (SELECT {cols}, {rhs} AS a, row_number() OVER (PARTITION BY {cols} ORDER BY count(*) DESC, o.n DESC, {rhs}) AS r
    FROM ws JOIN (SELECT {rhs} AS oa, count(*) AS n FROM ws WHERE split = 'train' GROUP BY 1) o ON {rhs} = o.oa WHERE split = 'train' GROUP BY {cols}, {rhs}, o.n) WHERE r = 1) j USING ({cols})"""


_HOLD = [(["l_partkey"], "p_brand"), (["o_custkey"], "o_orderstatus"), (["l_returnflag"], "l_linestatus")]


@query(f"WITH {SALES_SQL}, {_WSPLIT} " + _union([f"SELECT '{'+'.join(lhs)}' AS lhs, '{rhs}' AS rhs, round(accuracy, 6) AS accuracy, round(coverage, 6) AS coverage, examples FROM ({_holdout_sql(lhs, rhs)})" for lhs, rhs in _HOLD]))
def fd_holdout_accuracy(spark, sf_dir):
    w = split_sales(spark, sf_dir)
    train, val = w.where("split = 'train'"), w.where("split = 'val'")
    out = None
    for lhs, rhs in _HOLD:
        one = estimate.holdout(train, val, lhs, rhs).select(F.lit("+".join(lhs)).alias("lhs"), F.lit(rhs).alias("rhs"), "accuracy", "coverage", "examples")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query(f"""WITH {SALES_SQL}, {_WSPLIT}, h AS ({_union([f"SELECT {i} AS i, * FROM ({_holdout_sql(lhs, 'l_linestatus')})" for i, lhs in enumerate((["l_returnflag", "o_orderstatus"], ["l_returnflag"], ["o_orderstatus"]))])})
  SELECT round(max(accuracy) FILTER (i = 0), 6) AS accuracy, round(max(accuracy) FILTER (i > 0 AND examples >= 64), 6) AS best_subset, round(max(accuracy) FILTER (i = 0) - max(accuracy) FILTER (i > 0 AND examples >= 64), 6) AS lift FROM h""")
def fd_subset_lift(spark, sf_dir):
    w = split_sales(spark, sf_dir)
    train, val = w.where("split = 'train'"), w.where("split = 'val'")
    whole = estimate.holdout(train, val, ["l_returnflag", "o_orderstatus"], "l_linestatus").select("accuracy")
    parts = [estimate.holdout(train, val, [c], "l_linestatus") for c in ("l_returnflag", "o_orderstatus")]
    best = parts[0].unionByName(parts[1]).where("examples >= 64").agg(F.max("accuracy").alias("best_subset"))
    return rounded(whole.join(best).withColumn("lift", F.col("accuracy") - F.col("best_subset")))


# --- conditional distributions ------------------------------------------------


@query(f"""WITH {SALES_SQL}, c AS (SELECT o_orderpriority, l_returnflag AS value, count(*) AS k FROM w GROUP BY ALL), p AS (SELECT *, k / sum(k) OVER (PARTITION BY o_orderpriority) AS p, sum(k) OVER (PARTITION BY o_orderpriority) AS n,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY k DESC, value) AS rank FROM c) SELECT o_orderpriority, rank, value, round(p, 6) AS p, round(n / (SELECT count(*) FROM w), 6) AS p_lhs, round(n / (n + 12), 6) AS empirical_weight FROM p WHERE rank <= 3""")
def fd_soft_contingency(spark, sf_dir):
    return rounded(estimate.soft_contingency(sales(spark, sf_dir), ["o_orderpriority"], "l_returnflag"))


@query(f"""WITH {SALES_SQL}, d AS (SELECT l_returnflag, o_orderstatus, l_linestatus AS value, count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag, o_orderstatus) AS p FROM w GROUP BY l_returnflag, o_orderstatus, l_linestatus)
  SELECT l_returnflag, o_orderstatus, round(max(p), 6) AS top1, round(sum(-p * ln(p)), 6) AS entropy FROM d GROUP BY ALL""")
def fd_conditional_query(spark, sf_dir):
    lhs = ["l_returnflag", "o_orderstatus"]
    w = sales(spark, sf_dir)
    evidence = w.select(*lhs).distinct()
    return rounded(estimate.evidence_patterns(evidence, estimate.summary(estimate.conditional(w, lhs, "l_linestatus"), lhs), lhs))


@query(f"""WITH {SALES_SQL}, c AS (SELECT c_mktsegment, l_returnflag AS value, count(*) AS k FROM w GROUP BY ALL), m AS (SELECT l_returnflag AS value, count(*) / (SELECT count(*) FROM w) AS m FROM w GROUP BY 1),
  p AS (SELECT c_mktsegment, value, k, pow((k + 2.0 * m) / (sum(k) OVER (PARTITION BY c_mktsegment) + 2.0), 1 / 1.5) AS q FROM c JOIN m USING (value)) SELECT c_mktsegment, value, k, round(q / sum(q) OVER (PARTITION BY c_mktsegment), 6) AS p FROM p""")
def fd_conditional_smoothed(spark, sf_dir):
    return rounded(estimate.conditional(sales(spark, sf_dir), ["c_mktsegment"], "l_returnflag", strength=2.0, temperature=1.5))


@query(f"""WITH {SALES_SQL}, {_WSPLIT}, d AS (SELECT l_returnflag, o_orderstatus AS value, count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag) AS p FROM ws WHERE split = 'train' GROUP BY l_returnflag, o_orderstatus),
  t AS (SELECT l_returnflag, max(p) AS conf, arg_max(value, (p, value)) AS v, sum(p * p) AS sq FROM d GROUP BY 1),
  r AS (SELECT sq - 2 * coalesce(d.p, 0) + 1 AS brier, conf, (t.v = x.o_orderstatus)::INT AS ok FROM ws x JOIN t USING (l_returnflag) LEFT JOIN d ON d.l_returnflag = x.l_returnflag AND d.value = x.o_orderstatus WHERE split = 'val'),
  b AS (SELECT least(floor(conf * 15), 14) AS bin, count(*) AS n, sum(brier) AS s, avg(conf) AS c, avg(ok) AS a FROM r GROUP BY 1) SELECT sum(n)::BIGINT AS examples, round(sum(s) / sum(n), 6) AS brier, round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM b""")
def calibration_brier_ece(spark, sf_dir):
    w = split_sales(spark, sf_dir)
    return rounded(estimate.brier_and_ece(w.where("split = 'train'"), w.where("split = 'val'"), ["l_returnflag"], "o_orderstatus"))


@query(f"""WITH {SALES_SQL}, {_WSPLIT}, t AS (SELECT * FROM ws WHERE split = 'train'), m AS (SELECT o_orderstatus AS a, count(*) / (SELECT count(*) FROM t) AS m FROM t GROUP BY 1),
  c AS (SELECT l_returnflag AS x, o_orderstatus AS a, count(*) AS k FROM t GROUP BY ALL), d AS (SELECT x, a, (k + m) / (sum(k) OVER (PARTITION BY x) + 1) AS p FROM c JOIN m USING (a)), g(t) AS (VALUES (0.25), (0.5), (0.75), (1.0), (1.5), (2.0), (3.0), (4.0)),
  s AS (SELECT x, t, sum(pow(p, 1 / t)) AS mass FROM d, g GROUP BY ALL), v AS (SELECT l_returnflag AS x, o_orderstatus AS a, count(*) AS n FROM ws WHERE split = 'val' GROUP BY ALL),
  l AS (SELECT t, sum(-ln(greatest(coalesce(pow(p, 1 / t), 0) / mass, 1e-12)) * n) AS loss FROM v JOIN s USING (x) LEFT JOIN d USING (x, a) GROUP BY t)
  SELECT arg_min(t, loss)::DOUBLE AS temperature FROM l""")
def calibration_temperature(spark, sf_dir):
    w = split_sales(spark, sf_dir)
    t = estimate.fit_temperature(w.where("split = 'train'"), w.where("split = 'val'"), ["l_returnflag"], "o_orderstatus")
    return spark.createDataFrame([(t,)], "temperature double")


@query(f"""WITH {SALES_SQL}, {_WSPLIT}, t AS (SELECT * FROM ws WHERE split = 'train'), m AS (SELECT o_orderstatus AS a, count(*) / (SELECT count(*) FROM t) AS m FROM t GROUP BY 1),
  n AS (SELECT l_partkey, count(*) AS n FROM t GROUP BY 1), k AS (SELECT l_partkey, o_orderstatus AS a, count(*) AS k FROM t GROUP BY ALL),
  r AS (SELECT (coalesce(k.k, 0) + m.m) / (coalesce(n.n, 0) + 1) AS p FROM ws v JOIN m ON v.o_orderstatus = m.a LEFT JOIN n USING (l_partkey) LEFT JOIN k ON k.l_partkey = v.l_partkey AND k.a = v.o_orderstatus WHERE v.split = 'val')
  SELECT count(*) AS examples, round(avg(-ln(p)), 6) AS loss FROM r""")
def validation_loss(spark, sf_dir):
    w = split_sales(spark, sf_dir)
    return rounded(masking.validation_loss(w.where("split = 'train'"), w.where("split = 'val'"), ["l_partkey"], "o_orderstatus"))


# --- rules --------------------------------------------------------------------


@query(f"""WITH {SALES_SQL}, c AS (SELECT l_returnflag, l_linestatus, count(*) AS k FROM w GROUP BY ALL), m AS (SELECT l_returnflag, l_linestatus AS v FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY k DESC, l_linestatus) AS r FROM c) WHERE r = 1)
  SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, v AS expected FROM w JOIN m USING (l_returnflag) WHERE l_linestatus <> v""")
def fd_violations(spark, sf_dir):
    """Rows whose right side is not the majority of their pattern."""
    return violations(sales(spark, sf_dir), ["l_returnflag"], "l_linestatus").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "expected")


def violations(df: DataFrame, lhs: list[str], rhs: str) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*lhs).orderBy(F.desc("k"), "rhs"))
    majority = counts.contingency(df, lhs, rhs).where("rhs IS NOT NULL").withColumn("r", rank).where("r = 1").select(*lhs, F.col("rhs").alias("expected"))
    return df.join(majority, lhs).where(F.col(rhs) != F.col("expected"))


_EXACT = "e AS (SELECT lhs, rhs FROM (SELECT cand, lhs, rhs, x, count(*) AS n FROM c GROUP BY ALL) GROUP BY cand, lhs, rhs HAVING max(n) = 1)"


@query(f"WITH {SALES_SQL}, {_counts_sql(PAIRS)}, {_EXACT} SELECT lhs, rhs FROM e")
def fd_exact_rules(spark, sf_dir):
    """Pairs that hold without exception: no left side with two right sides."""
    return _exact_rules(spark, pair_shapes(spark, sf_dir)[1])


def _exact_rules(spark, shapes: DataFrame) -> DataFrame:
    pure = (F.col("eff") == 0) | (F.col("mx") == F.col("n"))
    return shapes.groupBy("cand").agg(F.bool_and(pure).alias("exact")).where("exact").join(_named(spark), "cand").select("lhs", "rhs")


@query(f"""WITH {_LEVEL1}, {_EXACT}, f AS (SELECT lhs, rhs FROM y WHERE .6 * s_ent + .4 * s_acc >= .3), t AS (SELECT (SELECT count(*) FROM f SEMI JOIN e USING (lhs, rhs)) AS hits, (SELECT count(*) FROM f) AS found, (SELECT count(*) FROM e) AS truth)
  SELECT round(hits / found, 4) AS precision, round(hits / truth, 4) AS recall, round(2 * (hits / found) * (hits / truth) / (hits / found + hits / truth), 4) AS f1 FROM t""")
def fd_evaluate(spark, sf_dir):
    """How well a low bar on the plain strengths finds the exact rules."""
    strength = 0.6 * F.col("empirical_s_ent") + 0.4 * F.col("empirical_s_acc")
    shapes = pair_shapes(spark, sf_dir)
    found = pair_scores(spark, sf_dir, shapes=shapes).where(strength >= 0.3).select(F.col("lhs_columns").alias("lhs"), F.col("rhs_column").alias("rhs"))
    return evaluate(found, _exact_rules(spark, shapes[1]).select(F.array("lhs").alias("lhs"), "rhs"))


_FEW = ["l_returnflag", "l_linestatus", "o_orderstatus", "o_orderpriority", "c_nationkey", "n_name", "r_name", "p_brand"]
_WIDER = [(lhs, rhs) for n in (1, 2) for lhs in itertools.combinations(_FEW, n) for rhs in _FEW if rhs not in lhs]


@query(f"""WITH {_scores_sql(_WIDER)}, d AS (SELECT string_split(lhs, ',') AS l, lhs, rhs, (.6 * s_ent + .4 * s_acc) * coverage AS score FROM y)
  SELECT lhs, rhs, round(score, 6) AS score FROM d WHERE NOT EXISTS (SELECT 1 FROM d s WHERE s.rhs = d.rhs AND len(s.l) < len(d.l) AND list_has_all(d.l, s.l) AND (d.score - s.score <= .08 OR (s.score >= .95 AND d.score - s.score < .08)))""")
def fd_minimality(spark, sf_dir):
    """Left sides of one or two columns that gain enough over what is in them."""
    found = pair_scores(spark, sf_dir, _WIDER).select(F.col("lhs_columns").alias("lhs"), F.col("rhs_column").alias("rhs"), "score")
    return rounded(minimal_rules(found).select(F.concat_ws(",", "lhs").alias("lhs"), "rhs", "score"))


def minimal_rules(candidates: DataFrame, floor: float = 0.08) -> DataFrame:
    """Candidates that gain more than ``floor`` over each scored proper subset."""
    s = candidates.select(F.col("lhs").alias("l"), F.col("rhs").alias("r"), F.col("score").alias("t"))
    inside = (F.col("rhs") == F.col("r")) & (F.size("l") < F.size("lhs")) & (F.size(F.array_except("l", "lhs")) == 0)
    gain = F.col("score") - F.col("t")
    return candidates.join(s, inside & ((gain <= floor) | ((F.col("t") >= 0.95) & (gain < max(0.05, floor)))), "left_anti")


def _search_rows(spark, sf_dir, columns=SALES, **options):
    families = {c: f for c, f in SALES_FAMILIES.items() if c in columns}
    w = kept_sales(spark, sf_dir, lambda df: df.select(*columns))
    job = Search(w, Settings(**options), key_columns=[c for c in SALES_KEY if c in columns], overrides=families)
    drop_kept(w)  # the search has its tokens
    try:
        result = job.run()
    finally:
        job.close()
    rows = [(",".join(c.lhs), c.rhs, float(c.score), float(c.s_ent), float(c.s_acc), c.bidirectional) for c in result.candidates]
    return spark.createDataFrame(rows, "lhs string, rhs string, score double, s_ent double, s_acc double, bidirectional boolean")


@query()
def fd_search_full(spark, sf_dir):
    """The whole search over all columns, with the settings that the profile asks for."""
    return _search_rows(spark, sf_dir)


@query(f"WITH {SALES_SQL}, {_counts_sql(PAIRS)}, {_EXACT} SELECT lhs, rhs FROM e")
def fd_search_level1(spark, sf_dir):
    """The rules that a search of single columns finds: on this table, the exact ones."""
    return _search_rows(spark, sf_dir, max_lhs_size=1).select("lhs", "rhs")


@query(f"WITH {SALES_SQL} SELECT l_returnflag, l_linestatus AS rhs, count(*) AS k FROM w GROUP BY ALL")
def streamed_contingency(spark, sf_dir):
    """Counts kept by a stream over the lineitem table, once it has read it all."""
    import tempfile
    import uuid

    from depsift.streaming.maintain import current, running_contingency, start

    one = f"{sf_dir}/lineitem.parquet"
    schema = spark.read.parquet(one).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(one if not one.endswith(".parquet") or _is_folder(spark, one) else one.replace("lineitem.parquet", "{lineitem}.parquet"))
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='depsift-')}"
    if "spark.checkpoint.dir" not in dict(spark.sparkContext.getConf().getAll()) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    place = f"{folder.rstrip('/')}/counts-{uuid.uuid4().hex}"
    q = start(running_contingency(stream, ["l_returnflag"], "l_linestatus"), place)
    q.processAllAvailable()
    q.stop()
    return current(spark, place).select("l_returnflag", "rhs", "k")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


__all__ = ["QUERIES", "SQL", "accuracy_strength", "entropy_strength"]
