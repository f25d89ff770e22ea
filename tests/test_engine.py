"""The engine: queries against SQL, planted rules, properties, files, streams."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from depsift import cli, registry
from depsift.functions import canonical, cleaning, scores
from depsift.operators import counts, estimate, kept, masking, profile, shapes, tokens
from depsift.plans.search import Search, search
from depsift.settings import Settings
from depsift.sources import rules, tables

DATA = "/root/testdata/sf0.001"
GOLDEN = """c_nationkey->n_name c_nationkey->n_regionkey c_nationkey->r_name n_name->c_nationkey n_name->n_regionkey n_name->r_name n_regionkey->r_name r_name->n_regionkey
o_custkey->c_nationkey o_custkey->c_mktsegment o_custkey->n_name o_custkey->n_regionkey o_custkey->r_name l_partkey->p_name l_partkey->p_brand l_partkey->p_type l_partkey->p_size
l_partkey->p_retailprice l_suppkey->s_nationkey l_orderkey->o_custkey l_orderkey->o_orderstatus l_orderkey->o_orderdate l_orderkey->o_orderpriority l_orderkey->c_nationkey
l_orderkey->c_mktsegment l_orderkey->n_name l_orderkey->n_regionkey l_orderkey->r_name""".split()


@pytest.mark.parametrize("name", [n for n in registry.SQL if n != "fd_search_level1"])
def test_same_as_sql(name, same_as_duckdb):
    same_as_duckdb(registry.QUERIES[name], registry.SQL[name])


def test_golden_rules(spark):
    w = tables.sales(spark, "/root/testdata/sf0.01")
    found = search(w, Settings(max_lhs_size=1), key_columns=list(tables.SALES_KEY), overrides=tables.SALES_FAMILIES)
    assert rules.evaluate_rules(found.dependencies, rules.parse_rules(GOLDEN)) == (1.0, 1.0, 1.0)
    assert found.screened  # sketches ruled some pairs out


# --- planted tables -----------------------------------------------------------


def planted(spark, n=4000, noise=0.0, seed=1):
    """a -> b, and a, c -> d with no single column behind it; e is random."""
    r = random.Random(seed)
    b_of = {a: f"b{r.randrange(12)}" for a in range(60)}
    d_of = {(a, c): f"d{r.randrange(40)}" for a in range(60) for c in range(5)}
    rows = []
    for i in range(n):
        a, c = r.randrange(60), r.randrange(5)
        b = b_of[a] if r.random() >= noise else f"b{r.randrange(12)}"
        rows.append((i, f"a{a}", b, f"c{c}", d_of[a, c], f"e{r.randrange(20)}"))
    return spark.createDataFrame(rows, "row_id long, a string, b string, c string, d string, e string")


def test_planted_rules(spark):
    found = search(planted(spark), Settings(max_lhs_size=3), key_columns=["row_id"])
    got = set(found.dependencies)
    assert (("a",), "b") in got and (("a", "c"), "d") in got
    assert not any("e" in lhs or rhs == "e" for lhs, rhs in got)
    assert not any(len(lhs) > 1 and rhs == "b" for lhs, rhs in got)  # nothing to gain over a
    assert not any("row_id" in lhs for lhs, _ in got)


def test_noise_lowers_scores(spark):
    last = 1.1
    for noise in (0.0, 0.1, 0.3):
        job = Search(planted(spark, 2000, noise), Settings(max_lhs_size=1), key_columns=["row_id"])
        job.score([(("a",), "b")], 0.0)
        score = job.scored[("a",), "b"].score
        assert 0 <= score < last
        last = score
        job.close()


def test_screening_loses_no_rule(spark):
    df = planted(spark, 2000, 0.05)
    runs = [search(df, Settings(max_lhs_size=2), key_columns=["row_id"], screen=s).dependencies for s in (True, False)]
    assert runs[0] == runs[1]


def test_rows_in_any_order_and_names_of_any_kind(spark):
    df = planted(spark, 1500)
    one = search(df, Settings(max_lhs_size=2), key_columns=["row_id"]).dependencies
    two = search(df.orderBy(F.rand(3)).repartition(5), Settings(max_lhs_size=2), key_columns=["row_id"]).dependencies
    names = {"a": "alpha", "b": "beta", "c": "gamma", "d": "delta", "e": "eps", "row_id": "row_id"}
    renamed = search(df.toDF(*(names[c] for c in df.columns)), Settings(max_lhs_size=2), key_columns=["row_id"]).dependencies
    assert one == two
    assert sorted(renamed) == sorted((tuple(sorted(names[x] for x in lhs)), names[rhs]) for lhs, rhs in one)


def test_empty_and_constant_tables(spark):
    df = spark.createDataFrame([("x", 1)] * 20, "a string, b int").withColumn("n", F.monotonically_increasing_id())
    assert search(df, key_columns=["n"]).dependencies == []
    with pytest.raises(TypeError):
        profile.families(spark.read.parquet(f"{DATA}/embeddings.parquet"))


# --- support ------------------------------------------------------------------


def test_support_edges(spark):
    rows = [("x", "1")] * 3 + [("x", "2")] + [("y", None)] * 4 + [(None, "1")] * 2 + [("z", "1")]
    df = spark.createDataFrame(rows, "l string, r string")
    got = {r["l"]: r for r in counts.support(df, ["l"], "r").collect()}
    assert set(got) == {"x", "y", "z"}
    assert got["y"]["eff"] == 0 and got["y"]["entropy"] == 0 and got["y"]["top1"] == 0 and got["y"]["non_null_ratio"] == 0
    assert got["x"]["top1"] == 0.75 and got["x"]["entropy"] == pytest.approx(-(0.75 * math.log(0.75) + 0.25 * math.log(0.25)))
    assert sum(r["weight"] for r in got.values()) == pytest.approx(1)
    assert counts.support(df.limit(0), ["l"], "r").count() == 0
    strict = counts.support(df, ["l"], "r", Settings(min_non_null_ratio=0.5)).collect()
    assert {r["l"] for r in strict} == {"x", "z"}
    shrunk = counts.support(df, ["l"], "r", Settings(independence_weight=0.5)).collect()
    assert sum(r["weight"] for r in shrunk) == pytest.approx(1)


def test_budget_keeps_its_size(spark):
    df = spark.range(3000).select((F.col("id") % 700).cast("string").alias("l"), (F.col("id") % 3).cast("string").alias("r"))
    for limit, head in ((100, 40), (256, 256), (700, 10), (2000, 10)):
        assert counts.support(df, ["l"], "r", Settings(max_support_rows=limit, support_head_rows=head)).count() == min(limit, 700)


@pytest.mark.parametrize("limit, head", [(60, 10), (41, 40), (30, 30), (90, 0)])
def test_budget_takes_head_and_spread_of_the_tail(spark, limit, head):
    import bisect

    r = random.Random(limit)
    rows = [(c, f"{c}{i:03}") for c in "ab" for i in range(100) for _ in range(r.choice([1, 1, 2, 3, 5, 8, 40]))]
    patterns = spark.createDataFrame(rows, "cand string, l string").groupBy("cand", "l").count().select("cand", "l", F.pow(F.col("count") + 1.0, F.lit(0.75)).alias("priority"))
    known = [tuple(x) for x in patterns.collect()]
    s = Settings(max_support_rows=limit, support_head_rows=head)
    got = {(x["cand"], x["l"]) for x in counts.budget(patterns, ["l"], s, by=["cand"]).collect()}
    one = {x["l"] for x in counts.budget(patterns.where("cand = 'a'").drop("cand"), ["l"], s).collect()}
    assert one == {l for c, l in got if c == "a"}
    for cand in "ab":
        order = sorted(((p, l) for c, l, p in known if c == cand), key=lambda x: (-x[0], x[1]))
        tail, rest = order[head:], limit - head
        run, total = [], sum(p for p, _ in tail)
        for p, _ in tail:
            run.append((run[-1] if run else 0) + p)
        taken = {min(bisect.bisect_left(run, (i + 0.5) / rest * total), len(tail) - 1) for i in range(rest)}
        free = [i for i in range(len(tail)) if i not in taken]
        want = rest - len(taken)
        taken |= {free[i * (len(free) - 1) // max(want - 1, 1)] for i in range(want)}
        assert {l for c, l in got if c == cand} == {l for _, l in order[:head]} | {tail[i][1] for i in taken}


def test_capped_and_batched_scores_agree(spark):
    df, s = planted(spark, 3000, 0.2), Settings(max_support_rows=20, support_head_rows=5)
    job = Search(df, s, key_columns=["row_id"], tune=False)
    job.score([(("a",), "b")], 0.0)
    assert job.scored[("a",), "b"].support_rows == 20
    job.close()


def test_orders_and_quantiles_in_buckets(spark):
    from depsift.operators.order import numbered, place_in

    r = random.Random(5)
    values = [r.choice([r.random() * 100, float(r.randrange(5)), float("inf") if r.random() < 0.05 else -3.0]) for _ in range(3000)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, i int")
    got = numbered(df, [F.col("v"), F.col("i")], place_in(F.col("v"), F.array(F.lit(0.0), F.lit(3.0), F.lit(50.0))), sums={"run": F.col("i")}).orderBy("__at").collect()
    order, run = sorted((v, i) for i, v in enumerate(values)), 0
    for at, (x, (v, i)) in enumerate(zip(got, order, strict=True), 1):
        run += i
        assert (x["__at"], x["v"], x["i"], x["run"]) == (at, v, i, run)
    finite = [v for v in values if v != float("inf")]
    import numpy as np

    edges = tokens.quantiles(df.withColumn("w", F.when(F.col("v") < 1e9, F.col("v"))), {"a": F.col("w"), "none": F.lit(None), "one": F.lit(7)}, 32)
    assert edges["a"] == pytest.approx(sorted(set(np.quantile(finite, [i / 32 for i in range(33)]).tolist())))
    assert edges["none"] == [0.0, 1.0] and edges["one"] == [7.0, 8.0]


def test_tokens_fold_forms(spark):
    df = spark.createDataFrame([("ﬁne", "x"), ("fine", "y"), (None, "①")], "a string, b string")
    got = tokens.tokens(df, {"a": "categorical", "b": "categorical"}).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("fine", "x"), ("fine", "y"), (None, "1")], key=repr)


def test_widest_left_side_follows_the_profile():
    many = profile.Summary(100, 8, 8, 0.0, 0.0, 0.3, 0.0, 0.0)
    few = profile.Summary(100, 7, 8, 0.0, 0.0, 0.9, 0.0, 0.0)
    assert profile.tuned(Settings(), many).widest == 3 and profile.tuned(Settings(), few).widest == 2
    assert profile.tuned(Settings(max_lhs_size=1), many).widest == 1 and Settings().widest == 2


def test_more_columns_never_agree_less(spark):
    df = planted(spark, 1500, 0.2)

    def agreement(lhs):
        return df.count() * counts.pattern_stats(counts.contingency(df, lhs, "b"), lhs).agg(F.sum(F.col("top1") * F.col("eff"))).first()[0]

    assert agreement(["a"]) <= agreement(["a", "c"]) + 1e-6 <= agreement(["a", "c", "e"]) + 2e-6


def test_accuracy_bound_holds(spark):
    df = planted(spark, 1500, 0.3).drop("row_id")
    table = counts.hashed(df, df.columns)
    ones, twos = counts.distinct_sketches(table, df.columns, counts.all_pairs(df.columns))
    for (a, b), n in twos.items():
        stats = counts.pattern_stats(counts.contingency(df, [a], b), [a]).agg((F.sum(F.col("top1") * F.col("eff")) / F.sum("n")).alias("t")).first()["t"]
        assert stats <= counts.accuracy_bound(1500, ones[a], n) + 0.06


# --- functions ----------------------------------------------------------------


def test_canonical_text(spark):
    given = [" Foo", "foo", "FOO  ", "f`oo", "", "   ", "Unknown", "a \t\n b", None, "ﬁne", "① x"]
    df = canonical.fold_forms(spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, v string"), "v")
    got = [r[1] for r in df.select("i", canonical.canonical_text(F.col("v"), ("Unknown",))).orderBy("i").collect()]
    assert got == ["foo", "foo", "foo", "f'oo", None, None, None, "a b", None, "fine", "1 x"]
    plain = spark.createDataFrame([("a",)], "v string")
    assert canonical.fold_forms(plain, "v") is plain


def test_numbers_and_buckets(spark):
    df = spark.createDataFrame([("1.9",), ("-1.9",), ("x",), (None,), ("NaN",), ("1e3",)], "v string")
    assert [r[0] for r in df.select(canonical.canonical_integer(F.col("v"))).collect()] == ["1", "-1", None, None, None, "1000"]
    one = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert tokens.quantile_edges(one, "v") == [5.0, 6.0] and tokens.quantile_edges(one.limit(0), "v") == [0.0, 1.0]
    edges = [0.0, 1.0, 2.0, 3.0]
    values = spark.createDataFrame([(x,) for x in (-5.0, 0.0, 1.0, 1.5, 2.0, 9.0, None, float("nan"))], "v double")
    assert [r[0] for r in values.select(tokens.bucket_of(F.col("v"), edges)).collect()] == [0, 0, 1, 1, 2, 2, None, None]


def test_cleaning(spark):
    df = spark.createDataFrame([("$350,00", "12-ab -7", "2001-01-01", " T "), (" $ 1,200.5", "none", "soon", "0"), (None, None, None, None)], "a string, b string, c string, d string")
    got = df.select(cleaning.currency(F.col("a")), cleaning.first_integer(F.col("b")), cleaning.days_since_2000(F.col("c")), cleaning.boolean(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(35000.0, 12.0, 366, 1), (1200.5, None, None, 0), (None, None, None, None)]
    assert cleaning.is_boolean(df, "d") and not cleaning.is_boolean(df, "a")
    z = cleaning.zscore(spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "a double, b double"), ["a", "b"]).collect()
    assert [tuple(r) for r in z] == [(-1.0, 0.0), (1.0, 0.0)]
    assert cleaning.standardized_interval(1.0, 3.0, 2.0, 2.0) == (-0.5, 0.5)


def test_scores():
    assert scores.ramp_value(1, 2, 2) == 0 and scores.ramp_value(2, 2, 2) == 1
    assert [scores.group_label(c) for c in ("p1_title", "key2", "name", "p2")] == ["1", "2", None, "2"]
    s = Settings()
    assert scores.group_factor(("p1id",), "p2title", s) == 0.35 and scores.group_factor(("p1id",), "p1title", s) == 1.0
    assert scores.group_factor(("p1id",), "p2title", s.with_options(group_match="hard")) == 0.0
    assert scores.extrapolated_patterns(100, 0.5, 200, 1000) == 500 and scores.extrapolated_patterns(0, 0.5, 200, 1000) == 0
    with pytest.raises(ValueError):
        Settings(max_lhs_size=0)
    assert Settings(mode="odd").mode == "balanced"


def test_roles_by_name_and_mode(spark):
    n = 5000
    df = spark.range(n).select(
        F.col("id").cast("string").alias("row"), (F.col("id") % 3000).cast("string").alias("account"), (F.col("id") % 400).cast("string").alias("zip"), (F.col("id") % 400).cast("string").alias("city"),
        (F.col("id") % 400).cast("string").alias("first_name"), (F.col("id") % 400).cast("string").alias("area_code"), (F.col("id") % 400).cast("string").alias("other"), (F.col("id") % 3).cast("string").alias("kind"),
        F.lit(1).alias("one"), (F.col("id") % 7).cast("int").alias("small"), (F.col("id") / 2).alias("amount"),
    )
    got = {r["column"]: r for r in profile.profile(df).collect()}
    assert {c: r["role"] for c, r in got.items()} == {
        "row": "identifier", "account": "quasi_identifier", "zip": "geo_code", "city": "location_categorical", "first_name": "entity_name", "area_code": "code_categorical",
        "other": "high_card_categorical", "kind": "semantic_categorical", "one": "constant", "small": "discrete_numeric", "amount": "identifier",
    }
    assert not got["row"]["lhs"] and not got["one"]["rhs"] and got["account"]["rhs"]
    strict = {r["column"]: r for r in profile.profile(df, mode="strict", target="kind").collect()}
    assert strict["account"]["lhs"] and not strict["account"]["rhs"] and not strict["kind"]["lhs"]
    about = {r["column"]: r["unique_count"] for r in profile.approximate_column_stats(df).collect()}
    assert abs(about["account"] - 3000) < 200


def test_holdout_and_temperature(spark):
    train = spark.createDataFrame([("x", "1")] * 3 + [("x", "2")] + [("y", "2")] * 2 + [(None, "2")], "l string, r string")
    val = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "2"), ("z", "1"), (None, "1"), ("x", None)], "l string, r string")
    got = estimate.holdout(train, val, ["l"], "r").first()
    assert (got["accuracy"], got["coverage"], got["examples"]) == (pytest.approx(2 / 3), 0.75, 3)
    assert estimate.holdout(train, val.limit(0), ["l"], "r").first()["accuracy"] == 0.0
    assert estimate.fit_temperature(train, val, ["l"], "r") > 0


def test_temperature_of_all_validation_rows(spark):
    train = spark.createDataFrame([("x", "1")] * 8000 + [("x", "2")] * 2000, "l string, r string")
    val = [("x", "1")] * 700 + [("x", "2")] * 300 + [("z", "1")] * 50 + [("x", None)] * 50
    # Any 512 rows that take equal ones together end at 0.25 or 4.
    assert estimate.fit_temperature(train, spark.createDataFrame(val, "l string, r string"), ["l"], "r") == 1.5
    assert estimate.fit_temperature(train, spark.createDataFrame([("z", "1")], "l string, r string"), ["l"], "r") == 1.0


def test_masks_and_objectives(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("k"), *(F.lit(c).alias(c) for c in "abcde"))
    rows = masking.observed(df, F.col("k"), list("abcde")).collect()
    sizes = {len(r["observed"]) for r in rows}
    assert sizes <= {1, 2, 3, 4} and len(sizes) == 3
    assert rows == masking.observed(df.repartition(3), F.col("k"), list("abcde")).orderBy(F.col("k").cast("int")).collect()
    assert rows != masking.observed(df, F.col("k"), list("abcde"), seed=1).collect()
    columns = [{"name": c, "unique_ratio": u, "identifier": u} for c, u in (("a", 0.9), ("b", 0.1), ("c", 0.0))]
    drawn = masking.objectives(columns, 500)
    assert all(rhs not in lhs and 1 <= len(lhs) <= 2 for lhs, rhs in drawn) and drawn == masking.objectives(columns, 500)
    train = spark.createDataFrame([("x", "1")] * 5 + [("y", "2")] * 5, "l string, r string")
    losses = [masking.validation_loss(train, train, ["l"], "r", strength=k, weighted=w).first() for k, w in ((0.01, False), (5.0, False), (0.01, True))]
    assert losses[0]["examples"] == 10 and losses[0]["loss"] < 0.01 < losses[1]["loss"]


def test_label_codes(spark):
    df = spark.createDataFrame([(1, " b"), (2, "a"), (3, "b "), (4, None)], "i int, v string")
    assert {r["value"]: r["code"] for r in tokens.label_codes(df, "v", F.col("i")).collect()} == {"b": 0, "a": 1}


# --- files, command line, stream ----------------------------------------------


def test_rules_files(tmp_path):
    parsed = rules.parse_rules(["# a comment", "", "b-x,a -> c-d", "e->f"])
    assert parsed == [(("a", "b_x"), "c_d"), (("e",), "f")]
    with pytest.raises(ValueError):
        rules.parse_rules(["no arrow"])
    assert rules.evaluate_rules(parsed, [(("b_x", "a"), "c_d")]) == (0.5, 1.0, 0.6667)
    rules.write_report(str(tmp_path / "out" / "r.txt"), parsed, (0.5, 1.0, 0.6667), 12)
    assert (tmp_path / "out" / "r.txt").read_text().splitlines() == ["a,b_x->c_d", "e->f", "Precision: 0.5000", "Recall: 1.0000", "F1: 0.6667", "Runtime: 12 ms"]


def test_command_line(spark, tmp_path, capsys):
    table = str(tmp_path / "t.csv")
    planted(spark, 800).toPandas().to_csv(table, index=False)
    (tmp_path / "truth.txt").write_text("a->b\n")
    assert cli.main(["search", table, "--key", "row_id", "--columns", "row_id", "a", "b", "e", "--max-lhs-size", "1", "--truth", str(tmp_path / "truth.txt"), "--output", str(tmp_path / "o")]) == 0
    assert "a->b" in capsys.readouterr().out
    summary = json.loads((tmp_path / "o" / "summary.json").read_text())
    assert summary["recall"] == 1.0 and (tmp_path / "o" / "results.jsonl").read_text().count("\n") == summary["candidates_kept"]
    for more in ([], [], ["--force"]):
        assert cli.main(["preprocess", table, "--key", "row_id", "--output", str(tmp_path / "p"), *more]) == 0
    assert json.loads((tmp_path / "p" / "summary.json").read_text())["rows_total"] == 800
    assert rules.read_schema(spark, str(tmp_path / "p")).fieldNames()[0] == "split"
    assert cli.main(["calibrate", table, "--key", "row_id", "--output", str(tmp_path / "p"), "--lhs", "a", "--rhs", "b"]) == 0
    assert "temperature" in capsys.readouterr().out
    assert cli.main(["profile", table, "--sample-rows", "100"]) == 0


def test_stream_follows_new_rows(spark, tmp_path):
    from depsift.streaming.maintain import current, running_contingency, start

    folder = str(tmp_path / "in")
    one = spark.createDataFrame([("x", "1"), ("x", None), (None, "1")], "l string, r string")
    one.write.parquet(folder)
    q = start(running_contingency(spark.readStream.schema(one.schema).parquet(folder), ["l"], "r"), str(tmp_path / "out"))
    q.processAllAvailable()
    assert sorted(map(repr, map(tuple, current(spark, str(tmp_path / "out")).collect()))) == sorted(map(repr, [("x", "1", 1), ("x", None, 1)]))
    one.write.mode("append").parquet(folder)
    q.processAllAvailable()
    q.stop()
    assert {r["k"] for r in current(spark, str(tmp_path / "out")).collect()} == {2}


def test_entry_points():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


def _keyed_rows(spark):
    """Keys of many values, columns of few, one of each with a value in a third of the rows
    and with nulls, as hashes."""
    rows = spark.range(30_000, numPartitions=5).selectExpr(
        "id", "id div 3 AS pair", "IF(id % 3 = 0, 7, IF(id % 11 = 0, NULL, id div 2)) AS holed", "id % 5 AS few", "IF(id % 4 = 0, NULL, (id div 3) % 9) AS gaps", "(id * id) % 1009 AS some"
    )
    return counts.hashed(rows, rows.columns)


def test_shapes_are_those_of_the_patterns(spark, monkeypatch):
    """Whichever values are dealt and whichever are known."""
    w = _keyed_rows(spark)
    wanted = [((a,), b) for a in w.columns for b in w.columns if a != b and (a, b) != ("few", "id")]
    counted = counts.contingencies(w, wanted).groupBy("cand", "lhs").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("rhs").isNotNull(), F.col("k")).otherwise(0)).alias("eff"), F.coalesce(F.max(F.when(F.col("rhs").isNotNull(), F.col("k"))), F.lit(0)).alias("mx"), F.coalesce(F.sum(F.when(F.col("rhs").isNotNull(), F.col("k") * F.log("k"))), F.lit(0.0)).alias("kl"))
    by = ["cand", "n", "eff", "mx", F.round("kl", 6).alias("kl")]
    want = sorted(map(tuple, counted.groupBy(*by).agg(F.count(F.lit(1))).collect()))
    for low, cells in ((4096, 1 << 24), (100, 1 << 24), (4096, 40), (0, 1 << 24)):
        monkeypatch.setattr(shapes, "LOW", low)
        monkeypatch.setattr(shapes, "CELLS", cells)
        rows, found = shapes.pattern_shapes(w, wanted)
        assert rows == 30_000
        assert sorted(map(tuple, found.groupBy(*by).agg(F.sum("times")).collect())) == want
        told = {r["column"]: r for r in shapes.shape_marginals(found, wanted, rows).collect()}
        for r in counts.marginal_stats(w, w.columns).collect():
            assert [told[r["column"]][c] for c in ("total", "valid", "vocabulary")] == [r["total"], r["valid"], r["vocabulary"]]
            assert abs(told[r["column"]]["entropy"] - r["entropy"]) < 1e-9 and abs(told[r["column"]]["top1"] - r["top1"]) < 1e-12


def test_profile_from_shapes_is_that_of_rows(spark):
    w = _keyed_rows(spark)
    wanted = [((a,), "few" if a != "few" else "gaps") for a in w.columns]
    rows, found = shapes.pattern_shapes(w, wanted)
    same = shapes.marginal_profile(shapes.shape_marginals(found, wanted, rows))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, profile.column_stats(w).collect()))


def test_shapes_shuffle_rows_and_not_counts(spark):
    """Fewer bytes than the counts of keys against each column take, which filled the disk."""
    w = _keyed_rows(spark).selectExpr("*", *(f"xxhash64(id % {n}) AS c{n}" for n in range(20, 40))).localCheckpoint()
    wanted = [((a,), b) for a in w.columns for b in w.columns if a != b]

    def written():
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()

    start = written()
    shapes.pattern_shapes(w, wanted)[1].count()
    middle = written()
    counts.pattern_stats(counts.contingencies(w, wanted), ["cand", "lhs"]).groupBy("cand").count().collect()
    assert 0 < middle - start < (written() - middle) / 4


def test_sales_in_slices_are_all_sales(spark):
    one, two = (tables.kept_sales(spark, DATA, small=n) for n in (10**9, 0))
    assert one.count() == two.count() and one.exceptAll(two).isEmpty()


@pytest.mark.parametrize("name", ["fd_level1_scores", "fd_fused_scores", "fd_evaluate", "fd_exact_rules", "fd_g3_error", "fd_reverse_margin", "fd_coverage_factor", "fd_backoff_scores"])
def test_all_pairs_shuffle_no_counts(name, spark, monkeypatch):
    """No query over all pairs goes back to a shuffle of counts."""
    def refused(*_):
        raise AssertionError("counts of pairs are shuffled")

    monkeypatch.setattr(counts, "contingencies", refused)
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_search_counts_singles_by_shapes(spark, monkeypatch):
    """A level of single columns shuffles no counts, and holdouts go in batches of few rows."""
    from depsift.plans import search as plan

    def refused(*_):
        raise AssertionError("counts of pairs are shuffled")

    monkeypatch.setattr(plan, "contingencies", refused)
    whole = search(planted(spark), Settings(max_lhs_size=1), screen=False)
    monkeypatch.setattr(plan, "ROUNDS", 1e-9)
    small = search(planted(spark), Settings(max_lhs_size=1), screen=False)
    assert (("a",), "b") in whole.dependencies and small.dependencies == whole.dependencies
    assert [c.holdout for c in small.candidates] == [c.holdout for c in whole.candidates]


def _shuffle_bytes(spark, run):
    def written():
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()

    start = written()
    run()
    return written() - start


def test_shuffles_of_a_kept_table_end_with_its_write(spark):
    """They filled the disk until the driver happened to collect its garbage."""
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {str(found.apply(i)).rpartition("/")[2] for i in range(found.size())}

    before = files()
    kept.keep(spark.range(20_000).groupBy((F.col("id") % 7000).alias("k")).count(), "counts")
    assert not [f for f in files() - before if f.startswith("shuffle_")]


def test_dealt_numbers_take_the_bytes_they_need(spark):
    """Whole numbers are dealt as distances from the least, whatever their size and steps."""
    near = spark.range(60_000, numPartitions=4).selectExpr("id % 20000 * 128 AS a", "pmod(xxhash64(id), 15000) * 64 AS b", "pmod(xxhash64(id, 1), 9000) AS c")
    far = near.selectExpr("xxhash64(a) AS a", "xxhash64(b) AS b", "IF(c = 0, -9223372036854775808, IF(c = 1, 9223372036854775807, xxhash64(c))) AS c")
    near, far = near.localCheckpoint(), far.localCheckpoint()
    wanted = [((a,), b) for a in near.columns for b in near.columns if a != b]
    told, sizes = [], []
    for table in (near, far):
        by = shapes.pattern_shapes(table, wanted)[1].groupBy("cand", "n", "eff", "mx", F.round("kl", 6))
        told.append(sorted(map(tuple, by.agg(F.sum("times")).collect())))
        sizes.append(_shuffle_bytes(spark, lambda table=table: shapes.pattern_shapes(table, wanted)))
    assert told[0] == told[1]
    assert sizes[0] < 0.7 * sizes[1]


def test_exact_numbers_tell_values_apart(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 2L, 'x', 1.5D), (1, 3L, 'y', 1.5D), (NULL, NULL, NULL, NULL) AS t(i, l, s, d)")
    told = sorted(map(tuple, counts.exact(rows, ["i", "l", "s", "d"]).collect()), key=str)
    hashes = sorted(map(tuple, counts.hashed(rows, ["i", "l", "s", "d"]).collect()), key=str)
    assert {r[:2] for r in told} == {(1, 2), (1, 3), (None, None)} and {r[2:] for r in told} == {r[2:] for r in hashes}


def test_sales_in_many_slices_are_all_sales(spark, monkeypatch):
    """A slice has so many line items, not a half of them."""
    names = []
    monkeypatch.setattr(tables, "keep", lambda df, name: names.append(name) or df)
    monkeypatch.setattr(tables, "SLICE", 1500)
    many = tables.kept_sales(spark, DATA, small=0)
    whole = tables.sales(spark, DATA)
    assert len(names) == 4 and many.count() == whole.count() and many.exceptAll(whole).isEmpty()


def test_wide_shapes_are_those_of_the_patterns(spark, monkeypatch):
    """Left sides of several columns, of known and dealt values, with nulls on both sides."""
    w = _keyed_rows(spark)
    names = w.columns
    wanted = [((*names[:i], *names[i + 1 : 3]), r) for i in range(3) for r in names if r not in (*names[:i], *names[i + 1 : 3])]
    wanted += [(tuple(names[:3]), r) for r in names[3:]]
    counted = counts.pattern_stats(counts.contingencies(w, wanted), ["cand", "lhs"])
    by = ["cand", "n", "eff", F.round("entropy", 6).alias("entropy"), F.round("top1", 6).alias("top1")]
    want = sorted(map(tuple, counted.groupBy(*by).agg(F.count(F.lit(1))).collect()))
    for low in (4096, 0):
        monkeypatch.setattr(shapes, "LOW", low)
        found = shapes.shape_stats(shapes.wide_shapes(w, wanted, names))
        assert sorted(map(tuple, found.groupBy(*by).agg(F.sum("times")).collect())) == want


def test_search_counts_wide_sides_of_many_values_by_shapes(spark, monkeypatch):
    """The same rules and scores as from counts, of which none is shuffled."""
    from depsift.plans import search as plan

    rows = spark.range(3000).selectExpr("id % 60 AS a", "pmod(xxhash64(id), 50) AS b", "pmod(xxhash64(id, 2), 40) AS c").selectExpr("*", "pmod(xxhash64(a, b), 30) AS d").localCheckpoint()
    options = {"overrides": dict.fromkeys(rows.columns, "categorical"), "tune": False, "screen": False}
    settings = Settings(max_lhs_size=2, estimator="empirical")
    monkeypatch.setattr(plan, "LEAD", 0.0)
    before = search(rows, settings, **options)
    monkeypatch.setattr(plan, "LEAD", 0.2)
    monkeypatch.setattr(plan, "FEW", 10**9)

    def refused(*_):
        raise AssertionError("counts are shuffled")

    monkeypatch.setattr(plan, "contingencies", refused)
    after = search(rows, settings, **options)
    assert after.dependencies == before.dependencies and after.counted == before.counted > 12
    assert [(c.lhs, c.rhs, round(c.score, 9)) for c in after.candidates] == [(c.lhs, c.rhs, round(c.score, 9)) for c in before.candidates]


def test_wider_sides_are_scored_where_rows_are_dealt(spark, monkeypatch):
    """Scores and holdouts are those of counts, none of which is shuffled: of sides that others determine,
    of few and of many values, with nulls and without."""
    from depsift.plans import search as plan

    rows = spark.range(6000).selectExpr("id % 900 AS a", "pmod(xxhash64(id), 400) AS b", "pmod(xxhash64(id, 2), 4) AS c", "pmod(xxhash64(id, 3), 3) AS d", "nullif(pmod(xxhash64(id, 4), 40), 7) AS e")
    rows = rows.selectExpr("*", "a % 30 AS f", "29 - a % 30 AS g", "pmod(xxhash64(c, d, b % 50 = 0), 5) AS h").localCheckpoint()
    names = rows.columns
    pairs = [((x, y), r) for i, x in enumerate(names) for y in names[i + 1 :] for r in names if r not in (x, y)]
    job = Search(rows, Settings(max_lhs_size=2), overrides=dict.fromkeys(names, "categorical"), tune=False, screen=False)
    job.score([((x,), r) for x in names for r in names if x != r], floor=0.0)
    pairs = [w for w in pairs if job.allowed(*w)]
    job._count(pairs)
    want = {w: job.scored.pop(w) for w in pairs}
    with monkeypatch.context() as m:
        m.setattr(plan, "contingencies", lambda *_: pytest.fail("counts are shuffled"))
        job.score(pairs, floor=0.0)
    assert len(pairs) > 100
    for w in pairs:
        one, other = (x and x.facts for x in (want[w], job.scored[w]))
        assert (one is None) == (other is None)
        assert one is None or all(abs(x - other[k]) < 1e-9 if isinstance(x, float) else x == other[k] for k, x in one.items() if k != "cand")
    some = [w for w in pairs if "a" in w[0] or "b" in w[0]] + [(("a",), "e"), (("b",), "c")]
    monkeypatch.setattr(plan, "FEW", 0)
    held = job.holdout_stats(some)
    monkeypatch.setattr(plan, "FEW", 10**9)
    with monkeypatch.context() as m:
        m.setattr(plan, "batched_contingency", lambda *_: pytest.fail("counts are shuffled"))
        assert job.holdout_stats(some) == held
    job.close()


def test_a_shuffle_of_dealt_rows_has_a_few_of_the_columns(spark, monkeypatch):
    """The shapes are the same, and no shuffle is as large as that of all columns at once."""
    w = _keyed_rows(spark).selectExpr("*", *(f"xxhash64(id % {n}) AS c{n}" for n in range(20, 40))).localCheckpoint()
    wanted = [((a,), b) for a in w.columns for b in w.columns if a != b]
    by, told, largest = ["cand", "n", "eff", "mx", F.round("kl", 6)], [], []
    real, sizes = shapes.keep, []

    def noted(df, name):
        out = []
        sizes.append(_shuffle_bytes(spark, lambda: out.append(real(df, name))))
        return out[0]

    monkeypatch.setattr(shapes, "keep", noted)
    for whole in (10**9, 0):
        monkeypatch.setattr(shapes, "WHOLE", whole)
        found = shapes.pattern_shapes(w, wanted)[1]
        told.append(sorted(map(tuple, found.groupBy(*by).agg(F.sum("times")).collect())))
        largest.append(max(sizes[2:]))  # after the survey and the known values
        sizes.clear()
    assert told[0] == told[1]
    assert largest[1] < 0.7 * largest[0]


def test_line_items_are_shuffled_once(spark, monkeypatch):
    """Parts and suppliers are sent, after the only shuffle; the rows are those of the whole join."""
    plans, real = [], tables.keep

    def noted(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name)

    def slices(**options):
        sizes = []
        sizes.append(_shuffle_bytes(spark, lambda: sizes.append(tables.kept_sales(spark, DATA, lambda df: counts.exact(df, tables.SALES), small=0, **options))))
        return sizes

    monkeypatch.setattr(tables, "keep", noted)
    monkeypatch.setattr(tables, "SLICE", 1000)
    monkeypatch.setattr(tables, "SLICES", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many, fewer = slices(cells=counts.exact)
        more = slices()[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    whole = counts.exact(tables.sales(spark, DATA), tables.SALES)
    assert len(plans) == 6 and many.count() == whole.count() and many.exceptAll(whole).isEmpty()
    assert fewer < 0.75 * more
