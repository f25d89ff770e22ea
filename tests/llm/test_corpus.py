"""Each corpus operator against brute force on a small table of awkward rows, and
against its SQL on the smallest tables."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from depsift.llm import exact_dedup, html_extract, line_dedup, ngram_join, packing, quality_rules, registry, repeats, source_mix, token_files, toxicity
from depsift.llm.components import components
from depsift.llm.suffix_sort import permuted_common, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, kept boolean, n int, name string"


def awkward() -> list[tuple]:
    """Nulls, empty and long texts, copies, near copies, repeated rows, other columns
    with the names of results."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeéf") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(80), text(30)
    texts = [None, "", " \t\n ", "one", "one two three", "a b c d", "A B C D", "É é", "é É", base, base.upper(), base, base + " end", base.replace(" ", "  ")]
    texts += [f"{text(20)} {passage} {text(20)}" for _ in range(8)]
    texts += [" ".join([*base.split()[:k], "new", *base.split()[k + 1 :]]) for k in (3, 40, 79)]
    texts += ["same " * 60, text(3000), "x" * 9000, "ab" * 100, "ab" * 130, "line one\nline two\nline one\n\n" + text(60), "#*$ %&| <> " * 30, text(5) + " " + text(5), "日本語 テキスト " * 20]
    sources = [None, "b", "a", "a", "a", "c", ""]
    rows = [(i * 3 - 9, t, r.choice(["en", "de", None]), sources[i % len(sources)], True, i, "x") for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (rows[9][0], "another text of that id", "en", "a", None, 0, "y"), (None, base, None, None, None, None, None), (None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def lower(t):
    return (t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


@pytest.mark.parametrize("name", [n for n in registry.SQL])
def test_same_as_sql(name, same_as_duckdb):
    same_as_duckdb(registry.QUERIES[name], registry.SQL[name])


# --- mixing -------------------------------------------------------------------


def test_mix(spark, docs, none):
    sized = source_mix.sized(docs)
    cuts = {r["__s"]: r for r in source_mix.thresholds(sized).collect()}
    sizes = defaultdict(int)
    for _, t, _, s, *_ in awkward():
        sizes[s] += len(words(t))
    order = [*sorted(s for s in sizes if s is not None), None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:  # reshare what is above twice a source's size
        rest = budget - sum(2 * sizes[s] for s in full)
        share = {s: rest * weights[s] / sum(weights[x] for x in order if x not in full) for s in order if s not in full}
        above = {s for s in share if share[s] > 2 * sizes[s]}
        if not above:
            break
        full |= above
    for s in order:
        assert cuts[s]["__size"] == sizes[s]
        assert cuts[s]["__target"] == pytest.approx(2 * sizes[s] if s in full else share[s])
    taken, largest = defaultdict(int), defaultdict(int)
    for r in sized.collect():
        k = cuts[r["__source"]]["__base"] + (r["__place"] <= cuts[r["__source"]]["__cut"])
        assert 0 <= k <= 2
        taken[r["__source"]] += k * r["__size"]
    places = defaultdict(int)
    for r in sized.collect():
        places[r["__source"], r["__place"]] += r["__size"]
    for (s, _), n in places.items():
        largest[s] = max(largest[s], n)
    for s in order:
        assert abs(taken[s] - cuts[s]["__target"]) <= largest[s] / 2 + 1e-9
    again = {r["__s"]: r["__cut"] for r in source_mix.thresholds(sized.repartition(7)).collect()}
    assert again == {s: c["__cut"] for s, c in cuts.items()}
    assert source_mix.mix(none).columns == none.columns and source_mix.mix(none).count() == 0
    assert source_mix.mix(docs).columns == docs.columns
    clash = docs.selectExpr("*", "1 AS __base", "2 AS __s", "3 AS __cut")
    assert source_mix.mix(clash).columns == clash.columns and source_mix.mix(clash).count() == source_mix.mix(docs).count()


# --- exact dedup --------------------------------------------------------------


def test_exact_dedup(docs, none):
    rows = exact_dedup.exact_dedup(docs, block_chars=16).collect()
    groups = defaultdict(list)
    for d, t, *_ in awkward():
        groups[lower(t)].append(d)
    assert len(rows) == len(awkward())
    stays = Counter()
    for r in rows:
        members, verdict = groups[lower(r["text"])], r["__dedup"]
        assert verdict["group_size"] == len(members)
        assert verdict["keep_id"] == max((m for m in members if m is not None), default=None)
        assert verdict["text_sha256"] == hashlib.sha256(lower(r["text"]).encode()).hexdigest()
        stays[lower(r["text"])] += verdict["kept"]
        assert not verdict["kept"] or r["doc_id"] == verdict["keep_id"]
    assert set(stays.values()) == {1}
    assert exact_dedup.exact_dedup(none).count() == 0


# --- quality ------------------------------------------------------------------


def features_of(t):
    w = words(t)
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    seen = defaultdict(list)
    for i in range(len(w) - 2):
        seen[tuple(w[i : i + 3])].append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_features_and_no_labels(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality_rules.quality_rules(docs, labels).collect()
    for r in rows:
        f = r["__quality"]
        assert (f["n_words"], f["word_chars"], f["n_symbols"], f["n_dup_lines"], f["n_repeat_words"]) == features_of(r["text"])
        assert f["base_failed"] == (f["n_words"] < 50 or 100 * f["n_repeat_words"] > 50 * f["n_words"])
        assert f["kept"] == (not f["base_failed"])
    assert len(rows) == len(awkward())
    assert quality_rules.quality_rules(none, labels).count() == 0


def test_quality_cutoffs_hold_the_risk(spark):
    import math

    from pyspark.sql import functions as F

    good = " ".join("word%d" % i for i in range(60))
    bad = " ".join("w%d##" % i for i in range(60))
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, bad).otherwise(good).alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", F.when((F.col("doc_id") % 10 == 0) & (F.col("doc_id") != 50), 0).otherwise(1).alias("quality"))
    rows = quality_rules.quality_rules(docs, labels, carry=["doc_id"]).where("NOT __quality.kept").select("doc_id").collect()
    assert len(rows) == 600 and all(r["doc_id"] % 10 == 0 for r in rows)
    one = spark.createDataFrame([(x, n) for x, n in ((0, 10), (3, 200), (7, 1000), (900, 1000))], "x long, n long")
    for r in one.select("x", "n", quality_rules.binomial_tail(F.col("x"), F.col("n"), 0.02).alias("p")).collect():
        exact = sum(math.comb(r["n"], i) * 0.02**i * 0.98 ** (r["n"] - i) for i in range(r["x"] + 1))
        assert r["p"] == pytest.approx(exact if r["x"] <= 0.02 * r["n"] else 1.0, rel=1e-9)


def test_quality_cutoffs_of_every_stratum_are_those_of_the_sql(spark):
    import duckdb
    import pandas as pd

    r = random.Random(12)
    pool = ["w%d" % i for i in range(500)]

    def text(kind):
        w = r.sample(pool, 60)
        if kind == "symbols":
            w = [x + "#" * r.choice([0, 1, 1]) for x in w]
        elif kind == "repeats":
            w[30:42] = w[:12]
        elif kind == "length":
            w = [x * r.choice([2, 3]) for x in w]
        lines = [" ".join(w[i : i + 10]) for i in range(0, 60, 10)]
        return "\n".join(lines + lines[:2] if kind == "lines" else lines)

    docs, labels = [], []
    for lang in ("en", "de", "fr", None):
        for i in range(2600):
            good = i >= 400
            # A few good documents break rules, fewer than the risk allows in two strata.
            kind = ["symbols", "repeats", "length", "lines"][i % 4] if not good or i % (400 if lang in ("en", None) else 100) == 0 else "plain"
            docs.append((len(docs), text(kind), lang, "x", -1))
            labels.append((docs[-1][0], int(good)))
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, __f string, __words int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    found = quality_rules.quality_rules(table, marks)
    rows = {x["doc_id"]: x["__quality"]["kept"] for x in found.collect()}
    assert found.columns == [*table.columns, "__quality"] and found.where("__f = 'x' AND __words = -1").count() == len(docs)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text", "lang", "f", "w"]).drop(columns=["f", "w"]))
    con.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality"]))
    assert rows == dict(con.execute(quality_rules.SQL).df()[["doc_id", "kept"]].itertuples(index=False))
    measured = quality_rules.features(table.drop("__f", "__words")).selectExpr("doc_id AS __id", "lang AS __stratum", "__f")
    cuts = {x["__s"]: [x[f"__cut_{rule}"] for rule in quality_rules.RULES] for x in quality_rules.cutoffs(measured, marks, risk=0.02, error=0.05).collect()}
    assert set(cuts) == {"en", "de", "fr", None}
    assert all(any(c is not None for c in cuts[s]) for s in ("en", None)) and len({tuple(v) for v in cuts.values()}) > 1
    lost = Counter(docs[d][2] for d, k in rows.items() if not k and labels[d][1])
    assert all(n <= 0.02 * 2200 for n in lost.values()) and sum(not k for k in rows.values()) > 400


# --- near copies --------------------------------------------------------------


def shingle_set(t):
    w = lower(t).split() if t else []
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + 4]) for i in range(max(len(w) - 3, 1))} if w else set()


def brute_components(rows):
    ids = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0]))
    sets, root = [shingle_set(t) for _, t, *_ in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {g: min((x for x in m if x is not None), default=None) for g, m in groups.items()}
    return sorted((repr(rows[i][0]), len(sets[i]), repr(least[find(i)])) for i in range(len(rows)))


@pytest.mark.parametrize("block", [4096, 3])
def test_near_duplicates(docs, none, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = ngram_join.near_duplicates(docs).collect()
    assert sorted((repr(r["__row"]), r["__near"]["n_shingles"], repr(r["__near"]["component_id"])) for r in rows) == brute_components(awkward())
    assert sorted(ngram_join.near_duplicates(docs, parts=2).collect(), key=repr) == sorted(rows, key=repr)
    assert ngram_join.near_duplicates(none, parts=2).count() == 0
    assert ngram_join.near_duplicates(none).count() == 0


@pytest.mark.parametrize("leaders", [0, 2])
def test_near_duplicates_of_a_hot_group_in_blocks(spark, monkeypatch, leaders):
    """One passage with changing words, so that chains of links cross blocks, beside other families."""
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    monkeypatch.setattr(ngram_join, "LEADERS", leaders)
    rng, rows = random.Random(11), []
    for family, copies in enumerate((90, 30, 7, 1, 1)):
        words = [f"f{family}w{i}" for i in range(120)]
        for _ in range(copies):
            if rng.random() < 0.5:
                words[rng.randrange(120)] = f"x{rng.random()}"
            other = list(words)
            for _ in range(rng.randrange(3)):
                other[rng.randrange(120)] = f"y{rng.random()}"
            rows.append((len(rows), " ".join(other)))
    rng.shuffle(rows)
    sets = {d: set(ngram_join.shingles(t).tolist()) for d, t in rows}
    least = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and least[a] != least[b]:
                low, high = sorted((least[a], least[b]))
                least = {d: low if x == high else x for d, x in least.items()}
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["__row"]: r["__near"]["component_id"] for r in found} == least
    assert 5 < len(set(least.values())) < 60


def test_seats_bring_components_together(spark, monkeypatch):
    """Every two sets of different components meet in exactly one place, whatever the sizes."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng, rows = random.Random(5), []
    for sig in range(12):
        nodes = rng.sample(range(1000), rng.randrange(2, 40))
        rows += [(sig, node, 10, rng.choice([1, 1, 1, 1, 2, 3]) if sig % 2 else 1 + (node == min(nodes)), len(nodes)) for node in nodes]
    frame = spark.createDataFrame(rows, "sig long, node long, n int, c long, last long")
    meet = {}
    for r in ngram_join._seats(frame).collect():
        meet.setdefault((r["sig"], r["lo"], r["hi"]), []).append((r["block"], r["node"], r["c"]))
    met = Counter()
    for (sig, lo, hi), seats in meet.items():
        for x, (bx, nx, cx) in enumerate(seats):
            for by, ny, cy in seats[:x]:
                if cx != cy and (lo == hi or bx != by):
                    met[sig, *sorted((nx, ny))] += 1
    apart = {(s, *sorted((a, b))) for s, a, _, c, _ in rows for t, b, _, d, _ in rows if s == t and c != d}
    assert met == dict.fromkeys(apart, 1)
    assert max(Counter((r[0], r[1]) for r in rows).values()) == 1


@pytest.mark.parametrize("parts", [1, 3])
def test_near_duplicates_of_many_sizes(spark, parts):
    r = random.Random(3)
    rows = []
    for g in range(60):
        base = [str(r.randrange(400)) for _ in range(r.choice([5, 8, 12, 20, 33, 60, 120, 300]))]
        for _ in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = str(r.randrange(400))
            rows.append((r.randrange(100000), " ".join(w[: len(w) - r.choice([0, 0, 0, 1, 2])])))
    rows = list({d: (d, t) for d, t in rows}.values())
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), parts=parts).collect()
    assert sorted((repr(x["__row"]), x["__near"]["n_shingles"], repr(x["__near"]["component_id"])) for x in found) == brute_components(rows)


def test_signatures_of_similar_sets_meet():
    r = np.random.default_rng(1)
    for n in (7, 9, 15, 40, 200, 1500):
        for _ in range(20):
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            drop = int(n * 0.15 * r.random())
            b = np.unique(np.concatenate([a[drop:], r.integers(0, 2**63, int(0.15 * n * r.random())).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both) and len(a) != both:
                sig, of = ngram_join.signatures([a, b])
                assert np.intersect1d(sig[of == 0], sig[of == 1]).size
                differ = len(a) + len(b) - 2 * both
                x, y = (np.frombuffer(ngram_join.sketch(s), "<u8") for s in (a, b))
                if len(x) == len(y):
                    assert int(np.bitwise_count(x ^ y).sum()) <= differ


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (300, 200), (500, 400), (7, 7)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {100: 100, 200: 100, 300: 100, 400: 400, 500: 400}


# --- repeated passages --------------------------------------------------------


def brute_repeats(rows):
    starts = defaultdict(set)
    key = lambda d: d if d is not None else repeats.NULL_ID
    for d, t, *_ in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            starts[raw[p : p + 50]].add(key(d))
    out = []
    for d, t, *_ in rows:
        raw = (t or "").encode()
        off = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if min(starts[raw[p : p + 50]]) < key(d):
                off[p : p + 50] = b"\1" * 50
        left = bytes(x for x, o in zip(raw, off) if not o)
        spans = len(re.findall(b"\1+", bytes(off)))
        out.append((repr(d), len(raw), sum(off), spans, left))
    return sorted(out)


def near_passages():
    """A string of 20 bytes that wins every window, in many surroundings, some of which come
    again; and a passage that a third of all documents share."""
    r = random.Random(15)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    hot, passage = "-" * 24, text(300)
    around = [(text(40), text(40)) for _ in range(12)]
    rows = []
    for i in range(90):
        a, b = r.choice(around) if i % 2 else (text(40), text(40))
        rows.append((i, f"{text(30)}{a[r.randrange(30):]}{hot}{b[:r.randrange(10, 40)]}{text(30)}" + (passage if i % 3 == 0 else "")))
    return rows


@pytest.mark.parametrize("most, held", [(1 << 13, 1 << 18), (3, 1 << 18), (3, 50), (1, 1 << 18)])
def test_repeats_of_hot_keys(spark, monkeypatch, most, held):
    monkeypatch.setattr(repeats, "MOST", most)
    monkeypatch.setattr(repeats, "HELD", held)
    given = near_passages()
    rows = repeats.remove_repeats(spark.createDataFrame(given, "doc_id long, text string").repartition(3)).collect()
    assert sorted((repr(r["__row"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows) == brute_repeats(given)


def test_repeats(spark, docs, none):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        rows = repeats.remove_repeats(docs).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((repr(r["__row"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows) == brute_repeats(awkward())
    assert all(r["kept_sha256"] == hashlib.sha256(r["kept"]).hexdigest() for r in rows)
    assert repeats.remove_repeats(none).count() == 0


def test_suffix_array_of_long_repeats():
    r = random.Random(6)
    base = bytes(r.choice(b"abcd") for _ in range(400))
    for raw in (b"a" * 3000, b"ab" * 1500, base * 8, base * 4 + base[::-1] * 4, b"abcabd" * 300 + b"abc" * 300, bytes(r.randrange(1, 256) for _ in range(5000))):
        s = np.frombuffer(raw + b"\0", np.uint8)
        order = suffix_array(s)
        raw = bytes(s)
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        prefix = permuted_common(s, order, 50)
        for a, b in zip(order[:-1].tolist(), order[1:].tolist()):
            x, y = raw[a : a + 50], raw[b : b + 50]
            assert prefix[b] == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_suffix_array():
    r = random.Random(5)
    for _ in range(200):
        s = np.array([r.randint(1, r.choice([1, 2, 3, 200])) for _ in range(r.randint(0, 80))] + [0], np.uint8)
        order = suffix_array(s)
        raw = bytes(s)
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        prefix = permuted_common(s, order, 50)
        for a, b in zip(order[:-1], order[1:]):
            x, y = raw[a:], raw[b:]
            assert prefix[b] == min(50, next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y))))


# --- repeated lines -----------------------------------------------------------


def brute_lines(rows):
    key = lambda d: d if d is not None else line_dedup.NULL_ID
    first, out = {}, []

    def full_lines(t):
        return [(i, line) for i, line in enumerate((t or "").split("\n")) if WORD.search(line)]

    for d, t, *_ in rows:
        full = full_lines(t)
        for p in range(len(full) - 2):
            w = tuple(line for _, line in full[p : p + 3])
            first[w] = min(first.get(w, (key(d), p)), (key(d), p))
    for d, t, *_ in rows:
        full, gone = full_lines(t), set()
        for p in range(len(full) - 2):
            if first[tuple(line for _, line in full[p : p + 3])] != (key(d), p):
                gone |= {p, p + 1, p + 2}
        dropped = {full[p][0] for p in gone}
        kept = "\n".join(line for i, line in enumerate((t or "").split("\n")) if i not in dropped)
        out.append((repr(d), len(full), len(gone), sum(p - 1 not in gone for p in gone), kept))
    return sorted(out)


def test_line_dedup(spark, docs, none):
    r = random.Random(9)
    lines = ["l%d" % i for i in range(12)] + ["", "  "]
    rows = [(r.randrange(1000), "\n".join(r.choice(lines) for _ in range(r.randint(0, 14)))) for _ in range(120)] + [(None, "l1\nl2\nl3"), (None, None), (5, "a\nb\nc\na\nb\nc\na\nb\nc")]
    for table, given in ((spark.createDataFrame(rows, "doc_id long, text string"), rows), (docs, awkward())):
        found = line_dedup.remove_lines(table).collect()
        assert sorted((repr(x["__row"]), x["n_lines"], x["n_removed"], x["n_spans"], x["kept"]) for x in found) == brute_lines(given)
        assert all(x["kept_sha256"] == hashlib.sha256(x["kept"].encode()).hexdigest() for x in found)
    assert line_dedup.remove_lines(none).count() == 0


# --- tokens -------------------------------------------------------------------


def library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoders_agree_with_the_library():
    from depsift.llm.tokens import byte_bpe, word_bpe

    r = random.Random(2)
    texts = [t for _, t, *_ in awkward()] + ["".join(r.choice("ab é_1 2²½.,'!\nsßtªº\t×÷µİŉ <>| ​Σ語'") for _ in range(r.randint(1, 30))) for _ in range(2000)]
    texts += ["it's they'll I'M don't", "<|endoftext|> a <|startoftext|>", "é e", "  lead", "trail  ", "\n\n\t x"]
    for encoder, name in ((byte_bpe(), "byte_bpe_50k.json"), (word_bpe(), "word_bpe_49k.json")):
        ids = library(name)
        for t, raw in zip(texts, encoder.ids_of(texts), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == ids(t), t


def test_special_tokens_in_texts():
    from depsift.llm.tokens import byte_bpe, word_bpe

    assert np.frombuffer(byte_bpe().ids("<|endoftext|>"), "<u4").tolist() == [50256]
    assert np.frombuffer(word_bpe().ids("<|startoftext|><|endoftext|>"), "<u4").tolist() == [49406, 49407]


def test_a_vocabulary_with_another_pattern(tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    from depsift.llm.tokens import byte_bpe, word_bpe

    r = random.Random(11)
    texts = ["".join(r.choice("ab éC1.,'\n ") for _ in range(40)) for _ in range(200)]
    for make, name in ((byte_bpe, "byte_bpe_50k.json"), (word_bpe, "word_bpe_49k.json")):
        with open(public_tokenizers.path(name), encoding="utf-8") as file:
            other = json.load(file)
        other["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
        path = tmp_path / name
        path.write_text(json.dumps(other), encoding="utf-8")
        library_ids = Tokenizer.from_file(str(path))
        for t in texts:
            assert np.frombuffer(make(str(path)).ids(t), "<u4").tolist() == library_ids.encode(t, add_special_tokens=False).ids


def test_token_files(spark, docs, none, tmp_path, monkeypatch):
    files = token_files.write_tokens(docs, f"file://{tmp_path}/a")
    rows = token_files.read_tokens(files, f"file://{tmp_path}/a").collect()
    ids = library("byte_bpe_50k.json")
    expected = Counter((d, len(ids(t)) + 1, crc([*ids(t), 2])) for d, t, *_ in awkward())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == expected
    rows.sort(key=lambda r: r["start"])
    at = 0
    for before, r in zip([None, *rows], rows):
        assert r["start"] == at
        assert before is None or before["doc_id"] is None or before["doc_id"] <= r["doc_id"]
        at += r["n_tokens"]
    files = token_files.write_tokens(none, f"file://{tmp_path}/b")
    assert token_files.read_tokens(files, f"file://{tmp_path}/b").count() == 0


def test_elias_fano():
    r = random.Random(4)
    for n in (0, 1, 2, 5, 255, 256, 257, 2000):
        for top in (1, 10, 10**6, 2**63):
            values = np.array(sorted(r.randrange(top) for _ in range(n)), np.uint64)
            code = token_files.EliasFano.from_bytes(token_files.EliasFano.of(values).to_bytes())
            assert [code.select(i) for i in range(n)] == values.tolist()
            if n:
                assert code.all().tolist() == values.tolist()
    raw = token_files.encode_file([None, -5, -5, 7], [1, 2, 1, 3], np.arange(7, dtype="<u4").tobytes(), 2)
    file = token_files.TokenFile(raw)
    assert file.doc_ids() == [None, -5, -5, 7] and [file.document(i).tolist() for i in range(4)] == [[0], [1, 2], [3], [4, 5, 6]]
    assert len(token_files.EliasFano.of(np.arange(0, 10**6, 100)).to_bytes()) < 10**4 * 1.5


def test_packing(docs, none):
    rows = packing.pack_documents(docs, capacity=256).collect()
    ids = library("word_bpe_49k.json")
    expected = Counter()
    for d, t, *_ in awkward():
        own = [*ids(t), 0]
        expected.update((d, k, s, len(own[s : s + 256]), crc(own[s : s + 256])) for k, s in enumerate(range(0, len(own), 256)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    # No two pieces over half a sequence share one.
    assert len(by) <= max(-(-sum(r["length"] for r in rows) // 256), sum(r["length"] > 128 for r in rows)) + 2
    assert packing.pack_documents(none).count() == 0


def test_packing_in_rounds(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(packing, "BLOCK", 500)
    items = spark.range(9000).select(F.col("id").alias("item"), (1 + F.abs(F.hash("id")) % 2000).alias("size"))
    rows = packing.pack(items).join(items, "item").collect()
    assert len(rows) == 9000
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["size"]))
    for parts in held.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 2048
    assert len(held) <= 1.05 * sum(r["size"] for r in rows) / 2048


def test_bins_that_are_passed_on_are_enough(spark, monkeypatch):
    from pyspark.sql import functions as F

    # Every bin of a block has room, and one is small; each small one finds a partner.
    monkeypatch.setattr(packing, "BLOCK", 200)
    monkeypatch.setattr(packing, "FAN_IN", 2)
    size = F.when(F.col("id") % 50 == 0, 900).otherwise(1100)
    items = spark.range(3200).select(F.col("id").alias("item"), size.alias("size"))
    used = {}
    for most in (packing.enough, lambda tasks: 10**9):
        monkeypatch.setattr(packing, "enough", most)
        used[most] = packing.pack(items).select("sequence_id").distinct().count()
    assert set(used.values()) == {3200 - 64}
    assert packing.rounds(1) == 0 and packing.rounds(9) == 4


# --- toxicity -----------------------------------------------------------------


def test_toxicity(spark, docs, none):
    r = random.Random(6)
    plain = ["".join(r.choice("aeioubcdfg") for _ in range(r.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(900):
        bad = i % 6 == 0
        w = [r.choice(plain) for _ in range(r.randint(5, 80))]
        for _ in range(1 + len(w) // 20 if bad else 0):
            w[r.randrange(len(w))] = r.choice(["zzyx", "zzyxen", "wkrrt"])
        rows.append((i, " ".join(w), int(bad)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = table.select("doc_id", "toxic").union(table.select("doc_id", "toxic").limit(5))
    truth = {d: x for d, _, x in rows}
    found = toxicity.score(table.drop("toxic"), labels).collect()
    assert len(found) == 900
    for x in found:
        assert x["held_out"] == (zlib.crc32(str(x["__row"]).encode()) % 5 == 0) and 0 <= x["score"] <= 1
    right = [(x["score"] >= 0.5) == truth[x["__row"]] for x in found if x["held_out"]]
    assert sum(right) / len(right) > 0.97
    # Labels of held-out rows change nothing.
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    again = {x["__row"]: x["score"] for x in toxicity.score(table.drop("toxic"), flipped).collect()}
    assert again == pytest.approx({x["__row"]: x["score"] for x in found})
    no_labels = labels.limit(0)
    assert {x["score"] for x in toxicity.score(docs, no_labels).collect()} == {0.0}
    assert toxicity.score(none, no_labels).count() == 0


def test_toxicity_gives_every_row_a_score(docs, spark):
    labels = spark.createDataFrame([(d, i % 2) for i, d in enumerate(x for x, *_ in awkward() if x is not None)], "doc_id long, toxic int")
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == len(awkward()) and all(0 <= r["score"] <= 1 for r in rows)


def brute_kneser_ney(texts):
    """Log ratios of all 4-grams and contexts, class by class, from the definition; every
    second text is toxic."""
    import math

    seen = (Counter(), Counter())
    for i, t in enumerate(texts):
        for word in t.lower().encode().split():
            padded = b"   " + word + b"   "
            for p in range(3, len(word) + 4):  # the bytes of the word and its end
                seen[i % 2][padded[p - 3 : p + 1]] += 1
    d, q, longer = 0.75, {b"": 1 / 256}, set(seen[0]) | set(seen[1])
    endings = {4: longer}
    for order in (3, 2, 1):
        endings[order] = {g[1:] for g in endings[order + 1]}
    for order in (1, 2, 3):
        n = Counter(g[1:] for g in endings[order + 1])
        total, types = Counter(), Counter()
        for g, k in n.items():
            total[g[:-1]] += k
            types[g[:-1]] += 1
        q |= {g: (k - d + d * types[g[:-1]] * q[g[1:]]) / total[g[:-1]] for g, k in n.items()}
    total, types = (Counter(), Counter()), (Counter(), Counter())
    for c in (0, 1):
        for g, k in seen[c].items():
            total[c][g[:-1]] += k
            types[c][g[:-1]] += 1

    def left(c, h):
        return d * types[c][h] / total[c][h] if total[c][h] else 1.0

    def p(c, g):
        h = g[:-1]
        return (max(seen[c][g] - d, 0) / total[c][h] if total[c][h] else 0.0) + left(c, h) * q[g[1:]]

    number = lambda g: int.from_bytes(g, "big")
    return {number(g): math.log(p(1, g) / p(0, g)) for g in longer}, {number(h): math.log(left(1, h) / left(0, h)) for h in {g[:-1] for g in longer}}


def test_toxicity_keeps_every_ratio(spark, monkeypatch):
    r = random.Random(8)
    texts = [" ".join("".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(5)) for _ in range(400)) for _ in range(330)]
    table = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "doc_id long, text string, toxic int").repartition(4)
    rows = table.selectExpr("doc_id AS __row", "text AS __text").unionByName(spark.createDataFrame([(None, None), (0, "another text"), (-1, " ")], "__row long, __text string"))
    counted = toxicity.count(table.selectExpr("text AS __text", "toxic AS __kind")).select("g", "n0", "n1")
    ratios, unseen, size = toxicity.train(counted)
    grams = set(np.concatenate([np.unique(toxicity.events([t])[0]) for t in texts]).tolist())
    of, other = {x["g"]: x["ratio"] for x in ratios.collect()}, {x["h"]: x["other"] for x in unseen.collect()}
    assert len(grams) > 500_000 and set(of) == grams and set(other) == {g >> 8 for g in grams} and size == len(of) + len(other)

    kneser_ney, other_kn = brute_kneser_ney(texts)
    assert of.keys() == kneser_ney.keys() and max(abs(of[g] - x) for g, x in kneser_ney.items()) < 1e-9
    assert other.keys() == other_kn.keys() and max(abs(other[h] - x) for h, x in other_kn.items()) < 1e-9

    def value(text):
        g = toxicity.events([text])[0].tolist()
        return sum(of.get(x, other.get(x >> 8, 0.0)) for x in g) / max(len(g), 1)

    expected = sorted((repr(x["__row"]), value(x["__text"])) for x in rows.collect())
    for most in (size, size - 1):  # broadcast, joined
        monkeypatch.setattr(toxicity, "MODEL", most)
        found = sorted((repr(x["__row"]), x["__mean"]) for x in toxicity.valued(counted)(rows).collect())
        assert [i for i, _ in found] == [i for i, _ in expected]
        assert [v for _, v in found] == pytest.approx([v for _, v in expected], abs=1e-9)


# --- pages --------------------------------------------------------------------

PAGES = [
    (1, "<html><body><nav><a href=x>Home</a></nav><article><h1>Title &amp; more</h1><p>First  <b>bold</b>\n text</p><p>One.<p>Two<br>lines</article><footer>(c) us</footer>", "Title & more\nFirst bold text\nOne.\nTwo lines"),
    (2, None, ""),
    (3, "", ""),
    (4, "<script>var a='<p>no</p>';</script><style>p{}</style><article><p>Yes &eacute; &#8364;</p><!-- <p>no</p> --><div class=comments><p>Nice post, thanks a lot for it.</p></div></article>", "Yes é €"),
    (5, "<article><p>a < b and c</p><form><p>Subscribe to our letter</p></form><aside><p>Side</p></aside></article>", "a < b and c"),
    (6, "<nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>", ""),
    (8, "<form><div class='page with sidebar'><article><p>Kept text</p><div class='share'>Share it</div></article><p>Not this</p></div></form>", "Kept text"),
    (7, "<article><p title='a>b'>Quoted</p><p hidden>Not seen</p></article", "Quoted"),
]


def test_html(spark):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(i, f"http://x/{i}", h, "text", 5) for i, h, _ in PAGES], "page_id long, url string, html string, text string, n_chars int")
    rows = {r["page_id"]: r for r in html_extract.extract(pages).withColumn("n_chars", F.char_length("text").cast("long")).collect()}
    for i, _, expected in PAGES:
        assert rows[i]["text"] == expected, i
        assert rows[i]["n_chars"] == len(expected)
    assert html_extract.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("n", [3, 64, 65, 500])
def test_html_with_items_left_open(n):
    flags = lambda page: {b.text: (b.main, b.framed, b.named, b.item) for b in html_extract.blocks(page)}
    tree = html_extract.learn()
    for many in ("<ul>" + "<li>x" * n + "</ul>", "<table>" + "<tr><td>x<th>x" * n + "</table>", "<ul>" + "<li><div>x" * n + "</ul>", "<section>" * n + "x"):
        got = flags(f"<nav>{many}</nav><div>after</div><article>{many}<p>inside</p></article><div>last</div>")
        assert got["after"] == got["last"] == (False, False, False, False)
        assert got["inside"] == (True, False, False, False)
    text = "The committee met for the third time this spring and agreed that the old bridge should be repaired."
    page = f"<nav><ul>{'<li><a href=a>Home</a>' * n}</ul></nav><div><p>{text}</p><p>{text}</p></div>"
    assert html_extract.main_text(page, tree) == f"{text}\n{text}"


P1 = "The ferry left the harbour an hour late, because the crew had to wait for a part of the engine to arrive."
P2 = "Most of the passengers stayed on deck, where the wind had turned and the smell of the sea was strong."
P3 = "By noon the island came into view, and nobody spoke of the delay any more until the boat was fast at the pier."
S1 = "Nobody complained."
#: Pages of many kinds, and their main text.
VARIED = [
    (f"<article><p>{P1}</p><aside>{'<li>x' * 70}</aside><p>{P2}</p></article>", [P1, P2]),
    (f"<article><p>{P1}</p><aside>{'<div>x' * 70}</aside><p>{P2}</p></article>", [P1, P2]),
    (f"<article><p>{P1}</p><form>{'<tr><td>x' * 40}</form><p>{P2}</p></article>", [P1, P2]),
    (f"<article><p title=          'a>b'>{P1}</p><img alt =            \"x>y\"><p>{P2}</p></article>", [P1, P2]),
    (f"<div><h1>The ferry</h1><p>{P1}</p><p>{P2}</p></div><footer><p>{P3}</p></footer>", ["The ferry", P1, P2]),
    (f"<aside><p>{P3}</p></aside><div><p>{P1}</p><p>{P2}</p></div>", [P1, P2]),
    (f"<nav><p>{P3}</p></nav><div><p>{P1}</p><p>{P2}</p></div>", [P1, P2]),
    (f"<div><p>{P1}</p><p>{P2}</p></div><form><p>{P3}</p><input></form>", [P1, P2]),
    (f"<article style='overflow:hidden'><p>{P1}</p><p>{S1}</p></article>", [P1, S1]),
    (f"<article class='overflow-hidden'><p>{P1}</p><p>{S1}</p></article>", [P1, S1]),
    (f"<article aria-hidden='false' data-hidden='no'><p>{P1}</p><p>{S1}</p></article>", [P1, S1]),
    (f"<article><p>{P1}</p><p hidden>{P3}</p><p style='color:red; display: none'>{P3}</p><p>A <span hidden>not <span>at</span> all</span>b.</p></article>", [P1, "A b."]),
    (f"<article class='layout side-by-side'><p>{P1}</p><p>{S1}</p></article>", [P1, S1]),
    (f"<article><div class='article-header'><h1>The ferry</h1></div><p>{P1}</p></article>", ["The ferry", P1]),
    (f"<article><header><h1>The ferry</h1></header><p>{P1}</p><p>{S1}</p></article>", ["The ferry", P1, S1]),
    (f"<div class='no-sidebar has-footer'><div class='entry-header'><h2>The ferry</h2></div><p>{P1}</p><p>{P2}</p></div><div class='siteFooter'><p>{P3}</p></div>", ["The ferry", P1, P2]),
    (f"<article class='post comments-open category-legal'><p>{P1}</p><p>{S1}</p></article><div id=comments><p>{P2}</p></div>", [P1, S1]),
    (f"<main><p>{P1}</p><p>{S1}</p></main><section class=related><article><p>{P3}</p></article></section>", [P1, S1]),
    (f"<article><p>{P1}</p><p>{P2}</p><ol><li><article><p>{P3}</p></article></ol></article>", [P1, P2]),
    (f"<form action=x><header><a href=/>Home</a></header><div><p>{P1}</p><p>{P2}</p><p>{P3}</p></div><footer>{P1}</footer></form>", [P1, P2, P3]),
    (f"<div role=navigation><p>{P3}</p></div><div role=main><h1>The ferry</h1><p>{P1}</p><p>{S1}</p></div><div role=contentinfo>{P2}</div>", ["The ferry", P1, S1]),
    (f"<table><tr><td><a href=1>Home</a><br><a href=2>News</a></td><td><h1>The ferry</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></td></tr></table>", ["The ferry", P1, P2, P3]),
    (f"<ul><li><a href=a>Home</a><li><a href=b>Sport</a></ul><h1>The ferry</h1><p>{P1}</p><p>{S1}</p><p>{P2}</p><ul><li>a bag<li>a coat</ul><p>{P3}</p><p><a href=n>Next</a> | <a href=l>Last</a></p>", ["The ferry", P1, S1, P2, "a bag", "a coat", P3]),
    (f"<p>{P1}</p><p>{P2} <a href=m>See the map</a>.</p><p>{P3}</p><p>&copy; 2020 The Harbour Times</p>", [P1, f"{P2} See the map.", P3]),
    (f"<div class='cookie-banner'>{P3}</div><main><h1>The ferry</h1><p>{P1}</p><ul><li><a href=1>One more story</a><li><a href=2>Another of them</a><li><a href=3>The last story</a></ul><p>{P2}</p></main>", ["The ferry", P1, P2]),
    (f"<main><p>{P1}</p><p><a href=x>A map of the island</a></p><p>{P2}</p><figure><figcaption>The pier</figcaption></figure><blockquote>{S1}</blockquote></main>", [P1, "A map of the island", P2, "The pier", S1]),
    (f"<div id=page><div id=main-nav><a href=1>A</a></div><div class=story><p>{P1}</p><p>{P2}</p></div><div class='newsletter-signup'><p>{P3}</p></div><div class='ad-slot'>{P3}</div></div>", [P1, P2]),
    (f"<body class='menu has-ads'>{P1}<p>{P2}</p><p>{P3}</p></body>", [P1, P2, P3]),
    ("<nav><a href=1>A</a></nav><ul><li><a href=1>First offer</a><li><a href=2>Second offer</a></ul><footer>Imprint</footer>", []),
    (f"<dl><dt>Ferry<dd>{P1}<dd>{P2}</dl>", ["Ferry", P1, P2]),
]


def test_html_of_varied_pages():
    tree = html_extract.learn()
    right = [html_extract.main_text(page, tree) == "\n".join(expected) for page, expected in VARIED]
    assert all(right[:21]), [i for i, x in enumerate(right) if not x]  # cases with a rule of their own
    assert sum(right) >= len(VARIED) - 1, [i for i, x in enumerate(right) if not x]


def test_html_tree_agrees_with_fresh_pages():
    tree, right, total = html_extract.learn(), 0, 0
    for page in html_extract.made_pages(400, seed=2):
        found = html_extract.blocks(page)
        marked = np.array(["data-y" in b.attributes for b in found])
        right, total = right + int((html_extract.classify(tree, html_extract.table_of(found)) == marked).sum()), total + len(found)
    assert right / total > 0.99

    def columns(t):
        return {t[0]} | columns(t[2]) | columns(t[3]) if isinstance(t, tuple) else set()

    assert {0, 2, 4} <= columns(tree) and {1, 3, 5} & columns(tree)  # words of the block and its neighbours, link densities


def test_html_items_end_their_siblings():
    found = html_extract.blocks("<ul><li class=share>a<li>b<ul><li>c</ul>d<div><li>e</ul><table><tr class=share><td class=ad>f<td>g<tr><td>h<table><tr><td>i</table>j</table>k")
    assert [(b.text, b.named, b.item) for b in found] == [
        ("a", True, True), ("b", False, True), ("c", False, True), ("d", False, True), ("e", False, True),
        ("f", True, False), ("g", True, False), ("h", False, False), ("i", False, False), ("j", False, False), ("k", False, False),
    ]


def test_html_is_linear_with_items_left_open():
    import time

    tree = html_extract.learn()
    began = time.time()
    for page in ("<ul><li>" * 30000, "<div>" * 30000 + "<li></li>" * 30000, "<li>" * 60000, "<tr><td>" * 30000, "<table><tr><td>" * 20000, "<li><div>" * 30000 + "</ul>" * 30000):
        html_extract.main_text(page, tree)
    assert time.time() - began < 20


def test_html_is_linear_in_odd_pages():
    import time

    tree = html_extract.learn()
    began = time.time()
    for page in ("<" * 200000, "<p " * 60000, "<div>" * 60000, "<!--" * 60000, "<a href='" * 60000, "</div>" * 60000, "x" * 10**6):
        html_extract.main_text(page, tree)
    assert time.time() - began < 20


def test_html_of_the_tables(spark):
    rows = html_extract.query(spark, "/root/testdata/sf0.001").collect()
    html = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", html[r["page_id"]], re.S)[1]
        parts = (" ".join(re.sub(r"<[^>]+>", "", p).split()) for p in re.split(r"</?(?:p|h1)>", inside))
        import html as h

        assert r["text"] == "\n".join(" ".join(h.unescape(p).split()) for p in parts if p)
