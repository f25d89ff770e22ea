"""The pipeline against a brute-force version of its stages."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from depsift.llm import ngram_join
from tests.llm.test_corpus import SCHEMA, awkward, brute_components, crc, features_of, library, lower, words


def row_counts(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def empty_labels(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages(spark, empty_labels):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.createDataFrame(awkward(), SCHEMA)
    rows = awkward()

    def good(t):
        n, _, _, _, repeated = features_of(t)
        return n >= 50 and 100 * repeated <= 50 * n

    kept = stages["quality rules"](spark, docs, empty_labels)
    assert kept.columns == docs.columns
    assert row_counts(kept) == Counter(r for r in rows if good(r[1]))

    one = stages["exact dedup"](spark, docs, empty_labels).collect()
    best = defaultdict(lambda: None)
    for d, t, *_ in rows:
        best[lower(t)] = max((x for x in (best[lower(t)], d) if x is not None), default=None)
    assert Counter((r["doc_id"], lower(r["text"])) for r in one) == Counter((d, t) for t, d in best.items())

    left = stages["n-gram jaccard join"](spark, docs, empty_labels).collect()
    roots = Counter((d, c) for d, n, c in brute_components(rows))
    stay = Counter({d for d, c in roots if d == c})
    unlinked = Counter(repr(r[0]) for r in rows if not words(r[1]))
    got = Counter(repr(r["doc_id"]) for r in left)
    assert all(tuple(r) in set(rows) for r in left)
    assert set(got) >= set(stay) and sum(got.values()) >= len(stay)
    texts = [r for r in map(tuple, left)]
    linked = [c for _, n, c in brute_components(texts) if n]
    assert len(linked) == len(set(linked))  # nothing that is left is linked with anything else that is left
    assert sum(unlinked.values()) == sum(1 for r in texts if not words(r[1]))

    mixed = row_counts(stages["source mix"](spark, docs, empty_labels))
    assert set(mixed) <= set(rows)

    for name in ("quality rules", "exact dedup", "n-gram jaccard join", "source mix", "best-fit packing"):
        assert stages[name](spark, docs.limit(0), empty_labels).count() == 0


def test_run_is_its_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    at = {c: i for i, c in enumerate(docs.columns)}

    def good(t):
        n, _, _, _, repeated = features_of(t)
        return n >= 50 and 100 * repeated <= 50 * n

    rows = [r for r in rows if good(r[at["text"]])]  # too few labels here for any further rule
    best = {}
    for r in sorted(rows):
        best[lower(r[at["text"]])] = r
    rows = list(best.values())
    pairs = [(r[at["doc_id"]], r[at["text"]]) for r in rows]
    stay = {d for d, _, c in brute_components(pairs) if d == c}
    rows = [r for r in rows if repr(r[at["doc_id"]]) in stay]
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[at["source"]]] += len(words(r[at["text"]]))
    found = corpus_pipeline.run(spark, sf).collect()
    ids = library("word_bpe_49k.json")
    expected = {}
    for r in rows:
        own = [*ids(r[at["text"]]), 0]
        expected[r[at["doc_id"]]] = [(k, s, len(own[s : s + 2048]), crc(own[s : s + 2048])) for k, s in enumerate(range(0, len(own), 2048))]
    times = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found)
    copies = defaultdict(set)
    for (d, *piece), n in times.items():
        assert tuple(piece) in expected[d]
        copies[d].add(n)
    taken = defaultdict(int)
    for r in rows:
        d = r[at["doc_id"]]
        n = copies.get(d, {0})
        assert len(n) == 1 and n <= {0, 1, 2}
        assert not max(n) or sum(1 for (x, *_) in times if x == d) == len(expected[d])
        taken[r[at["source"]]] += max(n) * len(words(r[at["text"]]))
    total = sum(sizes.values())
    largest = max(len(words(r[at["text"]])) for r in rows)
    assert abs(sum(taken.values()) - 1.5 * total) <= largest * len(sizes) / 2
    assert all(taken[s] <= 2 * sizes[s] for s in sizes)
    held = defaultdict(int)
    for r in found:
        held[r["sequence_id"]] += r["length"]
    assert max(held.values()) <= 2048


def five_word_similarity(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in (lower(a).split(), lower(b).split()))
    return len(x & y) / len(x | y)


def test_near_stage_takes_five_words_and_four_fifths(spark, empty_labels):
    r = random.Random(11)
    texts, linked = [], []
    for g in range(60):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.choice([40, 80, 150, 400, 1000]))]
        tail = [f"t{r.randrange(10**6)}" for _ in range(round(len(base) * r.uniform(0.17, 0.29)))]
        a, b = " ".join(base), " ".join(base + tail)
        texts += [a, b]
        linked.append(five_word_similarity(a, b) >= 0.8)
    between = sum(0.8 <= five_word_similarity(texts[2 * g], texts[2 * g + 1]) < 0.85 for g in range(60))
    assert between > 15 and not all(linked)
    docs = spark.createDataFrame([(i, t, "en", "a", None, i, "x") for i, t in enumerate(texts)], SCHEMA)
    left = {x["doc_id"] for x in dict(corpus_pipeline.STAGES)["n-gram jaccard join"](spark, docs, empty_labels).collect()}
    assert left == {2 * g for g in range(60)} | {2 * g + 1 for g in range(60) if not linked[g]}
    # The query's own words and similarity stay.
    joined = {x["__row"]: x["__near"]["component_id"] for x in ngram_join.near_duplicates(docs).collect()}
    four = lambda t: {tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)}
    for g in range(60):
        x, y = four(texts[2 * g]), four(texts[2 * g + 1])
        assert (joined[2 * g + 1] == 2 * g) == (100 * len(x & y) >= 85 * len(x | y))
