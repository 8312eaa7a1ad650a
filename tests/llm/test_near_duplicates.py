import random
import re

import pytest

from proofmill.llm import jaccard_join
from proofmill.llm.graph import components
from proofmill.llm.jaccard_join import boundary, near_duplicates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label):
        least[x] = min(least.get(x, i), i)
    return sorted((i, len(s), least[x]) for (i, _), s, x in zip(rows, sets, label))


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    shared = rng.choices(words, k=12)
    rows = [None, "", " \n", "One", "one", "one two", "ONE TWO", "a b c d", "É x", "é x", "a b c d e", "a b c d e"]
    bases = [rng.choices(words, k=rng.choice([5, 6, 7, 8, 9, 10, 11, 12, 16, 40, 90])) for _ in range(25)]
    for _ in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            at = rng.randrange(len(text))
            text[at : at + rng.choice([0, 1])] = rng.choices(words, k=rng.choice([0, 1]))
        rows.append(" ".join(text + (shared if rng.random() < 0.3 else [])))
    return list(enumerate(rows))


@pytest.mark.parametrize("listing, often", [(0, 16), (4, 2), (60, 16)])
def test_components_equal_brute_force(spark, monkeypatch, listing, often):
    """With no small sets, with a few, and with many, whatever the order of shingles."""
    monkeypatch.setattr(jaccard_join, "LISTING", listing)
    monkeypatch.setattr(jaccard_join, "OFTEN", often)
    monkeypatch.setattr(jaccard_join, "PASSED_ON", 1)
    rows = corpus(listing + often)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, near_duplicates(df).collect())) == brute(rows)


def test_one_large_group(spark):
    rng = random.Random(9)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for k in range(300):
        text = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            text[rng.randrange(len(text))] = f"x{k}_{rng.random()}"
        rows.append((k, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(df).collect())) == brute(rows)


def test_repeats_null_ids_and_no_rows(spark):
    rows = [(3, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "z z z z z z"), (9, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, sid string, n int")
    got = sorted(map(tuple, near_duplicates(df).collect()), key=str)
    assert got == sorted([(3, 2, 2), (2, 2, 2), (2, 2, 2), (None, 2, 2), (None, 1, None), (9, 0, 9)], key=str)
    assert near_duplicates(df.limit(0)).collect() == []


def test_boundary_follows_cost():
    assert boundary({}, 75) == 0
    assert boundary({k: 100 for k in range(1, 13)}, 75) >= 4
    assert boundary({12: 100}, 75) == 0


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert got == {**{k: 0 for k in range(301)}, 1000: 1000, 1001: 1000}


@pytest.mark.parametrize("bridge, want", [(None, 1), (9, 1)])
def test_links_through_a_row_without_an_id(spark, bridge, want):
    words = [f"w{k}" for k in range(60)]
    texts = [words, [*words[:-7], *(f"x{k}" for k in range(7))], ["y0", "y1", "y2", "y3", "y4", "y5", "y6", *words[7:-7], *(f"x{k}" for k in range(7))]]
    rows = [(i, " ".join(t)) for i, t in zip((1, bridge, 2), texts)]
    linked = [100 * len(shingles(x) & shingles(y)) >= 75 * len(shingles(x) | shingles(y)) for (_, x), (_, y) in zip(rows, rows[1:] + rows[:1])]
    assert linked == [True, True, False]
    got = near_duplicates(spark.createDataFrame(rows + [(None, "alone " * 9)], "doc_id long, text string")).collect()
    assert sorted(r["component_id"] for r in got if r["component_id"] is not None) == [want] * 3
    assert [r["component_id"] for r in got if r["doc_id"] is None] == ([1, None] if bridge is None else [None])


def test_repeats_stay_linear(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words))] * 2000 + [(2, " ".join([*words[:-4], "a", "b", "c", "d"]))] * 2000
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    sets = jaccard_join.whole_sets(
        df.selectExpr("doc_id", "text", "CAST(NULL AS LONG) AS place"),
        near_duplicates(df).limit(0).selectExpr("n_shingles AS sid", "doc_id", "doc_id AS place"),
    )
    assert sets.collect() == []
    got = near_duplicates(df).collect()
    assert len(got) == 4000 and {r["component_id"] for r in got} == {1}
