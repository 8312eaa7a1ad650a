import random

from proofmill.llm.decontamination import clean, contaminated, sketch_size
from proofmill.llm.jaccard_join import listed


def sets(text):
    """Shingles of an item; one of fewer words is one shingle."""
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}


def runs(text):
    """Every run of one to five words that a document holds."""
    w = (text or "").lower().split()
    return {tuple(w[k : k + n]) for n in range(1, 6) for k in range(len(w) - n + 1)}


def cases(seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 4, 5, 6, 20, 33, 70])))) for k in range(40)]
    docs = []
    for k in range(150):
        text = rng.choices(words, k=rng.choice([4, 50, 900]))
        passage = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 1, 2, 5])):
            passage[rng.randrange(len(passage))] = "changed"
        at = rng.randrange(len(text))
        docs.append((k, " ".join(text[:at] + (passage if k % 2 else []) + text[at:])))
    return docs, items


def test_equals_brute_force_in_blocks_too(spark):
    docs, items = cases()
    want = []
    for d, text in docs:
        held = runs(text)
        for i, item in items:
            own = sets(item)
            if own and 100 * len(own & held) >= 75 * len(own):
                want.append((d, i, len(own), len(own & held), len(own & held) / len(own)))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(want) > 20
    for block in (1_000_000, 200):
        assert sorted(map(tuple, contaminated(*frames, block=block).collect())) == sorted(want)
        kept = clean(*frames, block=block)
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted({d for d, _ in docs} - {w[0] for w in want})


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "x one  TWO y"), (2, "one x two"), (3, "one two"), (4, "two one"), (5, "one\ttwo three four five six"), (6, "one"), (7, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "One two"), (2, "two one"), (3, "one two three four"), (4, " "), (5, "one two")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["n_item"], r["n_common"]) for r in contaminated(docs, items).collect())
    assert got == sorted([(d, i, 1, 1) for d in (1, 3, 5) for i in (1, 5)] + [(4, 2, 1, 1), (5, 3, 1, 1)])
    assert sorted(r["doc_id"] for r in clean(docs, items).collect()) == [2, 6, 7]
    assert sorted(r["doc_id"] for r in clean(docs, items, shortest=3).collect()) == [1, 2, 3, 4, 6, 7]
    assert contaminated(docs, items, shortest=5).collect() == []


def test_sketch_cannot_miss():
    for n in range(1, 300):
        assert sketch_size(n, 75) >= min(n, listed(n, 75)) or sketch_size(n, 75) >= n


def test_edges(spark):
    item = "one two three four five six"
    docs = spark.createDataFrame([(1, f"x {item} y", 7), (1, f"x {item} y", 7), (2, None, 0), (3, "", 0), (None, item.upper(), 0), (4, "y " * 200_000 + item, 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "one two"), (None, item)], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["containment"]) for r in contaminated(docs, items).collect()), key=str)
    assert got == sorted([(d, i, 1.0) for d in (1, 1, None, 4) for i in (1, 4, None)], key=str)
    assert sorted(r["doc_id"] for r in clean(docs, items).collect()) == [2, 3] and clean(docs, items).columns == docs.columns
    assert contaminated(docs, items.limit(0)).collect() == [] and clean(docs, items.limit(0)).count() == 6
    assert contaminated(docs.limit(0), items).collect() == []
