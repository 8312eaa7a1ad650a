import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from proofmill.llm import tokenizer_alignment as T
from proofmill.llm.queries import op12_tokenizer_alignment
from proofmill.llm.sentence_pieces import read_model

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "   ", "a", " a", "a ", "a  b", "▁", "a▁b c", "<|endoftext|> x </s>", "日本語テキスト です", "🎉🎉 ok", "\n\n x\ty",
    "x　y z", "it's 12345 o'clock", "a" * 300, "ab" * 5000, "Müller … “ja” — nein", "same text here", "same text here", "\x1c a b",
]


@pytest.fixture(scope="module")
def models():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read(), read_model(public_tokenizers.path("piece_bpe_32k.model"))


def slow_groups(of: T.Aligner, text: str | None) -> list[tuple[list[int], list[int]]]:
    """Groups of a whole text, token by token."""
    if not text:
        return []
    (a,), (b,) = of.encode([" " + text], [text])
    if not of.same(a, b, (" " + text).encode(), (" " + text).encode()):
        return []
    groups, x, y, a_end, b_end = [], [], [], 0, 0
    a, b = a[::-1], b[::-1]
    while a or b:
        if a_end <= b_end:
            x.append(a.pop())
            a_end += len(of.a_bytes[x[-1]])
        else:
            y.append(b.pop())
            b_end += len(of.b_bytes[y[-1]])
        if a_end == b_end:
            groups.append((x, y))
            x, y = [], []
    assert not x and not y
    return groups


def slow_results(of: T.Aligner, rows: list[tuple]) -> list[tuple]:
    found = [(doc, slow_groups(of, text)) for doc, text in rows]
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for _, groups in found]
    count = Counter(pair for held in links for pair in held)
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for (doc, groups), held in zip(found, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            doc, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), held.total(),
            hashlib.sha256(text.encode()).hexdigest() if groups else "", text,
            sum(n for p, n in held.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in held.items()),
        ))
    return out


def odd_rows() -> list[tuple]:
    rng = random.Random(21)
    words = ["the", "naïve", "schön,", "日本", "x=1;", "don't", "1999", "…", "\n", "", "Größe", "antidisestablishment", "🎉"]
    texts = ODD + [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(40)]
    return [(k % 50 if k % 7 else None, t) for k, t in enumerate(texts)]


def test_composition_is_associative_and_gives_the_whole(models):
    of, rng = T.aligner(*models), random.Random(22)
    for _, text in odd_rows():
        if not slow_groups(of, text):
            continue
        (a,), (b,) = of.encode([" " + text], [text])
        tokens = of.tokens(a, b)
        # ranges that begin at different places for the two
        n = rng.randint(1, 6)
        i, k = ([0, *sorted(rng.randint(0, len(x)) for _ in range(n)), len(x)] for x in (a, b))
        parts = [
            of.fragment(T.Tokens(tokens.a[p:q], tokens.a_ends[p:q], tokens.b[r:s], tokens.b_ends[r:s]))
            for (p, q), (r, s) in zip(zip(i, i[1:]), zip(k, k[1:]))
        ]
        left = parts[0]
        for p in parts[1:]:
            left = of.compose(left, p)
        right = parts[-1]
        for p in parts[-2::-1]:
            right = of.compose(p, right)
        want = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in slow_groups(of, text))
        for whole in (left, right, of.tree(parts), of.fragment(tokens)):
            closed = of.group(whole.prefix) + whole.closed
            assert ";".join(closed.texts) == want and not len(whole.suffix.a) and not len(whole.suffix.b)


def test_chunks_hold_the_text():
    text = "".join(t or "" for _, t in odd_rows())
    found = list(T.chunks(text, 50))
    assert len(found) > 20
    assert "".join(a for a, _, _, _ in found) == " " + text
    assert any(a_begin != b_begin for _, _, a_begin, b_begin in found)
    assert list(T.chunks("x" * 99, 10)) == [(" " + "x" * 99, "x" * 99, 0, 0)]


@pytest.mark.parametrize("long, chunk, units", [(10**6, 100, 250_000), (100, 30, 20), (1, 8, 5)])
def test_against_brute_force(spark, models, monkeypatch, long, chunk, units):
    monkeypatch.setattr(T, "UNITS", units)
    rows = odd_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "'x' AS block", "2 AS n").repartition(4)
    got = T.align(frame, *models, long=long, chunk=chunk).collect()
    key = lambda r: (r[0] is not None, *map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(slow_results(T.aligner(*models), rows), key=key)


def test_empty_table(spark, models):
    assert T.align(spark.createDataFrame([], "doc_id long, text string"), *models).collect() == []


def test_query(spark, models):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = op12_tokenizer_alignment(spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(r[0], *r[1:5], r[7], r[8], r[5]) for r in slow_results(T.aligner(*models), rows)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
