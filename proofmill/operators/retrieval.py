"""Nearest corpus sample for every query, by Jaccard similarity of token sets.

The search is exact.  A query first gets a lower bound b on its best similarity: from documents that share one of
its rarest tokens (of a token's many documents a hash sample, as any document gives a bound), and from the size of
the smallest document that holds one of its tokens.  A document that reaches b holds one of the first
|q| - ceil(b|q|) + 1 tokens of the query in rare-to-frequent order, and its size lies within the bound.  The larger the
document, the more it must have in common, so the fewer of those tokens count for it.  Pairs that are left must
be allowed by the bitmaps of their sets, which tell how many tokens either has alone at least; only then
are whole sets fetched and compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.functions import text
from proofmill.operators.shape import computed_once
from proofmill.session import written_once

SEED_TOKENS = 2
BUCKETS = 16
#: Documents of one token that give a first bound, about; 64-bit words of a set's bitmap, a power of two.
SEED_DOCS, BITMAP_WORDS = 1024, 4


def _bucket(corpus_id: Column) -> Column:
    return F.pmod(F.xxhash64(corpus_id), F.lit(BUCKETS)).cast("int")


def _in_every_bucket(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))))


def token_set(column: Column) -> Column:
    """Distinct tokens of the normalised text."""
    words = F.split(text.normalize_chars(column), " ")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def _with_bitmap(sets: DataFrame) -> DataFrame:
    """Add ``bits0, bits1, ...``: of a bitmap of the set's tokens, each at the place of its hash."""
    hashes = F.transform("tokens", lambda t: F.xxhash64(t))
    word = "aggregate(_hashes, 0L, (a, h) -> a | if((h & {last}) = {k}, shiftleft(1L, cast(shiftright(h, 8) & 63 as int)), 0L))"
    words = [F.expr(word.format(last=BITMAP_WORDS - 1, k=k)).alias(f"bits{k}") for k in range(BITMAP_WORDS)]
    return computed_once(sets, "_hashes", hashes).select(*sets.columns, *words)


def _common_needed(n: str, m: str) -> Column:
    """Tokens that sets of n and m must have in common to reach a similarity of bc / bu."""
    return F.expr(f"(bc * ({n} + {m}) + bc + bu - 1) div (bc + bu)")


def _possible(pairs: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (query_id, corpus_id, nq, nd, bc, bu) whose bitmaps allow the bound to be reached."""
    bits = [f"bits{k}" for k in range(BITMAP_WORDS)]

    def alone(mine: str, other: str) -> Column:
        return sum((F.bit_count(F.col(f"{mine}{b}").bitwiseAND(F.bitwise_not(f"{other}{b}"))) for b in bits), F.lit(0))

    both = (
        pairs.join(docs.select("corpus_id", *[F.col(b).alias(f"d_{b}") for b in bits]), "corpus_id")
        .join(queries.select("query_id", *[F.col(b).alias(f"q_{b}") for b in bits]), "query_id")
    )
    most = F.least(F.col("nq") - alone("q_", "d_"), F.col("nd") - alone("d_", "q_"))
    return both.filter(most >= _common_needed("nq", "nd")).select("query_id", "corpus_id")


def _exact(candidates: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Add the true overlap to candidate pairs (query_id, corpus_id)."""
    common = F.size(F.array_intersect("q_tokens", "tokens")).cast("bigint")
    sized = (
        candidates.join(corpus.select("corpus_id", "tokens"), "corpus_id")
        .join(queries.select("query_id", F.col("tokens").alias("q_tokens")), "query_id")
        .select(
            "query_id", "corpus_id", common.alias("n_common"),
            (F.size("q_tokens") + F.size("tokens")).cast("bigint").alias("n_both"),
        )
    )
    return sized.select(
        "query_id", "corpus_id", "n_common", (F.col("n_both") - F.col("n_common")).alias("n_union")
    )


def _best(pairs: DataFrame) -> DataFrame:
    """Most similar document per query, the lowest id among equals."""
    score = F.col("n_common") / F.col("n_union")
    top = F.max(
        F.struct(
            score.alias("similarity"), (-F.col("corpus_id")).alias("neg_id"), "n_common", "n_union"
        )
    )
    return pairs.groupBy("query_id").agg(top.alias("top")).select(
        "query_id", (-F.col("top.neg_id")).alias("corpus_id"), "top.n_common", "top.n_union",
        "top.similarity",
    )


def retrieve_nearest(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """queries(query_id, text) × corpus(corpus_id, text) → the best hit of each query.

    A query that shares no token with any document has a row without a hit.
    Only tokens that some query holds are listed, and the lists are written
    once.  A list is dealt over ``BUCKETS`` tasks by document, so a token that
    every document and every query holds does not fall to one of them.
    """
    docs = written_once(
        _with_bitmap(corpus.select("corpus_id", token_set(F.col("text")).alias("tokens"))), "corpus-tokens"
    )
    asked = queries.select("query_id", token_set(F.col("text")).alias("tokens"))
    vocabulary = asked.select(F.explode("tokens").alias("token")).distinct()
    postings = written_once(
        docs.select("corpus_id", F.size("tokens").alias("nd"), F.explode("tokens").alias("token"))
        .withColumn("bucket", _bucket(F.col("corpus_id")))
        .join(_in_every_bucket(vocabulary), ["token", "bucket"]),
        "postings",
    )
    # Counted before any join: the count combines on the map side, so a token
    # found in every document costs one row per task.
    frequency = postings.groupBy("token").agg(F.count("*").alias("df"), F.min("nd").alias("least"))
    ranked = written_once(
        _with_bitmap(
            asked.select("query_id", "tokens", F.explode("tokens").alias("token"))
            .join(frequency, "token", "left")
            .groupBy("query_id")
            .agg(
                F.first("tokens").alias("tokens"),
                F.array_sort(
                    F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token", "least"))
                ).alias("ranked"),
            )
        ),
        "query-tokens",
    )

    candidates = _possible(_candidates(ranked, _bounds(ranked, postings, docs), postings), ranked, docs)
    return asked.select("query_id").join(_best(_exact(candidates, ranked, docs)), "query_id", "left")


def _bounds(ranked: DataFrame, postings: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, bc, bu: the best document of a query has a similarity of bc / bu at least."""
    present = F.filter("ranked", lambda r: r["df"] > 0)
    seeds = ranked.select("query_id", F.explode(F.slice(present, 1, SEED_TOKENS)).alias("r")).select("query_id", "r.token", "r.df")
    chosen = F.pmod(F.xxhash64("corpus_id", "token"), F.col("df")) < SEED_DOCS
    pairs = (
        postings.join(_in_every_bucket(seeds), ["token", "bucket"]).filter(chosen)
        .select("query_id", "corpus_id").distinct()
    )
    seeded = _best(_exact(pairs, ranked, docs)).select("query_id", F.col("n_common").alias("c"), F.col("n_union").alias("u"))
    # some document of ``least`` tokens holds a token of the query
    shortest = F.array_min(F.transform(present, lambda r: r["least"]))
    sure = (F.size("tokens") + shortest - 1).cast("bigint")
    bounds = ranked.filter(F.size(present) > 0).select("query_id", sure.alias("sure"), F.size("tokens").alias("nq"))
    better = F.col("c") * F.col("sure") >= F.col("u")
    return bounds.join(seeded, "query_id", "left").select(
        "query_id", "nq",
        F.when(better, F.col("c")).otherwise(F.lit(1).cast("bigint")).alias("bc"),
        F.when(better, F.col("u")).otherwise(F.col("sure")).alias("bu"),
    )


def _candidates(ranked: DataFrame, bounds: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, corpus_id, nq, nd, bc, bu of the pairs that may reach the bound, by the place of a common token and by size."""
    need = F.expr("(bc * nq + bu - 1) div bu")
    prefix = (F.col("nq") - need + 1).cast("int")
    probes = (
        ranked.join(bounds, "query_id")
        .select("query_id", "nq", "bc", "bu", F.posexplode(F.slice("ranked", F.lit(1), prefix)).alias("at", "r"))
        .filter("r.df > 0")
        .select("query_id", "nq", "bc", "bu", "at", F.col("r.token").alias("token"))
    )
    fits = (F.col("bc") * F.col("nd") <= F.col("bu") * F.col("nq")) & (F.col("bc") * F.col("nq") <= F.col("bu") * F.col("nd"))
    # the first common token of the query's order has all others behind it
    enough = F.col("nq") - F.col("at") >= _common_needed("nq", "nd")
    return (
        postings.join(_in_every_bucket(probes), ["token", "bucket"]).filter(fits & enough)
        .select("query_id", "corpus_id", "nq", "nd", "bc", "bu").distinct()
    )
