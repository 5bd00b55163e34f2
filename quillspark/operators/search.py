"""Ranked search of an index for batches of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import STOP_WORDS, tokens
from quillspark.shared import written

from .index import Index, bm25, classic_bm25, document_frequency, idf, tfidf

SCALE = 6  #: decimals of scores, so that ties are ties in any summation order


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "text", stop_words: bool = True) -> DataFrame:
    """(query_id, term, qtf): repeated words count as often as they are asked for."""
    terms = queries.select(F.col(id_col).alias("query_id"), F.explode(tokens(F.col(text_col))).alias("term"))
    if stop_words:
        terms = terms.filter(~F.col("term").isin(*STOP_WORDS))
    return terms.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def top_k(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", ties: str = "doc_id") -> DataFrame:
    """The k best rows of each query with their rank; equal scores go by ``ties``."""
    order = Window.partitionBy(by).orderBy(F.desc(score), ties)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def known_terms(index: Index, terms: DataFrame) -> DataFrame:
    """Query terms (query_id, term, qtf) with df, idf and max_impact; unknown terms go."""
    return terms.join(index.terms(), "term")


def _parts(index: Index, terms: DataFrame, scorer: str = "bm25") -> DataFrame:
    """(query_id, doc_id, term, part): what each posting of a query term adds to a score."""
    # one row of statistics, so the product is no larger than the postings
    joined = index.postings.join(terms, "term").crossJoin(F.broadcast(index.corpus_stats()))
    n, d, tf, dl, avg, qtf, weight = (F.col(c) for c in ("n_docs", "df", "tf", "doc_len", "avg_len", "qtf", "idf"))
    part = {"bm25": lambda: bm25(weight, tf, dl, avg) * qtf, "tfidf": lambda: tfidf(n, d, tf, dl) * qtf, "classic": lambda: classic_bm25(n, d, tf, dl, avg, qtf)}[scorer]()
    return joined.select("query_id", "doc_id", "term", part.alias("part"))


def asked_terms(index: Index, queries: DataFrame) -> DataFrame:
    """Query terms (query_id, term, qtf) of queries (query_id, text) with df and idf, written once; unknown terms go.

    Without saved terms, document frequencies are counted over the postings of
    the terms asked for alone.
    """
    terms = written(query_terms(queries), "asked")
    if index.saved_terms is not None:
        return written(known_terms(index, terms), "known")
    counted = document_frequency(index.postings.join(terms.select("term").distinct(), "term", "left_semi"))
    known = terms.join(counted, "term").crossJoin(F.broadcast(index.corpus_stats().select("n_docs")))
    return written(known.withColumn("idf", idf(F.col("n_docs"), F.col("df"))).drop("n_docs"), "known")


def score(index: Index, known: DataFrame, scorer: str = "bm25") -> DataFrame:
    """(query_id, doc_id, score) of all documents that have a query term, exhaustively.

    ``known`` are the ``asked_terms``. Postings of other terms are dropped
    before anything is aggregated, and a document's postings are one task's
    rows, so its score is added up before the shuffle. ``scorer`` is bm25,
    tfidf or classic.
    """
    return _parts(index, known, scorer).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), SCALE).alias("score"))


def search(index: Index, queries: DataFrame, k: int = 10, scorer: str = "bm25", documents: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Top k documents of each query (query_id, text): query_id, doc_id, score, rank, and the documents' columns if given.

    ``k`` must not be negative; 0 gives no rows. Queries of stop words or
    unknown terms give no rows. The k best are found at once and written, so
    that stages behind do not search again, and that documents, joined after
    ranking, need not be shuffled to meet so few rows. ``known`` are the
    ``asked_terms`` of the queries, if the caller has them.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    found = written(top_k(score(index, asked_terms(index, queries) if known is None else known, scorer), k), "found")
    return found if documents is None else found.join(documents, "doc_id")


#: More than rounding and the order of sums can change a score by.
MARGIN = 1e-5


def pruned_search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """The same result as ``search``, with documents dropped by score bounds before their scores are known.

    A document's lead-term part bounds its score from below, so the k-th best of
    these is a floor. Terms whose greatest impacts add up to less than the floor
    cannot make a document one of the k best by themselves: only documents with
    another term are candidates. These get their parts of the other terms
    first; the k-th best sum is a higher floor, and who stays under it with all
    the rest's impacts goes. Of the rest, mostly the long lists of frequent
    words, only the postings of remaining candidates are scored.

    ``index`` should be a loaded one, which has the impacts.
    """
    if k <= 0:
        return search(index, queries, k)
    known = known_terms(index, query_terms(queries)).withColumn("most", F.col("max_impact") * F.col("qtf"))
    by_impact = Window.partitionBy("query_id").orderBy("most", F.desc("term"))
    ranked = known.withColumns({"upto": F.sum("most").over(by_impact), "lead": F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("most"), "term")) == 1})

    def floor_of(parts: DataFrame) -> DataFrame:
        best = top_k(parts, k, score="part").groupBy("query_id").agg(F.min("part").alias("floor"), F.count("*").alias("n"))
        return best.select("query_id", F.when(F.col("n") == k, F.col("floor")).otherwise(0.0).alias("floor"))

    leads = _parts(index, ranked.filter("lead").drop("upto", "lead", "most")).select("query_id", "doc_id", "part")
    split = ranked.join(floor_of(leads), "query_id").withColumn("rest", F.col("upto") + MARGIN < F.col("floor")).drop("upto", "lead", "floor")
    rest = split.filter("rest").drop("rest")
    found = _parts(index, split.filter("not rest").drop("rest", "most")).groupBy("query_id", "doc_id").agg(F.sum("part").alias("part"))
    slack = rest.groupBy("query_id").agg(F.sum("most").alias("slack"))
    bounded = found.join(floor_of(found), "query_id").join(slack, "query_id", "left")
    kept = bounded.filter(F.col("part") + F.coalesce("slack", F.lit(0.0)) + MARGIN >= F.col("floor")).select("query_id", "doc_id", "part")
    others = _parts(index, rest.drop("most")).join(kept.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").select("query_id", "doc_id", "part")
    whole = kept.unionByName(others).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), SCALE).alias("score"))
    return top_k(whole, k)


def results_json(results: DataFrame) -> DataFrame:
    """(query_id, json): the ranked results of a query as a JSON array."""
    row = F.struct("rank", F.col("doc_id").alias("docId"), "score")
    return results.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("json"))
