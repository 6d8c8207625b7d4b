"""The retrieval strategies, each answering a whole table of questions.

``questions``: qid, question, qvec and, for the filtered strategies, the form columns.
``issues``: the issue table.  ``chunks``: issue_key, strategy, embedding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import values as V
from lodestone.functions import text, vector
from lodestone.operators import forms as fm
from lodestone.operators import fusion
from lodestone.operators.index import KeywordIndex, build_index, keyword_hits
from lodestone.operators.nearest import nearest
from lodestone.plans.contexts import rows_of_keys
from lodestone.session import cut_lineage

PairScorer = Callable[[Column, Column], Column]


def of_strategy(chunks: DataFrame, strategy: str) -> DataFrame:
    return chunks.where(F.col("strategy") == strategy)


def search(questions: DataFrame, chunks: DataFrame, strategy: str, k: int = V.TOP_K) -> DataFrame:
    """Nearest ``k`` chunks of one strategy, no filter: one scan, no corpus shuffle."""
    hits = nearest(questions, of_strategy(chunks, strategy), k)
    return hits.withColumnRenamed("distance", "score")


def vector_candidates(questions: DataFrame, issues: DataFrame, chunks: DataFrame,
                      strategy: str, n: int) -> DataFrame:
    """``(qid, rank, issue_key, distance)``: nearest ``n`` among issues the question's form accepts.

    The filter works before any distance is computed.  Questions without a filter scan
    the vectors as plain search does.  For the others the vectors meet only the narrow
    ``(issue_key, form_ids)`` rows of accepted issues: broadcast where few are accepted,
    joined in place where the tables are bucketed by issue_key, shuffled otherwise.
    """
    asked = fm.with_form_id(questions)
    rows = of_strategy(chunks, strategy).select("issue_key", "embedding")
    free = nearest(asked.where(~fm.has_filter()), rows, n)
    bound = asked.where(fm.has_filter())
    if bound.isEmpty():
        return free
    accepted = fm.match_forms(issues, bound)
    return free.unionByName(nearest(bound, rows.join(accepted, "issue_key"), n))


def search_filtered(questions: DataFrame, issues: DataFrame, chunks: DataFrame,
                    strategy: str, k: int = V.TOP_K) -> DataFrame:
    hits = vector_candidates(questions, issues, chunks, strategy, k)
    return hits.withColumnRenamed("distance", "score")


def filter_rows(questions: DataFrame, issues: DataFrame, chunks: DataFrame, strategy: str) -> DataFrame:
    """``(qid, filter_row_count)``: chunks of the strategy that each question's form accepts."""
    keys = of_strategy(chunks, strategy).select("issue_key")
    return fm.filter_row_count(questions, issues.join(keys, "issue_key"))


def keyword_list(questions: DataFrame, index: KeywordIndex, chunks: DataFrame,
                 strategy: str, n: int = V.FUSION_DEPTH) -> DataFrame:
    return keyword_hits(questions, index, of_strategy(chunks, strategy), n)


def candidate_lists(questions: DataFrame, issues: DataFrame, chunks: DataFrame, strategy: str = "summary_desc",
                    n: int = V.FUSION_DEPTH, index: KeywordIndex | None = None) -> DataFrame:
    """``(qid, list, rank, issue_key, score)``: the unfused vector and keyword lists.

    ``index`` is a stored keyword index of ``issues``; where none is given one is built and kept for the session.
    """
    vec = vector_candidates(questions, issues, chunks, strategy, n)
    kw = keyword_list(questions, index or build_index(issues), chunks, strategy, n)
    columns = ["qid", "list", "rank", "issue_key", "score"]
    return (vec.withColumnRenamed("distance", "score").withColumn("list", F.lit("vec")).select(columns)
            .unionByName(kw.withColumn("list", F.lit("kw")).select(columns)))


def vec_of(lists: DataFrame) -> DataFrame:
    return lists.where(F.col("list") == "vec").select("qid", "rank", "issue_key", F.col("score").alias("distance"))


def kw_of(lists: DataFrame) -> DataFrame:
    return lists.where(F.col("list") == "kw").select("qid", "rank", "issue_key", "score")


def search_hybrid(questions: DataFrame, issues: DataFrame, chunks: DataFrame,
                  strategy: str, k: int = V.TOP_K, weight: float = V.KEYWORD_WEIGHT,
                  index: KeywordIndex | None = None) -> DataFrame:
    lists = candidate_lists(questions, issues, chunks, strategy, index=index)
    return fusion.fuse(vec_of(lists), kw_of(lists), k, weight)


def search_rescue(questions: DataFrame, issues: DataFrame, chunks: DataFrame,
                  strategy: str, k: int = V.TOP_K, m: int = V.RESCUE_SLOTS,
                  index: KeywordIndex | None = None) -> DataFrame:
    lists = candidate_lists(questions, issues, chunks, strategy, index=index)
    return fusion.rescue(vec_of(lists), kw_of(lists), k, m)


def pair_scores(candidates: DataFrame, questions: DataFrame, issues: DataFrame,
                chars: int | None = None, scorer: PairScorer = text.overlap_score) -> DataFrame:
    """``(qid, issue_key, pair_score)`` for candidate pairs; ``scorer`` maps two text columns to a score.

    Candidates are at most depth x questions rows, so the issue texts stay where they are
    and only those of candidate keys move on; ``chars`` cuts the descriptions.
    """
    pairs = candidates.select("qid", "issue_key").join(questions.select("qid", "question"), "qid")
    documents = rows_of_keys(issues, candidates).select(
        "issue_key", text.rerank_text(F.col("summary"), F.col("description"), chars).alias("document"))
    return (pairs.join(documents, "issue_key", "left")
            .select("qid", "issue_key",
                    scorer(F.col("question"), F.coalesce("document", F.lit(""))).alias("pair_score")))


def route_flags(questions: DataFrame) -> DataFrame:
    return questions.select("qid", fm.has_filter().alias("filtered"))


def search_rerank(questions: DataFrame, issues: DataFrame, chunks: DataFrame, strategy: str,
                  k: int = V.TOP_K, depth: int = V.RERANK_DEPTH, chars: int | None = None,
                  scorer: PairScorer = text.overlap_score, candidates: DataFrame | None = None) -> DataFrame:
    """Routed rerank: ``(qid, rank, issue_key, score, route)``.

    Questions whose form filters keep the vector order; only the others reach the scorer.
    """
    if candidates is None:
        # Few rows behind a scan of all vectors, read by both routes and by the text lookup.
        candidates = cut_lineage(vector_candidates(questions, issues, chunks, strategy, depth))
    unfiltered = questions.where(~fm.has_filter())
    to_score = (candidates.where(F.col("rank") < depth)
                .join(unfiltered.select("qid"), "qid", "left_semi"))
    scores = pair_scores(to_score, unfiltered, issues, chars, scorer)
    return fusion.routed(candidates, route_flags(questions), scores, depth, k)


def valid_requests(requests: DataFrame, max_k: int = V.SEARCH_MAX_K) -> DataFrame:
    """Add ``k`` default and ``valid``: question length and k within the request limits."""
    k = F.coalesce("k", F.lit(V.DEFAULT_K))
    length = F.char_length("question")
    ok = (length.between(V.QUESTION_MIN_CHARS, V.QUESTION_MAX_CHARS) & k.between(1, max_k))
    return requests.withColumn("k", k).withColumn("valid", F.coalesce(ok, F.lit(False)))


def query_vectors(questions: DataFrame, dim: int) -> DataFrame:
    """Questions with ``qvec`` cut to ``dim`` and normalised afterwards."""
    return questions.withColumn("qvec", vector.truncate_and_normalize(F.col("qvec"), dim))
