"""Lodestone: retrieval, fusion and retrieval evaluation over issue tables, on Spark.

Every operator takes DataFrames and returns a DataFrame.  Ranked results always
have the long form ``(qid, rank, issue_key, score)`` so one Catalyst plan answers
a whole table of questions.
"""

__version__ = "0.1.0"

from lodestone.operators.merge import upsert_chunks, upsert_issues
from lodestone.plans.search import (candidate_lists, search, search_filtered, search_hybrid, search_rerank,
                                    search_rescue)
from lodestone.session import build_session

__all__ = ["build_session", "candidate_lists", "search", "search_filtered", "search_hybrid", "search_rerank",
           "search_rescue", "upsert_chunks", "upsert_issues"]
