"""The query suite: one entry per operator, each over the whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone import values as V
from lodestone.functions import text, vector
from lodestone.functions.stem import stem_words
from lodestone.operators import batching, fusion, merge, quality
from lodestone.operators import forms as fm
from lodestone.operators import index as kwx
from lodestone.operators import keyword as kwd
from lodestone.plans import agreement, content, contexts, evaluate, grading, parse_eval, search
from lodestone.session import cut_lineage, kept_path, shared_folder
from lodestone.sources import pages, records, sinks
from lodestone.streaming import ingest
from lodestone.suite.tables import SHORT_DIM, Tables

DESC = "summary_desc"
REGISTRY: dict[str, Callable[[Tables], DataFrame]] = {}


def query(make: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    REGISTRY[make.__name__] = make
    return make


@lru_cache(maxsize=4)
def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)


def scored(hits: DataFrame, digits: int = 6) -> DataFrame:
    return hits.select("qid", "rank", "issue_key", F.round("score", digits).alias("score"))


def joined(column: str):
    return F.array_join(column, "|").alias(column)


# --- vectors ------------------------------------------------------------------------

@query
def vector_topk(t: Tables) -> DataFrame:
    return scored(search.search(t.plain_questions, t.chunks, DESC))


@query
def vector_topk_short(t: Tables) -> DataFrame:
    asked = search.query_vectors(t.plain_questions, SHORT_DIM)
    return scored(search.search(asked, t.chunks, "summary_only"))


@query
def vector_truncate_normalize(t: Tables) -> DataFrame:
    short = F.col("embedding")
    return (content.cut_vectors(t.read("embeddings"), SHORT_DIM)
            .select("vec_id", F.size(short).alias("dim"), F.round(vector.norm(short), 5).alias("norm"),
                    F.round(short[0].cast("double"), 5).alias("first"),
                    F.round(short[SHORT_DIM - 1].cast("double"), 5).alias("last"),
                    vector.has_dim(short, SHORT_DIM).alias("dim_ok")))


@query
def filtered_vector_topk(t: Tables) -> DataFrame:
    return scored(search.search_filtered(t.questions, t.issues, t.chunks, DESC))


@query
def filter_row_count(t: Tables) -> DataFrame:
    return search.filter_rows(t.questions, t.issues, t.chunks, DESC)


@query
def result_count_check(t: Tables) -> DataFrame:
    hits = search.vec_of(t.lists).where(F.col("rank") < V.TOP_K)
    return evaluate.result_count_check(hits, search.filter_rows(t.questions, t.issues, t.chunks, DESC))


# --- forms --------------------------------------------------------------------------

@query
def form_normalize(t: Tables) -> DataFrame:
    return t.forms.select("qid", joined("priority"), joined("issue_type"), "open", joined("resolution"),
                          "created_from", "created_to", joined("text_terms"), "parse_error")


@query
def form_guard(t: Tables) -> DataFrame:
    return fm.normalize_forms(t.responses).select("qid", joined("dropped_values"), joined("dropped_names"))


@query
def form_where_text(t: Tables) -> DataFrame:
    return t.forms.select("qid", fm.where_text().alias("where_text"), fm.has_filter().alias("filtered"))


@query
def allowed_values(t: Tables) -> DataFrame:
    return fm.allowed_values(t.issues)


@query
def single_form_filter(t: Tables) -> DataFrame:
    form = {"priority": "Blocker", "issue_type": ["Bug", "Question"], "open": False,
            "created_from": "1996-01-01", "created_to": "2000-01-01"}
    return fm.where_form(t.issues, form).select("issue_key", "resolution")


# --- text ---------------------------------------------------------------------------

@query
def lexeme_df(t: Tables) -> DataFrame:
    return kwd.lexeme_df(t.issues)


@query
def postings(t: Tables) -> DataFrame:
    return kwd.postings(t.issues)


@query
def rare_lexemes(t: Tables) -> DataFrame:
    asked = kwd.question_lexemes(t.plain_questions).select(F.col("lexeme").alias("word"))
    return kwd.rare_lexemes(t.plain_questions, kwd.lexeme_df(t.issues, asked), t.issues)


@query
def posting_scores(t: Tables) -> DataFrame:
    asked = kwd.question_lexemes(t.plain_questions)
    frequency = kwd.lexeme_df(t.issues, asked.select(F.col("lexeme").alias("word")))
    wanted = kwd.rare_lexemes(t.plain_questions, frequency, t.issues)
    found = kwd.score_postings(wanted, kwd.postings(t.issues))
    return found.select("qid", "issue_key", F.round("score", 6).alias("score"))


@query
def keyword_topk(t: Tables) -> DataFrame:
    return scored(search.keyword_list(t.questions, t.index, t.chunks, DESC))


@query
def index_postings(t: Tables) -> DataFrame:
    """Everything the stored index holds of each posting."""
    return t.index.postings.select("lexeme", "issue_key", *fm.FACETS, "created", "n_a", "n_b")


@query
def index_frequency(t: Tables) -> DataFrame:
    return kwx.lexeme_frequency(t.index)


@query
def stemmed_vocabulary(t: Tables) -> DataFrame:
    return stem_words(kwd.lexeme_df(t.issues))


@query
def stemmed_scores(t: Tables) -> DataFrame:
    found = kwd.stemmed_scores(t.plain_questions, t.issues, kwd.postings(t.issues))
    return found.select("qid", "issue_key", F.round("score", 6).alias("score"))


# --- fusion -------------------------------------------------------------------------

@query
def candidate_lists(t: Tables) -> DataFrame:
    lists = search.candidate_lists(t.questions, t.issues, t.chunks, index=t.index)
    return lists.select("qid", "list", "rank", "issue_key", F.round("score", 6).alias("score"))


@query
def hybrid_rrf(t: Tables) -> DataFrame:
    return scored(search.search_hybrid(t.questions, t.issues, t.chunks, DESC, index=t.index), 8)


@query
def rrf_fusion(t: Tables) -> DataFrame:
    return scored(fusion.fuse_lists(t.lists, {"vec": 1.0, "kw": 0.5}, V.TOP_K, base=1), 8)


@query
def tail_rescue(t: Tables) -> DataFrame:
    return scored(search.search_rescue(t.questions, t.issues, t.chunks, DESC, index=t.index))


@query
def tail_rescue_two(t: Tables) -> DataFrame:
    return scored(fusion.rescue(search.vec_of(t.lists), search.kw_of(t.lists), m=2))


@query
def overlap_scores(t: Tables) -> DataFrame:
    pairs = search.pair_scores(search.vec_of(t.lists).where(F.col("rank") < V.RERANK_DEPTH), t.questions, t.issues)
    return pairs.select("qid", "issue_key", F.round("pair_score", 6).alias("pair_score"))


@query
def routed_rerank(t: Tables) -> DataFrame:
    hits = search.search_rerank(t.questions, t.issues, t.chunks, DESC)
    return hits.select("qid", "rank", "issue_key", F.round("score", 8).alias("score"), "route")


@query
def stored_score_rerank(t: Tables) -> DataFrame:
    """Candidates of the project 'src3' have no stored score; they count as 0."""
    scored_keys = t.issues.where("project <> 'src3'").select("issue_key")
    stored = t.scores.join(scored_keys, "issue_key", "left_semi")
    hits = fusion.routed(search.vec_of(t.lists), search.route_flags(t.questions), stored)
    return hits.select("qid", "rank", "issue_key", F.round("score", 8).alias("score"), "route")


def scored_candidates(t: Tables) -> DataFrame:
    return search.vec_of(t.lists).join(t.scores, ["qid", "issue_key"])


@query
def pure_rerank(t: Tables) -> DataFrame:
    return scored(fusion.pure_rerank(scored_candidates(t), V.RERANK_DEPTH))


@query
def pure_rerank_sort_all(t: Tables) -> DataFrame:
    return scored(fusion.pure_rerank(scored_candidates(t), V.RERANK_DEPTH, cut_first=False))


# --- evaluation ---------------------------------------------------------------------

def run_of(hits: DataFrame, name: str) -> DataFrame:
    return hits.select(F.lit(name).alias("strategy"), "qid", "rank", "issue_key")


def six_strategies(t: Tables) -> DataFrame:
    """Hits of all six strategies; the four filtered ones read the stored lists."""
    vec, kw = search.vec_of(t.lists), search.kw_of(t.lists)
    short = search.search(search.query_vectors(t.plain_questions, SHORT_DIM), t.chunks, "summary_only")
    runs = [
        run_of(short, "summary_only"), run_of(t.hits, "summary_desc"),
        run_of(vec.where(F.col("rank") < V.TOP_K), "summary_desc_filtered"),
        run_of(fusion.fuse(vec, kw, V.TOP_K), "summary_desc_hybrid"),
        run_of(fusion.rescue(vec, kw), "summary_desc_rescue"),
        run_of(search.search_rerank(t.questions, t.issues, t.chunks, DESC, candidates=vec), "summary_desc_rerank")]
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out


STRATEGY_RUNS = ["summary_only", "summary_desc", "summary_desc_filtered", "summary_desc_hybrid",
                 "summary_desc_rescue", "summary_desc_rerank"]
ROUNDED = ["recall_at_5", "recall_at_10", "mrr"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = {f.name: F.round(f.name, digits) for f in df.schema if f.dataType.typeName() == "double"}
    return df.withColumns(doubles)


@query
def metrics_per_question(t: Tables) -> DataFrame:
    return rounded(evaluate.question_metrics(six_strategies(t), t.gold, t.types, runs=STRATEGY_RUNS))


@query
def strategy_report(t: Tables) -> DataFrame:
    metrics = evaluate.question_metrics(six_strategies(t), t.gold, t.types, runs=STRATEGY_RUNS)
    return rounded(evaluate.metrics_report(metrics))


@query
def overall_means(t: Tables) -> DataFrame:
    hits = run_of(t.hits, "summary_desc")
    return rounded(evaluate.overall_means(evaluate.question_metrics(hits, t.gold, t.types, runs=["summary_desc"])))


def plain_against_filtered(t: Tables) -> DataFrame:
    base = evaluate.question_metrics(run_of(t.hits, "base"), t.gold, t.types, runs=["base"])
    kept = run_of(search.vec_of(t.lists).where(F.col("rank") < V.TOP_K), "other")
    return evaluate.compare_questions(base, evaluate.question_metrics(kept, t.gold, t.types, runs=["other"]))


@query
def compare_runs(t: Tables) -> DataFrame:
    return rounded(plain_against_filtered(t))


@query
def comparison_report(t: Tables) -> DataFrame:
    return rounded(evaluate.comparison_report(plain_against_filtered(t)))


@query
def gold_movement(t: Tables) -> DataFrame:
    after = fusion.fuse(search.vec_of(t.lists), search.kw_of(t.lists), V.TOP_K)
    return evaluate.gold_movement(search.vec_of(t.lists), after, t.gold)


@query
def weight_sweep(t: Tables) -> DataFrame:
    hits = cut_lineage(evaluate.weight_sweep(search.vec_of(t.lists), search.kw_of(t.lists)))
    metrics = evaluate.question_metrics(hits, t.gold, t.types, run="weight", runs=V.WEIGHT_SWEEP)
    return rounded(evaluate.sweep_report(metrics, "weight", metrics.where("weight = 0")))


@query
def depth_sweep(t: Tables) -> DataFrame:
    hits = evaluate.depth_sweep(scored_candidates(t))
    metrics = evaluate.question_metrics(hits, t.gold, t.types, run="depth", runs=V.OFFLINE_DEPTHS)
    base = evaluate.question_metrics(run_of(search.vec_of(t.lists), "base"), t.gold, t.types, runs=["base"])
    return rounded(evaluate.sweep_report(metrics, "depth", base))


@query
def routed_depth_sweep(t: Tables) -> DataFrame:
    hits = evaluate.routed_depth_sweep(search.vec_of(t.lists), search.route_flags(t.questions), t.scores, [10, 20, 30])
    return hits.select("depth", "qid", "rank", "issue_key", F.round("score", 8).alias("score"), "route")


@query
def reference_run_check(t: Tables) -> DataFrame:
    sweep = evaluate.weight_sweep(search.vec_of(t.lists), search.kw_of(t.lists), [0.0])
    return evaluate.same_lists(sweep, search.vec_of(t.lists))


@query
def plain_run_check(t: Tables) -> DataFrame:
    """The same check between plain and filtered search, which differ."""
    return evaluate.same_lists(t.hits, search.vec_of(t.lists))


# --- content ------------------------------------------------------------------------

@query
def content_strategies(t: Tables) -> DataFrame:
    return content.all_contents(t.issues, V.MAX_CONTENT_CHARS)


@query
def content_report(t: Tables) -> DataFrame:
    return content.content_report(content.all_contents(t.issues, V.MAX_CONTENT_CHARS))


@query
def embedding_backlog(t: Tables) -> DataFrame:
    return content.backlog(t.issues, t.chunks, DESC).select("issue_key", "issue_id")


@query
def embedding_backlog_first(t: Tables) -> DataFrame:
    return content.backlog(t.issues, t.chunks, DESC, limit=100).select("issue_key", "issue_id")


@query
def token_budget_batches(t: Tables) -> DataFrame:
    sizes = content.contents(t.issues, DESC).select("issue_key", F.char_length("content").alias("size"))
    return batching.token_budget_batches(sizes, "size", "issue_key")


@query
def hashed_embedding(t: Tables) -> DataFrame:
    made = content.hash_embed(content.contents(t.issues, DESC), 64)
    e = F.col("embedding")
    return made.select("issue_key", "strategy", F.size(e).alias("dim"), F.round(vector.norm(e), 4).alias("norm"),
                       F.round(e[0].cast("double"), 4).alias("first"), F.round(e[63].cast("double"), 4).alias("last"),
                       F.size(F.filter(e, lambda x: x != 0)).alias("filled"))


@query
def query_prefix(t: Tables) -> DataFrame:
    return t.plain_questions.select("qid", text.embed_query_text(F.col("question")).alias("query_text"))


# --- contexts and answers -----------------------------------------------------------

@query
def context_rows(t: Tables) -> DataFrame:
    return contexts.context_rows(t.hits, t.issues, V.CONTEXT_DESC_CHARS)


@query
def prompt_text(t: Tables) -> DataFrame:
    listed = contexts.context_lists(contexts.context_rows(t.hits, t.issues, V.CONTEXT_DESC_CHARS))
    return contexts.prompts(t.plain_questions, listed)


@query
def pair_text_sizes(t: Tables) -> DataFrame:
    pairs = search.vec_of(t.lists).where(F.col("rank") < V.RERANK_DEPTH).select("qid", "issue_key")
    asked = t.questions.select("qid", F.size(text.words(F.col("question"))).alias("asked"))

    def size(chars: int):
        return F.col("asked") + F.size(text.words(text.rerank_text(F.col("summary"), F.col("description"), chars)))

    documents = contexts.rows_of_keys(t.issues, pairs)
    measured = (pairs.join(asked, "qid").join(documents, "issue_key")
                .select(size(V.RERANK_DESC_CHARS).alias("words_500"), size(V.OFFLINE_RERANK_DESC_CHARS).alias("words_1000")))
    return rounded(agreement.text_sizes(measured, "words_500", "words_1000"), 4)


@query
def citation_split(t: Tables) -> DataFrame:
    split = contexts.citation_split(t.answers, "DOC")
    return split.select("qid", joined("cited_keys"), joined("citations"), joined("invented_citations"))


@query
def citation_classes(t: Tables) -> DataFrame:
    return grading.classify_citations(t.answers, t.contexts, "DOC")


def graded(t: Tables) -> DataFrame:
    classes = grading.classify_citations(t.answers, t.contexts, "DOC")
    return grading.grade_answers(t.answers, classes, t.gold, t.types)


@query
def answer_grades(t: Tables) -> DataFrame:
    return graded(t)


@query
def grade_summary(t: Tables) -> DataFrame:
    return grading.grade_summary(graded(t))


@query
def grade_flags(t: Tables) -> DataFrame:
    return grading.grade_flags(graded(t))


# --- parser evaluation --------------------------------------------------------------

# --- fixed values: candidate predicates a question may name ---------------------------
CANDIDATES = {
    "Blocker": "priority = 'Blocker' AND issue_type = 'Bug' AND resolution IS NULL",
    "Critical": "priority = 'Critical' AND resolution = 'Fixed' AND created >= '1996-01-01' AND created < '1999-01-01'",
    "Major": "summary ILIKE '%the%' AND priority = 'Major'",
    "Minor": r"issue_type = 'Bug' AND (regexp_like(lower(summary), 'on ?the\\b') OR regexp_like(lower(description), 'ent'))",
}


def candidate_questions(t: Tables) -> DataFrame:
    """Filtered questions name the candidate predicate of their priority; trivial ones have none."""
    named = F.regexp_extract("question", "^Which ([a-z]+) bugs", 1)
    name = F.when((F.col("type") == "filtered") & (named != "trivial"), F.initcap(named))
    return t.questions.withColumn("candidate", name)


@query
def parse_rows(t: Tables) -> DataFrame:
    return parse_eval.parse_eval(t.questions, t.issues, t.gold)


@query
def parse_summary(t: Tables) -> DataFrame:
    return parse_eval.parse_summary(parse_eval.parse_eval(t.questions, t.issues, t.gold))


@query
def gold_kept(t: Tables) -> DataFrame:
    return parse_eval.gold_kept(t.questions, t.issues, t.gold)


@query
def extra_keys(t: Tables) -> DataFrame:
    return parse_eval.extra_keys(t.questions, t.issues, t.gold, V.EXTRA_KEYS_KEPT)


@query
def candidate_diff(t: Tables) -> DataFrame:
    return parse_eval.candidate_diff(candidate_questions(t), t.issues, CANDIDATES)


@query
def exact_matches(t: Tables) -> DataFrame:
    asked = candidate_questions(t)
    return parse_eval.exact_matches(asked, parse_eval.candidate_diff(asked, t.issues, CANDIDATES))


@query
def candidate_rows(t: Tables) -> DataFrame:
    return parse_eval.candidate_rows(t.issues, CANDIDATES)


# --- score agreement ----------------------------------------------------------------

def score_pairs(t: Tables) -> DataFrame:
    return agreement.paired_scores(search.vec_of(t.lists), t.narrow_scores, t.wide_scores)


@query
def score_agreement(t: Tables) -> DataFrame:
    return rounded(agreement.score_agreement(score_pairs(t)))


@query
def average_ranks(t: Tables) -> DataFrame:
    counts = t.issues.groupBy(F.char_length("summary").cast("double").alias("size")).agg(F.count("*").alias("n"))
    return agreement.average_ranks(counts, "size")


@query
def top10_agreement(t: Tables) -> DataFrame:
    return agreement.top_agreement(score_pairs(t))


# --- ingest, merge, quality ---------------------------------------------------------

FLAT = ["issue_key", "issue_id", "project", "summary", "description", "issue_type", "priority",
        "status", "resolution", "created", "updated", "resolutiondate"]


def as_text(df: DataFrame) -> DataFrame:
    """Times as UTC text, so engines compare them alike."""
    stamps = {f.name: F.date_format(f.name, "yyyy-MM-dd HH:mm:ss") for f in df.schema if f.dataType.typeName() == "timestamp"}
    return df.withColumns(stamps)


@query
def issue_flatten(t: Tables) -> DataFrame:
    flat = pages.flatten_pages(pages.parse_pages(t.page_bodies))
    return as_text(flat.select(*FLAT, "raw", "date_suspect", "start_at", "position"))


@query
def issue_upsert(t: Tables) -> DataFrame:
    arriving = pages.flatten_pages(pages.parse_pages(t.page_bodies))
    return as_text(merge.upsert_issues(t.stored_issues, arriving, ["start_at", "position"]).select(*FLAT, "raw"))


@query
def chunk_upsert(t: Tables) -> DataFrame:
    """Stored: first-version contents of issues before 1999.  Arriving: both strategies of every closed issue."""
    stored = content.all_contents(t.stored_issues)
    arriving = content.all_contents(t.issues.where("status <> 'O'")).withColumn("arrival", F.lit(1))
    return merge.upsert_chunks(stored, arriving, ["arrival"])


@query
def project_counts(t: Tables) -> DataFrame:
    return pages.project_counts(t.issues)


@query
def project_oldest(t: Tables) -> DataFrame:
    return pages.of_project(t.issues, "src7", max_issues=25).select("issue_key", "issue_id")


def land_pages(t: Tables, folder: str, version: str, files: int) -> None:
    """One version of every issue, landed as pages of up to 50 issues, a page a line, in a few compressed files."""
    only = F.filter("p.issues", lambda i: (F.try_variant_get(i["fields"], "$.status.name", "string") == "O") == F.lit(version == "first"))
    paged = (t.page_bodies.select(F.from_json("body", schemas.PAGE).alias("p"))
             .select(F.floor(F.col("p.startAt") / 50).alias("page"), F.inline(only)).repartition(files, "page")
             .groupBy("page").agg(F.collect_list(F.struct("key", "id", "fields")).alias("issues")))
    body = F.to_json(F.struct((F.col("page") * 50).alias("startAt"), F.size("issues").alias("total"), "issues"))
    paged.select(body.alias("value")).write.mode("append").option("compression", "gzip").text(folder)


def seeded_store(t: Tables, root: str):
    """An issue store that holds the issues as they stood at the start of 1999."""
    store = ingest.issue_store(t.spark, root, buckets=16)
    seeds = t.stored_issues.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.ISSUES
                                          if f.name not in t.stored_issues.columns)).select(*schemas.ISSUES.names)
    store.append(store.snapshot(), seeds, {}, {})
    return store


def drain(t: Tables, root: str) -> None:
    ingest.stream_issues(t.spark, f"{root}/landing", f"{root}/issues", f"{root}/state", multi_line=False,
                         max_files=2, keep=2).awaitTermination()


@query
def stream_ingest(t: Tables) -> DataFrame:
    """Pages of many issues, landed twice, drained in four batches into a store that holds older issues; the newest snapshot."""
    root = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    store = seeded_store(t, f"{root}/issues")
    for version in ("first", "closing"):
        land_pages(t, f"{root}/landing", version, files=4)
        drain(t, root)
    return as_text(store.read().select(*FLAT, "raw"))


@query
def stream_embed(t: Tables) -> DataFrame:
    """Chunks of a stream that was told of all issues while only the old ones were merged, and ran again after the merge."""
    root = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    seeded_store(t, f"{root}/issues")
    for version in ("first", "closing"):
        land_pages(t, f"{root}/landing", version, files=4)
    for merged in (False, True):
        if merged:
            drain(t, root)
        ingest.stream_chunks(t.spark, f"{root}/landing", f"{root}/issues", f"{root}/chunks", f"{root}/embedded", DESC,
                             lambda: content.HashingEmbedder(SHORT_DIM), multi_line=False).awaitTermination()
    made = ingest.chunk_store(t.spark, f"{root}/chunks").read()
    return made.select("issue_key", "strategy", "chunk_index", "content", "token_count", F.size("embedding").alias("dim"))


@query
def md5_sample(t: Tables) -> DataFrame:
    return t.issues.orderBy(F.md5("issue_key"), "issue_key").limit(50).select("issue_key")


@query
def duplicate_keys(t: Tables) -> DataFrame:
    flat = pages.flatten_pages(pages.parse_pages(t.page_bodies))
    return quality.duplicate_keys(flat, "issue_key")


@query
def orphan_chunks(t: Tables) -> DataFrame:
    parents = t.issues.where("priority <> 'Minor'")
    return quality.orphans(t.chunks, parents).select("issue_key", "strategy")


@query
def cascade_delete(t: Tables) -> DataFrame:
    deleted = t.issues.where("resolution = 'Fixed'")
    return quality.cascade_delete(t.chunks, deleted).select("issue_key", "strategy")


@query
def null_counts(t: Tables) -> DataFrame:
    return quality.null_counts(t.issues, *FLAT)


@query
def wrong_dimension(t: Tables) -> DataFrame:
    return quality.wrong_dimension(t.chunks, SHORT_DIM).select("issue_key", "strategy")


# --- caches and requests ------------------------------------------------------------

@query
def parse_cache_fingerprint(t: Tables) -> DataFrame:
    """Fingerprint of each stored response, and whether it is the one valid for model 'm1'."""
    key = records.fingerprint(F.col("response"), F.lit("m1"))
    return t.responses.select("qid", key.alias("fingerprint"),
                              (key == records.fingerprint(F.lit("No filter is stated."), F.lit("m1"))).alias("valid"))


@query
def uncached_questions(t: Tables) -> DataFrame:
    """Questions whose form is missing from a cache that holds only error-free parses with a filter."""
    cached = t.questions.where(fm.has_filter() & ~F.col("parse_error")).select("question")
    return records.uncached_questions(t.plain_questions, cached).select("qid")


@query
def score_backlog(t: Tables) -> DataFrame:
    """Only questions that reach the reranker have scores; the others are still to do."""
    done = t.scores.join(t.questions.where(~fm.has_filter()).select("qid"), "qid", "left_semi")
    return records.unscored(t.plain_questions, done).select("qid")


@query
def request_validation(t: Tables) -> DataFrame:
    """Every document's text taken as a question, with its label's quality deciding the asked k."""
    k = F.when(F.col("quality") == 1, F.lit(None).cast("int")).when(F.col("quality") == 0, F.lit(51)).otherwise(F.lit(20))
    requests = (t.read("documents").join(t.read("labels"), "doc_id", "left")
                .select("doc_id", F.col("text").alias("question"), k.alias("k")))
    return search.valid_requests(requests).select("doc_id", "k", "valid")


# --- stored files -------------------------------------------------------------------

def documents_of(frame: DataFrame, document, t: Tables) -> str:
    """One JSON document a file, as evaluation runs leave them.  Returns the folder."""
    folder = kept_path(t.spark)
    frame.select(F.to_json(document).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return folder


@query
def gold_jsonl_scan(t: Tables) -> DataFrame:
    """The gold set as JSONL: a blank line before every lookup, and a torn line in place of every filtered question."""
    listed = t.gold.groupBy("qid").agg(F.sort_array(F.collect_list("issue_key")).alias("expected"))
    line = F.to_json(F.struct(F.concat(F.lit("Q"), F.col("qid")).alias("id"), "type", "question", "expected"))
    folder = kept_path(t.spark)
    (t.plain_questions.join(listed, "qid")
     .select(F.when(F.col("type") == "lookup", F.concat(F.lit("  \n"), line))
             .when(F.col("type") == "filtered", F.concat(F.lit('{"id":"Q'), F.col("qid"), F.lit('","expected":["')))
             .otherwise(line).alias("value"))
     .write.text(folder))
    rows = records.scan_gold(t.spark, folder)
    return rows.select(F.when(F.col("corrupt").isNull(), F.col("id")).alias("id"), "type", "question",
                       joined("expected"), "corrupt")


@query
def answers_scan(t: Tables) -> DataFrame:
    entry = F.struct(F.col("qid").cast("string").alias("id"), "answer", text.cited_keys(F.col("answer"), "DOC").alias("cited_keys"),
                     "context_keys", "seconds")
    rows = records.read_answers(t.spark, documents_of(t.answers, F.struct(F.array(entry).alias("questions")), t))
    return rows.select(F.col("qid").cast("long").alias("qid"), joined("cited_keys"), joined("context_keys"), "seconds")


@query
def scores_scan(t: Tables) -> DataFrame:
    """Pair scores of the first ten candidates, one document a question."""
    first = search.vec_of(t.lists).where(F.col("rank") < V.TOP_K).join(t.scores, ["qid", "issue_key"])
    kept = first.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("issue_key", "pair_score"))).alias("scores"))
    document = F.create_map(F.col("qid").cast("string"), F.struct("scores"))
    rows = records.read_scores(t.spark, documents_of(kept, document, t))
    return rows.select(F.col("qid").cast("long").alias("qid"), "issue_key", F.round("pair_score", 6).alias("pair_score"))


@query
def parse_cache_roundtrip(t: Tables) -> DataFrame:
    """Forms of two parsers in one cache; the second run of the first one replaces its own rows only."""
    folder = kept_path(t.spark)
    form = F.struct(*schemas.FORM_COLUMNS)
    parses = t.questions.select("question", form.alias("form")).dropDuplicates(["question"])
    empty = parses.withColumn("form", F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in parses.schema["form"].dataType)))
    records.write_parse_cache(empty, folder, "p1", "m1", "c1")
    records.write_parse_cache(empty, folder, "p2", "m2", "c1")
    records.write_parse_cache(parses, folder, "p1", "m1", "c2")
    rows = [records.read_parse_cache(t.spark, folder, key, t.plain_questions).withColumn("parser", F.lit(key)) for key in ["p1", "p2"]]
    return rows[0].unionByName(rows[1]).select("parser", "qid", joined("priority"), "open", "created_from", "parse_error")


@query
def score_cache_resume(t: Tables) -> DataFrame:
    """Lookups are scored first, then all questions, then all again: each pair is stored once."""
    folder = kept_path(t.spark)
    lookups = t.types.where("type = 'lookup'").select("qid")
    records.append_scores(t.scores.join(lookups, "qid", "left_semi"), folder)
    for _ in range(2):
        records.append_scores(t.scores, folder)
    return (t.spark.read.schema(t.scores.schema).parquet(folder).groupBy("qid")
            .agg(F.count("*").alias("pairs"), F.count_distinct("issue_key").alias("issues")))


@query
def write_once_and_suffix(t: Tables) -> DataFrame:
    """Question types written to a name three times: the first is kept, the others get a suffix, a plain write is refused."""
    base = kept_path(t.spark) + "/types"
    paths = [sinks.write_with_suffix(t.types.where(F.col("type") == kind), base) for kind in ["lookup", "topic", "filtered"]]
    try:
        sinks.write_once(t.types, paths[0])
        refused = False
    except FileExistsError:
        refused = True
    parts = [t.spark.read.schema(t.types.schema).parquet(p).withColumn("target", F.lit(p.rsplit("/", 1)[1])) for p in paths]
    return (parts[0].unionByName(parts[1]).unionByName(parts[2])
            .withColumn("refused", F.lit(refused)).select("target", "qid", "type", "refused"))


@query
def stats_rebuild(t: Tables) -> DataFrame:
    """Stem frequencies of the issues of 1998 and before, made anew from all issues, then once more from the stored table itself."""
    path = kept_path(t.spark) + "/lexeme_df"
    stale = t.index.postings.where(F.col("created") < F.lit("1999-01-01").cast("timestamp"))
    sinks.rebuild(stale.groupBy(F.col("lexeme").alias("word")).agg(F.count("*").alias("ndoc")), path)
    sinks.rebuild(kwx.lexeme_frequency(t.index), path)
    stored = t.spark.read.schema("word string, ndoc long").parquet(path)
    sinks.rebuild(stored.where("ndoc > 1"), path)
    return t.spark.read.schema("word string, ndoc long").parquet(path)


@query
def run_stamp(t: Tables) -> DataFrame:
    stamped = sinks.stamp_run(t.hits.select("qid", "rank", "issue_key"), run="r1", model="m1", k=V.TOP_K, strategy=DESC)
    path = sinks.write_with_suffix(stamped, kept_path(t.spark) + "/run")
    return t.spark.read.schema(stamped.schema).parquet(path)


@query
def missing_gold(t: Tables) -> DataFrame:
    """Answers whose question is no topic question have no gold question in a set of topics."""
    return grading.missing_gold(t.answers, t.types.where("type = 'topic'")).select("qid")


@query
def stage_means(t: Tables) -> DataFrame:
    """Mean stage seconds of a run log; the stages are eighths of the answers' measures."""
    part = (lambda c: F.col(c).cast("double") / F.lit(8.0))
    log = t.plain_questions.withColumn("size", F.char_length("question")).select(
        part("size").alias("parse"), (part("size") / 2).alias("embed"), (part("size") + 1).alias("vector"),
        F.when(F.col("type") != "filtered", part("size") * 4).alias("rerank"), (part("size") * 8).alias("total"))
    means = evaluate.stage_means(log)
    return means.select(*(F.round(c, 6).alias(c) for c in means.columns))


@query
def throughput(t: Tables) -> DataFrame:
    """Rows, cut rows and rate of a run log with one entry for each project; a second for every 1,024 characters."""
    made = content.contents(t.issues, DESC, 500).join(t.issues.select("issue_key", "project"), "issue_key")
    log = made.groupBy("project").agg(
        F.count("*").alias("rows"), F.count_if(F.col("token_count") > F.char_length("content")).alias("truncated"),
        (F.sum("token_count") / F.lit(1024.0)).alias("seconds"))
    out = content.throughput(log)
    return out.select("rows", "truncated", F.round("seconds", 6).alias("seconds"), F.round("rows_per_second", 8).alias("rows_per_second"))
