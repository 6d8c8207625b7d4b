"""SQL oracles of the query suite, written apart from the Spark plans.

Each statement reads the raw tables.  Shared derivations are common table expressions
named ``v_*``; a statement pulls in those it mentions.
"""

from __future__ import annotations

import re

from lodestone import values as V
from lodestone.functions import stem

STOP = ", ".join(f"'{w}'" for w in V.STOP_WORDS)
WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"


def words(text: str) -> str:
    return WORDS.format(text)


def cosine(a: str, b: str) -> str:
    def dot(x: str, y: str) -> str:
        return f"list_inner_product({x}::DOUBLE[], {y}::DOUBLE[])"
    return f"1.0 - {dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"


def short(vector: str) -> str:
    head = f"({vector})[1:32]"
    return (f"list_transform({head}, lambda x: (x::DOUBLE / sqrt(list_inner_product({head}::DOUBLE[], "
            f"{head}::DOUBLE[])))::FLOAT)")


def listed(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def named_object(column: str) -> str:
    return f"CASE WHEN {column} IS NOT NULL THEN json_object('name', {column}) END"


def sent(column: str) -> str:
    return f"concat(strftime({column}, '%Y-%m-%dT%H:%M:%S.%g'), CASE WHEN issue_type = 'Improvement' THEN '+0200' ELSE '+0000' END)"


def raw_fields(description: str, status: str, resolution: str, updated: str) -> str:
    """All delivered fields of an issue version, keys in order."""
    return f"""json_object('created', {sent('created')}, 'description', {description}, 'issuetype', {named_object('issue_type')},
    'labels', json_array(project, NULL), 'priority', {named_object('priority')}, 'resolution', {resolution}, 'resolutiondate', {updated},
    'status', {status}, 'summary', summary, 'updated', {updated},
    'votes', json_object('count', issue_id, 'last', json_object('by', NULL)))::VARCHAR"""


FORM_MATCH = """(f.priority IS NULL OR list_contains(f.priority, i.priority))
  AND (f.issue_type IS NULL OR list_contains(f.issue_type, i.issue_type))
  AND (f.open IS NULL OR f.open = (i.resolution IS NULL))
  AND (f.resolution IS NULL OR coalesce(list_contains(f.resolution, i.resolution), false))
  AND (f.created_from IS NULL OR i.created >= try_cast(f.created_from AS TIMESTAMP))
  AND (f.created_to IS NULL OR i.created < try_cast(f.created_to AS TIMESTAMP))"""

FILTERED = ("(f.priority IS NOT NULL OR f.issue_type IS NOT NULL OR f.open IS NOT NULL OR f.resolution IS NOT NULL "
            "OR f.created_from IS NOT NULL OR f.created_to IS NOT NULL)")

def overlap(description: str) -> str:
    """Share of the question's words that summary and description hold."""
    asked = f"list_distinct({words('f.question')})"
    body = words(f"concat(coalesce(i.summary, ''), chr(10), {description})")
    return f"coalesce(len(list_intersect({asked}, {body}))::DOUBLE / nullif(len({asked}), 0), 0)"


def one_of(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


def mapped(column: str, rules: dict[str, str], otherwise: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules.items()) + f" ELSE {otherwise} END"


def ending(view: str, rules: dict[str, str], allowed: str) -> str:
    """A suffix step: the longest suffix is the leftmost match at the end; it changes only where ``allowed`` holds."""
    return f"""
SELECT word, fixed, p1, p2, CASE WHEN sfx <> '' AND ({allowed}) THEN concat(left(w, stem_len), {mapped('sfx', rules, "''")}) ELSE w END AS w
FROM (SELECT *, length(w) - length(sfx) AS stem_len FROM (SELECT *, regexp_extract(w, '({"|".join(rules)})$') AS sfx FROM {view}))"""


LEFT1, LEFT2 = "left(w, length(w) - 1)", "left(w, length(w) - 2)"
STEM_VIEWS = {
    "v_words": f"""
SELECT lexeme AS word FROM v_postings UNION
SELECT lexeme FROM (SELECT unnest({words('question')}) AS lexeme FROM v_questions) WHERE lexeme NOT IN ({STOP})""",
    "v_marked": f"""
SELECT word, CASE WHEN length(word) <= 2 THEN word ELSE {mapped('word', stem.IRREGULAR, 'NULL')} END AS fixed,
  regexp_replace(word, '(^|[aeiouy])y', '\\1Y', 'g') AS w FROM v_words""",
    "v_region": r"""
SELECT word, fixed, w, p1, CASE WHEN second > 0 THEN p1 + second ELSE length(w) END AS p2 FROM (
  SELECT *, length(regexp_extract(substr(w, p1 + 1), '^(.*?[aeiouy][^aeiouy])', 1)) AS second FROM (
    SELECT *, CASE WHEN first > 0 THEN first ELSE length(w) END AS p1 FROM (
      SELECT *, length(regexp_extract(w, '^(gener|commun|arsen|.*?[aeiouy][^aeiouy])', 1)) AS first FROM v_marked)))""",
    "v_plural": f"""
SELECT word, p1, p2, w, coalesce(fixed, CASE WHEN w IN ({one_of(stem.KEPT_AFTER_PLURAL)}) THEN w END) AS fixed FROM (
  SELECT word, fixed, p1, p2, CASE WHEN ends_with(w, 'sses') THEN {LEFT2}
    WHEN regexp_matches(w, '(ied|ies)$') THEN CASE WHEN length(w) > 4 THEN {LEFT2} ELSE {LEFT1} END
    WHEN regexp_matches(w, '(us|ss)$') THEN w WHEN regexp_matches(w, '[aeiouy].+s$') THEN {LEFT1} ELSE w END AS w FROM v_region)""",
    "v_past": f"""
SELECT word, fixed, p1, p2, CASE
  WHEN ends_with(w, 'eedly') THEN CASE WHEN length(w) - 5 >= p1 THEN left(w, length(w) - 3) ELSE w END
  WHEN ends_with(w, 'eed') THEN CASE WHEN length(w) - 3 >= p1 THEN {LEFT1} ELSE w END
  WHEN bare IS NULL THEN w
  WHEN regexp_matches(bare, '(at|bl|iz)$') THEN concat(bare, 'e')
  WHEN regexp_matches(bare, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(bare, length(bare) - 1)
  WHEN p1 >= length(bare) AND regexp_matches(bare, '{stem.SHORT}') THEN concat(bare, 'e') ELSE bare END AS w
FROM (SELECT *, CASE WHEN regexp_matches(w, '[aeiouy].*(ed|edly|ing|ingly)$')
                THEN regexp_replace(w, '(edly|ingly|ed|ing)$', '') END AS bare FROM v_plural)""",
    "v_final_y": f"""
SELECT word, fixed, p1, p2, CASE WHEN regexp_matches(w, '.[^aeiouy][yY]$') THEN concat({LEFT1}, 'i') ELSE w END AS w FROM v_past""",
    "v_derived": ending("v_final_y", stem.DERIVED, "stem_len >= p1 AND (sfx <> 'ogi' OR regexp_matches(w, 'logi$')) "
                        "AND (sfx <> 'li' OR regexp_matches(w, '[cdeghkmnrt]li$'))"),
    "v_further": ending("v_derived", stem.FURTHER, "stem_len >= CASE sfx WHEN 'ative' THEN p2 ELSE p1 END"),
    "v_ended": ending("v_further", dict.fromkeys(stem.ENDINGS, ""),
                      "stem_len >= p2 AND (sfx <> 'ion' OR regexp_matches(w, '[st]ion$'))"),
    "v_stems": f"""
SELECT word, coalesce(fixed, replace(CASE
  WHEN ends_with(w, 'e') AND (length(w) - 1 >= p2 OR (length(w) - 1 >= p1 AND NOT regexp_matches({LEFT1}, '{stem.SHORT}'))) THEN {LEFT1}
  WHEN ends_with(w, 'll') AND length(w) - 1 >= p2 THEN {LEFT1} ELSE w END, 'Y', 'y')) AS stem FROM v_ended""",
    "v_stem_postings": """
SELECT s.stem, p.issue_key, sum(p.n_a)::BIGINT AS n_a, sum(p.n_b)::BIGINT AS n_b
FROM v_postings p JOIN v_stems s ON s.word = p.lexeme GROUP BY s.stem, p.issue_key""",
    "v_stem_df": "SELECT stem AS word, count(*) AS ndoc FROM v_stem_postings GROUP BY stem",
    "v_stem_rare": f"""
SELECT q.qid, q.stem FROM (
  SELECT DISTINCT a.qid, s.stem FROM (SELECT qid, unnest({words('question')}) AS lexeme FROM v_questions) a
  JOIN v_stems s ON s.word = a.lexeme WHERE a.lexeme NOT IN ({STOP})) q JOIN v_stem_df d ON d.word = q.stem
WHERE d.ndoc < 0.02::DOUBLE * (SELECT count(*) FROM v_issues)""",
}

VIEWS: dict[str, str] = {
    **STEM_VIEWS,
    "v_issues": """
SELECT concat('DOC-', d.doc_id) AS issue_key, d.doc_id AS issue_id, d.source AS project,
  split_part(d.text, chr(10), 1) AS summary,
  CASE WHEN o.o_orderstatus = 'P' THEN concat('Duplicate of DOC-', o.o_custkey, chr(10),
         CASE WHEN strpos(d.text, chr(10)) > 0 THEN substr(d.text, strpos(d.text, chr(10)) + 1) ELSE '' END)
       WHEN strpos(d.text, chr(10)) > 0 THEN substr(d.text, strpos(d.text, chr(10)) + 1) END AS description,
  CASE d.lang WHEN 'en' THEN 'Bug' WHEN 'fr' THEN 'Improvement' WHEN 'de' THEN 'Sub-task'
       WHEN 'es' THEN 'Question' ELSE 'Task' END AS issue_type,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Blocker' WHEN '2-HIGH' THEN 'Critical' WHEN '3-MEDIUM' THEN 'Major'
       WHEN '4-NOT SPECIFIED' THEN 'Minor' ELSE 'Trivial' END AS priority,
  o.o_orderstatus AS status,
  CASE o.o_orderstatus WHEN 'F' THEN 'Fixed' WHEN 'P' THEN 'Won''t Fix' END AS resolution,
  o.o_orderdate AS created,
  CASE WHEN o.o_orderstatus <> 'O' THEN o.o_orderdate + INTERVAL 30 DAY END AS updated,
  CASE WHEN o.o_orderstatus <> 'O' THEN o.o_orderdate + INTERVAL 30 DAY END AS resolutiondate
FROM documents d JOIN orders o ON o.o_orderkey = d.doc_id""",
    "v_chunks": f"""
SELECT issue_key, 'summary_desc' AS strategy, embedding, label FROM embeddings JOIN v_issues ON vec_id = issue_id
UNION ALL
SELECT issue_key, 'summary_only', {short('embedding')}, label FROM embeddings JOIN v_issues ON vec_id = issue_id""",
    "v_questions": """
SELECT b.item_id AS qid, e.embedding AS qvec, e.label,
  CASE o.o_orderstatus WHEN 'F' THEN 'lookup' WHEN 'O' THEN 'topic' ELSE 'filtered' END AS type,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Blocker' WHEN '2-HIGH' THEN 'Critical' WHEN '3-MEDIUM' THEN 'Major'
       WHEN '4-NOT SPECIFIED' THEN 'Minor' ELSE 'Trivial' END AS pname,
  year(o.o_orderdate) AS y,
  CASE WHEN o.o_orderstatus = 'P' THEN concat('Which ', lower(pname), ' bugs are about: ', b.text) ELSE b.text END AS question
FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id JOIN orders o ON o.o_orderkey = b.item_id""",
    # What each response must come out as, stated case by case.
    "v_forms": """
SELECT qid, question, type,
  CASE WHEN type = 'filtered' THEN CASE pname WHEN 'Blocker' THEN ['Blocker'] WHEN 'Critical' THEN ['Critical']
       WHEN 'Major' THEN ['Major'] WHEN 'Trivial' THEN ['Trivial'] END END AS priority,
  CASE WHEN type = 'filtered' AND pname IN ('Blocker', 'Minor') THEN ['Bug'] END AS issue_type,
  CASE WHEN type = 'filtered' THEN CASE pname WHEN 'Blocker' THEN true WHEN 'Major' THEN false END END AS open,
  CASE WHEN type = 'filtered' THEN CASE pname WHEN 'Critical' THEN ['Fixed'] WHEN 'Minor' THEN ['Fixed', 'Won''t Fix'] END END AS resolution,
  CASE WHEN type = 'filtered' THEN CASE WHEN pname IN ('Critical', 'Major') THEN concat(y, '-01-01') WHEN pname = 'Trivial' THEN 'last year' END END AS created_from,
  CASE WHEN type = 'filtered' THEN CASE pname WHEN 'Critical' THEN concat(y + 2, '-01-01') WHEN 'Minor' THEN concat(y + 2, '-01-01T12:00:00') END END AS created_to,
  CASE WHEN type = 'filtered' AND pname = 'Blocker' THEN ['parser'] WHEN type = 'filtered' AND pname = 'Critical' THEN ['scan']
       ELSE []::VARCHAR[] END AS text_terms,
  (type = 'topic' AND pname = 'Trivial') AS parse_error
FROM v_questions""",
    "v_gold": """
SELECT qid, issue_key FROM (
  SELECT q.qid, s.issue_key, row_number() OVER (PARTITION BY q.qid ORDER BY md5(s.issue_key), s.issue_key) AS n
  FROM v_questions q JOIN (
    SELECT label, issue_key, row_number() OVER (PARTITION BY label ORDER BY md5(issue_key), issue_key) AS place
    FROM v_chunks WHERE strategy = 'summary_desc') s ON s.label = q.label AND s.place <= 5
  WHERE s.issue_key <> concat('DOC-', q.qid) AND q.type <> 'lookup') WHERE n <= 4
UNION ALL SELECT qid, concat('DOC-', qid) FROM v_questions""",
    "v_plain": f"""
SELECT qid, n - 1 AS rank, issue_key, distance AS score FROM (
  SELECT qid, issue_key, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, issue_key) AS n FROM (
    SELECT q.qid, c.issue_key, {cosine('q.qvec', 'c.embedding')} AS distance
    FROM v_questions q, v_chunks c WHERE c.strategy = 'summary_desc')) WHERE n <= 10""",
    "v_plain_short": f"""
SELECT qid, n - 1 AS rank, issue_key, distance AS score FROM (
  SELECT qid, issue_key, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, issue_key) AS n FROM (
    SELECT q.qid, c.issue_key, {cosine('q.v', 'c.embedding')} AS distance
    FROM (SELECT qid, {short('qvec')} AS v FROM v_questions) q, v_chunks c WHERE c.strategy = 'summary_only')) WHERE n <= 10""",
    "v_vec": f"""
SELECT qid, n - 1 AS rank, issue_key, distance FROM (
  SELECT qid, issue_key, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, issue_key) AS n FROM (
    SELECT q.qid, c.issue_key, {cosine('q.qvec', 'c.embedding')} AS distance
    FROM v_questions q JOIN v_forms f ON f.qid = q.qid
    CROSS JOIN v_chunks c JOIN v_issues i ON i.issue_key = c.issue_key
    WHERE c.strategy = 'summary_desc' AND {FORM_MATCH})) WHERE n <= 100""",
    "v_filter_rows": f"""
SELECT f.qid, count(i.issue_key) AS filter_row_count
FROM v_forms f LEFT JOIN (SELECT * FROM v_issues WHERE issue_key IN (SELECT issue_key FROM v_chunks)) i ON {FORM_MATCH}
GROUP BY f.qid""",
    "v_occurrences": f"""
SELECT issue_key, true AS in_summary, unnest({words('summary')}) AS lexeme FROM v_issues WHERE summary IS NOT NULL
UNION ALL
SELECT issue_key, false, unnest({words("coalesce(description, '')")}) FROM v_issues WHERE summary IS NOT NULL""",
    "v_postings": f"""
SELECT lexeme, issue_key, count(*) FILTER (WHERE in_summary) AS n_a, count(*) FILTER (WHERE NOT in_summary) AS n_b
FROM v_occurrences WHERE lexeme NOT IN ({STOP}) GROUP BY lexeme, issue_key""",
    "v_df": "SELECT lexeme AS word, count(*) AS ndoc FROM v_postings GROUP BY lexeme",
    "v_rare": f"""
SELECT q.qid, q.lexeme, coalesce(d.ndoc, 0) AS ndoc
FROM (SELECT DISTINCT qid, unnest({words('question')}) AS lexeme FROM v_questions) q LEFT JOIN v_df d ON d.word = q.lexeme
WHERE q.lexeme NOT IN ({STOP}) AND coalesce(d.ndoc, 0) < 0.02::DOUBLE * (SELECT count(*) FROM v_issues)""",
    "v_kw": f"""
SELECT qid, n - 1 AS rank, issue_key, score FROM (
  SELECT qid, issue_key, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, issue_key) AS n FROM (
    SELECT r.qid, p.issue_key, sum(p.n_a) * 1.0::DOUBLE + sum(p.n_b) * 0.4::DOUBLE AS score
    FROM v_stem_rare r JOIN v_stem_postings p ON p.stem = r.stem
    JOIN v_issues i ON i.issue_key = p.issue_key JOIN v_forms f ON f.qid = r.qid
    WHERE i.issue_key IN (SELECT issue_key FROM v_chunks WHERE strategy = 'summary_desc') AND {FORM_MATCH}
    GROUP BY r.qid, p.issue_key)) WHERE n <= 100""",
    "v_both": """
SELECT coalesce(v.qid, k.qid) AS qid, coalesce(v.issue_key, k.issue_key) AS issue_key,
  v.rank AS vr, k.rank AS kr, v.distance
FROM v_vec v FULL OUTER JOIN v_kw k ON v.qid = k.qid AND v.issue_key = k.issue_key""",
    "v_hybrid": """
SELECT qid, n - 1 AS rank, issue_key, score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vr NULLS LAST, issue_key) AS n FROM (
    SELECT *, coalesce(1.0::DOUBLE / (60 + vr), 0) + 0.25::DOUBLE * coalesce(1.0::DOUBLE / (60 + kr), 0) AS score FROM v_both))
WHERE n <= 10""",
    "v_rescue1": """
SELECT qid, rank, issue_key, distance AS score FROM v_vec WHERE rank < 9
UNION ALL
SELECT qid, head + n - 1, issue_key, CASE WHEN kr IS NOT NULL THEN 1.0::DOUBLE / (60 + kr) END FROM (
  SELECT b.*, least(h.c, 9) AS head,
    row_number() OVER (PARTITION BY b.qid ORDER BY (kr IS NULL), kr, vr) AS n
  FROM v_both b LEFT JOIN (SELECT qid, count(*) AS c FROM v_vec GROUP BY qid) h ON h.qid = b.qid
  WHERE vr IS NULL OR vr >= 9) WHERE n <= 1""",
    "v_scores": f"""
SELECT v.qid, v.rank, v.issue_key, {overlap("coalesce(i.description, '')")} AS whole_score,
  {overlap("substr(coalesce(i.description, ''), 1, 500)")} AS s500, {overlap("substr(coalesce(i.description, ''), 1, 1000)")} AS s1000,
  i.project
FROM v_vec v JOIN v_forms f ON f.qid = v.qid JOIN v_issues i ON i.issue_key = v.issue_key""",
    "v_depths": "SELECT unnest([10, 15, 20, 30]) AS depth",
    "v_routed": f"""
SELECT depth, qid, n - 1 AS rank, issue_key, score, route FROM (
  SELECT *, row_number() OVER (PARTITION BY depth, qid ORDER BY score DESC, vr) AS n FROM (
    SELECT *, 1.0::DOUBLE / (61 + vr) + 1.0::DOUBLE / (60 + rr) AS score, 'rerank' AS route FROM (
      SELECT d.depth, s.qid, s.issue_key, s.rank AS vr,
        row_number() OVER (PARTITION BY d.depth, s.qid ORDER BY s.whole_score DESC, s.rank) AS rr
      FROM v_depths d JOIN v_scores s ON s.rank < d.depth JOIN v_forms f ON f.qid = s.qid WHERE NOT {FILTERED})))
WHERE n <= 10
UNION ALL
SELECT d.depth, v.qid, v.rank, v.issue_key, v.distance, 'filtered'
FROM v_depths d CROSS JOIN v_vec v JOIN v_forms f ON f.qid = v.qid WHERE v.rank < 10 AND {FILTERED}""",
    "v_runs": """
SELECT 'summary_only' AS strategy, qid, rank, issue_key FROM v_plain_short
UNION ALL SELECT 'summary_desc', qid, rank, issue_key FROM v_plain
UNION ALL SELECT 'summary_desc_filtered', qid, rank, issue_key FROM v_vec WHERE rank < 10
UNION ALL SELECT 'summary_desc_hybrid', qid, rank, issue_key FROM v_hybrid
UNION ALL SELECT 'summary_desc_rescue', qid, rank, issue_key FROM v_rescue1
UNION ALL SELECT 'summary_desc_rerank', qid, rank, issue_key FROM v_routed WHERE depth = 20""",
    "v_metrics": """
SELECT s.strategy, q.qid, q.type,
  count(r.issue_key) FILTER (WHERE r.rank < 5)::DOUBLE / count(DISTINCT g.issue_key) AS recall_at_5,
  count(r.issue_key)::DOUBLE / count(DISTINCT g.issue_key) AS recall_at_10,
  coalesce(1.0::DOUBLE / (min(r.rank) + 1), 0) AS mrr, min(r.rank) + 1 AS first_rank
FROM v_questions q CROSS JOIN (SELECT DISTINCT strategy FROM v_runs) s
JOIN v_gold g ON g.qid = q.qid
LEFT JOIN v_runs r ON r.strategy = s.strategy AND r.qid = q.qid AND r.issue_key = g.issue_key
GROUP BY s.strategy, q.qid, q.type""",
    "v_pair": """
SELECT b.qid, b.type, b.recall_at_5 AS base_recall_at_5, b.recall_at_10 AS base_recall_at_10, b.mrr AS base_mrr,
  o.recall_at_5, o.recall_at_10, o.mrr, b.first_rank AS base_first_rank, o.first_rank,
  CASE WHEN o.mrr < b.mrr - 1e-9 THEN 'worse' WHEN o.mrr > b.mrr + 1e-9 THEN 'better' ELSE 'equal' END AS verdict,
  o.recall_at_10 < b.recall_at_10 AS lost_recall
FROM v_metrics b JOIN v_metrics o ON o.qid = b.qid
WHERE b.strategy = 'summary_desc' AND o.strategy = 'summary_desc_filtered'""",
    "v_contents": """
SELECT issue_key, strategy, chunk_index, substr(content, 1, 8000) AS content, token_count FROM v_whole_contents""",
    "v_whole_contents": """
SELECT issue_key, strategy, 0 AS chunk_index, whole AS content, length(whole) AS token_count FROM (
  SELECT issue_key, 'summary_only' AS strategy, coalesce(summary, '') AS whole FROM v_issues
  UNION ALL SELECT issue_key, 'summary_desc', CASE WHEN description IS NULL THEN coalesce(summary, '')
    ELSE concat(coalesce(summary, ''), chr(10), chr(10), description) END FROM v_issues)""",
    "v_whole_context": """
SELECT p.qid, p.rank + 1 AS rank, i.issue_key, i.summary, i.status, i.resolution, i.priority, i.issue_type,
  strftime(i.created, '%Y-%m-%dT%H:%M:%S+00:00') AS created, i.description
FROM v_plain p JOIN v_issues i ON i.issue_key = p.issue_key""",
    "v_context": "SELECT * REPLACE (substr(description, 1, 1500) AS description) FROM v_whole_context",
    "v_answers": """
SELECT q.qid, q.type, k.keys, length(q.question) / 100.0::DOUBLE AS seconds,
  CASE WHEN length(q.question) > 250 THEN 'The issues do not answer this.'
       WHEN q.type = 'lookup' THEN concat('The fix is in [', k.keys[1], '] and [', k.keys[2], '].')
       WHEN q.type = 'topic' THEN concat('See [', k.keys[1], '], which repeats ', coalesce(m.mention, 'none'), '; also [DOC-999999].')
       ELSE concat('As [', k.keys[3], '] says, [', k.keys[3], '] supersedes [', k.keys[2], '].') END AS answer
FROM v_questions q
JOIN (SELECT qid, list(issue_key ORDER BY rank) AS keys FROM v_whole_context GROUP BY qid) k ON k.qid = q.qid
LEFT JOIN (SELECT qid, arg_min(regexp_extract(description, 'Duplicate of (DOC-[0-9]+)', 1), rank) AS mention FROM v_whole_context
           WHERE regexp_matches(description, 'Duplicate of DOC-[0-9]+') GROUP BY qid) m ON m.qid = q.qid""",
    "v_cited": """
SELECT qid, keys, pos - 1 AS pos, cited[pos] AS key FROM (
  SELECT qid, keys, cited, unnest(range(1, len(cited) + 1)) AS pos FROM (
    SELECT qid, keys, list_filter(found, lambda x, n: list_position(found, x) = n) AS cited FROM (
      SELECT qid, keys, regexp_extract_all(answer, 'DOC-[0-9]+') AS found FROM v_answers)))""",
    "v_classes": """
SELECT c.qid, c.pos, c.key,
  CASE WHEN list_contains(c.keys, c.key) THEN 'in_context' WHEN p.issue_key IS NOT NULL THEN 'from_text' ELSE 'invented' END AS class,
  p.issue_key AS found_in_issue, p.field,
  substr(p.body, greatest(strpos(p.body, c.key) - 100, 1),
         strpos(p.body, c.key) + 150 - greatest(strpos(p.body, c.key) - 100, 1)) AS excerpt
FROM v_cited c LEFT JOIN (
  SELECT c.qid, c.pos, x.issue_key, x.field, x.body, row_number() OVER (PARTITION BY c.qid, c.pos ORDER BY x.rank, x.field DESC) AS n
  FROM v_cited c JOIN (SELECT qid, rank, issue_key, 'summary' AS field, summary AS body FROM v_whole_context
                       UNION ALL SELECT qid, rank, issue_key, 'description', description FROM v_whole_context) x
    ON x.qid = c.qid AND contains(x.body, c.key) WHERE NOT list_contains(c.keys, c.key)) p
  ON p.qid = c.qid AND p.pos = c.pos AND p.n = 1""",
    "v_grades": """
SELECT a.qid, a.type, coalesce(c.gold_cited, 0) > 0 AS hit,
  EXISTS (SELECT 1 FROM v_gold g WHERE g.qid = a.qid AND list_contains(a.keys, g.issue_key)) AS gold_in_context,
  coalesce(c.n_cited, 0) AS n_cited, coalesce(c.in_context, 0) AS in_context, coalesce(c.from_text, 0) AS from_text,
  coalesce(c.invented, 0) AS invented, round(coalesce(c.in_context, 0)::DOUBLE / len(list_distinct(a.keys)), 3) AS cite_ratio,
  coalesce(c.n_cited, 0) = 0 AS no_citation, a.seconds, length(a.answer) AS completion_tokens
FROM v_answers a LEFT JOIN (
  SELECT k.qid, count(g.issue_key) AS gold_cited, count(*) AS n_cited, count(*) FILTER (WHERE class = 'in_context') AS in_context,
    count(*) FILTER (WHERE class = 'from_text') AS from_text, count(*) FILTER (WHERE class = 'invented') AS invented
  FROM v_classes k LEFT JOIN v_gold g ON g.qid = k.qid AND g.issue_key = k.key GROUP BY k.qid) c ON c.qid = a.qid""",
    "v_selected": f"SELECT f.qid, i.* FROM v_forms f JOIN v_issues i ON {FORM_MATCH}",
    "v_parse": f"""
SELECT f.qid, f.type, f.parse_error, {FILTERED} AS filtered,
  (f.created_from IS NOT NULL AND try_cast(f.created_from AS TIMESTAMP) IS NULL)
    OR (f.created_to IS NOT NULL AND try_cast(f.created_to AS TIMESTAMP) IS NULL) AS date_error,
  (SELECT count(*) FROM v_selected s WHERE s.qid = f.qid) AS rows_returned,
  (SELECT count(*) FROM v_gold g JOIN v_selected s ON s.qid = g.qid AND s.issue_key = g.issue_key WHERE g.qid = f.qid) AS kept,
  (SELECT count(*) FROM v_gold g WHERE g.qid = f.qid) AS total
FROM v_forms f""",
    "v_flat": f"""
SELECT issue_key, issue_id, 'DOC' AS project, summary, description, issue_type, priority, 'O' AS status, NULL AS resolution,
  shifted AS created, NULL AS updated, issue_id AS start_at, 0 AS position,
  {raw_fields('description', "json_object('name', 'O')", "'none'", 'NULL')} AS raw FROM (
  SELECT *, CASE WHEN issue_type = 'Improvement' THEN created - INTERVAL 2 HOUR ELSE created END AS shifted FROM v_issues)
UNION ALL
SELECT issue_key, issue_id, 'DOC', summary, CASE WHEN priority <> 'Trivial' THEN description END, issue_type, priority, status, resolution,
  shifted, CASE WHEN issue_type = 'Improvement' THEN updated - INTERVAL 2 HOUR ELSE updated END, issue_id, 1,
  {raw_fields("CASE WHEN priority <> 'Trivial' THEN description END", named_object('status'), named_object('resolution'), sent('updated'))} FROM (
  SELECT *, CASE WHEN issue_type = 'Improvement' THEN created - INTERVAL 2 HOUR ELSE created END AS shifted FROM v_issues)
WHERE status <> 'O'""",
    "v_newest": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY issue_key ORDER BY start_at DESC, position DESC) AS n FROM v_flat) WHERE n = 1""",
    "v_candidates": """
SELECT 'Blocker' AS candidate, issue_key FROM v_issues WHERE priority = 'Blocker' AND issue_type = 'Bug' AND resolution IS NULL
UNION ALL SELECT 'Critical', issue_key FROM v_issues WHERE priority = 'Critical' AND resolution = 'Fixed'
  AND created >= TIMESTAMP '1996-01-01' AND created < TIMESTAMP '1999-01-01'
UNION ALL SELECT 'Major', issue_key FROM v_issues WHERE summary ILIKE '%the%' AND priority = 'Major'
UNION ALL SELECT 'Minor', issue_key FROM v_issues WHERE issue_type = 'Bug'
  AND (regexp_matches(lower(summary), 'on ?the\\b') OR regexp_matches(lower(description), 'ent'))""",
    "v_diff": """
SELECT coalesce(c.qid, s.qid) AS qid, coalesce(c.issue_key, s.issue_key) AS issue_key,
  CASE WHEN s.qid IS NULL THEN 'missing' ELSE 'extra' END AS side
FROM (SELECT q.qid, k.issue_key FROM v_questions q JOIN v_candidates k ON k.candidate = q.pname WHERE q.type = 'filtered') c
FULL OUTER JOIN (SELECT s.qid, s.issue_key FROM v_selected s JOIN v_questions q ON q.qid = s.qid
                 WHERE q.type = 'filtered' AND q.pname <> 'Trivial') s
  ON s.qid = c.qid AND s.issue_key = c.issue_key
WHERE c.qid IS NULL OR s.qid IS NULL""",
}

TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def stamp(column: str) -> str:
    return f"{TIME.format(column)} AS {column}"


MEANS = "round(avg({0}), 6) AS {0}"
MEAN_COLUMNS = ", ".join(MEANS.format(c) for c in ["recall_at_5", "recall_at_10", "mrr"])


def sweep(run: str, hits: str, base: str) -> str:
    """Report of hits(run, qid, rank, issue_key) against the base run's MRR."""
    return f"""
, h AS ({hits}), m AS (
  SELECT w.{run}, q.qid, q.type,
    count(r.issue_key) FILTER (WHERE r.rank < 5)::DOUBLE / count(DISTINCT g.issue_key) AS recall_at_5,
    count(r.issue_key)::DOUBLE / count(DISTINCT g.issue_key) AS recall_at_10, coalesce(1.0::DOUBLE / (min(r.rank) + 1), 0) AS mrr
  FROM v_questions q CROSS JOIN (SELECT DISTINCT {run} FROM h) w JOIN v_gold g ON g.qid = q.qid
  LEFT JOIN h r ON r.{run} = w.{run} AND r.qid = q.qid AND r.issue_key = g.issue_key GROUP BY ALL),
b AS ({base}), c AS (
  SELECT m.{run}, count(*) FILTER (WHERE m.mrr < b.mrr - 1e-9) AS worse, count(*) FILTER (WHERE m.mrr > b.mrr + 1e-9) AS better
  FROM m JOIN b ON b.qid = m.qid GROUP BY m.{run})
SELECT r.*, c.worse, c.better FROM (
  SELECT {run}, CASE WHEN grouping(type) = 1 THEN 'overall' ELSE type END AS scope, count(*) AS n, {MEAN_COLUMNS}
  FROM m GROUP BY GROUPING SETS (({run}), ({run}, type))) r JOIN c ON c.{run} = r.{run}"""


BODIES: dict[str, str] = {
    "vector_topk": "SELECT qid, rank, issue_key, round(score, 6) AS score FROM v_plain",
    "vector_topk_short": "SELECT qid, rank, issue_key, round(score, 6) AS score FROM v_plain_short",
    "vector_truncate_normalize": f"""
SELECT vec_id, len(v) AS dim, round(sqrt(list_inner_product(v::DOUBLE[], v::DOUBLE[])), 5) AS norm,
  round(v[1]::DOUBLE, 5) AS first, round(v[32]::DOUBLE, 5) AS last, len(v) = 32 AS dim_ok
FROM (SELECT vec_id, {short('embedding')} AS v FROM embeddings)""",
    "filtered_vector_topk": "SELECT qid, rank, issue_key, round(distance, 6) AS score FROM v_vec WHERE rank < 10",
    "filter_row_count": "SELECT * FROM v_filter_rows",
    "result_count_check": """
SELECT r.qid, r.filter_row_count, least(10, r.filter_row_count) AS expected, coalesce(g.n, 0) AS actual,
  least(10, r.filter_row_count) = coalesce(g.n, 0) AS ok
FROM v_filter_rows r LEFT JOIN (SELECT qid, count(*) AS n FROM v_vec WHERE rank < 10 GROUP BY qid) g ON g.qid = r.qid""",
    "form_normalize": """
SELECT qid, array_to_string(priority, '|') AS priority, array_to_string(issue_type, '|') AS issue_type, open,
  array_to_string(resolution, '|') AS resolution, created_from, created_to,
  coalesce(array_to_string(text_terms, '|'), '') AS text_terms, parse_error FROM v_forms""",
    "form_guard": """
SELECT qid,
  CASE WHEN type = 'filtered' THEN CASE pname WHEN 'Critical' THEN 'Nonsense' WHEN 'Major' THEN 'Urgent' WHEN 'Minor' THEN 'Unknown' ELSE '' END
       ELSE '' END AS dropped_values,
  CASE WHEN type = 'filtered' THEN CASE pname WHEN 'Blocker' THEN 'Task' WHEN 'Critical' THEN 'Improvement' WHEN 'Trivial' THEN 'Minor' ELSE '' END
       ELSE '' END AS dropped_names FROM v_questions""",
    "form_where_text": f"""
SELECT qid, concat_ws(' AND ',
  CASE WHEN priority IS NOT NULL THEN concat('priority IN (''', priority[1], ''')') END,
  CASE WHEN issue_type IS NOT NULL THEN concat('issue_type IN (''', issue_type[1], ''')') END,
  CASE WHEN open THEN 'resolution IS NULL' WHEN NOT open THEN 'resolution IS NOT NULL' END,
  CASE WHEN len(resolution) = 1 THEN 'resolution IN (''Fixed'')' WHEN len(resolution) = 2 THEN 'resolution IN (''Fixed'', ''Won''''t Fix'')' END,
  CASE WHEN created_from IS NOT NULL THEN concat('created >= ''', created_from, '''') END,
  CASE WHEN created_to IS NOT NULL THEN concat('created < ''', created_to, '''') END) AS where_text, {FILTERED} AS filtered FROM v_forms f""",
    "allowed_values": """
SELECT DISTINCT 'priority' AS field, priority AS value FROM v_issues WHERE priority IS NOT NULL
UNION SELECT DISTINCT 'issue_type', issue_type FROM v_issues WHERE issue_type IS NOT NULL
UNION SELECT DISTINCT 'resolution', resolution FROM v_issues WHERE resolution IS NOT NULL""",
    "single_form_filter": """
SELECT issue_key, resolution FROM v_issues WHERE priority IN ('Blocker') AND issue_type IN ('Bug', 'Question')
  AND resolution IS NOT NULL AND created >= TIMESTAMP '1996-01-01' AND created < TIMESTAMP '2000-01-01'""",
    "lexeme_df": "SELECT word, ndoc FROM v_df",
    "postings": "SELECT lexeme, issue_key, n_a, n_b FROM v_postings",
    "rare_lexemes": "SELECT qid, lexeme, ndoc FROM v_rare",
    "posting_scores": """
SELECT r.qid, p.issue_key, round(sum(p.n_a) * 1.0::DOUBLE + sum(p.n_b) * 0.4::DOUBLE, 6) AS score
FROM v_rare r JOIN v_postings p ON p.lexeme = r.lexeme GROUP BY r.qid, p.issue_key""",
    "index_postings": """
SELECT p.lexeme, p.issue_key, i.priority, i.issue_type, i.resolution, i.created::TIMESTAMP AS created, p.n_a, p.n_b
FROM v_postings p JOIN v_issues i ON i.issue_key = p.issue_key""",
    "index_frequency": "SELECT word, ndoc FROM v_stem_df",
    "stemmed_vocabulary": "SELECT word, stem FROM v_stems WHERE word IN (SELECT word FROM v_df)",
    "stemmed_scores": """
SELECT r.qid, p.issue_key, round(sum(p.n_a) * 1.0::DOUBLE + sum(p.n_b) * 0.4::DOUBLE, 6) AS score
FROM v_stem_rare r JOIN v_stem_postings p ON p.stem = r.stem GROUP BY r.qid, p.issue_key""",
    "keyword_topk": "SELECT qid, rank, issue_key, round(score, 6) AS score FROM v_kw",
    "candidate_lists": """
SELECT qid, 'vec' AS list, rank, issue_key, round(distance, 6) AS score FROM v_vec
UNION ALL SELECT qid, 'kw', rank, issue_key, round(score, 6) FROM v_kw""",
    "hybrid_rrf": "SELECT qid, rank, issue_key, round(score, 8) AS score FROM v_hybrid",
    "rrf_fusion": """
SELECT qid, n - 1 AS rank, issue_key, round(score, 8) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vr NULLS LAST, issue_key) AS n FROM (
    SELECT *, coalesce(1.0::DOUBLE / (61 + vr), 0) + 0.5::DOUBLE * coalesce(1.0::DOUBLE / (61 + kr), 0) AS score FROM v_both)) WHERE n <= 10""",
    "tail_rescue": "SELECT qid, rank, issue_key, round(score, 6) AS score FROM v_rescue1",
    "tail_rescue_two": """
SELECT qid, rank, issue_key, round(distance, 6) AS score FROM v_vec WHERE rank < 8
UNION ALL
SELECT qid, head + n - 1, issue_key, round(CASE WHEN kr IS NOT NULL THEN 1.0::DOUBLE / (60 + kr) END, 6) FROM (
  SELECT b.*, least(h.c, 8) AS head, row_number() OVER (PARTITION BY b.qid ORDER BY (kr IS NULL), kr, vr) AS n
  FROM v_both b LEFT JOIN (SELECT qid, count(*) AS c FROM v_vec GROUP BY qid) h ON h.qid = b.qid
  WHERE vr IS NULL OR vr >= 8) WHERE n <= 2""",
    "overlap_scores": "SELECT qid, issue_key, round(whole_score, 6) AS pair_score FROM v_scores WHERE rank < 20",
    "routed_rerank": "SELECT qid, rank, issue_key, round(score, 8) AS score, route FROM v_routed WHERE depth = 20",
    "stored_score_rerank": f"""
SELECT qid, n - 1 AS rank, issue_key, round(score, 8) AS score, 'rerank' AS route FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vr) AS n FROM (
    SELECT *, 1.0::DOUBLE / (61 + vr) + 1.0::DOUBLE / (60 + rr) AS score FROM (
      SELECT s.qid, s.issue_key, s.rank AS vr, row_number() OVER (PARTITION BY s.qid
        ORDER BY CASE WHEN s.project <> 'src3' THEN s.whole_score ELSE 0 END DESC, s.rank) AS rr
      FROM v_scores s JOIN v_forms f ON f.qid = s.qid WHERE s.rank < 20 AND NOT {FILTERED}))) WHERE n <= 10
UNION ALL SELECT v.qid, v.rank, v.issue_key, round(v.distance, 8), 'filtered'
FROM v_vec v JOIN v_forms f ON f.qid = v.qid WHERE v.rank < 10 AND {FILTERED}""",
    "pure_rerank": """
SELECT qid, n - 1 AS rank, issue_key, round(whole_score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY whole_score DESC, rank) AS n FROM v_scores WHERE rank < 20) WHERE n <= 10""",
    "pure_rerank_sort_all": """
SELECT qid, n - 1 AS rank, issue_key, round(whole_score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY whole_score DESC, rank) AS n FROM v_scores) WHERE n <= 10""",
    "metrics_per_question": """
SELECT strategy, qid, type, round(recall_at_5, 6) AS recall_at_5, round(recall_at_10, 6) AS recall_at_10,
  round(mrr, 6) AS mrr, first_rank FROM v_metrics""",
    "strategy_report": f"""
SELECT strategy, CASE WHEN grouping(type) = 1 THEN 'overall' ELSE type END AS scope, count(*) AS n, {MEAN_COLUMNS}
FROM v_metrics GROUP BY GROUPING SETS ((strategy), (strategy, type))""",
    "overall_means": f"SELECT count(*) AS n, {MEAN_COLUMNS} FROM v_metrics WHERE strategy = 'summary_desc'",
    "compare_runs": """
SELECT qid, type, round(base_recall_at_5, 6) AS base_recall_at_5, round(base_recall_at_10, 6) AS base_recall_at_10,
  round(base_mrr, 6) AS base_mrr, round(recall_at_5, 6) AS recall_at_5, round(recall_at_10, 6) AS recall_at_10,
  round(mrr, 6) AS mrr, base_first_rank, first_rank, verdict, lost_recall FROM v_pair""",
    "comparison_report": """
SELECT CASE WHEN grouping(type) = 1 THEN 'overall' ELSE type END AS scope, count(*) AS n,
  round(avg(base_recall_at_5), 6) AS base_recall_at_5, round(avg(base_recall_at_10), 6) AS base_recall_at_10, round(avg(base_mrr), 6) AS base_mrr,
  round(avg(recall_at_5), 6) AS recall_at_5, round(avg(recall_at_10), 6) AS recall_at_10, round(avg(mrr), 6) AS mrr,
  round(avg(recall_at_5) - avg(base_recall_at_5), 6) AS delta_recall_at_5,
  round(avg(recall_at_10) - avg(base_recall_at_10), 6) AS delta_recall_at_10, round(avg(mrr) - avg(base_mrr), 6) AS delta_mrr,
  count(*) FILTER (WHERE verdict = 'worse') AS worse, count(*) FILTER (WHERE verdict = 'better') AS better,
  count(*) FILTER (WHERE lost_recall) AS lost_recall FROM v_pair GROUP BY GROUPING SETS ((), (type))""",
    "gold_movement": """
SELECT g.qid, g.issue_key, coalesce(v.rank + 1, -1) AS rank_before, coalesce(h.rank + 1, -1) AS rank_after,
  CASE WHEN coalesce(h.rank + 1, -1) > coalesce(v.rank + 1, -1) THEN ' ' ELSE chr(8595) END AS marker
FROM v_gold g LEFT JOIN v_vec v ON v.qid = g.qid AND v.issue_key = g.issue_key
LEFT JOIN v_hybrid h ON h.qid = g.qid AND h.issue_key = g.issue_key""",
    "weight_sweep": sweep("weight", """
SELECT weight, qid, n - 1 AS rank, issue_key FROM (
  SELECT *, row_number() OVER (PARTITION BY weight, qid ORDER BY score DESC, vr NULLS LAST, issue_key) AS n FROM (
    SELECT *, coalesce(1.0::DOUBLE / (60 + vr), 0) + weight * coalesce(1.0::DOUBLE / (60 + kr), 0) AS score
    FROM v_both CROSS JOIN (SELECT unnest([1.0, 0.5, 0.25, 0.1, 0.0]::DOUBLE[]) AS weight))) WHERE n <= 10""",
                          "SELECT qid, mrr FROM m WHERE weight = 0"),
    "depth_sweep": sweep("depth", """
SELECT depth, qid, n - 1 AS rank, issue_key FROM (
  SELECT *, row_number() OVER (PARTITION BY depth, qid ORDER BY whole_score DESC, rank) AS n
  FROM v_scores JOIN (SELECT unnest([20, 30, 50]) AS depth) ON rank < depth) WHERE n <= 10""",
                         "SELECT qid, mrr FROM v_metrics WHERE strategy = 'summary_desc_filtered'"),
    "routed_depth_sweep": "SELECT depth, qid, rank, issue_key, round(score, 8) AS score, route FROM v_routed WHERE depth <> 15",
    "reference_run_check": "SELECT DISTINCT qid, true AS exact, true AS same_set FROM v_vec",
    "plain_run_check": """
SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.keys, []) = coalesce(b.keys, []) AS exact,
  list_sort(coalesce(a.keys, [])) = list_sort(coalesce(b.keys, [])) AS same_set
FROM (SELECT qid, list(issue_key ORDER BY rank) AS keys FROM v_plain GROUP BY qid) a
FULL OUTER JOIN (SELECT qid, list(issue_key ORDER BY rank) AS keys FROM v_vec WHERE rank < 10 GROUP BY qid) b ON a.qid = b.qid""",
    "content_strategies": "SELECT * FROM v_contents",
    "content_report": """
SELECT strategy, count(*) AS rows, count(*) FILTER (WHERE token_count > 8000) AS truncated, sum(token_count)::BIGINT AS chars,
  sum(length(content))::BIGINT AS kept_chars FROM v_contents GROUP BY strategy""",
    "embedding_backlog": "SELECT issue_key, issue_id FROM v_issues WHERE issue_id NOT IN (SELECT vec_id FROM embeddings)",
    "embedding_backlog_first": """
SELECT issue_key, issue_id FROM v_issues WHERE issue_id NOT IN (SELECT vec_id FROM embeddings) ORDER BY issue_id LIMIT 100""",
    "query_prefix": f"""
SELECT qid, concat('{V.QUERY_PREFIX.split(chr(10))[0]}', chr(10), '{V.QUERY_PREFIX.split(chr(10))[1]}', question) AS query_text FROM v_questions""",
    "context_rows": "SELECT * FROM v_context",
    "prompt_text": """
SELECT q.qid, concat('Question: ', q.question, chr(10), chr(10), 'Jira issues:', chr(10), l.body, chr(10), chr(10), 'Answer with citations.') AS prompt,
  l.total AS desc_chars_total
FROM v_questions q JOIN (
  SELECT qid, string_agg(concat(rank, '. [', issue_key, '] issue_key=', issue_key, '; summary=', summary, '; status=', status,
      CASE WHEN resolution IS NOT NULL THEN concat('; resolution=', resolution) ELSE '' END,
      '; priority=', priority, '; issue_type=', issue_type, '; created=', created,
      CASE WHEN description IS NOT NULL THEN concat(chr(10), 'description=', description) ELSE '' END), chr(10) ORDER BY rank) AS body,
    sum(coalesce(length(description), 0))::BIGINT AS total
  FROM v_context GROUP BY qid) l ON l.qid = q.qid""",
    "pair_text_sizes": f"""
SELECT count(*) AS pairs,
  round(avg(len({words('f.question')}) + len({words("concat(coalesce(i.summary, ''), chr(10), substr(coalesce(i.description, ''), 1, 500))")})), 4) AS words_500,
  round(avg(len({words('f.question')}) + len({words("concat(coalesce(i.summary, ''), chr(10), substr(coalesce(i.description, ''), 1, 1000))")})), 4) AS words_1000
FROM v_vec v JOIN v_forms f ON f.qid = v.qid JOIN v_issues i ON i.issue_key = v.issue_key WHERE v.rank < 20""",
    "citation_split": """
SELECT a.qid, coalesce(string_agg(c.key, '|' ORDER BY c.pos), '') AS cited_keys,
  coalesce(string_agg(c.key, '|' ORDER BY c.pos) FILTER (WHERE list_contains(a.keys, c.key)), '') AS citations,
  coalesce(string_agg(c.key, '|' ORDER BY c.pos) FILTER (WHERE NOT list_contains(a.keys, c.key)), '') AS invented_citations
FROM v_answers a LEFT JOIN v_cited c ON c.qid = a.qid GROUP BY a.qid""",
    "citation_classes": "SELECT * FROM v_classes",
    "answer_grades": "SELECT * FROM v_grades",
    "grade_summary": """
SELECT CASE WHEN grouping(type) = 1 THEN 'overall' ELSE type END AS scope, count(*) AS n,
  count(*) FILTER (WHERE hit) AS hit, round(count(*) FILTER (WHERE hit)::DOUBLE / count(*), 3) AS hit_rate,
  count(*) FILTER (WHERE gold_in_context) AS ceiling, count(*) FILTER (WHERE hit AND gold_in_context) AS hit_on_ceiling,
  round(count(*) FILTER (WHERE hit AND gold_in_context)::DOUBLE / nullif(count(*) FILTER (WHERE gold_in_context), 0), 3) AS hit_on_ceiling_rate,
  sum(invented)::BIGINT AS invented_total, sum(from_text)::BIGINT AS from_text_total,
  count(*) FILTER (WHERE no_citation) AS no_citation, round(avg(cite_ratio), 3) AS avg_cite_ratio,
  count(*) FILTER (WHERE cite_ratio = 1.0) AS cited_all, round(avg(seconds), 2) AS avg_seconds,
  round(avg(completion_tokens), 1) AS avg_completion_tokens
FROM v_grades GROUP BY GROUPING SETS ((), (type))""",
    "grade_flags": """
SELECT 'no_citation' AS flag, qid, type FROM v_grades WHERE no_citation
UNION ALL SELECT 'cited_all_contexts', qid, type FROM v_grades WHERE cite_ratio = 1.0
UNION ALL SELECT 'invented', qid, type FROM v_grades WHERE invented > 0
UNION ALL SELECT 'from_text', qid, type FROM v_grades WHERE from_text > 0
UNION ALL SELECT 'missed_ceiling', qid, type FROM v_grades WHERE gold_in_context AND NOT hit""",
    "parse_rows": """
SELECT qid, type, parse_error, date_error, filtered, rows_returned, concat(kept, '/', total) AS gold_kept, rows_returned - kept AS extra_count FROM v_parse""",
    "parse_summary": """
SELECT CASE WHEN grouping(type) = 1 THEN 'overall' ELSE type END AS scope, count(*) AS n,
  count(*) FILTER (WHERE NOT filtered) AS empty_forms, count(*) FILTER (WHERE kept < total) AS dropped_gold,
  count(*) FILTER (WHERE parse_error) AS parse_errors FROM v_parse GROUP BY GROUPING SETS ((), (type))""",
    "gold_kept": """
SELECT g.qid, g.issue_key, s.issue_key IS NOT NULL AS kept
FROM v_gold g LEFT JOIN v_selected s ON s.qid = g.qid AND s.issue_key = g.issue_key""",
    "extra_keys": """
SELECT qid, n - 1 AS rank, issue_key FROM (
  SELECT s.qid, s.issue_key, row_number() OVER (PARTITION BY s.qid ORDER BY s.issue_id) AS n
  FROM v_selected s WHERE NOT EXISTS (SELECT 1 FROM v_gold g WHERE g.qid = s.qid AND g.issue_key = s.issue_key)) WHERE n <= 20""",
    "candidate_diff": "SELECT qid, issue_key, side FROM v_diff",
    "exact_matches": """
SELECT q.qid, q.pname AS candidate, count(d.qid) FILTER (WHERE side = 'missing') AS missing, count(d.qid) FILTER (WHERE side = 'extra') AS extra,
  count(d.qid) = 0 AS exact
FROM v_questions q LEFT JOIN v_diff d ON d.qid = q.qid WHERE q.type = 'filtered' AND q.pname <> 'Trivial' GROUP BY q.qid, q.pname""",
    "candidate_rows": "SELECT candidate AS name, count(*) AS candidate_rows FROM v_candidates GROUP BY candidate",
    "score_agreement": """
, r AS (SELECT s500 AS a, s1000 AS b,
    rank() OVER (ORDER BY s500) + (count(*) OVER (PARTITION BY s500) - 1) / 2.0::DOUBLE AS ra,
    rank() OVER (ORDER BY s1000) + (count(*) OVER (PARTITION BY s1000) - 1) / 2.0::DOUBLE AS rb FROM v_scores)
SELECT count(*) AS pairs, round(corr(ra, rb), 6) AS spearman, round(max(abs(a - b)), 6) AS max_abs_diff,
  round(avg(abs(a - b)), 6) AS mean_abs_diff, count(*) FILTER (WHERE abs(a - b) > 1e-6) AS differing FROM r""",
    "average_ranks": """
SELECT DISTINCT length(summary)::DOUBLE AS size,
  rank() OVER (ORDER BY length(summary)) + (count(*) OVER (PARTITION BY length(summary)) - 1) / 2.0::DOUBLE AS avg_rank FROM v_issues""",
    "top10_agreement": """
, l AS (SELECT qid, list(issue_key ORDER BY s500 DESC, rank)[1:10] AS a, list(issue_key ORDER BY s1000 DESC, rank)[1:10] AS b
        FROM v_scores GROUP BY qid)
SELECT count(*) AS questions, count(*) FILTER (WHERE a = b) AS exact FROM l""",
    "issue_flatten": f"""
SELECT issue_key, issue_id, project, summary, description, issue_type, priority, status, resolution, {stamp('created')},
  {stamp('updated')}, {TIME.format('updated')} AS resolutiondate, false AS date_suspect, start_at, position, raw FROM v_flat""",
    "issue_upsert": f"""
SELECT n.issue_key, n.issue_id, CASE WHEN t.issue_key IS NOT NULL THEN 'archive' ELSE n.project END AS project, n.summary, n.description,
  CASE WHEN t.issue_key IS NOT NULL THEN lower(n.issue_type) ELSE n.issue_type END AS issue_type, n.priority, n.status, n.resolution,
  {TIME.format('CASE WHEN t.issue_key IS NOT NULL THEN t.created ELSE n.created END')} AS created,
  {TIME.format('n.updated')} AS updated, {TIME.format('n.updated')} AS resolutiondate, n.raw
FROM v_newest n LEFT JOIN (SELECT * FROM v_issues WHERE created < TIMESTAMP '1999-01-01') t ON t.issue_key = n.issue_key""",
    "stream_ingest": f"""
SELECT n.issue_key, n.issue_id, CASE WHEN t.issue_key IS NOT NULL THEN 'archive' ELSE n.project END AS project, n.summary, n.description,
  CASE WHEN t.issue_key IS NOT NULL THEN lower(n.issue_type) ELSE n.issue_type END AS issue_type, n.priority, n.status, n.resolution,
  {TIME.format('CASE WHEN t.issue_key IS NOT NULL THEN t.created ELSE n.created END')} AS created,
  {TIME.format('n.updated')} AS updated, {TIME.format('n.updated')} AS resolutiondate, n.raw
FROM v_newest n LEFT JOIN (SELECT * FROM v_issues WHERE created < TIMESTAMP '1999-01-01') t ON t.issue_key = n.issue_key""",
    "stream_embed": f"""
SELECT issue_key, 'summary_desc' AS strategy, 0 AS chunk_index, content, length(content) AS token_count, 32 AS dim FROM (
  SELECT n.issue_key, CASE WHEN t.issue_key IS NOT NULL AND t.description IS NULL THEN lower(t.summary)
    WHEN t.issue_key IS NOT NULL THEN concat(lower(t.summary), chr(10), chr(10), t.description)
    WHEN n.description IS NULL THEN n.summary ELSE concat(n.summary, chr(10), chr(10), n.description) END AS content
  FROM v_newest n LEFT JOIN (SELECT * FROM v_issues WHERE created < TIMESTAMP '1999-01-01') t ON t.issue_key = n.issue_key)""",
    "chunk_upsert": """
SELECT c.issue_key, c.strategy, c.chunk_index,
  CASE WHEN i.status <> 'O' THEN c.content ELSE w.whole END AS content,
  CASE WHEN i.status <> 'O' THEN c.token_count ELSE length(w.whole) END AS token_count
FROM v_whole_contents c JOIN v_issues i ON i.issue_key = c.issue_key
JOIN (SELECT issue_key, s.strategy, CASE WHEN s.strategy = 'summary_only' OR description IS NULL THEN lower(summary)
        ELSE concat(lower(summary), chr(10), chr(10), description) END AS whole
      FROM v_issues CROSS JOIN (SELECT unnest(['summary_only', 'summary_desc']) AS strategy) s) w
  ON w.issue_key = c.issue_key AND w.strategy = c.strategy
WHERE i.status <> 'O' OR i.created < TIMESTAMP '1999-01-01'""",
    "token_budget_batches": f"""
RECURSIVE, sized AS MATERIALIZED (SELECT issue_key, token_count AS size, row_number() OVER (ORDER BY token_count, issue_key) AS n
  FROM v_whole_contents WHERE strategy = 'summary_desc'),
filled AS (SELECT n, 0 AS batch, 1 AS held FROM sized WHERE n = 1
  UNION ALL SELECT s.n, CASE WHEN (held + 1) * s.size <= {V.MAX_BATCH_TOKENS} THEN batch ELSE batch + 1 END,
    CASE WHEN (held + 1) * s.size <= {V.MAX_BATCH_TOKENS} THEN held + 1 ELSE 1 END FROM filled f JOIN sized s ON s.n = f.n + 1)
SELECT issue_key, size, batch FROM filled JOIN sized USING (n)""",
    "project_counts": "SELECT project, count(*) AS n FROM v_issues GROUP BY project",
    "project_oldest": "SELECT issue_key, issue_id FROM v_issues WHERE project = 'src7' ORDER BY created, issue_key LIMIT 25",
    "md5_sample": "SELECT issue_key FROM v_issues ORDER BY md5(issue_key), issue_key LIMIT 50",
    "duplicate_keys": "SELECT issue_key, count(*) AS n FROM v_flat GROUP BY issue_key HAVING count(*) > 1",
    "orphan_chunks": """
SELECT issue_key, strategy FROM v_chunks WHERE issue_key NOT IN (SELECT issue_key FROM v_issues WHERE priority <> 'Minor')""",
    "cascade_delete": """
SELECT issue_key, strategy FROM v_chunks WHERE issue_key NOT IN (SELECT issue_key FROM v_issues WHERE resolution = 'Fixed')""",
    "null_counts": "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM v_issues"
        for c in ["issue_key", "issue_id", "project", "summary", "description", "issue_type", "priority",
                  "status", "resolution", "created", "updated", "resolutiondate"]),
    "wrong_dimension": "SELECT issue_key, strategy FROM v_chunks WHERE len(embedding) <> 32",
    "parse_cache_fingerprint": """
, r AS (SELECT qid, CASE WHEN type = 'topic' AND pname = 'Trivial' THEN 'No filter is stated.'
  WHEN type <> 'filtered' THEN '{"priority":null,"issue_type":null,"open":null,"resolution":null,"created_from":null,"created_to":null,"text_terms":[]}'
  WHEN pname = 'Blocker' THEN concat('```json', chr(10), '{"priority":["Blocker"],"issue_type":["Bug","Task"],"open":true,"resolution":null,"created_from":null,"created_to":null,"text_terms":["parser"]}', chr(10), '```')
  WHEN pname = 'Critical' THEN concat('{"priority":"Critical","issue_type":"Improvement","open":null,"resolution":["Fixed","Nonsense"],"created_from":"', y, '-01-01","created_to":"', y + 2, '-01-01","text_terms":"scan"}')
  WHEN pname = 'Major' THEN concat('```', chr(10), '{"priority":["Major","Urgent"],"issue_type":[],"open":false,"created_from":"', y, '-01-01"}', chr(10), '```')
  WHEN pname = 'Minor' THEN concat('{"issue_type":["Bug"],"priority":["Unknown"],"resolution":["Fixed","Won''t Fix"],"issuetype":"x","created_to":"', y + 2, '-01-01T12:00:00"}')
  ELSE '{"priority":["Trivial","Minor"],"issue_type":null,"open":null,"created_from":"last year","text_terms":[]}' END AS response FROM v_questions)
SELECT qid, sha256(concat(sha256(response), '|m1')) AS fingerprint, response = 'No filter is stated.' AS valid FROM r""",
    "uncached_questions": f"""
SELECT qid FROM v_questions WHERE question NOT IN (SELECT question FROM v_forms f WHERE {FILTERED} AND NOT parse_error)""",
    "score_backlog": f"SELECT f.qid FROM v_forms f WHERE {FILTERED}",
    "request_validation": """
SELECT d.doc_id, coalesce(CASE l.quality WHEN 0 THEN 51 WHEN 1 THEN NULL ELSE 20 END, 10) AS k,
  length(d.text) BETWEEN 3 AND 500 AND coalesce(CASE l.quality WHEN 0 THEN 51 WHEN 1 THEN NULL ELSE 20 END, 10) BETWEEN 1 AND 50 AS valid
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "hashed_embedding": f"""
, steps AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
w AS (SELECT issue_key, unnest({words("concat(coalesce(summary, ''), chr(10), coalesce(description, ''))")}) AS word FROM v_issues),
codes AS (SELECT word, xor(list_reduce(list_transform(range(length(hex(word)) // 2),
    lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS code
  FROM (SELECT DISTINCT word FROM w) CROSS JOIN steps),
cells AS (SELECT issue_key, code % 64 AS cell, sum(CASE WHEN code >> 31 & 1 = 1 THEN -1 ELSE 1 END)::DOUBLE AS v
  FROM w JOIN codes USING (word) GROUP BY ALL),
sums AS (SELECT issue_key, sqrt(sum(v * v)) AS n, coalesce(max(v) FILTER (WHERE cell = 0), 0) AS a,
  coalesce(max(v) FILTER (WHERE cell = 63), 0) AS b, count(*) FILTER (WHERE v <> 0) AS filled FROM cells GROUP BY issue_key)
SELECT i.issue_key, 'summary_desc' AS strategy, 64 AS dim, CASE WHEN s.n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm,
  CASE WHEN s.n > 0 THEN round((s.a / s.n)::FLOAT::DOUBLE, 4) ELSE 0.0::DOUBLE END AS first,
  CASE WHEN s.n > 0 THEN round((s.b / s.n)::FLOAT::DOUBLE, 4) ELSE 0.0::DOUBLE END AS last, coalesce(s.filled, 0) AS filled
FROM v_issues i LEFT JOIN sums s ON s.issue_key = i.issue_key""",
    "gold_jsonl_scan": """
, g AS (SELECT qid, string_agg(issue_key, '|' ORDER BY issue_key) AS expected FROM v_gold GROUP BY qid)
SELECT CASE WHEN q.type <> 'filtered' THEN concat('Q', q.qid) END AS id, CASE WHEN q.type <> 'filtered' THEN q.type END AS type,
  CASE WHEN q.type <> 'filtered' THEN q.question END AS question, CASE WHEN q.type <> 'filtered' THEN g.expected END AS expected,
  CASE WHEN q.type = 'filtered' THEN concat('{"id":"Q', q.qid, '","expected":["') END AS corrupt
FROM v_questions q JOIN g ON g.qid = q.qid""",
    "parse_cache_roundtrip": """
SELECT 'p1' AS parser, qid, array_to_string(priority, '|') AS priority, open, created_from, parse_error FROM v_forms
UNION ALL SELECT 'p2', qid, NULL, NULL, NULL, NULL FROM v_forms""",
    "answers_scan": """
SELECT a.qid, coalesce(c.cited, '') AS cited_keys, array_to_string(a.keys, '|') AS context_keys, length(q.question) / 100.0::DOUBLE AS seconds
FROM v_answers a JOIN v_questions q ON q.qid = a.qid
LEFT JOIN (SELECT qid, string_agg(key, '|' ORDER BY pos) AS cited FROM v_cited GROUP BY qid) c ON c.qid = a.qid""",
    "scores_scan": """
SELECT qid, issue_key, round(whole_score, 6) AS pair_score FROM v_scores WHERE rank < 10""",
    "score_cache_resume": "SELECT qid, count(*) AS pairs, count(DISTINCT issue_key) AS issues FROM v_scores GROUP BY qid",
    "write_once_and_suffix": """
SELECT CASE type WHEN 'lookup' THEN 'types' WHEN 'topic' THEN 'types_2' ELSE 'types_3' END AS target, qid, type, true AS refused FROM v_questions""",
    "stats_rebuild": "SELECT word, ndoc FROM v_stem_df WHERE ndoc > 1",
    "run_stamp": "SELECT qid, rank, issue_key, 'r1' AS run, 'm1' AS model, 10 AS k, 'summary_desc' AS strategy FROM v_plain",
    "missing_gold": "SELECT qid FROM v_questions WHERE type <> 'topic'",
    "stage_means": """
SELECT round(avg(s / 8), 6) AS parse, round(avg(s / 16), 6) AS embed, round(avg(s / 8 + 1), 6) AS vector,
  round(avg(s / 2) FILTER (WHERE type <> 'filtered'), 6) AS rerank, round(avg(s), 6) AS total, round(avg(s / 16 + 1), 6) AS sql
FROM (SELECT type, length(question)::DOUBLE AS s FROM v_questions)""",
    "throughput": """
, c AS (SELECT length(coalesce(summary, '')) + coalesce(length(description) + 2, 0) AS n FROM v_issues)
SELECT count(*) AS rows, count(*) FILTER (WHERE n > 500) AS truncated, round(sum(n) / 1024.0::DOUBLE, 6) AS seconds,
  round(count(*) / (sum(n) / 1024.0::DOUBLE), 8) AS rows_per_second FROM c""",
}


def _needed(body: str, found: list[str]) -> list[str]:
    for name in re.findall(r"\bv_\w+", body):
        if name in VIEWS and name not in found:
            _needed(VIEWS[name], found)
            if name not in found:
                found.append(name)
    return found


def statement(name: str) -> str:
    """WITH the views the body mentions; a body that starts with a comma adds its own."""
    body = BODIES[name].strip()
    views = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in _needed(body, []))
    if not views:
        return body
    if body.startswith("RECURSIVE"):
        return f"WITH RECURSIVE {views}\n{body.removeprefix('RECURSIVE')}"
    return f"WITH {views}\n{body}"


def statements() -> dict[str, str]:
    return {name: statement(name) for name in BODIES}
