"""Structured filter forms: normalising raw responses, predicates, and matching at scale."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import values as V
from lodestone.functions import text
from lodestone.session import cut_lineage

FILTER_COLUMNS = ["priority", "issue_type", "open", "resolution", "created_from", "created_to"]
FACETS = ["priority", "issue_type", "resolution"]


# --- normalising raw parser responses -------------------------------------------

def normalize_forms(responses: DataFrame) -> DataFrame:
    """``(qid, question, response)`` -> the same rows with the form columns.

    A response that is not a JSON object, or whose list fields cannot be read,
    gives the empty form with ``parse_error``.
    """
    fields = ["priority", "issue_type", "resolution", "text_terms"]
    plain = ["open", "created_from", "created_to"]
    given = responses.columns
    parsed = responses.withColumn("_v", F.try_parse_json(text.strip_fence(F.col("response"))))
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    split = settle(parsed, given, {
        "_object": is_object,
        **{f"_{n}": F.when(is_object, F.try_variant_get("_v", f"$.{n}", "variant")) for n in [*fields, *plain]}})
    bad = reduce(lambda a, b: a | b, (_unreadable(F.col(f"_{n}")) for n in fields[:3]))
    failed = ~F.col("_object") | bad

    def usable(value: Column) -> Column:
        return F.when(~failed, value)

    shaped = settle(split, given, {
        "parse_error": failed,
        **{n: usable(_as_list(F.col(f"_{n}"))) for n in fields[:3]},
        "open": usable(F.when(_kind("_open") == "BOOLEAN", F.try_variant_get("_open", "$", "boolean"))),
        **{n: usable(F.when(_kind(f"_{n}") == "STRING", F.nullif(F.try_variant_get(f"_{n}", "$", "string"), F.lit(""))))
           for n in plain[1:]},
        "text_terms": F.coalesce(usable(_as_list(F.col("_text_terms"))), F.array().cast("array<string>"))})
    return guard_names(keep_allowed(shaped)).select(
        *given, "priority", "issue_type", "open", "resolution",
        "created_from", "created_to", "text_terms", "parse_error", "dropped_values", "dropped_names")


def settle(rows: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """Select ``columns`` behind a generator, so later steps read values and do not repeat expressions.

    Without it Catalyst merges the steps (or pushes a filter through them) and the
    nested CASE trees multiply.
    """
    made = F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return rows.select(*keep, made)


def _kind(name: str) -> Column:
    return F.schema_of_variant(name)


def _as_list(item: Column) -> Column:
    """A bare string becomes a one-element list, an empty list becomes NULL."""
    kind = F.schema_of_variant(item)
    listed = F.try_variant_get(item, "$", "array<string>")
    return (F.when(kind == "STRING", F.array(F.try_variant_get(item, "$", "string")))
            .when(kind.startswith("ARRAY") & (F.size(listed) > 0), listed))


def _unreadable(item: Column) -> Column:
    """A non-zero number or ``true`` where a list belongs cannot be iterated."""
    kind = F.schema_of_variant(item)
    scalar = ~(kind.startswith("ARRAY") | kind.startswith("OBJECT") | kind.isin("STRING", "VOID"))
    zero = F.try_variant_get(item, "$", "string").isin("0", "0.0", "false")
    return F.coalesce(scalar & ~zero, F.lit(False))


def _inside(allowed: list[str]):
    return lambda x: x.isin(allowed)


def _outside(allowed: list[str]):
    return lambda x: ~x.isin(allowed)


def keep_allowed(forms: DataFrame) -> DataFrame:
    """Drop list values outside the vocabulary; an emptied list becomes NULL."""
    vocabulary = {"priority": V.PRIORITIES, "issue_type": V.ISSUE_TYPES, "resolution": V.RESOLUTIONS}
    dropped = [F.filter(F.coalesce(F.col(n), F.array().cast("array<string>")), _outside(a))
               for n, a in vocabulary.items()]
    kept = {n: _non_empty(F.filter(F.col(n), _inside(a))) for n, a in vocabulary.items()}
    others = [c for c in forms.columns if c not in vocabulary]
    return settle(forms, others, {"dropped_values": F.concat(*dropped), **kept})


def guard_names(forms: DataFrame) -> DataFrame:
    """Keep a priority or issue type only if the question names it."""
    question = F.col("question")
    guarded, dropped = {}, []
    for name in ["priority", "issue_type"]:
        listed = F.coalesce(F.col(name), F.array().cast("array<string>"))
        guarded[name] = _non_empty(F.filter(F.col(name), lambda x: text.named_in(question, x)))
        dropped.append(F.filter(listed, lambda x: ~text.named_in(question, x)))
    others = [c for c in forms.columns if c not in guarded]
    return settle(forms, others, {"dropped_names": F.concat(*dropped), **guarded})


def _non_empty(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)


def allowed_values(issues: DataFrame) -> DataFrame:
    """Distinct values of each filter column, as ``(field, value)``."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in FACETS)))
    return issues.select(pairs.alias("p")).select("p.*").where("value IS NOT NULL").distinct()


# --- predicates -------------------------------------------------------------------

def has_filter(prefix: str = "") -> Column:
    """True if any filtering field of the form is set (text terms never filter)."""
    return reduce(lambda a, b: a | b, (F.col(prefix + n).isNotNull() for n in FILTER_COLUMNS))


def date_error(prefix: str = "") -> Column:
    """True if a created bound is no time: the form cannot be run, which is not the same as selecting nothing."""
    bounds = [F.col(prefix + n) for n in ("created_from", "created_to")]
    return reduce(lambda a, b: a | b, (c.isNotNull() & text.bound_time(c).isNull() for c in bounds))


def form_condition(issue: str = "i.", form: str = "f.") -> Column:
    """Does the issue of this row satisfy the form of this row?  A bound that is no time selects nothing."""
    f, i = (lambda n: F.col(form + n)), (lambda n: F.col(issue + n))

    def listed(name: str) -> Column:
        return f(name).isNull() | F.coalesce(F.array_contains(f(name), i(name)), F.lit(False))

    return (listed("priority") & listed("issue_type") & listed("resolution")
            & (f("open").isNull() | (f("open") == i("resolution").isNull()))
            & (f("created_from").isNull() | F.coalesce(i("created") >= text.bound_time(f("created_from")), F.lit(False)))
            & (f("created_to").isNull() | F.coalesce(i("created") < text.bound_time(f("created_to")), F.lit(False))))


def where_form(issues: DataFrame, form: dict) -> DataFrame:
    """Filter issues by one form given as a dict: literal predicates that reach the scan.  A bound that is no time selects nothing."""
    for name in FACETS:
        allowed = form.get(name)
        if allowed:
            issues = issues.where(F.col(name).isin([allowed] if isinstance(allowed, str) else allowed))
    if form.get("open") is not None:
        unresolved = F.col("resolution").isNull()
        issues = issues.where(unresolved if form["open"] else ~unresolved)
    if form.get("created_from"):
        issues = issues.where(F.col("created") >= text.bound_time(F.lit(form["created_from"])))
    if form.get("created_to"):
        issues = issues.where(F.col("created") < text.bound_time(F.lit(form["created_to"])))
    return issues


def where_text(form: str = "") -> Column:
    """Readable WHERE text of a form ("" when it filters nothing)."""
    def quoted(name: str) -> Column:
        inner = F.transform(F.col(form + name), lambda x: F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'")))
        return F.concat(F.lit(f"{name} IN ("), F.array_join(inner, ", "), F.lit(")"))

    return F.concat_ws(
        " AND ",
        F.when(F.col(form + "priority").isNotNull(), quoted("priority")),
        F.when(F.col(form + "issue_type").isNotNull(), quoted("issue_type")),
        F.when(F.col(form + "open"), F.lit("resolution IS NULL"))
        .when(~F.col(form + "open"), F.lit("resolution IS NOT NULL")),
        F.when(F.col(form + "resolution").isNotNull(), quoted("resolution")),
        F.concat(F.lit("created >= '"), F.col(form + "created_from"), F.lit("'")),
        F.concat(F.lit("created < '"), F.col(form + "created_to"), F.lit("'")))


# --- matching a table of forms with a table of issues ------------------------------

def with_form_id(questions: DataFrame) -> DataFrame:
    """Questions that filter alike share a ``form_id``."""
    sorted_lists = [F.array_sort(F.col(n)).alias(n) for n in FACETS]
    image = F.to_json(F.struct(*sorted_lists, "open", "created_from", "created_to"),
                      {"ignoreNullFields": "false"})
    return questions.withColumn("form_id", F.xxhash64(image))


def _distinct_forms(questions: DataFrame) -> DataFrame:
    return questions.select("form_id", *FILTER_COLUMNS).dropDuplicates(["form_id"])


def _form_keys(forms: DataFrame) -> DataFrame:
    """One row per combination of accepted facet values; '*' accepts any value.

    Every form becomes equality keys, so matching is a hash join and not a theta join.
    """
    def accepted(name: str) -> Column:
        return F.coalesce(F.transform(F.col(name), lambda x: F.concat(F.lit("="), x)), F.array(F.lit("*")))

    resolution = (
        F.when(F.col("resolution").isNotNull() & F.coalesce(F.col("open"), F.lit(False)),
               F.array().cast("array<string>"))
        .when(F.col("resolution").isNotNull(), accepted("resolution"))
        .when(F.col("open"), F.array(F.lit("null")))
        .when(~F.col("open"), F.array(F.lit("set")))
        .otherwise(F.array(F.lit("*"))))
    since, until = text.bound_time(F.col("created_from")), text.bound_time(F.col("created_to"))
    return (forms.where(~date_error()).select("form_id", since.alias("since"), until.alias("until"),
                         F.explode(F.array_distinct(accepted("priority"))).alias("kp"),
                         "issue_type", "resolution", "open")
            .withColumn("kt", F.explode(F.array_distinct(accepted("issue_type"))))
            .withColumn("kr", F.explode(F.array_distinct(resolution)))
            .select("form_id", "since", "until", "kp", "kt", "kr"))


def _facet_keys(facets: DataFrame) -> DataFrame:
    """The equality keys under which a facet combination may be accepted."""
    def offered(name: str) -> Column:
        return F.array_compact(F.array(F.lit("*"), F.concat(F.lit("="), F.col(name))))

    resolution = F.array_compact(F.array(
        F.lit("*"), F.when(F.col("resolution").isNull(), "null").otherwise("set"),
        F.concat(F.lit("="), F.col("resolution"))))
    return (facets.withColumn("kp", F.explode(offered("priority")))
            .withColumn("kt", F.explode(offered("issue_type")))
            .withColumn("kr", F.explode(resolution)))


def match_forms(issues: DataFrame, questions: DataFrame, *keep: str) -> DataFrame:
    """``(issue_key, *keep, form_ids)``: the distinct forms each issue satisfies.

    Facet combinations are few whatever the number of issues, so forms are matched
    with the combinations first; an issue then only looks its combination up and
    checks the created window.  Issues that satisfy no form are dropped.
    """
    facets = issues.select(*FACETS).distinct()
    accepted = (_facet_keys(facets).join(_form_keys(_distinct_forms(questions)), ["kp", "kt", "kr"])
                .groupBy(*FACETS)
                .agg(F.collect_list(F.struct("form_id", "since", "until")).alias("_forms")))
    # Costs a pass over the facet columns and stays small: kept, so Spark knows its bytes when it plans the join.
    accepted = cut_lineage(accepted).alias("a")
    i = issues.select("issue_key", *FACETS, "created", *(c for c in keep)).alias("i")
    same = reduce(lambda x, y: x & y, (F.col("i." + n).eqNullSafe(F.col("a." + n)) for n in FACETS))
    open_window = F.filter("_forms", lambda f: (f.since.isNull() | (F.col("i.created") >= f.since))
                           & (f.until.isNull() | (F.col("i.created") < f.until)))
    return (i.join(accepted, same)
            .select("i.issue_key", *(F.col("i." + c) for c in keep),
                    F.transform(open_window, lambda f: f.form_id).alias("form_ids"))
            .where(F.size("form_ids") > 0))


def filter_row_count(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """``(qid, filter_row_count)`` over ``rows`` that carry the issue columns.

    Rows are counted per facet combination and time before any form is looked at.
    """
    asked = with_form_id(questions)
    counted = (rows.groupBy(*FACETS, "created").agg(F.count("*").alias("n")))
    matches = (_facet_keys(counted).join(_form_keys(_distinct_forms(asked)), ["kp", "kt", "kr"])
               .where((F.col("since").isNull() | (F.col("created") >= F.col("since")))
                      & (F.col("until").isNull() | (F.col("created") < F.col("until"))))
               .groupBy("form_id").agg(F.sum("n").alias("n")))
    return (asked.select("qid", "form_id").join(matches, "form_id", "left")
            .select("qid", F.coalesce("n", F.lit(0)).cast("long").alias("filter_row_count")))
