"""English (Porter2) stems of a vocabulary, as column expressions on the JVM.

Stemming works on distinct words, so its cost follows the vocabulary and not the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.forms import settle

# --- fixed values: rules of the published Porter2 stemmer, longest suffix first -------
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURAL = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
DERIVED = {  # step 2, inside the first region
    "ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble",
    "lessli": "less", "tional": "tion", "alism": "al", "aliti": "al", "ation": "ate", "entli": "ent", "fulli": "ful",
    "iviti": "ive", "ousli": "ous", "abli": "able", "alli": "al", "anci": "ance", "ator": "ate", "enci": "ence",
    "izer": "ize", "bli": "ble", "ogi": "og", "li": "",
}
FURTHER = {  # step 3, inside the first region ("ative" inside the second)
    "ational": "ate", "tional": "tion", "alize": "al", "ative": "", "icate": "ic", "iciti": "ic", "ical": "ic",
    "ness": "", "ful": "",
}
ENDINGS = ["ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize",
           "ous", "al", "er", "ic"]  # step 4, deleted inside the second region

VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
SHORT = rf"(^{VOWEL}{OTHER}|{OTHER}{VOWEL}[^aeiouywxY])$"


def _cut(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.char_length(word) - n)


def _suffix_step(word: Column, rules: dict[str, str], allowed) -> Column:
    """The longest matching suffix decides; it is replaced only where ``allowed`` holds."""
    step = F
    for suffix, new in rules.items():
        step = step.when(word.endswith(suffix), F.when(
            allowed(suffix), F.concat(_cut(word, len(suffix)), F.lit(new))).otherwise(word))
    return step.otherwise(word)


def stem_words(vocabulary: DataFrame) -> DataFrame:
    """``(word)`` -> ``(word, stem)``."""
    w, keep = F.col("w"), ["word", "fixed", "p1", "p2"]

    def region(name: str):
        return lambda suffix: F.char_length(w) - len(suffix) >= F.col(name)

    irregular = F
    for form, stem in IRREGULAR.items():
        irregular = irregular.when(F.col("word") == form, F.lit(stem))
    rows = vocabulary.select("word").select("word", irregular.when(F.char_length("word") <= 2, F.col("word")).alias("fixed"),
                                            F.regexp_replace("word", r"(^|[aeiouy])y", "$1Y").alias("w"))
    opening = F.char_length(F.regexp_extract("w", rf"^(gener|commun|arsen|.*?{VOWEL}{OTHER})", 1))
    rows = settle(rows, ["word", "fixed", "w"], {"p1": F.when(opening > 0, opening).otherwise(F.char_length("w"))})
    second = F.char_length(F.regexp_extract(F.substring(w, F.col("p1") + 1, F.char_length("w")), rf"^(.*?{VOWEL}{OTHER})", 1))
    rows = settle(rows, ["word", "fixed", "w", "p1"], {
        "p2": F.when(second > 0, F.col("p1") + second).otherwise(F.char_length("w"))})

    def step(made: DataFrame, value: Column) -> DataFrame:
        return settle(made, keep, {"w": value})

    # Plurals.
    rows = step(rows, F.when(w.endswith("sses"), _cut(w, 2))
                .when(w.rlike("(ied|ies)$"), F.when(F.char_length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1)))
                .when(w.rlike("(us|ss)$"), w)
                .when(w.endswith("s") & w.rlike(rf"{VOWEL}.+s$"), _cut(w, 1)).otherwise(w))
    rows = rows.withColumn("fixed", F.coalesce("fixed", F.when(w.isin(KEPT_AFTER_PLURAL), w)))
    # Past and progressive forms.
    bare = F.when(w.rlike(rf"{VOWEL}.*(ed|edly|ing|ingly)$"), F.regexp_replace(w, "(edly|ingly|ed|ing)$", ""))
    rows = settle(rows, [*keep, "w"], {
        "bare": F.when(w.rlike("(eed|eedly)$"), F.lit(None)).otherwise(bare)})
    b = F.col("bare")
    restored = (F.when(b.rlike("(at|bl|iz)$"), F.concat(b, F.lit("e")))
                .when(b.rlike(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _cut(b, 1))
                .when(b.rlike(SHORT) & (F.col("p1") >= F.char_length(b)), F.concat(b, F.lit("e"))).otherwise(b))
    rows = step(rows, F.when(w.endswith("eedly"), F.when(region("p1")("eedly"), _cut(w, 3)).otherwise(w))
                .when(w.endswith("eed"), F.when(region("p1")("eed"), _cut(w, 1)).otherwise(w))
                .when(b.isNotNull(), restored).otherwise(w))
    rows = step(rows, F.when(w.rlike(rf".{OTHER}[yY]$"), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w))

    def derived(suffix: str) -> Column:
        before = {"ogi": "logi$", "li": "[cdeghkmnrt]li$"}.get(suffix)
        return region("p1")(suffix) & (w.rlike(before) if before else F.lit(True))

    rows = step(rows, _suffix_step(w, DERIVED, derived))
    rows = step(rows, _suffix_step(w, FURTHER, lambda s: region("p2" if s == "ative" else "p1")(s)))
    rows = step(rows, _suffix_step(w, dict.fromkeys(ENDINGS, ""), lambda s: region("p2")(s) & (
        w.rlike("[st]ion$") if s == "ion" else F.lit(True))))
    last = F.char_length(w) - 1
    drop_e = w.endswith("e") & ((last >= F.col("p2")) | ((last >= F.col("p1")) & ~_cut(w, 1).rlike(SHORT)))
    rows = step(rows, F.when(drop_e | (w.endswith("ll") & (last >= F.col("p2"))), _cut(w, 1)).otherwise(w))
    return rows.select("word", F.coalesce("fixed", F.replace(w, F.lit("Y"), F.lit("y"))).alias("stem"))


def stem_postings(postings: DataFrame) -> DataFrame:
    """Posting table with stems as lexemes; forms of one stem add up per issue."""
    stems = stem_words(postings.select(F.col("lexeme").alias("word")).distinct())
    return (postings.join(stems, F.col("lexeme") == F.col("word"))
            .groupBy(F.col("stem").alias("lexeme"), "issue_key")
            .agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b")))


def stem_lexemes(lexemes: DataFrame) -> DataFrame:
    """Distinct stems of ``(qid, lexeme)``."""
    stems = stem_words(lexemes.select(F.col("lexeme").alias("word")).distinct())
    return lexemes.join(stems, F.col("lexeme") == F.col("word")).select("qid", F.col("stem").alias("lexeme")).distinct()
