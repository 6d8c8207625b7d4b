from pyspark.sql import functions as F

from lodestone.functions.stem import stem_lexemes, stem_postings, stem_words

# Pairs of the published sample vocabulary.
SAMPLES = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist
consistency consist consistent consist consistently consist consisting consist consists consist consolation consol
consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid
consolidated consolid consoling consol consols consol consonant conson consort consort consorting consort
conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir
conspire conspir constable constabl constables constabl constancy constanc constant constant
knack knack knackeries knackeri knag knag knave knave knavery knaveri knavish knavish kneaded knead kneading knead
knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew
knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit
knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker
knocking knock knocks knock knopp knopp knot knot knots knot
gas gas gaps gap kiwis kiwi ties tie cries cri happily happili dying die skies sky news news proceed proceed
hoping hope hopping hop agreed agre feed feed generate generat general general communication communic
hopefulness hope national nation conditional condit sky sky by by say say cry cri
""".split()


def test_published_samples(spark):
    want = dict(zip(SAMPLES[::2], SAMPLES[1::2]))
    got = {r.word: r.stem for r in stem_words(spark.createDataFrame([(w,) for w in want], "word string")).collect()}
    assert {w: (got[w], s) for w, s in want.items() if got[w] != s} == {}


def test_stemmed_postings_and_questions(spark):
    postings = spark.createDataFrame([("upgrade", "K-1", 1, 2), ("upgrades", "K-1", 0, 3), ("upgrading", "K-2", 1, 0)],
                                     "lexeme string, issue_key string, n_a long, n_b long")
    assert {tuple(r) for r in stem_postings(postings).collect()} == {("upgrad", "K-1", 1, 5), ("upgrad", "K-2", 1, 0)}
    asked = spark.createDataFrame([(1, "upgraded"), (1, "upgrades"), (2, "shuffle")], "qid int, lexeme string")
    assert {tuple(r) for r in stem_lexemes(asked).collect()} == {(1, "upgrad"), (2, "shuffl")}
