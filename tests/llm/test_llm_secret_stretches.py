"""Keys behind and between ordinary text of one run."""

import random
import re
import string
import time

import pyarrow as pa
import pytest
from cases import column, frame

from lodestone.llm import secrets
from lodestone.llm.common import text_bytes

PREFIXES = ["usr/share/applications/production/service/settings/credentials/", "very_long_private_signing_service_credential_name=",
            "another-ordinary-name-of-a-thing-that-goes-on-for-long-", ""]


@pytest.fixture(scope="module")
def ratio():
    rng = random.Random(1)
    texts = " ".join(t or "" for t in column("text", "documents", "sf0.01"))
    words = sorted(set(secrets.re.findall(r"[A-Za-z][a-z]+", texts)) | set(secrets.re.findall(r"[a-z]+", " ".join(PREFIXES))))
    made = ["_-/"[i % 3].join(w.lower() for w in rng.choices(words, k=3)) for i in range(10_000)]
    alphabets = (string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "-_")
    drawn = ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(20, 44))) for _ in range(10_000)]
    return secrets.Ratio([(w, False) for w in words + made] + [(d, True) for d in drawn])


def spans(text, ratio):
    return [(a, b) for a, _, _, b in secrets.scan(secrets.pa.array([text]), ratio)[0][1]]


@pytest.mark.parametrize("size", [20, 32, 40])
def test_keys_are_found_wherever_they_stand(ratio, size):
    rng = random.Random(size)
    for prefix in PREFIXES:
        for tail in ("", "/and/some/more/ordinary/names/that/follow/after/it"):
            whole = exact = 0
            for _ in range(100):
                key = "".join(rng.choices(string.ascii_letters + string.digits, k=size))
                text = f"see {prefix}{key}{tail} here"
                found, at = spans(text, ratio), 4 + len(prefix)
                whole += any(a <= at and at + size <= b for a, b in found)
                exact += (at, at + size) in found
            assert whole >= 98, (prefix, tail, whole)
            assert exact >= 90 or len(prefix) < 20, (prefix, tail, exact)


def test_two_keys_and_a_span_of_the_rules(ratio):
    rng = random.Random(4)
    one, two = ("".join(rng.choices(string.ascii_letters + string.digits, k=32)) for _ in range(2))
    text = f"some/ordinary/place/of/things/that/are/kept/{one}/and/then/another/ordinary/place/of/things/{two}"
    assert spans(text, ratio) == [(text.index(k), text.index(k) + 32) for k in (one, two)]
    text = f"{one}-{'0123456789abcdef' * 2}/x"
    assert text.index(one) == 0 and any(a == 0 and b >= 32 for a, b in spans(text, ratio))


def test_ordinary_names_and_numbers_are_left(ratio):
    for text in (*(p + "and/some/more/ordinary/names/that/follow" for p in PREFIXES), "logs/of/the/service/2024/01/02-03-04-05-123456789012345/run", "z" * 60, "=" * 40):
        assert not spans(text, ratio), text


def test_words_and_triples_are_those_of_the_expression():
    rng = random.Random(2)
    texts = ["".join(rng.choices("aabBcCZ é_1 \n", k=rng.randint(0, 60))) for _ in range(300)] + ["", "Ab", "aB", "ABc", "abCd"]
    data, offsets = text_bytes(pa.array(texts))
    begins, ends = secrets.word_ranges(data, offsets)
    found = [data[a:b].tobytes().decode() for a, b in zip(begins, ends)]
    want = [w for t in texts for w in re.findall(r"[A-Za-z][a-z]+", t)]
    assert found == want
    assert (secrets._word_triples(data, begins, ends) == secrets._counts(want)).all()


def test_many_rule_spans_in_one_text_take_time_in_proportion():
    text = " ".join("0123456789abcdef01234567" + "ABCdefGHIjklMNOpqrSTU" for _ in range(20_000))
    start = time.perf_counter()
    base = secrets.base_spans(text)
    runs = secrets.candidates(text, base)
    assert time.perf_counter() - start < 4 and len(base) == len(runs) == 20_000


def test_ordinary_counts_come_from_all_documents(spark):
    rows = [(i, f"word{'s' * (i % 5)} Alpha beta key=0123456789abcdef0123456789", "", "", 0) for i in range(300)]
    total, words, matched = secrets.corpus_strings(frame(spark, rows), 40)
    assert total.sum() == sum(len(w) for r in rows for w in re.findall(r"[A-Za-z][a-z]+", r[1]))
    assert {"Alpha", "beta", "word"} <= set(words) and matched == ["0123456789abcdef0123456789"]
    assert secrets.op5_secret_scan(frame(spark, [])).count() == 0
