"""Fingerprint likeness against a plain-Python model of the pieces."""

import random
from collections import Counter

from cases import documents, frame, words

from lodestone.llm import merkle

M = (1 << 64) - 1


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def pieces(text):
    out, begin, blank = [], 0, -1
    for at in range(len(text) + 1):
        if at == len(text):
            ends = at > begin
        else:
            ends = at > 0 and text[at - 1] == 10
            if at > merkle.CONTEXT and text[at - 1] == 32:
                ends |= mix(int.from_bytes(text[at - 1 - merkle.CONTEXT:at - 1], "little")) % merkle.BLANKS == 0
            blank = at if text[at] in (32, 10) else blank
            if at >= merkle.CONTEXT and at - blank > merkle.STRETCH:
                ends |= mix(int.from_bytes(text[at - merkle.CONTEXT:at], "little")) % (merkle.STRETCH // 2) == 0
        if ends and at > begin:
            out.append(text[begin:at])
            begin = at
    return out


def alike(a, b):
    if a == b:
        return 1.0
    common = sum(len(p) * n for p, n in (Counter(pieces(a)) & Counter(pieces(b))).items())
    return 2 * common / (len(a) + len(b))


def test_near_values_are_those_of_the_model(spark):
    rows = list({r[0]: r for r in documents(n=60) if r[0] is not None}.values())
    rng = random.Random(3)
    long = words(rng, 2_000)
    rows += [(900, long, "", "", 0), (901, long.replace("a", "b", 3), "", "", 0), (902, "".join(rng.choices("日本語abc", k=4000)), "", "", 0)]
    rows.sort(key=lambda r: r[0])
    out = {r.doc_id: r for r in merkle.op1_merkle_fingerprints(frame(spark, rows)).collect()}
    texts = [r[1] or "" for r in rows]
    for (i, *_), text, following in zip(rows, texts, texts[1:] + texts[:1]):
        edited = text[:len(text) - len(text) // 4] + following[:len(text) // 4]
        assert abs(out[i].near_edited - alike(text.encode(), edited.encode())) < 1e-9
        assert abs(out[i].near_next - alike(text.encode(), following.encode())) < 1e-9


def test_one_changed_character_of_a_text_without_blanks():
    rng = random.Random(1)
    for alphabet in ("日本語漢字仮名", "ABCDEFGHabcdefgh0123456789+/"):
        text = "".join(rng.choices(alphabet, k=50_000))
        for other in (text[:-1] + "x", text[:25_000] + "x" + text[25_001:], "x" + text):
            assert merkle.likeness(merkle.tree(text.encode()), merkle.tree(other.encode())) > 0.99


def test_stored_trees_compare_like_new_ones():
    a, b = (merkle.tree(t.encode()) for t in ("one two three\n" * 50, "one two three\n" * 40 + "four five six seven eight\n"))
    c, d = (merkle.Tree.restored(x.stored()) for x in (a, b))
    assert merkle.likeness(c, d) == merkle.likeness(a, b) and merkle.differing(c, d) == merkle.differing(a, b) and 0 < merkle.likeness(a, b) < 1
    assert b"three" not in a.stored()
