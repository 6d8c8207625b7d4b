"""Operators whose result is fixed, against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from cases import DOCUMENTS, column, documents, frame
from tokenizers import Tokenizer

from lodestone.llm import bpe, chat, decontaminate, merkle, repeats, secrets, sharding, simhash
from lodestone.llm.components import components

EMPTY: list = []


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# sharding

def jump_one(key, shards):
    key &= (1 << 64) - 1
    at, ahead = -1, 0
    while ahead < shards:
        at = ahead
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        ahead = int((at + 1) * (2.0 ** 31 / ((key >> 33) + 1)))
    return at


def test_jump_matches_the_published_loop_and_moves_rows_into_the_new_shard_only():
    keys = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 3000)
    for shards in (1, 2, 40, 41, 1000):
        assert sharding.jump(keys, shards).tolist() == [jump_one(int(k), shards) for k in keys]
    small, grown = sharding.jump(keys, 40), sharding.jump(keys, 41)
    assert set(grown[small != grown].tolist()) == {40}


def test_sharding_numbers_every_row_without_a_gap(spark):
    data = documents()
    out = sharding.op9_jump_sharding(frame(spark, data)).collect()
    assert len(out) == len(data)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in data)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    assert sharding.op9_jump_sharding(frame(spark, EMPTY)).count() == 0


def test_slots_of_many_groups_are_gapless(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUP_ROWS", 7)
    out = sharding.op9_jump_sharding(frame(spark, documents(n=200))).groupBy("shard").agg({"slot": "max", "*": "count"}).collect()
    assert all(r["max(slot)"] + 1 == r["count(1)"] for r in out)


# chat

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_chat_digests_and_order(spark):
    data = [(1, 0, "system", "be <s> \\ [x]"), (1, 1, "user", "hi [/INST]"), (1, 2, "assistant", "</s>yes\n"), (2, 0, "assistant", "early"),
            (2, 1, "assistant", None), (3, 0, "tool[1]", "x"), (3, 1, None, "y"), (4, 0, "user", "a"), (4, 0, "user", "a"), (None, None, "user", "")]
    out = {r.conv_id: r for r in chat.op3_chat_formatting(frame(spark, data, CONVERSATIONS)).collect()}
    assert out.keys() == {-1, 1, 2, 3, 4, None}
    said = "</s>[INST] ok [/INST]"
    for conv, rows in {1: data[:3], 2: data[3:5], 3: data[5:7], 4: data[7:9], None: data[9:], -1: [(0, 0, "user", said), (0, 1, "assistant", said)]}.items():
        r = out[conv]
        assert r.n_turns == len(rows)
        assert r.turns_sha256 == sha("".join(f"{role or ''}\n{text or ''}\n" for _, _, role, text in rows))
        loss = "".join(text or "" for _, _, role, text in rows if role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    assert [out[k].valid for k in (1, 2, 3, 4, None, -1)] == [True, False, False, False, True, True]
    assert chat.op3_chat_formatting(frame(spark, EMPTY, CONVERSATIONS)).count() == 1


def test_formatted_text_can_be_read_as_one_string(spark):
    data = [(1, i, role, text) for i, (role, text) in enumerate([("system", "[SYS]"), ("user", "<"), ("assistant", "a</s"), ("odd<", "\\"), ("assistant", ""), ("user", "")])]
    turns = sorted(chat.format_turns(frame(spark, data, CONVERSATIONS)).collect(), key=lambda r: r.place)
    text = "".join(s.text for t in turns for s in t.segments)
    assert list(chat.read_turns(text)) == [(role, said) for _, _, role, said in data]


# fingerprints

def test_merkle_edits(spark):
    data = [r for r in documents() if r[0] is not None]
    data = list({r[0]: r for r in data}.values())
    out = {r.doc_id: r for r in merkle.op1_merkle_fingerprints(frame(spark, data)).collect()}
    ids = sorted(r[0] for r in data)
    texts = {i: t or "" for i, t, *_ in data}
    assert out.keys() == texts.keys()
    prints = defaultdict(set)
    for at, i in enumerate(ids):
        text, following, r = texts[i], texts[ids[(at + 1) % len(ids)]], out[i]
        k = len(text) // 4
        edited = text[:len(text) - k] + following[:k]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited))
        prints[text].add(r.fingerprint)
        prints[edited].add(r.edited_fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) == (text == edited) and (r.near_next == 1) == (text == following)
    assert all(len(p) == 1 for p in prints.values()) and len(set.union(*prints.values())) == len(prints)
    long = [r for r in out.values() if r.n_chars > 150]
    assert np.mean([r.near_edited for r in long]) > 0.6 > 0.3 > np.mean([r.near_next for r in long])


def test_merkle_ties_nulls_and_small_tables(spark):
    assert merkle.op1_merkle_fingerprints(frame(spark, EMPTY)).count() == 0
    assert [r.near_next for r in merkle.op1_merkle_fingerprints(frame(spark, [(5, "one", "", "", 1)])).collect()] == [1.0]
    data = documents()
    out = merkle.op1_merkle_fingerprints(frame(spark, data)).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in data)


def test_differing_branches_locate_the_edit():
    lines = [f"paragraph number {i} of this text" for i in range(40)]
    changed = [*lines[:17], "something else", *lines[18:]]
    a, b = (merkle.tree("\n".join(x).encode()) for x in (lines, changed))
    assert merkle.differing(a, b) == [17] and 0.9 < merkle.likeness(a, b) < 1


# tokens

def test_bpe_is_that_of_the_library(spark):
    path = bpe.vocabulary_path()
    library = Tokenizer.from_file(path)
    data = documents() + [(1000 + i, t, "", "", 0) for i, t in enumerate(column("text", "documents"))]
    odd = ["<|endoftext|>a<|endoftext|>", "  two  \n\n x\t", "it's we'LL !'s", "\x00\x1f 　​", "👩‍👩‍👧 ok", "日本語" * 300, "qzxjkvbp" * 200]
    data += [(9000 + i, t, "", "", 0) for i, t in enumerate(odd)]
    out = Counter(rows_of(bpe.op4_bpe(frame(spark, data))))
    want = Counter()
    for i, text, *_ in data:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(decoded)] += 1
    assert out == want
    assert bpe.op4_bpe(frame(spark, EMPTY)).count() == 0


def test_bpe_columns_round_trip(spark):
    path = bpe.vocabulary_path()
    df = frame(spark, [(1, "hello wörld", "", "", 1), (2, None, "", "", 1)])
    assert sorted((r.doc_id, r.back) for r in bpe.decode(bpe.encode(df, path), path, text="back").collect()) == [(1, "hello wörld"), (2, "")]


# secrets

def brute_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secret_rules_and_models(spark):
    key = "q7Zp0XkV3mT9bLw2RhYc8NsD"
    odd = ["password: 'abc' token=abcdef12 ſecret=abcdefgh", "AKIA" + "A1" * 8, "AKIAAAAA AKIA1", "0123456789abcdef01234567", "é" * 30 + "0123456789abcdef0123456789",
           f"key {key} here", "the_and_thing_of_with_ention", "12345678901234567890123456", "a" * 60, "secret=" + "f" * 30, "=" * 40]
    data = documents() + [(500 + i, t, "", "", 0) for i, t in enumerate(odd)] + [(1000 + i, t, "", "", 0) for i, t in enumerate(column("text", "documents"))]
    out = secrets.op5_secret_scan(frame(spark, data)).collect()
    texts = {}
    for i, t, *_ in data:
        texts.setdefault(i, t or "")
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in data)
    for r in out:
        base = brute_spans(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, k, _ in base) for kind in range(3))
        assert r.base_sha256 == sha(",".join(s for *_, s in base))
        assert {s for *_, s in base} <= set(filter(None, r.spans.split(",")))
    spans = {r.doc_id: r.spans for r in out}
    assert not any("random" in spans[i] for i in (506, 507, 508, 510))
    assert spans[505] == f"random:4:{4 + len(key)}"
    assert not any("random" in spans[1000 + i] for i in range(200))
    assert secrets.op5_secret_scan(frame(spark, EMPTY)).count() == 0


# decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_hits(text, items):
    own = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, said in items:
        w = WORD.findall(lower(said))
        for a in range(max(1, len(w) - 9)) if w else ():
            window = w[a:a + 10]
            for at in range(len(own) - len(window) + 1):
                if own[at:at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    found.add(str(item))
    return len(own), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


@pytest.mark.parametrize("block", [1 << 22, 40])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (block,))
    data = documents(n=15)
    passage = next(t for i, t, *_ in data if i == 22)
    said = passage.split()
    items = [(1, " ".join(said[10:40])), (2, " ".join(said[60:])), (3, "ab ab"), (4, "X"), (5, None), (6, ""), (7, "!!"), (10, " ".join(said[10:40]).upper()), (11, "ab " * 25),
             (12, "Ünï " * 12), (None, " ".join(said[:20]))]
    data += [(300, "x" + " ab" * 30, "", "", 0), (301, "ünï " * 20 + "Ünï", "", "", 0), (302, " ".join(said[12:21]), "", "", 0), (303, ", ".join(said[12:23]), "", "", 0)]
    out = Counter(rows_of(decontaminate.op7_decontamination(frame(spark, data), frame(spark, items, "item_id long, text string"))))
    known = [x for x in items if x[0] is not None]
    assert out == Counter((i, *brute_hits(t, known)) for i, t, *_ in data)


def test_decontamination_of_empty_tables(spark):
    none = frame(spark, EMPTY, "item_id long, text string")
    assert decontaminate.op7_decontamination(frame(spark, EMPTY), none).count() == 0
    assert {(r.n_hit, r.n_words) for r in decontaminate.op7_decontamination(frame(spark, [(1, "a b", "", "", 0)]), none).collect()} == {(0, 2)}


# SimHash

def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=4):
    """prints: (doc_id, fingerprint) of rows."""
    values = sorted({p for _, p in prints})
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                root[top(a)] = top(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[top(p)] = min(i, least.get(top(p), i))
    return Counter((i, f"{p:016x}", least.get(top(p))) for i, p in prints)


def test_simhash(spark):
    data = documents() + [(1000 + i, t, "", "", 0) for i, t in enumerate(column("text", "documents"))]
    want = brute_components([(i, brute_fingerprint(t)) for i, t, *_ in data])
    assert Counter(rows_of(simhash.op8_simhash(frame(spark, data)))) == want
    assert simhash.op8_simhash(frame(spark, EMPTY)).count() == 0


@pytest.mark.parametrize("limit", [20_000, 3])
def test_links_connect_what_lies_within_the_radius(spark, limit):
    rng = np.random.default_rng(8)
    seeds = rng.integers(0, 1 << 63, 12, dtype=np.uint64).tolist()
    prints = {0}
    for s in seeds:
        for _ in range(25):
            prints.add(s)
            for b in rng.integers(0, 64, rng.integers(1, 4)).tolist():
                s ^= 1 << b
    nodes = frame(spark, [(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    found = {r.node: r.component for r in components(simhash.near_links(nodes, 4, limit)).collect()}
    rows = [(i, p) for i, p in enumerate(sorted(prints))]
    want = defaultdict(set)
    for (i, _, least), n in brute_components(rows).items():
        want[least].add(rows[i][1])
    got = defaultdict(set)
    for p in prints:
        signed = p - (1 << 64) if p >> 63 else p
        got[found.get(signed, signed)].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_every_pattern_of_up_to_four_bits_is_covered():
    for family in (0, 1):
        masks = simhash.masks(4, family)
        assert len(masks) == 31
        rng = np.random.default_rng(1)
        for _ in range(3000):
            bits = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(m & bits == 0 for m in masks)


# repeated passages

def brute_removed(data):
    rows = sorted({(i if i is not None else -1, (t or "").encode()) for i, t, *_ in data})
    first = {}                                         # string: least document
    for i, t in rows:
        for s in range(len(t) - 99):
            first[t[s:s + 100]] = min(i, first.get(t[s:s + 100], i))
    out = {}
    for i, t in rows:
        gone, seen = np.zeros(len(t), bool), set()
        for s in range(len(t) - 99):
            w = t[s:s + 100]
            if first[w] < i or w in seen:
                gone[s:s + 100] = True
            seen.add(w)
        edges = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
        out[i, t] = len(t), int(gone.sum()), int((edges == 1).sum()), sha(np.frombuffer(t, np.uint8)[~gone].tobytes())
    return Counter((i, *out[-1 if i is None else i, (t or "").encode()]) for i, t, *_ in data)


@pytest.mark.parametrize("members, step", [(2048, 2 << 20), (2, 2 << 20), (2048, 1500)])
def test_repeated_passages(spark, monkeypatch, members, step):
    monkeypatch.setattr(repeats.repeated_ranges, "__defaults__", (members,))
    monkeypatch.setattr(repeats, "STEP_BYTES", step)
    monkeypatch.setattr(repeats.steps, "__defaults__", (step,))
    data = documents() + [(1000 + i, t, "", "", 0) for i, t in enumerate(column("text", "documents"))]
    data.append((2000, data[-1][1][:400] + data[-5][1][-300:] + "?", "", "", 0))
    data += [(2001 + k, f"{k} " * k + data[-1][1][50:350] + f" {k}", "", "", 0) for k in range(9)]
    assert Counter(rows_of(repeats.op10_repeated_passages(frame(spark, data)))) == brute_removed(data)


def test_repeated_passages_with_shared_ids_and_empty_tables(spark):
    data = documents()
    data += [(7, data[0][1], "", "", 0), (7, "z" * 300, "", "", 0), (7, "z" * 301, "", "", 0), (8, "z" * 150, "", "", 0)]
    assert Counter(rows_of(repeats.op10_repeated_passages(frame(spark, data)))) == brute_removed(data)
    assert repeats.op10_repeated_passages(frame(spark, EMPTY)).count() == 0


def test_suffix_sort_orders_by_bytes_and_survives_wrong_hashes(monkeypatch):
    rng = np.random.default_rng(4)
    data = np.concatenate([rng.integers(97, 99, 400, dtype=np.uint8)] * 3 + [np.full(300, 97, np.uint8)])
    at = np.arange(len(data) - 100)
    order = repeats.Suffixes(data).sort(at, np.zeros(len(at), int), np.full(len(at), len(at)))
    assert order.tolist() == sorted(range(len(at)), key=lambda i: (data[i:i + 100].tobytes(), i))
    monkeypatch.setattr(repeats, "prefix_hashes", lambda d: np.zeros(len(d) + 1, np.uint64))     # all hashes agree
    first, shape = np.array([0, 400, 30]), np.array([9, 9, 9])
    zero = np.zeros(3, np.int64)
    segment, number = repeats.repeated_windows(data, first, shape, zero, np.arange(3), zero, first)
    assert set(segment.tolist()) == {1} and number.tolist() == list(range(10))


def test_chat_query_equals_its_sql(spark):
    import duckdb

    from lodestone.llm import queries

    sf = "/root/testdata/sf0.01"
    own = queries.QUERIES["op3_chat_formatting"](spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    found = con.execute(queries.ORACLES["op3_chat_formatting"])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(own.columns)
    assert Counter(map(tuple, own.select(*names).collect())) == Counter(found.fetchall())
