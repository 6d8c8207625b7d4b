"""Secret scans: three fixed rules, and character Markov models of random strings and ordinary identifiers.

The rules find assignments, access keys and hexadecimal runs.  The models add what the rules miss: runs of at least ``CANDIDATE``
letters, digits and ``+/_=-`` are scored by the log-likelihood ratio of two second-order Markov chains, one trained on strings
labelled random (what the rules match, and strings drawn from the alphabets of keys), the other on ordinary ones: the character triples
of all words of all documents, counted in the tasks, and identifiers put together from words.  The counts of words enter with a fixed weight, so
that the smoothing is the same at every size; only the strings that are drawn are bounded, those of the least hashes.  A run that does not pass as a whole is searched: its parts between
``=`` and ``/``, then between these, ``_`` and ``-``, are scored like runs of their own, and every ``CANDIDATE`` characters in place,
so that a key behind a long path or name is not diluted.  Digits alone are numbers, not secrets, and are left out, and so are
digits with ``=/_-+`` where a run is searched.

Null texts count as empty and have no spans.  Places are code points, ends exclusive.  Every row is answered, repeated ones too.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import prefix_hashes, range_hashes, steps, text_bytes
from lodestone.session import cut_lineage, scratch

# The rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

CANDIDATE = 20
RUNS = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % CANDIDATE)
PARTS = [re.compile(r"[A-Za-z0-9+_-]{%d,}" % CANDIDATE), re.compile(r"[A-Za-z0-9+]{%d,}" % CANDIDATE)]
NUMBER = re.compile(r"[0-9=/_+-]*")
#: The mean log-likelihood ratio of a character above which a run counts as random, and the fewest different characters of one.
RATIO, DIFFERENT = 0.5, 8
#: Strings of a label that are drawn at most; characters that the words of all documents count for.
SAMPLE_STRINGS, WORD_CHARACTERS = 20_000, 80_000

_SYMBOLS = string.ascii_letters + string.digits + "+/_.=-"
_PLACE = np.zeros(256, np.int64)
_PLACE[[ord(c) for c in _SYMBOLS]] = np.arange(1, len(_SYMBOLS) + 1)
_SIZE = len(_SYMBOLS) + 1                                # 0 stands for the beginning and all other characters


def _triples(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all (two before, one before, character) of the strings, and to which string each belongs."""
    raw = [s.encode() for s in strings]
    ids = _PLACE[np.frombuffer(b"".join(b"\0\0" + r for r in raw), np.uint8)]
    of = np.repeat(np.arange(len(raw)), [len(r) + 2 for r in raw])
    inner = of[2:] == of[:-2]
    return ((ids[:-2] * _SIZE + ids[1:-1]) * _SIZE + ids[2:])[inner], of[2:][inner]


def _counts(strings: list[str]) -> np.ndarray:
    return np.bincount(_triples(strings)[0], minlength=_SIZE ** 3) if strings else np.zeros(_SIZE ** 3, np.int64)


class Chain:
    """A second-order chain of counts of triples, smoothed by the first-order one, which is smoothed by equal chances."""

    def __init__(self, counts: np.ndarray) -> None:
        three = counts.reshape(_SIZE, _SIZE, _SIZE).astype(float)
        two = three.sum(axis=0)
        first = (two + 0.5) / (two.sum(axis=1, keepdims=True) + 0.5 * _SIZE)
        self.log = np.log((three + 4 * first[None]) / (three.sum(axis=2, keepdims=True) + 4)).ravel()


class Ratio:
    """Log-likelihood ratio of random to ordinary, by character, from samples (string, whether random) and counts of ordinary triples."""

    def __init__(self, samples: list[tuple[str, bool]], ordinary: np.ndarray | float = 0.0) -> None:
        secret, plain = (_counts([s for s, is_secret in samples if is_secret == side]) for side in (True, False))
        self.log = (Chain(secret).log - Chain(plain + ordinary).log).astype(np.float32)

    def __call__(self, strings: list[str]) -> np.ndarray:
        triples, of = _triples(strings)
        return np.bincount(of, self.log[triples], len(strings)) / np.maximum(1, np.bincount(of, minlength=len(strings)))

    def each(self, run: str) -> np.ndarray:
        """The ratio of every character of one string."""
        return self.log[_triples([run])[0]].astype(float)


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, number of the kind, kind, end) of the rules' spans, by start and kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str]]:
    """Runs, without what the spans of the rules cover."""
    covered: list[list[int]] = []
    for a, _, _, b in taken:
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    out, nearest = [], 0
    for m in RUNS.finditer(text):
        at, end = m.start(), m.end()
        while nearest < len(covered) and covered[nearest][1] <= at:
            nearest += 1
        parts, k = [], nearest
        while k < len(covered) and covered[k][0] < end:
            parts.append((at, covered[k][0]))
            at = covered[k][1]
            k += 1
        out += [(a, b, text[a:b]) for a, b in (*parts, (at, end)) if b - a >= CANDIDATE and _can_be(text[a:b])]
    return out


def _can_be(run: str) -> bool:
    return not run.isdigit() and len(set(run)) >= DIFFERENT


def stretches(run: str, ratio: Ratio) -> list[tuple[int, int]]:
    """Ranges of a run, which does not pass as a whole, that count as random."""
    out: list[tuple[int, int]] = []
    for cut in PARTS:
        parts = [(m.start(), m.end()) for m in cut.finditer(run) if m.end() - m.start() < len(run) and _can_be(m[0]) and not NUMBER.fullmatch(m[0])]
        parts = [(a, b) for a, b in parts if not any(x < b and a < y for x, y in out)]
        if parts:
            out += [p for p, s in zip(parts, ratio([run[a:b] for a, b in parts]).tolist()) if s >= RATIO]
    each = ratio.each(run)
    sums = np.concatenate(([0.0], np.cumsum(each)))
    means = (sums[CANDIDATE:] - sums[:-CANDIDATE]) / CANDIDATE
    open_ = means >= RATIO
    for a, b in out:
        open_[max(0, a - CANDIDATE + 1):b] = False
    at = np.flatnonzero(open_)
    if len(at):
        letters = np.sort(np.lib.stride_tricks.sliding_window_view(np.frombuffer(run.encode(), np.uint8), CANDIDATE)[at], axis=1)
        at = at[(np.diff(letters, axis=1) != 0).sum(axis=1) + 1 >= DIFFERENT]
    while len(at):
        # windows that overlap are one; the best stretch of it, widened to the next separator inside it
        breaks = np.flatnonzero(np.diff(at) >= CANDIDATE)
        groups = [(int(g[0]), int(g[-1]) + CANDIDATE) for g in np.split(at, breaks + 1)]
        found = [_best(run, sums, means, low, high) for low, high in groups]
        out += [span for span in found if not NUMBER.fullmatch(run[slice(*span)])]
        clear = np.ones(len(at), bool)
        for a, b in found:
            clear &= (at + CANDIDATE <= a) | (at >= b)
        at = at[clear]
    return sorted(out)


def _best(run: str, sums: np.ndarray, means: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """The range of the largest sum of ratios within low..high, widened to separators, and to the best window if it is shorter than one."""
    part = sums[low:high + 1]
    floor = np.minimum.accumulate(part)
    end = int(np.argmax(part - floor))
    start, end = low + int(np.argmin(part[:end + 1])), low + end
    start = next((i for i in range(start, low, -1) if run[i - 1] in "=/_-"), low)
    end = next((i for i in range(end, high) if run[i] in "=/_-"), high)
    if end - start < CANDIDATE:
        window = low + int(np.argmax(means[low:high - CANDIDATE + 1]))
        start, end = min(start, window), max(end, window + CANDIDATE)
    return start, end


_HEX, _RUN = np.zeros(256, bool), np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True
_RUN[[ord(c) for c in string.ascii_letters + string.digits + "+/_=-"]] = True


def _worth(column: pa.Array) -> np.ndarray:
    """Rows that can have a span at all: with ``:``, ``=``, or a run that is long enough.  The rest need no closer look."""
    data, offsets = text_bytes(column)
    rows = np.zeros(len(column), bool)

    def flag(at: np.ndarray) -> None:
        rows[np.searchsorted(offsets, at, "right") - 1] = True

    flag(np.flatnonzero((data == ord(":")) | (data == ord("="))))
    for inside, least in ((_HEX[data], LEAST["hex"]), (_RUN[data], min(CANDIDATE, LEAST["access"]))):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
        begins, ends = edges[::2], edges[1::2]
        flag(begins[ends - begins >= least])           # a run may go on into the next text: then both are looked at
        long = ends - begins >= least
        flag(ends[long] - 1)
        wide = np.flatnonzero(long & (np.searchsorted(offsets, ends - 1, "right") - np.searchsorted(offsets, begins, "right") > 1))
        for k in wide.tolist():
            rows[np.searchsorted(offsets, begins[k], "right") - 1:np.searchsorted(offsets, ends[k] - 1, "right")] = True
    return rows


def word_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the words ``[A-Za-z][a-z]+`` of some texts."""
    lower = (data >= 97) & (data <= 122)
    start, end = lower.copy(), lower.copy()
    if len(data):
        start[1:] &= ~lower[:-1]
        end[:-1] &= ~lower[1:]
        some = np.diff(offsets) > 0
        first, last = offsets[:-1][some], offsets[1:][some] - 1
        start[first], end[last] = lower[first], lower[last]
    begins, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    before = np.maximum(begins - 1, 0)
    capital = (data[before] >= 65) & (data[before] <= 90) & (begins > 0) if len(data) else np.zeros(0, bool)
    if len(begins):
        capital &= offsets[np.searchsorted(offsets, begins, "right") - 1] != begins
    begins = begins - capital
    long = ends - begins >= 2
    return begins[long], ends[long]


def _word_triples(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Counts of the character triples of the words."""
    length = ends - begins
    place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    ids = _PLACE[data[np.repeat(begins, length) + place]]
    one, two = np.append(0, ids[:-1]), np.append([0, 0], ids[:-2])[:len(ids)]
    return np.bincount((np.where(place > 1, two, 0) * _SIZE + np.where(place > 0, one, 0)) * _SIZE + ids, minlength=_SIZE ** 3)


class _Least:
    """The strings of the least hashes."""

    def __init__(self, most: int) -> None:
        self.most, self.kept, self.bound = most, {}, 1 << 64

    def add(self, key: int, value: str) -> None:
        if key < self.bound:
            self.kept[key] = value
            if len(self.kept) > 2 * self.most:
                self.kept = dict(sorted(self.kept.items())[:self.most])
                self.bound = max(self.kept)


def corpus_strings(documents: DataFrame, strings: int = SAMPLE_STRINGS) -> tuple[np.ndarray, list[str], list[str]]:
    """Counts of the triples of all words of all documents; words, and strings that the rules match, of the least hashes, ``strings`` / 2 at most."""
    fields = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("string", pa.string())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words, matched = np.zeros(_SIZE ** 3, np.int64), _Least(strings // 2), _Least(strings // 2)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for low, high in steps(offsets):
                part, ends_at = data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
                begins, ends = word_ranges(part, ends_at)
                if len(begins):
                    total += _word_triples(part, begins, ends)
                    keys, first = np.unique(range_hashes(prefix_hashes(part), begins, ends), return_index=True)
                    for key, at in zip(keys[:strings].tolist(), first[:strings].tolist()):
                        if key >= words.bound:
                            break
                        words.add(key, part[begins[at]:ends[at]].tobytes().decode())
            for i in np.flatnonzero(_worth(batch.column(0))).tolist():
                text = batch.column(0)[i].as_py() or ""
                for a, _, kind, b in base_spans(text):
                    found = ASSIGN.match(text[a:b])[2] if kind == "assign" else text[a:b]
                    matched.add(int.from_bytes(hashlib.blake2b(found.encode(), digest_size=8).digest(), "little"), found)
        at = np.flatnonzero(total)
        rows = [(0, at, total[at], [None] * len(at)), *((k, np.array(list(x.kept), np.uint64).view(np.int64), np.zeros(len(x.kept), np.int64), list(x.kept.values()))
                                                        for k, x in ((1, words), (2, matched)))]
        for kind, key, n, values in rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(n), pa.array(values, pa.string())], schema=fields)

    with scratch(documents.sparkSession):
        each = cut_lineage(documents.select("text").mapInArrow(gather, "kind int, key long, n long, string string"))
        sums = each.where("kind = 0").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros(_SIZE ** 3, np.int64)
        total[sums["key"].to_numpy()] = sums["n"].to_numpy()
        # the tasks ordered by unsigned hashes
        least = [each.where(F.col("kind") == k).select("key", "string").distinct().orderBy(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), "string").limit(strings // 2) for k in (1, 2)]
        return total, *([r[1] for r in found.collect()] for found in least)


def labelled_strings(words: list[str], matched: list[str], strings: int = SAMPLE_STRINGS, seed: int = 5) -> list[tuple[str, bool]]:
    """Strings to train on: (string, whether it is random).  Ordinary ones are words joined the way identifiers are; random ones are what the
    rules match, and strings drawn from the alphabets of keys."""
    rng = random.Random(seed)
    words = sorted(words) or ["name"]
    joins = (lambda a: "_".join(a), lambda a: "-".join(a), lambda a: "/".join(a), lambda a: "".join(w.capitalize() for w in a),
             lambda a: "_".join(a).upper(), lambda a: f"{'_'.join(a)}_{rng.randrange(100)}")
    made = [(rng.choice(joins)([w.lower() for w in rng.choices(words, k=rng.randint(2, 4))]), False) for _ in range(strings // 2)]
    alphabets = ("0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_")
    drawn = [("".join(rng.choices(rng.choice(alphabets), k=rng.randint(20, 44))), True) for _ in range(strings // 2)]
    return [(s, True) for s in sorted(matched)] + made + drawn


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(column: pa.Array, ratio: Ratio) -> list[tuple[list, list]]:
    """Base spans and all spans of each text."""
    out: list[tuple[list, list]] = [([], [])] * len(column)
    for i in np.flatnonzero(_worth(column)).tolist():
        text = column[i].as_py() or ""
        base = base_spans(text)
        more = candidates(text, base)
        if more:
            scores = ratio([run for _, _, run in more])
            extra = []
            for (a, b, run), s in zip(more, scores.tolist()):
                extra += [(a + x, 3, "random", a + y) for x, y in ([(0, b - a)] if s >= RATIO else stretches(run, ratio))]
        else:
            extra = []
        out[i] = base, sorted(base + extra)
    return out


def trained(documents: DataFrame) -> Ratio:
    total, words, matched = corpus_strings(documents)
    return Ratio(labelled_strings(words, matched), total * (WORD_CHARACTERS / max(1, total.sum())))


def redact(documents: DataFrame, ratio: Ratio, mark: str = "[SECRET]") -> DataFrame:
    """Documents with every span of ``text`` replaced by ``mark``; overlapping spans are one.  Adds ``_spans``, their number."""
    sent = documents.sparkSession.sparkContext.broadcast(ratio)
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = batch.column(0), []
            changed: dict[int, str] = {}
            for i, (_, spans) in enumerate(scan(texts, sent.value)):
                counts.append(len(spans))
                if spans:
                    text, parts, at = texts[i].as_py(), [], 0
                    for a, _, _, b in spans:
                        if a >= at:
                            parts += [text[at:a], mark]
                        at = max(at, b)
                    changed[i] = "".join(parts) + text[at:]
            if changed:
                texts = pa.array([changed.get(i, t) for i, t in enumerate(texts.to_pylist())], texts.type)
            yield pa.RecordBatch.from_arrays([texts, *batch.columns[1:], pa.array(counts, pa.int32())], names=[*batch.schema.names, "_spans"])

    others = [c for c in names if c != "text"]
    rows = documents.select("text", *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)))
    schema = T.StructType([*rows.schema.fields, T.StructField("_spans", T.IntegerType())])
    out = rows.mapInArrow(run, schema)
    back = {c: f"c{i}" for i, c in enumerate(others)} | {"text": "text"}
    return out.select(*(F.col(back[c]).alias(c) for c in names), "_spans")


def op5_secret_scan(documents: DataFrame) -> DataFrame:
    """Spans of all texts, by the rules and by the models."""
    sent = documents.sparkSession.sparkContext.broadcast(trained(documents))
    fields = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                        ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spelled = [], [], []
            for base, spans in scan(batch.column(1), sent.value):
                kinds = [s[2] for s in base]
                counts.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex")))
                digests.append(hashlib.sha256(_spelled(base).encode()).hexdigest())
                spelled.append(_spelled(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)),
                                              pa.array(digests, pa.string()), pa.array(spelled, pa.string())], schema=fields)

    return documents.select("doc_id", "text").mapInArrow(run, RESULT)


def _spelled(spans: list) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
