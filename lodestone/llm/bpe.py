"""BPE encoding and decoding with forced boundaries.

A pair of bytes that stands inside no token of the vocabulary is a certain cut: no merge can ever join its two sides.  Texts are
split by the vocabulary's own pattern, the parts are cut at all such pairs, each different fragment is merged once by itself, and
the results are put together again.  The vocabulary file is read where the driver runs and sent to the tasks (its size is fixed).

Null texts are empty and have no ids.  Repeated parts are looked up in a store of bounded size.  Long fragments without a cut are
merged with a heap, in n log n steps.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that this kind of vocabulary splits texts with before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bytes that the parts kept by a task take, about, with ``PART_BYTES`` for each besides its text and ids; texts are worked on in steps of so many characters.
KEPT_BYTES, PART_BYTES, STEP_CHARS = 24 << 20, 180, 1 << 19
#: Fragments longer than this go to the heap.
LONG = 64


def _byte_letters() -> dict[str, int]:
    """The letters that stand for the 256 bytes in such files: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and certain cuts of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        ids = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: b for b, i in ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.tokens = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.of_byte = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        pairs = [tuple(p) if isinstance(p, (list, tuple)) else tuple(p.split(" ")) for p in spec["model"]["merges"]]
        as_ids = np.array([[ids[bytes(letters[c] for c in side)] for side in p] + [ids[bytes(letters[c] for c in "".join(p))]] for p in pairs], np.int64)
        keys = as_ids[:, 0] << 32 | as_ids[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), as_ids[order, 2]
        self.inside = np.zeros((256, 256), bool)
        for token in ids:
            b = np.frombuffer(token, np.uint8)
            self.inside[b[:-1], b[1:]] = True

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs among the merges, or -1."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Places where a certain cut lies before a byte."""
        return np.flatnonzero(~self.inside[data[:-1], data[1:]]) + 1

    def merge(self, fragments: list[bytes]) -> list[bytes]:
        """Ids of each fragment, as little-endian unsigned 32-bit integers.

        All short ones advance together: each round joins the pair of lowest rank in each of them.
        """
        out: list[bytes | None] = [self._merge_long(f) if len(f) > LONG else None for f in fragments]
        short = [i for i, x in enumerate(out) if x is None]
        if not short:
            return out
        ids = self.of_byte[np.frombuffer(b"".join(fragments[i] for i in short), np.uint8)]
        of = np.repeat(np.arange(len(short)), [len(fragments[i]) for i in short])
        none = len(self.keys)

        def ranked(at: np.ndarray) -> None:
            """Look the pairs that begin at these places up."""
            at = at[at + 1 < len(ids)]
            at = at[of[at] == of[at + 1]]
            pair[at] = self.find(ids[at], ids[at + 1])
            rank[at] = np.where(pair[at] >= 0, self.ranks[pair[at]], none)

        pair, rank = np.full(len(ids), -1, np.int64), np.full(len(ids), none, np.int64)
        ranked(np.arange(len(ids)))
        done_ids, done_of = [], []
        while len(ids):
            begins = np.flatnonzero(np.diff(of, prepend=-1))
            best = np.repeat(np.minimum.reduceat(rank, begins), np.diff(begins, append=len(of)))
            going = best < none
            if not going.all():
                done_ids.append(ids[~going])
                done_of.append(of[~going])
                ids, of, pair, rank, best = ids[going], of[going], pair[going], rank[going], best[going]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == best)
            # of joined pairs that overlap, as in "aaa", the first, third and so on count
            new = np.ones(len(at), bool)
            new[1:] = np.diff(at) > 1
            since = np.arange(len(at)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            at = at[since % 2 == 0]
            ids[at] = self.made[pair[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))                   # where the joined ones stand after the gaps are closed
            ids, of, pair, rank = ids[keep], of[keep], pair[keep], rank[keep]
            pair[at], rank[at] = -1, none
            left = at[at > 0] - 1
            pair[left], rank[left] = -1, none
            ranked(at)
            ranked(left)
        ids, of = np.concatenate(done_ids), np.concatenate(done_of)
        order = np.argsort(of, kind="stable")
        ends = np.cumsum(np.bincount(of, minlength=len(short)))
        flat = ids[order].astype("<u4").tobytes()
        low = 0
        for i, high in zip(short, (4 * ends).tolist()):
            out[i] = flat[low:high]
            low = high
        return out

    def _merge_long(self, fragment: bytes) -> bytes:
        ids = self.of_byte[np.frombuffer(fragment, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        places = self.find(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(self.ranks[p]), i, int(p), ids[i], ids[i + 1]) for i, p in enumerate(places) if p >= 0]
        heapq.heapify(heap)
        keys = self.keys
        while heap:
            _, i, p, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = int(self.made[p]), -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0:
                    key = ids[x] << 32 | ids[y]
                    at = int(np.searchsorted(keys, key))
                    if at < len(keys) and keys[at] == key:
                        heapq.heappush(heap, (int(self.ranks[at]), x, at, ids[x], ids[y]))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()


class Coder:
    """Encodes and decodes texts with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.split = regex.compile(PATTERN).findall
        self.kept: dict[str, bytes] = {}
        self.kept_bytes = 0
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) or r"(?!)")

    def _learn(self, parts: set[str]) -> None:
        """Cut parts at the certain cuts and merge each different fragment once."""
        parts_list = list(parts)
        raw = [p.encode() for p in parts_list]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(r) for r in raw])
        cut = np.zeros(len(data) + 1, bool)
        cut[self.v.cuts(data)] = True
        cut[ends] = True
        cut[0] = True
        places = np.flatnonzero(cut)
        whole = data.tobytes()
        pieces = [whole[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist())]
        number: dict[bytes, int] = {}
        index = [number.setdefault(p, len(number)) for p in pieces]
        merged = self.v.merge(list(number))
        last = np.searchsorted(places, ends).tolist()
        first = 0
        for part, end in zip(parts_list, last):
            ids = self.kept[part] = b"".join(merged[k] for k in index[first:end])
            self.kept_bytes += len(part) + len(ids) + PART_BYTES
            first = end

    def forget(self) -> None:
        """Empty the store of parts: a Python worker lives on when its task ends."""
        self.kept, self.kept_bytes = {}, 0

    def _plain(self, texts: list[str]) -> list[bytes]:
        lists = [self.split(t) for t in texts]
        missing = {p for parts in lists for p in parts if p not in self.kept}
        if missing:
            if self.kept_bytes > KEPT_BYTES:
                self.forget()
                missing = {p for parts in lists for p in parts}
            self._learn(missing)
        kept = self.kept
        return [b"".join([kept[p] for p in parts]) for parts in lists]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.  A special token's text is that token."""
        out: list[bytes] = [b""] * len(texts)
        low = 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size + len(texts[high]) <= STEP_CHARS):
                size += len(texts[high])
                high += 1
            rows = [[t] if not self.special.search(t) else [p for p in regex.split(f"({self.special.pattern})", t) if p] for t in texts[low:high]]
            flat = self._plain([p for row in rows for p in row if p not in self.v.special])
            made = iter(flat)
            for i, row in enumerate(rows):
                out[low + i] = b"".join(self.v.special[p].to_bytes(4, "little") if p in self.v.special else next(made) for p in row)
            low = high
        return out

    def decode(self, ids: bytes) -> str:
        tokens = self.v.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


#: The coder of this Python worker by its vocabulary.
_CODERS: dict[str, Coder] = {}


def _coder(df: DataFrame, path: str):
    """A function that gives each Python worker its coder.  The vocabulary is parsed once, on the driver."""
    made = pickle.dumps(Vocabulary(path))
    name, sent = hashlib.sha256(made).hexdigest(), df.sparkSession.sparkContext.broadcast(made)

    def get() -> Coder:
        if name not in _CODERS:
            _CODERS.clear()
            _CODERS[name] = Coder(pickle.loads(sent.value))
        return _CODERS[name]

    return get


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the ids of a text column as binary (little-endian unsigned 32-bit)."""
    coder = _coder(df, path)

    @F.pandas_udf("binary")
    def run(texts):
        return texts.__class__(coder().encode([t or "" for t in texts]))

    return df.withColumn(ids, run(text))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add the text of an id column; null ids give the empty text."""
    coder = _coder(df, path)

    @F.pandas_udf("string")
    def run(column):
        return column.__class__([coder().decode(i or b"") for i in column])

    return df.withColumn(text, run(ids))


def there_and_back(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add the ids of a text column and what they decode to, in one pass (``coded``: ids, text)."""
    coder = _coder(df, path)

    @F.pandas_udf("ids binary, text string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            ids = coder().encode([t or "" for t in texts])
            yield pd.DataFrame({"ids": ids, "text": [coder().decode(i) for i in ids]})
        coder().forget()

    return df.withColumn("coded", run(text))


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def vocabulary_path() -> str:
    """The 50,257-token file: named by LODESTONE_BPE_FILE, else by the module of public vocabularies."""
    if named := os.environ.get("LODESTONE_BPE_FILE"):
        return named
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op4_bpe(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode every text and digest both."""
    coder = _coder(documents, path or vocabulary_path())
    fields = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder()
        for batch in batches:
            codes = c.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.int64()), pa.array([len(x) // 4 for x in codes], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in codes]),
                pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in codes])], schema=fields)
        c.forget()

    return documents.select("doc_id", "text").mapInArrow(run, RESULT)
