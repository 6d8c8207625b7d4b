"""Ranked lexical search by NRA: impact-sorted lists are read from the top, and scores are known as intervals until they are resolved.

Terms are runs of ASCII letters and digits and of all other non-ASCII characters, A-Z lower-cased; a null text has none.  One
pass over the documents counts terms and writes the postings of asked terms, one row for each list: documents are dealt to shards of
``SHARD`` rows as they are read, and a list holds a term's documents of a shard.  With the counts of the whole corpus known, lists are written
again as **impacts** (weight of the term x its share in the document's score), greatest first: this table is the index, whatever is asked.

**Reads.**  For an item, the lists of a shard are read down to a common impact, which falls by four from read to read.  A document's lower bound is
the sum of what was read of it, its upper bound adds the next unread impact of the item's other lists.  The item is closed in a shard once the
next unread impacts of all its lists together are below the k-th lower bound: then no unseen document can come in.  Reading goes on until
every document whose upper bound reaches the k-th lower bound (ties stay) has equal bounds, so that membership, ties and scores are final, or
until the lists end.  A few shards are searched first; their k-th scores are a floor for all others, which then close after one or two reads.
The best of all shards are ranked by a window with a limit on both sides of its shuffle.

Items are broadcast in blocks of ``BLOCK`` terms, one after the other: more items cost more reads of the index, not more memory.

Repeated rows of items ask one question; each row of documents is a document of its own (equal scores: ascending doc_id, nulls
last).  Items without terms, and an empty table on either side, give no rows.  Texts of any length are read whole; a very long item has a
row for each of its different terms.  Columns besides item_id, doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Sieve, Words, steps, text_bytes
from lodestone.operators.fusion import top_rows
from lodestone.session import cut_lineage, scratch

K = 20
#: Documents of a shard; terms of items that are broadcast at once; shards searched first, for a floor.
SHARD, BLOCK, FIRST = 4_096, 1 << 20, 8


def _counted(text: pa.Array) -> Iterator[tuple[Words, int, int]]:
    """Words of the texts of a batch, step by step, with the first and last row."""
    data, offsets = text_bytes(text)
    for low, high in steps(offsets):
        yield Words(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]), low, high


def _tallied(found: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, str]]:
    """Text, hash and number for each different term of each text, of the words at some places, and the terms by hash."""
    hashes, of = found.hashes[at], found.of[at]
    order = np.lexsort((hashes, of))
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(hashes[order]) != 0) | (np.diff(of[order]) != 0)
    begins = np.flatnonzero(new)
    first = at[order[begins]]
    one, place = np.unique(found.hashes[first], return_index=True)
    names = {h: found.word(i).decode() for h, i in zip(one.tolist(), first[place].tolist())}
    return found.of[first].astype(np.int64), found.hashes[first], np.diff(np.append(begins, len(at))), names


def asked_terms(items: DataFrame) -> DataFrame:
    """item (a number of its own), item_id, term, hash and c (how often) for each different term of each different item."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for found, low, _ in _counted(batch.column(1)):
                of, hashes, c, names = _tallied(found, np.arange(len(found.hashes)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(number + low + of), batch.column(0).take(pa.array(low + of)), pa.array([names[h] for h in hashes.tolist()], pa.string()),
                    pa.array(hashes.view(np.int64)), pa.array(c)], names=["item", "item_id", "term", "hash", "c"])
            number += batch.num_rows

    return items.select("item_id", "text").distinct().mapInArrow(run, f"item long, item_id {kind}, term string, hash long, c long")


POSTINGS = "shard long, term string, docs binary, tf binary, n binary, held long, words long, ids array<long>"
_POSTINGS = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("docs", pa.binary()), ("tf", pa.binary()), ("n", pa.binary()), ("held", pa.int64()), ("words", pa.int64()),
                       ("ids", pa.list_(pa.int64()))])


class _Shard:
    """What a task has read of the documents of one shard."""

    def __init__(self, number: int) -> None:
        self.number, self.parts, self.names = number, [], {}
        self.ids: list[int | None] = []
        self.filled = self.words = 0

    def add(self, found: Words, ids: list[int | None], sieve: Sieve) -> None:
        n = np.diff(found.first)
        of, hashes, tf, names = _tallied(found, np.flatnonzero(sieve.passes(found.hashes)))
        self.parts.append((hashes, of + len(self.ids), tf, n[of]))
        self.names |= names
        self.ids += ids
        self.filled += int((n > 0).sum())
        self.words += int(n.sum())

    def rows(self) -> Iterator[pa.RecordBatch]:
        """One row for the shard (without a term: ids, documents with a word, words), and one for each list."""
        def packed(terms: list[str | None], columns: list[list[bytes | None]], held: list[int], words: int, ids: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([self.number] * len(terms), pa.int64()), pa.array(terms, pa.string()), *(pa.array(c, pa.binary()) for c in columns),
                pa.array(held, pa.int64()), pa.array([words] * len(terms), pa.int64()), pa.array(ids, pa.list_(pa.int64()))], schema=_POSTINGS)

        yield packed([None], [[None]] * 3, [self.filled], self.words, [self.ids])
        hashes, *columns = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(hashes, kind="stable")
        edges = np.append(np.flatnonzero(np.diff(hashes[order], prepend=~hashes[order[:1]])), len(order)).tolist()
        columns = [c[order].astype(np.uint32) for c in columns]
        lists = list(zip(edges[:-1], edges[1:]))
        for low in range(0, len(lists), 500):
            part = lists[low:low + 500]
            yield packed([self.names[int(hashes[order[a]])] for a, _ in part], [[c[a:b].tobytes() for a, b in part] for c in columns], [b - a for a, b in part], 0, [None] * len(part))


def postings(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """Lists (shard, term, docs, tf, n: packed numbers; held: how many) of the asked terms, and of the few others that the sieve lets through."""
    sieve = Sieve(asked.select("hash").distinct(), "hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(TaskContext.get().partitionId() << 36)
        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).to_pylist()
            for found, low, high in _counted(batch.column(1)):
                shard.add(found, ids[low:high], sieve)
                if len(shard.ids) >= SHARD:
                    yield from shard.rows()
                    shard = _Shard(shard.number + 1)
        if shard.ids:
            yield from shard.rows()

    return documents.select("doc_id", "text").mapInArrow(run, POSTINGS)


def impact_lists(read: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: shard, t, docs and impacts (packed, greatest impact first, all above 0) of the terms (term, t); without t, the ids of a shard."""
    heads = read.where("term IS NULL")
    sizes = heads.agg(F.sum("held").alias("docs"), F.sum("words").alias("words")).first()
    total, words = sizes["docs"] or 0, max(1, sizes["words"] or 0)
    held = read.join(terms, "term")
    weights = held.groupBy("t").agg(F.floor(F.lit(1000.0) * F.ln(F.lit(2.0 * total + 2) / (F.lit(2.0) * F.sum("held") + 1))).alias("w"))
    fields = pa.schema([("shard", pa.int64()), ("t", pa.int64()), ("docs", pa.binary()), ("impacts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, impacts = [], []
            for d, tf, n, w in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                d, tf, n = np.frombuffer(d, np.uint32), np.frombuffer(tf, np.uint32).astype(np.int64), np.frombuffer(n, np.uint32).astype(np.int64)
                gain = w * (1_000_000_000 * tf // (1000 * tf + 12 * (75 + 25 * n * total // words)))
                order = np.argsort(-gain, kind="stable")[:int((gain > 0).sum())]
                docs.append(d[order].tobytes())
                impacts.append(gain[order].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(docs, pa.binary()), pa.array(impacts, pa.binary())], schema=fields)

    lists = held.join(cut_lineage(weights), "t").select("shard", "t", "docs", "tf", "n", "w")
    none = F.lit(None)
    return lists.mapInArrow(run, "shard long, t long, docs binary, impacts binary").where("octet_length(docs) > 0").withColumn("ids", none.cast("array<long>")).unionByName(
        heads.select("shard", none.cast("long").alias("t"), none.cast("binary").alias("docs"), none.cast("binary").alias("impacts"), "ids"))


def nra(lists: list[tuple[np.ndarray, np.ndarray, int]], size: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents with one of the k best sums (ties with the k-th too) that reach ``floor``, their sums, and how many impacts were read.

    ``lists``: documents (numbers below ``size``), their impacts, greatest first, and how often each impact counts.
    """
    low = np.zeros(size, np.int64)
    done = [0] * len(lists)
    bound = max((int(gain[0]) * c for _, gain, c in lists), default=0)
    while True:
        bound = bound // 4 if sum(done) or bound < 4 else bound // 2
        unread = []
        for i, (docs, gain, c) in enumerate(lists):
            end = len(gain) - int(np.searchsorted(gain[::-1], bound // c, "right"))
            low[docs[done[i]:end]] += c * gain[done[i]:end]
            done[i] = end
            unread.append(c * int(gain[end]) if end < len(gain) else 0)
        unseen = sum(unread)
        least = max(floor, 1)
        if size >= k:
            least = max(least, int(np.partition(low, size - k)[size - k]))
        if unseen < least or not unseen:
            high = low + unseen
            for (docs, _, _), end, f in zip(lists, done, unread):
                if f:
                    high[docs[:end]] -= f
            stay = np.flatnonzero((high >= least) & (low > 0))
            if (high[stay] == low[stay]).all():
                return stay, low[stay], sum(done)


class _Block:
    """Items of one block: for each of them its terms, how often each counts, and the floor of its scores."""

    def __init__(self, rows: pa.Table, floors: dict[int, int]) -> None:
        item, self.t, self.c = (rows.column(n).to_numpy() for n in ("item", "t", "c"))
        order = np.argsort(item, kind="stable")
        self.t, self.c = self.t[order], self.c[order]
        self.items, first = np.unique(item[order], return_index=True)
        self.edges = np.append(first, len(item))
        self.floors = np.array([floors.get(i, 0) for i in self.items.tolist()], np.int64)


def _searched(index: DataFrame, block: _Block, k: int) -> DataFrame:
    """item, row, doc_id and score of what each shard finds."""
    sent = index.sparkSession.sparkContext.broadcast(block)
    fields = pa.schema([("item", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def answered(shard: int, ids: pa.Array, lists: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        found = []
        for i, (low, high) in enumerate(zip(asked.edges[:-1].tolist(), asked.edges[1:].tolist())):
            own = [(*lists[t], c) for t, c in zip(asked.t[low:high].tolist(), asked.c[low:high].tolist()) if t in lists]
            floor = int(asked.floors[i])
            if own and sum(int(gain[0]) * c for _, gain, c in own) >= floor:
                docs, score, _ = nra(own, len(ids), k, floor)
                if len(docs) > k:                                     # of ties with the k-th, those of the least ids
                    key = ids.take(pa.array(docs)).fill_null(np.iinfo(np.int64).max).to_numpy()
                    best = np.lexsort((docs, key, -score))[:k]
                    docs, score = docs[best], score[best]
                found.append((np.full(len(docs), asked.items[i]), docs, score))
        if found:
            item, docs, score = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array((shard << 12) + docs), ids.take(pa.array(docs)), pa.array(score)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, lists = None, None, {}
        for batch in batches:
            for i, (shard, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if t is None:
                    if lists:
                        yield from answered(now, ids, lists)
                    now, ids, lists = shard, batch.column(4)[i].values, {}
                else:
                    lists[t] = np.frombuffer(batch.column(2)[i].as_py(), np.uint32), np.frombuffer(batch.column(3)[i].as_py(), np.int64)
        if lists:
            yield from answered(now, ids, lists)

    rows = index.select("shard", "t", "docs", "impacts", "ids").repartition("shard").sortWithinPartitions("shard", F.asc_nulls_first("t"))
    return rows.mapInArrow(run, "item long, row long, doc_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    return top_rows(found, k, F.desc("score"), F.asc_nulls_last("doc_id"), F.col("row"), by=("item",))


def ranked(documents: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of each item."""
    with scratch(documents.sparkSession) as keep:
        asked = cut_lineage(asked_terms(items))
        terms = cut_lineage(asked.select("term").distinct().withColumn("t", F.monotonically_increasing_id()))
        index = cut_lineage(impact_lists(cut_lineage(postings(documents, asked)), terms))
        shards = index.where("t IS NULL").count()
        first = index.where(F.pmod(F.xxhash64("shard"), F.lit(max(1, shards // FIRST))) == 0)
        numbered = cut_lineage(asked.join(terms, "term").select("item", "t", "c"))
        blocks = numbered.count() // block + 1
        out = None
        for b in range(blocks):
            rows = numbered.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toArrow()
            floors = _best(_searched(first, _Block(rows, {}), k), k).where(F.col("rank") == k - 1).select("item", "score").toArrow()
            known = dict(zip(floors["item"].to_pylist(), floors["score"].to_pylist()))
            found = cut_lineage(_best(_searched(index, _Block(rows, known), k), k))
            out = found if out is None else out.union(found)
        names = asked.select("item", "item_id").distinct()
        return keep(out.join(names, "item").select("item_id", (F.col("rank") + 1).cast("int").alias("rank"), "doc_id", "score"))


def op11_nra_search(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    return ranked(documents, items)


ORACLE = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents),
i AS (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS x
    FROM benchmark),
z AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS words FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, n, x, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS x FROM d) GROUP BY ALL),
f AS (SELECT x, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, z GROUP BY x),
s AS (
    SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // words))))) AS BIGINT) AS score
    FROM (SELECT item_id, x, count(*) AS c FROM i GROUP BY ALL) JOIN p USING (x) JOIN f USING (x), z GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20"""
