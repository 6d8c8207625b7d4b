"""Collocations by relational mining (SETM): occurrence relations, merge-joined by piece and adjacent position, length after length.

Texts are lower-cased (A-Z), split into pieces at ``. , ; : ! ?`` and line ends, and those into words at blanks and tabs.  All
counts are for each language (null: ``und``).

**Relations.**  The first relation holds the occurrences of frequent words: the word, and its place, which goes up by one from word to word of a
piece and jumps where a piece ends or a rarer word stands.  Texts are read twice for it, to count their words and to write it: rarer words, most of
the vocabulary, are never written.  A document's occurrences are one row of it, sorted by place, as columns of packed numbers.  It is
written as a table, and so is each further one.  To get phrases of length k, the relation of length k - 1 is merge-joined with itself one
place ahead, inside its rows, since both sides are sorted alike: the first k - 1 words and the last k - 1 words both have to be occurrences that are
left.  Their groups are counted (in the tasks first, whose counts go by hash to buckets and are added up there), those of ``least`` or more are frequent, and the occurrences of
frequent groups are semi-joined into the next relation, with the words that they cover.  The semi-join asks a table of bits (of bounded size)
for the frequent groups: it never turns a frequent one away, and an occurrence that it lets through for nothing is counted, exactly, and falls at
the next count.  No occurrence is shuffled; only counts are.

**Words** are 64-bit hashes in the relations.  If two words share one that is frequent, all is done again with another hash; where they share a
rarer one, neither is frequent, and no phrase has it.

**Scores** are whole numbers in decimals of 38 digits.  Each cut of a candidate looks its two parts up among the frequent groups (a
part of a frequent phrase is frequent), and the lowest cut counts.  Phrases become text only at the end, for the candidates that can be among the
first ``top`` of their language, ties included.

Empty and null texts have no words, repeated rows count each time, an empty table gives no rows.  A text of any length is one row of a relation
(9 bytes a word).  Columns besides text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import BASE, Sieve, Words, mixed, prefix_hashes, range_hashes, steps, text_bytes
from lodestone.session import cut_lineage, scratch

#: Occurrences a candidate has to have, words of the longest, candidates of a language, share (percent) of a shorter phrase inside a longer one.
LEAST, LONGEST, TOP, INSIDE = 30, 4, 2_000, 80
#: Different groups that a task holds before it hands their counts on, and buckets of groups for each shuffle partition.
HELD, BUCKETS = 1 << 20, 4
#: Buckets over which the groups of one first word are spread.
SPLITS = 8

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(10, 14)]] = True
_INSIDE = ~_BREAK
_INSIDE[[9, 32]] = False


class Tally:
    """Counts of groups (language, words) in a task; groups are told apart by all their words, hashes only sort them."""

    def __init__(self) -> None:
        self.langs: dict[str, int] = {}
        self.held: list[tuple[np.ndarray, np.ndarray]] = []     # columns: language and words, sorted by hash; counts
        self.size = 0

    def codes(self, langs: pa.Array) -> np.ndarray:
        """A number for the language of each row."""
        return np.array([self.langs.setdefault(x, len(self.langs)) for x in langs.to_pylist()], np.uint64)

    def add(self, columns: np.ndarray) -> None:
        if columns.shape[1]:
            self.held.append(_summed(columns, np.ones(columns.shape[1], np.int64)))
            self.size += self.held[-1][0].shape[1]

    def rows(self, buckets: int, all_of_it: bool) -> Iterator[pa.RecordBatch]:
        """Counts packed by language and bucket of the group's hash: all, or none while there is room."""
        if not self.held or not (all_of_it or self.size > HELD):
            return
        columns, n = _summed(*(np.concatenate(x, axis=-1) for x in zip(*self.held)))
        self.held, self.size = [(columns, n)], len(n)
        if all_of_it or self.size > HELD // 2:
            self.held, self.size = [], 0
            names = list(self.langs)
            # groups with a first word in common share ``SPLITS`` buckets, and stand together there: they pack well
            split = mixed(columns[-1]) % np.uint64(SPLITS if len(columns) > 2 else 1)
            bucket = mixed(columns[1] + split) % np.uint64(buckets)
            order = np.lexsort((*columns[:0:-1], columns[0], bucket))
            columns, n, bucket = columns[:, order], n[order], bucket[order]
            edges = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (columns[0, 1:] != columns[0, :-1]), [True]))).tolist()
            for low in range(0, len(edges) - 1, 64):
                part = list(zip(edges[low:low + 64], edges[low + 1:low + 65]))
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(bucket[a]) for a, _ in part], pa.int64()), pa.array([names[int(columns[0, a])] for a, _ in part], pa.string()),
                    pa.array([columns[1:, a:b].tobytes() for a, b in part], pa.binary()), pa.array([n[a:b].tobytes() for a, b in part], pa.binary())],
                    names=["bucket", "lang", "words", "n"])


PACKED = "bucket long, lang string, words binary, n binary"


def _summed(columns: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different columns and their sums.  They are sorted by a hash, and by themselves if two that differ share one."""
    key = group_hash(columns[0], columns[1:])
    order = np.argsort(key, kind="stable")
    new = np.ones(len(n), bool)
    new[1:] = (columns[:, order[1:]] != columns[:, order[:-1]]).any(axis=0)
    if (new[1:] & (key[order[1:]] == key[order[:-1]])).any():
        order = np.lexsort(columns)
        new[1:] = (columns[:, order[1:]] != columns[:, order[:-1]]).any(axis=0)
    begins = np.flatnonzero(new)
    return columns[:, order[begins]], np.add.reduceat(n[order], begins)


def group_hash(lang: np.ndarray, words: np.ndarray) -> np.ndarray:
    out = mixed(lang + np.uint64(len(words)))
    for word in words:
        out = mixed(out * np.uint64(BASE) + word)
    return out


def _buckets(frame: DataFrame) -> int:
    return BUCKETS * int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def summed(packed: DataFrame, k: int, least: int) -> DataFrame:
    """lang, w1 .. wk and f of groups with ``least`` or more, from packed counts: a task holds the groups of one bucket at a time."""
    names = [f"w{i + 1}" for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                columns = np.concatenate([p[0] for p in parts], axis=1)
                columns, n = _summed(np.concatenate([np.zeros((1, columns.shape[1]), np.uint64), columns]), np.concatenate([p[1] for p in parts]))
                many = n >= least
                yield pa.RecordBatch.from_arrays([pa.array([lang] * int(many.sum()), pa.string()), *(pa.array(c[many].view(np.int64)) for c in columns[1:]), pa.array(n[many])],
                                                 names=["lang", *names, "f"])

        for batch in batches:
            for bucket, lang, words, n in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    yield from out()
                    now, held = bucket, {}
                held.setdefault(lang, []).append((np.frombuffer(words, np.uint64).reshape(k, -1), np.frombuffer(n, np.int64)))
        yield from out()

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, ", ".join(["lang string", *(f"{w} long" for w in names), "f long"]))


RELATION = "lang string, ids binary, steps binary, alive binary"
FIRST = f"{RELATION}, word string, id long"
_FIRST = pa.schema([("lang", pa.string()), ("ids", pa.binary()), ("steps", pa.binary()), ("alive", pa.binary()), ("word", pa.string()), ("id", pa.int64())])


def _read(batch: pa.RecordBatch, family: int) -> Iterator[tuple[int, Words, np.ndarray]]:
    """The words of the texts (the first column) and their hashes, some rows at a time, with the first row's number."""
    swap = np.random.default_rng(family).permutation(256).astype(np.uint8)
    data, offsets = text_bytes(batch.column(0))
    for low, high in steps(offsets):
        found = Words(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], inside=_INSIDE)
        if len(found.starts):
            yield low, found, found.hashes if not family else range_hashes(prefix_hashes(swap[found.data]), found.starts, found.ends)


def _languages(documents: DataFrame) -> DataFrame:
    return documents.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))


def word_counts(documents: DataFrame, family: int = 0) -> DataFrame:
    """Packed counts of words."""
    buckets = _buckets(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            codes = tally.codes(batch.column(1))
            for low, found, ids in _read(batch, family):
                tally.add(np.stack([codes[low + found.of], ids]))
                yield from tally.rows(buckets, False)
        yield from tally.rows(buckets, True)

    return _languages(documents).mapInArrow(run, PACKED)


class Counted(NamedTuple):
    """Documents, and a sieve of their frequent words."""

    documents: DataFrame
    frequent: Sieve


def occurrences(counted: Counted, family: int = 0) -> DataFrame:
    """The first relation (lang, ids, steps, alive), one row a document; and its words (word, id) that a task met.

    A step is how far a place lies behind the one before: 1, or 2 for any more.
    """
    documents, frequent = counted

    def of(size: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)) for f in _FIRST], schema=_FIRST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in batches:
            langs = batch.column(2).to_numpy().view(np.uint64)
            for low, found, ids in _read(batch, family):
                kept = np.flatnonzero(frequent.passes(group_hash(langs[low + found.of], ids[None])))
                breaks = np.cumsum(_BREAK[found.data], dtype=np.int64)[found.starts]
                places = np.cumsum(np.append(1, 1 + (np.diff(breaks) > 0)))
                ahead = np.clip(np.diff(places[kept], prepend=0), 1, 2).astype(np.uint8)
                ids, first = ids[kept], np.searchsorted(kept, found.first)
                one, at = np.unique(ids, return_index=True)
                new = [(i, place) for i, place in zip(one.view(np.int64).tolist(), kept[at].tolist()) if i not in met]
                if new:
                    met.update(i for i, _ in new)
                    yield of(len(new), word=pa.array([found.word(place).decode() for _, place in new]), id=pa.array([i for i, _ in new]))
                    if len(met) > 300_000:
                        met.clear()
                own = [(r, a, b) for r, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())) if b > a]
                if own:
                    yield of(len(own), lang=batch.column(1).take(pa.array([low + r for r, _, _ in own], pa.int64())), ids=pa.array([ids[a:b].tobytes() for _, a, b in own], pa.binary()),
                             steps=pa.array([ahead[a:b].tobytes() for _, a, b in own], pa.binary()), alive=pa.array([b"\1" * (b - a) for _, a, b in own], pa.binary()))

    return _languages(documents).select("*", F.xxhash64("lang")).mapInArrow(run, FIRST)


class _Joined:
    """Rows of a relation of length k - 1, merge-joined with themselves one place ahead: where phrases of k words begin."""

    def __init__(self, batch: pa.RecordBatch, k: int) -> None:
        """Columns: lang, its hash, ids, steps and alive."""
        sizes = np.array([len(x) // 8 for x in (v.as_buffer() for v in batch.column(2))], np.int64)
        self.first = np.append(0, np.cumsum(sizes))
        self.of = np.repeat(np.arange(len(sizes)), sizes)
        self.ids = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64)
        self.places = np.cumsum(np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8), dtype=np.int64)
        self.lang = batch.column(1).to_numpy().view(np.uint64)[self.of]
        alive = np.frombuffer(b"".join(batch.column(4).to_pylist()), bool)
        next_one = (self.of[1:] == self.of[:-1]) & (self.places[1:] == self.places[:-1] + 1)
        self.at = np.flatnonzero(alive[:-1] & alive[1:] & next_one)
        self.words = np.stack([self.ids[self.at + t] for t in range(k)]) if len(self.at) else np.zeros((k, 0), np.uint64)


def joined_counts(relation: DataFrame, k: int) -> DataFrame:
    """Packed counts of the phrases of k words."""
    buckets = _buckets(relation)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            if batch.num_rows:
                rows = _Joined(batch, k)
                tally.add(np.concatenate([tally.codes(batch.column(0))[rows.of[rows.at]][None], rows.words]))
                yield from tally.rows(buckets, False)
        yield from tally.rows(buckets, True)

    return relation.mapInArrow(run, PACKED)


def joined_relation(relation: DataFrame, k: int, frequent: Sieve) -> DataFrame:
    """The relation of length k: the words that occurrences of frequent phrases cover, and at which of them one begins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _Joined(batch, k)
            at = rows.at[frequent.passes(group_hash(rows.lang[rows.at], rows.words))]
            alive, covered = np.zeros((2, len(rows.ids)), bool)
            alive[at] = True
            for t in range(k):
                covered[at + t] = True
            left = np.append(0, np.cumsum(covered))[rows.first]
            ids, alive = rows.ids[covered], alive[covered]
            ahead = np.clip(np.diff(rows.places[covered], prepend=0), 1, 2).astype(np.uint8)
            own = [(r, a, b) for r, (a, b) in enumerate(zip(left[:-1].tolist(), left[1:].tolist())) if b > a]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array([r for r, _, _ in own], pa.int64())),
                *(pa.array([column[a:b].tobytes() for _, a, b in own], pa.binary()) for column in (ids, ahead, alive))], names=["lang", "ids", "steps", "alive"])

    return relation.mapInArrow(run, RELATION)


def _sieve(groups: DataFrame, k: int) -> Sieve:
    """A sieve of frequent groups (lang, w1 .. wk)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_numpy().view(np.uint64) for i in range(k + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(group_hash(columns[0], np.stack(columns[1:])).view(np.int64))], names=["hash"])

    return Sieve(cut_lineage(groups.select(F.xxhash64("lang"), *(f"w{i + 1}" for i in range(k))).mapInArrow(run, "hash long")), "hash")


def frequent_phrases(documents: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases (lang, phrase as an array of word hashes, f), the words (id, word), and for each lang n, its number of words."""
    columns = ["lang", F.xxhash64("lang"), "ids", "steps", "alive"]
    with scratch(documents.sparkSession) as keep:
        with scratch(documents.sparkSession) as stay:
            for family in range(1000):
                counts = cut_lineage(summed(word_counts(documents, family), 1, 1))
                sizes = stay(counts.groupBy("lang").agg(F.sum("f").alias("n")))
                found = [stay(counts.where(F.col("f") >= least))]
                whole = cut_lineage(occurrences(Counted(documents, _sieve(found[0], 1)), family))
                words = whole.where("word IS NOT NULL").join(found[0].select(F.col("w1").alias("id")).distinct(), "id", "left_semi")
                words = stay(words.groupBy("id").agg(F.min("word").alias("word"), F.max("word").alias("other")))
                if words.where("word <> other").isEmpty():
                    break
            words = words.drop("other")
            relation = whole.where("ids IS NOT NULL").select(*columns)
            for k in range(2, longest + 1):
                with scratch(documents.sparkSession) as further:
                    found.append(further(summed(joined_counts(relation, k), k, least)))
                    if k < longest:
                        relation = further(joined_relation(relation, k, _sieve(found[-1], k))).select(*columns)
            phrases = None
            for k, groups in enumerate(found, 1):
                part = groups.select("lang", F.array(*(f"w{i + 1}" for i in range(k))).alias("phrase"), "f")
                phrases = part if phrases is None else phrases.union(part)
            phrases = stay(phrases)
        return keep(phrases), keep(words), keep(sizes)


def collocations(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``top`` candidates of each language."""
    with scratch(documents.sparkSession) as keep:
        phrases, words, sizes = frequent_phrases(documents, least, longest)
        candidates = phrases.where(F.size("phrase") > 1).withColumnRenamed("f", "a")
        parts = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("cut")).select(
            "*", F.slice("phrase", F.lit(1), F.col("cut")).alias("left"), F.slice("phrase", F.col("cut") + 1, F.size("phrase") - F.col("cut")).alias("right"))
        for side, name in (("left", "l"), ("right", "r")):
            parts = parts.join(phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
        score = F.expr("(CAST(a AS DECIMAL(28, 0)) * 2000000BD) div CAST(l + r AS DECIMAL(20, 0))").alias("score")
        cuts = parts.select("lang", "phrase", "a", "l", "r", "cut", score)
        scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low")).select("lang", "phrase", "a", "low.l", "low.r", "low.score")
        longer = candidates.where(F.size("phrase") > 2).select("lang", "phrase", "a", F.explode(F.sequence(F.lit(2), F.size("phrase") - 1)).alias("size"))
        longer = longer.select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.size("phrase") - F.col("size") + 1)).alias("at"))
        holds = longer.groupBy("lang", F.slice("phrase", F.col("at"), F.col("size")).alias("phrase")).agg(F.max("a").alias("most"))
        alone = scored.join(holds, ["lang", "phrase"], "left").where(F.expr(
            f"most IS NULL OR 100BD * CAST(most AS DECIMAL(20, 0)) < {inside}BD * CAST(a AS DECIMAL(20, 0))")).drop("most")
        best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
        ahead = cut_lineage(alone.withColumn("place", F.rank().over(best)).where(F.col("place") <= top).drop("place"))
        spelt = ahead.select("lang", "phrase", F.posexplode("phrase").alias("at", "id")).join(words, "id")
        spelt = spelt.groupBy("lang", "phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("text"))
        full = ahead.join(spelt, ["lang", "phrase"]).join(sizes, "lang")
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "text")
        full = full.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
        return keep(full.select("lang", "rank", F.col("text").alias("phrase"), "a", "l", "r", "n", "score"))


def op12_collocations(documents: DataFrame) -> DataFrame:
    """The 2,000 best collocations of each language."""
    return collocations(documents)


ORACLE = r"""
WITH d AS (
    SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
           string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p
    FROM documents),
e AS (SELECT lang, regexp_extract_all(unnest(p), '[^\x20\x09]+') AS w FROM d),
o AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM e),
s AS (SELECT lang, count(*) AS n FROM o GROUP BY lang),
g AS (SELECT lang, w[i:i + k - 1] AS g FROM o, (VALUES (1), (2), (3), (4)) t(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, g, f AS a, unnest(range(1, len(g))) AS cut FROM f WHERE len(g) > 1),
x AS (
    SELECT c.lang, c.g, a, cut, l.f AS l, r.f AS r, CAST((a::HUGEINT * 2000000) // (l.f + r.f) AS BIGINT) AS score
    FROM c JOIN f l ON l.lang = c.lang AND l.g = c.g[1:cut] JOIN f r ON r.lang = c.lang AND r.g = c.g[cut + 1:]),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
u AS (SELECT lang, g, f, unnest(range(2, len(g))) AS k FROM f WHERE len(g) > 2),
v AS (SELECT lang, g, f, k, unnest(range(1, len(g) - k + 2)) AS i FROM u),
h AS (SELECT lang, g[i:i + k - 1] AS g, max(f) AS most FROM v GROUP BY ALL),
z AS (
    SELECT y.lang, array_to_string(y.g, ' ') AS phrase, a, l, r, score FROM y LEFT JOIN h ON h.lang = y.lang AND h.g = y.g
    WHERE most IS NULL OR 100 * most < 80 * a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
SELECT q.lang, rank, phrase, a, l, r, n, score FROM q JOIN s ON s.lang = q.lang WHERE rank <= 2000"""
