"""Phrase collocations from depth-limited count tries.

Each task counts its phrases in tries, cut them by prefix, and ships each range of prefixes as one
sorted, serialised piece; the range's owner merges all tasks' pieces. A trie has two levels first.
Phrases of three and four words can only be frequent where each two neighbours are, so the second
pass walks on from frequent pairs alone. In the merged trie a phrase's parent, its parent's parent
and so on are its left parts; its suffix link, that node's suffix link and so on its right parts.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Bloom, Words, _table, materialize, mix, read, tidy

#: Words of a phrase at most, occurrences at least, phrases that are returned of a language.
DEPTH, LEAST, TOP = 4, 30, 2_000
#: A candidate goes if a longer one that contains it occurs at least so many hundredths as often.
WITHIN = 80
#: The best possible score, of parts that occur nowhere else.
FULL = 2_000_000
#: Words that a task counts before it ships their trie, and nodes that an owner gathers before it merges them.
FLUSH, GATHER = 1 << 21, 1 << 22
OTHER = "und"

_BREAKS = _table((0x0A, 0x0D)) | _table(*[(ord(c), ord(c)) for c in ".,;:!?"])
#: Words are runs of anything but space, tab and what ends a piece.
WORDS = Words(_BREAKS | _table((0x20, 0x20), (0x09, 0x09)))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_HALF, _LOW = np.uint64(32), np.uint64((1 << 32) - 1)


def _ranked(columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """A number for each row that orders rows as their columns do, and what the numbers' rows are."""
    values, rank = np.unique(columns[-1], return_inverse=True)
    rank = rank.astype(np.uint64)
    if len(columns) == 1:
        return rank, [values]
    before, rows = _ranked(columns[:-1])
    keys, rank = np.unique((before << _HALF) | rank, return_inverse=True)
    return rank.astype(np.uint64), [*[r[keys >> _HALF] for r in rows], values[keys & _LOW]]


def tally(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of ``columns`` in order, with the sums of their counts (1 each if None)."""
    if not len(columns[0]):
        return columns, np.zeros(0, np.int64)
    values, key = np.unique(columns[-1], return_inverse=True)
    key, rows = key.astype(np.uint64), []
    if len(columns) > 1:
        before, rows = _ranked(columns[:-1])
        key |= before << _HALF
    if counts is None:
        key = np.sort(key)
    else:
        order = np.argsort(key, kind="stable")  # merges what is sorted already
        key, counts = key[order], counts[order]
    begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    total = np.diff(np.append(begins, len(key))) if counts is None else np.add.reduceat(counts, begins)
    key = key[begins]
    return [*[r[key >> _HALF] for r in rows], values[key & _LOW]], total.astype(np.int64)


def pack(columns: list[np.ndarray], counts: np.ndarray) -> tuple:
    """One level of a trie as sorted arrays: each column's runs within the runs of those before it."""
    out, edge = [], np.zeros(len(counts), bool)
    edge[:1] = True
    for c in columns[:-1]:
        edge[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(edge)
        out.append((c[at], np.diff(np.append(at, len(c))).astype(np.uint32)))
    small = counts.astype(np.uint8) if len(counts) and counts.max() < 256 else counts
    return out, columns[-1], small


def unpack(level: tuple) -> tuple[list[np.ndarray], np.ndarray]:
    out, last, counts = level
    return [*[np.repeat(c, n) for c, n in out], last], counts.astype(np.int64)


def _ranges(columns: list[np.ndarray], ranges: int) -> np.ndarray:
    """The range of each node's prefix of up to three words, so that no frequent word or pair makes a large one."""
    key = columns[0]
    for c in columns[1:3]:
        key = mix(key * _STEP + c)
    return (mix(key) % np.uint64(ranges)).astype(np.int64)


def _shipped(lang: str, columns: list[np.ndarray], ranges: int, out: dict) -> None:
    """Counts the phrases and adds them to ``out``, by range."""
    columns, counts = tally(columns)
    where = _ranges(columns, ranges)
    order = np.argsort(where, kind="stable")  # within a range the nodes stay sorted
    cuts = np.searchsorted(where[order], np.arange(ranges + 1))
    for r in np.flatnonzero(np.diff(cuts)):
        own = order[cuts[r] : cuts[r + 1]]
        out.setdefault(int(r), []).append((lang, len(columns), pack([c[own] for c in columns], counts[own])))


def _words_of(batch: pa.RecordBatch):
    """Yields (lang, hashes, joined, bytes, starts, ends) of each text; ``joined`` says whether a word and the next are in one piece."""
    langs = pc.fill_null(batch.column(0), OTHER).to_pylist()
    for row, hashes, data, starts, ends in WORDS.texts(batch.column(1)):
        if len(hashes):
            breaks = np.flatnonzero(_BREAKS[data])
            piece = np.searchsorted(breaks, starts)
            joined = np.append(piece[1:] == piece[:-1], False)
            yield langs[row], hashes, joined, data, starts, ends


def count_pairs(docs: DataFrame, ranges: int, flush: int = FLUSH) -> DataFrame:
    """(range, piece): tries of two levels, cut by prefix."""

    def ship(held: dict) -> pa.RecordBatch:
        out: dict[int, list] = {}
        for lang, parts in held.items():
            h, joined = (np.concatenate(x) for x in zip(*parts, strict=True))
            _shipped(lang, [h], ranges, out)
            at = np.flatnonzero(joined)
            _shipped(lang, [h[at], h[at + 1]], ranges, out)
        return _pieces(out)

    def step(batches):
        held, size = {}, 0
        for b in batches:
            for lang, h, joined, *_ in _words_of(b):
                held.setdefault(lang, []).append((h, joined))
                size += len(h)
                if size >= flush:
                    yield ship(held)
                    held, size = {}, 0
        if held:
            yield ship(held)

    return docs.mapInArrow(step, "range int, piece binary")


def _pieces(out: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([pickle.dumps(x, 5) for x in out.values()], pa.binary())], ["range", "piece"])


def count_longer(docs: DataFrame, pairs: Bloom, ranges: int, depth: int, flush: int = FLUSH) -> DataFrame:
    """(range, piece): nodes of three words up to ``depth``, and the words that any pair of ``pairs`` has."""
    shared = docs.sparkSession.sparkContext.broadcast(pairs)

    def ship(held: dict, spelt: dict) -> pa.RecordBatch:
        out: dict[int, list] = {}
        for lang, parts in held.items():
            h, linked = (np.concatenate(x) for x in zip(*parts, strict=True))
            run = linked.copy()
            for n in range(3, depth + 1):
                run[: 2 - n] &= linked[n - 2 :]
                run[2 - n :] = False
                at = np.flatnonzero(run)
                _shipped(lang, [h[at + i] for i in range(n)], ranges, out)
        for (lang, h), word in spelt.items():
            out.setdefault(int(mix(np.array([h], np.uint64))[0] % np.uint64(ranges)), []).append((lang, 0, (h, word)))
        return _pieces(out)

    def step(batches):
        held, spelt, size = {}, {}, 0
        seen: dict[str, np.ndarray] = {}  # sorted hashes of a language's words in `spelt`
        for b in batches:
            for lang, h, joined, data, starts, ends in _words_of(b):
                linked = joined.copy()
                at = np.flatnonzero(joined)
                linked[at] = shared.value.has(pair_key(lang, h[at], h[at + 1]))
                use = linked.copy()
                use[1:] |= linked[:-1]
                at = np.flatnonzero(use)
                if not len(at):
                    continue
                known = seen.get(lang, np.zeros(0, np.uint64))
                new, first = np.unique(h[at], return_index=True)
                fresh = np.flatnonzero(~np.isin(new, known, assume_unique=True))
                for i in fresh:
                    k = at[first[i]]
                    spelt[lang, int(new[i])] = bytes(data[starts[k] : ends[k]]).lower().decode("utf-8", "replace")
                if len(fresh):
                    seen[lang] = np.union1d(known, new[fresh])
                # a node never spans texts, as a text's last word is not linked
                held.setdefault(lang, []).append((h, linked))
                size += len(h)
                if size >= flush:
                    yield ship(held, spelt)
                    held, spelt, size, seen = {}, {}, 0, {}
        if held:
            yield ship(held, spelt)

    return docs.mapInArrow(step, "range int, piece binary")


def _seed(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))


def pair_key(lang: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a * _STEP + _seed(lang)) * _STEP + b)


NODES = "lang string, w array<long>, f long, word string"


def merge(pieces: DataFrame, ranges: int, least: int, gather: int = GATHER) -> DataFrame:
    """``NODES`` of the merged tries: phrases (hashes of words) that occur ``least`` times or more.

    Beside them, of each partition, the root of each language with the sum of its words (``w`` is
    empty), and once each word's spelling (``f`` is null).
    """

    def step(batches):
        tries: dict[tuple[str, int], list] = {}
        spelt: dict[tuple[str, int], str] = {}
        size, most = 0, gather

        def fold(key: tuple[str, int]) -> None:
            parts = [unpack(x) if len(x) == 3 else x for x in tries[key]]
            columns = [np.concatenate(c) for c in zip(*[p[0] for p in parts], strict=True)]
            tries[key] = [tally(columns, np.concatenate([p[1] for p in parts]))]

        for b in batches:
            for piece in b.column(1):
                for lang, depth, level in pickle.loads(piece.as_buffer()):
                    if not depth:
                        spelt[lang, level[0]] = level[1]
                        continue
                    tries.setdefault((lang, depth), []).append(level)
                    size += len(level[2])
            if size > most:
                for key in tries:
                    fold(key)
                # what stays is distinct; the next merge waits for as much again
                size = sum(len(x[0][1]) for x in tries.values())
                most = max(gather, 2 * size)
        for (lang, depth), _ in list(tries.items()):
            fold((lang, depth))
            columns, counts = tries.pop((lang, depth))[0]
            if depth == 1:
                yield _nodes([(lang, [], int(counts.sum()), None)])
            keep = counts >= least
            words = np.stack([c[keep] for c in columns], axis=1).view(np.int64)
            for at in range(0, len(words), 1 << 16):
                part, f = words[at : at + (1 << 16)], counts[keep][at : at + (1 << 16)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * depth), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), lists, pa.array(f), pa.nulls(len(part), pa.string())], ["lang", "w", "f", "word"])
        items = list(spelt.items())
        for at in range(0, len(items), 1 << 14):
            yield _nodes([(lang, [h - (1 << 64) if h >> 63 else h], None, word) for (lang, h), word in items[at : at + (1 << 14)]])

    return pieces.repartitionById(ranges, "range").mapInArrow(step, NODES)


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.list_(pa.int64()), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["lang", "w", "f", "word"])


def collocations(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, top: int = TOP, flush: int = FLUSH, gather: int = GATHER) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two to ``depth`` words.

    Of rows (lang, text), a null lang counts as ``und``, a null text as empty. A-Z are lower-cased.
    ``a`` is how often the phrase occurs in one piece of text, ``l`` and ``r`` the parts of its
    weakest cut, of equals that after the fewest words, ``n`` all words of the language, ``score``
    floor(2000000 a / (l + r)). Phrases that occur fewer than ``least`` times are no candidates; those
    that a longer candidate contains at 80 hundredths of their count or more are left out. Of a
    language's phrases the first ``top`` by score, count (both descending) and phrase are returned.
    Repeated rows count each time; texts of any length are read whole; an empty table gives no rows.
    Words are told apart by a hash of 64 bits. Other columns don't matter.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("length(text) > 0")
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    low = materialize(merge(count_pairs(docs, ranges, flush), ranges, least, gather), "phrase-pairs")
    nodes = low.where("size(w) > 0").select("lang", "w", "f")

    def keys(batches):
        for b in batches:
            w = b.column(1).flatten().to_numpy().view(np.uint64).reshape(-1, 2)
            out = np.zeros(len(w), np.uint64)
            langs = np.array(b.column(0).to_pylist(), object)
            for lang in set(langs):
                own = np.flatnonzero(langs == lang)
                out[own] = pair_key(lang, w[own, 0], w[own, 1])
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], ["k"])

    pairs = Bloom.of(nodes.where("size(w) = 2").select("lang", "w").mapInArrow(keys, "k long"), "k")
    high = materialize(merge(count_longer(docs, pairs, ranges, depth, flush), ranges, least, gather), "phrase-longer")
    nodes = nodes.unionByName(high.where("f IS NOT NULL").select("lang", "w", "f"))
    spelt = high.where("f IS NULL").select("lang", F.col("w")[0].alias("h"), "word")

    # up the trie and along its suffix links, level by level
    none = F.array().cast("array<bigint>")
    level = nodes.where("size(w) = 1").select("lang", "w", "f", none.alias("lefts"), none.alias("rights"))
    candidates = None
    for n in range(2, depth + 1):
        up = level.select("lang", F.col("w").alias("parent"), F.concat("lefts", F.array("f")).alias("lefts"))
        link = level.select("lang", F.col("w").alias("link"), F.concat(F.array("f"), "rights").alias("rights"))
        own = nodes.where(F.size("w") == n).select("*", F.slice("w", 1, n - 1).alias("parent"), F.slice("w", 2, n - 1).alias("link"))
        level = materialize(own.join(up, ["lang", "parent"]).join(link, ["lang", "link"]).select("lang", "w", "f", "lefts", "rights"), f"phrases-{n}")
        candidates = level if candidates is None else candidates.unionByName(level)

    # whatever contains a phrase contains an extension by one word that contains it and is as frequent
    longer = candidates.where("size(w) > 2")
    inner = longer.select("lang", F.expr("slice(w, 1, size(w) - 1)").alias("w"), "f").unionByName(longer.select("lang", F.expr("slice(w, 2, size(w) - 1)").alias("w"), "f"))
    most = inner.groupBy("lang", "w").agg(F.max("f").alias("most"))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    candidates = candidates.join(most, ["lang", "w"], "left").where(F.col("most").isNull() | (exact("most") * 100 < exact("f") * WITHIN))
    cut = F.expr(
        f"array_min(transform(sequence(1, size(w) - 1), k -> struct((cast({FULL} as decimal(7,0)) * cast(f as decimal(19,0))) div "
        "(cast(lefts[k - 1] as decimal(19,0)) + cast(rights[k - 1] as decimal(19,0))) as score, k, lefts[k - 1] as l, rights[k - 1] as r)))"
    )
    scored = candidates.select("lang", "w", F.col("f").alias("a"), cut.alias("cut")).select("lang", "w", "a", "cut.l", "cut.r", "cut.score")
    # ties at the end stay until they are spelt
    placed = scored.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= top)
    placed = materialize(placed, "phrases-best")
    words = placed.select("lang", "w", F.posexplode("w").alias("at", "h")).join(spelt.dropDuplicates(["lang", "h"]), ["lang", "h"])
    phrases = words.groupBy("lang", "w").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    totals = low.where("size(w) = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = placed.join(phrases, ["lang", "w"]).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@tidy
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, '{OTHER}') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])) AS w FROM words, range(1, {DEPTH + 1}) t(k) WHERE len(w) >= k),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
nodes AS MATERIALIZED (SELECT lang, w, count(*) AS f FROM grams GROUP BY lang, w HAVING count(*) >= {LEAST}),
cuts AS (
  SELECT c.lang, c.w, c.f AS a, k, l.f AS l, r.f AS r, CAST({FULL} * CAST(c.f AS HUGEINT) // (l.f + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, len(w))) AS k FROM nodes WHERE len(w) > 1) c
  JOIN nodes l ON l.lang = c.lang AND l.w = c.w[1 : c.k] JOIN nodes r ON r.lang = c.lang AND r.w = c.w[c.k + 1 : len(c.w)]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
inner_most AS (
  SELECT lang, w, max(f) AS most FROM (
    SELECT c.lang, c.w[i : i + k - 1] AS w, c.f FROM nodes c, range(2, {DEPTH}) t(k), range(1, {DEPTH}) u(i) WHERE k < len(c.w) AND i + k - 1 <= len(c.w)) GROUP BY lang, w),
left_over AS (SELECT b.* FROM best b LEFT JOIN inner_most i USING (lang, w) WHERE i.most IS NULL OR 100 * i.most < {WITHIN} * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM (SELECT *, array_to_string(w, ' ') AS phrase FROM left_over))
JOIN totals USING (lang) WHERE rank <= {TOP}"""
