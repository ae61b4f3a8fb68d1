"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

A token's probability is that of its class times that of the token within it. Frequent tokens share
classes of a few members each, which have a softmax of their own; all other words are in classes by
their last byte, where each has its share of the class's count. Features are the words before, hashed: the
last one, the last two, and the one before the last alone. Weights begin at 0 over log frequencies, so
the untrained model is the base; each task makes gradient steps over its own documents, and the
tasks' weights are averaged, round by round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED, id_fold, materialize, mix, read, tidy

#: Classes of frequent tokens, members of each, and classes of other words.
CLASSES, MEMBERS, OTHERS = 16, 32, 16
#: Words that count as themselves before another; a rarer one counts as its class there.
CONTEXT = 4_096
#: Words whose counts every task has; those of the rest are joined. This bounds what is broadcast.
COMMON = 1 << 18
#: Buckets of features, for classes and for members: a power of two, of 16 bits at most.
BUCKETS = 1 << 14
#: Each training document is in one of so many rounds.
ROUNDS = 2
#: Tokens of a gradient step, its rate, and the pull towards 0 after each round.
STEP, RATE, DECAY = 4_096, 0.1, 1e-3
#: Tokens that a task counts, or scores at once.
FLUSH = 1 << 20
#: Distinct words that a task holds before it passes their counts on.
HELD = 1 << 20
#: Rows that are sent, and summed, together.
CHUNK_ROWS = 1 << 10

#: The end of a text, as a token; and what stands before its first.
END, BEGIN = np.uint64(0x656E64206F662074), np.uint64(0x626567696E6E696E)
_P = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.int64(-1)
_BUCKET = np.uint64(BUCKETS - 1)


def other_class(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class that words have by their last byte, A-Z as a-z."""
    last = data[ends - 1]
    last = np.where((last >= 65) & (last <= 90), last + 32, last)
    return (mix(last.astype(np.uint64) * _P + np.uint64(1)) % np.uint64(OTHERS)).astype(np.int64)


class Tokens:
    """Tokens of some texts, one after the other, each text ended by ``END``."""

    def __init__(self, texts: list[tuple[np.ndarray, np.ndarray]]):
        self.sizes = np.array([len(h) + 1 for h, _ in texts], np.int64)
        self.last = np.cumsum(self.sizes) - 1
        total = int(self.sizes.sum())
        word = np.ones(total, bool)
        word[self.last] = False
        self.hash, self.other = np.full(total, END), np.zeros(total, np.int64)
        if word.any():
            self.hash[word] = np.concatenate([h for h, _ in texts])
            self.other[word] = np.concatenate([o for _, o in texts])

    def before(self, symbols: np.ndarray, n: int) -> np.ndarray:
        """The symbol ``n`` tokens before each, ``BEGIN`` where the text hadn't begun."""
        out = np.full(len(symbols), BEGIN)
        out[n:] = symbols[: len(symbols) - n]
        first = self.last - self.sizes + 1
        for i in range(n):
            at = first + i
            out[at[at <= self.last]] = BEGIN
        return out


def tokens_of(column: pa.Array, limit: int):
    """Yields (first row, Tokens) for runs of whole texts of about ``limit`` tokens; null is an empty text."""
    held, size, first = [], 0, 0
    for row, hashes, data, _, ends in SPACED.texts(column):
        held.append((hashes, other_class(data, ends)))
        size += len(hashes) + 1
        if size >= limit:
            yield first, Tokens(held)
            held, size, first = [], 0, row + 1
    if held:
        yield first, Tokens(held)


class Vocabulary:
    """Counts of common tokens, and the sums over all others by class. Its size is bounded by ``COMMON``."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, others: np.ndarray, other_sums: np.ndarray, other_kinds: np.ndarray, total: int, distinct: int):
        order = np.argsort(hashes)
        #: sorted; ``rank`` is the place by falling count
        self.hashes, self.counts, self.others, self.rank = hashes[order], counts[order], others[order], order
        self.total, self.distinct = total, distinct
        self.members = min(len(hashes), CLASSES * MEMBERS)
        # what the classes by last byte hold: all words but the members, and one unseen word each
        tail = order >= self.members
        self.sums = other_sums + np.bincount(self.others[tail], self.counts[tail], OTHERS)
        self.kinds = other_kinds + np.bincount(self.others[tail], minlength=OTHERS)
        # log frequencies: of classes, and of members within theirs
        n = np.zeros(CLASSES * MEMBERS)
        n[order[~tail]] = self.counts[~tail]
        n = n.reshape(CLASSES, MEMBERS)
        shares = np.append(n.sum(axis=1), self.sums + self.kinds + 1)
        with np.errstate(divide="ignore"):
            self.class_bias = np.log(shares / shares.sum()).astype(np.float32)
            # an empty class has no members to be told apart
            self.member_bias = np.where(n > 0, np.log(n / np.maximum(n.sum(axis=1, keepdims=True), 1)), -np.inf).astype(np.float32)

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """The place among ``hashes`` of each token, -1 where it isn't common."""
        if not len(self.hashes):
            return np.full(len(hashes), _NONE)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, _NONE)


class Events:
    """What the model is to predict, and from which features."""

    def __init__(self, tokens: Tokens, vocabulary: Vocabulary):
        self.place = vocabulary.place(tokens.hash)
        known = self.place >= 0
        rank = np.where(known, vocabulary.rank[self.place] if len(vocabulary.rank) else 0, np.iinfo(np.int64).max)
        self.member = rank < vocabulary.members
        self.cls = np.where(self.member, rank // MEMBERS, CLASSES + tokens.other)
        self.slot = np.where(self.member, rank % MEMBERS, 0)
        symbol = np.where(rank < CONTEXT, tokens.hash, tokens.other.astype(np.uint64))
        one, two = tokens.before(symbol, 1), tokens.before(symbol, 2)
        keys = mix(one + _P), mix(mix(two * _P + np.uint64(2)) + one), mix(two * _P + np.uint64(3))
        self.features = np.stack([(k & _BUCKET).astype(np.uint16) for k in keys])
        mine = self.cls[self.member].astype(np.uint64)
        self.member_features = np.stack([(((k[self.member] ^ mine) * _P >> np.uint64(40)) & _BUCKET).astype(np.uint16) for k in keys])


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def _look_up(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    out = np.take(weights, features[0], axis=0)
    for f in features[1:]:
        out += np.take(weights, f, axis=0)
    return out


class Weights:
    """For each bucket a row of class weights and one of member weights; a row's last number sums its squared gradients."""

    WIDTHS = CLASSES + OTHERS, MEMBERS

    def __init__(self, start: Weights | None = None):
        self.tables = tuple(np.zeros((BUCKETS, w), np.float32) if start is None else start.tables[k].copy() for k, w in enumerate(self.WIDTHS))
        self.squares = tuple(np.zeros(BUCKETS, np.float32) if start is None else start.squares[k].copy() for k in (0, 1))

    def moved(self, start: Weights, times: float):
        """Yields (chunk, rows, values): how far the rows that have changed since ``start`` moved, times a factor."""
        for k in (0, 1):
            rows = np.flatnonzero(self.squares[k] != start.squares[k])
            values = np.column_stack([(self.tables[k] - start.tables[k])[rows], (self.squares[k] - start.squares[k])[rows]]) * np.float32(times)
            cuts = np.searchsorted(rows, np.arange(0, BUCKETS + 1, CHUNK_ROWS))
            for c in np.flatnonzero(np.diff(cuts)):
                own = slice(cuts[c], cuts[c + 1])
                yield k * (BUCKETS // CHUNK_ROWS) + int(c), (rows[own] % CHUNK_ROWS).astype("<i4"), values[own].astype("<f4")

    def move(self, chunk: int, rows: np.ndarray, values: np.ndarray) -> None:
        k, c = divmod(chunk, BUCKETS // CHUNK_ROWS)
        self.tables[k][rows + c * CHUNK_ROWS] += values[:, :-1]
        self.squares[k][rows + c * CHUNK_ROWS] += values[:, -1]

    def shares(self, events: Events, v: Vocabulary, own: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Softmax over classes of the tokens ``own``, and over members of the members ``mine`` among all members."""
        classes = _look_up(self.tables[0], events.features[:, own])
        classes += v.class_bias
        members = _look_up(self.tables[1], events.member_features[:, mine])
        members += v.member_bias[events.cls[events.member][mine]]
        return _softmax(classes), _softmax(members) if len(members) else members

    def learn(self, events: Events, v: Vocabulary) -> None:
        """Gradient steps of ``STEP`` tokens each, in order; each row has a rate by its own gradients."""
        at_member = np.cumsum(events.member) - 1
        cls, slot = events.cls, events.slot[events.member]
        for at in range(0, len(cls), STEP):
            own = np.arange(at, min(at + STEP, len(cls)))
            mine = at_member[own[events.member[own]]]
            classes, members = self.shares(events, v, own, mine)
            classes[np.arange(len(own)), cls[own]] -= 1
            self._descend(0, events.features[:, own], classes)
            if len(mine):
                members[np.arange(len(mine)), slot[mine]] -= 1
                self._descend(1, events.member_features[:, mine], members)

    def _descend(self, which: int, features: np.ndarray, gradient: np.ndarray) -> None:
        rows = features.ravel()
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        begins = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        sums = np.add.reduceat(np.take(gradient, order % features.shape[1], axis=0), begins, axis=0)
        rows = rows[begins]
        squares = self.squares[which]
        squares[rows] += (sums * sums).mean(axis=1)
        self.tables[which][rows] -= (RATE / np.sqrt(squares[rows] + 1e-8))[:, None] * sums

    def log10(self, events: Events, v: Vocabulary) -> np.ndarray:
        """log10 of each token's probability; of words by last byte without their own count's part."""
        out = np.zeros(len(events.cls))
        at_member = np.cumsum(events.member) - 1
        slot = events.slot[events.member]
        with np.errstate(divide="ignore"):
            tail = -np.log10(v.sums + v.kinds + 1)
        for at in range(0, len(out), STEP):
            own = np.arange(at, min(at + STEP, len(out)))
            is_member = events.member[own]
            mine = at_member[own[is_member]]
            classes, members = self.shares(events, v, own, mine)
            # shares are bounded away from 0, as a softmax of floats can round to it
            p = np.log10(np.maximum(classes[np.arange(len(own)), events.cls[own]], 1e-30).astype(np.float64))
            if len(mine):
                p[is_member] += np.log10(np.maximum(members[np.arange(len(mine)), slot[mine]], 1e-30).astype(np.float64))
            p[~is_member] += tail[events.cls[own][~is_member] - CLASSES]
            out[own] = p
        return out


class Model:
    """What scoring needs but the rare words' counts, which stay a table (h, c)."""

    def __init__(self, vocabulary: Broadcast, weights: Weights, counts: DataFrame):
        self.vocabulary, self.weights, self.counts = vocabulary, weights, counts


def count_words(docs: DataFrame) -> DataFrame:
    """(h, other, c): how often each token occurs in the ``text`` of ``docs``, ends included."""

    def step(batches):
        hashes, others, counts, held = [], [], [], 0

        def shrunk():
            h, first, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
            return h, np.concatenate(others)[first], np.bincount(inverse, np.concatenate(counts)).astype(np.int64)

        def out(h, o, c):
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(o.astype(np.int32)), pa.array(c)], ["h", "other", "c"])

        for b in batches:
            for _, t in tokens_of(b.column(0), FLUSH):
                h, first, c = np.unique(t.hash, return_index=True, return_counts=True)
                hashes.append(h)
                others.append(t.other[first])
                counts.append(c)
                held += len(h)
                if held >= HELD:
                    h, o, c = shrunk()
                    if len(h) >= HELD // 2:
                        yield out(h, o, c)
                        hashes, others, counts, held = [], [], [], 0
                    else:
                        hashes, others, counts, held = [h], [o], [c], len(h)
        if held:
            yield out(*shrunk())

    return docs.select("text").mapInArrow(step, "h long, other int, c long").groupBy("h").agg(F.min("other").alias("other"), F.sum("c").alias("c"))


def vocabulary_of(counts: DataFrame, common: int = COMMON) -> Vocabulary:
    """Of at most ``common`` of the most frequent tokens: those of whole octaves' eighths of counts, as many as fit."""
    whole = counts.agg(F.sum("c").alias("total"), F.count("*").alias("distinct")).first()
    band = F.floor(F.log2("c") * 8).cast("int")
    # counts have at most 64 octaves, so the bands are few
    bands = sorted(counts.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.band)
    sizes = np.cumsum([r.n for r in bands])
    fit = int(np.searchsorted(sizes, common, "right"))
    top = counts.where(band >= bands[fit - 1].band) if fit else counts.where("false")

    def packed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]).tobytes()])], ["part"])

    # bounded by `common`, whatever the corpus is
    parts = [np.frombuffer(bytes(r.part), np.int64).reshape(3, -1) for r in top.select("h", "other", "c").coalesce(8).mapInArrow(packed, "part binary").toLocalIterator()]
    h, other, c = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)
    order = np.lexsort([h, -c])
    h, other, c = h[order], other[order], c[order]
    sums, kinds = np.zeros(OTHERS), np.zeros(OTHERS, np.int64)
    for r in counts.groupBy("other").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        sums[r.other], kinds[r.other] = r.c, r.n
    sums -= np.bincount(other, c, OTHERS)
    kinds -= np.bincount(other, minlength=OTHERS)
    return Vocabulary(h.view(np.uint64), c, other, sums, kinds, whole.total or 0, whole.distinct)


MOVED = "chunk int, rows binary, sums binary"


def _sent(parts: list[tuple]) -> pa.RecordBatch:
    chunk, rows, values = zip(*parts, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int32()), pa.array([r.tobytes() for r in rows]), pa.array([v.tobytes() for v in values])], ["chunk", "rows", "sums"])


def _added(parts: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The sums of all tasks' rows by chunk, added on the executors in two steps: first whatever chunks
    meet in a task, then each chunk's. The driver gets each chunk once."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, rows, sums in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                rows = np.frombuffer(rows.as_buffer(), "<i4")
                sums = np.frombuffer(sums.as_buffer(), "<f4").reshape(len(rows), -1)
                if chunk not in total:
                    total[chunk] = np.zeros((CHUNK_ROWS if chunk >= 0 else 1, sums.shape[1]))
                total[chunk][rows] += sums
        for chunk, sums in total.items():
            rows = np.flatnonzero(sums.any(axis=1))
            yield _sent([(chunk, rows.astype("<i4"), sums[rows].astype("<f4"))])

    tasks = max(1, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    once = parts.repartition(tasks).mapInArrow(add, MOVED)
    out = {}
    for r in once.repartition("chunk").mapInArrow(add, MOVED).collect():
        rows = np.frombuffer(bytes(r.rows), "<i4")
        out[r.chunk] = rows, np.frombuffer(bytes(r.sums), "<f4").reshape(len(rows), -1)
    return out


def train(docs: DataFrame, rounds: int = ROUNDS, common: int = COMMON) -> Model:
    """Learns from the ``text`` of all of ``docs``; a null text is an empty one.

    Each document is in one of ``rounds``. In a round every task starts from the same weights and
    makes gradient steps over its documents; the weights are then averaged by tokens. What a task
    sends has a fixed size. Without documents all classes are alike.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"))
    counts = materialize(count_words(texts), "lm-counts")
    vocabulary = spark.sparkContext.broadcast(vocabulary_of(counts, common))
    weights = Weights()
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        def learn(batches, shared=shared):
            own, v = Weights(shared.value), vocabulary.value
            used = 0
            for b in batches:
                for _, t in tokens_of(b.column(0), FLUSH // 8):
                    own.learn(Events(t, v), v)
                    used += len(t.hash)
            if used:
                yield _sent([(-1, np.zeros(1, "<i4"), np.full((1, 1), used, "<f4")), *own.moved(shared.value, used)])

        mine = texts.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == turn)
        moved = _added(mine.mapInArrow(learn, MOVED))
        if moved:
            used = float(moved.pop(-1)[1][0, 0])
            for chunk, (rows, values) in moved.items():
                weights.move(chunk, rows, values / np.float32(used))
            for table in weights.tables:
                table *= 1 - DECAY
        shared.unpersist()
    return Model(vocabulary, weights, counts)


PARTS = "n_tokens long, n_known long, base double, score double, rare array<long>"


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score and score, from the whole ``text``.

    Tokens are the words of the text (A-Z as a-z) and one end; a null text is an empty one. ``n_known``
    are those that occur in the training texts, ``train_tokens`` all of these. Scores are log10
    probabilities of the text: ``base_score`` by counts, each plus one, ``score`` by the model. Repeated rows each
    have one; an empty table none. Words are told apart by a hash of 64 bits. Columns of these names
    in the input are replaced.
    """
    spark = docs.sparkSession
    vocabulary, shared = model.vocabulary, spark.sparkContext.broadcast(model.weights)
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rest = docs.drop(*added)
    # a row is carried whole, so that no name of its columns clashes
    rows = rest.select(F.struct(*[rest[f"`{c}`"] for c in rest.columns]).alias("row"), rest["text"].cast("string").alias("text"))
    carried = rows.schema["row"].dataType.simpleString()

    def step(batches):
        v, weights = vocabulary.value, shared.value
        base_of = np.log10(v.total + v.distinct + 1)
        for b in batches:
            for first, t in tokens_of(b.column(1), FLUSH // 4):
                e = Events(t, v)
                at = t.last - t.sizes + 1
                known = e.place >= 0
                log_count = np.where(known, np.log10((v.counts[e.place] if len(v.counts) else np.zeros(len(known))) + 1.0), 0.0)
                p = weights.log10(e, v)
                # a common word's own count is in the tail's share as well
                p += np.where(known & ~e.member, log_count, 0.0)
                n_known = np.add.reduceat(known.astype(np.int64), at)
                base = np.add.reduceat(log_count, at) - t.sizes * base_of
                rare = t.hash[~known].view(np.int64)
                cuts = np.append(0, np.cumsum(np.add.reduceat((~known).astype(np.int64), at)))
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(rare))
                n = len(t.sizes)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, n), pa.array(t.sizes), pa.array(n_known), pa.array(base), pa.array(np.add.reduceat(p, at)), lists], ["row", *[x.split()[0] for x in PARTS.split(", ")]]
                )

    found = rows.mapInArrow(step, f"row {carried}, {PARTS}")
    found = materialize(found.withColumn("at", F.monotonically_increasing_id()), "lm-scored")
    # the rare words' counts: each text's distinct ones meet the table, and their sums go back to the text
    rare = found.select("at", F.explode("rare").alias("h")).groupBy("at", "h").agg(F.count("*").alias("n"))
    hits = rare.join(model.counts.select("h", "c"), "h").groupBy("at").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"), F.sum("n").alias("hits"))
    out = found.join(hits, "at", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "row.*",
        "n_tokens",
        (F.col("n_known") + F.coalesce("hits", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.value.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )


def held_out(doc_id: str = "doc_id") -> Column:
    return id_fold(doc_id, 7) == 2


@tidy
def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = train(docs.where(~held_out()))
    return score_texts(docs, model).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
