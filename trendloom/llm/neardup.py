"""MinHash near-duplicates by a chosen-path set similarity join.

Each tree sends a document down a path: at every level it follows the least of its shingles under
that level's random order. Nodes are split until few documents are left in them, and those are
compared with each other. A large node whose members agree with their typical member as linked ones
do is a family: it isn't split further, but compared with its most typical members, then piece by
piece as far as its members aren't connected yet. Independent trees repeat this to reach the target
recall; documents that shared text keeps together for many levels get as many more trees as their
depth needs. Candidates are confirmed on the full shingle sets, and confirmed links give the groups.

Where many members of a family aren't connected, they are told apart by what they differ in from the
family's common set: two members that differ in little are linked for certain, and any other linked
pair shares a rare difference. So only members that share one are compared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACED, Bloom, materialize, mix, read, shingles, tidy

#: Words of a shingle; least similarity in per cent.
SHINGLE, PERCENT = 5, 85
#: Independent trees that every document goes down, and the recall that a pair at exactly the least
#: similarity is to have: it meets in a node of depth d with chance 1 - (1 - s^d)^trees.
TREES, RECALL = 16, 0.95
#: Random orders of the shingles; each tree takes its own sequence of them. They are the sketch too.
ORDERS = 96
#: A node of more documents than this is split, down to this depth. A larger one whose members agree
#: with its typical member in this share of the orders is a family: at the level of links, splitting
#: would part what is linked. What is still larger at the last level is compared piece by piece too.
NODE, DEPTH, ALIKE = 256, 20, 0.85
#: Levels that are split at once below the first.
AHEAD = 4
#: Typical members that all members of a family are compared with.
PIVOTS = 2
#: Candidates whose sketches agree in a smaller share are taken for no links: a pair at exactly the
#: least similarity, 7 deviations above, falls below with a chance of under 1e-8, others with less.
SKETCH = 0.60
#: Bits of a set's parity map. Two maps differ in no more bits than their sets do in members, so a
#: pair whose maps differ in more than a link allows is none: this loses no link.
PARITY = 2048

_MULTIPLIERS = (mix(np.arange(1, ORDERS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADDENDS = mix(np.arange(1001, ORDERS + 1001, dtype=np.uint64)).astype(np.uint32)
#: PATHS[tree, level]: the order that the tree follows there; each tree begins with another one.
PATHS = np.stack([np.concatenate([[t], np.random.default_rng(t).permutation(np.delete(np.arange(ORDERS), t))]) for t in range(ORDERS)])


def trees_for(depth: int, recall: float = RECALL) -> int:
    """Trees by which a pair at the least similarity, which must meet at ``depth``, reaches ``recall``."""
    meets = (PERCENT / 100) ** depth
    return min(ORDERS, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meets))))


def shingle_set(words: np.ndarray) -> np.ndarray:
    return np.unique(shingles(words, SHINGLE))


def least(members: np.ndarray) -> np.ndarray:
    """The least value of a set under each order."""
    low = np.full(ORDERS, 0xFFFFFFFF, np.uint32)
    short = (members >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 4096):
        part = short[None, at : at + 4096] * _MULTIPLIERS[:, None]
        part += _ADDENDS[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low


def parity(members: np.ndarray) -> np.ndarray:
    """Whether an odd number of members fall on each bit."""
    return np.packbits((np.bincount((mix(members ^ np.uint64(PARITY)) % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1).astype(bool))


def _may_link(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of n and m members with parity maps a and b (rows) can be similar enough."""
    differ = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    # with k shared members, 100 k >= PERCENT (n + m - k), and the sets differ in n + m - 2 k
    return (100 + PERCENT) * differ <= (100 - PERCENT) * (n + m)


def _signatures(batches):
    """doc_id, text -> doc_id, size and digest of the set, its least values and its parity map."""
    for batch in batches:
        ids, sizes, digests, lows, odds = batch.column(0), [], [], [], []
        for _, words, *_ in SPACED.texts(batch.column(1)):
            members = shingle_set(words)
            sizes.append(len(members))
            digests.append(xxhash.xxh3_128_digest(members.tobytes()) if len(members) else None)
            lows.append(least(members).tobytes() if len(members) else None)
            odds.append(parity(members).tobytes() if len(members) else None)
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), *[pa.array(x, pa.binary()) for x in (digests, lows, odds)]], ["doc_id", "n_shingles", "digest", "low", "odd"])


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _ints(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _roots(trees: range):
    def step(batches):
        """cid, low -> a row for each tree: the node that the class is in at the first level."""
        number = np.arange(trees.start, trees.stop)
        for batch in batches:
            if batch.num_rows:
                cids, low = _ints(batch.column(0)), _matrix(batch.column(1), np.uint32, ORDERS)
                node = mix(low[:, PATHS[number, 0]].astype(np.uint64) ^ mix(number.astype(np.uint64) + np.uint64(77))[None, :])
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64).ravel()), pa.array(np.tile(number.astype(np.int32), len(cids))), pa.array(np.repeat(cids, len(number)))], ["node", "tree", "cid"])

    return step


def _deeper(level: int, steps: int):
    def step(batches):
        """node, tree, cid, low -> the node, n0, and those of the next ``steps`` levels, n1 and on."""
        for batch in batches:
            if batch.num_rows:
                node, tree = _ints(batch.column(0)).view(np.uint64), _ints(batch.column(1))
                low, out = _matrix(batch.column(3), np.uint32, ORDERS), []
                for k in range(steps):
                    node = mix(mix(node) + low[np.arange(len(node)), PATHS[tree, level + k]].astype(np.uint64))
                    out.append(pa.array(node.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(0), *out], ["tree", "cid", *[f"n{k}" for k in range(steps + 1)]])

    return step


class Leaves:
    """Where splitting ended, as tables: ``small`` (node, cid) with 2 to NODE classes a node, ``families``
    (node, cid, n) and their typical members' least values ``centers`` (node, center), and the deepest
    level in use, ``levels``."""

    def __init__(self):
        self.small, self.families, self.centers, self.levels, self.split = [], [], [], 1, []

    def add(self, classes: DataFrame, trees: range) -> None:
        """Sends ``classes`` (cid, low) down the ``trees``; ``split`` gets (level, table of what is split from there on).

        Levels are taken ``AHEAD`` at a time: all their nodes are counted together, and a document ends
        at the first that isn't too large.
        """
        roots = classes.select("cid", "low").mapInArrow(_roots(trees), "node long, tree int, cid long")
        counts = materialize(roots.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), "dup-counts")
        sized = materialize(roots.join(counts, "node"), "dup-level1")
        self.small.append(sized.where(F.col("n") <= NODE).select("node", "cid"))
        large, level = sized.where(F.col("n") > NODE), 1
        while not large.isEmpty():
            some = large.where(F.pmod(F.xxhash64("cid", F.lit(1)), F.ceil(F.col("n") / NODE)) == 0).join(classes.select("cid", "low"), "cid")
            centers = some.select("node", "low").repartition("node").sortWithinPartitions("node").mapInArrow(_centers, "node long, center binary, agree double")
            centers = materialize(centers, f"dup-centers{level}")
            if level == DEPTH:
                self.families.append(large.select("node", "cid", "n"))
                self.centers.append(centers.select("node", "center"))
                return
            alike = centers.where(F.col("agree") >= ALIKE)
            self.families.append(large.join(alike.select("node"), "node").select("node", "cid", "n"))
            self.centers.append(alike.select("node", "center"))
            # a node whose sample happened to be empty is split
            steps = min(AHEAD, DEPTH - level)
            nodes = [f"n{k + 1}" for k in range(steps)]
            below = large.join(alike.select("node"), "node", "left_anti").join(classes.select("cid", "low"), "cid").select("node", "tree", "cid", "low")
            below = materialize(below.mapInArrow(_deeper(level, steps), f"tree int, cid long, n0 long, {', '.join(n + ' long' for n in nodes)}"), f"dup-below{level}")
            # a level reads only its two columns of nodes
            flat = _union([below.select("tree", "cid", F.lit(level + k + 1).alias("level"), F.col(f"n{k}").alias("up"), F.col(f"n{k + 1}").alias("node")) for k in range(steps)])
            counts = materialize(flat.groupBy("node").agg(F.count("*").alias("n"), F.first("up").alias("up"), F.first("level").alias("level")).where("n > 1"), f"dup-counts{level}")
            # a document ends in the node that isn't too large, but below one that is, or at the last of these levels
            above = counts.select(F.col("node").alias("up"), F.col("n").alias("up_n"))
            ends = counts.join(above, "up", "left").where(((F.col("n") <= NODE) & (F.coalesce("up_n", F.lit(NODE + 1)) > NODE)) | ((F.col("n") > NODE) & (F.col("level") == level + steps)))
            sized = materialize(flat.select("tree", "cid", "node").join(ends.select("node", "n", "level"), "node").select("node", "tree", "cid", "n", "level"), f"dup-level{level + steps}")
            self.small.append(sized.where(F.col("n") <= NODE).select("node", "cid"))
            self.split.append(sized.select("cid", "level"))
            large, level = sized.where(F.col("n") > NODE), level + steps


def leaves(classes: DataFrame) -> Leaves:
    """The leaves of all trees: TREES for every class, and as many more as those that go deep need."""
    out = Leaves()
    out.add(classes, range(TREES))
    enough = max((d for d in range(1, DEPTH + 1) if trees_for(d) <= TREES), default=0)
    if out.split:
        ended = _union(out.split)
        out.levels = ended.agg(F.max("level")).first()[0] or 1
        if out.levels > enough:
            cids = ended.where(F.col("level") > enough).select("cid").distinct()
            out.add(materialize(classes.join(cids, "cid").select("cid", "low"), "dup-deep"), range(TREES, trees_for(out.levels)))
    return out


def _centers(batches):
    """node, low of some members, sorted by node -> the most frequent value of each order, and how often
    members agree with these on average."""
    for run in _by_node(batches):
        node, low = _ints(run.column(0)), _matrix(run.column(1), np.uint32, ORDERS)
        edge = np.concatenate([[0], np.flatnonzero(np.diff(node)) + 1, [len(node)]])
        out, agree = [], []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            part = np.sort(low[a:b], axis=0)
            # how often each value has come so far in its order: the last of the longest run is the mode
            place = np.broadcast_to(np.arange(b - a)[:, None], part.shape)
            start = np.maximum.accumulate(np.where(np.vstack([np.ones((1, ORDERS), bool), part[1:] != part[:-1]]), place, 0), axis=0)
            out.append(part[(place - start).argmax(axis=0), np.arange(ORDERS)].tobytes())
            agree.append(float((place - start + 1).max(axis=0).mean() / (b - a)))
        yield pa.RecordBatch.from_arrays([pa.array(node[edge[:-1]]), pa.array(out, pa.binary()), pa.array(agree)], ["node", "center", "agree"])


def _typical(batches):
    """node, cid, low, center -> how many orders agree with the center."""
    for batch in batches:
        if batch.num_rows:
            agree = (_matrix(batch.column(2), np.uint32, ORDERS) == _matrix(batch.column(3), np.uint32, ORDERS)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(agree.astype(np.int32))], ["node", "cid", "agree"])


def _star(batches):
    """cid, size, low, odd of a member and of a pivot -> the pairs whose sketches agree."""
    for batch in batches:
        if batch.num_rows:
            x, n, y, m = (_ints(batch.column(i)) for i in (0, 1, 4, 5))
            agree = (_matrix(batch.column(2), np.uint32, ORDERS) == _matrix(batch.column(6), np.uint32, ORDERS)).mean(axis=1)
            ok = (x != y) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & (agree >= SKETCH)
            ok &= _may_link(n, m, _matrix(batch.column(3), np.uint8, PARITY // 8), _matrix(batch.column(7), np.uint8, PARITY // 8))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[ok]), pa.array(np.maximum(x, y)[ok])], ["a", "b"])


def stars(families: DataFrame, centers: DataFrame, sketches: DataFrame) -> DataFrame:
    """Candidates (a, b) between the members of each family and its most typical ones."""
    members = families.join(sketches, "cid")
    scored = members.join(centers, "node").select("node", "cid", "low", "center").mapInArrow(_typical, "node long, cid long, agree int")
    best = scored.groupBy("node", F.pmod(F.xxhash64("cid", F.lit(2)), F.lit(PIVOTS)).alias("k")).agg(F.max(F.struct("agree", F.negate("cid").alias("minus"))).alias("best"))
    pivots = best.select("node", F.negate("best.minus").alias("cid")).join(sketches, "cid").select("node", F.col("cid").alias("p"), F.col("size").alias("p_size"), F.col("low").alias("p_low"), F.col("odd").alias("p_odd"))
    pivots = materialize(pivots, "dup-pivots")
    return members.join(pivots, "node").select("cid", "size", "low", "odd", "p", "p_size", "p_low", "p_odd").mapInArrow(_star, "a long, b long")


def merged(families: DataFrame, centers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Families of different trees with one center as one family, so that a membership counts once."""
    named = centers.select("node", F.xxhash64("center").alias("family"), "center")
    members = materialize(families.join(named.select("node", "family"), "node").select(F.col("family").alias("node"), "cid").distinct(), "dup-families")
    counts = members.groupBy("node").agg(F.count("*").alias("n"))
    return members.join(counts, "node"), materialize(named.select(F.col("family").alias("node"), "center").dropDuplicates(["node"]), "dup-centers")


def _blocks(n: Column, size: int = NODE // 2) -> Column:
    return F.ceil(n / size).cast("long")


def pieces(families: DataFrame) -> DataFrame:
    """The families dealt into nodes of about NODE / 2."""
    return families.select(F.xxhash64("node", F.pmod(F.xxhash64("cid", F.lit(3)), _blocks(F.col("n")))).alias("node"), "cid")


def minorities(labelled: DataFrame) -> DataFrame:
    """(node, n, common, others) of the families with several labels: the commonest, and how many members have another."""
    counts = labelled.groupBy("node", "label").agg(F.count("*").alias("k"))
    most = counts.groupBy("node").agg(F.max(F.struct("k", "label")).alias("most"), F.sum("k").alias("n"))
    return most.select("node", "n", F.col("most.label").alias("common"), (F.col("n") - F.col("most.k")).alias("others")).where("others > 0")


def crossings(labelled: DataFrame) -> DataFrame:
    """Nodes in which all members of a family with different labels meet: (node, cid, label).

    Most members share a family's commonest label. All others are dealt into blocks, which meet
    each block of the family, so that a node holds 2 NODE at most; the rows are as many as the family has, times blocks of the others.
    """
    rows = labelled.select("node", "cid", "label").join(minorities(labelled), "node")
    own = F.pmod(F.xxhash64("cid", F.lit(3)), _blocks(F.col("n"), NODE))
    other = F.pmod(F.xxhash64("cid", F.lit(4)), _blocks(F.col("others"), NODE))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), _blocks(F.col(n), NODE) - 1))
    members = rows.select("node", "cid", "label", own.alias("x"), every("others").alias("y"))
    others = rows.where("label != common").select("node", "cid", "label", other.alias("y"), every("n").alias("x"))
    return members.unionByName(others).select(F.xxhash64("node", "x", "y").alias("node"), "cid", "label")


def _unpacked(batches):
    """node, members -> a row for each member of the set."""
    for batch in batches:
        for node, members in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            tokens = np.frombuffer(members.as_buffer(), np.int64)
            for at in range(0, len(tokens), 1 << 16):
                part = tokens[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), node, np.int64)), pa.array(part)], ["node", "token"])


def _apart(batches):
    """node, cid, label, members, common -> what each set differs in from the common one, and by how much
    that exceeds what links allow for its size."""
    for batch in batches:
        excess, tokens = [], []
        for members, common in zip(batch.column(3), batch.column(4), strict=True):
            own = np.frombuffer(members.as_buffer(), np.int64)
            differ = np.setxor1d(own, common.values.to_numpy(), assume_unique=True) if common.is_valid else own
            excess.append((100 + PERCENT) * len(differ) - (100 - PERCENT) * len(own))
            tokens.append(differ)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(excess, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], ["node", "cid", "label", "excess", "tokens"])


def differences(members: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of families ``members`` (node, cid, label) with their ``sets`` (cid, members): nodes (node, cid, label) and pairs (a, b).

    Let d be the size of what a set of n members differs in from any common set, and its excess
    (100 + PERCENT) d - (100 - PERCENT) n. Two sets differ in d + d' - 2 k members if k of their
    differences are shared, and are linked if 100 + PERCENT times that is at most (100 - PERCENT) (n + n').
    So with a sum of excesses of 0 or less they are linked; the member of least excess is then linked
    with both, and ``pairs`` has it with each. Any other linked pair shares at least the sum of its
    excesses / 2 (100 + PERCENT) differences. Ordered by rarity, its members then share one among
    the first d - k + 1 of each, and meet in the node of that. This loses no link, whatever the common set is.
    """
    counts = members.groupBy("node").agg(F.count("*").alias("n"))
    some = members.join(counts, "node").where(F.pmod(F.xxhash64("cid", F.lit(5)), F.ceil(F.col("n") / NODE)) == 0).select("node", "cid")
    held = some.join(sets, "cid").select("node", "members").mapInArrow(_unpacked, "node long, token long").groupBy("node", "token").agg(F.count("*").alias("k"))
    common = held.join(some.groupBy("node").agg(F.count("*").alias("all")), "node").where("2 * k > all").groupBy("node").agg(F.collect_list("token").alias("common"))
    apart = members.join(sets, "cid").join(common, "node", "left").select("node", "cid", "label", "members", "common")
    apart = materialize(apart.mapInArrow(_apart, "node long, cid long, label long, excess long, tokens array<bigint>"), "dup-apart")
    first = apart.groupBy("node").agg(F.min(F.struct("excess", "cid", "label")).alias("z")).select("node", F.col("z.excess").alias("low"), F.col("z.cid").alias("z"), F.col("z.label").alias("z_label"))
    near = apart.select("node", "cid", "label", "excess").join(first, "node").where("excess + low <= 0 AND label != z_label")
    pairs = near.select(F.least("cid", "z").alias("a"), F.greatest("cid", "z").alias("b"))
    each = apart.select("node", "cid", "label", "excess", F.size("tokens").alias("d"), F.explode("tokens").alias("token"))
    # what only one label has comes first in the order, and is met by nobody
    shared = each.groupBy("node", "token").agg(F.count("*").alias("df"), F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("node", "token", "df")
    own = Window.partitionBy("node", "cid")
    placed = each.join(shared, ["node", "token"]).select(
        "*", (F.col("d") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "token"))).alias("place")
    ).join(first.select("node", "low"), "node")
    # of two with an excess each shares more than half of its own; one without meets all that differ like it
    least = lambda excess: F.greatest(F.lit(1), F.ceil(excess / (2 * (100 + PERCENT))))
    far = placed.where((F.col("excess") > 0) & (F.col("place") <= F.col("d") - least(F.col("excess")) + 1)).withColumn("kind", F.lit(0))
    mixed = placed.where((F.col("excess") <= 0) | (F.col("place") <= F.col("d") - least(F.col("excess") + F.col("low")) + 1)).withColumn("kind", F.lit(1))
    keyed = far.unionByName(mixed).select(F.xxhash64("node", "token", "kind").alias("node"), "cid", "label", "kind", (F.col("excess") > 0).alias("far"))
    sized = keyed.groupBy("node").agg(F.count("*").alias("n"), F.min("label").alias("x"), F.max("label").alias("y"), F.max("kind").alias("kind"), F.min("far").alias("f"), F.max("far").alias("g"))
    sized = sized.where("x != y AND (kind = 0 OR f != g)").select("node", "n")
    meeting = materialize(keyed.select("node", "cid", "label").join(sized, "node"), "dup-meeting")
    large = meeting.where(F.col("n") > NODE)
    return meeting.where(F.col("n") <= NODE).select("node", "cid", "label").unionByName(crossings(large)), pairs


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _compare(spanning: bool):
    """node, cid, label, size, low, odd, sorted by node -> pairs of classes whose sketches agree.

    Only pairs of different labels count. ``spanning`` keeps, of each node, the best pairs that
    connect what agrees; the others connect nothing new if those are confirmed.
    """

    def pairs_of(run: pa.RecordBatch):
        node, cid, label, size = (_ints(run.column(i)) for i in range(4))
        low, odd = _matrix(run.column(4), np.uint32, ORDERS), _matrix(run.column(5), np.uint8, PARITY // 8)
        edges = np.flatnonzero(np.diff(node)) + 1
        begin = np.concatenate([[0], edges])
        count = np.diff(np.concatenate([begin, [len(node)]]))
        for m in np.unique(count[count > 1]):
            i, j = np.triu_indices(m, 1)
            step = max(1, 40_000 // len(i))
            own = begin[count == m]
            for at in range(0, len(own), step):
                base = own[at : at + step, None]
                a, b = (base + i).ravel(), (base + j).ravel()
                which = np.repeat(np.arange(len(base)), len(i))
                short, long = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
                ok = (label[a] != label[b]) & (100 * short >= PERCENT * long)
                a, b, which = a[ok], b[ok], which[ok]
                agree = np.concatenate([(low[a[k : k + 20_000]] == low[b[k : k + 20_000]]).mean(axis=1) for k in range(0, len(a), 20_000)] or [np.zeros(0)])
                ok = agree >= SKETCH
                a, b, which, agree = a[ok], b[ok], which[ok], agree[ok]
                ok = _may_link(size[a], size[b], odd[a], odd[b])
                a, b, which, agree = a[ok], b[ok], which[ok], agree[ok]
                if spanning and m > 2:
                    keep = _forest(a, b, agree)
                    a, b = a[keep], b[keep]
                if len(a):
                    x, y = cid[a], cid[b]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def step(batches):
        for run in _by_node(batches):
            yield from pairs_of(run)

    return step


def _by_node(batches):
    """Batches of whole nodes, of batches sorted by node (the first column); a node has few rows."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        node = _ints(batch.column(0))
        cut = int(np.searchsorted(node, node[-1], "left"))  # the last node may go on in the next batch
        if cut:
            yield batch.slice(0, cut)
        held = batch.slice(cut)
    if held is not None:
        yield held


def _forest(a: np.ndarray, b: np.ndarray, agree: np.ndarray) -> np.ndarray:
    """Places of the pairs of a spanning forest, best pairs first."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    keep = []
    for k in np.argsort(-agree, kind="stable"):
        x, y = top(int(a[k])), top(int(b[k]))
        if x != y:
            up[x] = y
            keep.append(k)
    return np.array(sorted(keep), np.int64)


def _sets(bloom):
    """text -> digest and sorted set of those that are needed, each about once a task."""

    def step(batches):
        seen, needed = set(), bloom.value
        for batch in batches:
            digests, sets, held = [], [], 0
            for _, words, *_ in SPACED.texts(batch.column(0)):
                if len(words):
                    members = shingle_set(words)
                    digest = xxhash.xxh3_128_digest(members.tobytes())
                    if digest not in seen and needed.has(np.frombuffer(digest[:8], ">u8"))[0]:
                        seen.add(digest)
                        digests.append(digest)
                        sets.append(members.tobytes())
                        held += members.nbytes
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], ["digest", "members"])
                    digests, sets, held = [], [], 0
            if len(seen) > 1 << 18:
                seen = set()  # what comes again is dropped after the join
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], ["digest", "members"])

    return step


def _confirm(batches):
    """a, b and their sets -> the pairs that are similar enough."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            keep[i] = 100 * both >= PERCENT * (len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(cid, label) of all ends of ``links`` (a, b): label is the least cid that can be reached.

    Large-star and small-star steps, each a grouped minimum and a join, until the links stay.
    """
    links = materialize(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "dup-links")
    before = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("low").alias("a"), "b")
        large = large.where("a != b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(low, "b").select(F.col("low").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x != y")
        links = materialize(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "dup-links")
    return links.select(F.col("b").alias("cid"), F.col("a").alias("label")).unionByName(links.select(F.col("a").alias("cid"), F.col("a").alias("label")).distinct()).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_shingles, component_id, kept.

    Texts with one set of shingles form a class, so copies are compared once. Links join classes;
    the first round confirms the best candidates of each node, the second all that still lie
    between groups. ``component_id`` is the least doc_id that links reach.

    Nulls: a null, empty or blank text has the empty set and is linked with nothing. Rows of null
    doc_id link others but aren't kept, unless their group has no doc_id at all. Fewer than five
    words are one shingle. Repeated rows of a doc_id are one document and share its decision.
    Texts of any length are compared whole. An empty table gives no rows; other columns don't matter.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(texts.mapInArrow(_signatures, "doc_id long, n_shingles long, digest binary, low binary, odd binary"), "dup-rows")
    classes = rows.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("size"), F.first("low").alias("low"), F.first("odd").alias("odd")
    )
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "dup-classes")  # written once, so the ids stay
    sketches = classes.select("cid", "size", "low", "odd")
    found = leaves(sketches)
    small = _union(found.small)
    families = centers = None
    if found.families:
        families, centers = merged(_union(found.families), _union(found.centers))

    def sets_of(ends: DataFrame) -> DataFrame:
        """(cid, members): the full sets of some classes (cid)."""
        needed = materialize(classes.join(ends, "cid").select("cid", "digest", F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long").alias("key")), "dup-needed")
        bloom = spark.sparkContext.broadcast(Bloom.of(needed, "key"))
        sets = texts.select("text").mapInArrow(_sets(bloom), "digest binary, members binary")
        return materialize(sets.join(needed.select("cid", "digest"), "digest").select("cid", "members").dropDuplicates(["cid"]), "dup-sets")

    def confirmed(labels: DataFrame | None, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        near = None
        if labels is None:
            at = small if families is None else small.unionByName(pieces(families))
            at = at.withColumn("label", F.col("cid"))
        else:
            label = lambda df: df.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
            at = label(small)
            mixed = at.groupBy("node").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("node")
            at = at.join(mixed, "node").select("node", "cid", "label")
            if families is not None:
                members = materialize(label(families).select("node", "cid", "label"), "dup-members")
                apart = materialize(minorities(members).where(F.col("others") > NODE).select("node"), "dup-minorities")
                at = at.unionByName(crossings(members.join(apart, "node", "left_anti")))
                many = members.join(apart, "node")
                if not apart.isEmpty():
                    meeting, near = differences(many, sets_of(many.select("cid").distinct()))
                    at = at.unionByName(meeting)
        sketched = at.join(sketches, "cid").select("node", "cid", "label", "size", "low", "odd")
        pairs = sketched.repartition("node").sortWithinPartitions("node", "cid").mapInArrow(_compare(labels is None), "a long, b long")
        if labels is None and families is not None:
            pairs = pairs.unionByName(stars(families, centers, sketches))
        if near is not None:
            pairs = pairs.unionByName(near)
        pairs = pairs.distinct()
        if known is not None:
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "dup-pairs")
        if pairs.isEmpty():
            return pairs, pairs
        ends = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
        sets = sets_of(ends)
        of = lambda side: sets.select(F.col("cid").alias(side), F.col("members").alias(f"of_{side}"))
        links = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "of_a", "of_b").mapInArrow(_confirm, "a long, b long")
        return materialize(links, "dup-confirmed"), pairs

    links, known = confirmed(None, None)
    labels = materialize(components(links), "dup-labels")
    more, _ = confirmed(labels, known)
    if not more.isEmpty():
        # few links lie between groups: what they connect are the groups' labels
        of = lambda side: more.select(F.col(side).alias("cid")).join(labels, "cid", "left").select(F.col("cid").alias(side), F.coalesce("label", "cid").alias(f"label_{side}")).distinct()
        between = more.join(of("a"), "a").join(of("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
        joined = materialize(components(between), "dup-joined").select(F.col("cid").alias("label"), F.col("label").alias("whole"))
        own = labels.join(joined, "label", "left").select("cid", F.coalesce("whole", "label").alias("label"))
        alone = joined.join(labels.select(F.col("cid").alias("label")), "label", "left_anti").select(F.col("label").alias("cid"), F.col("whole").alias("label"))
        labels = materialize(own.unionByName(alone), "dup-labels")
    groups = classes.select("cid", "digest", "least_id", "copies").join(labels, "cid", "left")
    ids = groups.where("label IS NOT NULL").groupBy("label").agg(F.min("least_id").alias("group_id"))
    # a text that occurs once and has no link is its own group: only the others are joined back
    decided = groups.where("copies > 1 OR label IS NOT NULL").join(ids, "label", "left").select("digest", F.lit(True).alias("grouped"), F.when(F.col("label").isNull(), F.col("least_id")).otherwise(F.col("group_id")).alias("group_id"))
    component = F.when(F.col("grouped"), F.col("group_id")).otherwise(F.col("doc_id"))
    out = rows.select("doc_id", "n_shingles", "digest").join(decided, "digest", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


@tidy
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
