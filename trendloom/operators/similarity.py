"""Similarity joins: cosine pairs in blocks, Jaccard by prefix filter, groups of linked rows."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import jaccard
from .work import work_table


#: Blocks of one span of time are numbered below this.
BLOCKS = 1 << 24


def cosine_pairs(vectors: DataFrame, least: float, block: int = 2000, hours: float | None = None) -> DataFrame:
    """(a, b, cosine) of all pairs of ``vectors`` (id, v) with a < b and cosine >= ``least``.

    With ``hours``, of those whose ``at`` is not more than ``hours`` apart; rows without ``at`` pair with none.
    Exact. Rows are dealt into spans of ``hours`` and these into blocks of about ``block`` rows; each pair of
    blocks of one span or of neighbouring ones is one task's matrix product, and only pairs that are near
    enough leave it. So the work grows with a span's rows. Vectors without length pair with none.
    """
    if hours is None:
        timed = vectors.select("id", "v", F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("span"))
    else:
        t = F.unix_micros(F.col("at").cast("timestamp"))
        timed = vectors.where("at IS NOT NULL").select("id", "v", t.alias("t"), F.floor(t / (hours * 3_600_000_000)).alias("span"))
    # one row a span of time, so a small table however many vectors there are
    spans = work_table(timed.groupBy("span").agg(F.ceil(F.count("*") / block).alias("n")), "spans")
    at = lambda by: spans.select((F.col("span") + by).alias("span"), F.col("n").alias("before" if by > 0 else "after"))
    sizes = spans.join(at(1), "span", "left").join(at(-1), "span", "left")
    blocks = lambda n, by: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), lambda i: (F.col("span") + by) * BLOCKS + i)).otherwise(F.array().cast("array<long>"))
    rows = timed.join(F.broadcast(sizes), "span")
    own = F.col("span") * BLOCKS + F.pmod(F.xxhash64("id"), F.col("n"))
    other = F.explode(F.concat(blocks("before", -1), blocks("n", 0), blocks("after", 1))).alias("other")
    dealt = rows.select("id", "v", "t", own.alias("own"), other).select("id", "v", "t", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    most = np.inf if hours is None else hours * 3_600_000_000

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
        left, right = pdf[pdf["own"] == x], pdf[pdf["own"] == y]
        unit = lambda p: (m := np.array(p["v"].tolist(), float).reshape(len(p), -1)) / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": [], "cosine": []})
        c = unit(left) @ unit(right).T
        i, j = np.nonzero(c >= least)
        a, b = left["id"].to_numpy()[i], right["id"].to_numpy()[j]
        keep = np.abs(left["t"].to_numpy()[i] - right["t"].to_numpy()[j]) <= most
        keep &= a < b if x == y else True
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "cosine": c[i, j][keep]})

    return dealt.groupBy("x", "y").applyInPandas(near, "a long, b long, cosine double")


#: Longs of a set's sketch, which has a bit for each element.
SKETCH = 4


def sketch(members: Column, name: str) -> list[Column]:
    """The sketch of an array: ``SKETCH`` longs with a bit for each element."""
    def part(i: int) -> Column:
        own = lambda x: F.when(F.pmod(F.xxhash64(x), F.lit(SKETCH)) == i, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.floor(F.xxhash64(x) / SKETCH), F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("long"))
        return F.aggregate(members, F.lit(0).cast("long"), lambda out, x: out.bitwiseOR(own(x)))

    return [part(i).alias(f"{name}{i}") for i in range(SKETCH)]


def missing(part: str, whole: str) -> Column:
    """At most as many as the elements of ``part`` that ``whole`` lacks, by their sketches."""
    bits = [F.bit_count(F.col(f"{part}{i}").bitwiseAND(F.bitwise_not(F.col(f"{whole}{i}")))) for i in range(SKETCH)]
    return sum(bits[1:], bits[0])


def jaccard_pairs(sets: DataFrame, least: float, within: str, fresh: str | None = None) -> DataFrame:
    """(a, b, jaccard) of pairs of ``sets`` (id, members, ``within``) of one ``within`` that are near enough.

    Exact, by prefix filter: elements are ordered by rarity, and near sets share one of the first
    n - ceil(t n) + 1; only those are joined. The join drops pairs whose sketches differ in more bits
    than near sets have different elements, so that what rare elements many sets have in common, as a
    phrase, makes no rows; whole sets confirm the rest. Give each different set once. With
    ``fresh``, a boolean column, pairs of two sets that aren't fresh are left out and never made.
    """
    own = ["w"] if fresh is None else ["w", fresh]
    # elements and ``within`` travel as hashes: four numbers a row
    inside = F.xxhash64(within).alias("w")
    flat = sets.select("id", inside, *own[1:], F.explode("members").alias("m"), within).select("id", *own, F.xxhash64(within, "m").alias("h"))
    often = flat.groupBy("h").agg(F.count("*").alias("often"))
    sketch = [F.bit_or(F.when(F.pmod("h", F.lit(SKETCH)) == i, F.expr(f"shiftleft(1L, cast(pmod(h div {SKETCH}, 64) as int))")).otherwise(F.lit(0).cast("long"))).alias(f"s{i}") for i in range(SKETCH)]
    ranked = flat.join(often, "h").groupBy("id", *own).agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("often", "h"))).alias("ms"), *sketch)
    length = (F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).cast("int")
    bits = [f"s{i}" for i in range(SKETCH)]
    prefix = ranked.select("id", *own, "n", *bits, F.posexplode(F.slice("ms", F.lit(1), length)).alias("i", "p")).withColumn("key", F.col("p.h")).drop("p")
    a, b = (prefix.where(fresh) if fresh else prefix).alias("a"), prefix.alias("b")
    sized = (F.col("a.n") >= least * F.col("b.n") - 1e-9) & (F.col("b.n") >= least * F.col("a.n") - 1e-9)
    # the first element that near sets share leaves enough behind it in both
    enough = F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i")) >= least / (1 + least) * (F.col("a.n") + F.col("b.n")) - 1e-9
    apart = sum((F.bit_count(F.col(f"a.{x}").bitwiseXOR(F.col(f"b.{x}"))) for x in bits[1:]), F.bit_count(F.col("a.s0").bitwiseXOR(F.col("b.s0"))))
    alike = apart <= (1 - least) / (1 + least) * (F.col("a.n") + F.col("b.n")) + 1e-9
    once = (F.col("a.id") < F.col("b.id")) if fresh is None else (F.col("a.id") < F.col("b.id")) | (~F.col(f"b.{fresh}") & (F.col("a.id") != F.col("b.id")))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.w") == F.col("b.w")) & once & sized & enough & alike)
    pairs = pairs.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()
    of = lambda side: sets.select(F.col("id").alias(side), F.col("members").alias(f"of_{side}"))
    near = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", jaccard(F.col("of_a"), F.col("of_b")).alias("jaccard"))
    return near.where(F.col("jaccard") >= least - 1e-9)


def dealt(rows: DataFrame, within: str, block: int) -> DataFrame:
    """``rows`` (id, ``within``) once for each pair of blocks (``x`` <= ``y``) of their ``within`` that they have a part in.

    Rows of one ``within`` are dealt into blocks (``own``) of about ``block``, so a pair of blocks bounds what a task holds.
    """
    sizes = work_table(rows.groupBy(within).agg(F.ceil(F.count("*") / block).alias("__n")), "blocks")
    own = rows.join(sizes, within).withColumn("own", F.pmod(F.xxhash64("id"), F.col("__n")))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    return met.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("__n", "other")


def cosine_links(vectors: DataFrame, least: float, block: int = 20000, tile: int = 1000) -> DataFrame:
    """Links (a, b) of cosine >= ``least`` that connect what all such pairs of ``vectors`` (id, v) do.

    A pair of blocks is one task's: it multiplies tile by tile only rows that its links don't connect yet, and passes on
    one link for each two groups that meet, at most one less than its rows. So neither shuffle nor product grows with the pairs.
    """

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
        ids, own = pdf["id"].to_numpy(), pdf["own"].to_numpy()
        m = np.array(pdf["v"].tolist(), float).reshape(len(pdf), -1)
        m /= np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)
        of, out = np.arange(len(pdf)), []

        def meet(rows: np.ndarray, others: np.ndarray) -> None:
            if not len(rows) or not len(others):
                return
            near = m[rows] @ m[others].T >= least
            for i in np.flatnonzero(near.any(axis=1)):
                at = others[near[i]]
                groups, first = np.unique(of[at], return_index=True)
                new = groups != of[rows[i]]
                if new.any():
                    out.extend((ids[rows[i]], ids[j]) for j in at[first[new]])
                    of[np.isin(of, groups[new])] = of[rows[i]]

        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        for i in range(0, len(left), tile):
            for j in range(i if x == y else 0, len(right), tile):
                a, b = left[i : i + tile], right[j : j + tile]
                groups, n = np.unique(of[np.concatenate([a, b])], return_counts=True)
                if len(groups) > 1:
                    main = groups[n.argmax()]
                    meet(a[of[a] != main], b)
                    meet(b[of[b] != main], a)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    rows = dealt(vectors.select("id", "v", F.lit(0).alias("w")), "w", block)
    return rows.groupBy("x", "y").applyInPandas(link, "a long, b long")


def pair_bits(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text how many different pairs of neighbouring characters it has, and 256 bits that these set."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts), dtype=np.uint64), [len(t) for t in texts])
    inside = row[1:] == row[:-1]
    pairs = np.unique((row[1:][inside] << np.uint64(42)) | (codes[:-1][inside] << np.uint64(21)) | codes[1:][inside])
    at = (pairs >> np.uint64(42)).astype(np.int64)
    h = ((pairs & np.uint64((1 << 42) - 1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
    bits = np.zeros((len(texts), 4), np.uint64)
    np.bitwise_or.at(bits, (at, (h >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (h & np.uint64(63)))
    return np.bincount(at, minlength=len(texts)), bits


def alike(n: np.ndarray, bits: np.ndarray, left: np.ndarray, right: np.ndarray, least: float, same: bool):
    """Places (i, j) of ``left`` and ``right``, tile by tile, whose bits differ in no more than near sets do; nothing near is left out."""
    share = (1 - least) / (1 + least)
    left, right = left[np.argsort(n[left], kind="stable")], right[np.argsort(n[right], kind="stable")]
    for i in range(0, len(left), 64):
        a = left[i : i + 64]
        low, high = np.searchsorted(n[right], least * n[a[0]] - 1e-9), np.searchsorted(n[right], n[a[-1]] / least + 1e-9, "right")
        for j in range(max(low, i) if same else low, high, 4096):
            b = right[j : min(j + 4096, high)]
            apart = np.zeros((len(a), len(b)), np.uint16)
            for k in range(bits.shape[1]):
                apart += np.bitwise_count(bits[a, k][:, None] ^ bits[b, k][None, :])
            p, q = np.nonzero(apart <= share * (n[a[-1]] + n[b[-1]]) + 1e-9)
            keep = apart[p, q] <= share * (n[a[p]] + n[b[q]]) + 1e-9
            if same:
                keep &= q + j > p + i
            yield a[p[keep]], b[q[keep]]


def bigram_pairs(texts: DataFrame, least: float, within: str, block: int = 20000, fresh: str | None = None, home: str | None = None, most: int | None = None) -> DataFrame:
    """(a, b, jaccard) of ``texts`` (id, norm, ``within``) of one ``within`` whose pairs of characters are near enough.

    Exact. Pairs of characters are few and most texts share their rare ones too, so there is no key that near texts
    meet on: blocks of texts are compared by bits, thousands at a time, and those whose bits are near by their sets.

    With ``fresh`` or ``home``, boolean columns, pairs of two texts that aren't are left out. With ``most``, texts are also
    not more than it apart in time, from one's ``last`` to the other's ``first``, and what comes out is only links
    that connect what all pairs do: at most one less than a task's texts, however many are near.
    """
    flags = [c for c in (fresh, home) if c]
    cols = ["id", "norm", *flags, *(["first", "last"] if most is not None else [])]

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
        ids, own, norms = pdf["id"].to_numpy(), pdf["own"].to_numpy(), pdf["norm"].tolist()
        n, bits = pair_bits(norms)
        marks = [pdf[c].to_numpy(bool) for c in flags]
        times = (pdf["first"].to_numpy(), pdf["last"].to_numpy()) if most is not None else None
        of, out, sets = np.arange(len(pdf)), [], {}

        def grams(i: int) -> set:
            if i not in sets:
                sets[i] = {norms[i][k : k + 2] for k in range(len(norms[i]) - 1)}
            return sets[i]

        def compare(left: np.ndarray, right: np.ndarray, same: bool) -> None:
            for i, j in alike(n, bits, left, right, least, same):
                keep = np.ones(len(i), bool)
                for mark in marks:
                    keep &= mark[i] | mark[j]
                if times is not None:
                    keep &= np.maximum(times[0][i], times[0][j]) - np.minimum(times[1][i], times[1][j]) <= most
                i, j = i[keep], j[keep]
                while len(i):
                    # what is linked already goes between slices
                    if times is not None:
                        apart = of[i] != of[j]
                        i, j = i[apart], j[apart]
                    for p, q in zip(i[:256].tolist(), j[:256].tolist(), strict=True):
                        if times is not None and of[p] == of[q]:
                            continue
                        both = len(grams(p) & grams(q))
                        jaccard = both / (n[p] + n[q] - both)
                        if jaccard >= least - 1e-9:
                            out.append((min(ids[p], ids[q]), max(ids[p], ids[q]), jaccard))
                            if times is not None:
                                of[of == of[q]] = of[p]
                    i, j = i[256:], j[256:]

        first = marks[0] if marks else np.ones(len(pdf), bool)
        l1, l0 = np.flatnonzero((own == x) & first), np.flatnonzero((own == x) & ~first)
        if x == y:
            compare(l1, l1, True)
            compare(l1, l0, False)
        else:
            r1, r0 = np.flatnonzero((own == y) & first), np.flatnonzero((own == y) & ~first)
            for a, b in ((l1, r1), (l1, r0), (l0, r1)):
                compare(a, b, False)
        return pd.DataFrame(out, columns=["a", "b", "jaccard"]).astype({"a": "int64", "b": "int64", "jaccard": "float64"})

    rows = dealt(texts.where(F.length("norm") >= 2).select(*cols, F.xxhash64(within).alias("w")), "w", block)
    return rows.groupBy("w", "x", "y").applyInPandas(near, "a long, b long, jaccard double")


#: Links' ends that a task holds at once when it joins what its own links connect.
HELD = 1 << 20


def stars(links: DataFrame, held: int = HELD) -> DataFrame:
    """Links (a, b) that connect what ``links`` (a, b) do: each task leads its own links' ends to the least they reach.

    A task passes on what it has whenever it holds ``held`` ends, so its memory is bounded.
    """
    kind = links.schema["a"].dataType.simpleString()

    def join(batches):
        above: dict = {}

        def top(x):
            while above.setdefault(x, x) != x:
                above[x] = x = above[above[x]]
            return x

        def out():
            ends = [x for x in above if top(x) != x]
            return pd.DataFrame({"a": ends, "b": [top(x) for x in ends]})

        for pdf in batches:
            for x, y in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
                x, y = top(x), top(y)
                above[max(x, y)] = min(x, y)
            if len(above) >= held:
                yield out()
                above.clear()
        yield out()

    return links.select("a", "b").mapInPandas(join, f"a {kind}, b {kind}")


def groups(ids: DataFrame, links: DataFrame, held: int = HELD) -> DataFrame:
    """(id, group): the least id that ``links`` (a, b) reach from each of ``ids`` (id).

    Tasks first join what their own links connect. Then labels take the least of their neighbours', a
    label leads all its rows to the least that any of them meets, and labels take their label's own
    label; so rounds grow with the logarithm of a chain. Each round is grouped minimums and joins, and its table is written.
    """
    whole = links.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct()
    near = work_table(stars(whole, held), "stars")
    both = work_table(near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    alone = ids.select("id").distinct()
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("group"))
    while True:
        met = both.join(labels.select(F.col("id").alias("b"), "group"), "b").groupBy(F.col("a").alias("id")).agg(F.min("group").alias("near"))
        step = work_table(labels.join(met, "id").select("id", F.col("group").alias("old"), F.least("group", "near").alias("mid")), "steps")
        lower = step.where("mid < old")
        if lower.isEmpty():
            return alone.join(step.select("id", F.col("mid").alias("group")), "id", "left").select("id", F.coalesce("group", "id").alias("group"))
        hooks = lower.groupBy(F.col("old").alias("mid")).agg(F.min("mid").alias("hook"))
        jump = step.select(F.col("id").alias("mid"), F.col("mid").alias("own")).join(hooks, "mid", "left").select("mid", F.least("own", "hook").alias("further"))
        labels = work_table(step.select("id", "mid").join(jump, "mid").select("id", F.least("mid", "further").alias("group")), "labels")


def anchor_clusters(posts: DataFrame, least: float = 0.78, hours: float = 12.0, most: int = 50, newest: int = 3000, gate=None) -> DataFrame:
    """(id, cluster_id) of the ``newest`` posts (id, scraped_at, title, v), clustered as they came.

    By time, then id: each joins the nearest anchor of cosine ``least`` or more within ``hours`` whose
    cluster has room (of equals the later one) and which ``gate(title, anchor_title)`` lets pass, or
    becomes an anchor. Without a vector it stays alone. Names come from the least member's id.
    The order makes this one task's work; ``newest`` bounds it, as the feature asks.
    """
    top = posts.select("id", F.unix_micros(F.col("scraped_at").cast("timestamp")).alias("at"), "title", "v").orderBy(F.desc("at"), F.desc("id")).limit(newest)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "id"])
        anchors, matrix, members = [], [], []
        out = np.zeros(len(pdf), int)
        for i, (at, title, v) in enumerate(zip(pdf["at"], pdf["title"], pdf["v"], strict=True)):
            v = None if v is None or not len(v) or not np.any(v) else np.asarray(v, float) / np.linalg.norm(np.asarray(v, float))
            best = -1
            if v is not None and matrix:
                cosines = np.array([m @ v if m is not None and len(m) == len(v) else -1.0 for m in matrix])
                for k in np.argsort(-cosines, kind="stable"):
                    if cosines[k] < least:
                        break
                    if best >= 0 and cosines[k] < cosines[best]:
                        break
                    if at - anchors[k][0] <= hours * 3.6e9 and members[k] < most and (gate is None or gate(title, anchors[k][1])):
                        best = int(k)
            if best < 0:
                anchors.append((at, title))
                matrix.append(v)
                members.append(0)
                best = len(anchors) - 1
            members[best] += 1
            out[i] = best
        least_id = pdf.groupby(out)["id"].transform("min") if len(pdf) else pdf["id"]
        return pd.DataFrame({"id": pdf["id"], "cluster_id": ["v8-cluster-" + str(x) for x in least_id]})

    return top.groupBy().applyInPandas(walk, "id long, cluster_id string")


def echo(posts: DataFrame, vectors: DataFrame, least: float, alpha: float = 0.25, cap: float = 1.0, hours: float | None = None) -> DataFrame:
    """(id, echo): 1 + min(alpha sqrt(n) mean authority, cap) over near posts of other channels.

    ``posts`` has id, channel and authority, ``vectors`` id and v, and at if posts must be within ``hours``.
    """
    pairs = cosine_pairs(vectors, least, hours=hours).select("a", "b")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    of = lambda side: posts.select(F.col("id").alias(side), F.col("channel").alias(f"channel_{side}"), F.col("authority").alias(f"authority_{side}"))
    near = both.join(of("a"), "a").join(of("b"), "b").where("channel_a <> channel_b")
    found = near.groupBy(F.col("a").alias("id")).agg((1 + F.least(alpha * F.sqrt(F.count("*")) * F.avg("authority_b"), F.lit(cap))).alias("echo"))
    return posts.select("id").join(found, "id", "left").select("id", F.coalesce("echo", F.lit(1.0)).alias("echo"))


def issue_cards(scored: DataFrame, top: int = 10, alpha: float = 0.25, sources: int = 2) -> DataFrame:
    """One card per cluster: the sum of its ``top`` scores times its breadth, with a title by channel.

    ``scored`` has id, cluster_id, source_key, channel, title and trend_score. Only clusters of several
    sources with a news or portal post become cards. The best scores are limited in each task before they
    are sorted together, and all else is summed in parts, so a large cluster is no one task's work.
    Scores count to six places, and ``issue_score`` is a decimal: the order of sums can't move it across a rounding.
    """
    df = work_table(scored.select("id", "cluster_id", "source_key", "channel", "title", "trend_score"), "cards")
    best = Window.partitionBy("cluster_id").orderBy(F.desc("trend_score"), "id")
    priority = F.when(F.col("channel") == "news", 0).when(F.col("channel") == "portal", 1).when(F.col("channel") == "video", 2).otherwise(3)
    count = lambda kind: F.count_if(F.col("channel").isin(*kind))
    cards = df.groupBy("cluster_id").agg(
        F.count("*").alias("posts"), F.countDistinct("source_key").alias("n_sources"), F.countDistinct("channel").alias("n_channels"),
        count(("news", "portal")).alias("news_posts"), count(("community",)).alias("community_posts"), count(("video",)).alias("video_posts"), F.min("id").alias("first_id"),
        F.min_by("title", F.struct(priority, -F.col("trend_score"), F.col("id").isNull(), "id", "title")).alias("title"),
    )
    cards = cards.where((F.col("n_sources") >= sources) & (F.col("news_posts") >= 1))
    sums = df.withColumn("__rn", F.row_number().over(best)).where(F.col("__rn") <= top).groupBy("cluster_id").agg(F.sum(F.col("trend_score").cast("decimal(14,6)")).alias("sum_top"))
    breadth = (1 + F.lit(Decimal(str(alpha))) * (F.col("n_channels") - 1).cast("decimal(4,0)")).cast("decimal(8,4)")
    return cards.join(sums, "cluster_id").withColumn("issue_score", F.col("sum_top") * breadth).drop("sum_top")


def rank_changes(current: DataFrame, before: DataFrame, overlap: float = 0.5) -> DataFrame:
    """``current`` (stable_id, rank, members) with rank_change from ``before``'s rows of the same shape.

    A row's past self has its stable_id, else is the best ranked row that shares ``overlap`` of the
    larger one's members. Positive is up; null is new.
    """
    same = current.join(before.select("stable_id", F.col("rank").alias("was")), "stable_id", "left")
    lost = same.where("was IS NULL").select("stable_id", "rank", F.size("members").alias("n"), F.explode("members").alias("m"))
    old = before.select(F.col("rank").alias("old"), F.col("stable_id").alias("old_id"), F.size("members").alias("n_old"), F.explode("members").alias("m"))
    shared = lost.join(old, "m").groupBy("stable_id", "rank", "n", "old", "old_id", "n_old").agg(F.count("*").alias("k"))
    fuzzy = shared.where(F.col("k") / F.greatest("n", "n_old") >= overlap).groupBy("stable_id").agg(F.min("old").alias("old"))
    out = same.join(fuzzy, "stable_id", "left")
    return out.select("stable_id", "rank", (F.coalesce("was", "old") - F.col("rank")).alias("rank_change"))
