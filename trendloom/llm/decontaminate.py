"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is a set of windows of 13 words, a window a set of 5-word shingles. For a window
to occur whole, each of its shingles must, so its rarest one is the necessary prefix: documents and
windows are joined on that, bounded by the shingle's place in either, and then compared word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM, Bloom, materialize, read, shingles, tidy

#: Words of a window and of a shingle; a document is contaminated from one hit word in so many.
WINDOW, SHINGLE, SHARE = 13, 5, 20
#: Rows of windows that a task gathers before it passes them on.
SLICE = 20_000


def _plain(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> str:
    """The words, A-Z lower-cased, joined by spaces."""
    if not len(start):
        return ""
    part = data[start[0] : end[-1]].copy()
    upper = (part >= 65) & (part <= 90)
    part[upper] += 32
    part[ALNUM.separator[part] & ~upper] = 32
    return " ".join(part.tobytes().decode().split(" ")) if len(start) == 1 else " ".join(w for w in part.tobytes().decode().split(" ") if w)


def _windows(batches):
    """item_id, text -> a row for each shingle of each distinct window of the item; an item's windows leave
    in slices, so a long item isn't held whole."""
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32()]
    for batch in batches:
        for row, words, data, start, end in ALNUM.texts(batch.column(1)):
            item = batch.column(0)[row].as_py()
            size, seen, out = min(WINDOW, len(words)), set(), []
            for at in range(len(words) - size + 1 if size else 0):
                own = shingles(words[at : at + size], SHINGLE).view(np.int64)
                if (key := own.tobytes()) not in seen:
                    seen.add(key)
                    text = _plain(data, start[at : at + size], end[at : at + size])
                    out += [(item, text, size, int(h), k) for k, h in enumerate(own)]
                if len(out) > SLICE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["item_id", "words", "size", "shingle", "place"])
                    out, seen = [], set()  # windows that come again are made distinct before they are joined
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["item_id", "words", "size", "shingle", "place"])


def _passages(bloom, sizes: list[int]):
    """doc_id, text -> doc_id, key, n_words, and the passages around shingles that may be a window's.

    A passage is (first word's place, words); passages that touch are one. Shingles have ``SHINGLE``
    words, or fewer where an item has fewer.
    """
    reach = WINDOW

    def step(batches):
        known = bloom.value
        for batch in batches:
            keys, counts, found = [], [], []
            for _, words, data, start, end in ALNUM.texts(batch.column(1)):
                n = len(words)
                keys.append(xxhash.xxh3_128_digest(data.tobytes()))
                counts.append(n)
                hit = np.zeros(n + 1, np.int32)
                for size in sizes:
                    if n >= size:
                        at = np.flatnonzero(known.has(shingles(words, size)))
                        np.add.at(hit, np.maximum(at - reach, 0), 1)
                        np.add.at(hit, np.minimum(at + size + reach, n), -1)
                out = []
                if hit.any():
                    inside = np.concatenate([[False], np.cumsum(hit[:-1]) > 0, [False]])
                    edge = np.flatnonzero(inside[1:] != inside[:-1])
                    out = [{"first": int(a), "words": _plain(data, start[a:b], end[a:b])} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                found.append(out)
            kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(found, kind)], ["doc_id", "key", "n_words", "passages"])

    return step


def _shingle_rows(sizes: list[int]):
    """key, first, words -> a row for each shingle: its hash, size, place in the document."""

    def step(batches):
        for batch in batches:
            out = []
            for row, words, *_ in ALNUM.texts(batch.column(2)):
                first = batch.column(1)[row].as_py()
                for size in sizes:
                    if len(words) >= size:
                        h = shingles(words, size).view(np.int64)
                        out.append((np.full(len(h), row), h, np.full(len(h), size), first + np.arange(len(h))))
            if not out:
                continue
            row, h, size, at = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(h), pa.array(size, pa.int32()), pa.array(at, pa.int32())], ["key", "first", "shingle", "size", "at"])

    return step


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies inside an occurrence of a window of an item of ``benchmark`` (item_id,
    text). Documents are read once: shingles that a Bloom filter of fixed size passes give short
    passages, and all else works on these.

    Nulls: a null text has no words, as a document or an item; items of null item_id are matched,
    but not listed; a null doc_id stays. An item of fewer than 13 words is one window of all of them.
    Repeated items count once by id; repeated documents each give a row. Without items or documents
    nothing is hit. Texts and items of any length are compared whole. Other columns don't matter.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    parts = materialize(items.mapInArrow(_windows, "item_id string, words string, size int, shingle long, place int"), "bench-windows")
    sizes = sorted(min(SHINGLE, r.size) for r in parts.select(F.least("size", F.lit(SHINGLE)).alias("size")).distinct().collect())
    bloom = spark.sparkContext.broadcast(Bloom.of(parts, "shingle"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = materialize(texts.mapInArrow(_passages(bloom, sizes), "doc_id long, key binary, n_words long, passages array<struct<first:int,words:string>>"), "bench-passages")

    # equal texts have equal passages: one of each is enough
    passages = scanned.where("size(passages) > 0").select("key", "n_words", F.explode("passages").alias("p")).select("key", "n_words", "p.first", "p.words")
    met = passages.select("key", "first", "words").mapInArrow(_shingle_rows(sizes), "key binary, first int, shingle long, size int, at int")
    wanted = parts.select("shingle").distinct()
    rarity = met.join(wanted, "shingle").groupBy("shingle").agg(F.count("*").alias("often"))
    # windows with a shingle that occurs nowhere can't occur
    windows = parts.select("words", "size", "shingle", "place").distinct()
    ordered = windows.join(rarity, "shingle", "left").groupBy("words", "size").agg(
        F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "shingle", "place")).alias("rarest")
    )
    prefixes = materialize(ordered.where("rarest.often > 0").select("words", "size", "rarest.shingle", "rarest.place"), "bench-prefixes")

    once = passages.dropDuplicates(["key", "first"])
    places = once.select("key", "first", "words").mapInArrow(_shingle_rows(sizes), "key binary, first int, shingle long, size int, at int").select("key", "first", "shingle", "at")
    begin = F.col("at") - F.col("place")
    candidates = places.join(prefixes, "shingle").select("key", "first", begin.alias("begin"), F.col("words").alias("window"), "size").distinct()
    candidates = candidates.where("begin >= first").join(once, ["key", "first"]).where("begin + size <= n_words")
    # positions within the passage: the window's words follow the first (begin - first) words
    here = F.array_join(F.slice(F.split("words", " "), F.col("begin") - F.col("first") + 1, F.col("size")), " ")
    found = materialize(candidates.where(here == F.col("window")).select("key", "begin", (F.col("begin") + F.col("size")).alias("stop"), "window"), "bench-found")

    spans = found.groupBy("key", "begin").agg(F.max("stop").alias("stop"))
    before = F.max("stop").over(Window.partitionBy("key").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("begin", F.coalesce(before, F.col("begin"))))
    hits = spans.select("key", fresh.alias("fresh")).groupBy("key").agg(F.sum("fresh").alias("n_hit"))
    owners = parts.where("item_id IS NOT NULL").select(F.col("words").alias("window"), "item_id").distinct()
    listed = found.select("key", "window").distinct().join(owners, "window").groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    decided = hits.join(listed, "key", "left")
    clean = scanned.where("size(passages) = 0").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    rest = scanned.where("size(passages) > 0").select("doc_id", "key", "n_words").join(decided, "key", "left")
    rest = rest.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return clean.unionByName(rest).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


@tidy
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
