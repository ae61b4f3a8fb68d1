"""Token counts by separator scan of flat token files.

A flat token file is nothing but token ids of a fixed width, one document after the other, each
ended by the end-of-document id. Files are searched for that id block by block, each block with one
vectorised comparison; prefix sums over the blocks say which documents cross their boundaries.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read, tidy, work_path

#: Where the public tokenizers' files are, and the end-of-document id, which that vocabulary leaves free.
VOCABULARY, END = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256
#: How that vocabulary's texts are cut before byte pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of an id.
WIDTH = 2
#: Texts that a task tokenizes before it passes their tokens on.
SLICE = 256
#: Tokens of a block; blocks of a run in the two-step prefix scan.
BLOCK, RUN = 1 << 16, 1 << 10

#: White space runs of this length are set apart, as the pattern's engine can't match them.
LONG_SPACE = re.compile("[\t-\r \x85\xa0  -     　]{5000,}")

_encoders: dict = {}


def encoder(ranks_file: bytes):
    """The tokenizer of a ranks file's content; made once a worker."""
    import tiktoken

    key = hash(ranks_file)
    if key not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def encode(tokenizer, text: str | None) -> list[int]:
    """Ids of a whole text; special tokens' strings are ordinary text, null is empty."""
    out, at = [], 0
    text = text or ""
    for run in LONG_SPACE.finditer(text):
        # the last space of a run belongs to what follows
        stop = run.end() - (run.end() < len(text))
        out += tokenizer.encode_ordinary(text[at : run.start()])
        out += tokenizer._encode_single_piece(text[run.start() : stop])
        at = stop
    return out + tokenizer.encode_ordinary(text[at:])


def write_token_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END, width: int = WIDTH) -> None:
    """Writes the ``text`` of ``docs`` as flat token files below ``path``/kind=tokens.

    Each task writes the file of its rows, and of the same name below ``kind=ids`` the rows' doc_ids
    in order, 9 bytes each (1 if null, 8 of the number) and the separator. Where a setting limits
    a file's records, both kinds go on in further files alike. Spark's
    writer commits both together, so they agree however often a task is tried. A null or empty text
    has no tokens, only its separator.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(content_of(spark, vocabulary))
    kind = np.dtype(f"<u{width}")

    def step(batches):
        tokenizer = encoder(ranks.value)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                values = [np.array(encode(tokenizer, x.as_py()), kind).tobytes() for x in b.column(1)]
                ids = [bytes([x is None]) + (x or 0).to_bytes(8, "little", signed=True) for x in b.column(0).to_pylist()]
                for name, value in (("tokens", values), ("ids", ids)):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), b.column(2), pa.array(value, pa.binary())], ["kind", "at", "value"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("at", F.monotonically_increasing_id())
    out = rows.mapInArrow(step, "kind string, at long, value binary").sortWithinPartitions("kind", "at")
    separator = np.array([end], kind).tobytes().decode("latin-1")
    # the text writer writes the bytes of a string as they are
    out.select("kind", F.col("value").cast("string").alias("value")).write.partitionBy("kind").option("encoding", "ISO-8859-1").option("lineSep", separator).text(path)


def content_of(spark: SparkSession, path: str) -> bytes:
    """A small file's content. A path without a scheme is the driver's own, as the tokenizers' are."""
    if "://" not in path and not path.startswith("file:"):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).first().content)


def scan_token_files(spark: SparkSession, path: str, end: int = END, width: int = WIDTH, block: int = BLOCK, run: int = RUN) -> DataFrame:
    """(file, part, ordinal, start, n_tokens) of each document of the token files at ``path``.

    ``part`` is the file's name without its folder, ``ordinal`` the document's place in its file from 0, ``start`` its first token's. The separator isn't counted. Tokens after a file's last
    separator are a document; an empty file has none, and neighbouring separators enclose an empty
    one. A file whose length isn't a multiple of ``width`` is an error. Each file is read by one
    task, which sees it as blocks; so files should be no larger than a task's memory allows.
    """
    kind = np.dtype(f"<u{width}")

    def blocks(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                content = content.as_buffer()
                if content.size % width:
                    raise ValueError(f"{name}: {content.size} bytes are no whole number of tokens")
                tokens = np.frombuffer(content, kind)
                out = []
                for k, at in enumerate(range(0, len(tokens), block)):
                    own = tokens[at : at + block]
                    cuts = np.flatnonzero(own == end)
                    head = int(cuts[0]) if len(cuts) else len(own)
                    out.append((name, name.rsplit("/", 1)[-1], k, at, len(own), head, len(cuts), at + int(cuts[-1]) + 1 if len(cuts) else None, (np.diff(cuts) - 1).tolist(), at + len(own) == len(tokens)))
                    if len(out) == 64:
                        yield _batch(out)
                        out = []
                if out:
                    yield _batch(out)

    found = spark.read.format("binaryFile").load(path).select("path", "content")
    found = materialize(found.mapInArrow(blocks, SCANNED), "token-blocks")
    # prefix scan in two steps: over the runs of a file, then over the blocks of a run
    placed = found.withColumn("run", F.floor(F.col("block") / run))
    runs = placed.groupBy("file", "run").agg(F.sum("cuts").alias("run_cuts"), F.max("last_cut").alias("run_last"))
    before = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("file", "run", F.sum("run_cuts").over(before).alias("cuts_before"), F.max("run_last").over(before).alias("last_before"))
    within = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    placed = placed.join(runs, ["file", "run"]).select(
        "*",
        (F.coalesce("cuts_before", zero) + F.coalesce(F.sum("cuts").over(within), zero)).alias("first"),
        F.coalesce(F.max("last_cut").over(within), F.col("last_before"), zero).alias("begun"),
    )
    # the document that the block's first separator ends began at `begun`, maybe blocks before
    reach = F.col("begin") + F.col("head") - F.col("begun")
    closed = F.when(F.col("cuts") > 0, F.concat(F.array(reach), F.col("inner"))).otherwise(F.array().cast("array<bigint>"))
    after = F.when(F.col("cuts") > 0, F.col("last_cut")).otherwise(F.col("begun"))
    left = F.col("begin") + F.col("size") - after
    sizes = F.when(F.col("final") & (left > 0), F.concat(closed, F.array(left))).otherwise(closed)
    each = placed.select("file", "part", "first", "begun", sizes.alias("sizes")).where("size(sizes) > 0")
    each = each.select("file", "part", "first", "begun", F.posexplode("sizes").alias("i", "n_tokens"))
    earlier = Window.partitionBy("file", "first").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("begun") + F.coalesce(F.sum(F.col("n_tokens") + 1).over(earlier), zero)
    return each.select("file", "part", (F.col("first") + F.col("i")).alias("ordinal"), start.alias("start"), "n_tokens")


SCANNED = "file string, part string, block long, begin long, size long, head long, cuts long, last_cut long, inner array<bigint>, final boolean"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), *[pa.int64()] * 6, pa.list_(pa.int64()), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in SCANNED.split(", ")])


def read_ids(spark: SparkSession, path: str, width: int = WIDTH) -> DataFrame:
    """(part, ordinal, doc_id) from the ``kind=ids`` files that ``write_token_files`` wrote."""
    record = np.dtype([("null", "u1"), ("id", "<i8"), ("end", f"<u{width}")])

    def step(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(content.as_buffer(), record)
                for at in range(0, len(x), BLOCK):
                    own = x[at : at + BLOCK]
                    yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[-1]] * len(own), pa.string()), pa.array(np.arange(at, at + len(own))), pa.array(own["id"].copy(), mask=own["null"] > 0)], ["part", "ordinal", "doc_id"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(step, "part string, ordinal long, doc_id long")


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, width: int = WIDTH) -> DataFrame:
    """(doc_id, part, ordinal, start, n_tokens): one row per row of ``docs`` (doc_id, text).

    The texts go to flat token files in the shared work folder; the counts come from the files alone.
    Null and empty texts have 0 tokens, a null doc_id stays, repeated rows each give a row, an empty
    table none. Texts of any length are tokenized whole. Other columns don't matter.
    """
    spark = docs.sparkSession
    path = work_path(spark, "token-files")
    write_token_files(docs, path, vocabulary, end, width)
    if spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).isEmpty():
        return spark.createDataFrame([], "doc_id long, part string, ordinal long, start long, n_tokens long")
    ids, found = read_ids(spark, f"{path}/kind=ids", width), scan_token_files(spark, f"{path}/kind=tokens", end, width)
    return ids.join(found, ["part", "ordinal"], "left").select("doc_id", "part", "ordinal", "start", "n_tokens")


@tidy
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents")).select("doc_id", "n_tokens")
