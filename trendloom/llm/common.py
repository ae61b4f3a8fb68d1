"""Helpers shared by the corpus operators: work tables and vectorised word hashing."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are cut into pieces of about this many bytes, so a worker's arrays stay small.
CHUNK = 1 << 19


def work_root(spark: SparkSession) -> str:
    """The shared folder for work tables: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder of its own; a cluster has no such
    folder that all executors see, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="trendloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: The work tables of each open ``work_tables`` scope, innermost last; each thread has its own scopes.
_scopes: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())


def work_path(spark: SparkSession, name: str, outer: bool = False) -> str:
    """A new path in the shared folder; the innermost ``work_tables`` scope removes it, or the one around that."""
    path = f"{work_root(spark)}/trendloom/{name}-{uuid.uuid4().hex}"
    scopes = _scopes.get()
    if len(scopes) > outer:
        scopes[-1 - outer].append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet work table in the shared folder and return the table.

    This cuts the lineage: what a lost executor held is read again from the shared folder.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def work_tables(spark: SparkSession):
    """Removes the work tables that were made within, also after an error; what was lazy must be written by then."""
    own: list[str] = []
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in own:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a work table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def tidy(query):
    """A query (spark, sf_dir) whose result is one written table; its other work tables are removed."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with work_tables(spark):
            out = query(spark, sf_dir)
            path = f"{work_root(spark)}/trendloom/{query.__name__}-{uuid.uuid4().hex}"
            out.write.parquet(path)
        return spark.read.schema(out.schema).parquet(path)

    return run


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts`` (null ids count as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def table_of(values: list[float], kind: str = "array<double>") -> Column:
    """A constant array column that Catalyst folds into one literal."""
    return F.from_json(F.lit("[" + ",".join(repr(v) for v in values) + "]"), kind)


# --- word hashing -----------------------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        ones = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        for t in ones:
            t[0] = 1
        _powers = np.multiply.accumulate(ones[0]), np.multiply.accumulate(ones[1])
    return _powers


class Words:
    """Splits UTF-8 bytes into words and hashes them; A-Z count as a-z.

    ``separator`` is a 256-entry boolean table of the bytes between words. Bytes of 0x80 and more
    belong to characters of several bytes, so a table either splits at all of them or at none.
    """

    def __init__(self, separator: np.ndarray):
        self.separator = separator
        values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
        values[65:91] = values[97:123]
        values[separator] = 0
        self.values = values

    def split(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, end) of each word in ``data``; words also end where a text begins."""
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        gap = self.separator[data]
        cut = np.empty(len(data) + 1, bool)
        cut[0] = cut[-1] = True
        cut[1:-1] = gap[:-1]
        cut[begins[begins < len(data)]] = True
        starts = np.flatnonzero(cut[:-1] & ~gap)
        cut[1:-1] = gap[1:]
        cut[0] = False
        cut[:-1] = cut[1:]
        cut[begins[(begins > 0) & (begins < len(data))] - 1] = True
        cut[len(data) - 1] = True
        ends = np.flatnonzero(cut[:-1] & ~gap) + 1
        power, inverse = _power_tables(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * power[: len(data)], out=total[1:])
        hashes = (total[ends] - total[starts]) * inverse[starts]
        return mix(hashes + (ends - starts).astype(np.uint64) * _M2), starts, ends

    def texts(self, column: pa.Array):
        """Yields (row, hashes, bytes, starts, ends) for each text of an Arrow column, in order.

        Nulls count as empty. Long texts are hashed in pieces that end at separators; ``bytes`` is
        the whole text and ``starts`` and ``ends`` are offsets in it.
        """
        column = pc.fill_null(column, "").cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        body = column.buffers()[2]
        body = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        row = 0
        while row < len(column):
            last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
            lo, hi = int(offsets[row]), int(offsets[last])
            if last == row + 1 and hi - lo > CHUNK:
                yield (row, *self._long(body[lo:hi]))
            else:
                begins = offsets[row : last + 1] - lo
                hashes, starts, ends = self.split(body[lo:hi], begins)
                edge = np.searchsorted(starts, begins)
                for k in range(last - row):
                    a, b, at = edge[k], edge[k + 1], begins[k]
                    yield row + k, hashes[a:b], body[lo + at : lo + begins[k + 1]], starts[a:b] - at, ends[a:b] - at
            row = last

    def _long(self, data: np.ndarray):
        parts, at = [], 0
        while at < len(data):
            stop = at + CHUNK
            if stop < len(data):
                gaps = np.flatnonzero(self.separator[data[at:stop]])
                while not len(gaps) and stop < len(data):  # one word longer than a piece
                    stop += CHUNK
                    gaps = np.flatnonzero(self.separator[data[at:stop]])
                stop = at + int(gaps[-1]) + 1 if len(gaps) and stop < len(data) else min(stop, len(data))
            h, s, e = self.split(data[at:stop], np.zeros(1, np.int64))
            parts.append((h, s + at, e + at))
            at = stop
        h, s, e = (np.concatenate(x) for x in zip(*parts, strict=True))
        return h, data, s, e


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Words are runs of anything but space and 0x09-0x0D.
SPACED = Words(_table((0x20, 0x20), (0x09, 0x0D)))
#: Words are runs of letters, digits and all characters beyond ASCII.
ALNUM = Words(_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)) & ~_table((0x41, 0x5A)))


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of ``size`` words; fewer words make one shingle of them all."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        out = mix(out * _M1 + words[i : len(words) - size + 1 + i])
    return out


# --- Bloom filters of fixed size --------------------------------------------------------------


class Bloom:
    """A Bloom filter of a fixed number of bits, so that broadcasting it is bounded at any input.

    It only spares rows that can't match; what passes is still joined exactly.
    """

    BITS = 1 << 25

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def _places(keys: np.ndarray) -> tuple[np.ndarray, ...]:
        keys = mix(keys.astype(np.uint64, copy=False))
        return tuple(((keys >> np.uint64(s)) & np.uint64(Bloom.BITS - 1)).astype(np.int64) for s in (0, 19, 38))

    @classmethod
    def of(cls, df: DataFrame, column: str) -> Bloom:
        """Of a long column. Tasks make bit maps; they are merged in two steps of bounded size."""

        def local(batches):
            bits, seen = np.zeros(cls.BITS // 8, np.uint8), False
            for b in batches:
                keys = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                seen |= len(keys) > 0
                for p in cls._places(keys):
                    np.bitwise_or.at(bits, p >> 3, np.uint8(1) << (p & 7).astype(np.uint8))
            if seen:
                used = np.flatnonzero(bits)
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(bits[used].astype(np.int32))], ["place", "bits"])

        sparse = df.select(F.col(column).cast("long").alias("k")).where("k IS NOT NULL").mapInArrow(local, "place int, bits int")
        merged = sparse.groupBy("place").agg(F.bit_or("bits").alias("bits"))

        def pack(batches):
            for b in batches:
                place, bits = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([place.astype("<i4").tobytes()]), pa.array([bits.astype("u1").tobytes()])], ["place", "bits"])

        out = np.zeros(cls.BITS // 8, np.uint8)
        # At most BITS / 8 places exist, 5 bytes each: 20 MB however large the input is.
        # In few tasks, as the driver fetches one task's part after the other.
        for row in merged.coalesce(4).mapInArrow(pack, "place binary, bits binary").toLocalIterator():
            out[np.frombuffer(row.place, "<i4")] = np.frombuffer(row.bits, "u1")
        return cls(out)

    def has(self, keys: np.ndarray) -> np.ndarray:
        hit = np.ones(len(keys), bool)
        for p in self._places(keys):
            hit &= (self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
        return hit


# --- sums of fixed-size arrays ----------------------------------------------------------------


def summed(parts: DataFrame, length: int) -> np.ndarray:
    """The element-wise sum of a binary column ``part`` of ``length`` doubles, one row a task.

    Rows are summed on the executors in two steps, so the driver gets a few arrays however many
    tasks there were.
    """

    def add(batches):
        total, seen = np.zeros(length), False
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_buffer(), np.float64)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["part"])

    tasks = max(1, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    once = parts.select("part").repartition(tasks).mapInArrow(add, "part binary")
    total = np.zeros(length)
    for row in once.repartition(4).mapInArrow(add, "part binary").collect():
        total += np.frombuffer(row.part, np.float64)
    return total
