"""Shared plumbing of the training-data operators: shared storage, Arrow mapping, word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import shared_path


def handover(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends here and an executor lost later costs only a re-read.

    ``narrow`` rows (ids and hashes from a task that reads texts) are dealt anew by size first, so that they are few files.
    """
    return _write(df, shared_path(df.sparkSession, label), narrow)


def _write(df: DataFrame, path: str, narrow: bool) -> DataFrame:
    (df.hint("rebalance") if narrow else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a hand-over that no later plan reads."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


class Scratch:
    """Hand-overs of an operator that go once its result no longer needs them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __call__(self, df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
        """As ``handover``."""
        self.paths.append(shared_path(self.spark, label))
        return _write(df, self.paths[-1], narrow)

    def clear(self, leave: int = 0) -> None:
        """Delete all but the last ``leave`` hand-overs."""
        at = len(self.paths) - leave
        for path in self.paths[:at]:
            drop_path(self.spark, path)
        del self.paths[:at]


def split_join(rows: DataFrame, found: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``found``, an aggregate over ``keys``, so that Spark can split a hot key among tasks.

    It can do that only where both sides come straight from a shuffle made for the join. The hash that is added to
    the key makes the aggregate's rows be dealt anew, and takes the rows' shuffle apart from any other.
    """
    keyed = lambda df: df.withColumn("__key", F.xxhash64(*keys))
    return keyed(rows).join(keyed(found), [*keys, "__key"], how).drop("__key")


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished phases now: it does so when the driver's garbage is collected, which on a calm driver can be half an hour later."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, modulus: int):
    """crc32 of the value as text, modulo ``modulus``; a null value counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def not_replaced(keep: Sequence[str], names: Sequence[str]) -> list[str]:
    """The columns of ``keep`` that no name in ``names`` equals (case does not count)."""
    gone = {n.lower() for n in names}
    return [c for c in keep if c.lower() not in gone]


def map_rows(df: DataFrame, per_row: Callable, fields: list[T.StructField], keep: list[str], use: list[str]) -> DataFrame:
    """Apply ``per_row(*values of use) -> tuple`` to each row in Arrow batches; ``keep`` columns pass through untouched, but one with the name of a new field gives way to it.

    ``per_row`` may be a factory marked with ``.factory = True``; it is then called once per task.
    """
    keep = not_replaced(keep, [f.name for f in fields])
    cols = list(dict.fromkeys([*keep, *use]))
    slim = df.select(*[F.col(f"`{c}`") for c in cols])
    schema = T.StructType([slim.schema[c] for c in keep] + fields)
    arrow_types = [_arrow_type(f.dataType) for f in fields]
    names = [*keep, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = per_row() if getattr(per_row, "factory", False) else per_row
        for batch in batches:
            for small in small_batches(batch):
                inputs = [small.column(cols.index(c)).to_pylist() for c in use]
                results = [f(*row) for row in zip(*inputs, strict=True)]
                outs = list(zip(*results, strict=True)) if results else [[] for _ in fields]
                arrays = [small.column(cols.index(c)) for c in keep] + [pa.array(o, type=t) for o, t in zip(outs, arrow_types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return slim.mapInArrow(tidy(run), schema)


def small_batches(batch: pa.RecordBatch, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``max_bytes``; Python copies of the texts stay small."""
    if not batch.num_rows:
        return
    step = max(1, int(batch.num_rows * max_bytes / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)
    pa.default_memory_pool().release_unused()


def tidy(run: Callable) -> Callable:
    """An Arrow task that gives memory it no longer needs back to the system at its end: workers live on between tasks, and what their allocators keep would count against the executor."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return task


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


_MASK = (1 << 64) - 1
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h + np.uint64((0xA0761D6478BD642F * (seed + 1)) & _MASK)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the words of a UTF-8 byte string, without a Python object per word.

    A word's hash is the sum of ``code[byte] * m**i`` over its bytes, taken as a difference of prefix sums and
    divided by ``m**start`` (m is odd, so it has an inverse modulo 2**64). Such sums can collide on purpose for very
    long words only, so words of ``LONG`` bytes or more are hashed by BLAKE2b. The text is read in blocks that end
    between words, which bounds the memory beside the result. ``is_word_byte`` is a predicate on byte values; A-Z
    count as a-z.
    """

    BLOCK = 1 << 20
    LONG = 512

    def __init__(self, is_word_byte: Callable[[int], bool]):
        codes = mix(np.arange(256, dtype=np.uint64), 11) | np.uint64(1)
        for upper in range(65, 91):
            codes[upper] = codes[upper + 32]
        self.codes = np.array([codes[b] if is_word_byte(b + 32 if 65 <= b <= 90 else b) else 0 for b in range(256)], dtype=np.uint64)
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        step = np.full(n, _MULT, dtype=np.uint64)
        back = np.full(n, _INV, dtype=np.uint64)
        step[0] = back[0] = 1
        self.powers, self.inverses = np.multiply.accumulate(step), np.multiply.accumulate(back)

    @staticmethod
    def _long_word(word: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(word.lower(), digest_size=8).digest(), "little")

    def _word_end(self, data: bytes, at: int) -> int:
        """The end of the word that goes on at ``at``."""
        while at < len(data):
            gaps = np.flatnonzero(self.codes[np.frombuffer(data, np.uint8, min(self.BLOCK, len(data) - at), at)] == 0)
            if len(gaps):
                return at + int(gaps[0])
            at += self.BLOCK
        return len(data)

    def __call__(self, data: bytes) -> np.ndarray:
        """The hash of each word."""
        n = len(data)
        if min(n, self.BLOCK) > len(self.powers):
            self._grow(min(max(2 * n, 1 << 16), self.BLOCK))
        out = []
        at = 0
        while at < n:
            values = self.codes[np.frombuffer(data, np.uint8, min(self.BLOCK, n - at), at)]
            if at + len(values) < n and values[-1]:
                gaps = np.flatnonzero(values == 0)
                if not len(gaps):
                    end = self._word_end(data, at + len(values))
                    out.append(np.array([self._long_word(data[at:end])], dtype=np.uint64))
                    at = end
                    continue
                values = values[: gaps[-1] + 1]
            m = len(values)
            inside = np.zeros(m + 2, dtype=bool)
            inside[1:-1] = values != 0
            edges = np.flatnonzero(inside[1:] != inside[:-1])
            starts, ends = edges[::2], edges[1::2]
            sums = np.zeros(m + 1, dtype=np.uint64)
            np.cumsum(values * self.powers[:m], out=sums[1:])
            hashes = (sums[ends] - sums[starts]) * self.inverses[starts] if len(starts) else np.zeros(0, np.uint64)
            for k in np.flatnonzero(ends - starts >= self.LONG):
                hashes[k] = self._long_word(data[at + starts[k] : at + ends[k]])
            out.append(hashes)
            at += m
        return mix(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def is_space_free(b: int) -> bool:
    """Word bytes of the class [^\\x20\\x09-\\x0D]."""
    return not (b == 0x20 or 9 <= b <= 13)


def is_alnum_or_high(b: int) -> bool:
    """Word bytes of the class [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after lower-casing A-Z."""
    return 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80


#: bytes.translate table: lower-cases A-Z and turns every non-word byte of ``is_alnum_or_high`` into a space.
WORD_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if is_alnum_or_high(b + 32 if 65 <= b <= 90 else b) else 32 for b in range(256))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes; empty with fewer than k."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + n]
    return mix(out, k)
