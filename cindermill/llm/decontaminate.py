"""Operator 8: benchmark decontamination by winnowing.

Both sides keep the smallest k-gram hash of every sliding run of k-grams. With k + run - 1 words in a window, any
window that a document shares with an item has a k-gram that both sides keep, so the join of kept fingerprints finds
every shared window. A hit is extended to the windows around it: those that stand in an item too are shared, and
together they are the whole shared spans. Positions are never paired with positions, so repeated words cost no more
than others. An item shorter than the window is one window of its own length, found by the hash of all of it.

The benchmark is the small side: below ``limit_mb`` of text it goes to the workers whole (its size is measured
first); beyond that the fingerprints of both sides are joined by a shuffle. Both ways give the same rows. Words and
windows are told apart by 64 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHasher, handover, is_alnum_or_high, map_rows, rolling, small_batches, table, tidy

WINDOW = 10
GRAM = 6
LIMIT_MB = 32

_HASHER: list[WordHasher] = []


def words(text: str | None) -> np.ndarray:
    if not _HASHER:
        _HASHER.append(WordHasher(is_alnum_or_high))
    return _HASHER[0]((text or "").encode())


def winnow(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(first words, hashes) of the kept k-grams; of equal smallest hashes in a run the last one is kept."""
    grams = rolling(hashes, gram)
    run = window - gram + 1
    n = len(grams) - run + 1
    if n <= 0:
        at = np.zeros(0, dtype=np.int64)
        return at, grams[at]
    least = grams[:n].copy()
    for j in range(1, run):
        np.minimum(least, grams[j : j + n], out=least)
    kept = np.zeros(len(grams), dtype=bool)
    open_ = np.ones(n, dtype=bool)
    for j in range(run - 1, -1, -1):
        here = open_ & (grams[j : j + n] == least)
        kept[j : j + n] |= here
        open_ &= ~here
    at = np.flatnonzero(kept)
    return at, grams[at]


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of ``n`` words, told apart from runs of other lengths."""
    return rolling(hashes, n) ^ np.uint64(n)


def item_windows(hashes: np.ndarray, window: int) -> np.ndarray:
    """The windows of an item: all of its runs of ``window`` words, or the whole of a shorter one."""
    n = min(window, len(hashes))
    return np.unique(windows(hashes, n)) if n else hashes


def around(at: np.ndarray, n: int, window: int, gram: int) -> np.ndarray:
    """First words of the windows that hold one of the k-grams ``at``, in a text of ``n`` words."""
    starts = np.unique((at[:, None] - np.arange(window - gram + 1)).ravel())
    return starts[(starts >= 0) & (starts <= n - window)]


class Keys:
    """Sorted hashes behind a bitmap that turns most others away."""

    BITS = 22

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bitmap = np.zeros(1 << self.BITS, dtype=bool)
        self.bitmap[self._slot(self.values)] = True

    def _slot(self, values: np.ndarray) -> np.ndarray:
        return (values >> np.uint64(64 - self.BITS)).astype(np.int64)

    def known(self, values: np.ndarray) -> np.ndarray:
        """Places of the known ones among ``values``."""
        if not len(self.values):
            return np.zeros(0, dtype=np.int64)
        maybe = np.flatnonzero(self.bitmap[self._slot(values)])
        at = np.searchsorted(self.values, values[maybe])
        return maybe[self.values[np.minimum(at, len(self.values) - 1)] == values[maybe]]


def covered(spans: np.ndarray, lengths: np.ndarray, n: int) -> int:
    """How many of ``n`` words lie in spans that start at ``spans``."""
    turns = np.bincount(spans, minlength=n + 1).astype(np.int64) - np.bincount(spans + lengths, minlength=n + 1)
    return int((np.cumsum(turns) > 0).sum())


class Benchmark:
    """The benchmark in a worker: its fingerprints, and its windows with their items."""

    def __init__(self, items: list[tuple[object, str | None]], window: int, gram: int):
        self.window, self.gram = window, gram
        self.ids = [None if i is None else str(i) for i, _ in items]
        hashed = [words(t) for _, t in items]
        self.lengths = sorted({len(h) for h in hashed if 0 < len(h) < window})
        none = np.zeros(0, np.uint64)
        self.prints = Keys(np.concatenate([none, *(winnow(h, window, gram)[1] for h in hashed)]))
        own = [item_windows(h, window) for h in hashed]
        keys = np.concatenate([none, *own])
        order = np.argsort(keys, kind="stable")
        self.window_keys, self.owner = keys[order], np.repeat(np.arange(len(own)), [len(w) for w in own])[order]
        self.windows = Keys(keys)

    def hits(self, text: str | None) -> tuple[int, int, int, str, bool]:
        doc = words(text)
        n = len(doc)
        at, prints = winnow(doc, self.window, self.gram)
        starts = around(at[self.prints.known(prints)], n, self.window, self.gram)
        found = [(starts, windows(doc, self.window)[starts], self.window)] if len(starts) else []
        for length in self.lengths:
            keys = windows(doc, length)
            found.append((np.arange(len(keys)), keys, length))
        spans, lengths, hit_keys = [], [], []
        for starts, keys, length in found:
            known = self.windows.known(keys)
            spans.append(starts[known])
            lengths.append(np.full(len(known), length))
            hit_keys.append(keys[known])
        if not sum(map(len, spans)):
            return report(n, 0, ())
        hit = np.unique(np.concatenate(hit_keys))
        low, high = np.searchsorted(self.window_keys, hit, "left"), np.searchsorted(self.window_keys, hit, "right")
        owners = {int(o) for a, b in zip(low, high, strict=True) for o in self.owner[a:b]}
        return report(n, covered(np.concatenate(spans), np.concatenate(lengths), n), {self.ids[o] for o in owners})


def report(n_words: int, n_hit: int, items) -> tuple[int, int, int, str, bool]:
    names = sorted(i for i in items if i is not None)
    return n_words, n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
]


class _Whole:
    factory = True

    def __init__(self, items, window, gram):
        self.items, self.window, self.gram = items, window, gram

    def __call__(self):
        return Benchmark(self.items, self.window, self.gram).hits


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, limit_mb: float = LIMIT_MB, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_words, n_hit, n_items, items_sha256, contaminated of every document.

    Null and empty texts have no words and are clean; items without words never occur; an item whose id is null marks
    words but is not listed; repeated items with one id count once; repeated documents give a row each; columns
    besides the ids and texts are ignored, and a kept column that has the name of a result gives way to it.
    """
    items = benchmark.select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if size <= limit_mb * (1 << 20):
        rows = [(r[0], r[1]) for r in items.collect()]
        return map_rows(docs, _Whole(rows, window, gram), FIELDS, list(keep), ["text"])
    return _by_shuffle(docs, items, window, gram, list(keep))


def _arrow_rows(per_text, names: list[str]):
    """Map (key, text) to rows of int64 columns: ``per_text`` gives the columns besides the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch):
                found = [per_text(*values) for values in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True)]
                keys = np.repeat(part.column(0).to_numpy(), [len(columns[0]) for columns in found])
                columns = [np.concatenate(c).astype(c[0].dtype).view(np.int64) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, columns)], names=names)

    return tidy(run)


def _doc_prints(window: int, gram: int, lengths: list[int]):
    """Fingerprints of a text (length 0), and its runs of each length of the short items."""

    def run(text: str) -> tuple[np.ndarray, ...]:
        doc = words(text)
        parts = [(0, *winnow(doc, window, gram))]
        for n in lengths:
            keys = windows(doc, n)
            parts.append((n, np.arange(len(keys)), keys))
        return np.concatenate([p[2] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([np.full(len(p[1]), p[0]) for p in parts])

    return run


def _doc_windows(window: int, gram: int):
    """The windows around fingerprints."""

    def run(text: str, at: list[int]) -> tuple[np.ndarray, ...]:
        doc = words(text)
        starts = around(np.array(at, dtype=np.int64), len(doc), window, gram)
        return windows(doc, window)[starts], starts, np.full(len(starts), window)

    return run


def _totals(n_words: int, spans: list | None, names: list | None) -> tuple:
    at = np.array([s["start"] for s in spans or []], dtype=np.int64)
    return report(n_words, covered(at, np.array([s["length"] for s in spans or []], dtype=np.int64), n_words) if len(at) else 0, set(names or []))


def _by_shuffle(docs: DataFrame, items: DataFrame, window: int, gram: int, keep: list[str]) -> DataFrame:
    """Equal texts (128 bits of hash) are one row with a number from here on, so a hot copy is compared once.

    The joins are semi-joins with distinct keys that come from a written table: a document row passes once at most,
    and Spark can split a hot key. Only (text, item) pairs that share a window are listed.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    identity = [F.xxhash64(F.lit(1), text).alias("__h1"), F.xxhash64(F.lit(2), text).alias("__h2")]
    names = [k for k in keep if k.lower() not in {f.name for f in FIELDS}]
    plain = [f"__k{i}" for i in range(len(names))]
    keyed = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(names, plain, strict=True)], *identity, F.col("text").alias("__text"))
    counted = map_rows(keyed, lambda t: (len(words(t)),), [T.StructField("__n", T.LongType())], [*plain, "__h1", "__h2"], ["__text"])
    once = docs.select(*identity, text.alias("doc_text")).groupBy("__h1", "__h2").agg(F.first("doc_text").alias("doc_text"))
    texts = handover(once.withColumn("doc_key", F.monotonically_increasing_id()), "decontam-texts")
    numbered = handover(items.select(F.col("item_id").cast("string").alias("item_name"), text.alias("item_text")).distinct().withColumn("item_key", F.monotonically_increasing_id()), "decontam-items")
    lengths = [r[0] for r in map_rows(numbered, lambda t: (len(words(t)),), [T.StructField("n", T.IntegerType())], [], ["item_text"]).filter(F.col("n").between(1, window - 1)).distinct().collect()]
    whole = numbered.select("item_key", "item_text")
    item_prints = whole.mapInArrow(_arrow_rows(lambda t: (winnow(words(t), window, gram)[1],), ["item_key", "print"]), "item_key long, print long")
    item_keys = handover(whole.mapInArrow(_arrow_rows(lambda t: (item_windows(words(t), window),), ["item_key", "key"]), "item_key long, key long"), "decontam-windows")
    wanted = handover(item_prints.select("print").unionByName(item_keys.select(F.col("key").alias("print"))).distinct(), "decontam-prints")

    doc_prints = texts.select("doc_key", "doc_text").mapInArrow(_arrow_rows(_doc_prints(window, gram, sorted(lengths)), ["doc_key", "print", "at", "length"]), "doc_key long, print long, at long, length long")
    matched = handover(doc_prints.join(wanted, "print", "left_semi"), "decontam-matches")
    places = matched.filter("length = 0").groupBy("doc_key").agg(F.collect_set("at").alias("at"))
    near = texts.join(places, "doc_key").select("doc_key", "doc_text", "at").mapInArrow(_arrow_rows(_doc_windows(window, gram), ["doc_key", "key", "start", "length"]), "doc_key long, key long, start long, length long")
    runs = near.unionByName(matched.filter("length > 0").select("doc_key", F.col("print").alias("key"), F.col("at").alias("start"), "length"))
    hits = handover(runs.join(item_keys.select("key").distinct(), "key", "left_semi"), "decontam-hits")
    spans = hits.groupBy("doc_key").agg(F.collect_list(F.struct("start", "length")).alias("__spans"))
    pairs = hits.select("doc_key", "key").distinct().join(item_keys, "key").select("doc_key", "item_key").distinct()
    listed = pairs.join(numbered.select("item_key", "item_name"), "item_key").groupBy("doc_key").agg(F.collect_set("item_name").alias("__names"))
    found = texts.select("__h1", "__h2", "doc_key").join(spans, "doc_key").join(listed, "doc_key", "left").drop("doc_key")
    out = map_rows(counted.join(found, ["__h1", "__h2"], "left"), _totals, FIELDS, plain, ["__n", "__spans", "__names"])
    return out.toDF(*names, *(f.name for f in FIELDS))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, limit_mb: float = LIMIT_MB) -> DataFrame:
    """The rows of ``docs``, all columns, that share no window with the benchmark. Null and empty texts stay; repeated rows and null ids are judged each by its own text; an empty table stays empty."""
    columns = [f"c{i}" for i in range(len(docs.columns))]
    numbered = docs.toDF(*columns).withColumn("text", F.col(columns[[c.lower() for c in docs.columns].index("text")]))
    return contamination(numbered, benchmark, window, gram, limit_mb, tuple(columns)).filter(~F.col("contaminated")).select(*columns).toDF(*docs.columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
             FROM (SELECT item_id, w, least({WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0))),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, dw.n AS n FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
