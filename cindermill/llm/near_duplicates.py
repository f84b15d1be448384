"""Operator 5: exact Jaccard join on word shingles by PartEnum signatures.

Sizes fall into bands so that similar sets are in the same or in adjacent bands. For each pair of adjacent bands the
feature domain is dealt at random into ``n1`` partitions of ``n2`` cells. Sets that are similar enough differ in k
features at most, so in some partition they differ in ``k2`` cells at most, and they agree on one of its subsets of
``n2 - k2`` cells; the contents of every such subset are a set's signatures. A few partitions more than needed let most
sets leave out signatures of empty subsets. Frequent shingles (of passages that many documents share) stay out of the
signatures, so that a common passage alone ties nothing.

1. Equal sets are one class (its smallest document stands for it).
2. Holders of a signature are tied in a chain, first within each chunk of a task, then over all by one shuffle.
   Components of these ties are families: no link leaves a family. Families larger than a block are tied anew, each by
   itself, by other cells and without the shingles that are frequent among their members, while that takes them apart:
   a passage that is rare among all documents ties ever more unlike ones as these grow in number.
3. Families are cut into small blocks, and sets are compared exactly inside blocks; tasks return spanning links only.
   Then one set of each component so far stands for it, and these are compared in blocks, as long as that merges many:
   copies, however many, are one component by now. At last, sets of a family that are still in different components
   are compared in pairs of blocks; blocks of one component are not compared with each other. They are dealt into rounds
   that copy about as much text as there is in all sets, so their number costs time but no disk.
4. Components of all links, joined back to the classes, are the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, WordHasher, free_shuffles, handover, is_space_free, mix, rolling, small_batches, split_join, table, tidy
from .components import components

#: Documents of a block of the first round, of a later block, and shingles of a block, roughly (a larger set is a block of its own).
FIRST_DOCS = 100
BLOCK_DOCS = 500
BLOCK_ITEMS = 1_200_000
#: Features whose values are summed at a time.
CHUNK = 1 << 20
#: Spare partitions, as a share of those needed: at first, and where families are tied anew (few sets are poor then).
SPARE = 0.15
SPARE_ANEW = 0.5

#: Documents sampled to find frequent shingles, the length of a text from which it is not, and the documents of the sample that share a frequent one.
SAMPLE_DOCS = 20_000
SAMPLE_CHARS = 20_000
FREQUENT = 5
#: The most frequent of them that go to the tasks: 8 MB.
FREQUENT_MOST = 1_000_000

_HASHER: list[WordHasher] = []


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text of fewer words is one shingle, one without words has none."""
    if not _HASHER:
        _HASHER.append(WordHasher(is_space_free))
    hashes = _HASHER[0]((text or "").encode())
    if len(hashes) < words:
        return mix(rolling(hashes, len(hashes)), 97) if len(hashes) else hashes
    return np.unique(rolling(hashes, words))


class Scheme:
    """Bands and signatures for Jaccard >= num/den; each ``salt`` deals the features anew."""

    def __init__(self, num: int, den: int, n2: int, k2: int, salt: int = 0):
        self.num, self.den, self.n2, self.k2, self.salt = num, den, n2, k2, salt
        self.lows, self.highs = [1], [den // num]
        self.subsets = [list(c) for c in combinations(range(n2), n2 - k2)]

    def band(self, size: int) -> int:
        """The band of a set size (1 or more): band i holds lows[i]..highs[i], and highs[i] <= lows[i] * den / num."""
        while self.highs[-1] < size:
            self.lows.append(self.highs[-1] + 1)
            self.highs.append(self.lows[-1] * self.den // self.num)
        return int(np.searchsorted(self.highs, size))

    def distance(self, band: int) -> int:
        """Features in which similar sets of ``band`` and ``band + 1`` (or of ``band``) can differ at most."""
        self.band(self.highs[min(band, len(self.highs) - 1)] + 1)
        while len(self.highs) <= band + 1:
            self.band(self.highs[-1] + 1)
        return (self.den - self.num) * (self.highs[band] + self.highs[band + 1]) // (self.den + self.num)

    def _cells(self, items: np.ndarray, group: int, n1: int, domain: int) -> tuple[np.ndarray, np.ndarray]:
        """(marks, filled) of every subset of cells in every partition, by subset and partition."""
        cells = n1 * self.n2
        cell = (mix(items, 1000 + 2 * group + domain + (self.salt << 32)) % np.uint64(cells)).astype(np.int64)
        value = mix(items, 7)
        low, high = np.zeros(cells, np.uint64), np.zeros(cells, np.uint64)
        for at in range(0, len(items), CHUNK):  # so few halves of 32 bits have an exact sum in a double
            part = slice(at, at + CHUNK)
            low += np.bincount(cell[part], (value[part] & np.uint64(0xFFFFFFFF)).astype(np.float64), cells).astype(np.uint64)
            high += np.bincount(cell[part], (value[part] >> np.uint64(32)).astype(np.float64), cells).astype(np.uint64)
        total = low + high * np.uint64(0xC2B2AE3D27D4EB4F)
        content = mix(total + mix(np.arange(cells, dtype=np.uint64), 5)).reshape(n1, self.n2)
        filled = (np.bincount(cell, minlength=cells) > 0).reshape(n1, self.n2)
        sums = np.stack([content[:, s].sum(axis=1, dtype=np.uint64) for s in self.subsets])
        salt = np.arange(len(self.subsets), dtype=np.uint64) + np.uint64(100 * (2 * group + domain))
        return mix(sums + mix(salt, 3)[:, None]), np.stack([filled[:, s].any(axis=1) for s in self.subsets])

    def signatures(self, items: np.ndarray, frequent: np.ndarray | None = None) -> np.ndarray:
        """The distinct signatures of a set.

        ``frequent`` (sorted) features are left out first: that takes nothing from the guarantee, since sets differ in
        no more features then. A set that is poor without them (more partitions with an empty subset than there are
        spare ones) also gives the signatures of all its features. Of two similar sets, either one is rich, and they
        share a filled subset of the rare features, or both are poor, and they share one of all features.
        """
        rare = items
        if frequent is not None and len(frequent):
            at = np.searchsorted(frequent, items)
            rare = items[frequent[np.minimum(at, len(frequent) - 1)] != items]
        out = []
        band = self.band(len(items))
        for group in (band - 1, band):
            k = self.distance(group) if group >= 0 else 0
            if not k:
                continue  # similar sets of these bands are equal
            need = k // (self.k2 + 1) + 1
            n1 = need + int(need * (SPARE_ANEW if self.salt else SPARE))
            # At least n1 - need + 1 partitions agree: a set with fewer poor partitions shares a rich one.
            poor = True
            if rare is not items:
                marks, some = self._cells(rare, group, n1, 0)
                out.append(marks[some])
                poor = int((~some.all(axis=0)).sum()) > n1 - need
            if poor:
                marks, some = self._cells(items, group, n1, 1)
                out.append(marks[some] if int((~some.all(axis=0)).sum()) <= n1 - need else marks.ravel())
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _longs(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.uint64).view(np.int64))


def set_key(items: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    return int(mix(items, 21).sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix(items, 22))) if len(items) else 0


def _key_task(words: int, scheme_args: tuple, names: list[str]):
    """(id, text) to (id, size, two keys and band of the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = Scheme(*scheme_args)
        for batch in batches:
            for part in small_batches(batch):
                sets = [shingles(t, words) for t in part.column(1).to_pylist()]
                k1, k2 = zip(*map(set_key, sets), strict=True)
                bands = pa.array([scheme.band(len(s)) if len(s) else -1 for s in sets], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), _longs(k1), _longs(k2), bands], names=names)

    return run


def _shingle_task(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch):
                yield pa.RecordBatch.from_arrays([_longs(np.concatenate([shingles(t, words) for t in part.column(0).to_pylist()]))], names=["item"])

    return run


def frequent_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Sorted hashes of the shingles that ``FREQUENT`` documents or more of a sample of about ``SAMPLE_DOCS`` share.

    They only decide which features the signatures are made of, never the result, so at most the ``FREQUENT_MOST``
    most frequent are taken; texts over ``SAMPLE_CHARS`` characters are not sampled.
    """
    short = docs.select("text").filter(F.length("text") <= SAMPLE_CHARS)
    share = min(1.0, SAMPLE_DOCS / max(short.count(), 1))
    items = short.sample(share, seed=1).mapInArrow(tidy(_shingle_task(words)), "item long")
    found = items.groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "item").limit(FREQUENT_MOST).select("item").toArrow()
    return np.sort(found.column(0).to_numpy().view(np.uint64))


def _holder_task(words: int, scheme_args: tuple, frequent: np.ndarray):
    """(text, family) to (sign, holder): who holds a signature of a family, combined within a chunk.

    Of a signature that several sets of a chunk hold, one row with its first holder goes on; the others are tied to
    that holder by a sign of its own. So a signature that a large family shares has a row per chunk, not per document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = Scheme(*scheme_args)
        for batch in batches:
            for part in small_batches(batch):
                keys, signs = [], []
                for text, own in zip(part.column(0).to_pylist(), mix(part.column(1).to_numpy().view(np.uint64), 4), strict=True):
                    items = shingles(text, words)
                    if len(items):
                        keys.append(set_key(items)[0])
                        signs.append(scheme.signatures(items, frequent) ^ own)
                if not keys:
                    continue
                holder = np.repeat(np.array(keys, dtype=np.uint64), [len(s) for s in signs])
                sign, first, place = np.unique(np.concatenate(signs), return_index=True, return_inverse=True)
                lead = holder[first]
                led = lead[place]
                late = np.flatnonzero(led != holder)
                _, one = np.unique(mix(led[late], 1) ^ mix(holder[late], 2), return_index=True)
                tied = late[one]
                leads = np.unique(led[tied])
                out_sign = np.concatenate([sign, mix(led[tied], 77), mix(leads, 77)])
                out_holder = np.concatenate([lead, holder[tied], leads])
                for at in range(0, len(out_sign), 1 << 18):
                    yield pa.RecordBatch.from_arrays([_longs(out_sign[at : at + (1 << 18)]), _longs(out_holder[at : at + (1 << 18)])], names=["sign", "holder"])

    return run


def spanning_links(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links that span the components of the similarity graph of ``left`` and ``right`` sets (all pairs of ``left`` if ``right`` is None).

    Numbers of ``right`` sets follow those of ``left``. Intersections come from dense products for common features and
    from counted pairs for rare ones.
    """
    sets = left + (right or [])
    n, nl = len(sets), len(left)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, feature, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(feature, kind="stable")
    starts = np.concatenate([[0], np.cumsum(seen)[:-1]])
    common = np.zeros((n, n), dtype=np.float32)
    rare_most = 8
    for d in range(2, rare_most + 1):
        at = starts[seen == d]
        if len(at):
            who = owner[order[at[:, None] + np.arange(d)]]
            for a, b in combinations(range(d), 2):
                common += np.bincount(who[:, a] * n + who[:, b], minlength=n * n).reshape(n, n)
    often = np.flatnonzero(seen > rare_most)
    for at in range(0, len(often), 4096):
        some = often[at : at + 4096]
        column = np.full(len(seen), -1)
        column[some] = np.arange(len(some))
        used = column[feature] >= 0
        m = np.zeros((n, len(some)), dtype=np.float32)
        m[owner[used], column[feature[used]]] = 1.0
        if right is None:
            common += np.triu(m @ m.T, 1)
        else:
            common[:nl, nl:] += m[:nl] @ m[nl:].T
    common = np.rint(common).astype(np.int64)
    linked = (den * common >= num * (sizes[:, None] + sizes[None, :] - common)) & (common > 0)
    linked = np.triu(linked, 1)
    if right is not None:
        linked[:nl, :nl] = False
        linked[nl:, nl:] = False
    linked |= linked.T
    free = np.ones(n, dtype=bool)
    out = []
    for root in range(n):
        if not free[root]:
            continue
        free[root] = False
        todo = [root]
        while todo:
            u = todo.pop()
            new = np.flatnonzero(linked[u] & free)
            free[new] = False
            out += [(u, int(v)) for v in new]
            todo += new.tolist()
    return out


def _compare_task(words: int, num: int, den: int, kind: pa.DataType):
    """Rows (g, side, node, text) sorted by g to links (node, smallest node of its component in the group); side 0 compares with all of its group, 1 with side 2 only."""

    def links(rows: list[tuple]) -> pa.RecordBatch | None:
        whole = all(r[0] == 0 for r in rows)
        left = [r for r in rows if r[0] < 2]
        right = None if whole else [r for r in rows if r[0] == 2]
        nodes = [r[1] for r in left + (right or [])]
        found = spanning_links([shingles(r[2], words) for r in left], None if right is None else [shingles(r[2], words) for r in right], num, den)
        # Each set is linked with the smallest node of its component here.
        least = list(range(len(nodes)))
        for i, j in found:
            least[j] = least[i]
        roots: dict = {}
        for i, k in enumerate(least):
            roots[k] = min(roots.get(k, nodes[i]), nodes[i])
        pairs = sorted({(n, roots[k]) for n, k in zip(nodes, least, strict=True) if n != roots[k]})
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], kind), pa.array([b for _, b in pairs], kind)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            for part in small_batches(batch):
                for g, side, node, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if g != group:
                        if len(rows) > 1:
                            yield links(rows)
                        group, rows = g, []
                    rows.append((side, node, text))
        if len(rows) > 1:
            yield links(rows)

    return run


def _count(docs: int) -> Column:
    """Blocks of about ``docs`` sets that a group needs."""
    return F.greatest(F.ceil(F.count("*") / docs), F.ceil(F.sum("n") / BLOCK_ITEMS)).cast("int").alias("own")


def _block(salt: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "node"), F.col("own")).cast("int")


def _first_blocks(nodes: DataFrame) -> DataFrame:
    """node, family, band, n, g, large: the block g of the first round. A family within one block's limits is a block; larger ones are cut by band and hash."""
    whole = nodes.groupBy("family").agg((_count(FIRST_DOCS) > 1).alias("large"))
    bands = nodes.groupBy("family", "band").agg(_count(FIRST_DOCS))
    sized = split_join(split_join(nodes, whole, ["family"]), bands, ["family", "band"])
    block = F.when(F.col("large"), F.xxhash64(F.lit(1), "family", "band", _block(2))).otherwise(F.xxhash64(F.lit(0), "family"))
    return sized.select("node", "family", "band", "n", "large", block.alias("g"))


def _representative_blocks(members: DataFrame) -> DataFrame:
    """family, own: how many blocks the components of a family need, one set each."""
    return members.filter("node = component").groupBy("family").agg(_count(BLOCK_DOCS))


def _representatives(members: DataFrame, blocks: DataFrame, salt: int) -> DataFrame:
    """node, g, side: one set of each component of a family, in blocks."""
    return split_join(members.filter("node = component"), blocks, ["family"]).select("node", F.xxhash64(F.lit(salt), "family", _block(salt)).alias("g"), F.lit(0).alias("side"))


def _open_members(members: DataFrame) -> DataFrame:
    """The members of families that have several components."""
    several = members.groupBy("family").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most").select("family")
    return split_join(members, several, ["family"])


def _pairs_of_blocks(members: DataFrame, scratch: Scratch) -> DataFrame:
    """node, n, g, side of every comparison that is left: sets of like size in different components of one family.

    A component of half a block or more has blocks of its own, the others share blocks. Pairs of blocks of one
    component are left out; a shared block is compared with itself, too.
    """
    sizes = members.groupBy("family", "band", "component").agg(_count(BLOCK_DOCS), F.count("*").alias("size"))
    none = F.lit(None).cast(members.schema["component"].dataType)
    named = split_join(members, sizes, ["family", "band", "component"]).withColumn("part", F.when(F.col("size") >= BLOCK_DOCS // 2, F.col("component")).otherwise(none))
    shared = named.filter("part IS NULL").groupBy("family", "band").agg(_count(BLOCK_DOCS).alias("shared"))
    named = split_join(named, shared, ["family", "band"], "left").withColumn("own", F.when(F.col("part").isNull(), F.col("shared")).otherwise(F.col("own")))
    # A block's number tells all of it.
    block = F.xxhash64("family", "band", F.col("part").isNull(), F.coalesce("part", "family"), _block(3))
    placed = scratch(named.select("node", "n", "family", "band", "part", block.alias("block")), "placed-members")
    blocks = placed.select("family", "band", "part", "block").distinct()
    x, y = (blocks.select("family", *[F.col(c).alias(f"{s}_{c}") for c in ("band", "part", "block")]) for s in "xy")
    order = F.struct("x_band", "x_block") <= F.struct("y_band", "y_block")
    apart = F.col("x_part").isNull() | F.col("y_part").isNull() | (F.col("x_part") != F.col("y_part"))
    pairs = x.join(y, "family").filter(order & (F.abs(F.col("x_band") - F.col("y_band")) <= 1) & apart)
    pairs = pairs.select("x_block", "y_block", F.xxhash64("x_block", "y_block").alias("g"), (F.col("x_block") == F.col("y_block")).alias("self"))
    sides = F.when(F.col("self"), F.array(F.struct(F.col("x_block").alias("block"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("x_block").alias("block"), F.lit(1).alias("side")), F.struct(F.col("y_block").alias("block"), F.lit(2).alias("side"))))
    work = pairs.select("g", F.inline(sides))
    return placed.select("node", "n", "block").join(work, "block").select("node", "n", "g", "side")


def _wide(nodes: DataFrame) -> DataFrame:
    """The rows of families that do not fit into a block."""
    return split_join(nodes, nodes.groupBy("family").agg(_count(FIRST_DOCS)).filter("own > 1").select("family"), ["family"])


def similar_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, n2: int = 2, k2: int = 1, skip_frequent: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    Documents link when den * intersection >= num * union of their shingle sets. Null texts and texts without words
    have no shingles and form components of their own. Every row gets the component of its own text; a doc_id that stands
    first in several texts joins their components. Rows with a null doc_id take part in no link but that to equal sets.
    Other columns are ignored; an empty table gives an empty table. ``skip_frequent`` keeps frequent shingles out of the
    signatures (same result): worth its pass over a sample at similarities where a cell holds few shingles, so that a
    common passage alone may fill one.
    """
    spark = docs.sparkSession
    slim = docs.select("doc_id", "text")
    id_field = slim.schema["doc_id"]
    scheme = (num, den, n2, k2)
    scratch = Scratch(spark)
    schema = T.StructType([id_field, T.StructField("n", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("band", T.IntegerType())])
    keyed = handover(slim.mapInArrow(tidy(_key_task(words, scheme, schema.names)), schema), "sets", narrow=True)
    classes = scratch(keyed.filter("n > 0").groupBy("k1", "k2", "band", "n").agg(F.min("doc_id").alias("node")).filter("node IS NOT NULL"), "classes")

    def tied(texts: DataFrame, salt: int, frequent: np.ndarray) -> DataFrame:
        """k1, family of the sets that are tied with others of the same ``family`` of ``texts`` (text, family)."""
        # One shuffle of the signatures: holders of one, in order, are tied each to the one before.
        holders = texts.select("text", "family").mapInArrow(tidy(_holder_task(words, (*scheme, salt), frequent)), "sign long, holder long")
        before = F.lag("holder").over(Window.partitionBy("sign").orderBy("holder"))
        ties = scratch(holders.select(F.col("holder").alias("a"), before.alias("b")).filter("a <> b").distinct(), "ties")
        free_shuffles(spark)
        families = components(ties, "families", scratch)
        return families.select(F.col("node").alias("k1"), F.col("component").alias("family")).unionByName(families.select(F.col("component").alias("k1"), F.col("component").alias("family")).distinct())

    members = tied(slim.withColumn("family", F.lit(0).cast("long")), 0, frequent_shingles(slim, words) if skip_frequent else np.zeros(0, np.uint64))
    # A node in several families or sets (an id that repeats) has a row for each.
    nodes = scratch(members.join(classes, "k1").select("k1", "node", "family", "band", "n").distinct(), "family-nodes")

    source, sources, wide = slim, Scratch(spark), scratch(_wide(nodes), "wide-nodes")
    size = wide.count()
    for salt in count(1):
        if not size:
            break
        own = wide.select(F.col("node").alias("doc_id"), "family").distinct()
        source = sources(source.select("doc_id", "text").join(own.hint("merge"), "doc_id"), "wide-texts")
        sources.clear(leave=1)
        free_shuffles(spark)
        again = scratch(wide.drop("family").join(tied(source, salt, frequent_shingles(source, words)), "k1").select(*nodes.columns).distinct(), "wide-nodes")
        nodes = scratch(nodes.join(wide.select("family").distinct(), "family", "left_anti").select(*nodes.columns).unionByName(again), "family-nodes")
        wide = scratch(_wide(again), "wide-nodes")
        before, size = size, wide.count()
        # Another round pays only while families come apart.
        if 2 * size > before:
            break
    sources.clear()

    # The number of family members grows with the input, so they are never broadcast.
    placed = _first_blocks(nodes.select("node", "family", "band", "n").distinct()).withColumnRenamed("node", "doc_id")
    texts = scratch(slim.join(placed.hint("merge"), "doc_id").withColumnRenamed("doc_id", "node"), "family-texts")
    free_shuffles(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = to_arrow_type(id_field.dataType)
    pair = T.StructType([T.StructField("a", id_field.dataType), T.StructField("b", id_field.dataType)])

    def compare(work: DataFrame, label: str) -> DataFrame:
        """Links (a, b) between the sets of rows (g, side, node, text): of each set and the smallest node of its component in the group."""
        dealt = work.select("g", "side", "node", "text").repartition(parts, "g").sortWithinPartitions("g")
        return scratch(dealt.mapInArrow(tidy(_compare_task(words, num, den, kind)), pair), label, narrow=True)

    links = compare(texts.withColumn("side", F.lit(0)), "links-blocks")
    large = texts.filter("large").select("node", "family", "band", "n")
    if not large.isEmpty():
        own_text = texts.filter("large").select("node", "text")

        def after(members: DataFrame, moved: DataFrame) -> DataFrame:
            """Members of families that have several components still. A round has each set in one block only, so its links say at once which component it is in."""
            onto = moved.select(F.col("a").alias("component"), F.col("b").alias("root"))
            named = members.join(onto, "component", "left").select("node", "family", "band", "n", F.coalesce("root", "component").alias("component"))
            return scratch(_open_members(named), "open-members")

        current = after(large.withColumn("component", F.col("node")), links)
        for round_ in count(4):
            several = _representative_blocks(current)
            moved = compare(_representatives(current, several, round_).join(own_text, "node"), "links-round")
            merged, stood = moved.count(), current.filter("node = component").count()
            if not merged:
                break
            wide = not several.filter("own > 1").isEmpty()
            links, current = links.unionByName(moved), after(current, moved)
            # Another round finds something only where the sets lay in several blocks, and pays only while it merges many.
            if not wide or 2 * merged < stood:
                break
        if not current.isEmpty():
            work = _pairs_of_blocks(current, scratch)
            all_sets, copied = (df.agg(F.sum("n")).first()[0] for df in (classes, work))
            rounds = -(-(copied or 0) // all_sets)
            for i in range(rounds):
                links = links.unionByName(compare(work.filter(F.pmod(F.xxhash64(F.lit(5), "g"), F.lit(rounds)) == i).drop("n").join(own_text, "node"), "links-pairs"))
                if rounds > 1:
                    free_shuffles(spark)
    linked = components(links, "links", scratch)

    roots = handover(classes.join(linked, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("root")), "roots")
    scratch.clear()
    columns = ["doc_id", F.col("n").alias("n_shingles")]
    # Sets without shingles would share one key.
    some = keyed.filter("n > 0").join(roots, ["k1", "k2"], "left").select(*columns, F.coalesce("root", "doc_id").alias("component_id"))
    return some.unionByName(keyed.filter("n = 0").select(*columns, F.col("doc_id").alias("component_id")))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100, n2=2, k2=1, skip_frequent=False)


_JACCARD_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
OP5_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_JACCARD_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, min(seen) AS component_id FROM s JOIN r ON r.node = s.doc_id GROUP BY doc_id, g
"""
