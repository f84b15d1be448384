"""Inverted index over messages as a long table (term, event_id, ts_ms, service_name, positions), and its searches.

A stored index is dealt into buckets by the hash of the term and sorted by term and time, so a search opens the folders
of its terms' buckets only and skips most row groups in them. Conjunctions and phrases are aggregations by event, so
they cost one shuffle of the terms' postings however many terms there are. Batches of records are added as folders of
their own; adding one again replaces it.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import DELIMITERS, MIN_TERM, STOPWORDS, is_term, raw_tokens

TOP_POSTINGS = 10_000
BUCKETS = 64


def tokens(logs: DataFrame) -> DataFrame:
    """event_id, ts_ms, service_name, term, pos of every indexed token; dropped tokens keep their positions."""
    split = logs.select("event_id", "ts_ms", "service_name", F.posexplode(raw_tokens(F.col("message"))).alias("pos", "term"))
    return split.filter(is_term(F.col("term")))


def _repeats(terms: Column) -> Column:
    return F.size(F.array_distinct(terms)) < F.size(terms)


def postings(logs: DataFrame) -> DataFrame:
    """One row per term and event with the sorted positions; service, level and category are terms at position 0. Records that come twice count once.

    Records are brought together before they are cut into terms. Only of events with several records or repeated terms
    are positions gathered by term; of the others each place is a posting, and nothing is dealt or sorted for it.
    """
    key = ["event_id", "ts_ms", "service_name"]
    named = [c for c in ("level", "category") if c in logs.columns]
    # Split before the shuffle: what comes after it names the pieces several times, and Spark would split again for each. The
    # empty piece at an end is no term, so pieces need no trimming here (see raw_tokens).
    pieces = F.split(F.lower("message"), DELIMITERS).alias("pieces")
    events = logs.filter(F.col("message").isNotNull()).groupBy(*key).agg(F.collect_set(F.struct(pieces, *named)).alias("records"))
    records = events.select(*key, (F.size("records") > 1).alias("several"), F.explode("records").alias("r")).select(*key, "several", "r.*")
    meta = F.array_compact(F.array(*[F.concat(F.lit(f"{name}:"), F.lower(column)) for name, column in (("service", "service_name"), *((c, c) for c in named))]))
    gather = F.col("several") | (_repeats(F.col("pieces")) & _repeats(F.filter("pieces", is_term)))
    judged = records.select(*key, F.size("pieces").alias("n"), F.concat("pieces", meta).alias("terms"), gather.alias("gather"))

    def places(some: DataFrame) -> DataFrame:
        # Outer, since Spark would compute the array twice more for filters before another generator.
        rows = some.select(*key, "n", F.posexplode_outer("terms").alias("i", "term"))
        return rows.filter((F.col("i") >= F.col("n")) | is_term(F.col("term"))).select("term", *key, F.when(F.col("i") < F.col("n"), F.col("i")).otherwise(0).alias("pos"))

    gathered = places(judged.filter("gather")).groupBy("term", *key).agg(F.array_sort(F.collect_set("pos")).alias("positions"))
    return places(judged.filter("NOT gather")).select("term", *key, F.array("pos").alias("positions")).unionByName(gathered)


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(logs: DataFrame, path: str, batch: int = 0, buckets: int = BUCKETS) -> None:
    """Add the postings of a batch of records to the index at ``path``; a batch that is written again replaces itself."""
    rows = postings(logs).withColumn("bucket", bucket_of(F.col("term"), buckets))
    # Spark splits the bucket of a common term by its size.
    rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term", "ts_ms").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/buckets={buckets}/batch_id={batch}")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """All batches of a stored index."""
    return spark.read.parquet(path)


def of_terms(index: DataFrame, terms: list[str]) -> DataFrame:
    """The postings of some terms; of a stored index only their buckets are opened."""
    found = index.filter(F.col("term").isin(terms))
    if "bucket" not in index.columns or not terms:
        return found
    # Only partition columns are named, so folders are chosen before any file is read.
    return found.filter(reduce(lambda x, y: x | y, [F.col("bucket") == F.pmod(F.xxhash64(F.lit(t)), F.col("buckets")) for t in sorted(set(terms))]))


def top_postings(index: DataFrame, n: int = TOP_POSTINGS) -> DataFrame:
    """The newest ``n`` postings of each term (the rank filter lets Spark cut before the shuffle)."""
    order = Window.partitionBy("term").orderBy(F.desc("ts_ms"), "event_id")
    return index.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def term_count(index: DataFrame) -> DataFrame:
    return index.agg(F.countDistinct("term").alias("total_terms"))


def search_any(index: DataFrame, terms: list[str]) -> DataFrame:
    """Ids of events that have one of the terms."""
    return of_terms(index, terms).select("event_id").distinct()


def search_all(index: DataFrame, terms: list[str]) -> DataFrame:
    """Ids of events that have all terms."""
    wanted = sorted(set(terms))
    found = of_terms(index, wanted).groupBy("event_id").agg(F.countDistinct("term").alias("n"))
    return found.filter(F.col("n") == len(wanted)).select("event_id")


def search_phrase(index: DataFrame, terms: list[str], offsets: list[int] | None = None) -> DataFrame:
    """Ids of events in which the terms stand at consecutive positions (or at ``offsets`` from the first)."""
    offsets = offsets or list(range(len(terms)))
    if not terms:
        return index.select("event_id").limit(0)
    if len(terms) == 1:
        return search_any(index, terms)
    shifts = F.lit(None).cast("array<int>")
    for term in set(terms):
        shifts = F.when(F.col("term") == term, F.array(*[F.lit(o) for t, o in zip(terms, offsets, strict=True) if t == term])).otherwise(shifts)
    places = of_terms(index, terms).select("event_id", F.explode("positions").alias("pos"), shifts.alias("shifts")).select("event_id", "pos", F.explode("shifts").alias("shift"))
    starts = places.groupBy("event_id", (F.col("pos") - F.col("shift")).alias("start")).agg(F.countDistinct("shift").alias("n"))
    return starts.filter(F.col("n") == len(set(offsets))).select("event_id").distinct()


def phrase_terms(phrase: str) -> tuple[list[str], list[int]]:
    """Terms of a phrase and their positions in it, by the index's own token rules."""
    if not phrase.strip():
        return [], []
    pieces = re.split(DELIMITERS, phrase.lower())
    kept = [(t, i) for i, t in enumerate(pieces) if len(t) >= MIN_TERM and t not in STOPWORDS]
    return [t for t, _ in kept], [i - kept[0][1] for _, i in kept]


def search(index: DataFrame, query: str | None, stopword_gap: bool = False) -> DataFrame:
    """Ids of the events that a query asks for: a quoted phrase, terms joined by AND, terms joined by OR, or one term.

    AND is looked for first and quotes do not protect it. Terms are looked up as they are, in lower case. With
    ``stopword_gap`` a phrase leaves room for the stopwords it names, as messages do.
    """
    q = (query or "").strip()
    if not q:
        return index.select("event_id").limit(0)
    if len(q) > 1 and q[0] == q[-1] == '"':
        terms, gaps = phrase_terms(q[1:-1])
        return search_phrase(index, terms, gaps if stopword_gap else None)
    for word, find in (("AND", search_all), ("OR", search_any)):
        if f" {word} " in q.upper():
            return find(index, [t.strip().lower() for t in re.split(rf"(?i)\s{word}\s", q)])
    return search_any(index, [q.lower()])


def fetch(logs: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of the found ids."""
    return logs.join(ids, "event_id", "left_semi")


def postings_between(index: DataFrame, term: str, from_ms: int, to_ms: int) -> DataFrame:
    return of_terms(index, [term]).filter(F.col("ts_ms").between(from_ms, to_ms))
