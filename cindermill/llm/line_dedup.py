"""Operator 7 [native]: cross-site line dedup by distinct-site spread, with DataFrame functions only.

1. Places of each line hash are counted (a combined hash aggregate of fixed-width rows). A line on ``min_sites`` sites
   stands in as many places at least, so only lines with that many go on: an exact filter that leaves few.
2. Their places are written once. Each line hash gets a HyperLogLog sketch of the sites it stands on (sketches of tasks
   merge in the aggregation); lines whose estimate is within a margin of the threshold get an exact distinct count.
3. A line on ``min_sites`` sites or more is boilerplate: it stays at its first place in the corpus (smallest document
   id, then line number) and goes elsewhere.

Lines are told apart by 128 bits of hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import handover, table

MIN_SITES = 10
LG_K = 12
#: A line of more words than this is a passage: it does not recur by chance.
PASSAGE_WORDS = 50
KEY = ["h", "h2"]


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _exploded(docs: DataFrame, site: str | None = None) -> DataFrame:
    """doc, version (hash of the row's text), site, pos and __line of every line."""
    named = F.col(f"`{site}`").cast("string") if site else F.lit(None).cast("string")
    # The text is hashed before its lines are dealt out, not once for each of them.
    whole = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("version"), named.alias("site"), F.col("text").alias("__text"))
    return whole.select("doc", "version", "site", F.posexplode(_split(F.col("__text"))).alias("pos", "__line"))


def _keyed(lines: DataFrame) -> DataFrame:
    """The lines that are not blank, with the hashes of the line without blanks, tabs and carriage returns at its ends."""
    trimmed = lines.withColumn("__line", F.trim(F.col("__line"), F.lit(" \t\r"))).filter(F.col("__line") != "")
    return trimmed.select("doc", "version", "site", "pos", F.xxhash64("__line").alias("h"), F.xxhash64(F.lit(1), "__line").alias("h2"))


def _places(lines: DataFrame, wanted: DataFrame, label: str) -> DataFrame:
    """The places of the wanted lines, written once. Both sides of the join come straight from a shuffle, so a line that stands in very many places is split."""
    return handover(lines.join(handover(wanted.select(*KEY), f"{label}-lines"), KEY), f"{label}-places", narrow=True)


def _first() -> Column:
    return F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "pos"))).alias("first")


def site_spread(places: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """h, h2, first (document and line number) of the lines on ``min_sites`` sites or more; a null site is none."""
    margin = max(1, math.ceil(4 * 1.04 / math.sqrt(1 << lg_k) * min_sites))
    sketched = places.groupBy(*KEY).agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), _first())
    spread = handover(sketched.select(*KEY, "first", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= min_sites - margin), "line-spread")
    near = spread.filter(F.col("sites") <= min_sites + margin)
    exact = places.join(near.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.countDistinct("site").alias("exact")).filter(F.col("exact") >= min_sites)
    sure = spread.filter(F.col("sites") > min_sites + margin)
    return handover(sure.select(*KEY, "first").unionByName(near.join(exact, KEY).select(*KEY, "first")), "line-boilerplate")


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """All columns of ``docs`` with ``text`` cut, and n_lines, n_removed (columns of these names are replaced).

    Lines are split at line feeds and compared without blanks, tabs and carriage returns at their ends; blank lines
    stay. Null texts stay null with 0 lines; an empty text is one blank line. Rows with a null doc_id count towards
    the spread but lose nothing. Repeated rows with one doc_id and text are treated alike; rows that share the id only
    are not. An empty table gives an empty table.
    """
    lines = _keyed(_exploded(docs, site))
    often = lines.groupBy(*KEY).agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites)
    places = _places(lines, often, "line")
    found = places.join(site_spread(places, min_sites, lg_k), KEY).filter(F.col("first").isNull() | (F.struct("doc", "pos") != F.col("first")))
    return _cut(docs, found)


def dedup_passages(docs: DataFrame) -> DataFrame:
    """Like ``dedup_lines`` for lines of more than ``PASSAGE_WORDS`` words only, which go wherever two documents or more have them, on whatever sites.

    Meant for documents among which whole copies are gone: cut before, copies would be left as fragments that no longer match.
    """
    long = _exploded(docs).filter(F.length("__line") > 2 * PASSAGE_WORDS).filter(F.regexp_count("__line", F.lit(r"[^\x20\x09-\x0D]+")) > PASSAGE_WORDS)
    passages = _keyed(long.filter(F.col("doc").isNotNull()))
    spread = passages.groupBy(*KEY).agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    places = _places(passages, spread.filter(F.col("least") != F.col("most")), "passage")
    firsts = handover(places.groupBy(*KEY).agg(_first()), "passage-firsts")
    return _cut(docs, places.join(firsts, KEY).filter(F.struct("doc", "pos") != F.col("first")))


def _without(lines: Column, cut: Column) -> Column:
    """``lines`` without the positions in ``cut`` (ascending), joined again: the runs between cuts are sliced, so the cost is linear in both."""
    n = F.size(lines)
    runs = F.zip_with(F.concat(F.array(F.lit(-1)), cut), F.concat(cut, F.array(n)), lambda a, b: F.slice(lines, a + 2, b - a - 1))
    return F.array_join(F.flatten(runs), "\n")


def _cut(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the lines ``found`` (doc, version, pos), with n_lines and n_removed."""
    gone = found.filter(F.col("doc").isNotNull()).groupBy(F.col("doc").alias("__doc"), F.col("version").alias("__version")).agg(F.sort_array(F.collect_set("pos")).alias("__cut"))
    out = docs.join(gone, (docs["doc_id"] == gone["__doc"]) & (F.xxhash64(docs["text"]) == gone["__version"]), "left")
    # The lines are bound once, by a lambda: a plain reference would split the text again for every run.
    clean = F.when(F.col("__cut").isNull(), F.col("text")).otherwise(F.transform(F.array(_split(F.col("text"))), lambda lines: _without(lines, F.col("__cut")))[0])
    counts = {
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("long"),
        "n_removed": F.when(F.col("__cut").isNull(), 0).otherwise(F.size("__cut")).cast("long"),
    }
    names = [c for c in docs.columns if c.lower() not in counts]
    return out.select(*[clean.alias("text") if c.lower() == "text" else F.col(f"`{c}`") for c in names], *[v.alias(k) for k, v in counts.items()])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return clean.select("doc_id", "n_lines", "n_removed", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP7_SQL = f"""
WITH s AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, source, CAST(unnest(range(len(ls))) AS INTEGER) AS pos, unnest(ls) AS line FROM s),
k AS (SELECT doc_id, source, pos, line, trim(line, ' ' || chr(9) || chr(13)) AS t FROM l),
b AS (SELECT t, min(struct_pack(d := doc_id, p := pos)) AS f FROM k WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= {MIN_SITES}),
m AS (SELECT k.doc_id, k.pos, k.line, b.t IS NOT NULL AND struct_pack(d := k.doc_id, p := k.pos) <> b.f AS cut FROM k LEFT JOIN b ON k.t = b.t),
g AS (SELECT doc_id, count(*) AS n_lines, sum(CAST(cut AS INTEGER)) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT cut), '') AS txt FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(length(coalesce(txt, '')) AS BIGINT) AS kept_chars, sha256(coalesce(txt, '')) AS text_sha256
FROM documents d LEFT JOIN g USING (doc_id)
"""
