"""The search language of logs: parsed into clauses on the driver, run as one Catalyst filter."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_RESULTS = 500
#: Field names of the language and their columns; values of the first three are upper-cased.
FIELDS = {"level": "level", "category": "category", "env": "environment", "service": "service_name"}
UPPER = ("level", "category", "env")
#: Further columns that a query can name as they are.
PLAIN = ("message", "country", "city", "environment")
_REGEX = re.compile(r"[\\^$.|?*+()\[\]{}]")


@dataclass(frozen=True)
class Clause:
    kind: str  # FIELD, TEXT or PHRASE
    field: str
    value: str


@dataclass(frozen=True)
class Query:
    raw: str
    operator: str = "AND"
    clauses: tuple[Clause, ...] = field(default_factory=tuple)


def _cut(text: str, word: str) -> list[str]:
    """Pieces between `` word `` (any case) outside double quotes, trimmed, without empty ones."""
    pieces, start, quoted, at = [], 0, False, 0
    mark = f" {word} "
    while at < len(text):
        if text[at] == '"':
            quoted = not quoted
        if not quoted and text[at : at + len(mark)].upper() == mark:
            pieces.append(text[start:at])
            at += len(mark)
            start = at
        else:
            at += 1
    pieces.append(text[start:])
    return [p for p in map(str.strip, pieces) if p]


def _clause(text: str) -> Clause:
    if m := re.fullmatch(r'([^:"]*):"(.*)"', text, re.S):
        return Clause("PHRASE", m[1].strip().lower(), m[2])
    if len(text) > 1 and text[0] == text[-1] == '"':
        return Clause("PHRASE", "message", text[1:-1])
    name, colon, value = text.partition(":")
    if colon:
        return Clause("FIELD", name.strip().lower(), value.strip().lower())
    return Clause("TEXT", "message", text)


def parse(text: str | None) -> Query:
    """One operator holds for a whole query: OR if the text has one anywhere, even in quotes, else AND. There is no NOT and there are no parentheses."""
    raw = (text or "").strip()
    operator = "OR" if " OR " in raw.upper() else "AND"
    return Query(raw, operator, tuple(_clause(p) for p in _cut(raw, operator)))


def _checked(pattern: str) -> str:
    """A pattern of Java's regex language; one that is none is refused here, not by the tasks that would run it."""
    spark = SparkSession.getActiveSession()
    if spark is not None and hasattr(spark, "_jvm"):
        try:
            spark._jvm.java.util.regex.Pattern.compile(pattern)
        except Exception as e:
            raise ValueError(f"not a regular expression: {pattern.removeprefix('(?i)')}") from e
    return pattern


def clause_filter(c: Clause, columns: list[str]) -> Column:
    message = F.col("message")
    if c.kind == "FIELD":
        value = F.lit(c.value.upper() if c.field in UPPER else c.value)
        if c.field in FIELDS:
            return F.col(FIELDS[c.field]) == value
        if c.field.startswith("tags.") and "tags" in columns:
            return F.col("tags")[c.field[5:]] == value
        return F.col(c.field) == value if c.field in PLAIN and c.field in columns else F.lit(False)
    if c.kind == "PHRASE":
        return message.rlike(_checked(rf"(?i)\b{c.value}\b"))
    # A text without regex signs is a plain substring test, which is cheaper than a regex.
    return message.rlike(_checked(f"(?i){c.value}")) if _REGEX.search(c.value) or not c.value.isascii() else F.lower(message).contains(c.value.lower())


def condition(query: Query, columns: list[str]) -> Column:
    parts = [clause_filter(c, columns) for c in query.clauses]
    if not parts:
        return F.lit(False)
    return reduce((lambda a, b: a | b) if query.operator == "OR" else (lambda a, b: a & b), parts)


def matches(logs: DataFrame, text: str | None, from_ms: int = 0, to_ms: int = 0) -> DataFrame:
    """All records that a query asks for, within the times given (0: no limit)."""
    out = logs.filter(condition(parse(text), logs.columns))
    if from_ms:
        out = out.filter(F.col("ts_ms") >= from_ms)
    return out.filter(F.col("ts_ms") <= to_ms) if to_ms else out


def execute(logs: DataFrame, text: str | None, from_ms: int = 0, to_ms: int = 0, limit: int = MAX_RESULTS) -> DataFrame:
    """The newest ``limit`` matching records, newest first (Spark keeps the top rows of each task only)."""
    return matches(logs, text, from_ms, to_ms).orderBy(F.desc("ts_ms"), "event_id").limit(limit)


def explain(spark: SparkSession, text: str | None) -> DataFrame:
    """operator, type, field, value of each clause."""
    q = parse(text)
    return spark.createDataFrame([(q.operator, i, c.kind, c.field, c.value) for i, c in enumerate(q.clauses)], "operator string, clause int, type string, field string, value string")


def hits(logs: DataFrame, text: str | None, from_ms: int = 0, to_ms: int = 0) -> DataFrame:
    """Number of matches."""
    return matches(logs, text, from_ms, to_ms).agg(F.count("*").alias("hits"))
