"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .audio import op9_audio
from .bpe import op10_bpe
from .decontaminate import OP8_SQL, op8_decontaminate
from .html_text import op1_html_text
from .licences import op3_licences
from .line_dedup import OP7_SQL, op7_line_dedup
from .near_duplicates import OP5_SQL, op5_jaccard_join
from .quality import op4_quality
from .toxicity import op2_toxicity
from .warc import OP6_SQL, op6_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": op1_html_text,
        "op2_toxicity": op2_toxicity,
        "op3_licences": op3_licences,
        "op4_quality": op4_quality,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_warc": op6_warc,
        "op7_line_dedup": op7_line_dedup,
        "op8_decontaminate": op8_decontaminate,
        "op9_audio": op9_audio,
        "op10_bpe": op10_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_jaccard_join": OP5_SQL,
        "op6_warc": OP6_SQL,
        "op7_line_dedup": OP7_SQL,
        "op8_decontaminate": OP8_SQL,
    }
