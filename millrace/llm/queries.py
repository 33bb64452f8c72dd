"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, hard_negatives, html_text, language, lm_score, mixing, neardup, neighbours, quality, token_store, voronoi_join, warc_zip, whitening

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_quality": quality.query,
        "op2_neighbours": neighbours.query,
        "op3_html": html_text.query,
        "op4_language": language.query,
        "op5_warc": warc_zip.query,
        "op6_token_store": token_store.query,
        "op7_decontaminate": decontaminate.query,
        "op8_neardup": neardup.query,
        "op9_lm_score": lm_score.query,
        "op10_mixing": mixing.query,
        "op11_hard_negatives": hard_negatives.query,
        "op12_voronoi_join": voronoi_join.query,
        "op13_whitening": whitening.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": warc_zip.SQL, "op11_hard_negatives": hard_negatives.SQL, "op12_voronoi_join": voronoi_join.SQL}
