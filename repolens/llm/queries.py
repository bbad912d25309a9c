"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from repolens.llm.chat import OP4_SQL, op4_chat
from repolens.llm.decontaminate import op9_decontamination
from repolens.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from repolens.llm.language import op8_language
from repolens.llm.merkle import OP11_SQL, op11_merkle
from repolens.llm.mixing import OP2_SQL, op2_mixing
from repolens.llm.near_dedup import OP5_SQL, op5_near_dedup
from repolens.llm.pieces import op13_pieces
from repolens.llm.quality import op7_quality
from repolens.llm.sharding import op6_sharding
from repolens.llm.spelling import OP12_SQL, op12_spelling
from repolens.llm.url_rules import op10_url_rules
from repolens.llm.warc import OP3_SQL, op3_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_mixing": op2_mixing,
        "op3_warc": op3_warc,
        "op4_chat": op4_chat,
        "op5_near_dedup": op5_near_dedup,
        "op6_sharding": op6_sharding,
        "op7_quality": op7_quality,
        "op8_language": op8_language,
        "op9_decontamination": op9_decontamination,
        "op10_url_rules": op10_url_rules,
        "op11_merkle": op11_merkle,
        "op12_spelling": op12_spelling,
        "op13_pieces": op13_pieces,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1_SQL,
        "op2_mixing": OP2_SQL,
        "op3_warc": OP3_SQL,
        "op4_chat": OP4_SQL,
        "op5_near_dedup": OP5_SQL,
        "op11_merkle": OP11_SQL,
        "op12_spelling": OP12_SQL,
    }
