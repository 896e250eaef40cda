"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, merkle, prefix_trie
from .byte_bpe import op4_byte_bpe
from .exact_dedup import op1_exact_dedup
from .fingerprints import op3_fingerprints
from .html_extract import op8_html
from .kneser_ney import op5_kneser_ney
from .language_id import op10_language_id
from .merkle import op12_merkle
from .near_dedup import op7_near_dedup
from .packing import op2_packing
from .prefix_trie import op11_prefix_trie
from .quality import op9_quality
from .sentence_pieces import op13_sentence_pieces
from .toxicity import op6_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_exact_dedup, op2_packing, op3_fingerprints, op4_byte_bpe, op5_kneser_ney, op6_toxicity, op7_near_dedup, op8_html, op9_quality, op10_language_id, op11_prefix_trie, op12_merkle, op13_sentence_pieces)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.ORACLE_SQL, "op11_prefix_trie": prefix_trie.ORACLE_SQL, "op12_merkle": merkle.ORACLE_SQL}
