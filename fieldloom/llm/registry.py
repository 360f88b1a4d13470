"""Queries of the text operators and their SQL, as __spark_entry__ adds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_repeats, filter_audit, minhash, secrets, sharding, word_repeats
from .byte_repeats import op8_suffix_dedup
from .filter_audit import op12_filter_audit
from .html_text import op6_html_text
from .language import op11_language_id
from .licenses import op7_license_scan
from .minhash import op5_minhash
from .pieces import op2_sentencepiece
from .quality import op1_quality_rules
from .secrets import op3_secret_scan
from .sharding import op9_sharding
from .tiling import op4_decontamination
from .whitening import op13_embedding_whitening
from .word_repeats import op10_substring_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_quality_rules, op2_sentencepiece, op3_secret_scan, op4_decontamination, op5_minhash, op6_html_text, op7_license_scan, op8_suffix_dedup, op9_sharding, op10_substring_dedup, op11_language_id, op12_filter_audit, op13_embedding_whitening)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_secret_scan": secrets.ORACLE,
        "op5_minhash": minhash.ORACLE,
        "op8_suffix_dedup": byte_repeats.ORACLE,
        "op9_sharding": sharding.ORACLE,
        "op10_substring_dedup": word_repeats.ORACLE,
        "op12_filter_audit": filter_audit.ORACLE,
    }
