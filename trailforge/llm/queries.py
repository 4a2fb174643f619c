"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import op6_byte_bpe
from .ef_trie import op1_ef_trie
from .licence import ORACLE as LICENCE_SQL
from .licence import op9_licence
from .line_crf import op4_line_crf
from .partenum import op3_partenum
from .pii import op7_pii
from .prefix_hash import op2_prefix_hash
from .spaced_seed import op10_spaced_seed
from .url_filter import ORACLE as URL_SQL
from .url_filter import op5_url_filter
from .wavelet import op8_wavelet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_ef_trie, op2_prefix_hash, op3_partenum, op4_line_crf, op5_url_filter, op6_byte_bpe, op7_pii, op8_wavelet, op9_licence, op10_spaced_seed)
}
ORACLE: dict[str, str] = {"op5_url_filter": URL_SQL, "op9_licence": LICENCE_SQL}
