"""Registered queries of the corpus operators and their SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bytebpe import op4_byte_bpe
from .clusters import op13_centroid_clusters
from .decontaminate import op5_decontamination
from .lines import op1_line_dedup
from .oracles import CENTROIDS, DECONTAMINATION, TRIE
from .packing import op11_packing
from .prefixcounts import op6_token_counts
from .quality import op3_quality_classifier
from .rules import op9_quality_rules
from .secrets import op8_secret_scan
from .simhash import op10_simhash
from .suffixes import op7_suffix_dedup
from .trie import op12_conversation_trie
from .urlmodel import op2_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_decontamination": op5_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality_rules": op9_quality_rules,
    "op10_simhash": op10_simhash,
    "op11_packing": op11_packing,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_centroid_clusters": op13_centroid_clusters,
}

#: DuckDB SQL for the queries that SQL can express on whole tables.
ORACLES: dict[str, str] = {"op5_decontamination": DECONTAMINATION, "op12_conversation_trie": TRIE, "op13_centroid_clusters": CENTROIDS}
