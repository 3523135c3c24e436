"""The text operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cavitas.llm.bpe import op5_bpe_round_trip
from cavitas.llm.centroid_clustering import OP12_SQL, op12_centroid_clustering
from cavitas.llm.decontaminate import op3_decontaminate
from cavitas.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from cavitas.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from cavitas.llm.hyperminhash import OP13_SQL, op13_minhash_near_dedup
from cavitas.llm.language_id import op8_language_id
from cavitas.llm.license_scan import op2_license_scan
from cavitas.llm.secret_scan import op7_secret_scan
from cavitas.llm.simhash import op9_simhash_near_dedup
from cavitas.llm.substring_dedup import OP10_SQL, op10_substring_dedup
from cavitas.llm.token_shards import op6_token_shards
from cavitas.llm.toxicity import op1_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_license_scan": op2_license_scan,
    "op3_decontaminate": op3_decontaminate,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_token_shards": op6_token_shards,
    "op7_secret_scan": op7_secret_scan,
    "op8_language_id": op8_language_id,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_minhash_near_dedup": op13_minhash_near_dedup,
}

ORACLE_SQL: dict[str, str] = {"op4_exact_dedup": OP4_SQL, "op10_substring_dedup": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_centroid_clustering": OP12_SQL, "op13_minhash_near_dedup": OP13_SQL}
