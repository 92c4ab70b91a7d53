"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bag_minhash, centroids, chat, exact_dedup, merkle, ngram_join
from .bag_minhash import op2_bag_minhash
from .centroids import op11_centroid_clustering
from .chat import op8_reply_trees
from .exact_dedup import op7_streaming_dedup
from .lm_scoring import op6_gated_lm
from .merkle import op13_merkle_manifest
from .ngram_join import op12_ngram_join
from .packing import op1_harmonic_packing
from .quality import op5_co_training
from .records import op10_record_files
from .toxicity import op4_counterfactual_toxicity
from .winnowing import op9_winnowing
from .wordbpe import op3_speculative_bpe


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_harmonic_packing": op1_harmonic_packing,
        "op2_bag_minhash": op2_bag_minhash,
        "op3_speculative_bpe": op3_speculative_bpe,
        "op4_counterfactual_toxicity": op4_counterfactual_toxicity,
        "op5_co_training": op5_co_training,
        "op6_gated_lm": op6_gated_lm,
        "op7_streaming_dedup": op7_streaming_dedup,
        "op8_reply_trees": op8_reply_trees,
        "op9_winnowing": op9_winnowing,
        "op10_record_files": op10_record_files,
        "op11_centroid_clustering": op11_centroid_clustering,
        "op12_ngram_join": op12_ngram_join,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_bag_minhash": bag_minhash.SQL,
        "op7_streaming_dedup": exact_dedup.SQL,
        "op8_reply_trees": chat.SQL,
        "op11_centroid_clustering": centroids.SQL,
        "op12_ngram_join": ngram_join.SQL,
        "op13_merkle_manifest": merkle.SQL,
    }
