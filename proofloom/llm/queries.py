"""The subpackage's registered queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .exact import OP11_SQL, op11_exact_dedup
from .jaccard import op7_jaccard_join
from .language import op3_language_id
from .licenses import op2_license_scan
from .lines import op5_line_dedup
from .merkle import OP13_SQL, op13_merkle_manifest
from .mixing import OP8_SQL, op8_mixing
from .packing import op6_packing
from .phrases import OP12_SQL, op12_phrase_mining
from .pseudonyms import op4_pseudonyms
from .vectors import op9_topk_search, op10_embedding_dedup
from .wavelet import op1_wavelet_shards


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_wavelet_shards": op1_wavelet_shards,
    "op2_license_scan": op2_license_scan,
    "op3_language_id": op3_language_id,
    "op4_pseudonyms": op4_pseudonyms,
    "op5_line_dedup": op5_line_dedup,
    "op6_packing": op6_packing,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_mixing": op8_mixing,
    "op9_topk_search": op9_topk_search,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_merkle_manifest": op13_merkle_manifest,
    "pipeline": _pipeline,
}

ORACLE: dict[str, str] = {"op8_mixing": OP8_SQL, "op11_exact_dedup": OP11_SQL, "op12_phrase_mining": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
