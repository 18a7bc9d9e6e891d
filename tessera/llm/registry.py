"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, hnsw, lattice, licenses, packing, quality, secrets, simhash, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pigeonhole_edit": decontaminate.op1_pigeonhole_edit,
        "op2_subword_lattice": lattice.op2_subword_lattice,
        "op3_signature_rules": licenses.op3_signature_rules,
        "op4_markov_secrets": secrets.op4_markov_secrets,
        "op5_temporal_list": urls.op5_temporal_list,
        "op6_hnsw_shards": hnsw.op6_hnsw_shards,
        "op7_nb_char_linear": toxicity.op7_nb_char_linear,
        "op8_simhash_vantage": simhash.op8_simhash_vantage,
        "op9_attention_bags": quality.op9_attention_bags,
        "op10_best_fit": packing.op10_best_fit,
    }


def oracles() -> dict[str, str]:
    return {"op5_temporal_list": urls.ORACLE}
