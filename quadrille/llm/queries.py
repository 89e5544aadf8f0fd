"""The registered queries of this subpackage, one an operator, over whole tables."""

from __future__ import annotations

from quadrille.llm import decontaminate, language, licenses, mixing, oracles, packing, pii, quality, secrets, simhash, vectors
from quadrille.llm.common import table


def op1_pii(spark, sf_dir):
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op2_simhash(spark, sf_dir):
    return simhash.classes(table(spark, sf_dir, "documents"))


def op3_mixing(spark, sf_dir):
    return mixing.scored(table(spark, sf_dir, "documents"))


def op4_licenses(spark, sf_dir):
    return licenses.report(table(spark, sf_dir, "documents"))


def op5_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_secrets(spark, sf_dir):
    return secrets.incremental_report(table(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontaminate(spark, sf_dir):
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language(spark, sf_dir):
    return language.identified(table(spark, sf_dir, "documents"))


def op10_embeddings(spark, sf_dir):
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def queries():
    return {f.__name__: f for f in (op1_pii, op2_simhash, op3_mixing, op4_licenses, op5_packing, op6_secrets, op7_quality, op8_decontaminate, op9_language, op10_embeddings)}


def oracle_sql():
    """What SQL can express; the other queries are tested against brute force in ``tests/llm``."""
    return {"op4_licenses": oracles.LICENSES, "op6_secrets": oracles.SECRETS, "op8_decontaminate": oracles.DECONTAMINATE, "op10_embeddings": oracles.EMBEDDINGS}
