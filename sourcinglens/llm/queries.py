"""Registered queries of this package: each applies one operator, with its
production parameters, to its whole table; ORACLE has DuckDB SQL where SQL can
express the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from sourcinglens.llm.bpe import encode_decode
from sourcinglens.llm.common import scratch_folder
from sourcinglens.llm.exact_dedup import exact_dedup
from sourcinglens.llm.filter_audit import ORACLE as AUDIT_ORACLE, filter_audit
from sourcinglens.llm.html_extract import main_text
from sourcinglens.llm.lm_scoring import score
from sourcinglens.llm.merkle import ORACLE as MERKLE_ORACLE, manifest
from sourcinglens.llm.mixing import mix
from sourcinglens.llm.ngram_join import jaccard_groups
from sourcinglens.llm.pii import replace_private
from sourcinglens.llm.quality_cnn import classify
from sourcinglens.llm.quality_rules import ORACLE as RULES_ORACLE, quality_rules
from sourcinglens.llm.substring_dedup import substring_dedup
from sourcinglens.llm.token_counts import token_counts
from sourcinglens.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register("op1_quality_classifier")
def op1_quality_classifier(spark, sf_dir):
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@register("op2_exact_dedup", f"""
WITH d AS (SELECT doc_id, {LOWER} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm""")
def op2_exact_dedup(spark, sf_dir):
    return exact_dedup(read_table(spark, sf_dir, "documents")).drop("twins")


@register("op3_quality_rules", RULES_ORACLE)
def op3_quality_rules(spark, sf_dir):
    return quality_rules(read_table(spark, sf_dir, "documents"))


@register("op4_pii_surrogates")
def op4_pii_surrogates(spark, sf_dir):
    """The key is a parameter; a production run passes a secret of its own."""
    return replace_private(read_table(spark, sf_dir, "documents"), key="documents-demo-key")


@register("op5_mixing")
def op5_mixing(spark, sf_dir):
    return mix(read_table(spark, sf_dir, "documents"))


@register("op6_html_extract")
def op6_html_extract(spark, sf_dir):
    return main_text(read_table(spark, sf_dir, "pages"))


@register("op7_token_counts")
def op7_token_counts(spark, sf_dir):
    """The cache starts empty on each call, so that a run's work is its own."""
    docs = read_table(spark, sf_dir, "documents")
    return token_counts(docs, scratch_folder(docs, "token-cache"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op8_byte_bpe")
def op8_byte_bpe(spark, sf_dir):
    return encode_decode(read_table(spark, sf_dir, "documents"),
                         public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@register("op9_substring_dedup")
def op9_substring_dedup(spark, sf_dir):
    return substring_dedup(read_table(spark, sf_dir, "documents"))


@register("op10_ngram_jaccard")
def op10_ngram_jaccard(spark, sf_dir):
    return jaccard_groups(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@register("op11_merkle_manifest", MERKLE_ORACLE)
def op11_merkle_manifest(spark, sf_dir):
    return manifest(read_table(spark, sf_dir, "documents"))


@register("op12_filter_audit", AUDIT_ORACLE)
def op12_filter_audit(spark, sf_dir):
    return filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@register("op13_lm_scoring")
def op13_lm_scoring(spark, sf_dir):
    return score(read_table(spark, sf_dir, "documents"))
