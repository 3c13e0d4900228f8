"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chat, classifier, html, packing, rules, sharding, simhash, urlfilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_hash_tree_shards": sharding.op2_hash_tree_shards,
    "op3_adaptive_scan": ann.op3_adaptive_scan,
    "op4_simhash_variants": simhash.op4_simhash_variants,
    "op5_ordinal_quality": classifier.op5_ordinal_quality,
    "op6_bpe_word_shuffle": bpe.op6_bpe_word_shuffle,
    "op7_url_filter": urlfilter.op7_url_filter,
    "op8_config_lp_packing": packing.op8_config_lp_packing,
    "op9_rule_ledger": rules.op9_rule_ledger,
    "op10_wrapper_induction": html.op10_wrapper_induction,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": chat.OP1_SQL,
    "op7_url_filter": urlfilter.OP7_SQL,
    "op9_rule_ledger": rules.OP9_SQL,
}
