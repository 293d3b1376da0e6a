"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.llm import base_sql, binrec, bktree, decontam, licenses, mixing, pii, quotes, rules, secrets, weaklabel
from recordmill.llm.common import read, shared_dir, table


WORD_BPE = "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.linked_conversations(read(spark, sf_dir, "conversations"))


def op2_template_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op3_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = table(rules.text_stats(read(spark, sf_dir, "documents"), ["doc_id"]))
    learned = rules.learn(stats, read(spark, sf_dir, "labels"))
    return rules.judged(stats, learned).select("doc_id", *rules.STATS, "base_failed", "kept", *rules.EXTRA, "rule")


def op4_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weaklabel.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(read(spark, sf_dir, "documents"))


def op6_length_delimited_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    binrec.write(read(spark, sf_dir, "documents"), folder, tokenizer_path(WORD_BPE))
    return binrec.read_back(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_latent_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bktree.grouped(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_span_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def base_text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``op3_decision_list`` measures and its base test, without the learned rules."""
    stats = rules.text_stats(read(spark, sf_dir, "documents"), ["doc_id"])
    return stats.select("doc_id", *rules.STATS, rules.base_failed().alias("base_failed"))


def base_secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``op5_markov_secrets`` counts by its base patterns."""
    return op5_markov_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def base_personal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``op10_span_votes`` counts by its base patterns."""
    return op10_span_votes(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in pii.BASE_KINDS))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quotation_links": op1_quotation_links,
    "op2_template_automata": op2_template_automata,
    "op3_decision_list": op3_decision_list,
    "op4_weak_labels": op4_weak_labels,
    "op5_markov_secrets": op5_markov_secrets,
    "op6_length_delimited_records": op6_length_delimited_records,
    "op7_source_schedule": op7_source_schedule,
    "op8_latent_retrieval": op8_latent_retrieval,
    "op9_simhash_bktree": op9_simhash_bktree,
    "op10_span_votes": op10_span_votes,
    "base_text_statistics": base_text_statistics,
    "base_secret_counts": base_secret_counts,
    "base_personal_counts": base_personal_counts,
}
ORACLE_SQL: dict[str, str] = {
    "op2_template_automata": licenses.sql(),
    "base_text_statistics": base_sql.TEXT_STATISTICS,
    "base_secret_counts": base_sql.SECRET_COUNTS,
    "base_personal_counts": base_sql.PERSONAL_COUNTS,
}
