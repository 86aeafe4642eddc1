"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexigrove.llm import op1_decontaminate, op2_quality, op3_lm, op4_langid, op5_tokens, op6_pieces, op7_simhash, op8_toxicity, op9_html, op10_rules, op11_importance, op12_alignment, op13_digest
from lexigrove.llm.common import table


def op1_decontaminate_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, doc_id) pairs where the document holds 0.8 or more of the item's five-word shingles."""
    return op1_decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the byte-level convolutional network."""
    return op2_quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score and self-attention model score of every document."""
    return op3_lm.lm_scores(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by hierarchical discrimination."""
    return op4_langid.language_id(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after its redactions."""
    return op5_tokens.token_counts(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces, N-best scores and round trip of every document."""
    return op6_pieces.digest(op6_pieces.encode(table(spark, sf_dir, "documents")))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return op7_simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op8_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by Levenshtein automata over a lexicon trie."""
    return op8_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return op9_html.extract(table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and isolation-forest verdict of every document."""
    return op10_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document against the benchmark texts."""
    return op11_importance.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token groups, links and their corpus-wide counts of every document."""
    return op12_alignment.alignment(table(spark, sf_dir, "documents"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how alike they are."""
    return op13_digest.digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontaminate_containment, op2_quality_classifier, op3_lm_scoring, op4_language_id, op5_token_counts, op6_sentencepiece, op7_simhash_dedup, op8_toxicity_scores, op9_html_extraction, op10_quality_rules, op11_importance_resampling, op12_cross_tokenizer_alignment, op13_document_fingerprints)}
ORACLE_SQL = {"op1_decontaminate_containment": op1_decontaminate.ORACLE_SQL, "op11_importance_resampling": op11_importance.ORACLE_SQL}
