"""Registered queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcast.llm.bpe import encode_decode
from weekcast.llm.common import crc_mod, read_table
from weekcast.llm.conversation_repair import damage, repair
from weekcast.llm.cotraining import classify
from weekcast.llm.lm_scoring import lm_scores
from weekcast.llm.merkle import manifest
from weekcast.llm.packing import pack
from weekcast.llm.quality_rules import quality_rules
from weekcast.llm.simhash import simhash_groups
from weekcast.llm.sql import SQL  # noqa: F401  (registered beside QUERIES)
from weekcast.llm.substring_dedup import remove_passages
from weekcast.llm.suffix_dedup import remove_repeats
from weekcast.llm.topk import top_k
from weekcast.llm.toxicity import toxicity
from weekcast.llm.warc import round_trip


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and hashed n-gram log ratio; the trusted target is what `labels` marks as quality 1."""
    labels = read_table(spark, sf_dir, "labels")
    return quality_rules(read_table(spark, sf_dir, "documents"), labels.where(F.col("quality") == 1)).withColumn("llr", F.round("llr", 6))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, fingerprints linked at two bits or fewer."""
    return simhash_groups(read_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 4096 ids of the public word vocabulary, end id 2."""
    return pack(read_table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best inner products of every hundredth vector against all others."""
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level ids of every text and the text that they decode to, as digests."""
    both = encode_decode(read_table(spark, sf_dir, "documents"))
    count = (F.octet_length("ids") / 4).cast("long")
    return both.select("doc_id", count.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that start in a document with a smaller id are removed."""
    rows = remove_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return rows.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("span_starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to a WARC archive and read back."""
    return round_trip(read_table(spark, sf_dir, "pages"), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause grammar fitted on the rows whose id hash is not held out."""
    held_out = crc_mod("doc_id", 4) == 2
    rows = toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), is_training=~held_out)
    return rows.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by two co-trained views."""
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-count and attention-model scores of every text; ids with crc32 % 7 = 2 are held out."""
    rows = lm_scores(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash trees over all documents; every seventh id by crc32 is checked with a changed n_chars."""
    changed = [F.col(c) for c in ("doc_id", "source", "lang")] + [F.col("n_chars").cast("decimal(20,0)") + 1, F.col("text")]
    seventh = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = manifest(read_table(spark, sf_dir, "documents"), changed, seventh)
    text = lambda c: F.lower(F.hex(c))
    digests = [text(c).alias(c) for c in ("leaf", "subroot", "root")]
    return rows.select("doc_id", *digests, F.sha2(text("siblings").cast("binary"), 256).alias("proof_sha256"), text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged by a hash of its turns and repaired at least cost."""
    return repair(damage(read_table(spark, sf_dir, "conversations")), lost_column="lost")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words that start in a document with a smaller id are removed."""
    rows = remove_passages(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.zip_with("span_ends", "span_starts", lambda b, a: b - a), F.lit(0).cast("long"), lambda total, n: total + n)
    return rows.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {
    "op13_substring_dedup": op13_substring_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op11_merkle": op11_merkle,
    "op10_lm_scoring": op10_lm_scoring,
    "op4_cotraining": op4_cotraining,
    "op2_toxicity": op2_toxicity,
    "op9_warc": op9_warc,
    "op1_suffix_dedup": op1_suffix_dedup,
    "op7_bpe": op7_bpe,
    "op6_topk": op6_topk,
    "op5_packing": op5_packing,
    "op8_simhash": op8_simhash,
    "op3_quality_rules": op3_quality_rules,
}
