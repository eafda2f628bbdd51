"""The queries of this package over the test tables, and their SQL answers where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from duebook.llm import answers
from duebook.llm.common import held_out, new_folder, table
from duebook.llm.conversations import repair_damaged
from duebook.llm.decontamination import contaminated
from duebook.llm.exact_dedup import exact_dedup
from duebook.llm.main_text import extract_main_text
from duebook.llm.ngram_join import jaccard_join
from duebook.llm.packing import pack_documents
from duebook.llm.quality import fit_quality, score_quality
from duebook.llm.spelling import spelling_variants
from duebook.llm.suffix_dedup import remove_repeats
from duebook.llm.suffix_lm import score_texts
from duebook.llm.token_files import read_token_files, write_token_files
from duebook.llm.toxicity import fit_toxicity, score_toxicity
from duebook.llm.warc import index_archives, write_archives

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), held_out("doc_id", 4, 2)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held)
    return score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), held_out("doc_id", 5, 0)
    model = fit_quality(docs, table(spark, sf_dir, "labels"), ~held)
    return score_quality(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return index_archives(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "token_files")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, path)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = held_out("doc_id", 5, 1)
    scores = score_texts(table(spark, sf_dir, "documents"), ~held)
    return scores.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(table(spark, sf_dir, "conversations"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_toxicity": op2_toxicity,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_quality": op4_quality,
        "op5_decontamination": op5_decontamination,
        "op6_warc": op6_warc,
        "op7_token_files": op7_token_files,
        "op8_packing": op8_packing,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_suffix_lm": op10_suffix_lm,
        "op11_html_extraction": op11_html_extraction,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": answers.NGRAM_JOIN,
        "op6_warc": answers.WARC,
        "op9_exact_dedup": answers.EXACT_DEDUP,
        "op11_html_extraction": answers.MAIN_TEXT,
        "op12_conversation_repair": answers.CONVERSATIONS,
        "op13_spelling_variants": answers.SPELLING,
    }
