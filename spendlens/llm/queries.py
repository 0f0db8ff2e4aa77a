"""The registered queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm import collocations, decontaminate, html_extract, language_id, lattice_lm, ngram_join, packing, prefix_trie, quality, tool_calls, toxicity, url_filter, warc
from spendlens.llm.common import prepare, read_table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packed(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Pieces with the checksum of their ids, packed (the ids stay with ``cut_pieces``)."""
    pieces = packing.cut_pieces(docs, tokenizer).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.best_fit_pack(pieces)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(read_table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality.stored_ledger(read_table(spark, sf_dir, "documents"))
    return quality.apply_policy(ledger, quality.POLICIES[quality.DEFAULT_POLICY])


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = warc.response_records(read_table(spark, sf_dir, "pages"))
    return warc.derive(responses).withColumn("page_id", F.col("source_id").cast("bigint")).drop("source_id")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(read_table(spark, sf_dir, "documents"))


URL_RULES = [url_filter.Rule("block", "net"), url_filter.Rule("allow", "example.net", "/en/"),
             url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/")]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, URL_RULES).drop("url")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    score = toxicity.score_documents(docs, read_table(spark, sf_dir, "labels"))
    return docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), score.alias("score")) \
        .withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_texts(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found).drop("uid")


TOOLS = {
    "reply": {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {
        "text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "history": {"type": "object"}}},
    "configure": {"type": "object", "required": ["text"], "additionalProperties": False, "properties": {
        "text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0, "maximum": 0}}},
}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns as tool calls and results: what is not the assistant's calls a tool, the assistant's next turn is the result.

    A user's call refers to the call two turns before as its history.
    """
    asked = turns.where("role <> 'assistant' OR role IS NULL")
    history = F.when((F.col("role") == "user") & (F.col("turn") >= 2), F.struct(F.concat(F.lit("c"), (F.col("turn") - 2).cast("string")).alias("$ref")))
    calls = asked.select("conv_id", F.concat(F.lit("c"), F.col("turn").cast("string")).alias("call_id"), "turn",
                         F.when(F.col("role") == "user", "reply").when(F.col("role") == "system", "configure").otherwise(F.col("role")).alias("name"),
                         F.to_json(F.struct("text", "turn", history.alias("history"))).alias("arguments"))
    results = turns.where("role = 'assistant'").select(
        "conv_id", F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op10_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = conversation_calls(read_table(spark, sf_dir, "conversations"))
    return tool_calls.link_tool_calls(calls, results, TOOLS).withColumn("errors", F.array_join("errors", "; "))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = prefix_trie.rebuilt_conversations(prefix_trie.number_turns(read_table(spark, sf_dir, "conversations")))
    return prefix_trie.trie_report(prefix_trie.prefix_paths(turns, convs))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def _shipped(query: Callable) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: _shipped(q) for q in (
    op1_best_fit_packing,
    op2_html_extraction,
    op3_quality_rules,
    op4_warc_derivatives,
    op5_ngram_jaccard_join,
    op6_url_filters,
    op7_toxicity,
    op8_lm_scoring,
    op9_benchmark_decontamination,
    op10_tool_call_linking,
    op11_prefix_trie,
    op12_language_id,
    op13_phrase_collocations,
)}
