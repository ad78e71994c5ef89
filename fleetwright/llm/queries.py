"""One registered query per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetwright.llm import (chat_masks, decontaminate, exact_dedup, html_extract, jaccard_join, language_id,
                             mixture_pack, piece_codec, spelling_groups, token_index, toxicity, turn_trie,
                             url_cascade)
from fleetwright.llm.tokens import public_path

TOKENIZER = "word_bpe_49k.json"
CHAT_TOKENIZER = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"

#: verdict, host, path
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(table(spark, sf_dir, "documents"))


def token_index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_index.indexed_tokens(table(spark, sf_dir, "documents"), public_path(TOKENIZER), end_id=1)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "shard_offset")


def exact_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def html_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    chats = chat_masks.format_chats(turns.unionByName(extra), public_path(CHAT_TOKENIZER))
    return chat_masks.read_back(chats, public_path(CHAT_TOKENIZER))


def jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_groups(table(spark, sf_dir, "documents"), size=3, percent=90, links=True)


def url_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return url_cascade.judge(table(spark, sf_dir, "pages"), rules)


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_pack.pack(table(spark, sf_dir, "documents"), public_path(TOKENIZER), end_id=2)


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def trie_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def spelling_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups.variants(table(spark, sf_dir, "documents"))


def piece_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_path(PIECE_MODEL)
    return piece_codec.digests(piece_codec.encode(table(spark, sf_dir, "documents"), model), model)


QUERIES = {
    "op1_language_id": language_query,
    "op2_token_index": token_index_query,
    "op3_exact_dedup": exact_dedup_query,
    "op4_html_extraction": html_query,
    "op5_chat_masks": chat_query,
    "op6_jaccard_join": jaccard_query,
    "op7_url_rules": url_rules_query,
    "op8_mixture_packing": packing_query,
    "op9_toxicity": toxicity_query,
    "op10_decontamination": decontamination_query,
    "op11_turn_trie": trie_query,
    "op12_spelling_groups": spelling_query,
    "op13_piece_codec": piece_query,
}
