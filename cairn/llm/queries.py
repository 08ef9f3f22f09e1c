"""The registered queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fair_mix, guess_cost, hidden_markov, host_reputation, importance, isolation, oracle, shared_lists, simhash_pivot, transport_stream, tree_extract, walsh_codes, warc_zip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guess_cost.scan(table(spark, sf_dir, "documents"))


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.archive_round_trip(table(spark, sf_dir, "pages"))


#: host, path, verdict
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_reputation.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op4_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_tree_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_extract.extract(table(spark, sf_dir, "pages"))


def op6_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.described(transport_stream.stored(table(spark, sf_dir, "documents")))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, ids=False)


def op8_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.classify(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])


def op9_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = isolation.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op10_simhash_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pivot.near_duplicates(table(spark, sf_dir, "documents"))


def op11_shared_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_lists.mine(table(spark, sf_dir, "embeddings"))


def op12_walsh_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walsh_codes.compressed(table(spark, sf_dir, "embeddings"))


def op13_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_guess_cost": op1_guess_cost,
    "op2_warc_zip": op2_warc_zip,
    "op3_host_reputation": op3_host_reputation,
    "op4_fair_mix": op4_fair_mix,
    "op5_tree_extract": op5_tree_extract,
    "op6_transport_stream": op6_transport_stream,
    "op7_bpe": op7_bpe,
    "op8_importance": op8_importance,
    "op9_isolation": op9_isolation,
    "op10_simhash_pivot": op10_simhash_pivot,
    "op11_shared_lists": op11_shared_lists,
    "op12_walsh_codes": op12_walsh_codes,
    "op13_hidden_markov": op13_hidden_markov,
}

SQL: dict[str, str] = {"op2_warc_zip": oracle.OP2, "op3_host_reputation": oracle.op3(URL_RULES), "op11_shared_lists": oracle.OP11, "op12_walsh_codes": oracle.op12()}
