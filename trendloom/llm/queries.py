"""The named queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import align, bpe, chat, licenses, minhash, packing, pii, quality, repair, repeats, topk, toxicity, vectors
from trendloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length of all documents."""
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), tokenizer()))


@query
def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and the text decoded from them, as digests."""
    return bpe.round_trips(table(spark, sf_dir, "documents"), tokenizer())


@query
def op6_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted and read back, as digests."""
    conversations = chat.with_added(table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.format_turns(conversations))


ORACLES["op6_chat_round_trip"] = chat.ORACLE.strip()


@query
def op9_factor_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License wording of all documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op4_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    documents = table(spark, sf_dir, "documents")
    return pii.digests(pii.find(documents, pii.fit(documents)))


@query
def op5_sorted_list_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best vectors for every hundredth vector."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.whole(F.col("embedding")).alias("vector"))
    return topk.top_k(rows, rows.where("vec_id % 100 = 0"), k=10)


ORACLES["op5_sorted_list_top_k"] = topk.ORACLE.strip()


@query
def op2_cover_tree_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of all embeddings."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


ORACLES["op2_cover_tree_duplicates"] = vectors.ORACLE.strip()


@query
def op7_coordinate_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents by two-word shingles."""
    return minhash.near_documents(table(spark, sf_dir, "documents"))


ORACLES["op7_coordinate_near_duplicates"] = minhash.ORACLE.strip()


@query
def op8_deep_shallow_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated bytes of all documents."""
    documents = table(spark, sf_dir, "documents")
    return repeats.digests(documents, repeats.spans(documents))


@query
def op11_lattice_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of all conversations, after their rows are damaged."""
    conversations = table(spark, sf_dir, "conversations")
    return repair.report(repair.damaged(conversations), conversations)


ORACLES["op11_lattice_repair"] = repair.ORACLE.strip()


@query
def op12_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; documents labelled as good are the trusted ones."""
    documents = table(spark, sf_dir, "documents")
    return quality.judged(documents, quality.fit(documents, table(spark, sf_dir, "labels")))


@query
def op13_span_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers aligned in all documents."""
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align.alignments(table(spark, sf_dir, "documents"), *paths)
