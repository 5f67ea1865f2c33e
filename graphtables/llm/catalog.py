"""The registered queries of the training-data operators (thin: operator -> contract columns)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtables.llm import alignment, conversations, decontam, katz, licenses, line_chunks, packing, quality, secrets, simhash, suffixes, tokens, warc
from graphtables.llm.oracle import ORACLE  # noqa: F401
from graphtables.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash_variants(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, d, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def op2_credential_links(spark: SparkSession, d: str) -> DataFrame:
    """Secrets in every whole text of ``documents``; weak ones where their parts co-occur."""
    found = secrets.scan(table(spark, d, "documents"))

    def n(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(F.col("id").alias("doc_id"), n(0).alias("n_assign"), n(1).alias("n_access"),
                        n(2).alias("n_hex"), F.sha2(secrets.span_text(base), 256).alias("base_sha256"),
                        secrets.span_text(F.col("spans")).alias("spans"), secrets.link_text(F.col("links")).alias("links"))


def op3_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Bytes and tokens of every whole text of ``documents``."""
    import public_tokenizers

    counted = tokens.count_tokens(table(spark, d, "documents"), public_tokenizers.path(tokens.TOKENIZER))
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op4_katz_scores(spark: SparkSession, d: str) -> DataFrame:
    """Katz backoff score of every document, learnt from those not held out."""
    return katz.score(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def op5_license_inheritance(spark: SparkSession, d: str) -> DataFrame:
    """Licence of every document, its own or its directory's. ``documents`` has no paths:
    they are laid out as source / hundreds / tens of the id / id."""
    docs = table(spark, d, "documents")
    at = F.col("doc_id")
    path = F.concat_ws("/", "source", F.floor(at / 400).cast("string"), F.floor(at / 100).cast("string"),
                       F.concat(at.cast("string"), F.lit(".txt")))
    found = licenses.scan(docs.select("doc_id", "text", path.alias("path")))
    return found.withColumnRenamed("id", "doc_id")


def op6_warc_chain(spark: SparkSession, d: str) -> DataFrame:
    """A WARC record per row of ``pages``, written, read back and verified."""
    pages = table(spark, d, "pages")
    path = warc.archive_path(spark)
    warc.write_warc(pages, path)
    records = warc.read_warc(spark, path, pages.schema["page_id"].dataType.simpleString())
    return records.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest",
                          "record_type", "refers_to")


def op7_fm_decontamination(spark: SparkSession, d: str) -> DataFrame:
    """Words of every document inside a 10-word window of ``benchmark``."""
    found = decontam.find_spans(table(spark, d, "documents"), table(spark, d, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(ids, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op8_quality_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Quality rules over every whole text of ``documents``."""
    return quality.judge(table(spark, d, "documents"))


def op9_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every document's tokens and end token packed into bins of the permitted lengths."""
    import public_tokenizers

    return packing.pack_tokens(table(spark, d, "documents"), public_tokenizers.path(tokens.TOKENIZER))


def op10_line_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every document without repeated runs of lines: sizes, number of lines removed, digest of the rest."""
    kept = line_chunks.remove_runs(table(spark, d, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_removed", F.char_length("text").cast("long").alias("n_chars"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op11_spill_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Links of every document's tokens between two tokenizers, and their corpus-wide counts."""
    import public_tokenizers

    found = alignment.align(table(spark, d, "documents"), public_tokenizers.path(alignment.A_FILE),
                            public_tokenizers.path(alignment.B_FILE))
    return found.select(F.col("id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                        "groups_sha256")


def op12_suffix_sort(spark: SparkSession, d: str) -> DataFrame:
    """Every document without the bytes of 100-byte strings that start earlier."""
    found = suffixes.remove_repeats(table(spark, d, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_conversation_repair(spark: SparkSession, d: str) -> DataFrame:
    """The damaged ``conversations``: faults, cheapest edits and digest of the repaired rows of each."""
    rows = conversations.damaged(table(spark, d, "conversations"))
    return conversations.summaries(conversations.repair(rows, present="present")).withColumnRenamed("conv", "conv_id")


QUERIES: dict[str, Query] = {
    "op1_simhash_variants": op1_simhash_variants,
    "op2_credential_links": op2_credential_links,
    "op3_token_counts": op3_token_counts,
    "op4_katz_scores": op4_katz_scores,
    "op5_license_inheritance": op5_license_inheritance,
    "op6_warc_chain": op6_warc_chain,
    "op7_fm_decontamination": op7_fm_decontamination,
    "op8_quality_cascade": op8_quality_cascade,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_line_chunks": op10_line_chunks,
    "op11_spill_alignment": op11_spill_alignment,
    "op12_suffix_sort": op12_suffix_sort,
    "op13_conversation_repair": op13_conversation_repair,
}
