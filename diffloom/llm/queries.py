"""The queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from diffloom.llm import chat_format, decontam, html_text, lang_id, lm_scoring, merkle, pieces, quality_rules, simhash, small_world, url_filters, warc_archive, whitening
from diffloom.llm.common import table


def op1_lm_scoring(spark, sf_dir):
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents"))


def op2_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_rules.quality(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return lang_id.predict(docs, lang_id.learn(docs))


def op5_warc_archive(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return warc_archive.describe(warc_archive.read_records(spark, *warc_archive.write_archive(pages)))


def op6_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    same = "\\### Assistant: </turn> ok"
    planted = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(same).alias("text"))
    planted = planted.select(*(F.col(c).cast(rows.schema[c].dataType) for c in rows.columns))
    return chat_format.read_back(chat_format.format_conversations(rows.unionByName(planted)))


def op7_html_text(spark, sf_dir):
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op8_pieces(spark, sf_dir):
    found = pieces.encode_pieces(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", F.size("pieces").cast("long").alias("n_pieces"), F.hex(F.xxhash64("pieces")).alias("pieces_digest"), "lossless")


def op9_decontamination(spark, sf_dir):
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_url_filters(spark, sf_dir):
    return url_filters.judge_urls(table(spark, sf_dir, "pages"))


def op11_embedding_copies(spark, sf_dir):
    return small_world.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_embedding_whitening(spark, sf_dir):
    """deviation as a long: a sum of squares beyond it stops the query, where the operator's decimal goes on."""
    rows = table(spark, sf_dir, "embeddings")
    return whitening.whiten(rows, whitening.learn(rows)).withColumn("deviation", F.col("deviation").cast("long"))


def op13_merkle_manifest(spark, sf_dir):
    return merkle.tamper_check(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op")} | {"pipeline": pipeline}


def oracle_sql():
    return {"op5_warc_archive": warc_archive.SQL, "op6_chat_format": chat_format.SQL, "op10_url_filters": url_filters.sql(), "op13_merkle_manifest": merkle.SQL}
