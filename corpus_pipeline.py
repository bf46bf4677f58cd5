"""The corpus pipeline: quality, language, near copies, benchmark passages, pieces.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. In every stage whole texts count, however long;
repeated rows of a document fare alike; columns beyond those of documents are passed on and clash with none of the
stage's own, but for the last stage, which leaves them out; an empty table stays empty. What null and empty texts and null
ids come to is said at each stage. All stages may share executors and Python workers, so each bounds the session's batches by bytes (`small_batches`).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from diffloom.llm import decontam, lang_id, pieces, quality_rules, simhash
from diffloom.llm.common import saved, small_batches, table


def quality(spark, docs, sf_dir):
    """Drops the documents that the quality rules reject.

    Null and empty texts have no words, so they go. A null id is no hindrance: it has no label to learn from. Labels of one
    kind only give a constant verdict beside the base rules.
    """
    small_batches(spark)
    return quality_rules.keep_good(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def language(spark, docs, sf_dir):
    """Drops the documents in no learnt language.

    Null texts and texts without a letter go. Rows with a null language are judged but not learnt from; if none is learnt, all go.
    """
    small_batches(spark)
    return lang_id.keep_known(docs, lang_id.learn(docs))


def near_copies(spark, docs, sf_dir):
    """Keeps the document with the smallest id of each group of near copies.

    A document is an id: repeated rows stay or go together, and rows with a null id stay. Texts without words are copies of one another.
    """
    small_batches(spark)
    return simhash.one_of_each(docs)


def benchmark_passages(spark, docs, sf_dir):
    """Drops the documents that hold a benchmark item.

    Null and empty texts hold none and stay, as null and empty items are held by none. Rows are told apart by their text, so a null id is no hindrance.
    """
    small_batches(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark, docs, sf_dir):
    """doc_id, n_bytes, n_pieces, lossless and pieces of each document.

    Null and empty texts have no pieces and are lossless; a null id draws as the empty one.
    """
    small_batches(spark)
    return pieces.encode_pieces(docs).select("doc_id", "n_bytes", F.size("pieces").alias("n_pieces"), "lossless", "pieces")


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("SentencePiece encoding", encode),
]

#: The learnt verdicts and the sampled pieces are beyond SQL. Each stage's operator is tested on its own; the test of the whole says
#: which planted documents go, and lets the learnt verdicts err on three of the others.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs, f"pipeline-{i}")
    return docs
