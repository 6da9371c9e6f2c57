"""The corpus pipeline: toxicity, near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a frame; run() writes each result as Parquet to the shared folder and
reads it back as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweft.llm import mixing, ngram_join, sentencepiece_codec
from logweft.llm import toxicity as lexicon
from logweft.llm.common import cut, free, quoted, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted lexicon doesn't call toxic.

    The lexicon is learned from the labelled documents among docs; without toxic and clean ones among them all documents
    stay. Null and empty texts stay, repeated rows fare alike, an empty table stays empty; docs' columns may have any
    names."""
    model = lexicon.learn(docs, table(spark, sf_dir, "labels"))
    scored = lexicon.score(docs, model)
    return scored.filter(F.col(quoted(scored.columns[-1])[0]) == 0).select(*quoted(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with a shingle similarity of 0.75 or more one row: the one with the smallest id.

    Null ids come last; of different texts under one id the one with the smallest hash goes first; of repeated rows any
    one stays. Documents without words (null, empty and blank texts) link with nothing and stay, each row of them. An
    empty table stays empty; docs' columns may have any names."""
    found = ngram_join.link_components(docs.select("doc_id", "text"))
    # How often each row of a component occurs, and the first row of each component: both shrink before the shuffle.
    rows = found.filter("component IS NOT NULL").groupBy("component", "doc_id", "key").count()
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    best = rows.groupBy("component").agg(F.min(first).alias("b"))
    judged = rows.join(best, "component").select("doc_id", "key", "count", (first == F.col("b")).alias("first")).filter("NOT first OR count > 1")
    judged, _ = cut(judged, "pipeline-copies")
    key = free("__key", docs.columns)
    keyed = docs.withColumn(key, ngram_join.key_of())
    out = _matching(keyed, key, judged, "left_anti")
    often = judged.filter("first")
    if often.limit(1).count():
        out = out.union(_matching(keyed, key, often, "left_semi").dropDuplicates(["doc_id", key]))
    return out.drop(key)


def _matching(keyed: DataFrame, key: str, rows: DataFrame, kind: str) -> DataFrame:
    """The rows of keyed that are among rows (doc_id, key), or are not; few of those are sent to all tasks."""
    rows = rows.select(F.col("doc_id").alias("__i"), F.col("key").alias("__k"))
    few = rows.limit(ngram_join.SENT + 1).count() <= ngram_join.SENT
    return keyed.join(F.broadcast(rows) if few else rows, keyed["doc_id"].eqNullSafe(rows["__i"]) & (keyed[quoted(key)[0]] == rows["__k"]), kind)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null texts count no words, a null source is a source of its own, rows with one id are taken or left together, an
    empty table stays empty; docs' columns may have any names."""
    return mixing.mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids, and whether decoding those gives the text back (null: the empty text).

    Null and empty texts have no pieces; repeated rows are coded alike; an empty table stays empty. The new columns are
    piece_ids and lossless, with a number behind where docs has such a name."""
    return sentencepiece_codec.encode(docs, sentencepiece_codec.default_vocabulary(), decoded=None, lossless="lossless")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mix_sources), ("sentencepiece", sentencepiece)]

#: SQL can express neither the lexicon nor the segmentation; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
