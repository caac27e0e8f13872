"""The queries of this subpackage over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.skew import split_join
from ..session import kept, table
from .oracles import ORACLE as ORACLE
from . import canonical, leaks, neighbours, overlap, packing, scans, sentences, splits


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of documents.text."""
    return sentences.sentences(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


def p3_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of articles.text; of an article delivered twice, those of every delivery."""
    df = table(spark, sf_dir, "articles").select(F.struct("document_id", "loaded_at").alias("key"), "text", "language")
    out = sentences.sentences(df, "key", "text", "language")
    return out.select("key.document_id", "key.loaded_at", "start_char", "end_char")


def p3_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of relation_instance.context; of a sample delivered twice, those of every delivery."""
    df = table(spark, sf_dir, "relation_instance").select("sample_id", "context", "language")
    return sentences.sentences(df, "sample_id", "context", "language")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items they contain."""
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that contain items, without the spans taken from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return leaks.remove_leaks(docs, table(spark, sf_dir, "eval_item")).select("doc_id", "clean_text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that look the same and differ in their characters."""
    return canonical.alike_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text in the one consistent form."""
    return canonical.canonical(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").drop("text")


def scanned_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with their title and their lists of mentions, ready for the operators on scans."""
    lists = F.flatten(F.transform(F.filter("sampled_pairs", lambda p: p.isNotNull()), lambda p: F.array(p["pers_mentions_list"], p["loc_mentions_list"])))
    return table(spark, sf_dir, "articles").select("document_id", "text", "language", F.col("media.publication_title").alias("title"), lists.alias("names"))


def article_corpus(spark: SparkSession, sf_dir: str) -> scans.Corpus:
    return scans.train(scanned_articles(spark, sf_dir), "text", "language", "title", "names")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of page layout and scanning in articles.text and in the persons' mentions."""
    corpus = article_corpus(spark, sf_dir)
    a = scans.defects(scanned_articles(spark, sf_dir), "document_id", "text", "language", "title", corpus)
    m = scans.mention_defects(table(spark, sf_dir, "relation_instance"), "sample_id", "pers_mentions_list", corpus)
    cols = ["table_name", "record_key", "pos", "defect"]
    return a.withColumn("table_name", F.lit("articles")).select(cols).union(m.withColumn("table_name", F.lit("relation_instance")).select(cols)).distinct()


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """articles.text as continuous readable paragraphs."""
    return scans.repaired(scanned_articles(spark, sf_dir), "document_id", "text", "language", "title", article_corpus(spark, sf_dir))


def p4_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relation_instance.context as continuous readable paragraphs; headers are told by the article's title."""
    titles = table(spark, sf_dir, "articles").groupBy("document_id").agg(F.max("media.publication_title").alias("title"))
    df = table(spark, sf_dir, "relation_instance").select("sample_id", "document_id", "context", "language").join(titles, "document_id", "left")
    return scans.repaired(df, "sample_id", "context", "language", "title", article_corpus(spark, sf_dir))


def p4_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relation_instance.pers_mentions_list with clean mentions, each in its place."""
    return scans.repaired_mentions(table(spark, sf_dir, "relation_instance"), "sample_id", "pers_mentions_list", article_corpus(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every article: the smallest source within it."""
    df = table(spark, sf_dir, "articles")
    source = F.lower(F.trim(F.regexp_replace("source", r"^\s+|\s+$", "")))
    shared = [(source, False), (F.col("correspondent"), False), (F.col("sampled_pairs.pers_entity_id"), True), (F.col("sampled_pairs.pers_wikidata_QID"), True)]
    groups = splits.group_records(df, "document_id", shared)
    sources = df.groupBy("document_id").agg(F.min(source).alias("source"))
    joined = kept(groups.join(sources, "document_id"))
    least = joined.groupBy("group").agg(F.min("source").alias("group_source"))
    return split_join(joined, least, ["group"], right_hot={}).select("document_id", "group_source")  # one group may hold most articles


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """train, val and test (70/15/15) for every article, related articles together."""
    groups = p5_found(spark, sf_dir).withColumn("name", F.coalesce("group_source", "document_id")).select("document_id", "name")
    return splits.assign_splits(groups, "document_id", {"train": 0.7, "val": 0.15, "test": 0.15})


def split_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, x, h, split: the latest delivery of every article that has a split."""
    split = F.lower(F.trim("split"))
    by_document = table(spark, sf_dir, "split_ids").groupBy("document_id").agg(F.min(split).alias("split"))
    articles = table(spark, sf_dir, "articles").select("document_id", F.col("text").alias("x"), F.col("media.publication_title").alias("h"), "loaded_at")
    latest = articles.groupBy(F.col("document_id")).agg(F.max_by(F.struct("x", "h"), F.struct(F.col("loaded_at"), F.col("x"))).alias("r"))
    return latest.join(by_document, "document_id").select(F.col("document_id").alias("k"), "r.x", "r.h", "split")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of articles, one in train and the other in val or test, that are the same or nearly."""
    pairs = overlap.overlaps(split_articles(spark, sf_dir), scans.continuous_words)
    return pairs.select(F.least("eval_key", "train_key").alias("document_id_a"), F.greatest("eval_key", "train_key").alias("document_id_b")).distinct()


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps by evaluation split and source of the evaluation article."""
    source = F.lower(F.regexp_replace("source", r"^\s+|\s+$", ""))
    sources = table(spark, sf_dir, "articles").groupBy(F.col("document_id").alias("k")).agg(F.min(source).alias("source"))
    return overlap.report(split_articles(spark, sf_dir), scans.continuous_words, sources).withColumnRenamed("n_records", "n_articles")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of mask_batch one of which is among the 5 most similar others of the other, cosine 0.9 or more."""
    near = neighbours.neighbours(table(spark, sf_dir, "mask_batch"), "vec_id", "mask_emb", dim=64)
    return near.select(F.least("id", "other").alias("vec_id_a"), F.greatest("id", "other").alias("vec_id_b")).distinct()


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents.text in containers of 2,048 tokens: which tokens of which document lie in which container."""
    return packing.containers(packing.measured(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


QUERIES = {f.__name__: f for f in (p3_found, p3_articles, p3_context, p8_found, p8_clean, p9_found, p9_canonical, p4_found, p4_repaired, p4_context, p4_mentions, p5_found, p5_splits, p6_found, p6_report, p2_found, p7_containers)}
