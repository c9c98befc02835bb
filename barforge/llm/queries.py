"""The corpus operators as queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, importance, jaccard, mixing, neighbours, pii, quality, sharding, tokens, urls, warc, whitening
from ._common import materialize, read
from .oracle import ORACLE_SQL  # noqa: F401


#: The rules that op5 is given.
URL_RULES = [
    urls.Rule("net", "/", "block"),
    urls.Rule("example.net", "/en/", "allow"),
    urls.Rule("example.com", "/de/", "block"),
    urls.Rule("org", "/fr/", "allow"),
]


#: Disclosure from which op2 removes a term instead of generalising it.
REMOVE = 0.95


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents."""
    return decontaminate.contaminated_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(read(spark, sf_dir, "documents").select("doc_id", "text"), remove=REMOVE, keep_text=False)
    number = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    terms = lambda test: F.size(F.filter("spans", lambda s: (s["kind"] == "term") & test(s["disclosure"]))).cast("long")
    return found.select(
        "doc_id", *map(number, pii.KINDS), F.sha2(pii.joined(F.col("base_spans")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"),
        terms(lambda d: d < REMOVE).alias("n_generalised"), terms(lambda d: d >= REMOVE).alias("n_removed"), F.col("text_sha256").alias("sanitised_sha256"),
    )


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(read(spark, sf_dir, "pages"))


def op4_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.external_shuffle(docs, shards=40)
    return out.select(
        "doc_id",
        sharding.record_size(F.col("text")).alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document with its number; bad: low quality or toxic."""
    bad = F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad")
    labels = read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(bad)
    return urls.filter_urls(read(spark, sf_dir, "pages"), labels, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=90)


def op7_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """``vocabulary``: path of the vocabulary file; by default that of the installed public tokenizers."""
    import public_tokenizers

    count = tokens.token_counter(spark, vocabulary or public_tokenizers.path("word_bpe_49k.json"))
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), count(F.col("text")).alias("n_tokens")
    )
    return docs.withColumn("over_limit", F.col("n_tokens") > 2048)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixing.taken_words(placed, mixed).select("doc_id", "size", "source_size", "target", "taken")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    found = warc.read_archives(spark, path, payload=False)
    # What was written comes back whole: a gap is an error, not a row to leave out.
    whole = F.when(F.col("reason").isNull(), F.col("page_id")).otherwise(F.raise_error(F.concat(F.lit("a gap in an archive: "), F.col("reason"))).cast("long"))
    return found.withColumn("page_id", whole).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = quality.quality_features(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).drop("text")
    out = quality.quality_filter(materialize(features, "quality"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every row whose id is divisible by 50."""
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), every=50)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"), components=16)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents of 20 words or more, towards the features of the benchmark."""
    out = importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), least_words=20, percent=25)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


OPERATORS = (
    op1_decontamination, op2_pii, op3_main_text, op4_external_shuffle, op5_url_filter, op6_jaccard_join, op7_token_counts, op8_source_mix, op9_warc, op10_quality_rules,
    op11_nearest_neighbours, op12_whitening, op13_importance_resampling,
)
QUERIES = {f.__name__: f for f in OPERATORS}
