"""Queries of the operators, each over the whole of its tables, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions.ordering import use_checkpoint_dir

from . import captures, decontaminate, licenses, lm, manifest, mixing, neardup, pii, quality, resample, rollups, substrings, whitening
from .common import cut_lineage, documents


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(documents(spark, sf_dir))


def op4_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op9_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_rollups(spark: SparkSession, sf_dir: str, tokenizer: str = "/opt/tokenizers/byte_bpe_50k.tiktoken") -> DataFrame:
    """Totals after five batches over all documents: counted by words, then by a tokenizer; short ones taken out of both;
    word counts revised to have an end mark each; and the second batch committed once more, without effect."""
    counts = cut_lineage(rollups.count_tokens(documents(spark, sf_dir), tokenizer))
    words = counts.select("source", "lang", F.col("words").alias("tokens"))
    long, short = words.filter("tokens >= 20"), counts.filter("words < 20")
    marked = long.withColumn("tokens", F.col("tokens") + 1)
    rollup = rollups.Rollup(spark, f"{use_checkpoint_dir(spark)}/rollup-{spark.range(1).select(F.expr('uuid()')).first()[0]}")
    rollup.commit(1, rollups.inserts(words, "words"))
    rollup.commit(2, rollups.inserts(counts, "byte_bpe_50k"))
    out = [rollups.deletes(short.select("source", "lang", F.col(c).alias("tokens")), name) for c, name in (("words", "words"), ("tokens", "byte_bpe_50k"))]
    rollup.commit(3, out[0].unionByName(out[1]))
    rollup.commit(4, rollups.revisions(long, marked, "words"))
    rollup.commit(2, rollups.inserts(counts, "byte_bpe_50k"))
    return rollup.totals()


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to an archive, looked up through its index and read back; the archive goes when the result is written."""
    path = f"{use_checkpoint_dir(spark)}/archive-{spark.range(1).select(F.expr('uuid()')).first()[0]}"
    try:
        return captures.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), captures.Archive(path))
    finally:
        captures.remove(spark, path)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return manifest.manifest(docs, manifest.tampered_fifth(docs["doc_id"]))


_ALL = (
    op1_decontaminate, op2_mix, op3_substrings, op4_lattice, op5_licenses, op6_personal_data, op7_quality, op8_near_duplicates, op9_resample, op10_rollups,
    op11_whiten, op12_captures, op13_manifest,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {"op2_mix": mixing.MIX_SQL, "op12_captures": captures.CAPTURES_SQL, "op13_manifest": manifest.MANIFEST_SQL}
