"""Token counts as delta-maintained rollups: signed changes by source, language and tokenizer, committed once a batch."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import chunks, n_words

KEYS = ("source", "lang", "tokenizer")


#: Fixed value: how byte-level vocabularies of this kind cut a text before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def counter(path: str, pieces: str = PIECES) -> Callable[[str], int]:
    """A function from a text to its number of tokens, by a file of ranks (`.tiktoken`, cut by `pieces`) or a whole
    tokenizer (`.json`). Names of special tokens in a text are ordinary text."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        encoding = tiktoken.Encoding("ranks", pat_str=pieces, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(encoding.encode_ordinary(text))
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, source, lang, words, tokens of each row, tokens by the tokenizer file at `path`, which every executor can
    read; null and empty texts have none of either. Texts are encoded one at a time, so a very long one needs memory for
    itself only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for part in chunks(batches):
            sizes = [count(t.as_py() or "") for t in part.column(4)]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(sizes, pa.int64())], ["doc_id", "source", "lang", "words", "tokens"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", "source", "lang"))
    rows = docs.select("doc_id", "source", "lang", n_words(docs["text"]).alias("words"), "text")
    return rows.mapInArrow(run, f"{kinds}, words bigint, tokens bigint")


def inserts(counts: DataFrame, tokenizer: str) -> DataFrame:
    """Changes that add documents: source, lang, tokenizer, docs, tokens."""
    return _signed(counts, tokenizer, 1)


def deletes(counts: DataFrame, tokenizer: str) -> DataFrame:
    return _signed(counts, tokenizer, -1)


def revisions(old: DataFrame, new: DataFrame, tokenizer: str) -> DataFrame:
    """Changes that replace the counts of documents: the old ones leave, the new ones come."""
    return deletes(old, tokenizer).unionByName(inserts(new, tokenizer))


def _signed(counts: DataFrame, tokenizer: str, sign: int) -> DataFrame:
    return counts.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("docs"), (sign * F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"))


class Rollup:
    """Totals kept as one small file set a batch below `path`, a folder that driver and executors share.

    A batch's changes are summed by source, language and tokenizer and written to `batch=<id>`. Spark marks the folder
    complete when all its files are in place; only complete batches count. Committing an id again changes nothing, and a
    batch that a lost driver left half written is written anew. Totals add up all batches, so they follow inserts,
    deletes and revisions without reading a document again. Null sources and languages are groups of their own; a batch
    without rows is complete and adds nothing; keys whose documents are all gone leave the totals. One writer at a time.
    """

    schema = "source string, lang string, tokenizer string, docs bigint, tokens bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = spark._jvm.org.apache.hadoop.fs
        self.configuration = spark._jsc.hadoopConfiguration()

    def _exists(self, path: str) -> bool:
        place = self.files.Path(path)
        return place.getFileSystem(self.configuration).exists(place)

    def committed(self, batch: int) -> bool:
        return self._exists(f"{self.path}/batch={int(batch)}/_SUCCESS")

    def commit(self, batch: int, changes: Callable[[], DataFrame] | DataFrame) -> bool:
        """Adds a batch once; False if it is there already. `changes` may be a function, which is then not called in vain."""
        if self.committed(batch):
            return False
        rows = changes() if callable(changes) else changes
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.path}/batch={int(batch)}")
        return True

    def totals(self, upto: int | None = None) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over the complete batches, to batch `upto` if given."""
        place = self.files.Path(self.path)
        system = place.getFileSystem(self.configuration)
        found = [s.getPath() for s in system.listStatus(place)] if system.exists(place) else []
        ids = [int(p.getName().removeprefix("batch=")) for p in found if p.getName().startswith("batch=")]
        paths = [f"{self.path}/batch={i}" for i in sorted(ids) if self.committed(i) and (upto is None or i <= upto)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter((F.col("docs") != 0) | (F.col("tokens") != 0))

