"""Benchmark decontamination: rare n-gram seeds find passages near a test item, Smith-Waterman alignment scores them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import chunks, n_words

#: ASCII punctuation, dropped from words before they are compared.
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def plain_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(None, _PUNCTUATION).split()


@dataclass(frozen=True)
class Matching:
    """`seed` words in a row start an alignment if chance brings them up less than once in `rarity` words."""

    seed: int = 3
    rarity: float = 1e8
    least_seeds: float = 0.25  # share of the seeds of each stretch of an item that count as rare at least,
    stretch: int = 16  # so many seeds long, so that an excerpt has seeds of its own
    similarity: float = 0.5  # weight aligned over weight of the item
    run_words: int = 30  # so many words of an item in one passage are a copy, however long the item is,
    run_similarity: float = 0.8  # if they align with this share of their own weight
    least_words: int = 6
    slack: int = 12  # words looked at beyond the item's own length on either side
    block_words: int = 1_000_000  # benchmark words in one pass over the documents


@dataclass
class Block:
    """Some benchmark items, by position in the block: ids, words as numbers, weights, and rare seeds."""

    ids: list
    number: dict[bytes, int]
    words: list[np.ndarray]
    weight: np.ndarray
    keys: np.ndarray  # sorted seed keys
    places: np.ndarray  # (item, position) of each seed
    gap: float
    short: dict[int, list[tuple[int, np.ndarray]]]  # items of fewer words than a seed, by first word


def item_blocks(items: DataFrame, matching: Matching) -> Iterator[list[tuple]]:
    """The benchmark in blocks of about `block_words` words, each small enough for one task's memory."""
    sized = items.select("item_id", "text", n_words(items["text"]).alias("n"))
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    count = max(1, -(-total // matching.block_words))
    for k in range(count):
        part = sized.filter((F.col("n") > 0) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k))
        yield sorted({(r["item_id"], r["text"]) for r in part.toLocalIterator()}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def _word_counts(docs: DataFrame, number: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """How often each numbered word occurs in all documents, and the number of all words."""
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        counts = np.zeros(len(known) + 1, np.int64)
        for part in chunks(batches):
            for text in part.column(0):
                words = plain_words(text.as_py())
                counts += np.bincount(np.fromiter((known.get(w, len(known)) for w in words), np.int64, len(words)), minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(number) + 1, np.int64)
    for r in rows:
        counts[r["word"]] = r["n"]
    return counts[:-1], int(counts.sum())


def _keys(words: np.ndarray, seed: int, base: int) -> np.ndarray:
    """One number for each run of `seed` words; -1 where a word is not in the block."""
    n = len(words) - seed + 1
    if n < 1:
        return np.empty(0, np.int64)
    key, ok = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(seed):
        part = words[k : k + n]
        ok &= part >= 0
        key = key * np.uint64(base) + part.astype(np.uint64)
    return np.where(ok, (key >> np.uint64(1)).astype(np.int64), -1) if base**seed >= 2**63 else np.where(ok, key.astype(np.int64), -1)


def make_block(docs: DataFrame, rows: list[tuple], matching: Matching) -> Block:
    texts = [plain_words(text) for _, text in rows]
    number = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    words = [np.array([number[w] for w in t], np.int64) for t in texts]
    counts, total = _word_counts(docs, number)
    weight = np.log((total + 2) / (counts + 1))
    keys, places, short = [], [], {}
    for item, w in enumerate(words):
        if 0 < len(w) < matching.seed:
            short.setdefault(int(w[0]), []).append((item, w))
        own = _keys(w, matching.seed, len(number))
        if not len(own):
            continue
        # Rarity is what chance would bring, from single words; leaked copies hardly change it.
        chance = -sum(weight[w[k : k + len(own)]] for k in range(matching.seed))
        for begin in range(0, len(own), matching.stretch):
            part = chance[begin : begin + matching.stretch]
            limit = max(-np.log(matching.rarity), np.sort(part)[min(len(part) - 1, int(np.ceil(matching.least_seeds * len(part))))])
            for at in begin + np.flatnonzero(part <= limit):
                keys.append(own[at])
                places.append((item, at))
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    gap = 0.5 * float(weight.mean()) if len(weight) else 1.0
    return Block([i for i, _ in rows], number, words, weight, np.array(keys, np.int64)[order], np.array(places, np.int64).reshape(-1, 2)[order], gap, short)


def align(item: np.ndarray, weight: np.ndarray, passage: np.ndarray, gap: float) -> tuple[float, int, int]:
    """Best local alignment score, and the places in item and passage where it ends. Equal words score their weight, others and gaps -gap."""
    ramp = gap * np.arange(1, len(passage) + 1)
    above = np.zeros(len(passage) + 1)
    best = (0.0, -1, -1)
    for i, word in enumerate(item):
        cell = np.maximum(above[:-1] + np.where(passage == word, weight[word], -gap), above[1:] - gap)
        cell = np.maximum(np.maximum.accumulate(np.maximum(cell, 0.0) + ramp) - ramp, 0.0)
        above = np.concatenate([[0.0], cell])
        top = int(cell.argmax())
        if cell[top] > best[0]:
            best = (float(cell[top]), i, top)
    return best


def _short_matches(own: np.ndarray, block: Block) -> list[tuple]:
    """Items too short for a seed, where exactly their words stand; the first such place of each."""
    found = {}
    for at in np.flatnonzero(np.isin(own, np.fromiter(block.short, np.int64, len(block.short)))).tolist():
        for item, target in block.short[int(own[at])]:
            if item not in found and np.array_equal(own[at : at + len(target)], target):
                found[item] = (item, 1.0, at, at + len(target))
    return [found[k] for k in sorted(found)]


def matches(words: list[bytes], block: Block, matching: Matching) -> list[tuple]:
    """(item, score, start, stop): for each item found in a text its best passage, by word."""
    own = np.fromiter((block.number.get(w, -1) for w in words), np.int64, len(words))
    found = _short_matches(own, block) if block.short else []
    keys = _keys(own, matching.seed, len(block.number))
    at = np.flatnonzero(keys >= 0)
    if not len(at) or not len(block.keys):
        return found
    low = np.searchsorted(block.keys, keys[at], "left")
    high = np.searchsorted(block.keys, keys[at], "right")
    spans: dict[int, list[tuple[int, int]]] = {}
    for p, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
        for item, place in block.places[a:b].tolist():
            start = max(0, p - place - matching.slack)
            stop = min(len(words), p - place + len(block.words[item]) + matching.slack)
            regions = spans.setdefault(item, [])
            if regions and start <= regions[-1][1]:
                regions[-1] = (min(start, regions[-1][0]), max(stop, regions[-1][1]))
            else:
                regions.append((start, stop))
    for item, regions in spans.items():
        target = block.words[item]
        whole = float(block.weight[target].sum())
        best, run = (0.0, 0, 0), False
        for start, stop in regions:
            passage = own[start:stop]
            score, i, j = align(target, block.weight, passage, block.gap)
            if score / whole > best[0]:
                back = align(target[: i + 1][::-1], block.weight, passage[: j + 1][::-1], block.gap)
                best = (score / whole, start + j - back[2], start + j + 1)
                # The part of the item that aligned, by itself.
                part = target[i - back[1] : i + 1]
                run = len(part) >= matching.run_words and score >= matching.run_similarity * float(block.weight[part].sum())
        if run or best[0] >= matching.similarity and best[2] - best[1] >= min(matching.least_words, len(target)):
            found.append((item, min(best[0], 1.0), best[1], best[2]))
    return found


def contaminated(docs: DataFrame, items: DataFrame, matching: Matching = Matching()) -> DataFrame:
    """Documents with a copy of a benchmark item, exact or edited: doc_id, item_id, score, first_word, end_word.

    One row for each row of `docs` and item whose best passage aligns with at least `similarity` of the item's weight
    (words weigh by their rarity in all documents), or holds `run_words` of its words nearly as they are. `score` is the
    share of the item's weight. An item of fewer words than a seed is found wherever exactly its words stand together;
    leave such items out of the benchmark if they are ordinary words. Null and empty texts, and items without a word,
    match nothing. A very long text is searched as a whole, one text at a time. Repeated documents return repeated rows,
    items equal in id and text count once, rows without id stay; ids may be of any type. Empty tables give no rows; extra
    columns are ignored. The benchmark goes through memory in blocks of bounded size, with two passes over the documents
    for each; nothing but results is shuffled.
    """
    kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (items, "item_id")))
    schema = f"doc_id {kind}, item_id {item_kind}, score double, first_word bigint, end_word bigint"
    result = None
    for rows in item_blocks(items, matching):
        shared = docs.sparkSession.sparkContext.broadcast(vars(make_block(docs, rows, matching)))
        item_type = to_arrow_type(items.schema["item_id"].dataType)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, item_type=item_type) -> Iterator[pa.RecordBatch]:
            block = Block(**shared.value)
            for part in chunks(batches):
                at, out = [], []
                for i, text in enumerate(part.column(1)):
                    for hit in matches(plain_words(text.as_py()), block, matching):
                        at.append(i)
                        out.append(hit)
                columns = [part.column(0).take(pa.array(at, pa.int64())), pa.array([block.ids[x[0]] for x in out], item_type)]
                columns += [pa.array([x[k] for x in out], t) for k, t in ((1, pa.float64()), (2, pa.int64()), (3, pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score", "first_word", "end_word"])

        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        result = found if result is None else result.unionAll(found)
    return result


def keep_clean(docs: DataFrame, items: DataFrame, matching: Matching = Matching()) -> DataFrame:
    """The documents without a copy of a benchmark item, all columns as they are; each is judged where it is, without a join.

    What a copy is, `contaminated` says. Null and empty texts stay; repeated rows stay or go together; an empty table
    stays empty. Words weigh by their rarity in all of `docs`, whichever block of the benchmark is searched.
    """
    given = docs
    for rows in item_blocks(items, matching):
        shared = docs.sparkSession.sparkContext.broadcast(vars(make_block(given, rows, matching)))
        at = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            block = Block(**shared.value)
            for part in chunks(batches):
                yield part.filter(pa.array([not matches(plain_words(t.as_py()), block, matching) for t in part.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
