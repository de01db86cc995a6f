"""Substring dedup by level-wise doubling: only windows repeated at half the length are looked at in full."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, n_words

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the half-length hashes that travel: chance collisions only bring candidates that the full length refuses.
_HALF_BITS = np.uint64(16)
#: An anchor in this share of a sample's places counts as frequent; no more than its inverse are listed, whatever the input.
_FREQUENT = 0.002
#: Parts into which the rows of what a frequent anchor marks are split where they meet.
_PARTS = 64


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(29))) * _ODD + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _doubled(one: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of `length` entries, each from two runs of about half the length."""
    if length == 1:
        return one
    half = length // 2
    left = _doubled(one, half)
    right = left if length == 2 * half else _mix(left[: len(left) - 1], one[half:])
    n = len(one) - length + 1
    return _mix(left[:n], right[half : half + n])


class Windows:
    """Windows of some texts laid end to end: hashes at half and full length, and the anchor of each window.

    A window's anchor is the place of the smallest half-length hash inside it, the first of equal ones. It depends on the
    window's words alone, so equal windows have equal anchors, and neighbouring windows mostly share one.
    """

    def __init__(self, texts: list[str | None], window: int):
        self.words = [(t or "").encode().split() for t in texts]
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.stop = np.cumsum(sizes)
        self.start = self.stop - sizes
        digest = xxhash.xxh64_intdigest
        one = np.fromiter((digest(w) for ws in self.words for w in ws), np.uint64, int(sizes.sum()))
        half = window // 2
        if len(one) < window:
            self.at = self.row = self.anchor = np.empty(0, np.int64)
            self.half = self.full = np.empty(0, np.uint64)
            return
        self.half = _doubled(one, half)
        n = len(one) - window + 1
        self.full = _mix(self.half[:n], self.half[half : half + n])
        place, reach = np.arange(len(self.half)), 1
        while reach < half + 1:
            step = min(reach, half + 1 - reach)
            a, b = place[: len(place) - step], place[step:]
            place = np.where(self.half[b] < self.half[a], b, a)
            reach += step
        row = np.repeat(np.arange(len(sizes)), sizes)[:n]
        at = np.arange(n)
        whole = at + window <= self.stop[row]
        self.at, self.row, self.anchor = at[whole], row[whole], place[:n][whole]

    def runs(self, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First index (into `at`) and length of each stretch of neighbouring windows with one anchor."""
        pick = np.arange(len(self.at)) if chosen is None else np.flatnonzero(chosen)
        if not len(pick):
            return pick, pick
        new = np.ones(len(pick), bool)
        new[1:] = (np.diff(self.anchor[pick]) != 0) | (np.diff(self.row[pick]) != 0)
        first = np.flatnonzero(new)
        return pick[first], np.diff(np.append(first, len(pick)))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _keyed(part: pa.RecordBatch, keys: list[str], rows: np.ndarray, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    take = pa.array(rows, pa.int64())
    return pa.RecordBatch.from_arrays([*[part.column(k).take(take) for k in range(len(keys))], *columns.values()], [*keys, *columns])


def _schema(keys: list[str], *more: str) -> str:
    return ", ".join(f"{c} bigint" for c in (*keys, *more))


def _with_places(base: DataFrame, places: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Texts with the lists of their places, one list a column; a text's places are never more than its words."""
    keys = base.columns[:-1]
    lists = places.groupBy(*keys).agg(*[F.collect_list(c).alias(c) for c in columns])
    return base.join(lists, keys, how).select(*base.columns, *columns)


def _split_copies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (keys and text) with the first key of each text, and the others: whole copies, all of whose windows start earlier."""
    keys = rows.columns[:-1]
    firsts = rows.groupBy(F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("m")).agg(F.min(F.struct(*keys)).alias("first")).select("first.*")
    return rows.join(firsts, keys, "left_semi").select(*rows.columns), rows.join(firsts, keys, "left_anti").select(*rows.columns)


def _anchors(batches: Iterator[pa.RecordBatch], keys: list[str], window: int) -> Iterator[pa.RecordBatch]:
    """Each text's anchors: hash `h` once a text, and in how many places (`c`). The text follows the keys."""
    for part in chunks(batches):
        w = Windows(part.column(len(keys)).to_pylist(), window)
        first, _ = w.runs()
        row, h = w.row[first], w.half[w.anchor[first]] >> _HALF_BITS
        by = np.lexsort((h, row))
        row, h = row[by], h[by]
        new = np.ones(len(row), bool)
        new[1:] = (np.diff(row) != 0) | (h[1:] != h[:-1])
        at = np.flatnonzero(new)
        yield _keyed(part, keys, row[at], {"h": _signed(h[at]), "c": pa.array(np.diff(np.append(at, len(row))))})


def frequent_anchors(docs: DataFrame, window: int, sample: float = 0.02) -> list[int]:
    """Anchors that are frequent in a sample of the texts, at most 500.

    They only say which rows are split where equal hashes meet; results do not depend on them.
    """
    texts = docs.select(F.lit(0).cast("long").alias("d"), "text").sample(sample, seed=1)
    found = texts.mapInArrow(lambda batches: _anchors(batches, ["d"], window), _schema(["d"], "h", "c"))
    return list(found.stat.freqItems(["h"], _FREQUENT).first()[0])


def _spread(*by: str) -> Column:
    """A number below zero for each row, by which it meets no other."""
    return F.lit(-1).cast("long") - F.shiftrightunsigned(F.xxhash64(*by), 16)


def _repeated_or(rows: DataFrame, mark: Column, counts: Column, *by: str) -> DataFrame:
    """Rows whose `h` is counted twice or more, or marked. Marked rows are kept without meeting others, so none is a hot key."""
    again = rows.filter(~mark).groupBy("h").agg(counts.alias("c")).filter("c > 1").select(F.col("h").alias("k"), F.col("h").alias("m"))
    # Hashes of half length are no less than zero. Only marked rows carry theirs beside the key.
    keyed = rows.withColumns({"k": F.when(mark, _spread(*by)).otherwise(F.col("h")), "own": F.when(mark, F.col("h"))}).drop("h")
    met = keyed.join(again, "k", "left").filter(F.col("own").isNotNull() | F.col("m").isNotNull())
    return met.withColumn("h", F.coalesce("own", "k")).drop("k", "m", "own")


def _in_parts(firsts: DataFrame, mark: Column) -> DataFrame:
    """Rows with a `salt`: marked ones once for each part."""
    parts = F.sequence(F.lit(0).cast("long"), F.lit(_PARTS - 1).cast("long"))
    return firsts.withColumn("salt", F.explode(F.when(mark, parts).otherwise(F.array(F.lit(0).cast("long")))))


def repeated_windows(base: DataFrame, window: int, frequent: list[int] | None = None) -> DataFrame:
    """Runs of windows (keys, start, n) whose words also start earlier, by key and place. `base`: keys, none of them null, and text.

    1. Half length: each text gives its anchors, each once; anchors that occur once are dropped (about a sixth of all
       places is counted, and every repeated window holds a repeated anchor).
    2. Full length, in runs: windows around a surviving anchor, taken together as long as they share it. A run whose
       words are the same as an earlier run's is repeated as a whole; inside one text that is seen at once.
    3. Full length, singly: where different runs share an anchor their first occurrences are compared window by window.

    Anchors listed as `frequent` are taken for repeated without a count, which the full length makes good, and what they
    mark meets in parts.
    """
    keys = base.columns[:-1]
    text = len(keys)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            w = Windows(part.column(text).to_pylist(), window)
            mark = np.zeros(len(w.half) + 1, bool)
            for start, stop, alive in zip(w.start, w.stop, part.column(text + 1)):
                here = w.half[start:stop] >> _HALF_BITS
                mark[start : start + len(here)] = np.isin(here, np.asarray(alive.values).view(np.uint64))
            first, n = w.runs(mark[w.anchor])
            row, at = w.row[first], w.at[first]
            whole = _mix(_mix(w.full[at], w.full[at + n - 1]), n.astype(np.uint64))
            by = np.lexsort((at, whole, row))
            later = np.zeros(len(row), np.int64)
            later[by[1:]] = (np.diff(row[by]) == 0) & (whole[by][1:] == whole[by][:-1])
            columns = {
                "h": _signed(w.half[w.anchor[first]] >> _HALF_BITS), "r": _signed(whole), "start": pa.array(at - w.start[row]),
                "n": pa.array(n), "later": pa.array(later),
            }
            yield _keyed(part, keys, row, columns)

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            w = Windows(part.column(text).to_pylist(), window)
            rows, at, hot = [], [], []
            for i, places in enumerate(zip(*[part.column(text + k) for k in (1, 2, 3)])):
                for a, k, z in zip(*[p.as_py() for p in places]):
                    rows += [i] * k
                    at += range(a, a + k)
                    hot += [z] * k
            rows, at = np.array(rows, np.int64), np.array(at, np.int64)
            yield _keyed(part, keys, rows, {"h": _signed(w.full[w.start[rows] + at]), "start": pa.array(at), "hot": pa.array(hot, pa.int64())})

    hot = F.col("h").isin(frequent) if frequent else F.lit(False)
    own_part = F.pmod(F.xxhash64(*keys), F.lit(_PARTS).cast("long"))
    zero = F.lit(0).cast("long")

    half = base.mapInArrow(lambda batches: _anchors(batches, keys, window), _schema(keys, "h", "c"))
    alive = _repeated_or(half, hot, F.sum("c"), *keys, "h")

    found = _with_places(base, alive, ["h"]).mapInArrow(runs, _schema(keys, "h", "r", "start", "n", "later"))
    order = F.struct(*keys, "start")
    later = F.col("later") == 1
    earliest = found.filter(~later).groupBy("r").agg(F.min(order).alias("first"), F.first("h").alias("h"), F.first("n").alias("n"))
    salt = F.when(later, _spread(*keys, "start")).when(hot, own_part).otherwise(zero)
    met = found.select(*keys, "start", "n", "r", "later", salt.alias("salt")).join(
        _in_parts(earliest, hot).select("r", "salt", "first"), ["r", "salt"], "left"
    )
    copies = met.filter(later | (order > F.col("first"))).select(*keys, "start", "n")

    edges = _repeated_or(earliest, hot, F.count("*"), "r").select("first.*", "n", hot.cast("long").alias("hot"))
    single = _with_places(base, edges, ["start", "n", "hot"]).mapInArrow(singles, _schema(keys, "h", "start", "hot"))
    # A window's words fix its anchor, so equal windows are marked alike.
    marked = F.col("hot") == 1
    before = single.groupBy("h").agg(F.min(order).alias("first"), F.max("hot").alias("hot"))
    parted = single.select(*keys, "h", "start", F.when(marked, own_part).otherwise(zero).alias("salt"))
    late = parted.join(_in_parts(before, marked).select("h", "salt", "first"), ["h", "salt"]).filter(order > F.col("first"))
    return copies.unionAll(late.select(*keys, "start", F.lit(1).cast("long").alias("n")))


def without_repeats(words: list[bytes], starts: np.ndarray, ns: np.ndarray, window: int) -> tuple[int, bytes]:
    """Number of words covered by the windows, and the others joined by spaces."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + ns + window - 1, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def dedup_substrings(docs: DataFrame, window: int = 20, texts: bool = False, sample: float = 0.02) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row, and with `texts` the kept words as `kept`.

    A word goes if a window of `window` (even) words over it starts earlier too: in a row with a smaller id, or further
    up in the same text. Null ids come before all others; of rows with the same id, those with other texts follow in an
    order of their own, and rows equal in id and text are one document, all of which return the same. Null and empty
    texts have no words. An empty table gives an empty result; extra columns are ignored. Whole texts are used. Of
    equal texts only the first is searched. Texts are shuffled once; frequent passages meet in counts and minima. Which
    passages are frequent is read from a share (`sample`) of the texts: their rows are then joined in parts. The result
    is the same for any sample.
    """
    if window < 4 or window % 2:
        raise ValueError("window must be an even number of at least 4 words")
    # A hash of the text tells rows with one id apart, a mark sets null ids first. Keys travel with every place, so
    # both are left out where ids are unique and never null.
    one = docs["doc_id"].cast("long")
    mark = [] if docs.filter(docs["doc_id"].isNull()).isEmpty() else [one.isNotNull().cast("long").alias("z")]
    shared = not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    more = [F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("t")] if shared else []
    base, copies = _split_copies(docs.select(*mark, F.coalesce(one, F.lit(0)).alias("d"), *more, docs["text"]))
    at = len(base.columns) - 1
    gone = _with_places(base, repeated_windows(base, window, frequent_anchors(docs, window, sample)), ["start", "n"], "left")
    runs = n_words("text") - window + 1
    entry = lambda c: F.when(runs > 0, F.array(c.cast("long")))
    gone = gone.unionAll(copies.select("*", entry(F.lit(0)).alias("start"), entry(runs).alias("n")))

    keys, results = base.columns[:at], ["n_words", "n_removed", "kept_sha256", "kept"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            out = []
            for text, starts, ns in zip(part.column(at), part.column(at + 1), part.column(at + 2)):
                words = (text.as_py() or "").encode().split()
                if starts.is_valid:
                    removed, kept = without_repeats(words, np.asarray(starts.values), np.asarray(ns.values), window)
                else:
                    removed, kept = 0, b" ".join(words)
                out.append((len(words), removed, hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())[: 4 if texts else 3]
            columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*part.columns[:at], *columns], [*keys, *results[: len(columns)]])

    schema = _schema(keys, "n_words", "n_removed") + ", kept_sha256 string" + (", kept string" if texts else "")
    doc_id = F.when(F.col("z") == 1, F.col("d")) if mark else F.col("d")
    return gone.mapInArrow(finish, schema).select(doc_id.alias("doc_id"), *results[: 4 if texts else 3])
