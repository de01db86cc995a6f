"""Scores by a subword lattice: all segmentations of a text into the pieces of an existing vocabulary, summed in log space."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut_lineage

_START = "▁"
_FLOOR = math.log(1e-12)


@dataclass(frozen=True)
class Setting:
    vocabulary: str = "/opt/tokenizers/piece_bpe_32k.model"
    rounds: int = 2  # of re-estimating piece probabilities
    head: int = 262_144  # most frequent words, whose values every task keeps in memory; the rest is joined
    head_bytes: int = 32  # longer words are joined whatever their frequency, so the head has a size in bytes


def read_pieces(path: str) -> list[str]:
    """The vocabulary's pieces in order; at most some ten thousand. Byte pieces stand for what no other piece covers."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i)]


class Lattice:
    """Sums over the segmentations of many words at once, with natural log probabilities of the pieces.

    The words lie end to end in one array of code points, each behind a start mark and followed by one empty place. An
    arc leads from the place where a piece starts to the place behind it. Pieces are found by a trie, kept as sorted
    numbers of node and character.
    """

    def __init__(self, pieces: list[str], logs: np.ndarray):
        self.logs = np.asarray(logs, np.float64)
        self.bytes = {p: i for i, p in enumerate(pieces) if len(p) == 6 and p.startswith("<0x")}
        whole = {p: i for i, p in enumerate(pieces) if p not in self.bytes}
        node = {q: i for i, q in enumerate(sorted({p[:k] for p in whole for k in range(len(p) + 1)} | {""}, key=len))}
        edges = sorted((node[q[:-1]] << 21 | ord(q[-1]), i) for q, i in node.items() if q)
        self.edge = np.array([e for e, _ in edges], np.int64)
        self.child = np.array([i for _, i in edges], np.int64)
        self.piece = np.full(len(node), -1, np.int64)
        for p, i in whole.items():
            self.piece[node[p]] = i

    def _byte_ids(self, char: str) -> tuple[int, ...]:
        return tuple(self.bytes[f"<0x{b:02X}>"] for b in char.encode() if f"<0x{b:02X}>" in self.bytes)

    def _lay_out(self, words: list[str]) -> None:
        """Places and arcs of these words. Every character has the arc of its bytes besides those of pieces."""
        sizes = np.array([len(w) + 2 for w in words], np.int64)
        text = np.frombuffer("".join(f"{_START}{w}\0" for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
        self.end = np.cumsum(sizes) - 1
        self.first = self.end - sizes + 1
        self.place = np.arange(len(text)) - np.repeat(self.first, sizes)
        inside = np.ones(len(text), bool)
        inside[self.end] = False
        at = np.flatnonzero(inside)
        chars, char = np.unique(text[at], return_inverse=True)
        self.char_ids = [self._byte_ids(chr(c)) for c in chars]
        by_bytes = np.array([sum(self.logs[b] for b in ids) if ids else 3 * _FLOOR for ids in self.char_ids])
        # Kinds of arcs: pieces by number, then the characters.
        start, stop, kind, weight = [at], [at + 1], [len(self.logs) + char], [by_bytes[char]]
        node, size = np.zeros(len(at), np.int64), 0
        while len(at) and len(self.edge):
            key = node << 21 | text[at + size]
            edge = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            there = (self.edge[edge] == key) & inside[at + size]
            at, node, size = at[there], self.child[edge[there]], size + 1
            piece = self.piece[node]
            some = piece >= 0
            start.append(at[some])
            stop.append(at[some] + size)
            kind.append(piece[some])
            weight.append(self.logs[piece[some]])
        self.start, self.stop, self.kind, self.weight = (np.concatenate(x) for x in (start, stop, kind, weight))

    def _sums(self, source: np.ndarray, to: np.ndarray, level: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Log of the summed weights of all paths from `begin` to each place; all arcs of a level are taken together."""
        value = np.full(len(self.place), -math.inf)
        value[begin] = 0.0
        order = np.lexsort((to, level))
        source, to, level, weight = source[order], to[order], level[order], self.weight[order]
        heads = np.flatnonzero(np.diff(to, prepend=-1))
        own = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(to))))
        arcs = np.append(np.flatnonzero(np.diff(level, prepend=level[0] - 1)), len(level))
        for a, b in zip(arcs[:-1].tolist(), arcs[1:].tolist()):
            low, high = own[a], own[b - 1] + 1
            terms = value[source[a:b]] + weight[a:b]
            groups = heads[low:high] - a
            top = np.maximum.reduceat(terms, groups)
            value[to[heads[low:high]]] = top + np.log(np.add.reduceat(np.exp(terms - top[own[a:b] - low]), groups))
        return value

    def _forward(self) -> np.ndarray:
        return self._sums(self.start, self.stop, self.place[self.stop], self.first)

    def log_probability(self, word: str) -> float:
        return float(self.log_probabilities([word])[0])

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Of each word the log of its probability, summed over all its segmentations."""
        out = [np.empty(0)]
        for part in _portions(words):
            self._lay_out(part)
            out.append(self._forward()[self.end])
        return np.concatenate(out)

    def expected(self, words: list[str], uses: np.ndarray, counts: np.ndarray) -> None:
        """Adds the expected number of each piece in these words, each word counting `uses` times."""
        done = 0
        for part in _portions(words):
            self._lay_out(part)
            own = np.repeat(uses[done : done + len(part)], self.end - self.first + 1)
            done += len(part)
            alpha = self._forward()
            beta = self._sums(self.stop, self.start, -self.place[self.start], self.end)
            whole = np.repeat(alpha[self.end], self.end - self.first + 1)[self.start]
            share = own[self.start] * np.exp(alpha[self.start] + self.weight + beta[self.stop] - whole)
            found = np.bincount(self.kind, share, len(self.logs) + len(self.char_ids))
            counts += found[: len(self.logs)]
            for ids, n in zip(self.char_ids, found[len(self.logs) :]):
                for i in ids:
                    counts[i] += n


def _portions(words: list[str], characters: int = 100_000) -> Iterator[list[str]]:
    """Words in lists of about so many characters, in their order; only one longer than that makes a list larger."""
    part, size = [], 0
    for w in words:
        part.append(w)
        size += len(w) + 2
        if size >= characters:
            yield part
            part, size = [], 0
    if part:
        yield part


def _train(doc_id: Column) -> Column:
    return ~F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, uses): occurrences in training rows, and in all rows. Counted in tasks first, flushed at a bounded size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            words = list(both[0].keys() | both[1].keys())
            c = np.fromiter((both[1][w] for w in words), np.int64, len(words))
            uses = c + np.fromiter((both[0][w] for w in words), np.int64, len(words))
            both[0].clear()
            both[1].clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(c), pa.array(uses)], ["word", "c", "uses"])

        for part in chunks(batches):
            for train, text in zip(part.column(0), part.column(1)):
                both[train.as_py()].update((text.as_py() or "").encode().lower().split())
            if len(both[0]) + len(both[1]) > 400_000:
                yield flush()
        yield flush()

    rows = docs.select(_train(docs["doc_id"]).alias("train"), docs["text"]).mapInArrow(run, "word string, c bigint, uses bigint")
    return rows.groupBy("word").agg(F.sum("c").alias("c"), F.sum("uses").alias("uses"))


def fit_pieces(counts: DataFrame, setting: Setting) -> tuple[list[str], np.ndarray]:
    """Pieces and their log probabilities, from the words of the training rows.

    The pieces stay those of the vocabulary; a merge vocabulary's scores are only the order of its merges, so
    probabilities start from that order (the n-th piece gets a share of 1 / n) and are re-estimated from all
    segmentations of all training words, each distinct one worked out once and counted as often as it occurs. A round
    sends one row a piece and task.
    """
    pieces = read_pieces(setting.vocabulary)
    logs = -np.log(np.arange(1, len(pieces) + 1) + 10.0)
    logs -= np.log(np.exp(logs).sum())
    context = counts.sparkSession.sparkContext
    for _ in range(setting.rounds):
        shared = context.broadcast((pieces, logs))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice, found = Lattice(*shared.value), np.zeros(len(shared.value[0]))
            for part in chunks(batches, 4096):
                lattice.expected(part.column(0).to_pylist(), part.column(1).to_numpy().astype(np.float64), found)
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["piece", "n"])

        rows = counts.filter("c > 0").select("word", "c").mapInArrow(run, "piece bigint, n double").groupBy("piece").agg(F.sum("n")).collect()
        found = np.full(len(pieces), 0.01)
        for piece, n in rows:
            found[piece] += n
        logs = np.log(found / found.sum())
    return pieces, logs


def _head(valued: DataFrame, setting: Setting, floor: float) -> tuple:
    """The head's words and, for each, whether it is known, its base score and its log10 probability.

    Words of at most `head_bytes` bytes from some number of uses on: the least that leaves `head` words at most. That
    number is read off a table of at most some thousand rows, and the words come as Arrow columns, never as rows.
    """
    short = valued.filter(F.octet_length("word") <= setting.head_bytes)
    # Exact up to 1000 uses; beyond, in steps of a sixteenth.
    log = F.floor(16 * F.log2("uses"))
    step = F.when(F.col("uses") <= 1000, F.col("uses")).otherwise(F.lit(1000) + log - int(16 * math.log2(1000)))
    sizes = short.groupBy(step.cast("long").alias("step")).agg(F.count("*").alias("n"), F.min("uses").alias("least")).orderBy(F.desc("step")).collect()
    total, least = 0, None
    for r in sizes:
        total += r["n"]
        if total > setting.head:
            break
        least = r["least"]
    chosen = short.filter(F.col("uses") >= least) if least is not None else short.limit(0)
    rows = chosen.select(F.encode("word", "UTF-8").alias("word"), "c", "logp").toArrow()
    c = rows.column("c").to_numpy()
    return rows.column("word").combine_chunks(), (c > 0).astype(np.int64), np.log10((c + 0.1) / floor), rows.column("logp").to_numpy().astype(np.float64)


def score(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; scores are log10.

    `score` is the probability of the words and the end, each word's summed over all paths through its lattice: a
    training word is an arc of its own, with its count less a discount over all tokens, and the discounts' sum goes to
    the segmentations into pieces of the vocabulary. Each distinct word's sum is worked out once. The values of the `head`
    most frequent words go to every task, a fixed number of them and of bytes in each; words beyond are joined by word,
    partial sums first.

    Null texts are empty: one token, the end. Rows without id count as training rows. Repeated rows count and return
    each; an empty table gives an empty result; extra columns are ignored. Very long words cost time and memory in proportion.
    """
    counts = cut_lineage(word_counts(docs))
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1))).first()
    ends = docs.filter(_train(docs["doc_id"])).count()
    n, v = sums[0] + ends, sums[1] + (ends > 0)
    pieces, logs = fit_pieces(counts, setting)
    # Absolute discounting: what is taken from every seen token goes to the segmentations.
    discount = sums[2] / (sums[2] + 2 * sums[3]) if sums[2] and sums[3] else 0.5
    spared = discount * v / n if n else 1.0
    end = math.log10(max(ends - discount, 0) / n) if ends > discount else math.log10(0.5)
    floor = 0.1 * (v + 1) + n
    lattice = docs.sparkSession.sparkContext.broadcast((pieces, logs))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Lattice(*lattice.value)
        for part in chunks(batches, 4096):
            words = part.column(0).to_pylist()
            pieced = model.log_probabilities(words) + math.log(spared)
            whole = np.maximum(part.column(1).to_numpy().astype(np.float64) - discount, 0) / max(n, 1)
            logp = np.logaddexp(pieced, np.log(np.maximum(whole, 1e-300))) / math.log(10)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(logp, pa.float64())], ["word", "c", "uses", "logp"])

    valued = cut_lineage(counts.mapInArrow(values, "word string, c bigint, uses bigint, logp double"))
    table = docs.sparkSession.sparkContext.broadcast(_head(valued, setting, floor))
    head: list[tuple] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not head:  # once a worker
            words, *values = table.value
            head.append(({w.as_py(): i for i, w in enumerate(words)}, *values))
        known, seen, base, logp = head[0]
        for part in chunks(batches):
            rows, rare = [], []
            for text in part.column(1):
                words = (text.as_py() or "").encode().lower().split()
                at = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
                rare.append([{"word": w.decode(), "n": k} for w, k in Counter(words[i] for i in np.flatnonzero(at < 0)).items()])
                at = at[at >= 0]
                rows.append((len(words) + 1, int(seen[at].sum()), float(base[at].sum()), float(logp[at].sum())))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            columns = [pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)]
            columns.append(pa.array(rare, pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))))
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["row", "n_tokens", "n_known", "base_score", "score", "rare"])

    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("t")).alias("row"), "text")
    kind = keyed.schema["row"].dataType.simpleString()
    near = cut_lineage(keyed.mapInArrow(run, f"row {kind}, n_tokens bigint, n_known bigint, base_score double, score double, rare array<struct<word:string,n:bigint>>"))
    tail = near.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.n")
    # Rows equal in id and text are one here; their words are counted once each and the sums joined to every such row.
    tail = tail.join(valued.select("word", "c", "logp"), "word")
    value = F.log10((F.col("c") + 0.1) / F.lit(float(floor)))
    of_rows = tail.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * value).alias("b"), F.sum(F.col("n") * F.col("logp")).alias("s"), F.sum("n").alias("m")
    )
    counted = near.select("row", "n_tokens", "n_known", "base_score", "score", F.size("rare").alias("r"), F.aggregate("rare", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("own"))
    all_rows = counted.join(of_rows.withColumnRenamed("row", "other"), F.col("row").eqNullSafe(F.col("other")), "left")
    # m holds the words of all rows equal to this one, each with `own` of them.
    share = F.when(F.col("own") > 0, F.col("own") / F.col("m")).otherwise(0.0)
    extra = lambda c: F.coalesce(F.col(c) * share, F.lit(0.0))
    end_base = math.log10(((ends if ends else 0) + 0.1) / floor)
    return all_rows.select(
        F.col("row.doc_id").alias("doc_id"),
        (~_train(F.col("row.doc_id"))).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.round(extra("k")).cast("long") + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + extra("b") + end_base).alias("base_score"),
        (F.col("score") + extra("s") + end).alias("score"),
    )
