"""Near-duplicates by SimHash fingerprints, compared exactly in tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut_lineage, fresh

#: Fingerprints in a tile at most, about; two tiles and their comparison take few MB.
TILE = 16_384


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of a text's word shingles, A-Z lower-cased: a bit is set if over half the shingle hashes have it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(line, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(sizes + 1) - 1
    starts = (stops - sizes).tolist()
    hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts, stops[shingle - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fingerprint (a signed long, `fp`) of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            found = np.array([fingerprint(t.as_py(), shingle) for t in part.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def spanning_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all of a (and b) within the radius; b None: a with itself. Enough links to keep what is connected connected.

    Every pair is compared, by exclusive-or and bit count; of the links found, those between fingerprints that are
    connected already go, so a large group of near copies leaves one link a member and not one a pair.
    """
    nodes, shift = (a, 0) if b is None else (np.concatenate([a, b]), len(a))
    other = a if b is None else b
    label = np.arange(len(nodes))
    rows = max(1, 131_072 // max(1, len(other)))
    for top in range(0, len(a), rows):
        near = np.bitwise_count(a[top : top + rows, None] ^ other[None, :]) <= radius
        if b is None:
            near &= np.arange(len(a))[None, :] > np.arange(top, min(top + rows, len(a)))[:, None]
        for i in np.flatnonzero(near.any(1)):
            roots = np.unique(np.append(label[np.flatnonzero(near[i]) + shift], label[top + i]))
            if len(roots) > 1:
                label[np.isin(label, roots)] = roots[0]
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def _tiles(prints: DataFrame, tile: int) -> DataFrame:
    """Fingerprints in tiles of equal bit counts of the low and the high half: low, high, part, fps."""
    halves = prints.select(
        "fp", F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.bit_count(F.shiftrightunsigned("fp", 32)).alias("high")
    )
    # At most 33 x 33 rows, whatever the number of fingerprints.
    parts = halves.groupBy("low", "high").agg(F.ceil(F.count("*") / tile).alias("parts"))
    dealt = halves.join(F.broadcast(parts), ["low", "high"]).withColumn("part", F.pmod(F.xxhash64("fp"), "parts"))
    return dealt.groupBy("low", "high", "part").agg(F.collect_list("fp").alias("fps"))


def links(prints: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Links (u, v) between distinct fingerprints within `radius` bits, thinned to those that keep groups connected.

    Two fingerprints within the radius differ by no more than it in the bit counts of their two halves together; tile
    pairs beyond that are never made. All others are compared in full, so the result is exact. The work grows with the
    square of the number of distinct fingerprints, about an eighth of all pairs being left for a radius of 3.
    """
    tiles = cut_lineage(_tiles(prints, tile))
    name = lambda side: [F.col(c).alias(f"{side}_{c}") for c in ("low", "high", "part")]
    steps = [(x, y) for x in range(-radius, radius + 1) for y in range(-radius, radius + 1) if abs(x) + abs(y) <= radius and (x, y) >= (0, 0)]
    step = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps]))
    left = tiles.select(*name("a"), step.alias("s")).select("*", (F.col("a_low") + F.col("s.x")).alias("b_low"), (F.col("a_high") + F.col("s.y")).alias("b_high"))
    pairs = left.join(tiles.select(*name("b")), ["b_low", "b_high"]).filter(
        (F.col("a_low") != F.col("b_low")) | (F.col("a_high") != F.col("b_high")) | (F.col("a_part") <= F.col("b_part"))
    )
    of = lambda side: [f"{side}_low", f"{side}_high", f"{side}_part"]
    full = pairs.join(tiles.select(*name("a"), F.col("fps").alias("a")), of("a")).join(tiles.select(*name("b"), F.col("fps").alias("b")), of("b"))
    same = F.lit(True)
    for c in ("low", "high", "part"):
        same = same & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    count = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = full.select("a", F.when(~same, F.col("b")).alias("b")).repartition(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1)):
                x = np.asarray(a.values, np.int64).view(np.uint64)
                y = np.asarray(b.values, np.int64).view(np.uint64) if b.is_valid else None
                u, v = spanning_links(x, y, radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return spread.mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of `edges` (u, v): root is the smallest node reachable, and a node's own row is left out.

    Alternating stars: nodes hand their larger, then their smaller neighbours to the smallest they know, until nothing
    changes; a logarithmic number of rounds in practice. Each round is written to the checkpoint folder.
    """
    edges = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.union(smallest).distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def _roots(prints: DataFrame, radius: int, tile: int) -> DataFrame:
    """(fp, root) of all fingerprints: `root` names the group that links of at most `radius` bits reach."""
    distinct = cut_lineage(prints.select("fp").distinct())
    roots = components(links(distinct, radius, tile))
    return cut_lineage(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links of at most `radius` bits) of each row.

    Null and empty texts have fingerprint zero, which links like any other. Repeated rows all return; rows without id
    too, with the smallest id of their group, null if there is none. An empty table gives an empty result; extra columns
    are ignored. A very long text is hashed in one task, in parts. Copies share a fingerprint and meet only in counts
    and minima, however many there are.
    """
    prints = cut_lineage(fingerprints(docs, shingle))
    grouped = _roots(prints, radius, tile)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    ids = grouped.join(least, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(ids, "root").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 3, tile: int = TILE) -> DataFrame:
    """One row of each group, all columns as they are: the one with the least (doc_id, hash of its text), without id last.

    Rows that share an id but not a text are documents of their own: each belongs to the group of its text. Of rows equal
    in id and text one stays. Null and empty texts are one group. The choice is made on ids and hashes; whole rows are
    moved once, copies having met before that. An empty table gives an empty result.
    """
    names = {c: fresh(docs, f"__{c}") for c in ("id", "none", "text")}
    of_type = docs.schema["doc_id"].dataType
    keys = {
        names["none"]: docs["doc_id"].isNull(), names["id"]: F.coalesce(docs["doc_id"], F.lit("" if of_type.simpleString() == "string" else 0).cast(of_type)),
        names["text"]: F.xxhash64("text"),
    }
    order = list(keys)
    keyed = docs.withColumns(keys)
    row = F.struct(*[F.col(c).alias(k) for c, k in zip(order, ("none", "id", "text"))])
    prints = cut_lineage(fingerprints(keyed.select(row.alias("doc_id"), "text"), shingle).withColumnRenamed("doc_id", "row"))
    least = prints.groupBy("fp").agg(F.min("row").alias("row"))
    first = _roots(prints, radius, tile).join(least, "fp").groupBy("root").agg(F.min("row").alias("row"))
    chosen = cut_lineage(first.select(*[F.col(f"row.{k}").alias(c) for c, k in zip(order, ("none", "id", "text"))]))
    return keyed.dropDuplicates(order).join(chosen, order, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
