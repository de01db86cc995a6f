"""A Merkle manifest of a table: a tree of SHA-256 digests per source, whose parents keep copied hash states."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

#: Columns of a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 16
#: Levels that one task builds and folds at a time: FAN ** LEVELS nodes lie in one group at most.
LEVELS = 2
GROUP = FAN**LEVELS
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: One level of the way from a node to the root: digests left and right of it in its run, end to end as hex text.
_WAY = "array<struct<left:string,right:string>>"


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256, in hex, of `-` for a null and else of byte count, `:` and value, one after the other."""
    parts = []
    for column in columns:
        value = column.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _ranked(leaves: DataFrame) -> DataFrame:
    """`leaves` with `idx`, the place of each row among those of its source by doc_id and leaf, and `n`, how many those are.

    Rows are cut into ranges of (source, doc_id, leaf), so a source with most of the rows lies in many; rows count
    within ranges, and one small row a range and source tells where each starts.
    """
    order = [F.col("source"), F.col("doc_id"), F.col("leaf")]
    placed = cut_lineage(leaves.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    counts = placed.groupBy("__range", "source").agg(F.count("*").alias("__n"))
    # A source has a row for each range that it touches: as many as there are partitions, at most.
    earlier = Window.partitionBy("source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        F.col("__range").alias("__r"), F.col("source").alias("__s"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"), F.sum("__n").over(Window.partitionBy("source")).alias("n"),
    )
    inside = Window.partitionBy("__range", "source").orderBy("doc_id", "leaf")
    numbered = placed.withColumn("__at", F.row_number().over(inside) - 1)
    joined = numbered.join(bases, (F.col("__range") == F.col("__r")) & F.col("source").eqNullSafe(F.col("__s")))
    return joined.select(*leaves.columns, (F.col("__base") + F.col("__at")).alias("idx"), "n")


class Parent:
    """A parent over a run of children. It keeps a copy of its hash state before each child's slot, so a changed child
    costs the digests of what stands right of it, and nothing left of it is hashed again."""

    __slots__ = ("children", "states", "digest")

    def __init__(self, children: Sequence[str]):
        state, self.children, self.states = hashlib.sha256(), children, []
        for child in children:
            self.states.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def way(self, slot: int) -> tuple[str, str]:
        return "".join(self.children[:slot]), "".join(self.children[slot + 1 :])


def resume(state, child: str, right: str) -> str:
    """The digest of a parent whose child is replaced, from the state before that child's slot."""
    state = state.copy()
    state.update(child.encode())
    state.update(right.encode())
    return state.hexdigest()


class Group:
    """Up to `GROUP` consecutive nodes and the levels above them: `LEVELS` of them, or, if these are all nodes that there
    are, as many as lead to one node (none for a lone one)."""

    def __init__(self, nodes: Sequence[str], alone: bool):
        self.levels: list[list[Parent]] = []
        self.top = list(nodes)
        while len(self.top) > 1 if alone else len(self.levels) < LEVELS:
            self.levels.append([Parent(self.top[i : i + FAN]) for i in range(0, len(self.top), FAN)])
            self.top = [p.digest for p in self.levels[-1]]

    def steps(self, at: int) -> list[tuple[Parent, int]]:
        """Parent and slot at each level above node `at`."""
        found = []
        for parents in self.levels:
            at, slot = divmod(at, FAN)
            found.append((parents[at], slot))
        return found


def _groups(nodes: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Rows (keys.., idx, n, digest, extra..) as groups of at most `GROUP` consecutive ones: keys.., part, n, nodes."""
    part = F.floor(F.col("idx") / GROUP).cast("long")
    return nodes.groupBy(*keys, part.alias("part"), "n").agg(F.sort_array(F.collect_list(F.struct("idx", "digest", *extra))).alias("nodes"))


def _next_storey(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The node on top of each group, as the next storey's rows: keys.., idx, n, digest."""
    kinds = [f"{k} {groups.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = []
            for n, nodes in zip(batch.column("n").to_pylist(), batch.column("nodes").to_pylist()):
                tops.append(Group([x["digest"] for x in nodes], n <= GROUP).top[0])
            columns = [batch.column(k) for k in keys] + [batch.column("part"), batch.column("n"), pa.array(tops, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "idx", "n", "digest"])

    tops = groups.mapInArrow(run, ", ".join([*kinds, "idx bigint, n bigint, digest string"]))
    return tops.withColumn("n", F.ceil(F.col("n") / GROUP).cast("long"))


def _ways(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each node of `groups` (with `way`, the way from the group's top node) its own way: keys.., idx, digest, way."""
    kinds = [f"{k} {groups.schema[k].dataType.simpleString()}" for k in keys]
    way_type = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                nodes, above = one.column("nodes")[0].as_py(), one.column("way")[0].as_py()
                group = Group([x["digest"] for x in nodes], one.column("n")[0].as_py() <= GROUP)
                ways = [[dict(zip(("left", "right"), p.way(slot))) for p, slot in group.steps(i)] + above for i in range(len(nodes))]
                own = [pa.array([one.column(k)[0].as_py()] * len(nodes), one.column(k).type) for k in keys]
                columns = [*own, pa.array([x["idx"] for x in nodes], pa.int64()), pa.array([x["digest"] for x in nodes], pa.string()), pa.array(ways, way_type)]
                yield pa.RecordBatch.from_arrays(columns, [*keys, "idx", "digest", "way"])

    return groups.mapInArrow(run, ", ".join([*kinds, f"idx bigint, digest string, way {_WAY}"]))


def _tree(nodes: DataFrame, keys: Sequence[str]) -> tuple[list[DataFrame], DataFrame]:
    """Storeys of groups over `nodes` (keys.., idx, n, digest), the lowest first, and one top node for each key.

    Each storey has `GROUP` times fewer nodes than the one below and is written before the next reads it.
    """
    storeys = []
    while True:
        groups = cut_lineage(_groups(nodes, keys))
        storeys.append(groups)
        nodes = cut_lineage(_next_storey(groups, keys))
        if nodes.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0] <= 1:
            return storeys, nodes


def _same(keys: Sequence[str]) -> Column:
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return match


def _with_way(groups: DataFrame, ways: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups with the way and digest (`top`) of their top node, which the storey above has."""
    there = ways.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("idx").alias("__idx"), F.col("digest").alias("top"), "way")
    return groups.join(there, _same(keys) & (F.col("part") == F.col("__idx"))).select(*groups.columns, "top", "way")


def _down(storeys: Sequence[DataFrame], ways: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The lowest storey's groups with their ways, from the ways of the top nodes."""
    for groups in reversed(storeys[1:]):
        ways = cut_lineage(_ways(_with_way(groups, ways, keys), keys))
    return _with_way(storeys[0], ways, keys)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """The manifest tree of `docs`, and a proof folded for every row.

    Returns doc_id, leaf, subroot (of the row's source), root, proof_sha256, folded_root and verified of each row. A leaf
    is the digest of the row's columns. Leaves of a source ascend by doc_id (null first, ties by leaf); while more than
    one node remains, every 16 consecutive ones become their digest. Subroots, ordered by source (null first, bytewise),
    make the root in the same way. `folded_root` is made anew from the row's leaf, or the leaf with A-Z of the text
    lower-cased where `tampered` holds, and from the siblings on its way; `verified` is whether it equals the root.

    How: rows get their place in their source by ranges. Groups of 256 nodes build two levels in a task and hand one
    node up, storey by storey, until each source has one; the same is done over the sources. Ways (the siblings at each
    level up to the root) come down again, one for each group, so rows are shuffled three times in narrow form however
    high the tree is. In a task each parent keeps a copy of its hash state before each child; folding a row resumes
    those with the replacement and the digests right of it only.

    Nulls in any column have a digest of their own (`-`), as have empty and very long texts; only one text per task is in
    memory as a whole. Repeated rows are leaves of their own and each return. An empty table gives an empty result. Extra
    columns are ignored.
    """
    own = [docs[c] for c in COLUMNS]
    changed = [*own[:-1], F.translate(docs["text"], _UPPER, _LOWER)]
    tampered = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    leaves = docs.select(
        docs["doc_id"], docs["source"].cast("string").alias("source"), F.unhex(leaf_digest(own)).alias("leaf"),
        F.when(tampered, F.unhex(leaf_digest(changed))).alias("changed"),
    )
    rows = _ranked(leaves).select(
        "source", "idx", "n", F.lower(F.hex("leaf")).alias("digest"), "doc_id", F.lower(F.hex("changed")).alias("changed")
    )
    lowest = cut_lineage(_groups(rows, ["source"], ["doc_id", "changed"]))
    if not lowest.limit(1).count():
        return _empty(docs)
    storeys, subroots = [lowest], cut_lineage(_next_storey(lowest, ["source"]))
    if subroots.agg(F.max("n")).first()[0] > 1:
        more, subroots = _tree(subroots, ["source"])
        storeys += more
    # The sources are the leaves of the tree above: ranked like rows, as one group of their own.
    over = subroots.select(F.lit(0).alias("source"), F.col("source").alias("doc_id"), F.col("digest").alias("leaf"))
    of_source = cut_lineage(_ranked(over).select(F.col("source").alias("all"), "idx", "n", F.col("leaf").alias("digest"), F.col("doc_id").alias("source")))
    upper, tops = _tree(of_source.drop("source"), ["all"])
    root = tops.first()["digest"]
    start = tops.select("all", F.lit(0).cast("long").alias("idx"), "digest", F.array().cast(_WAY).alias("way"))
    ways = _ways(_down(upper, start, ["all"]), ["all"])
    named = of_source.select("source", F.col("idx").alias("__i"))
    ways = cut_lineage(ways.join(named, F.col("idx") == F.col("__i")).select("source", F.lit(0).cast("long").alias("idx"), "digest", "way"))
    # Ways of subroots are remembered, for the subroot's digest goes with each row.
    top = ways.select(F.col("source").alias("__source"), F.col("digest").alias("subroot"))
    folded = _down(storeys, ways, ["source"])
    whole = folded.join(top, _same(["source"]))
    return _fold(whole.select("n", "nodes", "way", "subroot"), root, docs.schema["doc_id"].dataType.simpleString())


def _schema(kind: str) -> str:
    return f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _empty(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.createDataFrame([], _schema(docs.schema["doc_id"].dataType.simpleString()))


def _fold(groups: DataFrame, root: str, kind: str) -> DataFrame:
    """Each row's proof and folded root, a group at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                nodes, subroot = one.column("nodes")[0].values, one.column("subroot")[0].as_py()
                leaves, changed = nodes.field("digest").to_pylist(), nodes.field("changed").to_pylist()
                group = Group(leaves, one.column("n")[0].as_py() <= GROUP)
                # What stands above the group is common to its rows: the state before its slot is made once a level.
                above = [(hashlib.sha256(x["left"].encode()), x["right"], (x["left"] + x["right"]).encode()) for x in one.column("way")[0].as_py()]
                rest = b"".join(x[2] for x in above)
                proofs, roots = [], []
                for i, (leaf, other) in enumerate(zip(leaves, changed)):
                    digest, proof = leaf if other is None else other, hashlib.sha256()
                    for parent, slot in group.steps(i):
                        left, right = parent.way(slot)
                        proof.update(left.encode())
                        proof.update(right.encode())
                        digest = resume(parent.states[slot], digest, right)
                    for state, right, _ in above:
                        digest = resume(state, digest, right)
                    proof.update(rest)
                    proofs.append(proof.hexdigest())
                    roots.append(digest)
                names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
                texts = [pa.array(x, pa.string()) for x in (leaves, [subroot] * len(leaves), [root] * len(leaves), proofs, roots)]
                yield pa.RecordBatch.from_arrays([nodes.field("doc_id"), *texts, pa.array([x == root for x in roots], pa.bool_())], names)

    return groups.mapInArrow(run, _schema(kind))


def tampered_fifth(doc_id: Column) -> Column:
    """Rows whose unsigned CRC-32 of the decimal doc_id is divisible by 5."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


#: The same in DuckDB's SQL: CRC-32 bit by bit, the tree level by level.
MANIFEST_SQL = """
WITH RECURSIVE typed AS (
  SELECT doc_id, source, lang, n_chars, text,
         list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
           lambda a, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[],
             lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(a, b)), 4294967295::BIGINT) AS crc
  FROM documents
),
both_texts AS (
  SELECT *, coalesce((4294967295 - crc) % 5 = 0, FALSE) AS tampered,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM typed
),
hashed AS (
  SELECT doc_id, source, sha256(fixed || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN tampered THEN sha256(fixed || coalesce(strlen(low) || ':' || low, '-')) END AS changed
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
          || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS fixed FROM both_texts)
),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM hashed
),
low_tree AS (
  SELECT source, 0 AS level, idx, n, leaf AS h FROM leaves
  UNION ALL
  SELECT source, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM low_tree WHERE n > 1
  GROUP BY source, level, idx // 16, n
),
subroots AS (
  SELECT source, h, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM low_tree WHERE n = 1
),
high_tree AS (
  SELECT 0 AS level, idx, n, h FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM high_tree WHERE n > 1 GROUP BY level, idx // 16, n
),
top AS (SELECT h AS root FROM high_tree WHERE n = 1),
low_runs AS (SELECT source, level, idx // 16 AS run, list(h ORDER BY idx) AS hs FROM low_tree WHERE n > 1 GROUP BY ALL),
high_runs AS (SELECT level, idx // 16 AS run, list(h ORDER BY idx) AS hs FROM high_tree WHERE n > 1 GROUP BY ALL),
low_fold AS (
  SELECT row_number() OVER () AS r, doc_id, source, leaf, 0 AS level, idx, coalesce(changed, leaf) AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT r, doc_id, f.source, leaf, f.level + 1, idx // 16,
         sha256(array_to_string(hs[:idx % 16], '') || h || array_to_string(hs[idx % 16 + 2:], '')),
         proof || array_to_string(hs[:idx % 16], '') || array_to_string(hs[idx % 16 + 2:], '')
  FROM low_fold f JOIN low_runs t ON t.source IS NOT DISTINCT FROM f.source AND t.level = f.level AND t.run = idx // 16
),
high_fold AS (
  SELECT r, doc_id, leaf, s.h AS subroot, 0 AS level, s.idx, f.h, proof
  FROM low_fold f JOIN subroots s ON s.source IS NOT DISTINCT FROM f.source AND s.height = f.level
  UNION ALL
  SELECT r, doc_id, leaf, subroot, f.level + 1, idx // 16,
         sha256(array_to_string(hs[:idx % 16], '') || h || array_to_string(hs[idx % 16 + 2:], '')),
         proof || array_to_string(hs[:idx % 16], '') || array_to_string(hs[idx % 16 + 2:], '')
  FROM high_fold f JOIN high_runs t ON t.level = f.level AND t.run = idx // 16
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM high_fold, top WHERE level = (SELECT max(level) FROM high_tree)"""
