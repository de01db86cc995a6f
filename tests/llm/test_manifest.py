"""The manifest against a plain version, over several storeys, with nulls, repeated rows and clashing columns."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from rollbook.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, low=False):
    out = ""
    for c in ("doc_id", "source", "lang", "n_chars", "text"):
        x = row[c]
        if x is not None and c == "text" and low:
            x = "".join(chr(ord(k) + 32) if "A" <= k <= "Z" else k for k in x)
        out += "-" if x is None else f"{len(str(x).encode())}:{x}"
    return h(out)


def tree(nodes):
    """Levels from the nodes to the top."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def fold(levels, at, digest):
    siblings = ""
    for level in levels[:-1]:
        run = level[at // 16 * 16 : at // 16 * 16 + 16]
        left, right = run[: at % 16], run[at % 16 + 1 :]
        siblings += "".join(left + right)
        digest = h("".join(left) + digest + "".join(right))
        at //= 16
    return digest, siblings


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in by[s]])
    upper = tree([trees[s][-1][0] for s in order])
    root, out = upper[-1][0], []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            digest, siblings = fold(trees[s], i, leaf(r, tampered))
            folded, more = fold(upper, k, digest)
            out.append((r["doc_id"], leaf(r), trees[s][-1][0], root, h(siblings + more), folded, folded == root))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("idx", "n", "leaf", "digest", "part", "nodes", "way", "changed", "root", "__range"):
        df = df.withColumn(c, F.lit("x"))
    found = manifest.manifest(df, manifest.tampered_fifth(df["doc_id"]))
    assert sorted(map(tuple, found.collect()), key=str) == brute([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows])


def test_nulls_ties_and_repeated_rows(spark):
    check(spark, [
        (1, "Some Text", "en", "a", 9), (1, "Some Text", "en", "a", 9), (1, "another", None, "a", None), (None, None, None, None, None), (None, "X", "en", "b", 1),
        (5, "", "en", "", 0), (15, "Ä" * 50_000 + "B", "de", "ß", 50_001), (20, None, "en", "a", 0), (6, "-", "-", "-", 1), (7, "1:2", "3:4", "a", 5),
    ])


@pytest.mark.parametrize("sizes", [[1], [16], [17], [1, 256, 257], [2] * 18, [5000, 1, 300]])
def test_heights(spark, sizes):
    check(spark, [(1000 * k + i, f"Text {i}", "en", f"s{k}", i) for k, n in enumerate(sizes) for i in range(n)])


def test_many_sources(spark):
    check(spark, [(i, "T", "en", f"s{i}", 1) for i in range(300)])


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert manifest.manifest(empty).count() == 0


def test_untampered_rows_are_verified(spark):
    df = spark.createDataFrame([(i, f"T{i}", "en", "ab"[i % 2], i) for i in range(100)], SCHEMA)
    assert manifest.manifest(df).filter("verified").count() == 100


def test_states_are_resumed():
    children = [h(str(i)) for i in range(16)]
    parent = manifest.Parent(children)
    assert parent.digest == h("".join(children))
    for slot in range(16):
        left, right = parent.way(slot)
        assert manifest.resume(parent.states[slot], h("new"), right) == h(left + h("new") + right)
