"""The text operators against brute force, SQL and planted cases, with nulls, empty and repeated rows and clashing columns."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
import xxhash
from compare import connect, differences
from pyspark.sql import functions as F

from rollbook.llm import decontaminate, licenses, lm, mixing, neardup, pii, quality, resample, rollups, substrings

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"word{i}" for i in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns named as results and internals are."""
    rows = [
        (1, PASSAGE, "en", "a", 5), (1, PASSAGE, "en", "a", 5), (2, PASSAGE + " and more", None, None, None), (None, PASSAGE, "en", "b", 1),
        (3, None, "en", "a", None), (4, "", "en", "a", 0), (5, " \t\n ", None, "b", 3), (6, "x " * 30_000, "en", "b", 60_000), (7, "+1 (743) 555-3824 " * 2000, "en", "c", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("size", "target", "taken", "kept", "fp", "d", "t", "h", "start", "m", "score", "row", "u", "draw", "place", "source_size", "posterior"):
        df = df.withColumn(c, F.lit(1))
    return df


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (None, "some other words that are never seen anywhere")], "item_id long, text string")


OPERATORS = {
    "mix": (mixing.mix, None), "substrings": (substrings.dedup_substrings, None), "licenses": (licenses.scan, 0), "pii": (pii.find, None), "quality": (quality.judge, None),
    "near": (neardup.near_duplicates, None),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(odd, name):
    run, rows = OPERATORS[name]
    assert run(odd).count() == (odd.count() if rows is None else rows)
    assert run(odd.limit(0)).count() == 0


def brute_measures(text):
    words = (text or "").encode().split()
    seen = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def test_quality_measures_and_verdicts(docs, odd, spark):
    for df in (docs, odd):
        want = collections.Counter((r.doc_id, *brute_measures(r.text)) for r in df.collect())
        got = quality.judge(df)
        assert collections.Counter(tuple(r) for r in got.select("doc_id", *quality.MEASURES).collect()) == want
    judged = quality.judge(docs).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("not base_failed")
    share = {r.quality: r.share for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] > 0.97 and share.get(0, 0) < 0.3
    assert quality.keep_good(docs).count() == quality.judge(docs).filter("kept").count()
    assert quality.keep_good(odd).columns == odd.columns


def test_mixing_gives_documents_chances_of_their_own(docs, monkeypatch):
    rows = mixing.mix(docs).collect()
    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    partial = 0
    for group in by_source.values():
        whole = min(2, int(group[0].target // group[0].source_size))
        need = group[0].target - whole * group[0].source_size
        # Chances times sizes make up the words that whole copies leave, and grow with the digits of the size.
        if whole < 2:
            assert sum(r.chance * r["size"] for r in group) == pytest.approx(need, rel=1e-9, abs=1e-6)
        steps = sorted({(len(bin(r["size"])) - 2, r.chance) for r in group})
        assert [c for _, c in steps] == sorted(c for _, c in steps) and len({b for b, _ in steps}) == len(steps)
        partial = max(partial, len({c for _, c in steps if 0 < c < 1}))
        # A document that is certain gets the further copy; none gets more than one.
        assert all(r.copies == whole + 1 for r in group if r.chance >= 1)
        assert all(whole <= r.copies <= whole + 1 for r in group)
        # Order sampling: taken are those of the least odds over inclusion odds.
        odds = {r: mixing_odds(r, docs) for r in group if 0 < r.chance < 1} if len(group) < 400 else {}
        taken = [o for r, o in odds.items() if r.copies > whole]
        assert not taken or max(taken) <= min([o for r, o in odds.items() if r.copies == whole], default=math.inf)
    assert partial > 1
    # A plan too large for every task is joined by key and salt: same rows.
    monkeypatch.setattr(mixing, "_PLAN_ROWS", 0)
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, rows))


_TEXTS = {}


def mixing_odds(row, docs):
    if not _TEXTS:
        _TEXTS.update({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    digest = hashlib.md5(f"mix:{row.doc_id}:{row.source or ''}:{_TEXTS[row.doc_id] or ''}".encode()).hexdigest()
    u = (int(digest[:13], 16) + 0.5) / 2**52
    return u / (1 - u) / (row.chance / (1 - row.chance))


def test_mixing_equals_sql_and_meets_targets(docs, odd):
    assert differences(mixing.mix(docs), connect(SF), mixing.MIX_SQL) == []
    rows = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("x"), F.max("size").alias("s"), F.max("source_size").alias("z")).collect()
    assert all(abs(r.t - r.x) <= r.s / 2 + 1 and r.x <= 2 * r.z for r in rows)
    assert mixing.mix(docs, materialise=True).count() == mixing.mix(docs).agg(F.sum("copies")).first()[0]
    assert mixing.mix(odd, materialise=True).columns == odd.columns


def test_personal_data(spark):
    texts = [
        (1, "write a.b+c@x-y.example.org now, host 10.0.0.255 or 10.0.0.256"), (2, "card 4111 1111 1111 1111 and 4111 1111 1111 1112"), (3, "call +1 (743) 555-3824 or phone 743-555-3824"),
        (4, "iban GB82WEST12345698765432 and GB82WEST12345698765431"), (5, "12.5 percent of 2024"), (6, "a@b.c+d@e.f"), (7, "9" * 40_000 + "@"),
    ]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1].spans == "email:6:27,ip:38:48" and (got[1].n_email, got[1].n_ip) == (1, 1)
    assert got[2].spans == "card:5:24" and got[2].base_sha256 == hashlib.sha256(b"card:5:24").hexdigest()
    assert got[3].spans == "phone:5:22,phone:32:44" and got[3].n_phone == 1
    assert got[4].spans == "iban:5:27"
    assert got[5].spans == got[7].spans == "" and got[6].spans == "email:0:5,email:5:11"
    hidden = pii.mask(spark.createDataFrame([(t, len(t)) for _, t in texts[:3]], "text string, n_chars int")).collect()
    assert hidden[0].text == "write [EMAIL] now, host [IP] or 10.0.0.256" and hidden[0].n_chars == len(hidden[0].text)
    assert hidden[1].text == "card [CARD] and 4111 1111 1111 1112"


def test_near_duplicates(docs, odd, spark):
    rows = [r for r in docs.collect()]
    prints = np.array([neardup.fingerprint(r.text) for r in rows], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    label = np.array([r.doc_id for r in rows])
    while True:
        new = np.array([label[near[i]].min() for i in range(len(rows))])
        if (new == label).all():
            break
        label = new
    got = {r.doc_id: r for r in neardup.near_duplicates(docs, tile=16).collect()}
    assert all(got[r.doc_id].component_id == c and got[r.doc_id].fingerprint == f"{int(p):016x}" for r, c, p in zip(rows, label, prints))
    assert neardup.fingerprint("A b C") == xxhash.xxh64_intdigest(b"a b c", 42)
    assert neardup.keep_one(docs).count() == len(set(label))
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 1").count() == 1


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    assert {r.root for r in neardup.components(edges).collect() if r.node < 100} == {0}


def brute_personal_data(text):
    """Numbers of base spans by kind and the hash of all, from plain patterns and checks."""
    import re

    def luhn(span):
        digits = [int(c) for c in span if c.isdigit()][::-1]
        return sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])

    def n_digits(span):
        return sum(c in "0123456789" for c in span)

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= n_digits(m) <= 19 and luhn(m) % 10 == 0),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= n_digits(m) <= 15),
    }
    found = [(k, m.start(), m.end()) for k, (p, holds) in kinds.items() for m in re.finditer(p, text or "") if holds(m.group())]
    counts = collections.Counter(k for k, _, _ in found)
    return (*[counts[k] for k in kinds], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest())


def test_personal_data_against_plain_patterns(spark, docs, odd):
    rng = np.random.default_rng(3)
    pieces = ["4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "1.2.3.4", "256.1.1.1", "a.b@c.d", "x@y", "\U0001F600", "é", " ", ".", "-", "+", "@", "7", "00", "(", "\n"]
    made = [(10**6 + i, "".join(rng.choice(pieces, rng.integers(0, 25)))) for i in range(600)]
    rows = docs.select("doc_id", "text").unionAll(spark.createDataFrame(made, "doc_id long, text string")).unionAll(odd.select("doc_id", "text"))
    want = collections.Counter((r.doc_id, *brute_personal_data(r.text)) for r in rows.collect())
    names = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert collections.Counter(tuple(r[c] for c in names) for r in pii.find(rows).collect()) == want


def brute_substrings(rows):
    """doc_id to number of words, words removed and hash of the kept ones, of rows with ids of their own."""
    seen, want = set(), {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        words, gone = (r.text or "").encode().split(), set()
        for i in range(len(words) - 19):
            key = tuple(words[i : i + 20])
            if key in seen:
                gone.update(range(i, i + 20))
            seen.add(key)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        want[r.doc_id] = (len(words), len(gone), hashlib.sha256(kept).hexdigest())
    return want


@pytest.mark.parametrize("sample", [0.0, 0.02, 1.0])
def test_substrings(docs, odd, sample):
    got = substrings.dedup_substrings(docs, sample=sample).collect()
    assert {r.doc_id: tuple(r)[1:4] for r in got} == brute_substrings(docs.collect())
    got = collections.Counter((r.doc_id, r.n_removed) for r in substrings.dedup_substrings(odd, sample=sample).collect())
    assert got[(1, 60)] == 2 and got[(None, 0)] == 1 and got[(2, 60)] == 1 and got[(6, 29_999)] == 1


@pytest.mark.parametrize("sample", [0.0, 1.0])
def test_substrings_of_a_hot_passage(spark, sample):
    """One passage in every other text, between words of their own or one repeated word."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        own = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, rng.integers(0, 30))) for _ in range(2)]
        middle = (PASSAGE, "same " * int(rng.integers(15, 60)), " ".join(PASSAGE.split()[7:]), own[0])[i % 4]
        rows.append((i, " ".join([own[0], middle, own[1], middle if i % 3 else ""])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    frequent = substrings.frequent_anchors(docs, 20, sample)
    assert len(frequent) <= 500 and bool(frequent) == bool(sample)
    got = substrings.dedup_substrings(docs, sample=sample).collect()
    assert {r.doc_id: tuple(r)[1:4] for r in got} == brute_substrings(docs.collect())


def test_decontamination(spark, docs, odd, items):
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, items).collect()}
    assert found == {(1, 1), (2, 1), (None, 1)}
    assert decontaminate.keep_clean(odd, items).count() == odd.count() - 4
    words = PASSAGE.split()
    edited = " ".join(w if i % 9 else "changed" for i, w in enumerate(words[:50]))
    planted = spark.createDataFrame([(10**6, "before " * 40 + edited + " after" * 40)], "doc_id long, text string")
    everything = docs.select("doc_id", "text").unionAll(planted)
    for setting in (decontaminate.Matching(), decontaminate.Matching(block_words=40)):
        assert {r.doc_id for r in decontaminate.contaminated(everything, items, setting).collect()} == {10**6}
    assert decontaminate.contaminated(odd, items.limit(0)).count() == 0


def test_license_lines_found_without_the_templates(spark):
    """Lines that speak of a license, found by a pattern of their own: nearly all must be reported, and few others."""
    import re

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    line = re.compile(r"\b(licen[sc]ed? under|under (the|a) .{0,60}licen[sc]e|licen[sc]e, version|spdx-license|permission is hereby granted)", re.I)
    want = {r.doc_id for r in docs.collect() if line.search(r.text or "")}
    got = {r.doc_id for r in licenses.scan(docs).collect()}
    assert len(want) > 30 and len(want & got) >= 0.9 * len(want) and len(got - want) <= 0.05 * len(got)
    assert licenses.Scan().found(0.4) > 0.999


@pytest.mark.parametrize("name, text", licenses.TEMPLATES)
def test_each_notice_is_told_from_the_others(name, text):
    index = licenses.Index(licenses.TEMPLATES, licenses.Scan())
    filler = " ".join(f"filler{i}" for i in range(37))
    for own in (text, f"{filler} {text} {filler}", f"{filler} {filler} {text.upper()}"):
        found = index.search([filler, own, None, ""])
        # A body that several licenses share may name the family; nothing else may be reported.
        assert name in {x[1] for x in found} or any(x[1].startswith(name) or name.startswith(x[1]) for x in found), found
        assert all(x[0] == 1 for x in found) and len(found) == 1, found


def test_license_versions_and_very_long_texts():
    index = licenses.Index(licenses.TEMPLATES, licenses.Scan())
    text = "This work is licensed under the GNU General Public License, version 2. " + "word " * 200_000 + "Licensed under CC BY-SA 4.0. Released under the MIT License."
    assert [(x[1], x[2]) for x in index.search([text])] == [("CC-BY-SA-4.0", 1.0), ("GPL-2.0", 1.0), ("MIT", 1.0)]


def test_long_items_short_items_and_ids_of_any_type(spark):
    long_item = " ".join(f"long{i}" for i in range(250))
    part = " ".join(f"long{i}" for i in range(80, 180))
    noise = " ".join(f"noise{i}" for i in range(40))
    rows = [(1, f"{noise} {part} {noise}"), (2, noise), (3, "we saw Quixotic zebras, there"), (4, "quixotic grey zebras"), (5, None), (6, ""), (7, " ".join(f"long{i}" for i in range(20)))]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    for kind in ("int", "bigint", "string", "smallint"):
        bench = spark.createDataFrame([(1, long_item), (2, "Quixotic zebras"), (3, "?!"), (4, None)], "item_id int, text string").withColumn("item_id", F.col("item_id").cast(kind))
        found = decontaminate.contaminated(docs, bench)
        assert found.schema["item_id"].dataType.simpleString() == kind
        assert sorted((r.doc_id, int(r.item_id)) for r in found.collect()) == [(1, 1), (3, 2)]
    one = {r.doc_id: (r.first_word, r.end_word) for r in found.collect()}
    assert one == {1: (40, 140), 3: (2, 4)}
    small = decontaminate.Matching(block_words=150)  # two blocks
    assert sorted(r.doc_id for r in decontaminate.keep_clean(docs, bench, small).collect()) == [2, 4, 5, 6, 7]


def test_lattice_scores(docs):
    got = {r.doc_id: r for r in lm.score(docs, lm.Setting(rounds=1)).collect()}
    small = {r.doc_id: r for r in lm.score(docs, lm.Setting(rounds=1, head=50)).collect()}
    count, ends = collections.Counter(), 0
    for r in docs.collect():
        if zlib.crc32(str(r.doc_id).encode()) % 10:
            count.update((r.text or "").encode().lower().split())
            ends += 1
    count[None] = ends
    n, v = sum(count.values()), len(count)
    for r in docs.collect():
        words = [*(r.text or "").encode().lower().split(), None]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        x = got[r.doc_id]
        assert math.isclose(x.base_score, base, rel_tol=1e-9) and (x.n_tokens, x.n_known, x.train_tokens) == (len(words), sum(count[w] > 0 for w in words), n)
        assert math.isclose(small[r.doc_id].score, x.score, rel_tol=1e-9) and small[r.doc_id].n_known == x.n_known


def test_lattice_sums_all_segmentations():
    pieces = ["▁", "a", "b", "▁a", "ab", "▁ab"]
    logs = np.log(np.array([0.1, 0.2, 0.3, 0.1, 0.2, 0.1]))
    # ▁ a b, ▁ ab, ▁a b, ▁ab; a character's byte arc adds next to nothing without byte pieces.
    assert math.isclose(math.exp(lm.Lattice(pieces, logs).log_probability("ab")), 0.1 * 0.2 * 0.3 + 0.1 * 0.2 + 0.1 * 0.3 + 0.1, rel_tol=1e-6)


def test_lattice_score_against_all_segmentations(spark, tmp_path):
    """The whole score, segmentations counted one by one: refit by token counts, discounts, the end."""
    setting = lm.Setting(rounds=1)
    rows = [(i, "ab abc ab x%d" % (i % 4)) for i in range(40)] + [(50, None), (None, "ab"), (51, "abcab cab"), (52, ""), (53, "long" * 30)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), setting).collect()
    pieces = lm.read_pieces(setting.vocabulary)
    number = {p: i for i, p in enumerate(pieces)}
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    count = collections.Counter(w for t in train for w in (t or "").split())
    start = -np.log(np.arange(1, len(pieces) + 1) + 10.0)
    start -= np.log(np.exp(start).sum())

    def ways(text, logs):
        """All segmentations of a marked word: lists of pieces and bytes."""
        if not text:
            return [((), 0.0)]
        found = [((number[text[:k]],), logs[number[text[:k]]], text[k:]) for k in range(1, len(text) + 1) if text[:k] in number and not (text[:k].startswith("<0x") and k == 6)]
        own = [number[f"<0x{b:02X}>"] for b in text[0].encode()]
        found.append((tuple(own), sum(logs[i] for i in own), text[1:]))
        return [(p + q, a + b) for p, a, rest in found for q, b in ways(rest, logs)]

    fresh = np.full(len(pieces), 0.01)
    for w, c in count.items():
        if len(w) > 20:
            lattice = lm.Lattice(pieces, start)
            lattice.expected([w], np.array([float(c)]), fresh)
            continue
        paths = ways("\u2581" + w, start)
        whole = sum(math.exp(a) for _, a in paths)
        for used, a in paths:
            for i in used:
                fresh[i] += c * math.exp(a) / whole
    logs = np.log(fresh / fresh.sum())
    n, v = sum(count.values()) + len(train), len(count) + 1
    ones, twos = (sum(c == k for c in count.values()) for k in (1, 2))
    discount = ones / (ones + 2 * twos) if ones and twos else 0.5
    for r, text in ((r, dict(rows)[r.doc_id]) for r in got):
        want = math.log10((len(train) - discount) / n)
        for w in (text or "").split():
            sums = lm.Lattice(pieces, logs).log_probability(w) if len(w) > 20 else math.log(sum(math.exp(a) for _, a in ways("\u2581" + w, logs)))
            want += math.log10(math.exp(sums) * discount * v / n + max(count[w] - discount, 0) / n)
        assert math.isclose(r.score, want, rel_tol=1e-6), (text, r.score, want)


def test_good_ids_are_bounded(spark):
    labels = spark.range(5000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert resample.good_ids(labels, 5000).count() == 5000 and 700 < resample.good_ids(labels, 1000).count() <= 1000


def test_token_counts_by_ranks_and_by_a_tokenizer_agree():
    texts = ["", "Hello  world\n\n's", "ÄÖ <|endoftext|> 123", "a" * 5000, "x y " * 3000]
    ranks, whole = (rollups.counter(f"/opt/tokenizers/byte_bpe_50k.{kind}") for kind in ("tiktoken", "json"))
    assert [ranks(t) for t in texts] == [whole(t) for t in texts]


def test_resampling(spark, docs, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = resample.resample(docs, labels)
    keys = sorted((r.key for r in got.collect()), reverse=True)
    want = math.ceil(0.75 * len(keys))
    assert got.filter("kept").count() == want and got.filter("kept").agg(F.min("key")).first()[0] == keys[want - 1]
    assert resample.resample(odd, labels.limit(0)).count() == odd.count() and resample.resample(odd.limit(0), labels).count() == 0


def test_rollups_commit_once(spark, docs, tmp_path):
    counts = rollups.count_tokens(docs, "/opt/tokenizers/byte_bpe_50k.json")
    rollup = rollups.Rollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().count() == 0
    assert rollup.commit(1, rollups.inserts(counts, "bpe")) and not rollup.commit(1, rollups.inserts(counts, "bpe"))
    total = rollup.totals().agg(F.sum("docs"), F.sum("tokens")).first()
    assert tuple(total) == (docs.count(), counts.agg(F.sum("tokens")).first()[0])
    few = counts.filter("words < 50")
    rollup.commit(2, rollups.revisions(few, few.withColumn("tokens", F.col("tokens") + 1), "bpe"))
    assert rollup.totals().agg(F.sum("tokens")).first()[0] == total[1] + few.count()
    rollup.commit(3, rollups.deletes(few.withColumn("tokens", F.col("tokens") + 1), "bpe"))
    assert rollup.totals().agg(F.sum("docs")).first()[0] == docs.count() - few.count()
    assert rollup.totals(upto=1).agg(F.sum("tokens")).first()[0] == total[1]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x, seed=42) for x in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_first_of_copies(rows):
    """Ids of the rows that are the least of their component, by comparing all pairs."""
    fingerprints = np.array([plain_fingerprint(r.text) for r in rows], np.uint64)
    least = [r.doc_id for r in rows]
    moved = True
    near = [np.flatnonzero(np.bitwise_count(fingerprints ^ f) <= 3) for f in fingerprints]
    while moved:
        new = [min(least[j] for j in near[i]) for i in range(len(rows))]
        moved, least = new != least, new
    return {r.doc_id for r, first in zip(rows, least) if r.doc_id == first}


def test_pipeline_rows_against_plain_versions(spark, tmp_path):
    """Each stage's whole output against a plain version of it, or, for alignments, against what must go and what must stay."""
    import corpus_pipeline
    import duckdb
    import re

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "benchmark decontamination", "PII", "mixing sources"]
    given = spark.read.parquet(f"{SF}/documents.parquet")
    tables, inputs = [given], [given.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], SF).write.parquet(f"{tmp_path}/{i}")
        tables.append(spark.read.parquet(f"{tmp_path}/{i}"))
        inputs.append(tables[-1].collect())
    start, good, single, clean, masked, mixed = inputs
    bag = lambda rows: collections.Counter(map(tuple, rows))

    verdicts = {r.doc_id: r.kept for r in quality.judge(given).collect()}
    assert bag(good) == bag([r for r in start if verdicts[r.doc_id]])
    for r in start:
        n_words, *_, again = brute_measures(r.text)
        if n_words < 20 or 100 * again > 30 * n_words:
            assert not verdicts[r.doc_id]

    first = plain_first_of_copies(good)
    assert bag(single) == bag([r for r in good if r.doc_id in first])

    plain = lambda text: re.findall(r"[a-z0-9]+", (text or "").lower())
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = [" " + " ".join(w) + " " for w in items if len(w) >= 10]
    runs = {tuple(w[i : i + 4]) for w in items for i in range(len(w) - 3)}
    left = {r.doc_id for r in clean}
    for r in single:
        words = plain(r.text)
        text = " " + " ".join(words) + " "
        if any(w in text for w in whole):
            assert r.doc_id not in left
        elif not any(tuple(words[i : i + 4]) in runs for i in range(len(words) - 3)):
            assert r.doc_id in left
    assert bag(clean) == bag([r for r in single if r.doc_id in left])

    assert sorted(r.doc_id for r in masked) == sorted(r.doc_id for r in clean)
    before = {r.doc_id: r for r in clean}
    for r in masked:
        old = before[r.doc_id]
        assert (r.source, r.lang) == (old.source, old.lang) and r.n_chars == len(r.text)
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text)
        # What is not masked is as it was, in order.
        rest = re.compile(".*?".join(re.escape(x) for x in re.split(r"\[[A-Z_]+\]", r.text)), re.S)
        assert r.text == old.text or rest.fullmatch(old.text)

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/3/*.parquet'")
    copies = dict(con.sql(f"SELECT doc_id, copies FROM ({mixing.MIX_SQL})").fetchall())
    want = collections.Counter()
    for r in masked:
        want[tuple(r)] += copies[r.doc_id]
    assert bag(mixed) == +want and max(copies.values()) <= 2
    result = corpus_pipeline.run(spark, SF)
    assert result.columns == given.columns and bag(result.collect()) == bag(mixed)


def test_many_words_are_summed_as_one_is():
    pieces = ["▁", "a", "b", "ab", "▁a", "<0x61>", "<0xC3>", "<0xA9>"]
    logs = np.log(np.arange(1, 9) / 36)
    words = ["ab", "", "abba" * 40, "éa", "a\0b", "b"] * 50
    lattice = lm.Lattice(pieces, logs)
    many, counts, one_by_one = lattice.log_probabilities(words), np.zeros(8), np.zeros(8)
    assert np.allclose(many, [lattice.log_probability(w) for w in words], rtol=1e-12)
    uses = np.arange(1.0, len(words) + 1)
    lattice.expected(words, uses, counts)
    for w, n in zip(words, uses):
        for _ in range(int(n) % 3):
            lattice.expected([w], np.ones(1), one_by_one)
        lattice.expected([w], np.array([n - int(n) % 3]), one_by_one)
    assert np.allclose(counts, one_by_one, rtol=1e-9)
    counts[:] = 0
    lattice.expected(["a"], np.ones(1), counts)
    # Paths: mark and a, mark and byte 61, and both in one piece; the mark's own bytes are not all pieces.
    assert math.isclose(counts[4] + counts[1] + counts[5], 1.0, rel_tol=1e-9) and counts[2] == 0


def test_copies_null_ids_and_shared_ids_in_substring_dedup(spark):
    tail = " ".join(f"tail{i}" for i in range(25))
    rows = [(5, PASSAGE), (None, PASSAGE), (7, PASSAGE + " " + tail), (8, tail), (8, "other " + tail), (9, "few words"), (10, "few words"), (11, PASSAGE), (12, None), (13, "")]
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed) for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    fixed = [(5, 60, 60), (None, 60, 0), (7, 85, 60), (8, 25, 25), (8, 26, 25), (9, 2, 0), (10, 2, 0), (11, 60, 60), (12, 0, 0), (13, 0, 0)]
    assert got == collections.Counter(fixed)


def test_texts_under_one_id_are_documents_of_their_own(spark):
    one, two = (" ".join(f"{w}{i}" for i in range(50)) for w in ("red", "blue"))
    rows = [(1, one), (1, two), (1, two), (2, two), (3, one), (None, one), (None, "alone here"), (None, "alone here"), (4, None), (5, ""), (1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("__id", "fp", "row", "root", "__text", "none")})
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, one), (1, two), (None, "alone here"), (1, "")], key=str)
    strings = neardup.keep_one(df.withColumn("doc_id", F.col("doc_id").cast("string")))
    assert strings.count() == 4
    assert neardup.keep_one(df.limit(0)).count() == 0
