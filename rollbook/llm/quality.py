"""Quality rules by weak supervision, in DataFrame expressions only.

Rules vote good or bad or abstain; expectation-maximisation estimates how reliable each is; the posterior decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, let, word_list

_WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hash; sorting (hash, position) brings equal ones together, so it is n log n.
    """
    def covered(hashes: Column) -> Column:
        tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(z: Column) -> Column:
            return F.filter(
                F.transform(z, lambda s, k: F.when((F.get(z, k - 1)["h"] == s["h"]) | (F.get(z, k + 1)["h"] == s["h"]), s["i"])),
                lambda p: p.isNotNull(),
            )

        def total(ps: Column) -> Column:
            steps = F.transform(ps, lambda p, k: F.least(F.lit(_WINDOW), F.coalesce(F.get(ps, k + 1) - p, F.lit(_WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(tagged, lambda z: let(F.sort_array(positions(z)), total))

    def of(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered(hashes))

    # Eight words as four pairs: two hashes a word, where a slice for each window would copy eight words.
    pairs = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1)))
    eights = let(pairs, lambda p: F.transform(p, lambda x, i: F.xxhash64(x, F.get(p, i + 2), F.get(p, i + 4), F.get(p, i + 6))))
    hashes = F.slice(eights, F.lit(1), F.size(words) - (_WINDOW - 1))
    return F.when(F.size(words) > _WINDOW, let(hashes, of)).otherwise(F.lit(0).cast("long"))


def measures(text: Column) -> Column:
    """A struct of whole-text measures; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def lines(ls: Column) -> Column:
        return (F.size(ls) - F.size(F.array_distinct(ls))).cast("long")

    def counts(marks: Column) -> Column:
        # One scan for three counts; nearly all texts have few such places.
        first = F.transform(marks, lambda x: F.substring(x, 1, 1))
        return let(
            F.size(F.filter(first, lambda x: x.isin("!", "?"))),
            lambda n: F.struct(
                F.size(F.filter(first, lambda x: x.rlike("[#*$%&|<>]"))).cast("long").alias("n_symbols"),
                n.cast("long").alias("n_marks"),
                F.size(F.filter(first, lambda x: x.rlike(r"\p{Lu}"))).cast("long").alias("n_upper"),
            ),
        )

    with_word = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    places = F.regexp_extract_all(text, F.lit(r"[#*$%&|<>!?]|\p{Lu}{3,}"), F.lit(0))
    return let(
        F.struct(word_list(text).alias("w"), let(places, counts).alias("c")),
        lambda x: let(x["w"], lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            x["c"]["n_symbols"].alias("n_symbols"),
            F.when(F.instr(text, "\n") > 0, let(with_word, lines)).otherwise(F.lit(0).cast("long")).alias("n_dup_lines"),
            _repeated(w).alias("n_repeat_words"),
            x["c"]["n_upper"].alias("n_upper"),
            x["c"]["n_marks"].alias("n_marks"),
        )),
    )


@dataclass(frozen=True)
class Rules:
    """Bounds of the rules, as shares of the words unless stated, and the settings of the estimate."""

    few_words: int = 20
    repeats: float = 0.3
    symbols: float = 0.1
    repeated_lines: float = 0.02
    upper: float = 0.5  # runs of three capitals
    marks: float = 0.2
    word_length: float = 14.0  # mean code points
    clean: float = 0.02  # symbols and marks of plain prose
    steady: float = 0.1  # repeated words of plain prose
    rounds: int = 20
    #: Accuracies at the start, of rules that vote bad and of rules that vote good; they weigh `prior_votes` times a rule's own votes.
    start_bad: float = 0.95
    start_good: float = 0.75
    prior_votes: float = 3.0


def votes(m: Column, rules: Rules) -> dict[str, Column]:
    """Votes of all rules on a struct of measures: 1 good, 0 bad, null abstains."""
    per_word = lambda name: m[name] / F.greatest(m["n_words"], F.lit(1))
    bad = lambda test: F.when(test, 0)
    good = lambda test: F.when(test, 1)
    enough = m["n_words"] >= 2 * rules.few_words
    return {
        "few_words": bad(m["n_words"] < rules.few_words),
        "repeats": bad(per_word("n_repeat_words") > rules.repeats),
        "symbols": bad(per_word("n_symbols") > rules.symbols),
        "repeated_lines": bad(per_word("n_dup_lines") > rules.repeated_lines),
        "upper": bad(per_word("n_upper") > rules.upper),
        "marks": bad(per_word("n_marks") > rules.marks),
        "word_length": bad(per_word("word_chars") > rules.word_length),
        "plain": good(enough & (per_word("n_symbols") <= rules.clean) & (per_word("n_marks") <= rules.clean)),
        "steady": good(enough & (per_word("n_repeat_words") <= rules.steady) & (m["n_dup_lines"] == 0)),
    }


_SAYS_GOOD = ("plain", "steady")


@dataclass(frozen=True)
class Reliability:
    """Estimated accuracy of each rule where it votes; either class is as likely before any vote."""

    accuracy: dict[str, float]

    def posterior(self, vote: dict[str, Column]) -> Column:
        """Probability of good: votes add their log odds of being right, abstaining adds nothing."""
        total = F.lit(0.0)
        for name, v in vote.items():
            weight = math.log(self.accuracy[name] / (1 - self.accuracy[name]))
            total = total + F.when(v == 1, weight).when(v == 0, -weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(patterns: DataFrame, names: list[str], rules: Rules) -> Reliability:
    """Expectation-maximisation over rows (vote columns, n): at most three to the power of the rules, whatever the corpus.

    Each round is one aggregate of that table; only two sums a rule come to the driver. Pseudo-votes at the starting
    accuracies keep the two classes from changing places. A rule that contradicts the others loses weight.
    """
    start = {r: rules.start_good if r in _SAYS_GOOD else rules.start_bad for r in names}
    accuracy = dict(start)
    for _ in range(rules.rounds):
        p, n = Reliability(accuracy).posterior({r: F.col(r) for r in names}), F.col("n")
        sums = []
        for r in names:
            sums += [F.sum(F.when(F.col(r).isNotNull(), n)).alias(f"{r}_n"), F.sum(n * F.when(F.col(r) == 1, p).when(F.col(r) == 0, 1 - p)).alias(f"{r}_right")]
        got = patterns.agg(*sums).first()
        new = {}
        for r in names:
            voted, right = got[f"{r}_n"] or 0, got[f"{r}_right"] or 0.0
            share = (rules.prior_votes * voted * start[r] + right) / ((rules.prior_votes + 1) * voted) if voted else start[r]
            new[r] = min(max(share, 0.5), 0.999)
        moved = max(abs(new[r] - accuracy[r]) for r in names)
        accuracy = new
        if moved < 1e-3:
            break
    return Reliability(accuracy)


def _patterns(ballots: DataFrame) -> tuple[DataFrame, list[str]]:
    """Counts of equal ballots, from one struct column v of votes."""
    counted = ballots.groupBy("v").agg(F.count("*").alias("n")).select("v.*", "n")
    names = counted.columns[:-1]
    return cut_lineage(counted.coalesce(1).sortWithinPartitions(*names)), names


def _ballot(m: Column, rules: Rules) -> Column:
    return F.struct(*[v.alias(r) for r, v in votes(m, rules).items()])


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Measures and verdict for each row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior.

    A null or empty text has no words and fails; an empty table gives an empty result. Repeated rows are judged alike
    and all return, so do rows without id. Extra columns are ignored.
    """
    measured = cut_lineage(docs.select("doc_id", measures(docs["text"]).alias("m")))
    m = F.col("m")
    patterns, names = _patterns(measured.select(_ballot(m, rules).alias("v")))
    posterior = fit(patterns, names, rules).posterior(votes(m, rules))
    failed = base_failed(m)
    return measured.select(
        "doc_id", *[m[c].alias(c) for c in MEASURES], failed.alias("base_failed"), (~failed & (posterior >= 0.5)).alias("kept"), posterior.alias("posterior")
    )


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that `judge` keeps, with all their columns; texts are measured where they are, without a join."""
    found = measures(docs["text"])
    patterns, names = _patterns(docs.select(let(found, lambda m: _ballot(m, rules)).alias("v")))
    model = fit(patterns, names, rules)
    return docs.filter(let(found, lambda m: ~base_failed(m) & (model.posterior(votes(m, rules)) >= 0.5)))
