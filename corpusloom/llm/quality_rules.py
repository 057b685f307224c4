"""Quality rules by weak supervision (DataFrame functions only).

Each rule votes +1 (good), -1 (bad) or 0 (abstains). Expectation-maximisation over the counts of the
vote patterns estimates how far each rule is to be trusted, and the posterior probability of being good
replaces all-must-pass filtering: a document that one unreliable rule is against may stay, and one that no rule
speaks for may go. There are at most PATTERNS patterns whatever the number of documents; their counts, two
numbers each, come to the driver once, and EM runs over them there.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import Steps, checkpointed

SEPARATORS = " \t\n\u000b\f\r"
WORD_BREAK = r"[ \t-\r]+"
PLAIN_WORD = r"(?<![^ \t-\r])\p{L}+(?:['\u2019-]\p{L}+)*[.,;:!?]?(?![^ \t-\r])"
SENTENCE_END = r"\p{L}[.!?](?![^ \t-\r])"
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_shouts", "n_distinct", "n_digits", "n_plain", "n_ends"]


def _let(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SEPARATORS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_BREAK))


def _windows(words: Column) -> Column:
    """A 64-bit hash of each window of three words."""
    n = F.size(words)
    at = F.sequence(F.lit(1), n - 2)
    hashed = F.transform(at, lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)))
    return F.when(n >= 3, hashed).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words covered by windows that occur twice or more; sorted neighbours show the repeats."""
    ordered = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def count(s: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(s, j)["w"] == F.get(s, i)["w"], F.lit(False))
        hits = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        starts = F.transform(hits, lambda i: F.get(s, i)["i"])
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    return _let(ordered, count)


def _repeats(windows: Column) -> Column:
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_covered(windows))


def _dup_lines(lines: Column) -> Column:
    return F.size(lines) - F.size(F.array_distinct(lines))


def features_of(text: Column) -> Column:
    """The features of a text as one structure, so that whatever is asked of them they are worked out once."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SEPARATORS)) != "")
    length = lambda strip: F.length(text) - F.length(F.regexp_replace(text, strip, ""))

    def made(w: Column) -> Column:
        found = {
            "n_words": F.size(w),
            "word_chars": F.length(F.array_join(w, "")),
            "n_symbols": length("[#*$%&|<>]+"),
            "n_dup_lines": _let(lines, _dup_lines),
            "n_repeat_words": _let(_windows(w), _repeats),
            "n_upper": length(r"\p{Lu}+"),
            "n_shouts": length("[!?]{2,}"),
            "n_distinct": F.size(F.array_distinct(w)),
            "n_digits": length("[0-9]+"),
            "n_plain": F.regexp_count(text, F.lit(PLAIN_WORD)),
            "n_ends": F.regexp_count(text, F.lit(SENTENCE_END)),
        }
        return F.struct(*[found[k].cast("long").alias(k) for k in FEATURES])

    return _let(words_of(text), made)


def base_failed(of: Column) -> Column:
    return (of["n_words"] < 50) | (100 * of["n_repeat_words"] > 50 * of["n_words"])


def votes(of: Column) -> list[Column]:
    """The labelling functions over features: +1 good, -1 bad, 0 abstains. Each abstains on what it cannot tell.

    Several rules look at each kind of damage from different sides, since agreement is all EM can learn from. The
    last two are suspicions that many a sound document raises; EM finds how little they weigh.
    """
    c = lambda k: of[k].cast("double")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    vote = lambda bad, good=F.lit(False): F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))
    n, chars = c("n_words"), c("word_chars")
    mean, ends, plain = share(chars, n), share(c("n_ends"), n), share(c("n_plain"), n)
    return [
        vote(n < 20, n >= 50),
        vote((mean < 2) | (mean > 14), (mean >= 3) & (mean <= 10)),
        vote(plain < 0.6, plain > 0.9),
        vote((ends < 0.01) | (ends > 0.6), (ends >= 0.03) & (ends <= 0.4)),
        vote(share(c("n_symbols"), chars) > 0.06),
        vote(share(c("n_upper"), chars) > 0.35, share(c("n_upper"), chars) < 0.15),
        vote(share(c("n_shouts"), n) > 0.2),
        vote(share(c("n_repeat_words"), n) > 0.35),
        vote((n >= 30) & (n <= 500) & (share(c("n_distinct"), n) < 0.2)),
        vote(share(c("n_digits"), chars) > 0.25),
        vote(share(c("n_symbols"), n) > 0.5, c("n_symbols") == 0),
        vote(c("n_dup_lines") > 0),
        vote(n > 1000),
    ]


N_RULES = 13
#: The most patterns there can be: seven rules never vote +1, the other six vote three ways.
PATTERNS = 2**7 * 3**6


def pattern_of(votes: list[Column]) -> Column:
    """The votes as one number: the digit to the base 3 at place k is one more than rule k's vote."""
    return reduce(lambda total, v: total * 3 + v + 1, reversed(votes), F.lit(0).cast("long"))


def votes_of(pattern: Column, n_rules: int) -> list[Column]:
    """The votes that pattern_of has packed."""
    return [F.pmod(F.floor(pattern / 3**k), F.lit(3)) - 1 for k in range(n_rules)]


@dataclass(frozen=True)
class VoteModel:
    """Prior log-odds of good, and each rule's log-likelihood ratio for the votes -1, 0 and +1."""

    prior: float
    ratios: tuple[tuple[float, float, float], ...]

    def probability(self, pattern: list[Column]) -> Column:
        terms = [
            F.when(v == -1, F.lit(bad)).when(v == 1, F.lit(good)).otherwise(F.lit(silent))
            for v, (bad, silent, good) in zip(pattern, self.ratios, strict=True)
        ]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-sum(terms, F.lit(self.prior))))


#: What a rule is expected to do before any document is seen: how often it votes -1, 0 and +1 on each class.
START = {"good": (0.03, 0.37, 0.60), "bad": (0.45, 0.35, 0.20)}


def _model(p_good: float, rates: list[dict[str, tuple[float, ...]]]) -> VoteModel:
    ratios = tuple(tuple(math.log(g / b) for g, b in zip(r["good"], r["bad"], strict=True)) for r in rates)
    return VoteModel(math.log(p_good / (1 - p_good)), ratios)


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 25, prior_good: float = 0.8, strength: float = 20.0) -> VoteModel:
    """Estimates how often each rule votes which way on good and on bad documents; no labels are used.

    ``votes`` has a row for each pattern and a column for each rule, ``counts`` how many documents have it.
    ``strength`` pseudo-counts of START keep the estimates sound on a small table and settle which of the
    two classes is the good one. Without any document the result is START itself.
    """
    n_rules, total = votes.shape[1], counts.sum()
    p, rates = prior_good, [START] * n_rules
    for _ in range(rounds if total else 0):
        model = _model(p, rates)
        log_odds = np.full(len(counts), model.prior)
        for k, ratio in enumerate(model.ratios):
            log_odds += np.array(ratio)[votes[:, k] + 1]
        q = 1 / (1 + np.exp(-log_odds))
        weights = {"good": counts * q, "bad": counts * (1 - q)}

        def rate(k: int, name: str, weights=weights) -> tuple[float, ...]:
            found = np.bincount(votes[:, k] + 1, weights[name], minlength=3) + strength * np.array(START[name])
            return tuple(np.maximum(found / found.sum(), 1e-4).tolist())

        new = [{name: rate(k, name) for name in START} for k in range(n_rules)]
        moved = max(abs(x - y) for u, v in zip(new, rates, strict=True) for k in START for x, y in zip(u[k], v[k], strict=True))
        p = min(max((weights["good"].sum() + strength * prior_good) / (total + strength), 0.02), 0.98)
        rates = new
        if moved < 1e-4:
            break
    return _model(float(p), rates)


def fit(patterns: DataFrame, n_rules: int, **options) -> VoteModel:
    """The model for a column ``pattern`` (null: not counted); one row per pattern, PATTERNS at most, comes to the driver."""
    found = patterns.where("pattern IS NOT NULL").groupBy("pattern").agg(F.count(F.lit(1)).alias("n_docs")).toPandas()
    codes, counts = found["pattern"].to_numpy(np.int64), found["n_docs"].to_numpy(float)
    order = np.argsort(codes)
    votes = codes[order, None] // 3 ** np.arange(n_rules) % 3 - 1
    return expectation_maximisation(votes, counts[order], **options)


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, the features, base_failed, p_good and kept for each row of docs, and ``against``, how many rules vote bad.

    Texts are read once: the features, a few numbers a row, are checkpointed before EM reads them again.
    Null or empty text has no words and so fails; an empty table gives an empty result; repeated rows are
    judged one by one; other columns are ignored.
    """
    kept = checkpointed(docs.select(F.col(id_col).alias("doc_id"), features_of(F.col(text_col)).alias("f")))
    voted = kept.select("*", pattern_of(votes(F.col("f"))).alias("pattern"))
    each = votes_of(F.col("pattern"), N_RULES)
    good = fit(voted, N_RULES).probability(each)
    against = reduce(lambda a, b: a + b, [F.when(v == -1, 1).otherwise(0) for v in each])
    scored = voted.select("doc_id", "f.*", base_failed(F.col("f")).alias("base_failed"), good.alias("p_good"), against.cast("int").alias("against"))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def filter_quality(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the rules keep, with their columns. Edge cases are as for quality_scores.

    A first pass over the texts leaves each row's vote pattern for EM, a second one judges beside each row: that costs
    less than a copy of all texts on disk, or sending them through an exchange to meet their verdicts. The verdict is one
    expression over one structure of features, so that the filter works them out once, wherever it is moved.
    """
    text = F.col(text_col)
    with Steps(docs.sparkSession) as work:
        model = fit(work.keep(docs.select(_let(features_of(text), lambda f: pattern_of(votes(f))).alias("pattern"))), N_RULES)
        work.done()

    def verdict(f: Column) -> Column:
        good = _let(pattern_of(votes(f)), lambda p: model.probability(votes_of(p, N_RULES)) >= threshold)
        return ~base_failed(f) & good

    return docs.where(_let(features_of(text), verdict))
