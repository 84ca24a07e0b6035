"""Quality rules by weak supervision: each rule votes or abstains, and EM weighs the votes."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import NOT_SPACE, documents, free_names, materialize, words

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_stop", "n_marks", "n_ended")
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "was", "that", "for", "with", "der", "die", "das", "und", "ist", "nicht", "ein", "zu", "den", "von",
    "le", "la", "les", "et", "des", "que", "est", "un", "une", "pour", "el", "los", "las", "de", "y", "en", "por", "con", "se", "del",
)
#: A mark that ends a phrase, before white space or the end; and the same at the end of a line, quotes and brackets aside.
MARK, ENDED = r"[.,;:!?](?=[\x20\x09-\x0D]|\z)", r"""[.!?]["')\]»”]*[\x20\x09-\x0D]*\z"""


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value computed once; a plain reference would compute it again for each element of a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns FEATURES (long); a null text has no words. Columns of those names are replaced, all others stay."""
    given = [f"`{c}`" for c in docs.columns if c not in FEATURES]
    w_name, l_name = free_names(docs.columns, "words", "lines")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(NOT_SPACE)))
    shape = _let(words(t), lambda w: F.struct(
        F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), F.when(F.size(w) >= WINDOW, _windows_differ(w)).otherwise(True).alias("differ"),
        F.size(F.array_distinct(w)).alias("distinct"), F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).alias("stop"),
    ))
    by_line = _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct"), F.size(F.filter(x, lambda y: F.rlike(y, F.lit(ENDED)))).alias("ended")))
    step = docs.select(*given, shape.alias(w_name), by_line.alias(l_name))
    of_words, of_lines = F.col(w_name), F.col(l_name)
    found = {
        "n_words": of_words["n"], "word_chars": of_words["chars"], "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)), "n_lines": of_lines["n"], "n_dup_lines": of_lines["n"] - of_lines["distinct"],
        "n_repeat_words": F.when(of_words["differ"], F.lit(0)).otherwise(_let(words(t), _repeat_words)), "n_distinct": of_words["distinct"], "n_stop": of_words["stop"],
        "n_marks": F.regexp_count(t, F.lit(MARK)), "n_ended": of_lines["ended"],
    }
    return step.select(*given, *[found[c].cast("long").alias(c) for c in FEATURES])


def _windows_differ(w: Column) -> Column:
    """True only if no window of the words occurs twice; tells by hashes, so a few texts without repeats may get False."""

    def doubled(hashes: Column, by: int) -> Column:
        return F.zip_with(hashes, F.slice(hashes, F.lit(by + 1), F.size(hashes)), lambda a, b: F.xxhash64(a, b))

    spans = F.transform(w, lambda x: F.xxhash64(x))
    of_8 = _let(spans, lambda x1: _let(doubled(x1, 1), lambda x2: _let(doubled(x2, 2), lambda x4: doubled(x4, 4))))
    return _let(F.slice(of_8, F.lit(1), F.size(w) - (WINDOW - 1)), lambda h: F.size(F.array_distinct(h)) == F.size(h))


def _repeat_words(w: Column) -> Column:
    """Number of words in windows that occur twice or more: sort the windows' hashes (128 bits), keep equal neighbours, add up the cover."""

    def hashed(i: Column) -> Column:
        window = F.slice(w, i, WINDOW)
        return F.struct(F.xxhash64(window).alias("a"), F.xxhash64(F.lit("second"), window).alias("b"), i.alias("i"))

    windows = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), hashed)
    nothing = F.array(F.struct(F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(0).alias("i")))
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"])

    def starts(ordered: Column) -> Column:
        trios = F.arrays_zip(ordered.alias("cur"), F.concat(nothing, ordered).alias("prev"), F.slice(F.concat(ordered, nothing), F.lit(2), F.size(ordered)).alias("next"))
        twice = F.filter(trios, lambda x: same(x["cur"], x["prev"]) | same(x["cur"], x["next"]))
        return F.array_sort(F.transform(twice, lambda x: x["cur"]["i"]))

    first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(
        _let(F.array_sort(windows), starts), first, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n")), lambda s: s["n"]
    )


def base_failed() -> Column:
    """The rules that reject whatever the votes say."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Votes: 1 good, -1 bad, 0 abstains. Each rule looks at something that neither the base rules nor another rule looks at."""
    n, lines = F.col("n_words"), F.col("n_lines")

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    chars, distinct = F.col("word_chars"), F.col("n_distinct")
    return {
        "symbols": vote(10 * F.col("n_symbols") > n, 100 * F.col("n_symbols") <= n),
        "word_length": vote((chars < 3 * n) | (chars > 10 * n), (2 * chars >= 7 * n) & (chars <= 7 * n)),
        "line_ends": vote(10 * F.col("n_ended") < 6 * lines, 10 * F.col("n_ended") >= 9 * lines),
        "marks": vote(40 * F.col("n_marks") < n, (20 * F.col("n_marks") >= n) & (2 * F.col("n_marks") <= n)),
        "stop_words": vote(50 * F.col("n_stop") < n, 15 * F.col("n_stop") >= n),
        "variety": vote(distinct * distinct < 9 * n, distinct * distinct >= 16 * n),
        "dup_lines": vote(3 * F.col("n_dup_lines") > lines, F.col("n_dup_lines") == 0),
    }


@dataclass
class LabelModel:
    """log_odds[rule][vote] is what a vote adds to the log odds of good; prior is where they start."""

    prior: float
    log_odds: dict[str, dict[int, float]]

    def log_odds_of(self, votes: dict[str, int]) -> float:
        return self.prior + sum(self.log_odds[r][v] for r, v in votes.items())

    def posterior(self, votes: dict[str, Column]) -> Column:
        """P(good) from the rules' votes."""
        total = F.lit(self.prior)
        for rule, by_vote in self.log_odds.items():
            total = total + F.when(votes[rule] == 1, by_vote[1]).when(votes[rule] == -1, by_vote[-1]).otherwise(by_vote[0])
        return 1 / (1 + F.exp(-total))


#: What is believed of a rule before any document: how often it votes bad, abstains, votes good, for a bad and a good one.
BELIEF = ((0.4, 0.2, 0.4), (0.01, 0.09, 0.9))
#: The share of good documents that is believed, and how many documents the beliefs are worth, as a part of all.
PRIOR, STRENGTH, ROUNDS = 0.8, 0.02, 50


def fit_em(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = ROUNDS, prior: float = PRIOR, strength: float = STRENGTH) -> LabelModel:
    """EM on counted vote patterns (at most 3**rules of them, whatever the number of documents).

    Each rule has for either class a distribution over its three votes. EM starts at BELIEF, which also stays as
    pseudo-counts, so that the classes keep their meaning; the model returned is EM's last estimate as it stands.
    """
    total = sum(c for _, c in patterns)
    extra = strength * total + 1
    theta, pi = [BELIEF] * len(names), prior

    def log_odds() -> tuple[float, list[list[float]]]:
        return math.log(pi / (1 - pi)), [[math.log(good / bad) for bad, good in zip(*rule, strict=True)] for rule in theta]

    for _ in range(rounds):
        start, adds = log_odds()
        weight = [1 / (1 + math.exp(-max(-500.0, min(500.0, start + sum(a[v + 1] for a, v in zip(adds, p, strict=True)))))) for p, _ in patterns]
        good = math.fsum(w * c for w, (_, c) in zip(weight, patterns, strict=True))
        pi = (good + prior * extra) / (total + extra)
        theta = []
        for j in range(len(names)):
            seen = [[0.0] * 3, [0.0] * 3]
            for w, (p, c) in zip(weight, patterns, strict=True):
                seen[0][p[j] + 1] += (1 - w) * c
                seen[1][p[j] + 1] += w * c
            theta.append(tuple(tuple((s + extra * b) / (sum(row) + extra) for s, b in zip(row, belief, strict=True)) for row, belief in zip(seen, BELIEF, strict=True)))
    start, adds = log_odds()
    return LabelModel(start, {n: {v: a[v + 1] for v in (-1, 0, 1)} for n, a in zip(names, adds, strict=True)})


def judge(docs: DataFrame, keep: list[str] | None = None, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The columns `keep` of docs (all by default) with FEATURES, base_failed, p_quality and kept.

    kept is false if base_failed, else p_quality >= threshold. The label model is fitted to the documents that the base
    rules pass, since it decides on these alone. A null or empty text has no words and fails; equal rows are judged
    alike; an empty table gives an empty result; columns of docs that bear a result's name are replaced. The features
    are written to the shared folder once, since both the fit and the verdict read them; the fit sees only the counts of
    vote patterns.
    """
    keep = docs.columns if keep is None else keep
    keep = [c for c in keep if c not in (*FEATURES, "base_failed", "p_quality", "kept")]
    votes = rules()
    column = dict(zip(votes, free_names([*keep, *FEATURES], *votes), strict=True))
    featured = with_features(docs, text).select(*[f"`{c}`" for c in keep], *FEATURES)
    voted = materialize(featured.select("*", *[v.cast("byte").alias(column[r]) for r, v in votes.items()]), "quality", compression="zstd")
    counted = voted.filter(~base_failed()).groupBy(*column.values()).count().collect()  # at most 3 to the number of rules
    patterns = sorted((tuple(row[c] for c in column.values()), row["count"]) for row in counted)
    good = fit_em(patterns, list(votes)).posterior({r: F.col(c) for r, c in column.items()})
    return voted.select(*[f"`{c}`" for c in keep], *FEATURES, base_failed().alias("base_failed"), F.round(good, 6).alias("p_quality"), (~base_failed() & (good >= threshold)).alias("kept"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and p_quality of all documents."""
    judged = judge(documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_quality")
