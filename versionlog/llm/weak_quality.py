"""Quality rules as weak supervision.

Each rule votes good, bad, or abstains.  Expectation-maximisation over the counts of vote patterns
(at most 3 to the number of rules) estimates how often each rule is right for good and for bad
documents; a document is kept by its posterior probability of being good, not by passing all rules.
Features, votes and posteriors are built-in column expressions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versionlog.llm.common import stored, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_calls", "n_kinds")


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


@dataclass(frozen=True)
class Rule:
    """Votes good or bad where its condition holds, else abstains; bad wins."""

    name: str
    good: Column
    bad: Column

    def vote(self) -> Column:
        return F.when(self.bad, F.lit(0)).when(self.good, F.lit(1)).cast("byte").alias(self.name)


def default_rules() -> list[Rule]:
    """Eight rules over ``FEATURES``.  Most know one fault and abstain without it; three also know good text.  ``n_kinds``: different words."""
    n, never = F.col("n_words"), F.lit(False)
    length, symbols, letters, capitals = _share("word_chars", "n_words"), _share("n_symbols", "n_words"), _share("n_letters", "word_chars"), _share("n_capitals", "n_letters")
    return [
        Rule("v_word_length", (n >= 5) & length.between(4, 6.5), (n >= 5) & ~length.between(2.5, 9)),
        Rule("v_symbols", never, symbols > 0.1),
        Rule("v_letters", letters >= 0.94, (n >= 5) & (letters < 0.8)),
        Rule("v_capitals", (F.col("n_letters") >= 20) & (capitals <= 0.05), (F.col("n_letters") >= 20) & (capitals > 0.3)),
        Rule("v_calls", never, (n >= 5) & (_share("n_calls", "n_words") > 0.25)),
        Rule("v_lines", never, (F.col("n_lines") >= 3) & (_share("n_dup_lines", "n_lines") > 0.3)),
        Rule("v_kinds", never, n.between(20, 400) & (_share("n_kinds", "n_words") < 0.3)),
        Rule("v_repeats", never, (n >= 20) & (_share("n_repeat_words", "n_words") > 0.25)),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, *FEATURES)`` of every document; a null text counts as empty.

    Repeated words: windows are compared by a 64-bit hash of their words' 64-bit hashes, all within
    one document; sorting (hash, place) brings equal windows together, and the words they cover are
    summed over the sorted places.
    """
    df = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    df = df.withColumn("__w", words(F.col("__t")))
    df = df.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    df = df.withColumn("__g", F.expr(f"if(size(__h) < {WINDOW}, cast(array() as array<bigint>), transform(sequence(1, greatest(size(__h) - {WINDOW - 1}, 1)), i -> xxhash64(slice(__h, i, {WINDOW}))))"))
    df = df.withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    df = df.withColumn("__d", F.array_distinct("__g"))
    # Sorted (hash, place) of texts that have an equal pair of windows at all.
    df = df.withColumn("__s", F.expr("if(size(__d) = size(__g), cast(array() as array<struct<h:bigint,i:int>>), sort_array(transform(__g, (h, i) -> named_struct('h', h, 'i', i))))"))
    df = df.withColumn("__p", F.expr("sort_array(transform(filter(__s, (x, k) -> (k > 0 and element_at(__s, k).h = x.h) or (k + 1 < size(__s) and element_at(__s, k + 2).h = x.h)), x -> x.i))"))
    covered = f"aggregate(__p, named_struct('n', 0L, 'to', 0), (a, i) -> named_struct('n', a.n + (i + {WINDOW} - greatest(a.to, i)), 'to', i + {WINDOW}), a -> a.n)"
    bare = F.translate("__t", SPACES, "")
    df = df.withColumn("__b", bare)
    return df.select(
        id_col,
        F.size("__w").cast("long").alias("n_words"),
        F.length("__b").cast("long").alias("word_chars"),
        (F.length("__b") - F.length(F.translate("__b", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("__b", r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace("__b", r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        (F.length("__b") - F.length(F.translate("__b", "!?", ""))).cast("long").alias("n_calls"),
        F.size(F.array_distinct("__h")).cast("long").alias("n_kinds"),
    )


Votes = tuple[int | None, ...]


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents, and each rule's log odds of good against bad by its vote."""

    prior: float
    odds: list[dict[int | None, float]]

    def posterior(self, rules: list[Rule]) -> Column:
        z = F.lit(math.log(self.prior / (1 - self.prior)))
        for rule, o in zip(rules, self.odds, strict=True):
            v = F.col(rule.name)
            z = z + F.when(v == 1, F.lit(o[1])).when(v == 0, F.lit(o[0])).otherwise(F.lit(o[None]))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit_votes(patterns: list[tuple[Votes, int]], n_rules: int, rounds: int = 80, smooth: float = 0.5) -> VoteModel:
    """Expectation-maximisation over (votes, count) patterns, begun with the rules' majority.

    For good and for bad documents it estimates how often each rule votes good, bad, or abstains; the
    accuracy of a rule is what follows from these.  A bad vote weighs twice at the start, as rules
    that know faults speak up seldom.  With no documents all odds are even.
    """
    belief = []
    for votes, _ in patterns:
        good, bad = sum(v == 1 for v in votes), sum(v == 0 for v in votes)
        belief.append((good + 0.5) / (good + 2 * bad + 1))
    prior, odds = 0.5, [dict.fromkeys((1, 0, None), 0.0) for _ in range(n_rules)]
    total = sum(c for _, c in patterns)
    for _ in range(rounds if patterns else 0):
        weight = [(p * c, (1 - p) * c) for p, (_, c) in zip(belief, patterns, strict=True)]
        good, bad = sum(g for g, _ in weight), sum(b for _, b in weight)
        prior = (good + smooth) / (total + 2 * smooth)
        for r in range(n_rules):
            for vote in (1, 0, None):
                g = sum(w[0] for w, (v, _) in zip(weight, patterns, strict=True) if v[r] == vote)
                b = sum(w[1] for w, (v, _) in zip(weight, patterns, strict=True) if v[r] == vote)
                odds[r][vote] = math.log((g + smooth) / (good + 3 * smooth)) - math.log((b + smooth) / (bad + 3 * smooth))
        z = [math.log(prior / (1 - prior)) + sum(odds[r][v] for r, v in enumerate(votes)) for votes, _ in patterns]
        belief = [1 / (1 + math.exp(-max(-700.0, min(700.0, x)))) for x in z]
    return VoteModel(prior, odds)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, threshold: float = 0.5) -> DataFrame:
    """``(id, *FEATURES, votes, posterior, base_failed, kept)`` of every document.

    The features are written once to the shared folder (numbers only); the driver gets vote patterns
    with their counts, at most 3 to the number of rules.  Null and empty texts have no words and fail
    the base; repeated rows are judged alike; an empty table gives an empty result; other columns are
    not read.
    """
    rules = rules or default_rules()
    votes = [r.name for r in rules]
    voted = stored(features(docs, id_col, text_col).select("*", *(r.vote() for r in rules)), "votes")
    seen = voted.groupBy(*votes).count().collect()
    model = fit_votes(sorted(((tuple(r[v] for v in votes), r["count"]) for r in seen), key=lambda x: str(x[0])), len(rules))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return voted.withColumn("posterior", model.posterior(rules)).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= threshold))
