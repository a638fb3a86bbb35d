"""Quality rules combined by weak supervision (native DataFrame expressions only).

Every rule looks at one statistic of the whole text and votes good, votes bad or abstains.
The rules' accuracies are unknown; expectation-maximisation over the counts of vote patterns
estimates them, and the posterior probability that a document is good replaces the requirement
that all rules pass. A rule's good and bad votes have an accuracy each: junk of one kind passes
the rules against other kinds, so a good vote says less than a bad one. A rule whose bad votes no
other rule backs is found weak, and good votes of others outvote it. The class balance is given
(PRIOR_GOOD): rules that mostly abstain do not identify it.

What leaves the executors for the driver is one row of sums per iteration. The pattern table
has at most 3^RULES rows whatever the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.staging import discard, stage

SPACE = " \\t-\\r"
GOOD, BAD, ABSTAIN = 1, 0, -1
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
ROUNDS = 40
SETTLED = 1e-5
#: Share of good documents before any rule has voted, a parameter.
PRIOR_GOOD = 0.5
PRIOR_ACCURACY = 0.9
#: An accuracy stays between these: a rule is never taken as inverted or infallible.
ACCURACY_RANGE = (0.55, 0.99)
#: Where the accuracy of good votes starts; most rules vouch for nearly all texts.
VOUCHER_MOST = 0.65
#: An odd word has a character that is no letter, digit or usual punctuation.
ODD_WORD = f"[^\\p{{L}}\\p{{M}}\\p{{N}}{SPACE}.,;:!?'\"()/’‘“”„«»…¿¡–—。、，．：；！？「」『』（）-][^{SPACE}]*"
PREFIX = "_wq_"


def _let(value: Column, body) -> Column:
    """Evaluate value once and hand it to body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered_by_repeats(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the array.

    Window hashes are packed above their position into one long, so a single sort puts equal
    windows side by side; neighbours are then compared word by word.
    """

    def of(n: Column) -> Column:
        bits = F.length(F.bin(n)).cast("int")
        low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

        def key(word: Column, i: Column) -> Column:
            return F.call_function("shiftleft", F.xxhash64(word, F.get(words, i + 1), F.get(words, i + 2)), bits).bitwiseOR(i.cast("long"))

        def count(keys: Column) -> Column:
            def same(k: Column, other: Column) -> Column:
                at, to = k.bitwiseAND(low).cast("int"), other.bitwiseAND(low).cast("int")
                equal = F.lit(True)
                for d in range(3):
                    equal = equal & (F.get(words, at + d) == F.get(words, to + d))
                return (F.call_function("shiftright", k, bits) == F.call_function("shiftright", other, bits)) & equal

            twice = F.filter(keys, lambda k, i: F.coalesce(same(k, F.get(keys, i - 1)), F.lit(False)) | F.coalesce(same(k, F.get(keys, i + 1)), F.lit(False)))
            starts = F.sort_array(F.transform(twice, lambda k: k.bitwiseAND(low)))
            zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
            return F.aggregate(starts, zero, lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end")), lambda a: a["n"])

        windows = F.transform(F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))), key)
        return _let(F.sort_array(windows), count)

    return _let(F.size(words), of)


def text_statistics(text: Column) -> Column:
    """A struct of whole-text statistics; null text counts as a text without words."""
    text = F.coalesce(text, F.lit(""))
    without = lambda chars: (F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]", ""))).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            without("#*$%&|<>").alias("n_symbols"),
            _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_lines"),
            _covered_by_repeats(words).alias("n_repeat_words"),
            without("!").alias("n_bangs"),
            without("A-Z").alias("n_capitals"),
            without("0-9").alias("n_digits"),
            without(".?!").alias("n_stops"),
            F.regexp_count(text, F.lit(ODD_WORD)).cast("long").alias("n_odd_words"),
        )

    return _let(F.array_remove(F.split(text, f"[{SPACE}]+"), ""), of)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN).cast("int")


def rule_votes(s: Column) -> dict[str, Column]:
    """The rules. s: the struct of text_statistics()."""
    words = F.greatest(s["n_words"], F.lit(1))
    chars = F.greatest(s["word_chars"], F.lit(1))
    a_word = lambda c: c / words
    mean = s["word_chars"] / words
    # A rule votes bad on junk of its kind, good well inside the normal range, and abstains in between.
    return {
        "length": _vote(s["n_words"] >= 2 * MIN_WORDS, s["n_words"] < MIN_WORDS),
        "sentences": _vote(a_word(s["n_stops"]).between(0.02, 0.3), (s["n_stops"] == 0) & (s["n_words"] >= 100)),
        "word_length": _vote(mean.between(4, 7), (mean < 2) | (mean > 14)),
        "symbols": _vote(a_word(s["n_symbols"]) <= 0.02, a_word(s["n_symbols"]) > 0.1),
        "repetition": _vote(a_word(s["n_repeat_words"]) <= 0.1, a_word(s["n_repeat_words"]) > 0.4),
        "lines": _vote((s["n_lines"] > 0) & (s["n_dup_lines"] * 10 <= s["n_lines"]), s["n_dup_lines"] * 10 > s["n_lines"] * 4),
        "shouting": _vote(a_word(s["n_bangs"]) <= 0.03, a_word(s["n_bangs"]) > 0.15),
        "capitals": _vote(s["n_capitals"] / chars <= 0.1, s["n_capitals"] / chars > 0.4),
        "digits": _vote(s["n_digits"] / chars <= 0.06, s["n_digits"] / chars > 0.25),
        "odd_words": _vote(a_word(s["n_odd_words"]) <= 0.05, a_word(s["n_odd_words"]) > 0.3),
    }


RULES = ("length", "sentences", "word_length", "symbols", "repetition", "lines", "shouting", "capitals", "digits", "odd_words")


def _posterior(model: dict, votes: dict[str, Column]) -> Column:
    """Probability of good quality: each vote counts by the log odds of the accuracy of such votes of its rule, an abstention not at all."""
    total = F.lit(math.log(PRIOR_GOOD / (1 - PRIOR_GOOD)))
    for r in RULES:
        good, bad = (math.log(model[r, v] / (1 - model[r, v])) for v in (GOOD, BAD))
        total = total + F.when(votes[r] == GOOD, good).when(votes[r] == BAD, -bad).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def _within(accuracy: float) -> float:
    return min(max(accuracy, ACCURACY_RANGE[0]), ACCURACY_RANGE[1])


def fit(voted: DataFrame) -> dict:
    """The rules' accuracies, by expectation-maximisation on the pattern counts.

    model[rule, vote] is the accuracy of one kind of vote: how often texts of the quality voted
    for get it, as a share of how often texts of either quality do. One text of each quality that
    votes by the start is added to the sums. model[rule] is the expected share of all votes of the
    rule that are right. An empty table gives the start.
    """
    patterns = stage(voted.groupBy(*[PREFIX + r for r in RULES]).agg(F.count("*").alias("docs")).coalesce(1), "patterns")
    votes = {r: F.col(PREFIX + r) for r in RULES}
    start = {(r, v): a for r in RULES for v, a in ((GOOD, VOUCHER_MOST), (BAD, PRIOR_ACCURACY))}
    model = dict(start)

    def sums(table: DataFrame, c: str) -> dict:
        row = table.agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("double") for x in (F.col(c), *[F.when(votes[r] == v, F.col(c)) for r, v in start])]).first()
        return dict(zip((None, *start), row, strict=True))

    docs = sums(patterns, "docs")
    for _ in range(ROUNDS):
        good = sums(patterns.select("*", (_posterior(model, votes) * F.col("docs")).alias("good")), "good")
        bad = {k: docs[k] - good[k] for k in docs}
        after = {}
        for r, v in start:
            right, wrong = (good, bad) if v == GOOD else (bad, good)
            often = (right[r, v] + start[r, v]) / (right[None] + 1)
            falsely = (wrong[r, v] + 1 - start[r, v]) / (wrong[None] + 1)
            after[r, v] = _within(often / (often + falsely))
        moved = max(abs(after[k] - model[k]) for k in start)
        model = after
        if moved < SETTLED:
            break
    discard(voted.sparkSession, patterns)
    for r in RULES:
        seen = docs[r, GOOD] + docs[r, BAD]
        model[r] = _within((good[r, GOOD] + bad[r, BAD]) / seen) if seen else PRIOR_ACCURACY
    return model


def quality_scores(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs with the struct ``_wq_s`` of statistics and ``_wq_p``, the posterior of good quality.

    keep: the columns of docs to carry (all by default); fewer make the staged table smaller.
    Rows are never joined back, so null or repeated doc_id values do not matter; the two structs
    replace columns of their names. Null and empty texts have no words and fail, texts of any
    length count whole. An empty table gives no rows.
    """
    keep = [c for c in docs.columns if c not in (PREFIX + "s", PREFIX + "p")] if keep is None else keep
    return _scored(docs, keep).select(*[f"row.`{c}`" for c in keep], PREFIX + "s", PREFIX + "p")


def _scored(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The struct ``row`` of the columns to keep, ``_wq_s`` and ``_wq_p``."""
    scored = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text_statistics(F.col("text")).alias(PREFIX + "s"))
    voted = scored.select("*", *[v.alias(PREFIX + r) for r, v in rule_votes(F.col(PREFIX + "s")).items()])
    voted = stage(voted, "votes")
    model = fit(voted)
    return voted.select("row", PREFIX + "s", _posterior(model, {r: F.col(PREFIX + r) for r in RULES}).alias(PREFIX + "p"))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def filter_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that pass the base rules and whose posterior reaches the threshold."""
    scored = _scored(docs, docs.columns)
    return scored.where(~base_failed(F.col(PREFIX + "s")) & (F.col(PREFIX + "p") >= threshold)).select("row.*")


def quality_report(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per row of docs: the base statistics, base_failed, kept and quality_probability."""
    s, p = F.col(PREFIX + "s"), F.col(PREFIX + "p")
    return quality_scores(docs, keep=["doc_id"]).select(
        "doc_id", *[s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed(s).alias("base_failed"), (~base_failed(s) & (p >= threshold)).alias("kept"), F.round(p, 6).alias("quality_probability"),
    )
