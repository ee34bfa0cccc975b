"""Token measures, generation budgets and output quality as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import content_tokens, let, words

# The budget classes, in tokens.
BUCKETS = (64, 128, 192, 256, 320, 400)


def measure(c: Column) -> Column:
    """The default token measure: half the characters, rounded up, 1 at least."""
    return F.greatest(F.lit(1), F.floor((F.length(c) + 1) / 2)).cast("long")


def target_budget(tokens: Column, style: Column, most: int = 400) -> Column:
    long, short = F.greatest(F.lit(64), F.floor(tokens * 2.5)), F.greatest(F.lit(1), F.floor(tokens * 1.5))
    return F.least(F.lit(most), F.when(style == "phrase", short).otherwise(long)).cast("long")


def bucket(budget: Column) -> Column:
    """The smallest class that holds the budget, or the budget itself."""
    out = budget
    for b in reversed(BUCKETS):
        out = F.when(budget <= b, F.lit(b)).otherwise(out)
    return out.cast("long")


def policy(tokens: Column, style: Column) -> Column:
    """struct of the generation settings that a style asks for."""
    phrase = style == "phrase"
    return F.struct(
        F.when(phrase & (tokens <= 32), 32).otherwise(512).cast("long").alias("max_new_tokens"),
        F.when(phrase, 1.5).otherwise(2.5).alias("multiplier"),
        F.when(phrase, 0.8).otherwise(1.0).alias("length_penalty"),
        F.when(phrase, 3.0).alias("max_expansion"),
        F.when(phrase, "warn").otherwise("off").alias("scaffolding"),
    )


def engine_budget(tokens: Column, style: Column, explicit: Column) -> Column:
    """What the engine generates at most: the explicit budget or tokens times the style's factor, within the policy."""
    p = policy(tokens, style)
    wanted = F.coalesce(explicit.cast("long"), F.ceil(tokens * p["multiplier"]))
    return F.least(p["max_new_tokens"], F.greatest(F.lit(1), wanted)).cast("long")


def phrase_check(source: Column, output: Column, most: float = 3.0) -> Column:
    """struct(accepted, reasons, source_tokens, output_tokens, ratio) of a phrase's translation."""
    a, b = (F.regexp_replace(c, P.ANY_PLACEHOLDER, " ") for c in (source, output))
    n, m = F.greatest(F.lit(1).cast("long"), content_tokens(a)), content_tokens(b)
    reasons = F.array_compact(F.array(F.when(m / n > most, "output_expansion_exceeded"), F.when(b.rlike(P.SCAFFOLDING), "sentence_scaffolding_detected")))
    return F.struct((F.size(reasons) == 0).alias("accepted"), reasons.alias("reasons"), n.alias("source_tokens"), m.alias("output_tokens"), (m / n).alias("ratio"))


def phrase_action(reasons: Column, policy: Column, retried: Column) -> Column:
    """What a policy does about a phrase whose check gave these reasons: accept, warn, retry (once) or quality_error."""
    fine = (F.size(reasons) == 0) | (policy == "off")
    return F.when(fine, "accept").when(policy == "warn", "warn").when((policy == "retry") & ~retried, "retry").otherwise("quality_error")


def folded(w: Column, finish: Callable[[Column], Column]) -> Column:
    """finish(struct(n, best, pairs)) of a word array: its length, its longest run of one word, and how often a
    word pair comes again right after itself. One pass; the array is computed once."""
    start = F.struct(*[F.lit("").alias(k) for k in ("one", "two", "three")], *[F.lit(0).alias(k) for k in ("n", "run", "best", "pairs")])

    def add(s: Column, x: Column) -> Column:
        run = F.when((s["n"] > 0) & (x == s["one"]), s["run"] + 1).otherwise(1)
        again = (s["n"] >= 3) & (x == s["two"]) & (s["one"] == s["three"])
        return F.struct(x.alias("one"), s["one"].alias("two"), s["two"].alias("three"), (s["n"] + 1).alias("n"), run.alias("run"), F.greatest(s["best"], run).alias("best"), (s["pairs"] + again.cast("int")).alias("pairs"))

    return F.aggregate(w, start, add, finish)


def max_run(w: Column) -> Column:
    """The longest run of equal words."""
    return folded(w, lambda s: s["best"]).cast("long")


def repeated_pairs(w: Column) -> Column:
    """How many word pairs come again right after themselves."""
    return folded(w, lambda s: s["pairs"]).cast("long")


def repeating(source: Column, most_run: int = 3, most_ratio: float = 0.35) -> Column:
    """Whether a text itself says the same again and again: a stretch stands more than most_run times in a row, or what
    comes again right after itself takes up so much that a translation, of up to five words a character, may exceed most_ratio."""
    own = F.regexp_replace(F.regexp_replace(source, P.ANY_PLACEHOLDER, "\0"), r"(?U)\s+", "")
    once = lambda t: F.regexp_replace(t, r"([^\x00]{1,40}?)(?=\1)", "")
    return let(own, lambda t: t.rlike(rf"([^\x00]{{1,40}}?)\1{{{most_run}}}") | (1 - F.length(once(t)) / F.length(t) > most_ratio / 4))


def degenerate(text: Column, source_tokens: Column, most_run: int = 3, most_ratio: float = 0.35, source: Column | None = None) -> Column:
    """Whether a model's output runs in circles or swells beyond measure. With its source: one that repeats itself may
    have an output that does, as long as it doesn't swell."""

    def told(s: Column) -> Column:
        circles = (s["best"] > most_run) | (s["n"] >= 4) & (s["pairs"] / F.greatest(F.lit(1), s["n"] - 3) > most_ratio)
        much = s["n"] > F.greatest(F.lit(32), source_tokens * 8)
        if source is not None:
            circles = F.when(circles, much | ~repeating(source, most_run, most_ratio)).otherwise(F.lit(False))
        return F.when(s["n"] == 0, F.trim(text) == "").otherwise(circles | (source_tokens <= 32) & much)

    return folded(words(text), told)
