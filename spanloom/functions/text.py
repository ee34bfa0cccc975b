"""Text predicates, normalisation and spans as Column expressions. A null text counts as empty."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.btrim(c, F.lit(P.WHITE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def lang_kind(c: Column) -> Column:
    """mixed, chinese or english (which covers everything without Han characters)."""
    han, latin = c.rlike(P.HAN), c.rlike(P.LATIN)
    return F.when(han & latin, "mixed").when(han, "chinese").otherwise("english")


def mostly_english(c: Column) -> Column:
    """More than 80 % ASCII letters, digits and white space; the empty text isn't."""
    kept = F.length(F.regexp_replace(c, r"[^A-Za-z0-9\s]", ""))
    return F.coalesce((F.length(c) > 0) & (kept / F.length(c) > 0.8), F.lit(False))


def region_action(text: Column, terms: list[str], patterns: list[str], default: str = "translate", keep_english: bool = True) -> Column:
    """struct(action, reason) of a text region, the first rule that holds."""
    rule = lambda action, reason: F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))
    t = strip(F.coalesce(text, F.lit("")))
    named = reduce(lambda a, b: a | b, [F.contains(F.lower(t), F.lit(x.lower())) for x in terms], F.lit(False))
    formed = reduce(lambda a, b: a | b, [t.rlike(rf"^(?:{p})\z") for p in patterns], F.lit(False))
    return (
        F.when(t == "", rule("remove", "empty_text"))
        .when(F.lit(keep_english) & mostly_english(t), rule("preserve", "already_target_language"))
        .when(named, rule("preserve", "preserve_term_match"))
        .when(formed, rule("preserve", "preserve_pattern_match"))
        .otherwise(rule(default, "default_action"))
    )


def preprocessed(c: Column, most: int = 4000) -> Column:
    """struct(text, error): line ends unified, blank lines collapsed, ends stripped; error names what makes it unusable."""
    ends = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))

    def told(t: Column) -> Column:
        error = F.when(t.isNull(), "null_input").when(t == "", "empty_input").when(F.length(t) > most, "input_too_long")
        return F.struct(F.when(error.isNull(), t).alias("text"), error.alias("error"))

    return let(strip(F.regexp_replace(ends, r"\n{3,}", "\n\n")), told)


def content_tokens(c: Column) -> Column:
    """Han characters one by one, runs of Latin letters and digits as one."""
    return F.size(matches(c, P.CONTENT_TOKEN)).cast("long")


def words(c: Column) -> Column:
    return matches(F.lower(c), P.WORD)


def spans(c: Column) -> Column:
    """array of struct(cjk, span): maximal runs of CJK and of other characters, in order."""
    runs = matches(c, rf"(?s)[{P.CJK}]+|[^{P.CJK}]+")
    return F.transform(runs, lambda s: F.struct(s.rlike(rf"^[{P.CJK}]").alias("cjk"), s.alias("span")))


def located(c: Column, pattern: str, kind: str) -> Column:
    """array of struct(start, stop, kind, content) of a pattern's matches; start counts from 0."""
    shape = "array<struct<start:int,stop:int,kind:string,content:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(shape).alias("out"))

    def add(s: Column, x: Column) -> Column:
        at, stop = s["at"] + F.length(x["gap"]), s["at"] + F.length(x["gap"]) + F.length(x["found"])
        one = F.struct(at.alias("start"), stop.alias("stop"), F.lit(kind).alias("kind"), x["found"].alias("content"))
        return F.struct(F.coalesce(stop, at).alias("at"), F.when(x["found"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(one))).alias("out"))

    both = F.arrays_zip(F.split(c, pattern, -1).alias("gap"), matches(c, pattern).alias("found"))
    return F.aggregate(both, start, add, lambda s: s["out"])


def protected_spans(c: Column) -> Column:
    """Identifiers of all kinds without overlap: the earliest start first, then the longest, then the kind listed first."""

    def ranked(n: int) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["start"], (s["start"] - s["stop"]).alias("shorter"), F.lit(n).alias("n"), s["stop"], s["kind"], s["content"])

    found = [F.transform(located(c, p, k), ranked(n)) for n, (k, p) in enumerate(P.IDENTIFIERS.items())]
    ranked_all = F.array_sort(F.concat(*found))
    shape = "array<struct<start:int,shorter:int,n:int,stop:int,kind:string,content:string>>"
    none = F.array().cast(shape)
    free = F.aggregate(ranked_all, F.array().cast(shape), lambda kept, s: F.when(s["start"] >= F.coalesce(F.try_element_at(kept, F.lit(-1))["stop"], F.lit(-1)), F.concat(kept, F.array(s))).otherwise(kept))
    return F.transform(F.when(c.rlike(P.HINT), free).otherwise(none), lambda s: F.struct(s["start"], s["stop"], s["kind"], s["content"]))


def token(kind: str, n: Column) -> Column:
    """The n-th placeholder of a kind."""
    return F.concat(F.lit(P.PREFIX + kind[0].upper()), F.lpad(n.cast("string"), 4, "0"), F.lit("_"))


def protected(c: Column, found: Column) -> Column:
    """The text with its protected spans, numbered in order, as placeholders."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit("").alias("out"))

    def add(s: Column, x: Column) -> Column:
        gap = F.substring(c, s["at"] + 1, x["start"] - s["at"])
        return F.struct(x["stop"].alias("at"), (s["n"] + 1).alias("n"), F.concat(s["out"], gap, token("span", s["n"] + 1)).alias("out"))

    return F.aggregate(found, start, add, lambda s: F.concat(s["out"], F.substring(c, s["at"] + 1, F.length(c))))


def restored(c: Column, tokens: Column, contents: Column) -> Column:
    """Placeholders replaced by what they stand for, in their order."""
    return F.aggregate(F.arrays_zip(tokens.alias("token"), contents.alias("content")), c, lambda s, x: F.replace(s, x["token"], x["content"]))


def spaced(c: Column) -> Column:
    """Every placeholder set off by spaces, as the model gets it."""
    return F.regexp_replace(c, f"({P.PLACEHOLDER})", " $1 ")


def placeholder_check(output: Column, expected: Column) -> Column:
    """struct(ok, missing, duplicated, unknown, order_ok) of a model's output against the source's placeholders."""
    count = lambda t: F.size(F.split(output, F.concat(F.lit(r"\Q"), t, F.lit(r"\E")), -1)) - 1
    missing = F.filter(expected, lambda t: count(t) == 0)
    twice = F.filter(expected, lambda t: count(t) > 1)
    unknown = F.filter(matches(output, P.ANY_PLACEHOLDER), lambda t: ~F.array_contains(expected, t))
    order = F.filter(F.array_distinct(matches(output, P.PLACEHOLDER)), lambda t: F.array_contains(expected, t)) == expected
    ok = (F.size(missing) == 0) & (F.size(twice) == 0) & (F.size(unknown) == 0) & order
    return F.struct(ok.alias("ok"), missing.alias("missing"), twice.alias("duplicated"), unknown.alias("unknown"), order.alias("order_ok"))


def edges_kept(source: Column, piece: Column) -> Column:
    """piece with the white space at source's ends instead of its own."""
    lead = F.regexp_extract(source, r"(?U)^\s*", 0)
    tail = F.regexp_extract(F.substring(source, F.length(lead) + 1, F.length(source)), r"(?U)\s*\z", 0)
    return F.concat(lead, strip(piece), tail)


def joined(left: Column, right: Column) -> Column:
    """left and right, with a space where two ASCII words would merge."""
    return F.concat(left, F.when(left.rlike(r"[A-Za-z0-9]\z") & right.rlike("^[A-Za-z0-9]"), " ").otherwise(""), right)


def last_boundary(c: Column, limit: int, ends: str) -> Column:
    """How many of the first ``limit`` characters there are up to the last of ``ends``; -1 without any."""
    head = F.substring(c, 1, limit)
    cut = F.length(F.regexp_extract(head, rf"(?s)^.*[{ends}]", 0))
    return F.when(cut > 0, cut).otherwise(-1).cast("long")
