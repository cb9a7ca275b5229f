"""Scalar text functions: Column in, Column out, all in generated code or higher-order functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters whose upper case is several letters, and the one letter that stands for each (itself, if it has none).
_LONG = "".join(c for c in map(chr, range(0x10000)) if len(c.upper()) > 1)
_SHORT = "".join("ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _LONG)


def upper_letters(text: Column) -> Column:
    """Upper case one letter for one, as in DuckDB: the length stays."""
    each = F.transform(F.split(text, ""), lambda c: F.when(F.contains(F.lit(_LONG), c), F.translate(c, _LONG, _SHORT)).otherwise(F.upper(c)))
    return F.when(text.rlike(f"[{_LONG}]"), F.array_join(each, "")).otherwise(F.upper(text))


def word_tokens(text: Column, least: int = 3) -> Column:
    """Lower-case tokens of letters a-z and underscores with ``least`` characters, in order, repeats kept."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}_]+")
    return F.filter(parts, lambda t: t.rlike(rf"^[a-z_]{{{least},}}$"))


def keywords(text: Column, stop: Sequence[str] = (), least: int = 3) -> Column:
    """Distinct word characters runs of the lower-cased text that aren't stop words, in order."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}_]+")
    kept = F.filter(parts, lambda t: (F.length(t) >= least) & ~t.isin(*stop) if stop else F.length(t) >= least)
    return F.array_distinct(kept)


def has_any(text: Column, aliases: Sequence[str]) -> Column:
    """Whether the lower-cased text has one of the aliases."""
    found = F.lit(False)
    for alias in aliases:
        found = found | F.contains(F.lower(text), F.lit(alias.lower()))
    return found


def matched(text: Column, markers: Mapping[str, Sequence[str]]) -> Column:
    """array<string>: names of the markers that the text has, in the mapping's order."""
    return F.array_compact(F.array(*[F.when(has_any(text, aliases), name) for name, aliases in markers.items()]))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), either.cast("double")), F.lit(0.0))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-cased words, each padded by two blanks in front and one behind."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(
        words,
        lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))),
    )
    return F.array_distinct(F.flatten(grams))


def tokens_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("bigint")


def length_score(text: Column) -> Column:
    n = F.length(text)
    return (
        F.when(n < 10, 0.3).when(n < 100, 0.7).when(n < 500, 1.0).otherwise(F.greatest(F.lit(0.5), 1.0 - (n - 500) / 1000.0))
    )


def optimized_query(text: Column) -> Column:
    """Blanks collapsed, other characters than letters, digits and ``_-/.`` taken out."""
    clean = F.regexp_replace(text, r"\s+", " ")
    clean = F.regexp_replace(clean, r"[^\p{L}\p{N}_\s\-/.]", "")
    return F.trim(F.regexp_replace(clean, r"\s+", " "))


def first_rule(text: Column, rules: Mapping[str, str], default: str) -> Column:
    """Name of the first rule whose regular expression the lower-cased text has."""
    low, out = F.lower(text), None
    for name, pattern in rules.items():
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return F.lit(default) if out is None else out.otherwise(default)


def best_rule(text: Column, words: Mapping[str, Sequence[str]], default: str) -> Column:
    """Struct (name, score) of the class with most of its words in the text: share + 0.3, at most 1; ties to the earlier."""
    low = F.lower(text)
    options = []
    for place, (name, terms) in enumerate(words.items()):
        hits = sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))
        score = F.when(hits > 0, F.least(F.round(hits / len(terms) + 0.3, 6), F.lit(1.0))).otherwise(0.0)
        options.append(F.struct(score.cast("double").alias("score"), F.lit(-place).alias("place"), F.lit(name).alias("name")))
    options.append(F.struct(F.lit(1e-9).alias("score"), F.lit(-99).alias("place"), F.lit(default).alias("name")))
    top = F.array_max(F.array(*options))
    return F.struct(top["name"].alias("name"), F.when(top["name"] == default, 0.5).otherwise(top["score"]).alias("score"))


def sentences(text: Column, longer_than: int = 5) -> Column:
    """Parts that end in a full stop, question or exclamation mark before a blank."""
    marked = F.regexp_replace(text, r"([。！？!?.])\s+", "$1␞")
    return F.filter(F.split(marked, "␞"), lambda s: F.length(s) > longer_than)


def query_complexity(text: Column, simple: Sequence[str], complex_: Sequence[str]) -> Column:
    """0 to 1 from the number of words, less 0.1 for each simple and more for each complex indicator."""
    low = F.lower(text)
    n = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    base = F.when(n <= 3, 0.2).when(n <= 8, 0.5).otherwise(0.7)
    for word in simple:
        base = base - F.when(F.contains(low, F.lit(word)), 0.1).otherwise(0.0)
    for word in complex_:
        base = base + F.when(F.contains(low, F.lit(word)), 0.1).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base)), 6)
