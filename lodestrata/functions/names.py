"""Names, words and scores of matches, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a requirement that are no keywords.
STOP_WORDS = ("the", "and", "for", "with", "this", "that", "from", "import")


def normalize(c: Column) -> Column:
    """camelCase, kebab-case and spaces to snake_case, repeated underscores collapsed, outer ones trimmed."""
    s = F.regexp_replace(c, r"([A-Z]+)([A-Z][a-z])", r"$1_$2")
    s = F.regexp_replace(s, r"([a-z0-9])([A-Z])", r"$1_$2")
    s = F.regexp_replace(F.lower(s), r"[\s\-_]+", "_")
    return F.regexp_replace(s, r"^_+|_+$", "")


def words(c: Column) -> Column:
    return F.filter(F.split(normalize(c), "_"), lambda w: w != "")


def match_score(query: str, name: Column) -> Column:
    """1 for equality, .95 after normalisation, .7 substring, .6 normalised substring, .5 all words, .3 times the share of words; else 0."""
    q = F.lit(query)
    ql, nl, qn, nn = F.lower(q), F.lower(name), normalize(q), normalize(name)
    qw, nw = F.array_distinct(words(q)), F.array_distinct(words(name))
    both = F.size(F.array_intersect(qw, nw))
    s = F.when(nl == ql, 1.0).when(nn == qn, 0.95).when(nl.contains(ql), 0.7).when(nn.contains(qn), 0.6)
    s = s.when((F.size(qw) > 0) & (F.size(F.array_except(qw, nw)) == 0), 0.5).when(both > 0, 0.3 * both / F.size(qw))
    return F.coalesce(s.otherwise(0.0), F.lit(0.0))


def keywords(text: Column) -> Column:
    """Capitalised and CamelCase words, snake_case words and back-ticked ones, longer than two, without stop words, each once."""
    camel = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])([A-Z][a-z]+(?:[A-Z][a-z]+)*)(?![A-Za-z0-9_])"), 1)
    snake = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])([a-z]+_[a-z_]+)(?![A-Za-z0-9_])"), 1)
    ticked = F.regexp_extract_all(text, F.lit(r"`([^`\n]+)`"), 1)
    found = F.array_distinct(F.concat(camel, snake, ticked))
    return F.filter(found, lambda w: (F.length(w) > 2) & ~F.lower(w).isin(*STOP_WORDS))


def tokens_estimate(text: Column) -> Column:
    """A quarter of the characters."""
    return F.floor(F.length(text) / 4).cast("long")


def module_of(path: Column) -> Column:
    """Dotted module name of a source path, without extension and __init__."""
    s = F.regexp_replace(path, r"\.[^./]+$", "")
    return F.regexp_replace(F.regexp_replace(s, "/", "."), r"\.__init__$", "")
