"""Tokenisers as column expressions. All lower-case first; null text gives an empty array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\p{L}\p{N}_]+"
WORD_OR_UNDERSCORE = r"[^\p{L}\p{N}]+"


def words(text: Column, separator: str = WORD) -> Column:
    """Tokens in order, repeats kept."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), separator), lambda t: t != "")


def tokens(text: Column, exclude: tuple[str, ...] = (), separator: str = WORD) -> Column:
    """Distinct tokens without the excluded keys."""
    found = F.array_distinct(words(text, separator))
    return F.array_except(found, F.array(*map(F.lit, exclude))) if exclude else found


def substrings(text: Column, size: int) -> Column:
    """All substrings of ``size`` characters in order; a shorter text is its own only one."""
    return F.when(F.length(text) < size, F.array(text)).otherwise(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: text.substr(i, F.lit(size))))


def ngrams(text: Column, size: int = 3, padded: bool = True) -> Column:
    """Distinct character n-grams of each token, padded with ``size - 1`` underscores on both sides, or unpadded."""
    pad = "_" * (size - 1)
    grams = lambda t: substrings(F.concat(F.lit(pad), t, F.lit(pad)) if padded else t, size)
    return F.array_distinct(F.flatten(F.transform(tokens(text), grams)))


def extended_ngrams(text: Column, size: int = 3, most_left_out: int | None = None) -> Column:
    """Distinct joined combinations of each token's n-grams: all of ``n``, or with up to ``n - floor(0.95 * n)`` left out.

    That is one up to 20 n-grams, two up to 40, and so on: the combinations grow exponentially with a token's length.
    ``most_left_out`` bounds how many are left out; None, the default, does not.
    """

    def of(token: Column) -> Column:
        return _combined(substrings(token, size), most_left_out)

    return F.array_distinct(F.flatten(F.transform(tokens(text), of)))


def _combined(grams: Column, most_left_out: int | None) -> Column:
    n = F.size(grams)
    none = F.array().cast("array<string>")
    places = F.sequence(F.lit(0), n - 1)
    left_out = n - F.floor(n * F.lit(0.95).cast("decimal(3,2)")).cast("int")
    if most_left_out is not None:
        left_out = F.least(left_out, F.lit(most_left_out))
    join = lambda kept: F.array_join(kept, "")
    one = F.transform(places, lambda i: join(F.filter(grams, lambda _, k: k != i)))

    def wider(found: Column, size: Column) -> Column:
        last = lambda out: F.coalesce(F.get(out, F.size(out) - 1), F.lit(-1))
        longest = F.filter(found, lambda out: F.size(out) == size - 1)
        return F.concat(found, F.flatten(F.transform(longest, lambda out: F.transform(F.filter(places, lambda j: j > last(out)), lambda j: F.array_append(out, j)))))

    # the places left out, by rising number of them; from the second on
    many = F.aggregate(F.sequence(F.lit(2), left_out), F.transform(places, lambda i: F.array(i)), wider)
    two = F.transform(F.filter(many, lambda out: F.size(out) > 1), lambda out: join(F.filter(grams, lambda _, k: ~F.array_contains(out, k))))
    return F.concat(F.array(join(grams)), F.when((n > 1) & (left_out > 0), one).otherwise(none), F.when((n > 20) & (left_out > 1), two).otherwise(none))


def suffixes(text: Column, least: int = 2) -> Column:
    """Distinct suffixes of at least ``least`` characters of each token, or the token itself."""
    of = lambda t: F.when(F.length(t) < least, F.array(t)).otherwise(F.transform(F.sequence(F.lit(1), F.length(t) - least + 1), lambda i: t.substr(i, F.length(t))))
    return F.array_distinct(F.flatten(F.transform(tokens(text), of)))


def extended_suffixes(text: Column, least: int = 2) -> Column:
    """Distinct substrings of at least ``least`` characters of each token, and the token itself."""

    def of(t: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(t) - least + 1, F.lit(1)))
        return F.array_append(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(least), F.greatest(F.length(t) - i + 1, F.lit(least))), lambda n: t.substr(i, n)))), t)

    return F.array_distinct(F.filter(F.flatten(F.transform(tokens(text), of)), lambda s: s != ""))


def keyed_tokens(attributes: Column) -> Column:
    """Distinct ``key_token`` of a bag of attributes (array of ``key, value``)."""
    each = lambda a: F.transform(words(a["value"]), lambda t: F.concat(a["key"], F.lit("_"), t))
    return F.array_distinct(F.flatten(F.transform(attributes, each)))


def keyed_ngrams(attributes: Column, size: int = 3, exclude: tuple[str, ...] = ()) -> Column:
    """Distinct ``key_gram`` of a bag of attributes: n-grams of whole values, lower-cased, spaces as underscores."""
    value = lambda a: F.replace(F.trim(F.lower(a["value"])), F.lit(" "), F.lit("_"))
    held = F.filter(attributes, lambda a: F.coalesce(F.trim(a["value"]) != "", F.lit(False)) & ~a["key"].isin(*exclude))
    each = lambda a: F.transform(substrings(value(a), size), lambda g: F.concat(a["key"], F.lit("_"), g))
    return F.array_distinct(F.flatten(F.transform(held, each)))


def edge_ngrams(text: Column, least: int = 3, most: int = 6) -> Column:
    """Leading substrings of ``least`` to ``most`` characters of each token."""
    of = lambda t: F.transform(F.sequence(F.lit(least), F.least(F.lit(most), F.greatest(F.length(t), F.lit(least)))), lambda n: t.substr(F.lit(1), n))
    return F.flatten(F.transform(words(text), of))


def word_shingles(text: Column, least: int = 2, most: int = 3) -> Column:
    """Runs of ``least`` to ``most`` words, joined by a space."""
    own = words(text)
    runs = lambda n: F.when(F.size(own) >= n, F.transform(F.sequence(F.lit(1), F.size(own) - n + 1), lambda i: F.array_join(F.slice(own, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    return F.concat(*(runs(n) for n in range(least, most + 1)))


def plain_words(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct tokens that are all letters or all digits and no stop words."""
    return F.filter(tokens(text, stop), lambda t: t.rlike("^([A-Za-z]+|[0-9]+)$"))


#: The words that the analyser of English text leaves out.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")

ANALYZERS = {
    "standard": words,
    "standard_stopwords": lambda t: F.filter(words(t), lambda w: ~w.isin(*STOP_WORDS)),
    "shingle": word_shingles,
    "2gram": lambda t: F.flatten(F.transform(words(t), lambda w: substrings(w, 2))),
    "3gram": lambda t: F.flatten(F.transform(words(t), lambda w: substrings(w, 3))),
    "4gram": lambda t: F.flatten(F.transform(words(t), lambda w: substrings(w, 4))),
    "edge_gram": edge_ngrams,
}
