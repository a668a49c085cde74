"""Seeded changes of a token array, to make training pairs: the same row and seed always give the same result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _draw(tokens: Column, seed: int, salt: int, upto: Column) -> Column:
    """A whole number from 0 to below ``upto``, from the tokens."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), tokens), F.greatest(upto, F.lit(1)).cast("long")).cast("int")


def _span(tokens: Column, seed: int, least: int, most: int) -> tuple[Column, Column]:
    size = F.least(least + _draw(tokens, seed, 1, F.lit(most - least + 1)), F.size(tokens))
    return _draw(tokens, seed, 2, F.size(tokens) - size + 1), size


def augment(tokens: Column, operation: str, seed: int = 7, share: float = 0.2) -> Column:
    """One of del, swap, drop_len, drop_sym, drop_same, drop_token, ins; null stays null, empty stays empty.

    del drops one or two neighbours, swap shuffles two to four, drop_len drops all of one token's length, drop_same
    all equal to one, drop_sym all that are neither letters nor digits, drop_token each with a chance of ``share``,
    ins doubles a token elsewhere.
    """
    one = F.try_element_at(tokens, _draw(tokens, seed, 3, F.size(tokens)) + 1)
    start, size = _span(tokens, seed, *((1, 2) if operation == "del" else (2, 4)))
    before, within = F.slice(tokens, F.lit(1), start), F.slice(tokens, start + 1, size)
    after = F.slice(tokens, start + size + 1, F.size(tokens))
    if operation == "del":
        changed = F.concat(before, after)
    elif operation == "swap":
        keyed = F.transform(within, lambda t, i: F.struct(F.xxhash64(F.lit(seed), i, t).alias("h"), t.alias("t")))
        changed = F.concat(before, F.transform(F.array_sort(keyed), lambda x: x["t"]), after)
    elif operation == "drop_len":
        changed = F.filter(tokens, lambda t: F.length(t) != F.length(one))
    elif operation == "drop_same":
        changed = F.filter(tokens, lambda t: t != one)
    elif operation == "drop_sym":
        changed = F.filter(tokens, lambda t: t.rlike(r"[\p{L}\p{N}]"))
    elif operation == "drop_token":
        changed = F.filter(tokens, lambda t, i: F.pmod(F.xxhash64(F.lit(seed), i, t), F.lit(1 << 20)) >= share * (1 << 20))
    elif operation == "ins":
        at = _draw(tokens, seed, 4, F.size(tokens) + 1)
        changed = F.concat(F.slice(tokens, F.lit(1), at), F.array(one), F.slice(tokens, at + 1, F.size(tokens)))
    else:
        raise ValueError(operation)
    return F.when(F.size(tokens) > 0, changed).otherwise(tokens)


def augment_attributes(attributes: Column, operation: str, seed: int = 7) -> Column:
    """drop_col: without one attribute; append_col: one attribute's value put behind another's and left out itself."""
    n = F.size(attributes)
    out = _draw(attributes, seed, 5, n)
    rest = F.filter(attributes, lambda a, i: i != out)
    if operation == "drop_col":
        return F.when(n > 1, rest).otherwise(attributes)
    if operation != "append_col":
        raise ValueError(operation)
    to, gone = _draw(attributes, seed, 6, n - 1), F.try_element_at(attributes, out + 1)["value"]
    joined = F.transform(rest, lambda a, i: F.struct(a["key"].alias("key"), F.when(i == to, F.concat_ws(" ", a["value"], gone)).otherwise(a["value"]).alias("value")))
    return F.when(n > 1, joined).otherwise(attributes)
