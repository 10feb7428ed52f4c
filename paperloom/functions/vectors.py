"""Vector arithmetic on array<float> columns, in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    scaled = lambda x: F.transform(x["v"], lambda y: y.cast("double") / F.when(x["n"] == 0, 1.0).otherwise(x["n"]))
    return _let(a, lambda v: _let(F.struct(v.alias("v"), norm(v).alias("n")), scaled))


def _letter(digest: Column, dim: int) -> Column:
    """One letter for a word's place and sign; ``dim`` divides 256, so the third and fourth hex digits tell the place."""
    figures = F.lit("0123456789abcdef")
    figure = lambda at: F.instr(figures, F.substring(digest, at, 1)) - 1
    place = (figure(3) * 16 + figure(4)) % dim
    return F.char(place + F.when(F.substring(digest, 5, 1) < "8", 0).otherwise(dim))


def hashed_counts(text: Column, dim: int = 64) -> Column:
    """array<int>: signed feature hashing of words (letters and digits, lower case).

    A word's MD5 digest says where it counts (the first four hex digits, modulo ``dim``) and its sign (the fifth).  For dimensions
    that are powers of two up to 64 every word becomes a letter, and letters are counted by what the text of them loses without one.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    digest = F.transform(words, lambda w: F.md5(w.cast("binary")))
    if 64 % dim == 0:
        letters = F.array_join(F.transform(digest, lambda h: _letter(h, dim)), "")
        without = lambda x, k: F.octet_length(F.replace(x, F.lit(chr(k)), F.lit("")))
        return _let(letters, lambda x: F.array(*(without(x, dim + k) - without(x, k) for k in range(dim))))
    spots = F.transform(digest, lambda h: F.struct((F.conv(F.substring(h, 1, 4), 16, 10).cast("int") % dim).alias("k"), F.when(F.substring(h, 5, 1) < "8", 1).otherwise(-1).alias("s")))
    count = lambda acc, x: F.concat(F.slice(acc, 1, x["k"]), F.array(F.get(acc, x["k"]) + x["s"]), F.slice(acc, x["k"] + 2, dim))
    return F.aggregate(spots, F.array_repeat(F.lit(0), dim), count)


def hashed(text: Column, dim: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: ``hashed_counts`` at unit length."""
    return normalised(hashed_counts(text, dim))
