"""Column functions for ids, instants and JSON texts. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The characters that count as white space around an id.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITE))


def message_id(c: Column | str) -> Column:
    """The id without surrounding white space and in lower case; null if nothing is left."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def instant(c: Column | str) -> Column:
    """An ISO 8601 text as a timestamp in microseconds; null if it is none."""
    return col(c).try_cast("timestamp")


#: JSON texts in pieces: strings, numbers with an exponent, and what is between them.
_PIECES = r'"(?:[^"\\]|\\.)*"|-?[0-9]+(?:\.[0-9]+)?[eE][+-]?[0-9]+|[^"0-9-]+|[0-9.-]+|.'
_EXPONENT = r"^(-?)([0-9]+)(?:\.([0-9]+))?[eE]\+?(-?[0-9]+)$"


def _without_exponent(number: Column) -> Column:
    """A JSON number with an exponent of up to 38 in plain digits; other texts as they are."""
    sign, whole, part, power = (F.regexp_extract(number, _EXPONENT, i) for i in range(1, 5))
    e = power.try_cast("int")
    whole = F.lpad(whole, F.greatest(F.length(whole), F.lit(1) - e), F.lit("0"))
    part = F.rpad(part, F.greatest(F.length(part), e), F.lit("0"))
    digits, point = F.concat(whole, part), F.length(whole) + e
    front = F.coalesce(F.nullif(F.ltrim(F.substring(digits, F.lit(1), point), F.lit("0")), F.lit("")), F.lit("0"))
    back = F.substring(digits, point + 1, F.length(digits))
    plain = F.concat(sign, front, F.when(back != "", F.concat(F.lit("."), back)).otherwise(""))
    return F.when(F.abs(e) <= 38, plain).otherwise(number)


def canonical_json(c: Column | str) -> Column:
    """One text for all spellings of a JSON value: keys sorted, no spacing, escapes resolved, numbers in plain digits without trailing zeros.

    Null stays null. A text that is no JSON (or has a key twice in an object) stands for itself, marked so that it equals no value.
    Numbers of more than 38 digits count as doubles.
    """
    c = col(c)
    pieces = F.regexp_extract_all(c, F.lit(_PIECES), F.lit(0))
    plain = F.when(c.rlike("[0-9][eE][+-]?[0-9]"), F.array_join(F.transform(pieces, lambda x: F.when(x.rlike(_EXPONENT), _without_exponent(x)).otherwise(x)), "")).otherwise(c)
    return F.coalesce(F.to_json(F.try_parse_json(plain)), F.concat(F.lit("\x00"), c))


def canonical_instant(c: Column | str) -> Column:
    """One text for all spellings of an instant; a text that is no instant stands for itself."""
    c = col(c)
    return F.coalesce(F.unix_micros(instant(c)).cast("string"), F.concat(F.lit("\x00"), c))


def value_hash(*cs: Column) -> Column:
    """128 bits of all columns with their nulls told apart."""
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cs])
    return F.struct(F.xxhash64(nulls, *cs).alias("a"), F.xxhash64(F.lit(7), nulls, *cs).alias("b"))
