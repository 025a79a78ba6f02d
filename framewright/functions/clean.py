"""Column expressions that bring dirty manifest fields to one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NOT_PLAIN = r"\\|//|/$|(^|/)\.\.?(/|$)|^[\p{IsWhite_Space}]|[\p{IsWhite_Space}]$"
_EDGE_BLANKS = r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$"


def strip(c: Column) -> Column:
    """c without white space (of any script) at either end."""
    return F.regexp_replace(c, _EDGE_BLANKS, "")


def label_key(c: Column) -> Column:
    """Labels agree if they agree without case, blanks, '_' and '-'. A label of nothing else is null."""
    return F.nullif(F.lower(F.regexp_replace(c, r"[\p{IsWhite_Space}_\-]", "")), F.lit(""))


def split_key(c: Column) -> Column:
    """train, val or test; 'valid' and 'validation' mean val; anything else is null."""
    s = F.lower(strip(c))
    return F.when(s.isin("train", "val", "test"), s).when(s.isin("valid", "validation"), F.lit("val"))


def hash64(c: Column) -> Column:
    """The signed 64-bit value of a hexadecimal hash, or null where it is not one.

    Blanks around, case and 0x are removed; 1 to 16 hex digits must be left (zeros added in front);
    the value zero, words and hashes of another length are null.
    """
    h = F.regexp_replace(F.lower(strip(c)), "^0x", "")
    full = F.lpad(h, 16, "0")
    half = lambda at: F.conv(F.substring(full, at, 8), 16, 10).cast("bigint")
    value = F.shiftleft(half(1), 32).bitwiseOR(half(9))
    return F.when(h.rlike("^[0-9a-f]{1,16}$") & (value != 0), value)


def file_name(c: Column) -> Column:
    """One spelling of a file: blanks around, back slashes, doubled slashes and dot segments resolved.

    Letter case is kept. Null, empty and blank names are null.
    """
    plain = F.translate(strip(c), "\\", "/")
    parts = F.filter(F.split(plain, "/"), lambda x: (x != "") & (x != "."))
    step = lambda acc, x: F.when(
        (x == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."),
        F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
    ).otherwise(F.concat(acc, F.array(x)))
    folded = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    resolved = F.when(plain.startswith("/"), F.concat(F.lit("/"), folded)).otherwise(folded)
    # most names are plain already, and folding costs ten times a look at them
    return F.nullif(F.when(c.rlike(_NOT_PLAIN), resolved).otherwise(c), F.lit(""))


def usable_score(c: Column) -> Column:
    """A score that is neither null, NaN nor negative (-1 stands for 'not scored'); else null."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (c >= 0), c)
