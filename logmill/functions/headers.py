"""Record headers as stored: a JSON array of [name, bytes or null], bytes being an array of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_headers(headers: Column) -> Column:
    """JSON text of ``array<struct<key, value>>``, in order; null for null."""

    def one(h: Column) -> Column:
        digits = F.hex(h["value"])
        size = (F.length(digits) / 2).cast("int")
        numbers = F.transform(F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>")), lambda i: F.conv(F.substr(digits, 2 * i - 1, F.lit(2)), 16, 10))
        value = F.when(h["value"].isNull(), "null").otherwise(F.concat(F.lit("["), F.concat_ws(",", numbers), F.lit("]")))
        # to_json quotes the name; the bare string is what stands between the brackets
        name = F.regexp_replace(F.to_json(F.array(h["key"])), r"^\[|\]$", "")
        return F.concat(F.lit("["), name, F.lit(","), value, F.lit("]"))

    return F.when(headers.isNotNull(), F.concat(F.lit("["), F.concat_ws(",", F.transform(headers, one)), F.lit("]")))


def decode_headers(text: Column) -> Column:
    """``array<struct<key, value>>`` of such a text; what is no JSON gives none.  Of repeated names the last value
    stays, in the place of the first."""
    pairs = F.coalesce(F.from_json(text, "array<array<string>>"), F.array().cast("array<array<string>>"))

    def value(raw: Column) -> Column:
        numbers = F.from_json(raw, "array<int>")
        return F.when(raw.isNotNull(), F.unhex(F.concat_ws("", F.transform(numbers, lambda b: F.lpad(F.hex(b), 2, "0")))))

    named = F.transform(pairs, lambda p: F.struct(F.get(p, 0).alias("key"), value(F.get(p, 1)).alias("value")))
    names = F.array_distinct(F.transform(named, lambda h: h["key"]))
    return F.transform(names, lambda n: F.element_at(F.filter(named, lambda h: h["key"] == n), -1))
