"""Text formats as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventspark.functions.pinning import let
from eventspark.schema import RAW_FIELDS


def numbers(line: Column) -> Column:
    """All numbers of a line; ``;`` counts as a blank."""
    words = F.split(F.trim(F.regexp_replace(line, r"[;\s]+", " ")), " ")
    return F.filter(words, lambda w: w != "").cast("array<double>")


def particles_of_line(line: Column, fields: Sequence[str] = RAW_FIELDS) -> Column:
    """``id x x ...;id x x ...`` -> array of particle structs; a ragged line is an error."""
    width = len(fields)

    def particle(flat, i):
        base = i * width
        return F.struct(*[
            F.get(flat, base + k).cast("bigint" if f == "pdgid" else "double").alias(f)
            for k, f in enumerate(fields)])

    def particles(flat):
        count = F.size(flat)
        message = F.concat(F.lit("malformed event: "), count.cast("string"),
                           F.lit(f" numbers are not divisible by {width}"))
        whole = F.when(count % width == 0, F.floor(count / width).cast("int")).otherwise(
            F.raise_error(message).cast("int"))
        return F.when(count == 0, F.array().cast(_array_type(fields))).otherwise(
            F.transform(F.sequence(F.lit(0), whole - 1), lambda i: particle(flat, i)))

    return let(numbers(line), particles)


def _array_type(fields: Sequence[str]) -> str:
    inner = ",".join(f"{f}:{'bigint' if f == 'pdgid' else 'double'}" for f in fields)
    return f"array<struct<{inner}>>"


def _near_tie(x: Column) -> Column:
    """Whether the shortest digits of a double can round to five decimals otherwise than its exact value."""
    steps = x * 1e5
    return F.abs(F.abs(steps - F.rint(steps)) - 0.5) <= F.abs(steps) * 2.0 ** -51


def five_decimals(x: Column) -> Column:
    """``%.5f`` of the exact binary value, ties to even, as in C; ``format_string`` rounds the shortest digits instead.

    From 2^63 on the digits are those of ``format_string``.
    """
    def scaled(a):  # fraction in units of 2^-32 and a rest; 100,000 times both are exact wherever a tie can be
        part = (a - F.floor(a)) * 2.0 ** 32
        rest = (part - F.floor(part)) * 1e5
        return F.struct(F.floor(a).alias("whole"), (F.floor(part) * 100000 + F.floor(rest)).alias("units"), (rest > F.floor(rest)).alias("more"))

    def rounded(v):
        k, over = F.shiftright(v["units"], 32), v["units"].bitwiseAND(F.lit((1 << 32) - 1))
        up = (over > 1 << 31) | ((over == 1 << 31) & (v["more"] | (k % 2 == 1)))
        return F.struct(v["whole"].alias("whole"), (k + up.cast("long")).alias("k"))

    def text(v):
        carry = (v["k"] == 100000).cast("long")
        return F.concat((v["whole"] + carry).cast("string"), F.lit("."), F.lpad((v["k"] % 100000).cast("string"), 5, "0"))

    sign = F.when(F.startswith(x.cast("string"), F.lit("-")), "-").otherwise("")
    exact = F.concat(sign, let(F.abs(x), lambda a: let(scaled(a), lambda v: let(rounded(v), text))))
    return F.when(F.abs(x) < 2.0 ** 63, exact).otherwise(F.format_string("%.5f", x))


def line_of_particles(particles: Column, fields: Sequence[str] = RAW_FIELDS) -> Column:
    """Array of particle structs -> text: integer id, five decimals, ``;`` after each particle."""
    pattern = " ".join("%d" if f == "pdgid" else "%.5f" for f in fields) + ";"
    decimals = [f for f in fields if f != "pdgid"]

    def line(p):
        exact = F.format_string(pattern.replace("%.5f", "%s"), *[five_decimals(p[f]) if f in decimals else p[f] for f in fields])
        near = reduce(lambda a, b: a | b, [_near_tie(p[f]) for f in decimals])
        return F.when(near, exact).otherwise(F.format_string(pattern, *[p[f] for f in fields]))

    return F.array_join(F.transform(particles, line), "")


def tokens_of_line(line: Column) -> Column:
    return F.filter(F.split(F.trim(line), r"\s+"), lambda w: w != "").cast("array<int>")


def line_of_tokens(tokens: Column) -> Column:
    return F.array_join(tokens.cast("array<string>"), " ")


def millions(text: Column) -> Column:
    """``12.3M`` -> 12300000."""
    return (F.regexp_replace(text, "M", "").cast("double") * 1e6).cast("bigint")
