"""Group-wise symmetric 4-bit quantization of vector columns, and its error report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspark.language import QUANT_GROUP

SMALLEST_SCALE = 1e-8
LEVELS = 7
GROUPS = "array<struct<scale:double,codes:array<tinyint>>>"
HALF_GROUPS = "array<struct<bits:int,codes:array<tinyint>>>"
HALF_INFINITY = 31 << 10


def quantize(vector: Column, group: int = QUANT_GROUP) -> Column:
    """`array<struct<scale, codes>>`, one per `group` values: scale = max|w| / 7, codes 1..15.

    Rounds half to even. A length that is no multiple of `group` is an error.
    """

    def grouped(values: Column) -> Column:
        def one(start: Column) -> Column:
            part = F.slice(values, start, group)
            top = F.array_max(F.transform(part, lambda w: F.abs(w)))
            scale = F.greatest(top / LEVELS, F.lit(SMALLEST_SCALE))
            return F.transform(F.array(scale), lambda s: F.struct(s.alias("scale"), coded(part, s)))[0]

        whole = F.transform(F.sequence(F.lit(1), F.size(values), F.lit(group)), one)
        message = F.format_string(f"%d values are no multiple of {group}", F.size(values))
        return (
            F.when(F.size(values) == 0, F.array().cast(GROUPS))
            .when(F.size(values) % group == 0, whole)
            .otherwise(F.raise_error(message).cast(GROUPS))
        )

    def coded(part: Column, scale: Column) -> Column:
        def code(w: Column) -> Column:
            step = F.greatest(F.lit(-7.0), F.least(F.lit(7.0), F.rint(w / scale)))
            return (step + LEVELS + 1).cast("tinyint")

        return F.transform(part, code).alias("codes")

    return F.transform(F.array(vector.cast("array<double>")), grouped)[0]


def half(x: Column) -> Column:
    """`struct<bits, value>`: the IEEE half-precision number nearest to `x`, ties to even.

    `x` is not negative. What rounds to more than the largest half number, 65,504, is infinite.
    """

    def rounded(unit: Column) -> Column:
        steps = F.rint(unit.x / F.pow(F.lit(2.0), unit.e - 10))
        bits = ((unit.e + 14) * 1024 + steps).cast("int")
        fits = bits < HALF_INFINITY
        return F.struct(
            F.when(fits, bits).otherwise(HALF_INFINITY).alias("bits"),
            F.when(fits, steps * F.pow(F.lit(2.0), unit.e - 10))
            .otherwise(F.lit(float("inf")))
            .alias("value"),
        )

    def exponent(v: Column) -> Column:
        # the logarithm may be off by one next to a power of two
        guess = F.floor(F.log2(v)).cast("double")
        low = F.when(F.pow(F.lit(2.0), guess) > v, guess - 1).otherwise(guess)
        e = F.when(F.pow(F.lit(2.0), low + 1) <= v, low + 1).otherwise(low)
        return F.struct(
            v.alias("x"), F.greatest(F.coalesce(e, F.lit(-14.0)), F.lit(-14.0)).alias("e")
        )

    number = F.transform(F.array(x.cast("double")), exponent)
    return F.transform(number, rounded)[0]


def stored_vector(vector: Column, group: int = QUANT_GROUP) -> Column:
    """`struct<packed, scales>` as weight files hold a vector: half a byte per value, and two bytes
    (half precision, low byte first) per group of values.

    The scale is rounded to half precision *before* the values are divided by it, in single
    precision as there. A group whose scale rounds to zero has code 8, zero, for all its values;
    one whose scale is beyond half precision is an error.
    """

    def one(part: Column) -> Column:
        top = F.array_max(F.transform(part, lambda w: F.abs(w))).cast("double") / LEVELS
        scale = half(F.greatest(top, F.lit(SMALLEST_SCALE)).cast("float"))
        return F.transform(F.array(scale), lambda s: F.struct(checked(s), codes(part, s)))[0]

    def checked(scale: Column) -> Column:
        message = F.lit("values beyond 7 * 65,504 have no scale in half precision")
        fits = scale.bits < HALF_INFINITY
        return F.when(fits, scale.bits).otherwise(F.raise_error(message).cast("int")).alias("bits")

    def codes(part: Column, scale: Column) -> Column:
        def code(w: Column) -> Column:
            quotient = F.try_divide(w.cast("double"), scale.value).cast("float")
            step = F.greatest(F.lit(-7.0), F.least(F.lit(7.0), F.rint(F.coalesce(quotient, F.lit(0.0)))))
            return (step + LEVELS + 1).cast("tinyint")

        return F.transform(part, code).alias("codes")

    def whole(values: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(values), F.lit(group))
        message = F.format_string(f"%d values are no multiple of {group}", F.size(values))
        return (
            F.when(F.size(values) == 0, F.array().cast(HALF_GROUPS))
            .when(
                F.size(values) % group == 0,
                F.transform(starts, lambda at: one(F.slice(values, at, group))),
            )
            .otherwise(F.raise_error(message).cast(HALF_GROUPS))
        )

    def low_first(g: Column) -> Column:
        return F.concat(_two_digits(g.bits % 256), _two_digits(F.floor(g.bits / 256)))

    def as_bytes(groups: Column) -> Column:
        pairs = F.transform(
            groups, lambda g: F.array_join(F.transform(pack_codes(g.codes), _two_digits), "")
        )
        return F.struct(
            F.unhex(F.array_join(pairs, "")).alias("packed"),
            F.unhex(F.array_join(F.transform(groups, low_first), "")).alias("scales"),
        )

    groups = F.transform(F.array(vector.cast("array<float>")), whole)
    return F.when(vector.isNotNull(), F.transform(groups, as_bytes)[0])


def _two_digits(byte: Column) -> Column:
    return F.lpad(F.hex(byte.cast("long")), 2, "0")


def loaded_vector(stored: Column, group: int = QUANT_GROUP) -> Column:
    """`array<float>`: the values of `stored_vector`."""

    def number(digits: Column, at: Column, n: int) -> Column:
        return F.conv(F.substring(digits, at, n), 16, 10).cast("int")

    def scale(digits: Column, at: Column) -> Column:
        bits = number(digits, at, 2) + number(digits, at + 2, 2) * 256
        e = F.greatest(F.floor(bits / 1024).cast("int"), F.lit(1))
        return (bits - (e - 1) * 1024) * F.pow(F.lit(2.0), e - 25)

    def value(packed: Column, scales: Column, i: Column) -> Column:
        # the even place is in the lower four bits, hence the second digit of its byte
        digit = number(packed, i + 2 - (i % 2) * 2, 1)
        at = F.floor(i / group).cast("int") * 4 + 1
        return ((digit - (LEVELS + 1)) * scale(scales, at)).cast("float")

    def values(s: Column) -> Column:
        places = F.sequence(F.lit(0), F.length(s.packed) - 1)
        return F.when(F.length(s.packed) == 0, F.array().cast("array<float>")).otherwise(
            F.transform(places, lambda i: value(s.packed, s.scales, i))
        )

    digits = F.struct(F.hex(stored["packed"]).alias("packed"), F.hex(stored["scales"]).alias("scales"))
    return F.when(stored.isNotNull(), F.transform(F.array(digits), values)[0])


def pack_codes(codes: Column) -> Column:
    """Two codes per byte, the even place in the lower four bits."""
    pairs = F.sequence(F.lit(0), F.size(codes) - 2, F.lit(2))
    return F.transform(
        pairs,
        lambda i: (F.get(codes, i).cast("int") + F.get(codes, i + 1).cast("int") * 16).cast(
            "smallint"
        ),
    )


def packed_groups(groups: Column) -> Column:
    """`array<struct<scale, codes>>` with half a byte per code, for storing."""

    def as_bytes(codes: Column) -> Column:
        pairs = F.transform(pack_codes(codes), lambda b: F.lpad(F.hex(b), 2, "0"))
        return F.unhex(F.array_join(pairs, ""))

    return F.transform(
        groups, lambda g: F.struct(g.scale.alias("scale"), as_bytes(g.codes).alias("codes"))
    )


def unpacked_groups(packed: Column) -> Column:
    """`quantize`'s groups from `packed_groups`."""

    def as_codes(codes: Column) -> Column:
        digits = F.hex(codes)
        places = F.sequence(F.lit(1), F.length(digits), F.lit(2))
        value = lambda at: F.conv(F.substring(digits, at, 1), 16, 10).cast("tinyint")
        return F.flatten(F.transform(places, lambda i: F.array(value(i + 1), value(i))))

    return F.transform(
        packed, lambda g: F.struct(g["scale"].alias("scale"), as_codes(g["codes"]).alias("codes"))
    )


def dequantize(groups: Column) -> Column:
    """Values of `quantize`'s groups."""
    return F.flatten(
        F.transform(
            groups,
            lambda g: F.transform(g.codes, lambda q: (q.cast("double") - (LEVELS + 1)) * g.scale),
        )
    )


def vector_quantize(vectors: DataFrame, column: str, group: int = QUANT_GROUP) -> DataFrame:
    """Adds `groups`, the 4-bit form of `column`."""
    return vectors.withColumn("groups", quantize(F.col(column), group))


def quantization_error(
    vectors: DataFrame, column: str, by: Sequence[str] = (), group: int = QUANT_GROUP
) -> DataFrame:
    """Largest and mean absolute error, the largest error in steps, and bytes before and after.

    A value takes four bytes before; after, its group's packed codes and scale are counted as
    `packed_groups` makes them.
    """
    steps = F.flatten(
        F.transform("groups", lambda g: F.array_repeat(g["scale"], F.size(g["codes"])))
    )
    packed = F.transform(packed_groups(F.col("groups")), lambda g: F.octet_length(g["codes"]) + 8)
    errors = (
        vector_quantize(vectors, column, group)
        .withColumn("back", dequantize(F.col("groups")))
        .withColumn(
            "err",
            F.zip_with(F.col(column).cast("array<double>"), "back", lambda a, b: F.abs(a - b)),
        )
        .select(
            *by,
            F.size("err").alias("values"),
            F.array_max("err").alias("worst"),
            F.aggregate("err", F.lit(0.0), lambda s, e: s + e).alias("total"),
            F.array_max(F.zip_with("err", steps, lambda e, s: e / s)).alias("worst_steps"),
            F.aggregate(packed, F.lit(0), lambda s, n: s + n).alias("stored"),
        )
    )
    values = F.sum("values")
    return errors.groupBy(*by).agg(
        F.count("*").alias("vectors"),
        F.max("worst").alias("max_abs_error"),
        (F.sum("total") / values).alias("mean_abs_error"),
        F.max("worst_steps").alias("max_error_steps"),
        (4 * values).alias("bytes_before"),
        F.sum("stored").alias("bytes_after"),
    )
