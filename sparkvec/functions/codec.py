"""Value codecs as expressions: what a value is after it has been stored in a narrower type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkvec.schema import Codec


def _binary_float(x: Column, digits: int, least: int, largest: float) -> Column:
    """Rounded to `digits` fraction bits, ties to even; subnormal below 2**least, infinite beyond `largest`."""
    unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))).cast("double"), F.lit(float(least))) - F.lit(float(digits)))
    rounded = F.rint(x / unit) * unit
    return F.when(x == 0, F.lit(0.0)).when(F.abs(rounded) > F.lit(largest), F.signum(x) * F.lit(float("inf"))).otherwise(rounded)


def _fixed(x: Column, bits: int, fraction: int) -> Column:
    """Unsigned fixed point: negative values become 0, large ones the largest."""
    return F.greatest(F.lit(0.0), F.least(F.lit(float((1 << bits) - 1)), F.rint(x * F.lit(float(1 << fraction))))) / F.lit(float(1 << fraction))


def store(x: Column, codec: Codec | str) -> Column:
    """x as a float (a double for f64) with the value that the codec keeps of it; all values pass through 32-bit floats."""
    codec = Codec(codec)
    x = x.cast("float")
    wide = x.cast("double")
    if codec is Codec.F32:
        return x
    if codec is Codec.F64:
        return wide
    if codec is Codec.F16:
        return _binary_float(wide, 10, -14, 65504.0).cast("float")
    if codec is Codec.BF16:
        return _binary_float(wide, 7, -126, 3.3895313892515355e38).cast("float")
    if codec is Codec.FIXEDU8:
        return _fixed(wide, 8, 6).cast("float")
    return _fixed(wide, 16, 13).cast("float")


def store_all(vector: Column, codec: Codec | str) -> Column:
    return F.transform(vector, lambda v: store(v, codec))


def store_tokens(tokens: Column, codec: Codec | str) -> Column:
    return F.transform(tokens, lambda t: store_all(t, codec))
