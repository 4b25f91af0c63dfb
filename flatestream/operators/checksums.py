"""Checksums of ordered chunks: CRC-32 and Adler-32 of parts, combined by length."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POLYNOMIAL, PRIME = 0xEDB88320, 65521


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC polynomial, bits reflected."""
    out = 0
    for i in range(32):
        if b >> (31 - i) & 1:
            out ^= a
        a = a >> 1 ^ (POLYNOMIAL if a & 1 else 0)
    return out


def crc32_combine(first: int, second: int, second_length: int) -> int:
    """CRC-32 of two byte strings in a row: first * x**(8 * length) + second."""
    if not first:
        return second
    power, square, n = 1 << 31, 1 << 30, 8 * second_length
    while n:
        if n & 1:
            power = _times(power, square)
        square, n = _times(square, square), n >> 1
    return _times(first, power) ^ second


def adler32_combine(first: int, second: int, second_length: int) -> int:
    a = (first & 0xFFFF) + (second & 0xFFFF) - 1
    b = (first >> 16) + (second >> 16) + second_length * ((first & 0xFFFF) - 1)
    return b % PRIME << 16 | a % PRIME


def combined_crc32(chunks: DataFrame, keys: list[str], order: str, data: str) -> DataFrame:
    """keys, bytes, crc32 of each group's chunks in order. Chunks are summed up where they are; a task folds one narrow row of each.

    A group without chunks has no row; null chunks count as empty.
    """
    parts = chunks.select(*keys, order, F.crc32(F.coalesce(data, F.lit(b""))).alias("crc"), F.coalesce(F.octet_length(data), F.lit(0)).cast("long").alias("n"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.select(*keys).schema.fields)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, crc, size = None, 0, 0
        for f in frames:
            done = []
            for own, c, n in zip(f[keys].itertuples(index=False, name=None), f["crc"].tolist(), f["n"].tolist(), strict=True):
                if own != group:
                    if group is not None:
                        done.append((*group, size, crc))
                    group, crc, size = own, 0, 0
                crc, size = crc32_combine(crc, c, n), size + n
            yield pd.DataFrame(done, columns=[*keys, "bytes", "crc32"])
        if group is not None:
            yield pd.DataFrame([(*group, size, crc)], columns=[*keys, "bytes", "crc32"])

    return parts.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(fold, f"{schema}, bytes long, crc32 long")
