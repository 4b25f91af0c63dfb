"""Column functions: bit offsets, text forms, lookups, detection and alphabet shapes."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of RFC 1952 and of the block format.
OPERATING_SYSTEMS = {
    0: "FAT filesystem (MS-DOS, OS/2, NT/Win32)", 1: "Amiga", 2: "VMS (or OpenVMS)", 3: "Unix", 4: "VM/CMS", 5: "Atari TOS", 6: "HPFS filesystem (OS/2, NT)", 7: "Macintosh", 8: "Z-System", 9: "CP/M",
    10: "TOPS-20", 11: "NTFS filesystem (NT)", 12: "QDOS", 13: "Acorn RISCOS", 255: "unknown",
}
EXTRA_FLAGS = {0: "none", 2: "compressor used maximum compression, slowest algorithm", 4: "compressor used fastest algorithm"}
ZLIB_LEVELS = {0: "fastest algorithm", 1: "fast algorithm", 2: "default algorithm", 3: "maximum compression, slowest algorithm"}
BLOCK_TYPES = {0: "Uncompressed", 1: "Fixed Huffman", 2: "Dynamic Huffman"}
UNITS = ["EiB", "PiB", "TiB", "GiB", "MiB", "KiB"]


def encode_bit_offset(bits: Column) -> Column:
    """struct(byte, n): byte b / 8 and n = 0 on a byte edge, else the next byte and the bits still unused before it."""
    rest = bits % 8
    return F.struct(F.when(rest == 0, F.shiftright(bits, 3)).otherwise(F.shiftright(bits, 3) + 1).alias("byte"), F.when(rest == 0, F.lit(0)).otherwise(8 - rest).cast("int").alias("n"))


def decode_bit_offset(byte: Column, n: Column) -> Column:
    """Inverse of encode_bit_offset; raises where n isn't in 0..7 or bits lie before byte 0."""
    bad = (n < 0) | (n > 7) | ((n > 0) & (byte == 0))
    return F.when(bad, F.raise_error(F.lit("invalid bit offset")).cast("long")).otherwise(byte * 8 - n)


def add_offset(base: Column, delta: Column) -> Column:
    """base + delta; raises where that lies before byte 0 or beyond 64 bits."""
    at = F.try_add(base, delta)
    bad = base.isNotNull() & delta.isNotNull() & (at.isNull() | (at < 0))
    return F.when(bad, F.raise_error(F.lit("position outside the decoded stream")).cast("long")).otherwise(at)


def format_for_index(kind: Column) -> Column:
    """The container that an index of a kind belongs to: BGZF files are gzip files."""
    return F.when(kind == "bgzf", "gzip").otherwise(kind)


def member_header_offset(kind: Column, bits: Column, header_offset: Column) -> Column:
    """Byte of the member header that a checkpoint stands for; raises for one that isn't at a gzip member."""
    other = F.raise_error(F.concat(F.lit("not at a member: "), kind)).cast("long")
    return F.when(kind == "gzip_member_header", F.shiftright(bits, 3)).when(kind == "gzip_member_deflate", header_offset).otherwise(other)


def lookup(code: Column, names: dict[int, str]) -> Column:
    """The name of a code, `undefined (code)` for others."""
    out = F.concat(F.lit("undefined ("), code.cast("string"), F.lit(")"))
    for k, v in names.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def bits_text(n: Column) -> Column:
    return F.format_string("%d B %d b", F.floor(n / 8).cast("long"), (n % 8).cast("long"))


def bytes_text(n: Column, largest: str = "EiB") -> Column:
    """Mixed binary units up to `largest`, without the zero ones; `0 B` for nothing."""
    units = UNITS[UNITS.index(largest) :]
    parts = [(F.shiftright(n, 10 * (len(units) - i)).bitwiseAND(F.lit(1023 if i else -1)), u) for i, u in enumerate(units)] + [(n.bitwiseAND(F.lit(1023)), "B")]
    return F.coalesce(F.nullif(F.concat_ws(" ", *[F.when(v > 0, F.concat(v.cast("string"), F.lit(f" {u}"))) for v, u in parts]), F.lit("")), F.lit("0 B"))


def _printf(form: str) -> Callable[[Column], Column]:
    """C's printf of a double. Java's formatter rounds the shortest decimal form, C the binary value, so ties differ; hence Arrow batches."""

    @F.pandas_udf(T.StringType())
    def text(x: pd.Series) -> pd.Series:
        return x.map(lambda v: form % v, na_action="ignore")

    return lambda x: text(x.cast("double"))


general_text, scientific_text, fixed_text = _printf("%.6g"), _printf("%.6e"), _printf("%.6f")


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part * 100.0 / whole)


def compression_ratio(out_bytes: Column, in_bits: Column) -> Column:
    return F.try_divide(out_bytes.cast("double"), in_bits / 8)


def metric_text(x: Column) -> Column:
    """%.6f, empty for null."""
    return F.coalesce(fixed_text(x), F.lit(""))


def markdown_cell(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, "\\|", "\\\\|"), "[\\r\\n]", " ")


def sanitized(s: Column) -> Column:
    return F.regexp_replace(s, "[\\t\\r\\n]", " ")


def escaped_bytes(b: Column) -> Column:
    """Printable ASCII as it is, every other byte as \\xNN."""
    text = F.hex(b)
    pairs = F.transform(F.sequence(F.lit(1), F.length(text), F.lit(2)), lambda i: F.substring(text, i, F.lit(2)))
    shown = F.transform(pairs, lambda h: F.when((h >= "20") & (h <= "7E"), F.decode(F.unhex(h), "US-ASCII")).otherwise(F.concat(F.lit("\\x"), F.lower(h))))
    return F.when(F.length(b) == 0, "").otherwise(F.array_join(shown, ""))


def bar(count: Column, most: Column, width: int = 20) -> Column:
    return F.expr("repeat('=', 0)") if width == 0 else F.repeat(F.lit("="), F.when(most > 0, F.floor(count * width / most)).otherwise(0).cast("int"))


def output_path(path: Column) -> Column:
    """Without its gz, bgz, zlib or z ending, else with .out appended."""
    cut = F.regexp_replace(path, "(?i)\\.(gz|bgz|zlib|z)$", "")
    return F.when(cut == path, F.concat(path, F.lit(".out"))).otherwise(cut)


def detected_format(content: Column) -> Column:
    """gzip, zlib or null from the first two bytes; raw DEFLATE is never guessed."""
    cmf, flg = (F.conv(F.hex(F.substring(content, i, 1)), 16, 10).cast("int") for i in (1, 2))
    zlib = (cmf % 16 == 8) & (F.shiftright(cmf, 4) <= 7) & ((cmf * 256 + flg) % 31 == 0) & (F.shiftright(flg, 5) % 2 == 0)
    return F.when(F.hex(F.substring(content, 1, 2)) == "1F8B", "gzip").when((F.length(content) >= 2) & zlib, "zlib")


def looks_like_gzi(prefix: Column, file_length: Column) -> Column:
    little = F.concat(*[F.substring(F.hex(prefix), 15 - 2 * i, 2) for i in range(8)])
    count = F.conv(little, 16, 10).cast("decimal(20,0)")
    return count * 16 + 8 == file_length


def used_count(lengths: Column) -> Column:
    return F.size(F.filter(lengths, lambda x: x != 0))


def length_range(lengths: Column) -> Column:
    used = F.filter(lengths, lambda x: x != 0)
    return F.struct(F.array_min(used).alias("least"), F.array_max(used).alias("most"))


def counts_by_length(lengths: Column, most: int = 15) -> Column:
    """How many codes have each length from 1 to `most`."""
    return F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.size(F.filter(lengths, lambda x: x == n)))


def alphabet_text(lengths: Column) -> Column:
    """Used of declared codes, the range of their lengths, and how many have each length that occurs; `unused` for none."""
    r, by = length_range(lengths), counts_by_length(lengths)
    each = F.filter(F.transform(by, lambda k, i: F.when(k > 0, F.concat_ws(":", (i + 1).cast("string"), k.cast("string")))), lambda x: x.isNotNull())
    shown = F.format_string("%d of %d used, lengths %d to %d (%s)", used_count(lengths), F.size(lengths), r["least"], r["most"], F.array_join(each, ", "))
    return F.when(F.coalesce(used_count(lengths), F.lit(0)) > 0, shown).otherwise("unused")


def throughput(decoded_bytes: Column, seconds: Column) -> Column:
    """MiB in a second; null where no time has passed."""
    return F.when(seconds > 0, decoded_bytes / seconds / (1 << 20))
