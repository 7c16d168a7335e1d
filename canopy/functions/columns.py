"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopy.schema import MODE_TYPES


def bit_length_of(x: Column) -> Column:
    """Bits of a non-negative number; 0 for 0."""
    return F.when(x > 0, F.length(F.bin(x))).otherwise(0)


def ilog2(x: Column) -> Column:
    return bit_length_of(x) - 1


def lowbit(x: Column) -> Column:
    return x.bitwiseAND(-x)


def round_up(x: Column, unit: int) -> Column:
    return F.floor((x + (unit - 1)) / unit).cast("long") * unit if unit & (unit - 1) else (x + (unit - 1)).bitwiseAND(-unit)


def blocks_of(x: Column, bits: int) -> Column:
    """Blocks of 2 ** bits bytes that x bytes need."""
    return F.shiftright(x + ((1 << bits) - 1), bits)


def size_bucket(size: Column, buckets: int = 17) -> Column:
    """Of a histogram by powers of two of KiB; the last bucket is open."""
    return F.least(F.lit(buckets - 1), bit_length_of(F.shiftright(size.cast("long"), 10))).cast("int")


def ftype_of(mode: Column) -> Column:
    kind = mode.bitwiseAND(0xF000)
    out = F.when(kind == 0x8000, 1)
    for bits, number in MODE_TYPES.items():
        if bits != 0x8000:
            out = out.when(kind == bits, number)
    return out.otherwise(0).cast("int")


def access_string(mode: Column) -> Column:
    """rwxrwxrwx."""
    return F.concat(*[F.when(F.shiftright(mode, 8 - i).bitwiseAND(1) == 1, "rwxrwxrwx"[i]).otherwise("-") for i in range(9)])


def encode_rdev(major: Column, minor: Column) -> Column:
    """Packed device number: minor low byte, major, minor's other bits."""
    return minor.bitwiseAND(0xFF).bitwiseOR(F.shiftleft(major, 8)).bitwiseOR(F.shiftleft(minor.bitwiseAND(-256), 12))


def decode_rdev(dev: Column) -> tuple[Column, Column]:
    return F.shiftright(dev, 8).bitwiseAND(0xFFF), dev.bitwiseAND(0xFF).bitwiseOR(F.shiftright(dev, 12).bitwiseAND(0xFFF00))


def normal_path(path: Column) -> Column:
    """Slashes collapsed, `.` dropped, `..` resolved; relative to the root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    kept = F.aggregate(parts, empty, lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(kept, "/")


def ancestors(path: Column) -> Column:
    """All proper prefixes of a path at slashes, the shortest first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def parent_of(path: Column) -> Column:
    """Empty for what lies in the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def extension_of(name: Column) -> Column:
    """From the last dot on; null without a dot."""
    return F.when(F.instr(name, ".") > 0, F.concat(F.lit("."), F.substring_index(name, ".", -1)))


def size_suffix(text: Column) -> Column:
    """4096, 4k, 16M, 1g -> bytes; null for anything else."""
    number = F.regexp_extract(text, r"^(\d+)[kKmMgG]?$", 1)
    unit = F.lower(F.regexp_extract(text, r"^\d+([kKmMgG])$", 1))
    shift = F.when(unit == "k", 1024).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).otherwise(1)
    return F.when(number != "", number.cast("long") * shift)


def pax_time(text: Column) -> tuple[Column, Column]:
    """(seconds, nanoseconds) of a decimal time; both null where it is invalid.

    Further digits than nine are dropped; a negative time with a fraction borrows a second.
    """
    ok = text.rlike(r"^[+-]?\d+(\.\d+)?$")
    whole = F.regexp_extract(text, r"^([+-]?\d+)", 1).cast("long")
    ns = F.rpad(F.substring(F.regexp_extract(text, r"\.(\d+)$", 1), 1, 9), 9, "0").cast("long")
    borrow = text.startswith("-") & (ns > 0)
    return F.when(ok, F.when(borrow, whole - 1).otherwise(whole)), F.when(ok, F.when(borrow, 1000000000 - ns).otherwise(ns)).cast("int")


def octal(text: Column) -> Column:
    """Octal digits, with a sign or none, up to a space or the end; null where there are none."""
    digits = F.regexp_extract(text, r"^\s*(?:\+(?=[0-7]))?(-?[0-7]+)(?: .*)?$", 1)
    return F.when(digits != "", F.conv(digits, 8, -10).cast("long"))


def octal_field(value: Column, digits: int = 7) -> Column:
    """The number as octal text and a space: `digits` digits, more where it has more, after the sign of a negative one."""
    text = F.conv(value.cast("string"), 10, -8)
    bare = F.ltrim(text, F.lit("-"))
    return F.concat(F.when(value < 0, "-").otherwise(""), F.lpad(bare, F.greatest(F.length(bare), F.lit(digits)), F.lit("0")), F.lit(" "))


def uuid_text(raw: Column) -> Column:
    h = F.lower(F.hex(raw))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


#: POSIX character classes in Java's notation.
POSIX_CLASSES = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\s", "punct": r"\p{Punct}", "blank": r" \t", "xdigit": r"\p{XDigit}", "cntrl": r"\p{Cntrl}", "graph": r"\p{Graph}", "print": r"\p{Print}"}


def java_pattern(ere: str) -> str:
    """A POSIX extended regular expression for Java's engine: classes, and backslashes in brackets, which POSIX takes literally."""
    out, i, inside = [], 0, False
    while i < len(ere):
        if not inside and ere[i] == "\\" and i + 1 < len(ere):
            out.append(ere[i : i + 2])
            i += 2
            continue
        if not inside and ere[i] == "[":
            inside = True
            out.append("[")
            i += 1
            if i < len(ere) and ere[i] == "^":
                out.append("^")
                i += 1
            if i < len(ere) and ere[i] == "]":
                out.append(r"\]")
                i += 1
            continue
        if inside:
            end = ere.find(":]", i)
            if ere.startswith("[:", i) and end > 0 and ere[i + 2 : end] in POSIX_CLASSES:
                out.append(POSIX_CLASSES[ere[i + 2 : end]])
                i = end + 2
                continue
            if ere[i] == "]":
                inside = False
            elif ere[i] in "\\[&":
                out.append("\\")
        out.append(ere[i])
        i += 1
    return "".join(out)
