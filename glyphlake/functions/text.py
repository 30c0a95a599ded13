"""Strings of PDF files as column expressions: hexadecimal tokens, characters and text strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space between the parts of a token line.
_SPACE = " \t\r\n\f"


def hex_tokens(line: Column) -> Column:
    """The digits of all ``<...>`` tokens of a line, invalid ones left out, of even length."""
    raw = F.regexp_extract_all(line, F.lit("<([^>]*)>"), F.lit(1))
    good = F.filter(F.transform(raw, lambda t: F.btrim(t, F.lit(_SPACE))), lambda t: t.rlike("^[0-9A-Fa-f]+$"))
    return F.transform(good, lambda t: F.when(F.length(t) % 2 == 1, F.concat(F.lit("0"), t)).otherwise(t))


def hex_number(digits: Column) -> Column:
    """The big-endian value of up to seven bytes of digits; null where 64 bits do not hold it."""
    short = F.ltrim(digits, F.lit("0"))
    return F.when(F.length(short) <= 16, F.conv(digits, 16, 10)).try_cast("bigint")


def code_point(n: Column) -> Column:
    """The character of a code point; null for surrogates and values outside Unicode."""
    good = (n >= 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    wide = n - 0x10000
    units = F.when(n < 0x10000, F.lpad(F.hex(n), 4, "0")).otherwise(F.concat(F.hex(F.lit(0xD800) + F.shiftright(wide, 10)), F.hex(F.lit(0xDC00) + wide.bitwiseAND(F.lit(0x3FF)))))
    return F.when(good, F.decode(F.unhex(units), "UTF-16BE"))


def hex_character(digits: Column) -> Column:
    """One byte, a UTF-16 unit, a surrogate pair or a 4-byte code point; null for others."""
    n, size = hex_number(digits), F.length(digits)
    high, low = F.shiftright(n, 16), n.bitwiseAND(F.lit(0xFFFF))
    pair = high.between(0xD800, 0xDBFF) & low.between(0xDC00, 0xDFFF)
    joined = F.lit(0x10000) + F.shiftleft(high - 0xD800, 10) + (low - 0xDC00)
    return F.when(size.isin(2, 4), code_point(n)).when(size == 8, code_point(F.when(pair, joined).otherwise(n)))


def pdf_string(b: Column) -> Column:
    """The text of string bytes: sound UTF-16 with a byte-order mark, else UTF-8, else Latin-1."""
    digits, rest = F.hex(b), F.substring(b, 3, 1 << 30)
    # whole units only, high surrogates before low ones
    utf16 = digits.rlike("^FEFF(?:(?!D[89A-F])[0-9A-F]{4}|D[89AB][0-9A-F]{2}D[C-F][0-9A-F]{2})*+$")
    return F.when(utf16, F.decode(rest, "UTF-16BE")).when(F.is_valid_utf8(b.cast("string")), b.cast("string")).otherwise(F.decode(b, "ISO-8859-1"))


def trimmed_real(v: Column) -> Column:
    """A number with four decimals, its last zeros and a bare point removed."""
    return F.regexp_replace(F.format_string("%.4f", v.cast("double")), r"\.?0+$", "")


def placeholder(glyph_id: Column) -> Column:
    """What stands for a glyph without a character: its number in brackets."""
    digits = F.hex(glyph_id)
    return F.concat(F.lit("["), F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits), F.lit("]"))
