"""Folding of Turkish letters, as plain Python for vectorised steps and as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII = str.maketrans("çÇğĞıİöÖşŞüÜâÂîÎûÛ", "cCgGiIoOsSuUaAiIuU")


def lower(x: str) -> str:
    """Lower case in Turkish: İ to i, I to ı."""
    return x.replace("İ", "i").replace("I", "ı").lower()


CODE_PAGE = "cp1254"  # one byte a character; texts with others take the way by characters


def _table() -> bytes:
    """`plain` for each byte of the code page."""
    out = bytearray(range(256))
    for b in range(256):
        new = lower(bytes([b]).decode(CODE_PAGE, "ignore")).translate(ASCII).encode(CODE_PAGE, "ignore")
        out[b] = new[0] if len(new) == 1 else b
    return bytes(out)


PLAIN = _table()


def plain(x: str) -> str:
    """Lower case without Turkish marks; i and ı fall together."""
    try:
        return x.encode(CODE_PAGE).translate(PLAIN).decode(CODE_PAGE)
    except UnicodeError:
        return lower(x).translate(ASCII)


def fold(c: Column) -> Column:
    """Lower case in Turkish."""
    return F.lower(F.translate(c, "İI", "iı"))


def fold_dotless(c: Column) -> Column:
    """Lower case in which i and ı fall together."""
    return F.translate(fold(c), "ı", "i")


def upper(c: Column) -> Column:
    """Upper case in Turkish: i to İ, ı to I."""
    return F.upper(F.translate(c, "iı", "İI"))


def ascii_fold(c: Column) -> Column:
    """The twelve Turkish letters without their marks."""
    return F.translate(c, "çğıöşüÇĞİÖŞÜ", "cgiosuCGIOSU")
