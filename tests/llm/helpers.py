"""Plain re-computations and tables of awkward rows."""

from __future__ import annotations

import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _mix_key string, n string, node string, rank int, _salt int"


def words(text):
    return WORD.findall((text or "").translate(ASCII_LOWER))


def crc_mod(value, n):
    return zlib.crc32(str(value).encode()) % n


def awkward(spark, more=()):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, "the cat sat on the mat and looked at the door", "en", "b"), (2, "", "en", "a"), (3, None, None, None), (None, "der hund und die katze im haus am see", "de", "a"),
        (5, "the cat sat on the mat and looked at the door", "en", "b"), (5, "the cat sat on the mat and looked at the door", "en", "b"),
        (7, "long " * 40_000, "en", "c"), (8, "   \n\t ", "fr", "é"), (9, "a", None, "a"), (10, "12345 ... 678", "en", "a"), *more,
    ]
    return spark.createDataFrame([(i, t, g, s, None, "x", "x", "x", 1, 1) for i, t, g, s in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
