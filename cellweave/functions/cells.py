"""Packed cell keys: the document in the upper, the sentence in the lower 32 bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(document: Column, sentence: Column) -> Column:
    return F.shiftleft(document.cast("long"), 32).bitwiseOR(sentence.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def document_of(key: Column) -> Column:
    return F.shiftright(key, 32)


def sentence_of(key: Column) -> Column:
    """Null where the lower half is negative as a 32-bit number."""
    low = key.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(low < 1 << 31, low.cast("int"))
