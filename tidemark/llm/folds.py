"""Which rows may be learned from, and byte classes shared by the text models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .textops import byte_class

FOLDS = 5


def held_out(id_col: str) -> Column:
    """Rows whose crc32 of the id as text is divisible by five are never learned from (a null id is held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


#: ASCII letters and every byte of other scripts.
LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Symbols of the character models: 0 for what is no letter, 1-26, then each byte from 0x80.
N_SYMBOLS = 27 + 128
SYMBOL = np.zeros(256, np.int64)
SYMBOL[0x61:0x7B] = np.arange(1, 27)
SYMBOL[0x41:0x5B] = np.arange(1, 27)
SYMBOL[0x80:] = np.arange(27, N_SYMBOLS)


def fold_case(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the Latin letters U+00C0 to U+00DE."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[latin] += 32
    return out


def trigram_codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code of the three symbols that end at each byte; a document begins after two blanks."""
    s = SYMBOL[data]
    p1 = np.concatenate(([0], s[:-1]))
    p1[offsets[:-1][offsets[:-1] < len(s)]] = 0
    p2 = np.concatenate(([0], p1[:-1]))
    p2[offsets[:-1][offsets[:-1] < len(s)]] = 0
    p2[p1 == 0] = 0
    return (p2 * N_SYMBOLS + p1) * N_SYMBOLS + s
