"""Byte classes used by the text features (ASCII only; bytes from 0x80 count as letters)."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
LOWER = np.zeros(256, bool)
LOWER[0x61:0x7B] = True
HIGH = np.zeros(256, bool)
HIGH[0x80:] = True
LETTER = UPPER | LOWER | HIGH
PUNCT = ~(SPACE | DIGIT | LETTER)

#: Byte -> lower-case letter byte, or a space for everything else.
LETTERS_ONLY = np.where(LETTER, np.arange(256), 0x20).astype(np.uint8)
LETTERS_ONLY[0x41:0x5B] += 0x20
