"""What a word is, for operators that compare texts by their words.

Words are runs of letters and digits of a text in lower case; a Chinese or Japanese character is a word of its own. Marks,
spaces and full-width marks part words, whatever script they come from."""

import numpy as np

_U = np.uint64
_FACTOR = _U(0xD1342543DE82EF95)
# Blocks of Unicode.
_WIDE_MARKS = ((0x30FB, 0x30FB), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))
_IDEOGRAPHS = ((0x3041, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_MARKS = ((0x2000, 0x206F), (0x3000, 0x303F), *_WIDE_MARKS)
_LETTERS = ((48, 57), (65, 90), (97, 122), (0xC0, 0x10FFFF))
OTHER, LETTER, ALONE = 0, 1, 2
_made: list[np.ndarray] = []
_powers = [np.multiply.accumulate(np.full(4096, _FACTOR, "u8"))]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    return (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)


def _kinds() -> np.ndarray:
    """OTHER, LETTER or ALONE for each code point; made once a process."""
    if not _made:
        kinds = np.zeros(0x110000, "u1")
        for kind, ranges in ((LETTER, _LETTERS), (ALONE, _IDEOGRAPHS), (OTHER, _MARKS)):
            for a, b in ranges:
                kinds[a : b + 1] = kind
        _made.append(kinds)
    return _made[0]


def find_words(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words' first code points, and a hash of each word, of which every place of a word has its own factor."""
    kinds = _kinds()[code]
    first = np.flatnonzero((kinds == ALONE) | ((kinds == LETTER) & (np.append(OTHER, kinds[:-1]) != LETTER)))
    if not len(first):
        return first, np.zeros(0, "u8")
    inside = np.flatnonzero(kinds)
    starts = np.searchsorted(inside, first)
    sizes = np.diff(np.append(starts, len(inside)))
    if sizes.max() > len(_powers[0]):
        _powers[0] = np.multiply.accumulate(np.full(int(sizes.max()), _FACTOR, "u8"))
    values = (code[inside].astype("u8") + _U(1)) * _powers[0][inside - np.repeat(first, sizes)]
    return first, mix(np.add.reduceat(values, starts))
