"""Counts over one whole text that the quality operators share."""

from __future__ import annotations

import numpy as np

SPACES = [0x20, *range(0x09, 0x0E)]
SYMBOLS = list(b"#*$%&|<>")
#: The counts in the order of ``counts``.
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_exclaim", "n_digits", "n_stops", "n_bars", "n_brackets", "n_distinct", "n_bytes"]


def _cubes(ids: np.ndarray, size: int) -> np.ndarray:
    """A number for each window of three words, equal for equal windows."""
    if size < 2_000_000:
        return (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
    return pairs[:-1] * size + ids[2:]


def repeat_words(words: list[bytes]) -> tuple[int, int]:
    """Words that stand in a three-word window found twice or more, and the number of different words."""
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], dtype=np.int64)
    if len(ids) < 4:
        return 0, len(index)
    keys = _cubes(ids, len(index))
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0, len(index)
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(twice)] |= twice
    return int(covered.sum()), len(index)


def counts(text: bytes) -> list[int]:
    """The counts of ``NAMES``.  Words are runs without ASCII white space; characters are code points."""
    seen = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    words = text.split()
    repeats, distinct = repeat_words(words)
    lines = text.split(b"\n")
    dup = 0
    if len(lines) > 1:
        before: set[bytes] = set()
        for line in lines:
            if line and not line.isspace():
                dup += line in before
                before.add(line)
        n_lines = sum(1 for x in lines if x and not x.isspace())
    else:
        n_lines = int(bool(words))
    points = int(seen[:128].sum() + seen[192:].sum())
    upper, lower, high = int(seen[65:91].sum()), int(seen[97:123].sum()), int(seen[192:].sum())
    return [
        len(words), points - int(seen[SPACES].sum()), int(seen[SYMBOLS].sum()), dup, repeats, n_lines, upper, upper + lower + high,
        int(seen[33]), int(seen[48:58].sum()), int(seen[[44, 46]].sum()), int(seen[124]), int(seen[[40, 41, 91, 93, 123, 125]].sum()), distinct, len(text),
    ]
