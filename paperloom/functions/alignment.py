"""Local alignment of word sequences: where in a text something like a sentence stands, and how much of it.

Words that agree gain their weight; a word replaced by another, or left out, loses a part of its own; a word put in between loses a
part of the sentence's mean weight.  Gaps cost, so an alignment stays in a band around its start as wide as the sentence can pay for.
A row of the table is computed at once for the whole text, one row for each word of the sentence, so time is their product and
memory a few rows.
"""

from __future__ import annotations

import numpy as np

#: Shares of a word's weight that a replaced and a left-out word lose, and of the mean weight that a word in between loses.
REPLACED, LEFT_OUT, BETWEEN = 0.5, 0.5, 0.25


def align(sentence: np.ndarray, weight: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Best score and the words [start, stop) of ``text`` it is found at; (0, 0, 0) if nothing agrees.

    ``sentence`` and ``text`` are numbers of words, ``weight`` the positive weights of the sentence's.  Of equal scores the one that
    is complete with the fewest words of the sentence counts, then the one that ends first.
    """
    n = len(text)
    best = (0.0, 0, 0)
    if not len(sentence) or not n or not np.isin(sentence, text).any():
        return best
    between = BETWEEN * float(weight.mean())
    at = np.arange(n + 1)
    score, start = np.zeros(n + 1), at.copy()
    for word, w in zip(sentence.tolist(), weight.tolist(), strict=True):
        step = np.where(text == word, w, -REPLACED * w)
        over, skip = score[:-1] + step, score[1:] - LEFT_OUT * w
        row = np.zeros(n + 1)
        row[1:] = np.maximum(0, np.maximum(over, skip))
        from_ = at.copy()
        from_[1:] = np.where(row[1:] == 0, at[1:], np.where(over >= skip, start[:-1], start[1:]))
        # Words in between: the best cell to the left, less its distance.
        level = row + between * at
        top = np.maximum.accumulate(level)
        origin = np.maximum.accumulate(np.where(level == top, at, 0))
        moved = top - between * at
        far = moved > row
        start = np.where(far, from_[origin], from_)
        score = np.where(far, moved, row)
        stop = int(np.argmax(score))
        if score[stop] > best[0] + 1e-12:
            best = (float(score[stop]), int(start[stop]), stop)
    return best
