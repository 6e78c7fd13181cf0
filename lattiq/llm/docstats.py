"""Statistics of whole documents, a run of documents at a time."""

from __future__ import annotations

import numpy as np

from . import textscan as T

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True
_HEAD = np.ones(256, bool)
_HEAD[128:192] = False
U64 = np.uint64


def per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each document's stretch."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _own(hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For values told apart by document: (index of each one's kind, size of each kind)."""
    _, back, times = np.unique(T.mix(hashes ^ (of.astype(np.uint64) * U64(0x9E3779B97F4A7C15) + U64(1))), return_inverse=True, return_counts=True)
    return back, times


def base(run: T.Run) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Counts of each document as columns, with the run's word hashes and their first indexes.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a
    word that equal an earlier line), n_lines (lines with a word), n_repeat_words
    (words in windows of three that occur twice or more, the first included).
    """
    data, offsets = run.data, run.offsets
    space = T.SPACE[data]
    begin, end, first = T.pieces(space, offsets)
    hashes = T.range_hash(data, begin, end)
    counts = np.diff(first)
    chars = per_document(_HEAD[data] & ~space, offsets)
    symbols = per_document(_SYMBOL[data], offsets)
    low, high, lines = T.pieces(data == 10, offsets)
    filled = np.concatenate([[0], np.cumsum(~space)])
    worded = filled[high] > filled[low]
    line_of = np.repeat(np.arange(run.size), np.diff(lines))[worded]
    back, times = _own(T.range_hash(data, low[worded], high[worded]), line_of)
    n_lines = np.bincount(line_of, minlength=run.size)
    kinds = np.zeros(len(times), np.int64)
    kinds[back] = line_of
    distinct = np.bincount(kinds, minlength=run.size)
    windows = T.chain(hashes, 3)
    word_of = np.repeat(np.arange(run.size), counts)
    whole = np.flatnonzero(word_of[2:] == word_of[: len(windows)]) if len(windows) else np.zeros(0, np.int64)
    back, times = _own(windows[whole], word_of[whole])
    often = whole[times[back] > 1]
    covered = np.zeros(len(hashes), bool)
    for k in range(3):
        covered[often + k] = True
    repeated = np.bincount(word_of[covered], minlength=run.size)
    return {"n_words": counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": n_lines - distinct, "n_lines": n_lines, "n_repeat_words": repeated}, hashes, first


NAMES = ("log_words", "log_bytes", "word_length", "symbols", "digits", "upper", "stops", "beyond_ascii", "blank", "dup_lines", "repeat_words", "distinct_words", "line_words", "word_symbols", "no_letter", "short_words", "word_spread", "entropy")


def features(run: T.Run) -> np.ndarray:
    """One row of ``NAMES`` for each document; zero where a ratio has nothing below."""
    data, offsets = run.data, run.offsets
    counts, hashes, first = base(run)
    size = np.diff(offsets)
    words = counts["n_words"]
    n, w, lines = np.maximum(size, 1), np.maximum(words, 1), np.maximum(counts["n_lines"], 1)
    begin, end, _ = T.pieces(T.SPACE[data], offsets)
    of = np.repeat(np.arange(run.size), words)
    length = end - begin
    letters = np.concatenate([[0], np.cumsum(_UPPER[data] | _LOWER[data] | (data > 127))])
    marks = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    back, times = _own(hashes, of)
    kinds = np.zeros(len(times), np.int64)
    kinds[back] = of
    share = lambda flags: np.bincount(of, flags, minlength=run.size) / w
    spread = np.sqrt(np.maximum(share(length.astype(float) ** 2) - share(length.astype(float)) ** 2, 0))
    doc = np.repeat(np.arange(run.size), size)
    freq = np.bincount(doc * 256 + data, minlength=run.size * 256).reshape(run.size, 256) / n[:, None]
    entropy = -(freq * np.log2(np.where(freq > 0, freq, 1))).sum(1)
    columns = [
        np.log1p(words), np.log1p(size), counts["word_chars"] / w, counts["n_symbols"] / n, per_document(_DIGIT[data], offsets) / n, per_document(_UPPER[data], offsets) / n,
        per_document(_STOP[data], offsets) / n, per_document(data > 127, offsets) / n, per_document(T.SPACE[data], offsets) / n, counts["n_dup_lines"] / lines, counts["n_repeat_words"] / w,
        np.bincount(kinds, minlength=run.size) / w, words / lines, share(marks[end] > marks[begin]), share(letters[end] == letters[begin]), share(length <= 3), spread, entropy,
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], 1)
