"""Whole-text encoding with a fixed vocabulary file, one distinct word at a time.

Both kinds of vocabulary file in use split a text at single spaces and line ends before
they merge anything, so a text's ids are its words' ids in a row.  Words are found and
told apart by 64-bit hashes over the text buffer; each worker keeps the ids of the
words it has met in sorted arrays, only new ones go through the tokenizers library,
many in one call, and a text's ids are gathered from there.  A text with white space
around a space (where the byte-level pattern looks ahead across words), one that holds
the name of a special token, and a vocabulary of any other kind are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from tokenizers import Tokenizer

from . import textscan as T

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

KNOWN_WORDS = 2_000_000
RUN_BYTES = 1 << 21
CALL = 512
MARKS = np.frombuffer(b",.;:!?", np.uint8)


def kind_of(spec: dict) -> str:
    """How words can be told apart: "spaced" (a word owns the space before it), "ended" (white space is dropped) or "whole"."""
    before, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if norm is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
        return "spaced"
    steps = [x.get("type") for x in before.get("pretokenizers", [])]
    norms = [x.get("type") for x in (norm or {}).get("normalizers", [])]
    if steps == ["Split", "ByteLevel"] and norms == ["NFC", "Replace", "Lowercase"] and spec["model"].get("end_of_word_suffix") and "\\s" in str(before["pretokenizers"][0]["pattern"]) and before["pretokenizers"][0].get("invert"):
        return "ended"
    return "whole"


def spaces(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first bytes, last bytes) of every character that may be white space; some that aren't are among them."""
    ahead = np.zeros(len(data), np.uint8)
    ahead[:-1] = data[1:]
    one = data <= 32
    two = (data == 0xC2) & ((ahead == 0x85) | (ahead == 0xA0))
    three = ((data == 0xE1) & (ahead == 0x9A)) | ((data == 0xE2) & ((ahead == 0x80) | (ahead == 0x81))) | ((data == 0xE3) & (ahead == 0x80))
    last = one.copy()
    last[1:] |= two[:-1]
    last[2:] |= three[:-2]
    return one | two | three, last


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``begin[i] .. begin[i] + size[i] - 1`` of all i in a row."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


class WordEncoder:
    def __init__(self, text: str, special_as_text: bool = False):
        spec = json.loads(text)
        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.encode_special_tokens = special_as_text
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocab = self.tokenizer.get_vocab()
        self.width = np.dtype("<u2" if max(vocab.values(), default=0) < 65536 else "<u4")
        self.kind = kind_of(spec)
        self.names = [] if special_as_text else [x["content"].lower() for x in spec.get("added_tokens") or []]
        self.opens = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.closes = np.zeros(len(self.opens), bool)
        if mark := spec["model"].get("end_of_word_suffix"):
            self.closes[[i for t, i in vocab.items() if t.endswith(mark)]] = True
        zero = self._plain(["0"])[0]
        self.mark = int(zero[0]) if len(zero) == 1 else None
        line = self._plain(["\n"])[0] if self.kind == "spaced" else []
        self.newline = int(line[0]) if len(line) == 1 else None
        if {"ended": self.mark, "spaced": self.newline}.get(self.kind) is None:
            self.kind = "whole"
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.pool = np.zeros(1 << 16, self.width)
        self.used = 0

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.width) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, data: np.ndarray, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, leads: np.ndarray, odd: np.ndarray, letters: np.ndarray) -> None:
        """Take the ids of new words into the pool; ``leads`` marks those with a space before them."""
        sizes = np.zeros(len(hashes), np.int64)
        found: list[np.ndarray | None] = [None] * len(hashes)
        chunks: list[np.ndarray] = []
        order: list[np.ndarray] = []

        def take(own: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
            sizes[own] = np.diff(ends, prepend=0)
            chunks.append(ids)
            order.append(own)

        def alone(own: np.ndarray) -> None:
            words = [" " * bool(leads[k]) + data[begin[k] : end[k]].tobytes().decode("utf-8", "replace") for k in own.tolist()]
            for k, ids in zip(own.tolist(), self._plain(words), strict=True):
                found[k] = ids

        def joined(own: np.ndarray, how: str) -> str:
            """The words in a row: each after a space, before a line's end, before a space, or before " 0 "."""
            ahead, after = (1, 0) if how == "open" else (0, 3) if how == "mark" else (0, 1)
            size = end[own] - begin[own] + ahead + after
            row = data[np.minimum(spans(begin[own] - ahead, size), len(data) - 1)]
            last = np.cumsum(size) - 1
            if ahead:
                row[last - size + 1] = 32
            else:
                row[last] = 10 if how == "line" else 32
            if after == 3:
                row[last - 1], row[last - 2] = 48, 32
            return row.tobytes().decode("utf-8", "replace")

        spaced = self.kind == "spaced"
        clean = ~odd & (end > begin)
        if spaced:
            groups = [("open", np.flatnonzero(clean & leads)), ("line", np.flatnonzero(clean & ~leads))]
        else:
            groups = [("close", np.flatnonzero(clean & letters)), ("mark", np.flatnonzero(clean & ~letters))]
        alone(np.flatnonzero(~clean))
        for how, own in groups:
            for at in range(0, len(own), CALL):
                some = own[at : at + CALL]
                ids = self._plain([joined(some, how)])[0]
                if how == "open":
                    ends = np.append(np.flatnonzero(self.opens[ids])[1:], len(ids)) if len(ids) else np.zeros(0, np.int64)
                elif how == "close":
                    ends = np.flatnonzero(self.closes[ids]) + 1
                else:
                    # What stands between the words is an id of its own.
                    mark = self.newline if how == "line" else self.mark
                    marks = np.flatnonzero(ids == mark)
                    ends = marks - np.arange(len(marks))
                    ids = ids[ids != mark]
                if len(ends) != len(some):
                    alone(some)
                else:
                    take(some, ids, ends)
        rest = [k for k, ids in enumerate(found) if ids is not None]
        for k in rest:
            sizes[k] = len(found[k])
        chunks += [found[k] for k in rest]
        order.append(np.array(rest, np.int64))
        place = np.concatenate(order)
        fresh = np.concatenate(chunks) if chunks else np.zeros(0, self.width)
        if self.used + len(fresh) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(fresh), self.used // 2), self.width)])
        self.pool[self.used : self.used + len(fresh)] = fresh
        at = np.empty(len(hashes), np.int64)
        at[place] = self.used + np.cumsum(sizes[place]) - sizes[place]
        self.used += len(fresh)
        line = np.argsort(hashes, kind="stable")
        to = np.searchsorted(self.hashes, hashes[line])
        self.hashes = np.insert(self.hashes, to, hashes[line])
        self.begin = np.insert(self.begin, to, at[line])
        self.size = np.insert(self.size, to, sizes[line].astype(np.int32))

    def _words(self, run: T.Run) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, whether a space leads, index of each document's first) of a run's words.

        Words end at spaces, and at line ends that nothing white stands beside; a mark
        such as a comma after an ASCII letter is a word of its own.  All of these are
        places where either kind of vocabulary splits whatever stands around.
        """
        data, offsets = run.data, run.offsets
        spaced = self.kind == "spaced"
        line = data == 10
        if spaced and line.any():
            first, last = spaces(data)
            line[1:] &= ~last[:-1]
            line[:-1] &= ~first[1:]
            filled = np.flatnonzero(np.diff(offsets))
            line[offsets[:-1][filled]] = line[offsets[1:][filled] - 1] = False
        gaps = np.flatnonzero((data == 32) | line)
        inside = np.diff(np.searchsorted(gaps, offsets))
        # A document with k gaps has k + 1 words, some of them empty.
        first = np.concatenate([[0], np.cumsum(inside + 1)])
        begin, end = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
        slot = np.arange(len(gaps)) + np.repeat(np.arange(run.size), inside)
        begin[first[:-1]] = offsets[:-1]
        begin[slot + 1] = gaps + 1
        end[first[1:] - 1] = offsets[1:]
        end[slot] = gaps
        leads = np.ones(len(begin), bool)
        leads[first[:-1]] = False
        leads[slot + 1] = ~line[gaps]
        tail = np.zeros(len(begin), bool)
        if len(data):
            letter = (((data | 32) >= 97) & ((data | 32) <= 122))[np.maximum(end - 2, 0)]
            tail = (end - begin > 1) & letter & np.isin(data[np.maximum(end - 1, 0)], MARKS)
        parts = 1 + tail.astype(np.int64)
        broken = np.zeros(len(begin), bool)
        if spaced:
            broken[slot] = line[gaps]
            parts += broken
        upto = np.concatenate([[0], np.cumsum(parts)])
        at = upto[:-1]
        begin, end, leads = np.repeat(begin, parts), np.repeat(end, parts), np.repeat(leads, parts)
        own = at[tail]
        end[own] -= 1
        begin[own + 1], end[own + 1], leads[own + 1] = end[own], end[own] + 1, False
        own = (upto[1:] - 1)[broken]
        # The end of a line follows the word (and its mark) before it.
        begin[own] = end[own] = end[own - 1]
        end[own] += 1
        leads[own] = False
        return begin, end, leads, upto[first]

    def _run(self, run: T.Run) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds of each document) of texts that can be taken word by word."""
        data = run.data
        begin, end, leads, first = self._words(run)
        hashes = T.range_hash(data, begin, end, fold=self.kind == "ended")
        if self.kind == "spaced":
            hashes[~leads] = T.mix(hashes[~leads] ^ np.uint64(0x5851F42D4C957F2D))
        codes, distinct = pd.factorize(hashes)
        where = np.empty(len(distinct), np.int64)
        where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        if len(self.hashes) + len(distinct) > KNOWN_WORDS:
            self._forget()
        line = np.argsort(distinct)
        at = np.empty(len(distinct), np.int64)
        at[line] = np.searchsorted(self.hashes, distinct[line])
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == distinct[known]
        if not known.all():
            new = where[~known]
            marks, _ = spaces(data)
            marked = np.concatenate([[0], np.cumsum(marks | (data == 48) & (self.kind == "ended"))])
            plain = np.concatenate([[0], np.cumsum(((data | 32) < 97) | ((data | 32) > 122))])
            b, e = begin[new], end[new]
            self._learn(data, distinct[~known], b, e, leads[new], marked[e] > marked[b], plain[e] == plain[b])
            at[line] = np.searchsorted(self.hashes, distinct[line])
        size = self.size[at].astype(np.int64)[codes]
        ids = self.pool[spans(self.begin[at][codes], size)]
        return ids, np.concatenate([[0], np.cumsum(size)])[first]

    def _unsafe(self, column: pa.Array) -> np.ndarray:
        """Documents that must be encoded whole."""
        data, offsets = T.text_buffers(column)
        out = np.zeros(len(column), bool)
        if not len(data) or not len(column):
            return out
        low, high = int(offsets[0]), int(offsets[-1])
        data, offsets = data[low:high], offsets - low
        if self.kind == "spaced" and len(data) > 2:
            first, last = spaces(data)
            at = np.flatnonzero((data[1:-1] == 32) & last[:-2] & first[2:]) + 1
            out[np.minimum(np.searchsorted(offsets, at, "right") - 1, len(out) - 1)] = True
        if self.names:
            # A name's first byte and a Python search tell, on the few texts that hold that byte.
            heads = {n[0] for n in self.names}
            maybe = np.flatnonzero(np.isin(data, np.frombuffer("".join(heads).encode(), np.uint8)))
            for k in np.unique(np.searchsorted(offsets, maybe, "right") - 1).tolist():
                text = bytes(data[offsets[k] : offsets[k + 1]]).decode("utf-8", "replace").lower()
                out[k] |= any(n in text for n in self.names)
        return out

    def encode_column(self, column: pa.Array) -> Iterator[bytes]:
        """Each text's ids as packed integers of type ``width``; a null counts as empty."""
        column = column.cast(pa.large_string())
        whole = np.ones(len(column), bool) if self.kind == "whole" else self._unsafe(column)
        odd = np.flatnonzero(whole)
        apart = dict(zip(odd.tolist(), (x.tobytes() for x in self._plain([x or "" for x in column.take(pa.array(odd)).to_pylist()])), strict=True)) if len(odd) else {}
        rest = column.take(pa.array(np.flatnonzero(~whole))) if len(odd) else column
        k, unit = 0, self.width.itemsize
        for run in T.runs(rest, RUN_BYTES) if len(rest) else ():
            ids, bounds = self._run(run)
            packed, bounds = ids.tobytes(), (bounds * unit).tolist()
            for low, high in zip(bounds, bounds[1:], strict=False):
                while k in apart:
                    yield apart[k]
                    k += 1
                yield packed[low:high]
                k += 1
        while k in apart:
            yield apart[k]
            k += 1

    def encode(self, texts: list[str]) -> list[bytes]:
        return list(self.encode_column(pa.array(texts, pa.large_string())))


_encoders: dict[tuple, WordEncoder] = {}


def encoder(text: str, special_as_text: bool = False) -> WordEncoder:
    """This process's encoder for a vocabulary file's text."""
    key = hashlib.sha256(text.encode()).digest(), special_as_text
    if key not in _encoders:
        _encoders[key] = WordEncoder(text, special_as_text)
    return _encoders[key]
