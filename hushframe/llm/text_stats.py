"""Counts over bytes, words and repeated windows of many texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

from hushframe.llm.common import Interner, mix64

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Bytes of text that are held as Stats at once; each takes about a hundred times as much.
SLICE = 1 << 17
_M = np.uint64(0x9E3779B97F4A7C15)


def _members(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars, np.uint8))


_IS_SPACE = _members(SPACE)
_CLASSES = {
    "chars": (np.arange(256) & 0xC0 != 0x80) & ~_IS_SPACE,
    "symbols": _members(SYMBOLS),
    "upper": _members(bytes(range(65, 91))),
    "lower": _members(bytes(range(97, 123))) | (np.arange(256) >= 0xC0),
    "digits": _members(bytes(range(48, 58))),
    "stops": _members(b".,;:"),
    "marks": _members(b"!?"),
    "pipes": _members(b"|"),
}
FEATURES = ("bias", "symbols", "upper", "digits", "stops", "marks", "pipes", "short", "long", "repeated", "again", "few_words", "one_word")


def _sums(flags: np.ndarray) -> np.ndarray:
    """How many hold before each place."""
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=out[1:])
    return out


class Stats:
    """Of documents given as UTF-8 bytes; documents are held apart by a line feed."""

    def __init__(self, docs: list[bytes]):
        self.data = b"\n".join(docs) + b"\n"
        raw = np.frombuffer(self.data, np.uint8)
        self.doc_bytes = np.zeros(len(docs) + 1, np.int64)
        np.cumsum([len(d) + 1 for d in docs], out=self.doc_bytes[1:])
        space = _IS_SPACE[raw]
        inside = np.flatnonzero(~space)
        self.word_at = inside[(inside == 0) | space[inside - 1]] if len(inside) else inside
        self.doc_words = np.searchsorted(self.word_at, self.doc_bytes)
        names = Interner(lambda w: xxhash.xxh64_intdigest(w))
        ids = names(self.data.split())
        self.ids = np.fromiter(ids, np.int64, len(ids))
        self.doc_of_word = np.repeat(np.arange(len(docs)), np.diff(self.doc_words))
        self._cum = {k: _sums(v[raw]) for k, v in _CLASSES.items()}
        order = np.lexsort((np.arange(len(self.ids)), self.ids, self.doc_of_word))
        same = (self.ids[order][1:] == self.ids[order][:-1]) & (self.doc_of_word[order][1:] == self.doc_of_word[order][:-1])
        #: The word's last place before in the same document, or -1.
        self.previous = np.full(len(self.ids), -1, np.int64)
        self.previous[order[1:][same]] = order[:-1][same]
        self.repeated = self._repeated(mix64(names.hashes())[self.ids] if len(self.ids) else np.zeros(0, np.uint64))
        self._cum_repeated = _sums(self.repeated)

    def _repeated(self, h: np.ndarray) -> np.ndarray:
        """Whether a word lies in a window of WINDOW words that its document has twice or more."""
        n = len(h) - WINDOW + 1
        if n < 2:
            return np.zeros(len(h), bool)
        acc = np.zeros(n, np.uint64)
        for j in range(WINDOW):
            acc = acc * _M + h[j : j + n]
        at = np.flatnonzero(self.doc_of_word[:n] == self.doc_of_word[WINDOW - 1 :])
        key = mix64(mix64(acc[at]) + self.doc_of_word[at].astype(np.uint64) * _M)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edges = np.zeros(len(h) + 1, np.int64)
        edges[at[twice]] += 1
        edges[at[twice] + WINDOW] -= 1
        return np.cumsum(edges)[:-1] > 0

    def count(self, what: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of bytes of class ``what`` from a to b."""
        return (self._cum[what][b] - self._cum[what][a]).astype(np.int64)

    def n_repeated(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words from a to b in repeated windows."""
        return (self._cum_repeated[b] - self._cum_repeated[a]).astype(np.int64)

    def features(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the byte ranges a to b, which stand in order without overlap: a row of FEATURES, each from 0 to 1."""
        wa, wb = np.searchsorted(self.word_at, a), np.searchsorted(self.word_at, b)
        n = np.maximum(wb - wa, 1)
        chars = np.maximum(self.count("chars", a, b), 1)
        of = lambda k: self.count(k, a, b)
        owner = np.repeat(np.arange(len(a)), wb - wa)
        words = np.arange(len(owner)) - np.repeat(np.cumsum(wb - wa) - (wb - wa), wb - wa) + np.repeat(wa, wb - wa)
        again = np.bincount(owner[self.previous[words] >= wa[owner]], minlength=len(a)) if len(owner) else np.zeros(len(a))
        mean = chars / n
        cols = [
            np.ones(len(a)), np.minimum(1, 4 * of("symbols") / chars), of("upper") / np.maximum(of("upper") + of("lower"), 1), of("digits") / chars, np.minimum(1, of("stops") / n), np.minimum(1, of("marks") / n), np.minimum(1, 2 * of("pipes") / n),
            np.clip(1 - mean / 4, 0, 1), np.clip(mean / 8 - 1, 0, 1), self.n_repeated(wa, wb) / n, again / n, n < 8, n < 2,
        ]
        return np.stack([np.asarray(c, np.float32) for c in cols], axis=1)
