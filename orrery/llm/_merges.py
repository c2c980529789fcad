"""Byte-pair merges of many words at once, in numpy: the same ids as a tokenizer's, for words that are all letters.

Every row of a matrix is a word, every cell a symbol. In each step each word merges its pair of lowest rank, the leftmost
of several; words that have no pair left are done.
"""

from __future__ import annotations

import json

import numpy as np

_NONE = np.int32(1 << 30)


def _byte_letters() -> list[str]:
    """The characters that stand for the 256 bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(more))
        more += b not in plain
    return out


class WordMerges:
    """Merges of a BPE model whose words end with a suffix; ``None`` from ``load`` where a tokenizer is of another kind."""

    SLOTS = 1 << 18

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        letters = _byte_letters()
        self.inside = np.array([vocab[c] for c in letters], dtype=np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], dtype=np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.key = np.array([(vocab[a] << 16) | vocab[b] for a, b in pairs], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.table = np.full(self.SLOTS, -1, dtype=np.int32)
        left, at = np.arange(len(self.key), dtype=np.int32), self._slot(self.key)
        while len(left):
            free = self.table[at] < 0
            self.table[at[free]] = left[free]
            stays = self.table[at] != left
            left, at = left[stays], (at[stays] + 1) & (self.SLOTS - 1)

    @classmethod
    def load(cls, path: str) -> WordMerges | None:
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, steps = made["model"], made.get("pre_tokenizer") or {}
        kinds = [p["type"] for p in steps.get("pretokenizers", [])]
        suffix = model.get("end_of_word_suffix")
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges", "byte_fallback"))
        if model["type"] != "BPE" or not suffix or not plain or kinds != ["Split", "ByteLevel"] or max(model["vocab"].values()) >= 1 << 16:
            return None
        return cls(model["vocab"], model["merges"], suffix)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * 0x9E3779B1) >> 13) & (self.SLOTS - 1)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 16) | b
        at = self._slot(key)
        got = self.table[at]
        out = np.where((got >= 0) & (self.key[got] == key), got, _NONE)
        todo = np.flatnonzero((got >= 0) & (out == _NONE))
        while len(todo):
            at[todo] = (at[todo] + 1) & (self.SLOTS - 1)
            own = self.table[at[todo]]
            hit = (own >= 0) & (self.key[own] == key[todo])
            out[todo[hit]] = own[hit]
            todo = todo[(own >= 0) & ~hit]
        return out

    def _alike(self, words: list[bytes], size: int) -> list[bytes]:
        """Words of one length."""
        raw = np.frombuffer(b"".join(words), dtype=np.uint8).reshape(-1, size)
        sym = self.inside[raw]
        sym[:, -1] = self.last[raw[:, -1]]
        out: list = [None] * len(words)
        own = np.arange(len(words))
        rank = self.rank(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(len(words), size - 1)
        while len(own):
            n = sym.shape[1]
            best = rank.argmin(axis=1) if n > 1 else np.zeros(len(own), np.int64)
            low = rank[np.arange(len(own)), best] if n > 1 else np.full(len(own), _NONE)
            ready = low == _NONE
            if ready.any():
                ids = sym[ready].astype("<u4")
                for i, x in zip(own[ready].tolist(), ids, strict=True):
                    out[i] = x.tobytes()
                own, sym, rank, best, low = own[~ready], sym[~ready], rank[~ready], best[~ready], low[~ready]
                if not len(own):
                    break
            row = np.arange(len(own))
            sym[row, best] = self.made[low]
            cols = np.arange(n - 1)
            sym = np.take_along_axis(sym, cols + (cols > best[:, None]), axis=1)
            cols = np.arange(n - 2)
            rank = np.take_along_axis(rank, cols + (cols >= best[:, None]), axis=1)
            if n > 2:
                for at in (best - 1, best):
                    ok = np.flatnonzero((at >= 0) & (at < n - 2))
                    rank[ok, at[ok]] = self.rank(sym[ok, at[ok]], sym[ok, at[ok] + 1])
        return out

    def encode(self, words: list[bytes], together: int = 16384) -> list[bytes]:
        """Ids of each word (lower-case UTF-8 bytes), as little-endian 32-bit numbers."""
        out: list = [b""] * len(words)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for size, own in by.items():
            for lo in range(0, len(own), together):
                part = own[lo : lo + together]
                got = self._alike([words[i] for i in part], size) if size > 1 else [self.last[words[i][0]].astype("<u4").tobytes() for i in part]
                for i, x in zip(part, got, strict=True):
                    out[i] = x
        return out
