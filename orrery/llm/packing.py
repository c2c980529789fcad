"""Packing of examples into sequences: vector bin packing by the dot-product heuristic.

Every example has a size vector (tokens, segments, loss-bearing tokens) and every sequence the same limits on each.
A sequence is filled one example at a time: among the examples that fit, the one whose size vector has the largest dot
product with the room left (both as shares of the limits) goes in, so the scarcest limit decides. Examples longer than
a sequence are first cut into whole sequences and a rest. When nothing fits and ``cut`` allows it, the longest waiting
rest is cut to fill the room. The last sequence of a task is cut at powers of two, which need no padding.

Packing runs where the documents are: one pass, no shuffle, a bounded pool of ``pool`` waiting examples. A task's
sequences are numbered from its partition's number, so a task that runs again gives the same rows.

A document's ids are those of its text (null: none) and one closing id; an empty text is that id alone. Every id lies
in exactly one piece. The first id of a piece bears no loss, as nothing precedes it; else all ids do, or those that a
column of the table names: an array of booleans, one an id (what it lacks, as for the closing id, bears none), or the
number of a document's last ids that do. A null means all. Repeated rows are packed each.
Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import _text as tx
from orrery.llm._merges import WordMerges
from orrery.llm._store import _kept, small_batches, tidy

#: Numbers that one task can give to its sequences.
PER_TASK = 1 << 36


class RunTable:
    """What runs of characters become, by 64-bit hash: open addressing in arrays, so half a million runs take some 25 MB. When
    ``most`` are held it starts anew."""

    def __init__(self, most: int):
        self.most, self.slots = most, 1 << max(8, (2 * most - 1).bit_length())
        self.clear()

    def clear(self) -> None:
        self.keys, self.own = np.zeros(self.slots, dtype=np.uint64), np.zeros(self.slots, dtype=np.int32)
        self.start, self.ids = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint32)
        self.held = 0

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (self.slots - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each run, -1 where it is not held."""
        at = self._slot(h)
        key = self.keys[at]
        out = np.where(key == h, self.own[at], -1)
        todo = np.flatnonzero((key != h) & (key != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (self.slots - 1)
            key = self.keys[at[todo]]
            hit = key == h[todo]
            out[todo[hit]] = self.own[at[todo[hit]]]
            todo = todo[~hit & (key != 0)]
        return out

    def add(self, h: np.ndarray, ids: list[bytes]) -> None:
        """Runs that are not held yet, each once."""
        size = np.array([len(x) // 4 for x in ids], dtype=np.int64)
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(size)])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), dtype="<u4")])
        left, at = np.arange(len(h)), self._slot(h)
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[left[free]]
            mine = self.keys[at] == h[left]
            self.own[at[mine]] = self.held + left[mine]
            left, at = left[~mine], (at[~mine] + 1) & (self.slots - 1)
        self.held += len(h)


class WordTokens:
    """Ids of texts under a tokenizer. Where it never joins what white space divides and puts words in lower case, ids of
    runs are kept (by hash) and reused, of at most ``keep`` runs. Other tokenizers get whole texts, and so do texts with
    a special token's beginning."""

    LONGEST = 64
    _solid = tx._lut(lambda b: b not in b" \n\t\r")
    #: Letters whose lower case and normal form depend on nothing around them, perhaps with ASCII marks behind.
    _plain = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str, keep: int = 400_000):
        from tokenizers import Tokenizer

        self.tok, self.table = Tokenizer.from_file(path), RunTable(keep)
        parts = ("One two", "three", ", four. ", "5 six'")
        self.divides = all(self._slow([f"{a}{s}{b}"])[0] == b"".join(self._slow([a, b])) for a in parts for b in parts for s in " \n\t\r")
        self.divides = self.divides and self._slow(["ABC aBc"]) == self._slow(["abc abc"])
        self.merges, self.marks = (WordMerges.load(path) if self.divides else None), {"": b""}
        probe = ["Words", "müssen", "être", "a", "ŽÀ", "xqzzkvw", "interoperability", "Don"]
        if self.merges and any(self._encode([w, w + ".)"]) != self._slow([w, w + ".)"]) for w in probe):
            self.merges = None

    def _slow(self, texts: list[str]) -> list[bytes]:
        # An encoding holds far more than its ids: few at a time.
        parts = (texts[i : i + 512] for i in range(0, len(texts), 512))
        return [np.array(e.ids, dtype="<u4").tobytes() for part in parts for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]

    def _encode(self, runs: list[str]) -> list[bytes]:
        """Ids of runs: plain words by their merges, anything else by the tokenizer itself."""
        if not self.merges:
            return self._slow(runs)
        words, own, ends, rest = [], [], [], []
        for i, run in enumerate(runs):
            m = self._plain.fullmatch(run) if len(run) <= self.LONGEST else None
            if m and max(m[1]) < "\u0250" and "\u0130" not in m[1]:
                words.append(m[1].lower().encode())
                own.append(i)
                ends.append(m[2])
            else:
                rest.append(i)
        marks = list(set(ends) - self.marks.keys())
        self.marks.update(zip(marks, self._slow(marks), strict=True))
        out: list = [b""] * len(runs)
        for i, ids, end in zip(own, self.merges.encode(words), ends, strict=True):
            out[i] = ids + self.marks[end]
        for i, ids in zip(rest, self._slow([runs[i] for i in rest]), strict=True):
            out[i] = ids
        if len(self.marks) > 10_000:
            self.marks = {"": b""}
        return out

    def __call__(self, text: str) -> np.ndarray:
        return next(self.many(pa.array([text], pa.string())))

    def many(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text; null ones have none."""
        if not self.divides:
            for text in texts.to_pylist():
                yield np.frombuffer(self._slow([text or ""])[0], dtype=np.uint32)
            return
        table = self.table
        for block in tx.blocks(texts, self._solid):
            h = np.maximum(block.hashes(), np.uint64(1))
            own = table.find(h)
            new, at = np.unique(h[own < 0], return_index=True)
            if len(new):
                if table.held + len(new) > table.most:
                    table.clear()
                    new, at = np.unique(h, return_index=True)
                else:
                    at = np.flatnonzero(own < 0)[at]
                raw = block.data.tobytes()
                runs = [raw[a:b].decode("utf-8", "replace") for a, b in zip(block.starts[at].tolist(), block.ends[at].tolist(), strict=True)]
                if len(new) > table.most:  # more than can ever be held: look this block up by itself
                    table = RunTable(len(new))
                table.add(new, self._encode(runs))
                own = table.find(h)
            first, size = table.start[own], table.start[own + 1] - table.start[own]
            upto = np.concatenate([[0], np.cumsum(size)])
            ids = table.ids[np.repeat(first - upto[:-1], size) + np.arange(upto[-1])]
            table = self.table
            special = np.flatnonzero((block.data[:-1] == 60) & (block.data[1:] == 124)) if len(block.data) else np.zeros(0, np.int64)
            whole = set((np.searchsorted(block.offs, special, side="right") - 1).tolist())
            for i, (a, b) in enumerate(zip(upto[block.first[:-1]].tolist(), upto[block.first[1:]].tolist(), strict=True)):
                if i in whole:
                    text = block.data[block.offs[i] : block.offs[i + 1]].tobytes().decode("utf-8", "replace")
                    yield np.frombuffer(self._slow([text])[0], dtype=np.uint32)
                else:
                    yield ids[a:b]


@lru_cache(1)
def word_tokens(path: str) -> WordTokens:
    """One for all tasks of a process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    _kept["tokens"] = word_tokens.cache_clear
    return WordTokens(path)


class Pool:
    """Waiting examples, by (tokens, loss-bearing tokens); all examples of one kind are alike to the heuristic."""

    def __init__(self, limits: tuple[int, int, int]):
        self.limits = np.array(limits, dtype=float)
        self.kinds: dict[tuple[int, int], list] = {}
        self.size = self.tokens = 0

    def add(self, tokens: int, loss: int, what) -> None:
        self.kinds.setdefault((tokens, loss), []).append(what)
        self.size, self.tokens = self.size + 1, self.tokens + tokens

    def take(self, kind: tuple[int, int]):
        own = self.kinds[kind]
        what = own.pop()
        if not own:
            del self.kinds[kind]
        self.size, self.tokens = self.size - 1, self.tokens - kind[0]
        return what

    def fill(self, cut: int, most=None, cost=None) -> list[tuple[int, object]]:
        """Take examples for one sequence: (tokens, example); the last may be a part, whose rest goes back.
        ``most(example, tokens, loss)`` is how many tokens of an example these limits allow, ``cost(example, tokens)``
        how many of its first tokens bear loss; by default all do but the first."""
        most = most or (lambda what, tokens, loss: min(tokens, loss + 1))
        cost = cost or (lambda what, tokens: tokens - 1)
        room, out = self.limits.copy(), []
        keys = np.array(list(self.kinds), dtype=float).reshape(-1, 2)
        counts = np.array([len(v) for v in self.kinds.values()])
        shares = np.stack([keys[:, 0], np.ones(len(keys)), keys[:, 1]], axis=1)
        while len(keys) and room[0] > 0 and room[1] > 0:
            fits = (counts > 0) & (shares <= room).all(axis=1)
            if not fits.any():
                break
            dots = (shares / self.limits) @ (room / self.limits)
            best = int(np.argmax(np.where(fits, dots, -1.0)))
            kind = (int(keys[best, 0]), int(keys[best, 1]))
            out.append((kind[0], self.take(kind)))
            counts[best] -= 1
            room -= shares[best]
        if cut and room[0] >= cut and room[1] >= 1 and self.kinds:
            kind = max(self.kinds)
            doc, start = what = self.kinds[kind][-1]
            gap = most(what, int(min(room[0], kind[0])), int(room[2]))
            if gap >= cut and kind[0] >= gap + cut:
                self.take(kind)
                out.append((gap, what))
                rest = (doc, start + gap)
                self.add(kind[0] - gap, cost(rest, kind[0] - gap), rest)
        return out


def powers(n: int) -> list[int]:
    """n as a sum of powers of two, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def loss_before(n: int, bears) -> np.ndarray:
    """How many of the first 0 to n ids bear loss, under what a row says (see the module's text)."""
    mask = np.ones(n, dtype=bool)
    if isinstance(bears, list):
        mask[:] = False
        own = [bool(b) for b in bears[:n]]
        mask[: len(own)] = own
    elif bears is not None:
        mask[: n - min(max(int(bears), 0), n)] = False
    return np.concatenate([[0], np.cumsum(mask)])


def pack(
    docs: DataFrame, spark: SparkSession, tokenizer: str, limit: int = 2048, segments: int = 512, loss: int = 2048, end: int = 1, pool: int = 4096, cut: int = 16,
    bears: str | None = None,
) -> DataFrame:
    """One row a piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset. ``bears``: the column that says
    which ids bear loss."""
    small_batches(spark)
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        encode = word_tokens(tokenizer)
        waiting, next_id = Pool((limit, segments, loss)), TaskContext.get().partitionId() * PER_TASK
        # Of documents that wait: doc_id, ids, ids left, loss before each (None: all bear it), place of the first id held, all ids.
        ids: dict[int, list] = {}
        rows: list[tuple] = []

        def cost(what, n):
            """Loss-bearing ids of a piece."""
            (key, start), before = what, ids[what[0]][3]
            start -= ids[key][4]
            return n - 1 if before is None else int(before[start + n] - before[start + 1])

        def most(what, tokens, room):
            """How long a piece may be, of ``tokens`` at most and ``room`` loss-bearing ids."""
            (key, start), before = what, ids[what[0]][3]
            if before is None:
                return min(tokens, room + 1)
            start -= ids[key][4]
            return min(tokens, int(np.searchsorted(before, before[start + 1] + room, side="right")) - 1 - start)

        def put(parts, sequence):
            offset = 0
            for n, (key, start) in parts:
                doc_id, own, _, _, held, whole = ids[key]
                rows.append((doc_id, start, n, own[start - held : start - held + n].tobytes(), whole, sequence, offset))
                offset += n
                ids[key][2] -= n
                if not ids[key][2]:
                    del ids[key]

        def flush():
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if x == "ids" else pa.int64()) for c, x in zip(cols, names, strict=True)], names=names)
            rows.clear()
            return out

        key = 0
        for batch in batches:
            said = batch.column(2).to_pylist() if bears else [None] * len(batch)
            for doc_id, ids_of, which in zip(batch.column(0).to_pylist(), encode.many(batch.column(1)), said, strict=True):
                own = np.append(ids_of, np.uint32(end)).astype("<u4")
                ids[key] = [doc_id, own, len(own), None if which is None else loss_before(len(own), which), 0, len(own)]
                start, size = 0, len(own)
                while start < size:
                    n = most((key, start), min(limit, size - start), loss)
                    rest = start + n == size and n < limit and cost((key, start), n) < loss
                    if rest:
                        waiting.add(n, cost((key, start), n), (key, start))
                        if start:  # what is placed already need not wait
                            _, _, _, before, _, _ = ids[key]
                            ids[key][1], ids[key][4] = own[start:].copy(), start
                            ids[key][3] = None if before is None else before[start:].copy()
                    else:
                        put([(n, (key, start))], next_id)
                        next_id += 1
                    start += n
                key += 1
                while waiting.size > pool:
                    put(waiting.fill(cut, most, cost), next_id)
                    next_id += 1
                if len(rows) >= 512:
                    yield flush()
        while waiting.size:
            parts = waiting.fill(cut, most, cost)
            total = sum(n for n, _ in parts)
            sizes = powers(total) if total < limit else [total]
            for size in sizes:
                mine = []
                while size:
                    n, (doc, start) = parts[0]
                    part = min(n, size)
                    mine.append((part, (doc, start)))
                    size -= part
                    parts[0] = (n - part, (doc, start + part))
                    if n == part:
                        parts.pop(0)
                put(mine, next_id)
                next_id += 1
            if len(rows) >= 512:
                yield flush()
        yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([bears] if bears else [])).mapInArrow(tidy(run, keeps="tokens"), schema)


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
