"""Language identification by hierarchical discrimination with linear support vector machines.

Texts are counted character n-grams (bytes, 1 to 4, within words, lower-cased) in ``dims`` hash cells, square-rooted
and scaled to unit length. A one-versus-rest machine for each language family picks the family; within it a machine
for each pair of its languages votes, ties going to the larger sum of margins. Machines minimise the squared hinge
loss by accelerated gradient steps.

Learnt from at most about ``per_language`` documents of each language, sampled by hash; of all others every text is
read whole when it is predicted. The score is the family's share (softmax of margins) times the least pairwise
share of the winner. Texts that are null or have no letter are ``und`` with score 0. If nothing can be learnt, all are
``und``. Repeated rows each get a row. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import _text as tx
from orrery.llm._store import sized, small_batches, tidy

# Families of some languages; any other language is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk pl cs sk bg sr hr sl mk be",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}

LETTERS = tx._lut(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
_ASCII_LETTERS = tx._lut(lambda b: 65 <= b <= 90 or 97 <= b <= 122)


def features(col: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of n-gram counts, and whether the text has a letter."""
    out, letters = [], []
    for block in tx.blocks(col, LETTERS):
        n = len(block.data)
        low = np.where(LETTERS[block.data], tx.LOWER[block.data], np.uint8(32)).astype(np.uint64)
        row = np.repeat(np.arange(block.rows), np.diff(block.offs))
        counts = np.zeros(block.rows * dims)
        gram = np.zeros(n, dtype=np.uint64)
        for k in range(4):
            gram = gram[: n - k] * np.uint64(257) + low[k:] if k < n else gram[:0]
            if not len(gram):
                break
            same = row[: n - k] == row[k:]
            word = same if k == 0 else same & ((low[1 : n - k + 1] != 32) if k == 1 else np.logical_and.reduce([low[j : n - k + j] != 32 for j in range(1, k)]))
            cell = (tx.mix(gram[word] + np.uint64(k << 60)) % np.uint64(dims)).astype(np.int64)
            counts += np.bincount(row[: n - k][word] * dims + cell, minlength=len(counts))
        x = np.sqrt(counts.reshape(block.rows, dims)).astype(np.float32)
        out.append(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9))
        got = np.add.reduceat(np.append(_ASCII_LETTERS[block.data], False), np.minimum(block.offs[:-1], n)) * (np.diff(block.offs) > 0) > 0
        for i in np.flatnonzero(~got & (np.diff(block.offs) > 0)):
            raw = block.data[block.offs[i] : block.offs[i + 1]]
            got[i] = bool((raw >= 128).any()) and any(c.isalpha() for c in raw.tobytes().decode("utf-8", "replace") if c != "�")
        letters.append(got)
    return (np.concatenate(out), np.concatenate(letters)) if out else (np.zeros((0, dims), np.float32), np.zeros(0, bool))


def machine(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss; y is +1 or -1, classes weigh the same."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = v = np.zeros(x.shape[1])
    rate = 1 / (1 / c + 2 * 2)
    for t in range(steps):
        short = np.maximum(0, 1 - y * (x @ v))
        new = v - rate * (v / c / len(x) - 2 * x.T @ (share * y * short))
        v, w = new + t / (t + 3) * (new - w), new
    return w[:-1].astype(np.float32), float(w[-1])


class Hierarchy:
    def __init__(self, x: np.ndarray, lang: np.ndarray):
        self.langs = sorted(set(lang.tolist()))
        family = np.array([FAMILY_OF.get(k, k) for k in lang])
        self.families = sorted(set(family.tolist()))
        self.members = {f: [k for k in self.langs if FAMILY_OF.get(k, k) == f] for f in self.families}
        self.top = [machine(x, np.where(family == f, 1.0, -1.0)) for f in self.families] if len(self.families) > 1 else []
        self.pairs = {}
        for f, own in self.members.items():
            for i, a in enumerate(own):
                for b in own[i + 1 :]:
                    pick = (lang == a) | (lang == b)
                    self.pairs[a, b] = machine(x[pick], np.where(lang[pick] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.top:
            m = np.stack([x @ w + b for w, b in self.top], axis=1) * 3
            e = np.exp(m - m.max(axis=1, keepdims=True))
            share = e / e.sum(axis=1, keepdims=True)
        else:
            share = np.ones((len(x), 1))
        best = share.argmax(axis=1)
        lang, score = np.empty(len(x), dtype=object), share[np.arange(len(x)), best]
        for k, f in enumerate(self.families):
            at, own = np.flatnonzero(best == k), self.members[f]
            if not len(at):
                continue
            wins, least = np.zeros((len(at), len(own))), np.ones((len(at), len(own)))
            for (a, b), (w, bias) in ((p, m) for p, m in self.pairs.items() if p[0] in own):
                m, i, j = x[at] @ w + bias, own.index(a), own.index(b)
                p = 1 / (1 + np.exp(-np.clip(3 * m, -30, 30)))
                wins[:, i] += (m >= 0) + 1e-3 * np.tanh(m)
                wins[:, j] += (m < 0) - 1e-3 * np.tanh(m)
                least[:, i], least[:, j] = np.minimum(least[:, i], p), np.minimum(least[:, j], 1 - p)
            top = wins.argmax(axis=1)
            lang[at] = np.array(own, dtype=object)[top]
            score[at] *= least[np.arange(len(at)), top]
        return lang, score


def train(labelled: DataFrame, per_language: int = 1000, dims: int = 2048) -> Hierarchy | None:
    """Fit on about ``per_language`` documents of each value of ``lang``; ``labelled`` must hold no row to be held out."""
    labelled = labelled.where("lang is not null and text is not null")
    have = labelled.groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.least(F.lit(1.0), F.lit(per_language) / F.col("n")).alias("share"))
    part = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 20))
    own = labelled.select("lang", "text").join(sized(have), "lang").where(part < F.col("share") * (1 << 20)).select("lang", "text")

    def count(batches):
        for batch in batches:
            x, ok = features(batch.column(1), dims)
            rows = pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), rows, pa.array(ok)], names=["lang", "x", "ok"])

    got = own.mapInArrow(tidy(count), "lang string, x binary, ok boolean").where("ok").orderBy("lang", "x").toPandas()
    if got.empty:
        return None
    x = np.stack([np.frombuffer(r, dtype=np.float16) for r in got["x"]]).astype(np.float32)
    return Hierarchy(x, got["lang"].to_numpy(dtype=object))


def identify(docs: DataFrame, model: Hierarchy | None, dims: int = 2048) -> DataFrame:
    """doc_id, lang_pred and score of each whole text."""

    def run(batches):
        for batch in batches:
            x, ok = features(batch.column(1), dims)
            lang, score = model.predict(x) if model is not None and len(x) else (np.full(len(x), "und", object), np.zeros(len(x)))
            known = ok & (model is not None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.where(known, lang, "und").tolist(), pa.string()), pa.array(np.where(known, score, 0.0), pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, labelled: DataFrame, spark: SparkSession, per_language: int = 1000) -> DataFrame:
    """doc_id, lang_pred and score of every document, learnt from ``labelled(text, lang)``."""
    small_batches(spark)
    return identify(docs, train(labelled, per_language))
