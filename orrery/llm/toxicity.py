"""Toxicity by compression distance: two zstandard dictionaries, one of ordinary and one of toxic text.

A window is a word with its borders, each byte spelled as three so that compressed lengths, which are whole bytes,
tell more. A window's distance is its compressed length under the ordinary dictionary less that under the toxic one.
The ordinary dictionary holds the words seen most in ordinary documents. The toxic one holds the same words and, before
them, the passages that tell toxic documents from ordinary ones: of each word the part whose character 5- and 6-grams
are far more frequent in toxic documents (a two-proportion test). Thus text that both know costs the same, and only
toxic passages differ.

A document's score is a logistic model of how many of its windows reach each distance, of the largest distance and of
the length, fitted on labelled documents by halves, each under dictionaries made from the other half, with the classes weighted back to their
shares, so scores are calibrated. Labels are sampled by hash: at most about ``max_docs`` documents, half of them of each
class where there are so many. The sample is the only bound; all other text is read whole.

Null and empty texts have no windows: their score is the model's for none. Without both labels every score is 0.
Repeated rows each get a row. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import _text as tx
from orrery.llm._store import free, give_back, small_batches, tidy

STEPS = (2, 3, 4, 5, 6, 8, 10, 12, 15)
_PARAMS = dict(
    strategy=zs.STRATEGY_LAZY2, min_match=6, window_log=18, hash_log=16, chain_log=16, search_log=6, target_length=32,
    write_content_size=False, write_checksum=False, write_dict_id=False,
)


def spell(word: bytes) -> bytes:
    """Three bytes for each: itself and two that follow from it."""
    one = np.frombuffer(word, dtype=np.uint8).astype(np.int64)
    return np.stack([one, one * 37 + 11, one * 91 + 53], axis=1).astype(np.uint8).tobytes()


def _document_words(text: str) -> set[str]:
    out: set[str] = set()
    for block in tx.blocks(pa.array([text]), tx.ALNUM):
        data = tx.LOWER[block.data].tobytes()
        out |= {data[a:b] for a, b in zip(block.starts, block.ends, strict=True)}
    return {w.decode("utf-8", "replace") for w in out}


def _grams(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of characters of words between blanks, the index of each one's word, and its place there."""
    codes = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = np.array([len(w) + 2 for w in words], dtype=np.int64)
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), np.maximum(size - n + 1, 0))
    place = np.arange(len(word)) - np.repeat(np.cumsum(np.maximum(size - n + 1, 0)) - np.maximum(size - n + 1, 0), np.maximum(size - n + 1, 0))
    h, at = np.full(len(word), n, dtype=np.uint64), first[word] + place
    for k in range(n):
        h = tx.mix(h * np.uint64(0xD1342543DE82EF95) + codes[at + k].astype(np.uint64))
    return h, word, place


def _once(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Where a gram stands in its word for the first time."""
    return np.unique(tx.mix(h + tx.mix(word.astype(np.uint64))), return_index=True)[1]


def _word_counts(texts: list[str], together: int = 500) -> Iterator[Counter]:
    """How many documents have each word, by blocks of documents."""
    for lo in range(0, len(texts), together):
        out: Counter = Counter()
        for text in texts[lo : lo + together]:
            out.update(_document_words(text))
        yield out


def _gram_counts(texts: list[str], n: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """n-grams (of ``among``, if given) and the sum over their words of the documents that have the word."""
    total, many = np.zeros(0, np.uint64), np.zeros(0)
    for counts in _word_counts(texts):
        h, word, _ = _grams(list(counts), n)
        if among is not None:
            hit = np.isin(h, among)
            h, word = h[hit], word[hit]
        at = _once(h, word)
        times = np.array(list(counts.values()), dtype=float)[word[at]]
        total, inverse = np.unique(np.concatenate([total, h[at]]), return_inverse=True)
        many = np.bincount(inverse, weights=np.concatenate([many, times]), minlength=len(total))
    return total, many


def common_words(texts: list[str], most: int) -> list[str]:
    """Words that most documents have, most frequent first."""
    seen = [np.unique(np.concatenate([b.hashes() for b in tx.blocks(pa.array([t]), tx.ALNUM)] or [np.zeros(0, np.uint64)])) for t in texts]
    keys, n = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.uint64), return_counts=True)
    top = keys[np.lexsort((keys, -n))[:most]]
    word: dict[int, str] = {}
    for text, own in zip(texts, seen, strict=True):
        if any(int(k) not in word for k in own[np.isin(own, top)]):
            for block in tx.blocks(pa.array([text]), tx.ALNUM):
                h = block.hashes()
                for i in np.flatnonzero(np.isin(h, top)).tolist():
                    word.setdefault(int(h[i]), block.word(i))
    return [word[int(k)] for k in top]


def telling_passages(toxic: list[str], ordinary: list[str], least: float = 5.0, docs: int = 4) -> list[str]:
    """Parts of toxic texts' words by how often they tell, most often first."""
    n_toxic, n_ordinary, telling = max(1, len(toxic)), max(1, len(ordinary)), {}
    for n in (5, 6):
        grams, seen = _gram_counts(toxic, n)
        # Only grams that stand in enough toxic documents are asked for; the rest need no count.
        grams, seen = grams[seen >= docs], seen[seen >= docs]
        had, times = _gram_counts(ordinary, n, grams)
        plain = np.zeros(len(grams))
        plain[np.searchsorted(grams, had)] = times
        p, q = seen / n_toxic, plain / n_ordinary
        z = (p - q) / np.sqrt((seen + plain + 1) / (n_toxic + n_ordinary) * (1 / n_toxic + 1 / n_ordinary))
        good = (q < 0.35 * p) & (z >= least)
        telling[n] = grams[good], z[good]
    parts: Counter = Counter()
    for counts in _word_counts(toxic):
        words, told = list(counts), {}
        for n, (grams, z) in telling.items():
            h, word, place = _grams(words, n) if len(grams) else (np.zeros(0, np.uint64),) * 3
            j = np.minimum(np.searchsorted(grams, h), len(grams) - 1)
            for i in np.flatnonzero(grams[j] == h).tolist() if len(grams) else []:
                told.setdefault(int(word[i]), []).append((int(place[i]), n, float(z[j[i]])))
        for w in sorted(told):
            own = f" {words[w]} "
            best = max(x for *_, x in told[w])
            mask = np.zeros(len(own) + 2, dtype=bool)
            for i, n, x in told[w]:
                if x >= 0.6 * best:
                    mask[i + 1 : i + 1 + n] = True
            edge = np.diff(mask.astype(int))
            for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                parts[own[a:b]] += counts[words[w]]
    return [p for p, _ in parts.most_common(1000)]


class CompressionModel:
    """The two dictionaries, the distances of words, and the logistic model on them."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.contents = (spell(ordinary), spell(toxic) + spell(ordinary))
        self.weights: np.ndarray | None = None
        self._ready = None

    def __getstate__(self):
        return {"contents": self.contents, "weights": self.weights, "_ready": None}

    def _compressors(self):
        if self._ready is None:
            params = zs.ZstdCompressionParameters(**_PARAMS)
            made = []
            for content in self.contents:
                d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=params)
                made.append(zs.ZstdCompressor(dict_data=d, compression_params=params).compress)
            self._ready = (*made, {})
        return self._ready

    def features(self, col: pa.Array, keep: int = 300_000) -> np.ndarray:
        """One row a document, from the distances of all its words."""
        plain, toxic, known = self._compressors()
        out = []
        for block in tx.blocks(col, tx.ALNUM):
            keys, at, inverse = np.unique(block.hashes(), return_index=True, return_inverse=True)
            data = tx.LOWER[block.data].tobytes()
            if len(known) > keep:
                known.clear()
            distance = np.zeros(len(keys), dtype=np.int64)
            for i, (key, j) in enumerate(zip(keys.tolist(), at.tolist(), strict=True)):
                d = known.get(key)
                if d is None:
                    window = spell(b" " + data[block.starts[j] : block.ends[j]] + b" ")
                    d = known[key] = len(plain(window)) - len(toxic(window))
                distance[i] = d
            all_ = distance[inverse]
            sums = [np.concatenate([[0], np.cumsum(all_ >= k)]) for k in STEPS]
            counts = np.stack([s[block.first[1:]] - s[block.first[:-1]] for s in sums], axis=1).astype(float)
            n = block.counts[:, None].astype(float)
            out.append(np.concatenate([np.log1p(counts), counts > 0, counts / np.sqrt(n + 1), np.log1p(n)], axis=1))
        return np.concatenate(out) if out else np.zeros((0, 3 * len(STEPS) + 1))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> CompressionModel:
        """Weighted logistic regression by Newton's method."""
        self.mean, self.sd = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.concatenate([(x - self.mean) / self.sd, np.ones((len(x), 1))], axis=1)
        w, keep = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (weight * (p - y)) + keep * w
            step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(keep), grad)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = np.append(w[:-1] / self.sd, w[-1] - (w[:-1] * self.mean / self.sd).sum())
        return self

    def scores(self, col: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(col))
        return 1 / (1 + np.exp(-np.clip(self.features(col) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 8000) -> CompressionModel | None:
    """Fit on at most about ``max_docs`` labelled documents; ``labels(doc_id, toxic)`` must hold no row to be held out."""
    labels = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    have = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(have) < 2:
        return None
    share = {k: min(1.0, max_docs / 2 / n) for k, n in have.items()}
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    own = labels.where(part < F.when(F.col("toxic") == 1, int(share[1] * (1 << 20))).otherwise(int(share[0] * (1 << 20))))
    # The sample has about max_docs rows whatever the table's size.
    rows = docs.select("doc_id", "text").join(F.broadcast(own.dropDuplicates(["doc_id"])), "doc_id").orderBy("doc_id").select("text", "toxic").toPandas()
    # Copies say nothing new; each text counts once.
    rows = rows.assign(text=rows["text"].fillna("")).drop_duplicates("text")
    text, y = rows["text"].tolist(), rows["toxic"].to_numpy().copy()
    del rows
    give_back()
    if len(set(y.tolist())) < 2:
        return None

    def built(use: np.ndarray) -> CompressionModel:
        own = [[text[i] for i in np.flatnonzero(use & (y == k))] for k in (0, 1)]
        # What is likeliest to be met stands last, nearest to the window.
        common = " ".join(reversed(common_words(own[0], 4000))) + " "
        return CompressionModel(common.encode(), " ".join(reversed(telling_passages(own[1], own[0]))).encode())

    # The logistic model sees each document under dictionaries made without it.
    half, column = np.arange(len(y)) % 2 == 0, pa.array(text)
    x = np.zeros((len(y), 3 * len(STEPS) + 1))
    for use in (half, ~half):
        x[~use] = built(use).features(column.filter(pa.array(~use)), keep=50_000)
        give_back()
    model = built(np.ones(len(y), dtype=bool))
    total = have[0] + have[1]
    prior = {k: have[k] / total for k in (0, 1)}
    size = {k: int((y == k).sum()) for k in (0, 1)}
    weight = np.array([prior[int(k)] * len(y) / size[int(k)] for k in y])
    model.fit(x, y, weight)
    model._ready = None
    del text, column
    give_back()
    return model


def score(docs: DataFrame, model: CompressionModel | None, columns: list[str] | None = None, name: str = "score") -> DataFrame:
    """``columns`` of ``docs`` (doc_id) and the score, 0 to 1, of each whole text."""
    columns = columns or ["doc_id"]
    text_name = free([*columns, name], "text")

    def run(batches):
        for batch in batches:
            text = batch.column(len(columns))
            s = np.zeros(len(batch)) if model is None else model.scores(text)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), pa.array(s, pa.float64())], names=[*columns, name])
        if model is not None:
            model._ready = None

    kept = docs.select(*columns, F.col("text").alias(text_name))
    schema = docs.select(*columns).schema.add(name, "double")
    return kept.mapInArrow(tidy(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame, spark: SparkSession, max_docs: int = 8000) -> DataFrame:
    """doc_id and score of every document, learnt from ``labels``."""
    small_batches(spark)
    return score(docs, train(docs, labels, max_docs))


def reject_toxic(docs: DataFrame, labels: DataFrame, spark: SparkSession, at: float = 0.7, training: DataFrame | None = None) -> DataFrame:
    """``docs`` without documents whose score is ``at`` or more, learnt from ``training`` (or ``docs``) and ``labels``;
    all columns stay as they are."""
    small_batches(spark)
    name = free(docs.columns, "toxic")
    return score(docs, train(docs if training is None else training, labels), docs.columns, name).where(F.col(name) < at).drop(name)
