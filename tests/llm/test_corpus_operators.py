"""Spelling variants, collocations and exact deduplication against brute force and SQL."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import collocations, exact_dedup, queries, spelling

low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
LONG = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i % 7)}" for i in range(20_000))
AWKWARD = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "one", "en"), (5, "one", "de"), (5, "one", "de"), (None, "one", "en"), (7, LONG, "en"), (8, LONG, "fr"), (8, LONG, "fr"),
    (9, "ÄÖ ñandú façade ΣΑΣ ς İ K×÷ÿ", None), (10, "x" * 5000, "en"), (11, "wordé wordè. wordé wordè, wordé  \t wordè;\n" * 8, "fr"), (-5, "one\x0b  two", "en"), (12, "one two", "en"), (13, "one  two ", "en"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, lang, 7, "x", 1, 2, 3) for i, t, lang in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, rid int, digest string, size int, bucket int, word int").repartition(3, "text")


@pytest.fixture(scope="module")
def tables(spark, sf, awkward):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return {"docs": docs, "awkward": awkward, "empty": awkward.limit(0)}


def brute_words(rows):
    n = Counter()
    for i, text in rows:
        for w in map(low, re.findall("[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def test_spelling(spark, tables):
    for name, df in tables.items():
        rows = [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]
        n = brute_words(rows)
        got = {r["word"]: r for r in spelling.spelling_variants(df, spark).collect()}
        assert set(got) == set(n), name
        forms = {w: r["form"] for w, r in got.items()}
        want = brute_forms(n)
        for w, r in got.items():
            assert (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) == want[w], (name, w)
        assert name == "empty" or any(forms.values()) or name == "awkward"


def brute_forms(n):
    """form, root, n, n_near, form_n of each word."""
    near = defaultdict(set)
    holes = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
            if (x := w[:i] + w[i + 1 :]) in n:
                near[w].add(x)
                near[x].add(w)
    for ws in holes.values():
        for w in ws:
            near[w] |= ws - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.mark.parametrize("most", [2, 4, 48])
def test_near_words_in_divided_blocks(spark, most):
    """Words of few letters, so that blocks are crowded and are divided again and again."""
    rng = np.random.default_rng(5)
    n = {}
    for size in (5, 6, 7, 8, 11):
        for _ in range(120):
            n["".join(rng.choice(list("abé"), size))] = int(rng.integers(1, 60))
    for c in "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß":
        n["prefix" + c + "suffix"] = ord(c)
        n["prefixx" + c] = 5
    n["prefixsuffix"] = 400
    from orrery.llm._store import stored

    words = stored(spark.createDataFrame(list(n.items()), "word string, n long"), spark, "words")
    got = {r["word"]: (r["n_near"], r["form"], r["form_n"]) for r in spelling.near_words(words, spark, most).collect()}
    near = defaultdict(set)
    for a in n:
        for b in n:
            if a != b and abs(len(a) - len(b)) <= 1 and one_edit(a, b):
                near[a].add(b)
    want = {}
    for w, ws in near.items():
        best = min(ws, key=lambda x: (-n[x], x))
        want[w] = (len(ws), best, n[best])
    assert got == want


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_roots(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(23)] + [(f"v{i}", "w7") for i in range(5)]
    got = dict(map(tuple, spelling.roots(spark.createDataFrame(chain, "word string, form string"), spark).collect()))
    assert got == {w: "w23" for w, _ in chain}


def brute_collocations(rows, min_count=10, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", low(text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = defaultdict(list)
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    gone = set()
    for (lang, g), a in cand.items():
        if len(g) == 3:
            gone |= {(lang, s) for s in (g[:2], g[1:]) if 100 * a >= 50 * f[lang, s]}
    for (lang, g), a in cand.items():
        if (lang, g) in gone:
            continue
        score, _, l, r = min((10**6 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
        out[lang].append((-score, -a, " ".join(g).encode(), l, r))
    return {(lang, k + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, xs in out.items() for k, x in enumerate(sorted(xs)[:top])}


def test_collocations(spark, tables):
    for name, df in tables.items():
        rows = [(r[0], r[1]) for r in df.select("lang", "text").collect()]
        for count, top in ((10, 2000), (2, 7)):
            got = {tuple(r) for r in collocations.collocations(df, spark, min_count=count, top=top).collect()}
            assert got == brute_collocations(rows, count, top), name


def test_collocations_in_many_buckets(spark, tables, monkeypatch):
    """Small buckets, small sends and many shares give the same."""
    monkeypatch.setattr(collocations, "BUCKET_BYTES", 20_000)
    df = tables["docs"]
    rows = [(r[0], r[1]) for r in df.select("lang", "text").collect()]
    got = {tuple(r) for r in collocations.collocations(df, spark, min_count=3, top=50).collect()}
    assert got == brute_collocations(rows, 3, 50)


def test_first_of_each(spark):
    df = spark.range(5000).select(F.lit("a").alias("lang"), (F.col("id") * 7919 % 5003).alias("score"), F.col("id").cast("string").alias("phrase"))
    got = collocations.first_of_each(df, 5000, "lang", [F.desc("score"), F.asc("phrase")], 40, "phrase", share=50, fan=4).collect()
    want = sorted((-(i * 7919 % 5003), str(i)) for i in range(5000))[:40]
    assert sorted((r["rank"], r["phrase"]) for r in got) == [(k + 1, p) for k, (_, p) in enumerate(want)]


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000_000
    counts = spark.createDataFrame([("x", 1, "p", big + 7), ("x", 1, "q", big + 1), ("x", 2, "p q", big)], "lang string, size long, gram string, f long")
    got = collocations.cut_scores(counts.where("size > 1"), counts).first()
    assert got["score"] == 10**6 * big * big // ((big + 7) * (big + 1))


def brute_classes(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append((i is None, i or 0, k))
    out = []
    for t, members in groups.items():
        first = min(members)
        for m in members:
            i = None if m[0] else m[1]
            out.append((i, None if first[0] else first[1], len(members), m == first, hashlib.sha256(t.encode()).hexdigest()))
    return Counter(out)


def test_exact_dedup(spark, tables):
    for name, df in tables.items():
        rows = [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]
        got = Counter(map(tuple, exact_dedup.exact_classes(df, spark).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))
        assert got == brute_classes(rows), name
        for history in (F.lit(True), F.lit(False), F.col("doc_id") % 2 == 0):
            assert Counter(map(tuple, exact_dedup.exact_classes(df, spark, history).collect())) == brute_classes(rows), name


def test_remove_repeats(spark, tables):
    df = tables["awkward"]
    left = exact_dedup.remove_repeats(df, spark)
    assert left.columns == df.columns
    assert left.count() == len({re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t, _ in AWKWARD})
    seen = spark.createDataFrame([(99, "one"), (None, "one   two")], "doc_id long, text string")
    texts = {r["text"] for r in exact_dedup.remove_repeats(df, spark, seen).collect()}
    assert "one" not in texts and "one two" not in texts and "" in {t or "" for t in texts}


def test_perfect_hash():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 256, (5000, 32), dtype=np.uint8)
    sizes, bits, slots = exact_dedup.perfect_hash(keys)
    assert sorted(slots) == list(range(5000))
    held = keys[np.argsort(slots)]
    assert (exact_dedup.slots_of(keys, sizes, bits, held) == slots).all()
    assert (exact_dedup.slots_of(rng.integers(0, 256, (3000, 32), dtype=np.uint8), sizes, bits, held) == -1).all()
    assert exact_dedup.slots_of(keys[:0], sizes, bits, held).shape == (0,)
    # Keys that no level tells apart are compared one by one.
    sizes, bits, slots = exact_dedup.perfect_hash(keys[:9])
    none = np.zeros(0, bool)
    assert (exact_dedup.slots_of(keys[:9], [], none, keys[:9]) == np.arange(9)).all()


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_collocations", "op13_exact_dedup"])
def test_sql(spark, sf, name):
    from tests.oracle import connect, same

    assert same(spark, connect(sf), sf, queries.QUERIES[name], queries.ORACLES[name]) == ""
