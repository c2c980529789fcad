"""Document fingerprints by consistent weighted sampling, in built-in SQL functions only.

A text is a bag of lower-cased words (divided by blanks and line breaks) with their counts as weights. For each sample
and word, hashes give r and c from Gamma(2, 1) and b uniform on (0, 1); with t = floor(ln w / r + b), the word with the
least ln c - r (t - b + 1) is the sample, together with t. Two texts agree in a sample with a probability equal to
their generalised Jaccard similarity (sum of least weights over sum of largest), so the share of equal samples
estimates it. r and c take the 4096 quantiles of that distribution. A sample is kept as 16 bits, a fingerprint as their hexadecimal digits.

Null and empty texts hold one empty word: alike to each other, unlike (but by chance) any other text. Repeated rows
get a row each; a doc_id that repeats is followed by itself. A null doc_id counts as smaller than all others. Extra
columns are ignored.

Neighbours by doc_id come from buckets of consecutive doc_ids, some hundred documents each (bounded number of buckets,
placed by quantiles, so gaps in the ids do no harm). Each bucket also gets the first document of the next one, and
thus texts are shuffled once, and all later steps work inside a bucket's task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Documents in a bucket, at least; buckets, at most (the table of their first ids is broadcast).
BUCKET_DOCS, MOST_BUCKETS, QUANTILES = 500, 1 << 16, 256
_DIGITS = 16
#: Levels of Gamma(2, 1) that r and c take; parts of the vocabulary; samples in each.
LEVELS, STRATA, PER_STRATUM = 4096, 8, 8


def _numbers(values: list) -> Column:
    """An array literal, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _doubles(values: list[float]) -> Column:
    return F.split(F.lit(",".join(f"{x:.9g}" for x in values)), ",").cast("array<double>")


def bucketed(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` with a column ``bucket`` that does not fall as doc_id rises, and the number of documents."""
    got = docs.agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    n = got["n"]
    buckets = max(1, min(MOST_BUCKETS, n // BUCKET_DOCS))
    if got["lo"] is None or buckets == 1:
        return docs.withColumn("bucket", F.lit(0).cast("long")), n
    parts = min(buckets, QUANTILES)
    at = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 20 * QUANTILES)).first()[0]
    edges = [got["lo"], *sorted(set(at) - {got["lo"]}), got["hi"]]
    own, width = max(1, buckets // parts), _numbers(edges)
    # Number of edges at or below the id, the last edge not counted.
    part = F.size(F.filter(_numbers(edges[1:-1]), lambda e: e <= F.col("doc_id")))
    low, high = (F.element_at(width, part + F.lit(k)).cast("double") for k in (1, 2))
    inside = F.least(F.lit(own - 1), F.floor((F.col("doc_id").cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * own))
    return docs.withColumn("bucket", F.coalesce(part.cast("long") * own + inside, F.lit(-1).cast("long"))), n


def with_next(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """bucket, rid (place in it), ghost (a neighbour's copy), doc_id, text, next_text; null texts are empty."""
    rows, n = bucketed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")))
    along = Window.orderBy("bucket")
    # The first document of a bucket, as the window below sorts them: without doc_id first.
    firsts = rows.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", F.xxhash64("text"))).alias("first"))
    # One row a bucket, MOST_BUCKETS at most.
    firsts = firsts.select(
        F.col("first.doc_id").alias("first_id"), F.col("first.col3").alias("first_text"),
        F.coalesce(F.lag("bucket").over(along), F.max("bucket").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"),
    )
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.xxhash64("text") == F.col("first_text"))
    ghosts = rows.join(F.broadcast(firsts), is_first).select("doc_id", "text", F.col("to").alias("bucket"), F.lit(1).alias("ghost"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 2000))
    both = rows.withColumn("ghost", F.lit(0)).unionByName(ghosts).repartition(tasks, "bucket")
    order = Window.partitionBy("bucket").orderBy("ghost", "doc_id", F.xxhash64("text"))
    return both.select("bucket", F.row_number().over(order).alias("rid"), "ghost", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def words_of(text: Column) -> Column:
    got = F.array_remove(F.split(F.lower(text), "[ \\n\\t\\r]+"), "")
    return F.when(F.size(got) == 0, F.array(F.lit(""))).otherwise(got)


def gamma_quantiles(n: int = LEVELS) -> list[float]:
    """Quantiles of Gamma(2, 1) at the middles of n equal shares, by Newton's method on 1 - (1 + x) e^-x."""
    out, x = [], 1e-3
    for k in range(n):
        p = (k + 0.5) / n
        for _ in range(60):
            step = (1 - (1 + x) * math.exp(-x) - p) / (x * math.exp(-x))
            x = max(x / 2, x - step)
            if abs(step) < 1e-12 * x:
                break
        out.append(x)
    return out


def _draws(j: int) -> list[str]:
    """r, ln c and b of a row's sample j for its word, from one hash."""
    return [
        f"shiftrightunsigned(h{j}, 48) as h{j}",
        f"get(rs, cast(h{j} & {LEVELS - 1} as int)) as r{j}",
        f"get(cs, cast(shiftrightunsigned(h{j}, 12) & {LEVELS - 1} as int)) as c{j}",
        f"((shiftrightunsigned(h{j}, 24) & 16777215) + 0.5D) / 16777216D as b{j}",
    ]


def _sample(j: int, log_weight: str) -> str:
    """Least ln a over the words: its order in the upper bits, 16 bits of (word, t) in the lowest; no word, no value."""
    t = f"floor({log_weight} / r{j} + b{j})"
    return f"min(if({log_weight} is null, null, shiftleft(cast((c{j} - r{j} * ({t} - b{j} + 1) + 128) * 1073741824 as bigint), {_DIGITS}) | ((h{j} ^ {t}) & 65535)))"


def _packed(kind: str, k: int) -> str:
    """Four samples' digits in a long."""
    return " | ".join(f"shiftleft({kind}{4 * k + x} & 65535L, {48 - 16 * x})" for x in range(4))


def edited_fingerprints(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """Fingerprints of every text, of an edited text (its last half replaced by the start of the next document's), and
    the likeness of the fingerprint to the edited text's and to the next document's."""
    rows = with_next(docs, spark)
    n, half = F.length("text"), F.expr("length(text) div 2")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.when(F.col("ghost") == 0, F.concat(F.expr("left(text, length(text) - length(text) div 2)"), F.left("next_text", half)))
    )
    # What must reach the result travels as a last "word" of its own kind, so that nothing has to be joined later.
    note = F.concat_ws(",", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("n_chars").cast("string"), F.coalesce(F.sha2("edited", 256), F.lit("")), F.col("ghost").cast("string"))
    lists = (words_of(F.col("text")), F.when(F.col("ghost") == 0, words_of(F.col("edited"))), F.array(note))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(x, F.array().cast("array<string>")).alias("words")) for k, x in enumerate(lists)])
    words = rows.select("bucket", "rid", F.explode(kinds).alias("x")).select("bucket", "rid", F.col("x.kind").alias("kind"), F.explode("x.words").alias("word"))
    counted = words.groupBy("bucket", "rid", (F.col("kind") == 2).alias("note"), "word").agg(
        F.sum(F.expr("if(kind = 0, 1D, 0D)")).alias("w"), F.sum(F.expr("if(kind = 1, 1D, 0D)")).alias("v")
    )
    told_names = ["doc_id", "n_chars", "ghost", *(f"s{k}" for k in range(5))]
    part = lambda k: f"split_part(word, ',', {k})"
    told = [f"if(note, try_cast({part(1)} as bigint), null) as doc_id", f"if(note, cast({part(2)} as bigint), null) as n_chars", f"if(note, cast({part(4)} as int), null) as ghost"]
    told += [f"if(note, cast(conv(substring({part(3)}, {1 + 13 * k}, {min(13, 64 - 13 * k)}), 16, 10) as bigint), null) as s{k}" for k in range(5)]
    same_row = ["bucket", "rid", "g", "w", "v", "lw", "lv", *told_names]
    plain = counted.selectExpr("bucket", "rid", "if(note, 0D, w) as w", "if(note, 0D, v) as v", "if(note or w = 0, null, ln(w)) as lw", "if(note or v = 0, null, ln(v)) as lv", "if(note, 0L, xxhash64(word)) as term", *told)
    hashed = plain.withColumn("g", F.expr(f"cast(term & {STRATA - 1} as int)")).selectExpr(*same_row, *[f"xxhash64(term, {j}) as h{j}" for j in range(PER_STRATUM)])
    quantiles = gamma_quantiles()
    tables = {"rs": _doubles(quantiles), "cs": _doubles([math.log(x) for x in quantiles])}
    drawn = hashed.withColumns(tables).selectExpr(*same_row, *[x for j in range(PER_STRATUM) for x in _draws(j)])
    least = drawn.groupBy("bucket", "rid", "g").agg(
        *[F.expr(f"max({c}) as {c}") for c in told_names], F.expr("sum(w) as w"), F.expr("sum(v) as v"),
        *[F.expr(f"{_sample(j, 'lw')} as p{j}") for j in range(PER_STRATUM)], *[F.expr(f"{_sample(j, 'lv')} as q{j}") for j in range(PER_STRATUM)],
    )
    longs = range(PER_STRATUM // 4)
    alike = " + ".join(f"if((p{j} & 65535L) = (q{j} & 65535L), 1D, 0D)" for j in range(PER_STRATUM))
    packed = least.selectExpr(
        "bucket", "rid", "g", *told_names, f"({alike}) / {float(PER_STRATUM)}D as alike", "w + v as total",
        *[f"coalesce({_packed(x, k)}, 0L) as {x}{k}" for x in "pq" for k in longs], "cast(w as bigint) as pw", "cast(v as bigint) as qw",
    ).selectExpr("*", "total / (1 + alike) as most")
    parts = [f"max(if(g = {g}, {x}{k}, null)) as {x}{g}_{k}" for x in "pq" for g in range(STRATA) for k in (*longs, "w")]
    marks = packed.groupBy("bucket", "rid").agg(
        *[F.expr(f"max({c}) as {c}") for c in told_names], F.expr("sum(alike * most) / sum(most) as near_edited"), *[F.expr(x) for x in parts]
    )
    hexed = lambda x, n: F.lpad(F.hex(F.coalesce(F.col(x), F.lit(0))), n, "0")
    digits = lambda x: F.lower(F.concat(*[y for g in range(STRATA) for y in (*(hexed(f"{x}{g}_{k}", 16) for k in longs), hexed(f"{x}{g}_w", 8))]))
    sha = F.lower(F.concat(*[F.lpad(F.hex(f"s{k}"), min(13, 64 - 13 * k), "0") for k in range(5)]))
    out = marks.select(
        "bucket", "rid", "doc_id", "n_chars", "ghost", sha.alias("edited_sha256"), digits("p").alias("fingerprint"),
        F.when(F.col("ghost") == 0, digits("q")).alias("edited_fingerprint"), "near_edited",
    )
    along = Window.partitionBy("bucket").orderBy("rid")
    out = out.withColumn("next_fingerprint", F.lead("fingerprint").over(along)).where("ghost = 0")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", likeness("fingerprint", "next_fingerprint").alias("near_next"))


def likeness(a: str, b: str) -> Column:
    """Estimate of generalised Jaccard similarity from two columns of fingerprints."""
    width = 4 * PER_STRATUM + 8
    above, below = [], []
    for g in range(STRATA):
        same = " + ".join(f"if(substring({a}, {1 + g * width + 4 * j}, 4) = substring({b}, {1 + g * width + 4 * j}, 4), 1D, 0D)" for j in range(PER_STRATUM))
        total = " + ".join(f"cast(conv(substring({x}, {1 + g * width + 4 * PER_STRATUM}, 8), 16, 10) as double)" for x in (a, b))
        share = f"(({same}) / {float(PER_STRATUM)}D)"
        above.append(f"({share} * ({total}) / (1 + {share}))")
        below.append(f"(({total}) / (1 + {share}))")
    return F.expr(f"({' + '.join(above)}) / ({' + '.join(below)})")
