"""License scan by diagonal voting, besides a plain search for license phrases.

Words are runs of digits, ASCII letters (lower-cased) and non-ASCII characters. Every document is cut into rolling
word ``k``-grams; their hashes are joined with the positions of the same k-grams in license templates. Each meeting
votes for a diagonal (document position minus template position); votes are counted by diagonal, diagonals at most
``gap`` apart are merged (words added or left out shift the rest of a copy), and a merged band is taken for a copy of
the template when its votes cover at least ``cover`` of the template's k-grams within a span not much longer than the
template. The templates are constants, so their table has a fixed size and is broadcast; k-grams that no template has
are dropped in the scan, before the join.

Phrases: the places where a phrase's words stand consecutively, overlaps included. The score is the best coverage of a
verified band, 1 where a phrase stands.

Null and empty texts have no words and no labels. Repeated rows each get a row. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm import _text as tx
from orrery.llm._store import small_batches, stored, tidy

# Phrases and their labels, and texts by which public licenses are known.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
}


def _words(text: str) -> np.ndarray:
    return next(tx.blocks(pa.array([text]), tx.ALNUM)).hashes()


def template_rows(k: int) -> list[tuple[int, int, int, str, int]]:
    """(hash, template, position, label, number of k-grams), one for each k-gram of each template."""
    out = []
    for t, (label, text) in enumerate((label, text) for label, texts in TEMPLATES.items() for text in texts):
        h = _words(text)
        own = tx.gram_at(h, np.arange(max(0, len(h) - k + 1)), k)
        out += [(int(g), t, p, label, len(own)) for p, g in enumerate(tx.signed(own))]
    return out


def _scan(docs: DataFrame, k: int, wanted: np.ndarray) -> DataFrame:
    """doc_id, n_words, phrases (label, pos) and hits (hash, pos) of k-grams that a template has."""
    phrases = [(label, _words(text)) for text, label in PHRASES.items()]
    kinds = {
        "phrases": pa.list_(pa.struct([("label", pa.string()), ("pos", pa.int64())])),
        "hits": pa.list_(pa.struct([("gram", pa.int64()), ("pos", pa.int64())])),
    }

    def lists(rows, at, pos, what, kind):
        order = np.lexsort((pos, at))
        items = pa.StructArray.from_arrays([what.take(pa.array(order)), pa.array(pos[order])], names=[kind.value_type.field(0).name, "pos"])
        offs = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=rows))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offs), items).cast(kind)

    def scan(batches):
        for batch in batches:
            for block in tx.blocks(batch.column(1), tx.ALNUM):
                h = block.hashes()
                found = []
                for label, words in phrases:
                    at = np.flatnonzero(h[: max(0, len(h) - len(words) + 1)] == words[0])
                    for j in range(1, len(words)):
                        at = at[h[at + j] == words[j]]
                    at = at[block.row_of(at) == block.row_of(at + len(words) - 1)]
                    found += [(label, p) for p in at]
                g, at = tx.grams(h, block.first, k)
                hit = np.isin(g, wanted)
                at, g = at[hit], g[hit]
                row, p = block.row_of(at), np.array([p for _, p in found], dtype=np.int64)
                prow = block.row_of(p)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.lo, block.rows),
                        pa.array(block.counts.astype(np.int64)),
                        lists(block.rows, prow, p - block.first[prow], pa.array([x for x, _ in found], pa.string()), kinds["phrases"]),
                        lists(block.rows, row, at - block.first[row], pa.array(tx.signed(g)), kinds["hits"]),
                    ],
                    names=["doc_id", "n_words", "phrases", "hits"],
                )

    schema = "doc_id long, n_words long, phrases array<struct<label: string, pos: long>>, hits array<struct<gram: long, pos: long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(scan), schema)


def license_labels(docs: DataFrame, spark: SparkSession, k: int = 4, gap: int = 6, cover: float = 0.6) -> DataFrame:
    """doc_id, n_words, phrases (label, pos), spans (label, first, last, score of verified template copies)."""
    small_batches(spark)
    rows = template_rows(k)
    templates = spark.createDataFrame(rows, "gram long, template int, tpos int, label string, grams int")
    wanted = np.unique(np.array([r[0] for r in rows], dtype=np.int64)).view(np.uint64)
    scanned = stored(_scan(docs, k, wanted).withColumn("rid", F.monotonically_increasing_id()), spark, "licenses")
    hits = scanned.where(F.size("hits") > 0).select("rid", F.inline("hits"))
    met = hits.join(F.broadcast(templates), "gram").withColumn("diagonal", F.col("pos") - F.col("tpos"))
    key = ["rid", "template", "label", "grams"]
    votes = met.groupBy(*key, "diagonal").agg(
        F.collect_set("tpos").alias("tpos"), F.min("pos").alias("first"), F.max("pos").alias("last")
    )
    along = Window.partitionBy("rid", "template").orderBy("diagonal")
    # Copies of one template that follow each other are as far apart as it is long: bands are narrower.
    width = F.least(F.lit(gap), F.floor((F.col("grams") + (k - 1)) / 2))
    new = F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= width, 0).otherwise(1)
    bands = votes.withColumn("new", new).withColumn("chain", F.sum("new").over(along))
    start = F.min("diagonal").over(Window.partitionBy("rid", "template", "chain"))
    bands = bands.withColumn("band", F.floor((F.col("diagonal") - start) / F.greatest(F.lit(gap), F.floor((F.col("grams") + (k - 1)) / 2))))
    merged = bands.groupBy(*key, "chain", "band").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("tpos")))).alias("covered"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    merged = merged.withColumn("score", F.col("covered") / F.col("grams")).where(
        (F.col("score") >= cover) & (F.col("last") - F.col("first") <= 2 * F.col("grams") + gap)
    )
    spans = merged.groupBy("rid").agg(
        F.sort_array(F.collect_list(F.struct("first", (F.col("last") + k - 1).alias("last"), "label", "score"))).alias("spans")
    )
    return scanned.drop("hits").join(spans, "rid", "left").drop("rid")
