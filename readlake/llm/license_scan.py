"""License scan by diagonal voting.

All rolling word k-gram hashes of a text are joined to the positions of the same k-grams
in license templates. A hit votes for its diagonal (place in the text less place in the
template); neighbouring diagonals, which an added or left-out word separates, merge into
one candidate span, which is verified by a longest common subsequence of words.

Base phrases are short templates (k = 2) of which every k-gram has to vote on one
diagonal, that is, whose words stand consecutively. The library of templates is a
parameter of bounded size (``MOST_GRAMS``), so it is broadcast and the texts never shuffle.

Defined results: null or empty text has 0 words, no labels and score 0. Repeated rows are
scanned each alone, since rows are told apart by a row identity and not by doc_id.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from readlake.llm import bytewise
from readlake.llm.common import map_batches, with_uid

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Public wordings of common licenses by label: short notices, characteristic passages and whole texts.
_WARRANTY = "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_FREE = "you can redistribute it and or modify it under the terms of the gnu {} general public license as published by the free software foundation"
TEMPLATES = {
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement " + _WARRANTY,
    ],
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        _FREE.replace("{} ", ""),
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ],
    "lgpl": ["under the terms of the gnu lesser general public license as published by the free software foundation", _FREE.format("lesser")],
    "agpl": ["under the terms of the gnu affero general public license as published by the free software foundation", _FREE.format("affero")],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", _BSD,
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "mpl-2.0": [
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "if a copy of the mpl was not distributed with this file you can obtain one at",
    ],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means",
    ],
    "zlib": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "bsl-1.0": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "epl-2.0": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"],
}
#: Word k-grams of templates and of base phrases.
K, K_BASE = 3, 2
#: Diagonals at most this far apart merge.
SLACK = 3
#: Least share of a template's words in a verified span; above 6 of 7, so that one word tells short notices apart.
LEAST = 0.86
#: Least share of a template's k-grams that vote for a candidate, so that a few common words do not call for verification.
#: A span with ``LEAST`` of the words has over half of them, less two for each word put in.
VOTES = 0.25
#: Bound on the template positions, which are broadcast.
MOST_GRAMS = 100_000

_SENTINEL = -1


def _library(base: dict[str, str], templates: dict[str, list[str]]) -> tuple[list[tuple], list[dict]]:
    """(hash, template, position, k) rows, and the templates."""
    texts = [(t, label, K_BASE) for t, label in base.items()] + [(t, label, K) for label, ts in templates.items() for t in ts]
    rows, known = [], []
    for i, (text, label, k) in enumerate(texts):
        w = next(bytewise.scan(pa.array([text]), bytewise.ALNUM))
        h = w.hashes()
        if len(h) < k:
            raise ValueError(f"template of under {k} words: {text}")
        g, at = w.grams(h, k)
        rows += [(int(x), i, int(p), k) for x, p in zip(g.view(np.int64), at, strict=True)]
        known.append({"label": label, "k": k, "words": h})
    if len(rows) > MOST_GRAMS:
        raise ValueError("the template library is over its bound")
    return rows, known


def _profile(batch: pa.RecordBatch) -> pa.RecordBatch:
    """For each row its words' hashes, and a sentinel followed by its k-gram hashes, for both k."""
    n_words, words, wptr, grams, gptr = [], [], [np.zeros(1, np.int64)], [], [np.zeros(1, np.int64)]
    for w in bytewise.scan(batch.column("text"), bytewise.ALNUM):
        h, c = w.hashes(), w.counts
        parts = [w.grams(h, k) for k in (K_BASE, K)]
        row = w.rows()
        sizes = [np.maximum(c - k + 1, 0) for k in (K_BASE, K)]
        total = 1 + sizes[0] + sizes[1]
        ptr = np.concatenate([[0], np.cumsum(total)])
        out = np.empty(ptr[-1], np.int64)
        out[ptr[:-1]] = _SENTINEL
        for (g, at), skip in zip(parts, (1, 1 + sizes[0]), strict=True):
            r = row[at]
            out[ptr[r] + (at - w.ptr[r]) + (skip if isinstance(skip, int) else skip[r])] = g.view(np.int64)
        n_words.append(c)
        words.append(h.view(np.int64))
        wptr.append(wptr[-1][-1] + w.ptr[1:])
        grams.append(out)
        gptr.append(gptr[-1][-1] + ptr[1:])
    return pa.RecordBatch.from_arrays(
        [batch.column("_uid"), batch.column("doc_id"), pa.array(np.concatenate(n_words), pa.int64()),
         bytewise.list_array(np.concatenate(words), np.concatenate(wptr), pa.int64()), bytewise.list_array(np.concatenate(grams), np.concatenate(gptr), pa.int64())],
        names=["_uid", "doc_id", "n_words", "words", "grams"],
    )


def _lcs(a: list[int], b: list[int]) -> tuple[int, int, int]:
    """Length of the longest common subsequence, and the first and last place of ``b`` that it uses."""
    best: list[tuple[int, int, int]] = [(0, -1, -1)] * (len(b) + 1)
    for x in a:
        diagonal = best[0]
        for j, y in enumerate(b, 1):
            kept = best[j]
            if x == y:
                n, first, _ = diagonal
                new = (n + 1, first if n else j - 1, j - 1)
                best[j] = new if new[0] > max(kept[0], best[j - 1][0]) else max(kept, best[j - 1], key=lambda v: v[0])
            else:
                best[j] = kept if kept[0] >= best[j - 1][0] else best[j - 1]
            diagonal = kept
    return best[-1]


def spans(documents: DataFrame, base: dict[str, str] = BASE, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """Verified spans: _uid, doc_id, n_words, label, is_base, first, last, score; and for each
    document one row with a null label."""
    spark = documents.sparkSession
    rows, known = _library(base, templates)
    lib = spark.createDataFrame(rows + [(_SENTINEL, -1, 0, 0)], "hash bigint, template int, t_pos bigint, k int")
    sizes = F.create_map(*[F.lit(x) for i, t in enumerate(known) for x in (i, len(t["words"]))])
    wanted = F.create_map(*[F.lit(x) for i, t in enumerate(known) for x in (i, 1 if t["k"] == K_BASE else max(1, math.ceil(VOTES * (len(t["words"]) - K + 1))))])
    profile = map_batches(with_uid(documents).select("_uid", "doc_id", "text"), _profile, "_uid bigint, doc_id bigint, n_words bigint, words array<bigint>, grams array<bigint>", 2000)
    hits = (
        profile.select("_uid", "doc_id", "n_words", "words", F.posexplode("grams").alias("p", "hash"))
        .join(F.broadcast(lib), "hash")
        # A sentinel's hash may in theory equal a k-gram's; its place tells them apart.
        .filter(F.when(F.col("template") < 0, F.col("p") == 0).otherwise(F.col("p") > 0))
    )
    first_k = F.greatest(F.col("n_words") - (K_BASE - 1), F.lit(0))
    pos = F.when(F.col("k") == K_BASE, F.col("p") - 1).when(F.col("k") == K, F.col("p") - 1 - first_k).otherwise(F.lit(0))
    inside = F.when(F.col("k") == K_BASE, (F.col("p") >= 1) & (F.col("p") <= first_k)).when(F.col("k") == K, F.col("p") > first_k).otherwise(True)
    seg_at = F.greatest(F.col("diag") - SLACK, F.lit(0))
    votes = (
        hits.filter(inside).withColumn("pos", pos.cast("long")).withColumn("diag", F.col("pos") - F.col("t_pos"))
        .withColumn("seg_at", seg_at)
        .withColumn("seg", F.when(F.col("template") >= 0, F.slice("words", (F.col("seg_at") + 1).cast("int"), (sizes[F.col("template")] + 2 * SLACK).cast("int"))))
        .select("_uid", "doc_id", "n_words", "template", "k", "diag", "pos", "seg_at", "seg")
        .repartition("_uid")
        .groupBy("_uid", "doc_id", "n_words", "template", "k", "diag").agg(F.count("*").alias("votes"), F.min("pos").alias("lo"), F.first("seg_at").alias("seg_at"), F.first("seg").alias("seg"))
    )
    order = Window.partitionBy("_uid", "template").orderBy("diag")
    new = F.when((F.col("k") == K) & (F.col("diag") - F.lag("diag").over(order) <= SLACK), 0).otherwise(1)
    merged = (
        votes.withColumn("new", new).withColumn("cluster", F.sum("new").over(order))
        .groupBy("_uid", "doc_id", "n_words", "template", "cluster")
        .agg(F.sum("votes").alias("votes"), F.max_by(F.struct("seg_at", "seg", "diag"), F.struct("votes", -F.col("diag"))).alias("best"))
        .filter((F.col("template") < 0) | (F.col("votes") >= wanted[F.col("template")]))
        .select("_uid", "doc_id", "n_words", "template", "votes", "best.*")
    )
    shared = spark.sparkContext.broadcast(known)

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = batch.to_pydict()
        out = {c: [] for c in ("label", "is_base", "first", "last", "score")}
        keep = []
        for i, template in enumerate(t["template"]):
            found = (None, None, None, None, None)
            if template >= 0:
                x = shared.value[template]
                words = x["words"].view(np.int64).tolist()
                if x["k"] == K_BASE:
                    at = t["diag"][i] - t["seg_at"][i]
                    if t["diag"][i] < 0 or t["seg"][i][at : at + len(words)] != words:
                        continue
                    found = (x["label"], True, t["diag"][i], t["diag"][i] + len(words) - 1, 1.0)
                else:
                    n, first, last = _lcs(words, t["seg"][i])
                    if n < LEAST * len(words):
                        continue
                    found = (x["label"], False, t["seg_at"][i] + first, t["seg_at"][i] + last, n / len(words))
            keep.append(i)
            for c, v in zip(out, found, strict=True):
                out[c].append(v)
        kinds = {"label": pa.string(), "is_base": pa.bool_(), "first": pa.int64(), "last": pa.int64(), "score": pa.float64()}
        base = batch.select(["_uid", "doc_id", "n_words"]).take(pa.array(keep, pa.int64()))
        return pa.RecordBatch.from_arrays([*base.columns, *(pa.array(out[c], kinds[c]) for c in out)], names=[*base.schema.names, *out])

    return map_batches(merged, verify, "_uid bigint, doc_id bigint, n_words bigint, label string, is_base boolean, first bigint, last bigint, score double")


def _labels(where: Column) -> Column:
    return F.concat_ws(",", F.array_sort(F.collect_set(F.when(where, F.col("label")))))


def scan(documents: DataFrame, base: dict[str, str] = BASE, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    return (
        spans(documents.select("doc_id", "text"), base, templates).groupBy("_uid", "doc_id")
        .agg(
            F.max("n_words").alias("n_words"), F.count_if("is_base").cast("long").alias("n_base"),
            F.min(F.when(F.col("is_base"), F.col("first"))).alias("first_word"), F.max(F.when(F.col("is_base"), F.col("first"))).alias("last_word"),
            _labels(F.col("is_base")).alias("base_labels"), _labels(F.lit(True)).alias("labels"), F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
        )
        .drop("_uid")
    )


def brute_force(text: str | None, base: dict[str, str] = BASE) -> tuple:
    """The base part of the contract in plain Python, for tests."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in base.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))
