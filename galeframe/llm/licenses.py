"""License scans by diagonal voting.

All rolling word k-gram hashes of all documents are joined with the positions that they have in the license
templates. A match at word i of a document and word j of a template lies on diagonal i - j. Matches
are counted by diagonal, neighbouring diagonals are merged (a word more or less only shifts the text by
one), and a span is verified by the template's words that its matches cover.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import prepare
from galeframe.llm.textarray import slices, words

SCHEMA = "doc_id long, license string, template string, first_word long, n_words long, first_byte long, n_bytes long, matched long, share double"

#: Notices and texts by (license, template); the words are what counts, not case or punctuation.
TEMPLATES: dict[tuple[str, str], str] = {
    ("MIT", "notice"): "Released under the MIT License",
    ("MIT", "licensed"): "Licensed under the MIT License",
    ("MIT", "spdx"): "SPDX-License-Identifier: MIT",
    ("MIT", "grant"): "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ("MIT", "warranty"): "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
    ("Apache-2.0", "notice"): "Licensed under the Apache License, Version 2.0",
    ("Apache-2.0", "spdx"): "SPDX-License-Identifier: Apache-2.0",
    ("Apache-2.0", "warranty"): "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ("GPL-2.0", "notice"): "This work is licensed under the GNU General Public License, version 2",
    ("GPL-3.0", "notice"): "This work is licensed under the GNU General Public License, version 3",
    ("GPL-3.0", "terms"): "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ("GPL", "warranty"): "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    ("LGPL", "notice"): "licensed under the GNU Lesser General Public License",
    ("BSD", "conditions"): "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ("BSD", "notice"): "Use of this source code is governed by a BSD-style license",
    ("MPL-2.0", "notice"): "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ("CC-BY-4.0", "notice"): "Licensed under CC BY 4.0",
    ("CC-BY-SA-4.0", "notice"): "Licensed under CC BY-SA 4.0",
    ("CC-BY-NC-4.0", "notice"): "Licensed under CC BY-NC 4.0",
    ("CC-BY", "name"): "This work is licensed under a Creative Commons Attribution License",
    ("ISC", "grant"): "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ("Unlicense", "notice"): "This is free and unencumbered software released into the public domain",
}


@dataclass(frozen=True)
class Settings:
    """k: words of a gram; near: diagonals that are merged; share: of a template's words that a span must match, in order."""

    k: int = 3
    near: int = 3
    share: float = 0.8


def _word_hashes(text: str) -> np.ndarray:
    return words(pa.array([text], pa.string())).hash


def gram_hashes(rows: DataFrame, k: int) -> DataFrame:
    """(row, doc_id, position, hash, low, high) for every run of k words of every text; low and high are its bytes' bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 18):
                w = words(part.column(2))
                at, h = w.grams(k)
                doc = w.doc[at]
                own, begin = pa.array(doc), w.offsets[doc]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(own),
                        part.column(1).take(own),
                        pa.array((at - w.first[doc]).astype(np.int32)),
                        pa.array(h.view(np.int64)),
                        pa.array((w.start[at] - begin).astype(np.int32)),
                        pa.array((w.end[at + k - 1] - begin).astype(np.int32)),
                    ],
                    names=["row", "doc_id", "position", "hash", "low", "high"],
                )

    return rows.mapInArrow(run, "row long, doc_id long, position int, hash long, low int, high int")


def scan(docs: DataFrame, templates: dict[tuple[str, str], str] = TEMPLATES, settings: Settings = Settings()) -> DataFrame:
    """A row for each verified span: which license and template, where in words and bytes, how many words match, and their share.

    A word of a template is matched where a run of k words around it (or the whole template, if that is shorter) is found on one of
    the span's diagonals, which lie within near of each other. A span needs share of the template's words; of overlapping
    spans of a document the one with most matched words stays (ties: the larger share, the earlier, the first license).
    Words are compared without case and punctuation. Null and empty texts have no words and give no rows. Repeated
    rows are scanned one by one and give equal rows. Null ids stay, an empty table gives no rows. Other columns are ignored. Templates
    are a fixed list and are broadcast; texts are read once and not shuffled, only the votes are.
    """
    prepare(docs.sparkSession)
    spark, s = docs.sparkSession, settings
    names = sorted(templates)
    sizes = [len(_word_hashes(templates[n])) for n in names]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    votes = None
    for k in sorted({min(s.k, n) for n in sizes if n}):
        known = []
        for t, n in enumerate(sizes):
            if n and min(s.k, n) == k:
                at, g = words(pa.array([templates[names[t]]], pa.string())).grams(k)
                known += [(int(x), t, int(j)) for j, x in zip(at, g.view(np.int64))]
        table = spark.createDataFrame(known, "hash long, template int, offset int")
        found = gram_hashes(rows, k).join(F.broadcast(table), "hash").withColumn("k", F.lit(k))
        votes = found if votes is None else votes.unionByName(found)
    if votes is None:
        return spark.createDataFrame([], SCHEMA)
    diagonals = votes.groupBy("row", "doc_id", "template", (F.col("position") - F.col("offset")).alias("diagonal")).agg(
        F.collect_list(F.struct("position", "offset", "k", "low", "high")).alias("votes")
    )
    spots = diagonals.groupBy("row", "doc_id").agg(F.collect_list(F.struct("template", "diagonal", "votes")).alias("spots"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for t, first, end, low, high, matched in _best(_spans(own, sizes, s), names, sizes):
                    out.append((doc, *names[t], first, end - first, low, high - low, matched, matched / sizes[t]))
            frame = pd.DataFrame(out, columns=_COLUMNS).astype({"doc_id": "Int64"})
            yield pa.RecordBatch.from_pandas(frame, schema=_ARROW, preserve_index=False)

    return spots.mapInArrow(check, SCHEMA)


_COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
_ARROW = pa.schema([(c, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]]) for c, x in zip(_COLUMNS, SCHEMA.split(", "))])


def _spans(spots: list[dict], sizes: list[int], s: Settings) -> list[tuple]:
    """(template, first word, end, first byte, end, matched words) of the candidate spans of one text."""
    out = []
    by: dict[int, list[dict]] = {}
    for spot in spots:
        by.setdefault(spot["template"], []).append(spot)
    for t, own in by.items():
        own.sort(key=lambda x: x["diagonal"])
        end = 0
        for i, spot in enumerate(own):
            while end < len(own) and own[end]["diagonal"] <= spot["diagonal"] + s.near:
                end += 1
            group = [x for y in own[i:end] for x in y["votes"]]
            covered = {x["offset"] + j for x in group for j in range(x["k"])}
            if len(covered) >= s.share * sizes[t]:
                last = max(x["position"] + x["k"] for x in group)
                out.append((t, min(x["position"] for x in group), last, min(x["low"] for x in group), max(x["high"] for x in group), len(covered)))
    return out


def _best(spans: list[tuple], names: list[tuple[str, str]], sizes: list[int]) -> list[tuple]:
    """The spans that stay of overlapping ones, by place. Those that stay don't overlap, so a new one is compared with its neighbours alone."""
    starts: list[int] = []
    kept: list[tuple] = []
    for x in sorted(spans, key=lambda x: (-x[5], -x[5] / sizes[x[0]], x[1], names[x[0]])):
        at = bisect_left(starts, x[1])
        if (at == 0 or kept[at - 1][2] <= x[1]) and (at == len(kept) or x[2] <= kept[at][1]):
            starts.insert(at, x[1])
            kept.insert(at, x)
    return kept
