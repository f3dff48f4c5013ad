"""License scan: an exact set-similarity join of text blocks with license notices."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import sliced, text_or_empty, word_pieces

#: Bytes of text at once; share of a notice's words that a block must hold; most words of all notices, as their index goes to every task.
STEP, THRESHOLD, MOST_WORDS = 1 << 20, 0.9, 20_000

# Phrases that give a label wherever their words stand in a row.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Notices as their licenses word them (one of the GNU license without its number), with their labels.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "This software is released under the MIT License"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version of the License, or (at your option) any later version"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("lgpl-3", "licensed under the GNU Lesser General Public License, version 3"),
    ("agpl-3", "licensed under the GNU Affero General Public License, version 3"),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]


class Index:
    """Words of notices in one global order, rarest in the corpus first, and the notices as sets of their places in it.

    A notice's size class is the least power of two that its words (repeats counted) fit in, 8 at least, and
    not less than that of a notice with another label and all its words. It is looked for in blocks of twice that
    many words, which begin at every multiple of the class: so each stretch of a text as long as the class
    lies within a block.
    """

    def __init__(self, notices: list[tuple[str, str]], phrases: dict[str, str], threshold: float) -> None:
        worded = [[w for piece in word_pieces(text, STEP) for w in piece] for _, text in notices]
        self.phrases = [[w for piece in word_pieces(text, STEP) for w in piece] for text in phrases]
        if sum(map(len, worded + self.phrases)) > MOST_WORDS:
            raise ValueError(f"notices of more than {MOST_WORDS} words in all")
        if not worded or not all(map(len, worded + self.phrases)):
            raise ValueError("no notices, or one or a phrase without words")
        self.words = sorted({w for x in worded + self.phrases for w in x})
        self.names = list(phrases.values())
        self.labels, self.sets = [x for x, _ in notices], [set(w) for w in worded]
        self.wider = [[j for j, t in enumerate(self.sets) if s < t and self.labels[i] != self.labels[j]] for i, s in enumerate(self.sets)]
        own = [max(8, 1 << (len(w) - 1).bit_length()) for w in worded]
        self.classes = [max([own[i], *(own[j] for j in w)]) for i, w in enumerate(self.wider)]
        self.least = [max(1, int(np.ceil(threshold * len(s) - 1e-9))) for s in self.sets]
        self.order(np.zeros(len(self.words), np.int64))

    def order(self, counts: np.ndarray) -> None:
        """Give words their places, ascending by how often each occurs in the corpus (ties in byte order)."""
        self.place = {self.words[i]: k for k, i in enumerate(np.lexsort((np.arange(len(self.words)), counts)).tolist())}

    def notices(self, spark: SparkSession) -> DataFrame:
        """label, size (of its class), least (words in common), words (their places, in order), wider (the same of notices with another label, all its words and more)."""
        words = [sorted(self.place[w] for w in s) for s in self.sets]
        rows = [(self.labels[i], self.classes[i], self.least[i], words[i], [(self.least[j], words[j]) for j in wider]) for i, wider in enumerate(self.wider)]
        return spark.createDataFrame(rows, "label string, size int, least int, words array<int>, wider array<struct<least:int,words:array<int>>>")


def _hits(index: Index, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the index in texts: the text, place in it and place in the order of each, and how many words each text has in all."""
    sizes, of, at, place = np.zeros(len(texts), np.int64), [], [], []
    for i, text in enumerate(texts):
        for words in word_pieces(text, STEP):
            found = np.fromiter(map(index.place.get, words, repeat(-1)), np.int64, len(words))
            hit = np.flatnonzero(found >= 0)
            of.append(np.full(len(hit), i))
            at.append(hit + sizes[i])
            place.append(found[hit])
            sizes[i] += len(words)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(of), join(at), join(place), sizes


def _word_counter(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.words), np.int64)
        for batch in batches:
            for part in sliced(batch, "text", STEP):
                total += np.bincount(_hits(index, part.column("text").to_pylist())[2], minlength=len(total))
        yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], ["place", "n"])

    return run


_BLOCKS = pa.list_(pa.struct([("size", pa.int32()), ("words", pa.list_(pa.int32()))]))


def _blocks(index: Index, texts: int, of: np.ndarray, at: np.ndarray, place: np.ndarray) -> pa.Array:
    """Of each text its distinct blocks that hold as many words of the index as some notice of their size needs."""
    wide, rows = len(index.words), [[] for _ in range(texts)]
    for size in sorted(set(index.classes)):
        least = min(n for n, c in zip(index.least, index.classes, strict=True) if c == size)
        held = np.unique([place_of for x, c in zip(index.sets, index.classes, strict=True) if c == size for place_of in map(index.place.get, x)])
        own = np.isin(place, held)
        o, p, k = of[own], at[own] // size, place[own]
        block = np.concatenate([p, np.maximum(p - 1, 0)])
        most = int(block.max(initial=0)) + 1
        keys = np.unique((np.tile(o, 2) * most + block) * wide + np.tile(k, 2))
        start = np.flatnonzero(np.diff(keys // wide, prepend=-1))
        length = np.diff(np.append(start, len(keys)))
        seen = set()
        for s, n in zip(start[length >= least].tolist(), length[length >= least].tolist(), strict=True):
            words, text = (keys[s : s + n] % wide).astype(np.int32), int(keys[s] // wide // most)
            if (text, words.tobytes()) not in seen:
                seen.add((text, words.tobytes()))
                rows[text].append({"size": size, "words": words})
    return pa.array(rows, _BLOCKS)


def _phrases(index: Index, texts: int, of: np.ndarray, at: np.ndarray, place: np.ndarray) -> list[pa.Array]:
    """Of each text how often phrases occur, the first and last word at which one begins, and their labels."""
    where, which = [], []
    for i, phrase in enumerate(index.phrases):
        n = len(phrase)
        begin = np.arange(max(0, len(at) - n + 1))
        same = (of[begin] == of[begin + n - 1]) & (at[begin + n - 1] - at[begin] == n - 1)
        for k, word in enumerate(phrase):
            same &= place[begin + k] == index.place[word]
        where.append(begin[same])
        which.append(np.full(int(same.sum()), i))
    where, which = np.concatenate(where), np.concatenate(which)
    text = of[where]
    n = np.bincount(text, minlength=texts)
    first, last = np.full(texts, np.iinfo(np.int64).max), np.full(texts, -1)
    np.minimum.at(first, text, at[where])
    np.maximum.at(last, text, at[where])
    labels: list[set] = [set() for _ in range(texts)]
    for t, w in zip(text.tolist(), which.tolist(), strict=True):
        labels[t].add(index.names[w])
    return [pa.array(n, pa.int64()), pa.array(first, pa.int64(), mask=n == 0), pa.array(last, pa.int64(), mask=n == 0), pa.array([sorted(x) for x in labels], pa.list_(pa.string()))]


def _scanner(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text", STEP):
                *found, sizes = _hits(index, part.column("text").to_pylist())
                yield pa.record_batch([part.column("doc_id"), pa.array(sizes), *_phrases(index, len(part), *found), _blocks(index, len(part), *found)], names)

    return run


def license_scan(docs: DataFrame, notices: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses that each text names: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    base_labels are those of the phrases whose words stand in a row; n_base counts their places, first_word
    and last_word are the first and last of them. labels adds those of notices of which a block of the text holds
    the share threshold of the distinct words. In a block, a notice of another label with all words of one and more
    takes its place. score is the greatest share that a block has of a notice it is labelled with, 1 with a phrase,
    0 without either.

    The join is exact. Words of notices are counted in all texts and put in one order, rarest first; a block
    is the ordered set of those it holds (blocks with fewer than any notice of their length needs end there: the
    length filter). Its words within the prefix meet the notices' within theirs; a match must leave enough words behind it on
    both sides (the positional filter); sets of pairs that pass are intersected. Notices are a bounded list,
    which is why their index is broadcast. Null and empty texts have no words and no labels; null ids and
    repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    index = Index(NOTICES if notices is None else notices, PHRASES if phrases is None else phrases, threshold)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    counts = rows.select("text").mapInArrow(_word_counter(index), "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()
    by_place = {r["place"]: r["n"] for r in counts}  # as many as there are words in the index
    index.order(np.array([by_place.get(index.place[w], 0) for w in index.words], np.int64))
    every = index.notices(docs.sparkSession).withColumnRenamed("words", "t_words").withColumnRenamed("size", "t_size")
    entries = every.select("t_size", "label", "least", "t_words", "wider", F.posexplode(F.slice("t_words", 1, F.size("t_words") - F.col("least") + 1)).alias("t_pos", "t_word"))

    scan = rows.mapInArrow(_scanner(index), "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base array<string>, blocks array<struct<size:int,words:array<int>>>")
    own = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base"]
    blocks = scan.withColumn("row", F.monotonically_increasing_id()).select(*own, F.posexplode_outer("blocks").alias("nth", "block"))
    # A block's prefix ends where too few words follow for the notice of its size that needs fewest.
    fewest = {size: min(n for n, c in zip(index.least, index.classes, strict=True) if c == size) for size in set(index.classes)}
    enough = F.coalesce(*[F.when(F.col("block.size") == size, F.lit(n)) for size, n in sorted(fewest.items())], F.lit(1))
    probes = blocks.select(*own, "nth", F.col("block.size").alias("size"), F.col("block.words").alias("words"), F.posexplode_outer(F.slice("block.words", F.lit(1), F.greatest(F.lit(0), F.size("block.words") - enough + 1))).alias("pos", "word"))
    behind = (F.size("words") - F.col("pos") >= F.col("least")) & (F.size("t_words") - F.col("t_pos") >= F.col("least"))
    met = probes.join(F.broadcast(entries), (F.col("size") == F.col("t_size")) & (F.col("word") == F.col("t_word")) & behind, "left")
    common = F.size(F.array_intersect("words", "t_words"))
    beaten = F.exists("wider", lambda t: F.size(F.array_intersect("words", t["words"])) >= t["least"])
    met = met.withColumn("share", F.when((common >= F.col("least")) & ~beaten, common / F.size("t_words")))
    first = F.coalesce(F.col("nth"), F.lit(0)) + F.coalesce(F.col("pos"), F.lit(0)) == 0  # a row of each text goes on
    best = met.where(first | F.col("share").isNotNull()).groupBy(*own).agg(F.collect_set(F.when(F.col("share").isNotNull(), F.col("label"))).alias("more"), F.max("share").alias("share"))
    labels = F.array_sort(F.array_union("base", "more"))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return best.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
