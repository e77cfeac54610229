"""Licence scans by diagonal voting: word k-grams of a text against those of templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvid.llm.common import RID, lean, settled, text_rows

#: Base phrases: a place counts where all words stand consecutively.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Opening passages of well-known licence notices: label and text.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
]
#: Words in a k-gram of phrases and of notices, how far apart neighbouring diagonals may be, and the share of a notice's k-grams that makes a span of it.
PHRASE_K, NOTICE_K, DRIFT, SHARE = 2, 4, 8, 0.6

#: What stands between words, for both regular-expression engines.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text in lower case. Lower-casing other letters than A-Z, too, changes neither the boundaries of words nor a match of the ASCII templates."""
    return F.array_remove(F.split(F.lower(text), _BETWEEN), "")


def _python_words(text: str) -> list[str]:
    return [w for w in re.split(_BETWEEN, text.lower()) if w]


def templates(spark: SparkSession) -> DataFrame:
    """(template, label, kind, at, grams, gram): a row for each k-gram of each template; a fixed table of a few hundred rows."""
    rows = []
    for t, (text, label, k) in enumerate([(p, v, PHRASE_K) for p, v in PHRASES.items()] + [(text, label, NOTICE_K) for label, text in NOTICES]):
        w = _python_words(text)
        for at in range(len(w) - k + 1):
            rows.append((t, label, k, at, len(w) - k + 1, " ".join(w[at : at + k])))
    return spark.createDataFrame(rows, "template int, label string, k int, at int, grams int, gram string")


def chain(hits: list[tuple[int, int]]) -> tuple[int, int, int]:
    """Length, first and last place of the longest chain of hits (place in the text, place in the template).

    Both places rise from each hit to the next, so a template's k-gram counts once, and the
    diagonal changes by at most DRIFT.
    """
    on: dict[int, tuple[list, list]] = {}
    best = (0, 0, 0)
    for place, at in sorted(hits):
        d, own = place - at, (1, place)
        for e in range(d - DRIFT, d + DRIFT + 1):
            if e in on:
                places, found = on[e]
                k = bisect_left(places, min(place, at + e))
                if k and found[k - 1][0] >= own[0]:
                    own = (found[k - 1][0] + 1, found[k - 1][1])
        places, found = on.setdefault(d, ([], []))
        places.append(place), found.append(own)
        if own[0] > best[0]:
            best = (own[0], own[1], place)
    return best


def _chains(batches):
    for batch in batches:
        got = [chain([(h["place"], h["at"]) for h in hits]) for hits in batch.column("hits").to_pylist()]
        columns = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (RID, "template", "label", "k", "grams")), *columns], [RID, "template", "label", "k", "grams", "votes", "first", "last"])


def scan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans (RID, template, label, k, first, last, votes, grams, share) and the documents' (RID, doc_id, n_words).

    A k-gram that a text shares with a template votes for the diagonal: its place in the text
    less its place in the template. Votes are summed by diagonal; diagonals of a notice that
    lie within DRIFT of the one before are one span, so inserted or lost words don't break
    it. A phrase's span is kept when its diagonal has the vote of each of its k-grams. A
    notice's with votes enough is verified: SHARE of its k-grams must stand in the text in the
    template's order, each counted once (see chain); votes are those then.
    """
    spark = docs.sparkSession
    rows = text_rows(settled(docs))
    split = rows.select(RID, words(F.col("text")).alias("w"))
    shared = templates(spark)
    wanted = {k: [r["gram"] for r in shared.where(F.col("k") == k).select("gram").distinct().collect()] for k in (PHRASE_K, NOTICE_K)}
    # Places are exploded with the words that follow; only k-grams whose hash some template has go on to the join.
    ahead = F.arrays_zip(F.col("w").alias("a"), *(F.slice("w", k + 1, F.size("w")).alias("bcd"[k - 1]) for k in range(1, NOTICE_K)))
    placed = split.where(F.size("w") >= PHRASE_K).select(RID, F.posexplode(ahead).alias("place", "s")).select(RID, "place", *(F.col("s")[x].alias(x) for x in "abcd"))
    gram = {k: F.concat_ws(" ", *"abcd"[:k]) for k in (PHRASE_K, NOTICE_K)}
    hashed = {k: F.xxhash64(*"abcd"[:k]) for k in (PHRASE_K, NOTICE_K)}
    hashes = {k: [r[0] for r in spark.createDataFrame([tuple(g.split(" ")) for g in v], ", ".join(f"{x} string" for x in "abcd"[:k])).select(hashed[k]).distinct().collect()] for k, v in wanted.items()}
    hits = placed.where(reduce(lambda x, y: x | y, (hashed[k].isin(v) for k, v in hashes.items())))
    hits = hits.select(RID, "place", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), g.alias("gram")) for k, g in gram.items()))).alias("g")).select(RID, "place", "g.k", "g.gram")
    votes = hits.join(F.broadcast(shared), ["k", "gram"]).groupBy(RID, "template", "label", "k", "grams", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("votes"), F.collect_list(F.when(F.col("k") == NOTICE_K, F.struct("place", "at"))).alias("hits"))
    phrases = votes.where((F.col("k") == PHRASE_K) & (F.col("votes") == F.col("grams"))).select(RID, "template", "label", "k", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("grams") + PHRASE_K - 2).alias("last"), "votes", "grams")
    by = "template", "label", "k", "grams"
    order = Window.partitionBy(RID, "template").orderBy("diagonal")
    notices = votes.where(F.col("k") == NOTICE_K).withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT).cast("int"), F.lit(1)))
    notices = notices.withColumn("span", F.sum("new").over(order)).groupBy(RID, *by, "span").agg(F.sum("votes").alias("votes"), F.flatten(F.collect_list("hits")).alias("hits"))
    enough = F.col("votes") >= F.ceil(F.col("grams") * SHARE)
    notices = notices.where(enough).select(RID, *by, "hits").mapInArrow(lean(_chains), f"{RID} long, template int, label string, k int, grams int, votes long, first int, last int")
    notices = notices.where(enough).select(RID, "template", "label", "k", "first", (F.col("last") + NOTICE_K - 1).alias("last"), "votes", "grams")
    spans = phrases.unionByName(notices).withColumn("share", F.least(F.lit(1.0), F.col("votes") / F.col("grams")))
    return spans, rows.select(RID, "doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))


def query(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row for each row of documents.

    An empty or null text has no words, no labels and the score 0. The score is the largest
    share of a template found, so 1 with any base phrase.
    """
    spans, rows = scan(docs)
    base = F.col("k") == PHRASE_K
    joined = lambda x: F.concat_ws(",", F.array_sort(F.collect_set(x)))
    found = spans.groupBy(RID).agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.max("share").alias("score"),
    )
    none = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}
    return rows.join(found, RID, "left").select("doc_id", "n_words", *(F.coalesce(F.col(c), F.lit(none[c])).alias(c) if c in none else F.col(c) for c in found.columns[1:]))
