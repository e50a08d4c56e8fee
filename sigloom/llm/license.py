"""License scans: a positional index of rare licence words, intersected by relative position. DataFrame code only.

The words of all templates are counted over the whole corpus first (a bounded table: one row for each template word),
which ranks them by inverse document frequency. Each template is then indexed by its rarest words. A file is looked
up by the anchors it holds: where an anchor stands, the template would start at a fixed distance, and the other rare
words must stand at theirs (the postings intersected by relative position). A template is accepted where enough of
its rare words, weighted by rarity, line up at one start and its mandatory key phrases occur. Base phrases are
templates all of whose words must line up; all their places are found, whichever word is the anchor.

Each file is handled in its own row, with no shuffle, so neither copies nor a hot source can pile up.

Defined cases: a null or empty text has no words, labels '' and score 0. Repeated rows give repeated results. An empty
table ranks all words alike and returns no rows. Result columns replace input columns of their names.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Anchors tried for each template, rare words indexed for each, and the weight share that must line up.
ANCHORS, RARE, SHARE = 3, 10, 0.7

# Base phrases and their labels, then licence notices with the phrases that must occur.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
NOTICES = [
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse "
     "or promote products derived from this software", ["endorse or promote products"]),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license",
     ["creative commons attribution 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted", ["with or without fee is hereby granted"]),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", ["gnu lesser general public license"]),
    ("mit-notice", "released under the mit license", ["under the mit license"]),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files", ["permission is hereby granted free of charge"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ["unencumbered software released into the public domain"]),
]
RESULT = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def words_of(text: Column) -> Column:
    """Words of a text, A to Z lower-cased.

    ``lower`` changes more than A to Z, which cannot matter here: only ASCII words are ever compared, and the one other
    character whose lower case is ASCII (the Kelvin sign) is replaced first. Boundaries stay where they are.
    """
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def word_weights(words: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """Inverse document frequency of each template word over all rows of ``words``."""
    n = F.count(F.lit(1)).alias("n")
    seen = words.select(F.explode(F.array_append(
        F.array_intersect("words", F.array(*[F.lit(w) for w in vocabulary])), F.lit(""))).alias("w")).groupBy("w").agg(n)
    # one row for each template word, and one for the number of documents
    count = {r["w"]: r["n"] for r in seen.collect()}
    total = count.get("", 0)
    return {w: math.log((1 + total) / (1 + count.get(w, 0))) + 1e-6 for w in vocabulary}


def _at(start: Column, place: int, word: str) -> Column:
    return F.get("words", (start + place).cast("int")) == word


def scan(docs: DataFrame, base: list[tuple[str, str]] = BASE, notices: list[tuple[str, str, list[str]]] = NOTICES,
         share: float = SHARE) -> DataFrame:
    """``docs`` with the result columns (RESULT)."""
    rest = [c for c in docs.columns if c not in RESULT]
    split = docs.select(F.struct(*rest).alias("_row"), words_of(F.col("text")).alias("words"))
    phrases = [(label, text.split()) for text, label in base]
    templates = [(label, text.split(), keys) for label, text, keys in notices]
    vocabulary = sorted({w for _, ws in phrases for w in ws} | {w for _, ws, _ in templates for w in ws})
    weight = word_weights(split, vocabulary)

    def rarest(ws: list[str], n: int) -> list[str]:
        return sorted(dict.fromkeys(ws), key=lambda w: (-weight[w], w))[:n]

    anchors = sorted({w for _, ws in phrases for w in rarest(ws, 1)} | {w for _, ws, _ in templates for w in rarest(ws, ANCHORS)})
    # where the file holds an anchor: its postings; files without one are done
    known = F.arrays_overlap("words", F.array(*[F.lit(w) for w in anchors]))
    posting = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: x["w"].isin(anchors))
    found = split.withColumn("hits", F.when(known, posting))

    def starts(ws: list[str], anchor: str) -> Column:
        return F.transform(F.filter("hits", lambda x: x["w"] == anchor), lambda x: x["i"] - ws.index(anchor))

    def places_of(ws: list[str]) -> Column:
        """The starts where all words line up."""
        return F.filter(starts(ws, rarest(ws, 1)[0]), lambda s: reduce(and_, [_at(s, j, w) for j, w in enumerate(ws)]))

    def best_share(ws: list[str]) -> Column:
        """The largest weight share of the rare words that line up at one start."""
        rare = rarest(ws, RARE)
        total = sum(weight[w] for w in rare)
        every = F.concat(*[starts(ws, a) for a in rarest(ws, ANCHORS)])
        return F.array_max(F.transform(every, lambda s: reduce(add, [
            F.when(_at(s, ws.index(w), w), weight[w] / total).otherwise(0.0) for w in rare])))

    cols = {f"b{k}": places_of(ws) for k, (_, ws) in enumerate(phrases)}
    cols |= {f"t{k}": best_share(ws) for k, (_, ws, _) in enumerate(templates)}
    aligned = found.withColumns(cols)
    near = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"t{k}") >= share, F.lit(False)) for k in range(len(templates))])
    aligned = aligned.withColumn("joined", F.when(near, F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))))
    accepted = [reduce(and_, [F.col("joined").contains(f" {p} ") for p in keys], F.col(f"t{k}") >= share)
                for k, (_, _, keys) in enumerate(templates)]
    places = F.concat(*[f"b{k}" for k in range(len(phrases))])
    own = F.array_compact(F.array(*[F.when(F.size(f"b{k}") > 0, F.lit(label)) for k, (label, _) in enumerate(phrases)]))
    more = F.array_compact(F.array(*[F.when(ok, F.lit(label)) for ok, (label, _, _) in zip(accepted, templates)]))
    best = F.greatest(F.lit(0.0), *[F.when(ok, F.least(F.col(f"t{k}"), F.lit(1.0))).otherwise(0.0) for k, ok in enumerate(accepted)])
    text = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return aligned.select(
        "_row.*", F.size("words").cast("long").alias("n_words"),
        F.when(F.col("hits").isNull(), 0).otherwise(F.size(places)).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.coalesce(text(own), F.lit("")).alias("base_labels"), F.coalesce(text(F.concat(own, more)), F.lit("")).alias("labels"),
        F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"))
