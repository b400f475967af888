"""License scans with a positional index of rare words."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import query, table, text_of

# Phrases and labels of the base scan.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# The parts of the BSD licences, and the names and versions in the notices of the Free Software Foundation.
_BSD = ("redistribution and use in source and binary forms with or without modification are permitted provided that the"
        " following conditions are met redistributions of source code must retain the above copyright notice this list of"
        " conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice"
        " this list of conditions and the following disclaimer in the documentation and or other materials provided with"
        " the distribution")
_ADVERT = ("all advertising materials mentioning features or use of this software must display the following"
           " acknowledgement this product includes software developed by")
_ENDORSE = ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
            " products derived from this software without specific prior written permission",
            "the name of the author may not be used to endorse or promote products derived from this software without"
            " specific prior written permission")
_DISCLAIMER = ("this software is provided by the copyright holders and contributors as is and any express or implied"
               " warranties including but not limited to the implied warranties of merchantability and fitness for a"
               " particular purpose are disclaimed")
_FSF = [(["gpl-2.0"], "general", "2"), (["gpl-3.0"], "general", "3"), (["agpl", "agpl-3.0"], "affero general", "3"),
        (["lgpl", "lgpl-2.0"], "library general", "2"), (["lgpl", "lgpl-2.1"], "lesser general", "2 1"),
        (["lgpl", "lgpl-3.0"], "lesser general", "3")]


def _fsf_notices(labels: list[str], name: str, version: str) -> list[tuple]:
    """Templates of the header notice: with later versions, with this version only, and with the version in the name."""
    start, by = "redistribute it and or modify it under the terms of the", "as published by the free software foundation"
    full = f"gnu {name} public license"
    # "version 2" does not stand for 2.1
    bars = [f"version {version} 1"] if version == "2" else []
    return [(label, text, keys, bars) for label in labels for text, keys in (
        (f"{start} {full} {by} either version {version} of the license or at your option any later version",
         [full, f"either version {version}"]),
        (f"{start} {full} {by} version {version} of the license", [full, f"foundation version {version}"]),
        (f"{start} {full} version {version} {by}", [f"{full} version {version}"]),
        (f"licensed under the {full} version {version}", [f"under the {full} version {version}"]))]


# Notices and passages of licences (label, words, phrases that must stand in the aligned place, phrases that
# must not, such as names of other licences), from the licences themselves. Labels without a version or variant stand beside those with one.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license"
                   " at http www apache org licenses license 2 0", ["apache org licenses"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"
            " provided that the following conditions are met", ["source and binary forms"]),
    ("bsd-2-clause", f"{_BSD} {_DISCLAIMER}", ["source and binary forms", "this software is provided"],
     ["endorse or promote products", "all advertising materials"]),
    *[("bsd-3-clause", f"{_BSD} {endorse} {_DISCLAIMER}",
       ["source and binary forms", "to endorse or promote products derived from this software"],
       ["all advertising materials"]) for endorse in _ENDORSE],
    *[("bsd-4-clause", f"{_BSD} {_ADVERT} {endorse} {_DISCLAIMER}",
       ["source and binary forms", "all advertising materials mentioning features or use of this software",
        "to endorse or promote products derived from this software"]) for endorse in _ENDORSE],
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license",
     ["creative commons attribution 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license",
     ["attribution noncommercial 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"],
     ["either the gnu general public license", "ordinary gnu general public license"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3",
     ["gnu general public license version 3"]),
    *[t for notice in _FSF for t in _fsf_notices(*notice)],
    ("agpl", "licensed under the gnu affero general public license", ["under the gnu affero general public license"]),
    ("gpl-2.0", "gnu general public license version 2 june 1991 copyright c 1989 1991 free software foundation inc",
     ["gnu general public license version 2 june 1991"]),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation inc",
     ["gnu general public license version 3 29 june 2007"]),
    ("agpl-3.0", "gnu affero general public license version 3 19 november 2007 copyright c 2007 free software foundation inc",
     ["gnu affero general public license version 3 19 november 2007"]),
    *[(label, "gnu library general public license version 2 june 1991 copyright c 1991 free software foundation inc",
       ["gnu library general public license version 2 june 1991"]) for label in ("lgpl", "lgpl-2.0")],
    *[(label, "gnu lesser general public license version 2 1 february 1999 copyright c 1991 1999 free software foundation inc",
       ["gnu lesser general public license version 2 1 february 1999"]) for label in ("lgpl", "lgpl-2.1")],
    *[(label, "gnu lesser general public license version 3 29 june 2007 copyright c 2007 free software foundation inc",
       ["gnu lesser general public license version 3 29 june 2007"]) for label in ("lgpl", "lgpl-3.0")],
    ("apache-2.0", "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use"
                   " reproduction and distribution", ["apache license version 2 0 january 2004"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is"
            " hereby granted", ["with or without fee"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"],
     ["use the gnu lesser", "version 2 0 the gnu lesser"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
            " documentation files the software to deal in the software without restriction",
     ["hereby granted free of charge"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ["free and unencumbered software"]),
]

#: Rare words of a template that are looked up (at least, and a share of a long one's words), the weighted share of its words
#: that must stand in order, and the words by which offsets of one template may differ (a share of its words, and at most).
ANCHORS = 4
ANCHOR_SHARE = 0.125
COVERAGE = 0.75
SLACK_SHARE = 0.25
SLACK = 24

# bytes of words: 0-9, a-z (A-Z lower-cased) and all of non-ASCII characters; others part words
_FOLD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class LicenseIndex:
    """Postings (template, place) of each template's rarest words, and what is needed to verify an alignment."""

    def __init__(self, idf: dict[bytes, float], anchors: int, coverage: float, base=None, templates=None):
        self.coverage = coverage
        self.entries = [(label, phrase.encode().split(), [], [], True) for phrase, label in (base or BASE_PHRASES).items()]
        self.entries += [(label, text.encode().split(), [k.encode().split() for k in keys],
                          [k.encode().split() for bars in rest for k in bars], False)
                         for label, text, keys, *rest in (TEMPLATES if templates is None else templates)]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.weights, self.needed = [], []
        for number, (_, words, _, _, base_entry) in enumerate(self.entries):
            weight = [idf.get(w, 1.0) for w in words]
            self.weights.append(weight)
            rare = sorted(set(words), key=lambda w: (-idf.get(w, 1.0), w))[
                :1 if base_entry else max(anchors, int(ANCHOR_SHARE * len(words)))]
            # a full-coverage phrase always holds its rarest word; a template may miss words, so two of its rare ones
            # must agree on the relative place, or its key phrase is found by the rarest
            self.needed.append(1 if base_entry else min(2, len(rare)))
            for place, word in enumerate(words):
                if word in rare:
                    self.postings[word].append((number, place))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], set[str], float]:
        """Base places (start, label), labels of the method, and the best weighted share of a template in place."""
        postings = self.postings
        votes: dict[int, dict[int, set[bytes]]] = defaultdict(lambda: defaultdict(set))
        for place, word in enumerate(words):
            if word in postings:
                for number, inside in postings[word]:
                    votes[number][place - inside].add(word)
        base, labels, best = [], set(), 0.0
        for number, starts in votes.items():
            label, template, keys, bars, is_base = self.entries[number]
            if is_base:
                for start in starts:
                    if start >= 0 and words[start:start + len(template)] == template:
                        base.append((start, label))
                        best = 1.0
                continue
            slack = min(SLACK, max(2, int(SLACK_SHARE * len(template))))
            ordered = sorted(starts)
            till, last = None, 0
            for at, start in enumerate(ordered):
                # words left out or put in shift what follows: neighbouring offsets count together
                last = max(last, at)
                while last < len(ordered) and ordered[last] <= start + slack:
                    last += 1
                if till is not None and start <= till:
                    continue
                found = set().union(*(starts[s] for s in ordered[at:last]))
                if len(found) < self.needed[number]:
                    continue
                window = words[max(0, start):max(0, ordered[last - 1] + len(template))]
                share = self._share(number, start, words, window)
                if share < self.coverage or any(_stands(k, window) for k in bars):
                    continue
                if all(_stands(k, window) for k in keys):
                    labels.add(label)
                    best = max(best, share)
                    till = ordered[last - 1]
        return sorted(base), labels, best

    def _share(self, number: int, start: int, words: list[bytes], window: list[bytes]) -> float:
        """The weighted share of a template's words that stand in their places from `start` on, or else in order in `window`."""
        template, weight = self.entries[number][1], self.weights[number]
        total = sum(weight)
        inside = [b""] * max(0, -start) + words[max(0, start):start + len(template)]
        share = sum(w for a, b, w in zip(template, inside, weight) if a == b) / total
        present = set(window)
        if share >= 1.0 or sum(w for a, w in zip(template, weight) if a in present) / total < self.coverage:
            return share
        # weighted longest common subsequence, a row of all places of the window for each word of the template
        number_of = {w: i for i, w in enumerate(set(template))}
        codes = np.array([number_of.get(w, -1) for w in window])
        row = np.zeros(len(window) + 1)
        for word, w in zip(template, weight):
            if word in present:
                row[1:] = np.maximum(row[1:], row[:-1] + np.where(codes == number_of[word], w, 0.0))
                np.maximum.accumulate(row, out=row)
        return max(share, min(1.0, row[-1] / total))


def _stands(phrase: list[bytes], words: list[bytes]) -> bool:
    return any(words[i:i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))


def word_idf(docs: DataFrame, text_col: str = "text") -> dict[bytes, float]:
    """Inverse document frequency of the licence words over all documents; one number per word of the fixed list."""
    vocabulary = {w for phrase in BASE_PHRASES for w in phrase.encode().split()}
    vocabulary |= {w for _, text, *_ in TEMPLATES for w in text.encode().split()}

    def count(batches):
        seen: Counter = Counter()
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column("text"):
                seen.update(vocabulary.intersection(words_of(text.as_py())))
        yield pa.RecordBatch.from_pydict(
            {"word": [None, *(w.decode() for w in seen)], "n": pa.array([rows, *seen.values()], pa.int64())},
            schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

    counts = {r["word"]: r["n"] for r in docs.select(text_of(docs, text_col).alias("text"))
              .mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = counts.pop(None, 0)
    return {w: math.log((total + 1) / (counts.get(w.decode(), 0) + 0.5)) + 0.1 for w in vocabulary}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchors: int = ANCHORS,
                  coverage: float = COVERAGE) -> DataFrame:
    """Licences named or quoted in every whole text.

    id, n_words, places ARRAY<STRUCT<start, label>> of the base phrases in order, labels ARRAY (base and method, sorted),
    score (0 to 1: 1 with a base phrase, else the weighted share of the best template). Null is the empty text: no words,
    no places, score 0. Rows are independent, so repeated rows and null ids do no harm; an empty table gives no rows.
    The inverse document frequencies are counted over all documents; the driver holds one number per licence word.
    """
    idf = word_idf(docs, text_col)
    rows = docs.select(F.col(id_col).alias("id"), text_of(docs, text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    place = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))

    def run(batches):
        index = LicenseIndex(idf, anchors, coverage)
        for batch in batches:
            sizes, places, labels, scores = [], [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                base, found, best = index.scan(words)
                sizes.append(len(words))
                places.append([{"start": s, "label": n} for s, n in base])
                labels.append(sorted({n for _, n in base} | found))
                scores.append(min(1.0, best))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(places, place),
                 pa.array(labels, pa.list_(pa.string())), pa.array(scores, pa.float64())],
                ["id", "n_words", "places", "labels", "score"])

    return rows.mapInArrow(run, f"id {kind}, n_words bigint, places array<struct<start: bigint, label: string>>, "
                                "labels array<string>, score double").withColumnRenamed("id", id_col)


@query("op4_licenses")
def op4_licenses(spark, sf_dir):
    found = scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.col("places.start")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("places.label")), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score")
