"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import query, table, text_of

#: Bounds of the training sample of each classifier, classifiers, features of each, rounds and step of training.
POSITIVES = 2000
UNLABELLED = 6000
MEMBERS = 3
FEATURES = 4096
ROUNDS = 400
STEP = 0.05
PREFIXES = (4, 5, 6)
#: Positives that a feature is in at least, and the share of its unlabelled texts that positives must explain.
LEAST = 3
KNOWN_SHARE = 0.65
#: Words of which training lists the features at a time; words that a scoring task remembers, and their longest length.
WORDS_AT_ONCE = 200_000
CACHE_WORDS = 50_000
CACHE_LENGTH = 40

_WORD = re.compile(r"[^\W\d_]+")


def distinct_words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def word_features(word: str) -> list[str]:
    """A word itself and its beginnings, marked by a star."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def _features_of(words: pa.Array) -> tuple[list[str], np.ndarray]:
    """Names of all features of distinct words, and per word the numbers of its own, -1 where it has fewer."""
    columns = [words]
    for k in PREFIXES:
        long = pc.greater(pc.utf8_length(words), k)
        start = pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, k), "*", "")
        columns.append(pc.if_else(long, start, pa.scalar(None, pa.string())))
    coded = pa.concat_arrays(columns).dictionary_encode()
    numbers = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return coded.dictionary.to_pylist(), numbers.reshape(len(columns), -1).T


def _present(words: np.ndarray, ends: np.ndarray, features: np.ndarray, count: int):
    """(row, feature) arrays of the distinct features of each text, a bounded number of words at a time.

    words: numbers of the distinct words of all texts one after the other; ends: where each text ends.
    """
    lo = 0
    while lo < len(ends):
        start = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, start + WORDS_AT_ONCE, side="right")))
        part = words[start:ends[hi - 1]]
        rows = np.repeat(np.arange(lo, hi), np.diff(np.concatenate([[start], ends[lo:hi]])))
        own = features[part]
        pairs = np.unique((rows[:, None] * count + own)[own >= 0])
        yield pairs // count, pairs % count
        lo = hi


def train(positive, unlabelled, prior: float, features: int = FEATURES,
          rounds: int = ROUNDS, step: float = STEP) -> tuple[dict[str, float], float]:
    """Weights and bias of a linear classifier from positive and unlabelled word sets (lists, or Arrow lists).

    The risk is prior * E+[loss(g)] + max(0, Eu[loss(-g)] - prior * E+[loss(-g)]) with the sigmoid loss: the unlabelled
    texts count as negative, corrected for the share `prior` of positives among them; when the corrected negative risk
    falls below zero, its gradient is turned round, so that it can't be fitted below what a negative class allows.
    Features are words and beginnings of words whose unlabelled texts are mostly explained by positives, as far as the
    class prior tells; the most telling come first. A feature is in LEAST positives at least, and its z score exceeds
    what the largest of so many features without a meaning would have.

    Words are numbers of one dictionary, features are found once a distinct word, and texts are flat arrays.
    """
    kind = pa.list_(pa.string())
    sides = [x if isinstance(x, pa.Array) else pa.array([list(w) for w in x], kind) for x in (positive, unlabelled)]
    n_pos, n_unl = len(sides[0]), max(1, len(sides[1]))
    coded = pa.concat_arrays([x.flatten() for x in sides]).dictionary_encode()
    flat = coded.indices.to_numpy(zero_copy_only=False)
    names, own = _features_of(coded.dictionary)
    ends = [np.cumsum(pc.list_value_length(x).to_numpy(zero_copy_only=False)).astype(np.int64) for x in sides]
    border = len(sides[0].flatten())
    texts = [(flat[:border], ends[0], n_pos), (flat[border:], ends[1], len(sides[1]))]

    def counts(part):
        total = np.zeros(len(names), np.int64)
        for _, found in _present(part[0], part[1], own, max(1, len(names))):
            total += np.bincount(found, minlength=len(names))
        return total

    pos, unl = counts(texts[0]), counts(texts[1])
    kept = np.flatnonzero(pos >= LEAST)
    a, b = pos[kept] / max(1, n_pos), unl[kept] / n_unl
    middle = (pos[kept] + unl[kept]) / (n_pos + n_unl)
    z = (a - b) / np.sqrt(middle * (1 - middle) * (1 / max(1, n_pos) + 1 / n_unl) + 1e-12)
    # of its unlabelled texts, at least the share KNOWN_SHARE is what the class prior explains by positives
    telling = (prior * a > KNOWN_SHARE * b) & (z > np.sqrt(2 * np.log(max(2, len(kept)))))
    chosen = sorted((-v, names[f], int(f)) for v, f in zip(z[telling], kept[telling]))[:features]
    if not chosen:
        return {}, -1.0
    place = np.full(len(names), -1)
    place[[f for _, _, f in chosen]] = np.arange(len(chosen))
    chosen = [name for _, name, _ in chosen]

    def matrix(part):
        rows, cols = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for r, found in _present(part[0], part[1], own, len(names)):
            used = place[found] >= 0
            rows.append(r[used])
            cols.append(place[found[used]])
        return np.concatenate(rows), np.concatenate(cols), part[2]

    data = [matrix(part) for part in texts]
    weights, bias = np.zeros(len(chosen)), -0.5
    first, second = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)

    def margins(part):
        rows, cols, n = part
        return np.bincount(rows, weights[cols], n) + bias

    def gradient(part, slope):
        rows, cols, _ = part
        return np.append(np.bincount(cols, slope[rows], len(chosen)), slope.sum())

    for turn in range(1, rounds + 1):
        g_pos, g_unl = margins(data[0]), margins(data[1])
        s_pos, s_unl = 1 / (1 + np.exp(-np.clip(g_pos, -30, 30))), 1 / (1 + np.exp(-np.clip(g_unl, -30, 30)))
        # sigmoid loss of margin m is 1 - s(m); its slope is -s(1-s)
        d_pos, d_unl = s_pos * (1 - s_pos) / max(1, len(g_pos)), s_unl * (1 - s_unl) / max(1, len(g_unl))
        negative_risk = s_unl.mean() - prior * s_pos.mean() if len(g_unl) else 0.0
        negative = gradient(data[1], d_unl) - prior * gradient(data[0], d_pos)
        if negative_risk < 0:
            negative = -negative
        grad = -prior * gradient(data[0], d_pos) + negative
        grad[:-1] += 1e-5 * weights
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad ** 2
        move = step * (first / (1 - 0.9 ** turn)) / (np.sqrt(second / (1 - 0.999 ** turn)) + 1e-9)
        # toxic words only ever speak for toxicity: the features were chosen as such
        weights = np.maximum(0.0, weights - move[:-1])
        bias = min(-0.5, bias - move[-1])
    return {name: float(w) for name, w in zip(chosen, weights) if w > 1e-3}, float(bias)


def train_models(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic", folds: int = 5) -> list[tuple[dict[str, float], float]]:
    """Weights and bias of each classifier; none without a confirmed toxic example.

    Learns only from rows whose crc32 of the id as text is not divisible by `folds`. Every classifier gets a sample of at
    about POSITIVES confirmed toxic rows and UNLABELLED other rows (MEMBERS times that in all), chosen by hash, and is trained in a task of its own.
    The class prior is the toxic share among all labelled training rows.
    """
    fold = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(folds))
    marks = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
             .where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("label").alias("label")))
    marks = marks.where(fold != 0)
    prior = marks.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0]
    if not prior:
        return []
    prior = min(0.9, max(0.01, prior))
    toxic = marks.where("label = 1").select("id")
    known = docs.select(F.col(id_col).alias("id"), text_of(docs, text_col).alias("text")).where(
        F.col("id").isNotNull() & (fold != 0))
    ids = known.select("id").join(toxic.withColumn("positive", F.lit(True)), "id", "left")

    def sample(kind, most: int) -> DataFrame:
        return kind.select("id", F.xxhash64("id").alias("place")).orderBy("place", "id").limit(most)

    # every classifier gets its own part of the rows; of positives, parts of POSITIVES that overlap where there are too few
    found = sample(ids.where("positive"), POSITIVES * MEMBERS).withColumn(
        "rank", F.row_number().over(Window.orderBy("place", "id")) - 1)
    n = ids.where("positive").limit(POSITIVES * MEMBERS).count()
    starts = F.explode(F.sequence(F.lit(0), F.lit(MEMBERS - 1)))
    picked = found.select("id", F.lit(True).alias("positive"), "rank", starts.alias("member")).where(
        F.pmod(F.col("rank") - F.floor(F.col("member") * n / MEMBERS), F.lit(max(1, n))) < POSITIVES).drop("rank")
    picked = picked.unionByName(sample(ids.where("positive IS NULL"), UNLABELLED * MEMBERS).select(
        "id", F.lit(False).alias("positive"), F.pmod("place", F.lit(MEMBERS)).cast("int").alias("member")))
    # at most (POSITIVES + UNLABELLED) * MEMBERS rows
    picked = known.join(F.broadcast(picked), "id")

    def split(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                words = pa.array([sorted(distinct_words(t.as_py())) for t in part.column("text")], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("member"), part.column("positive"), words],
                                                 ["id", "member", "positive", "words"])

    kind = known.schema["id"].dataType.simpleString()
    words = picked.select("id", "member", "positive", "text").mapInArrow(
        split, f"id {kind}, member int, positive boolean, words array<string>")

    def fit(group: pa.Table) -> pa.Table:
        ordered = group.sort_by([("id", "ascending")])
        positive, unlabelled = (ordered.filter(pc.equal(ordered["positive"], side))["words"].combine_chunks()
                                for side in (True, False))
        weights, bias = train(positive, unlabelled, prior) if len(positive) else ({}, None)
        names = list(weights)
        if bias is not None:
            names.append("")
        return pa.table({"member": pa.array([group["member"][0].as_py()] * len(names), pa.int32()),
                         "feature": pa.array(names, pa.string()),
                         "weight": pa.array([*weights.values(), *([bias] if bias is not None else [])], pa.float64())})

    models: dict[int, tuple[dict, float]] = {}
    for row in words.groupBy("member").applyInArrow(fit, "member int, feature string, weight double").collect():
        weights, bias = models.get(row["member"], ({}, -1.0))
        if row["feature"]:
            weights[row["feature"]] = row["weight"]
        else:
            bias = row["weight"]
        models[row["member"]] = (weights, bias)
    return [models[m] for m in sorted(models)]


def score_texts(docs: DataFrame, models: list, text_col: str = "text") -> DataFrame:
    """Adds __score: the mean sigmoid of the classifiers over the whole text; 0 without a classifier."""
    spec = docs.sparkSession.sparkContext.broadcast(models)
    rows = docs.withColumn("__text", text_of(docs, text_col))

    def run(batches):
        parts = spec.value
        names = sorted({f for weights, _ in parts for f in weights})
        table_of = np.array([[w.get(f, 0.0) for w, _ in parts] for f in names]).reshape(len(names), len(parts))
        biases = np.array([b for _, b in parts])
        place = {f: i for i, f in enumerate(names)}
        cache: dict[str, tuple] = {}
        for batch in batches:
            scores = []
            for text in batch.column("__text"):
                hits: set[int] = set()
                for word in distinct_words(text.as_py()):
                    found = cache.get(word)
                    if found is None:
                        found = tuple(place[f] for f in word_features(word) if f in place)
                        if len(word) <= CACHE_LENGTH:
                            if len(cache) >= CACHE_WORDS:
                                cache.clear()
                            cache[word] = found
                    if found:
                        hits.update(found)
                if not parts:
                    scores.append(0.0)
                    continue
                margin = biases + (table_of[sorted(hits)].sum(axis=0) if hits else 0.0)
                scores.append(float((1 / (1 + np.exp(-np.clip(margin, -30, 30)))).mean()))
            columns = [c for c, n in zip(batch.columns, batch.schema.names) if n != "__text"]
            kept = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], [*kept, "__score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("__score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", folds: int = 5) -> DataFrame:
    """id, held_out, score (0 to 1), predicted (1 from a score of 0.5) of every document.

    Null is the empty text, which gets the score of no word. Labels of rows in the fold 0 are never looked at; a null id
    has no label and is not held out. Ids labelled twice count as toxic if one label says so. Without toxic labels every
    score is 0. Other columns of either table are ignored; an empty table gives no rows.
    """
    models = train_models(docs, labels, id_col, text_col, label_col, folds)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = score_texts(rows, models)
    held = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), F.col("__score").alias("score"),
                         (F.col("__score") >= 0.5).cast("int").alias("predicted"))


@query("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
