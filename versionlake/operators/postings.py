"""Exact top k of sparse vectors by postings lists, with upper bounds that keep most postings out.

For short queries. When whole documents are the queries, nearly every record shares terms with each of them and bounds
rule out little, so `tiles.top_k` with a `SparseScorer`, which gives the same rows, does less work there.

The postings are dealt by record: a block holds the lists of a few hundred thousand postings, so a frequent term has a short list in
each block instead of a long one in a single task, and a record's products meet where its postings are. Pairs of a query and a record
never leave a task; its best ones of a query do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from versionlake.operators import tiles
from versionlake.session import reliable_checkpoint

#: Postings of a query in the first round, as a multiple of k; postings of a block; terms of a group of queries.
FIRST_ROUND = 20
HOT_POSTINGS = 500_000
GROUP_TERMS = 100_000
#: What rounding to SCORE_DIGITS can move a score, with the rounding errors of sums.
SLACK = 2 * 10.0 ** -tiles.SCORE_DIGITS


def exploded(vectors: DataFrame, id_name: str, weight_name: str) -> DataFrame:
    """term, id and weight of every term of every record; a term that repeats in a record is summed."""
    rows = vectors.select(F.col("id").alias(id_name), F.explode(F.arrays_zip("terms", "weights")).alias("p"))
    return (rows.select(id_name, F.col("p.terms").alias("term"), F.col("p.weights").cast("double").alias(weight_name))
            .where(F.col(weight_name) != 0).groupBy(id_name, "term").agg(F.sum(weight_name).alias(weight_name)))


@dataclass
class Lists:
    """Postings in blocks, one packed row each; `left` has terms that are only looked up for records found by others."""

    blocks: DataFrame
    n_blocks: int
    id_type: str
    left: DataFrame | None = None


def _blocks(corpus: DataFrame, hot_postings: int) -> DataFrame:
    """`rows` (id, label of every record of a block), `ids` (its distinct ids, ascending) and `lists` (term, places of ids, weights).

    Rows of one id come one after the other, so they fall into one block and their weights are summed there.
    """
    label = F.col("label") if "label" in corpus.columns else F.lit(None).cast("string")
    # a record without an id is never found, so its terms stay behind
    terms = F.when(F.col("id").isNotNull(), F.col("terms")).alias("terms")
    rows = corpus.select("id", label.alias("label"), terms, F.col("weights").cast("array<double>").alias("weights"))
    dealt = rows.repartition("id").sortWithinPartitions("id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            sizes = np.cumsum(pc.list_value_length(batch["terms"]).fill_null(0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                done = int(sizes[at - 1]) if at else 0
                # the row that fills the block; the block ends where the next id begins
                full = int(np.searchsorted(sizes, done + hot_postings - size))
                end = _next_id(batch["id"], max(at, full), held[-1]["id"][-1] if held and full <= at else None)
                if end is None:
                    held.append(batch.slice(at))
                    size += int(sizes[-1]) - done
                    break
                if end > at:
                    held.append(batch.slice(at, end - at))
                yield _block(pa.Table.from_batches(held).combine_chunks())
                held, size, at = [], 0, end
        if held:
            yield _block(pa.Table.from_batches(held).combine_chunks())

    return reliable_checkpoint(dealt.mapInArrow(pack, "rows binary, ids binary, lists binary"))


def _next_id(ids: pa.Array, row: int, before: pa.Scalar | None) -> int | None:
    """First row after `row` with another id than it has, or `row` itself if it is another id than `before`; None if there is no such row."""
    if row >= len(ids):
        return None
    if before is not None and before != ids[row]:
        return row
    while row + 1 < len(ids):
        if ids[row + 1] != ids[row]:
            return row + 1
        row += 1
    return None


def _block(rows: pa.Table) -> pa.RecordBatch:
    terms, weights = (rows[c].combine_chunks() for c in ("terms", "weights"))
    ids = pc.unique(rows["id"].combine_chunks().drop_null())
    ids = ids.take(pc.array_sort_indices(ids))
    # as many entries a row as both lists have
    n = np.minimum(*(pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (terms, weights)))
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    word, w = (x.values.take(pa.array(np.repeat(x.offsets.to_numpy()[:-1], n) + inside)) for x in (terms, weights))
    word, w = word.dictionary_encode(), w.to_numpy(zero_copy_only=False)
    code = word.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.repeat(pc.index_in(rows["id"].combine_chunks(), value_set=ids, skip_nulls=True).fill_null(-1)
                      .to_numpy(zero_copy_only=False).astype(np.int64), n)
    used = (code >= 0) & (place >= 0) & ~np.isnan(w) & (w != 0)
    key, w = (code * max(1, len(ids)) + place)[used], w[used]
    order = np.argsort(key, kind="stable")
    key, w = key[order], w[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    # a term that repeats in a record is summed
    key, w = key[first], np.add.reduceat(w, first) if len(first) else w
    code, place = np.divmod(key, max(1, len(ids)))
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    ends = pa.array(np.append(starts, len(code)), pa.int32())
    lists = pa.record_batch({"term": word.dictionary.take(pa.array(code[starts])),
                             "at": pa.ListArray.from_arrays(ends, pa.array(place, pa.int32())),
                             "weight": pa.ListArray.from_arrays(ends, pa.array(w, pa.float64()))})
    packed = [rows.select(["id", "label"]).to_batches(), [pa.record_batch({"id": ids})], [lists]]
    return pa.record_batch({name: tiles._packed_row(part)["packed"] for name, part in zip(("rows", "ids", "lists"), packed)})


def _records(blocks: DataFrame, schema: str) -> DataFrame:
    """id and label of every row of the corpus."""
    def run(batches):
        for batch in batches:
            for packed in batch["rows"]:
                yield from tiles._unpacked(packed).to_batches()
    return blocks.select("rows").mapInArrow(run, schema)


def _term_bounds(blocks: DataFrame) -> DataFrame:
    """term, df, most, least: number of postings of every term and its largest and smallest weight."""
    def run(batches):
        for batch in batches:
            for packed in batch["lists"]:
                lists = tiles._unpacked(packed)
                if lists.num_rows:
                    starts, w = _starts(lists), lists["weight"].combine_chunks().values.to_numpy()
                    yield pa.record_batch({
                        "term": lists["term"].combine_chunks(), "df": pa.array(np.diff(starts), pa.int64()),
                        "most": pa.array(np.maximum.reduceat(w, starts[:-1])), "least": pa.array(np.minimum.reduceat(w, starts[:-1]))})
    return (blocks.select("lists").mapInArrow(run, "term string, df long, most double, least double").groupBy("term")
            .agg(F.sum("df").alias("df"), F.max("most").alias("most"), F.min("least").alias("least")))


def _starts(lists: pa.Table) -> np.ndarray:
    return lists["weight"].combine_chunks().offsets.to_numpy().astype(np.int64)


def _scored(asked: DataFrame, lists: Lists, out: str) -> DataFrame:
    """query_id, corpus_id and the sum of products, in `out`, of the `wanted` best records of every query and task.

    Records are found by the terms of `asked` (query_id, term, wq, reach, wanted, bar); terms of `lists.left` are looked up for those
    that can reach the bar. What a task has found of a query raises its bar for the blocks that follow.
    """
    both = asked if lists.left is None else asked.unionByName(lists.left)
    rows = both.groupBy(F.col("query_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("reach", "term", "wq")), asc=False).alias("v"),
        F.max("wanted").alias("wanted"), F.max("bar").alias("bar"))
    rows = rows.select("id", "wanted", "bar", *[F.col("v")[c].alias(c) for c in ("reach", "term", "wq")])
    groups = max(1, math.ceil(both.count() / GROUP_TERMS))
    spans = max(math.ceil(4 * asked.sparkSession.sparkContext.defaultParallelism / groups), math.ceil(lists.n_blocks / tiles.SPAN_CELLS))
    pairs = (lists.blocks.select("ids", "lists").coalesce(spans)
             .crossJoin(tiles._packed(rows, groups).select("number", F.col("packed").alias("q")).hint("shuffle_replicate_nl")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, id_type = {}, None
        for batch in batches:
            for i, number in enumerate(batch["number"].to_pylist()):
                if number not in groups:
                    groups[number] = _Asked(tiles._unpacked(batch["q"][i]))
                ids = tiles._unpacked(batch["ids"][i])["id"].combine_chunks()
                id_type = ids.type
                groups[number].meet(ids, tiles._unpacked(batch["lists"][i]))
        for group in groups.values():
            yield group.found(id_type, out)

    kind = asked.schema["query_id"].dataType.simpleString()
    return pairs.select("number", "q", "ids", "lists").mapInArrow(run, f"query_id {kind}, corpus_id {lists.id_type}, {out} double")


class _Asked:
    """A group of queries inside a task: their terms by falling reach, and the best records found so far."""

    def __init__(self, rows: pa.Table):
        self.ids = rows["id"].combine_chunks()
        lists = {c: rows[c].combine_chunks() for c in ("reach", "term", "wq")}
        self.ends = lists["term"].offsets.to_numpy()
        self.terms = lists["term"].values
        self.reach, self.wq = (lists[c].values.to_numpy() for c in ("reach", "wq"))
        self.wanted = rows["wanted"].to_numpy().astype(np.int64)
        self.bars = rows["bar"].to_numpy().copy()
        self.best: list[list] = [[] for _ in range(len(self.ids))]

    def meet(self, ids: pa.Array, lists: pa.Table) -> None:
        if not lists.num_rows:
            return
        starts = _starts(lists)
        at, weight = (lists[c].combine_chunks().values.to_numpy() for c in ("at", "weight"))
        place = pc.index_in(self.terms, value_set=lists["term"].combine_chunks()).fill_null(-1).to_numpy()
        sums = np.zeros(len(ids))
        for i, bar in enumerate(self.bars):
            terms = np.arange(self.ends[i], self.ends[i + 1])
            # the terms behind `cut` together stay below the bar, so they find no record
            cut = int(np.searchsorted(-self.reach[terms], -bar, side="right"))
            for t in terms[:cut][place[terms[:cut]] >= 0]:
                own = slice(starts[place[t]], starts[place[t] + 1])
                sums[at[own]] += self.wq[t] * weight[own]
            cols = np.flatnonzero(sums)
            values = sums[cols]
            sums[cols] = 0.0
            for t in terms[cut:]:
                near = values + self.reach[t] >= bar
                if not near.all():
                    cols, values = cols[near], values[near]
                if not len(cols):
                    break
                if place[t] >= 0:
                    own = slice(starts[place[t]], starts[place[t] + 1])
                    spot = np.minimum(np.searchsorted(at[own], cols), own.stop - own.start - 1)
                    values += np.where(at[own][spot] == cols, self.wq[t] * weight[own][spot], 0.0)
            # a product of positive weights may round to 0: it then takes its place among the others by id
            values = np.round(values, tiles.SCORE_DIGITS)
            near = (values > 0) & (values >= bar)
            if near.any():
                self._keep(i, ids, cols[near], values[near])

    def _keep(self, i: int, ids: pa.Array, cols: np.ndarray, values: np.ndarray) -> None:
        most = self.wanted[i]
        if len(cols) > most:
            near = values >= np.partition(values, len(values) - most)[len(values) - most]
            cols, values = cols[near], values[near]
        order = np.lexsort((cols, -values))[:most]
        new = zip((-values[order]).tolist(), ids.take(pa.array(cols[order])).to_pylist())
        self.best[i] = sorted([*self.best[i], *new])[:most]
        if len(self.best[i]) == most:
            self.bars[i] = max(self.bars[i], -self.best[i][-1][0] - SLACK)

    def found(self, id_type: pa.DataType, out: str) -> pa.RecordBatch:
        rows = np.repeat(np.arange(len(self.best)), [len(x) for x in self.best])
        flat = [x for best in self.best for x in best]
        return pa.record_batch({"query_id": self.ids.take(pa.array(rows)), "corpus_id": pa.array([x[1] for x in flat], id_type),
                                out: pa.array([-x[0] for x in flat], pa.float64())})


def _allowed(pairs: DataFrame, exclude: DataFrame | None) -> DataFrame:
    pairs = pairs.where(F.col("query_id") != F.col("corpus_id"))
    return pairs if exclude is None else pairs.join(
        exclude.select("query_id", "corpus_id").distinct(), ["query_id", "corpus_id"], "left_anti")


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 100, exclude: DataFrame | None = None,
          first_round: int = FIRST_ROUND, hot_postings: int = HOT_POSTINGS) -> DataFrame:
    """query_id, corpus_id, score, rank, relevant, as `tiles.top_k` gives them for a `SparseScorer`.

    `queries` and `corpus` have id, terms, weights and perhaps label; weights must not be negative, which is checked. A block
    has about `hot_postings` postings.

    1. Round one scores each query on its rarest terms, about `first_round` * k postings. A sum over some terms is never
       above the whole, so the k-th best of them is a bar that the k-th whole score reaches.
    2. The most that a term can add is its query weight times its largest corpus weight. The terms with the smallest such
       shares, as long as all of them together stay below the bar, can't lift a record to it alone: their postings, which are mostly
       those of frequent words, aren't read. Records found by the other terms stay if the bar is in reach.
    3. Those records get the products of the terms left out, looked up in the same block by (term, record), and are ranked.

    A query with fewer than k records that share a term is filled up with score 0 by ascending id.
    """
    blocks = _blocks(corpus, hot_postings)
    lists = Lists(blocks, blocks.count(), corpus.schema["id"].dataType.simpleString())
    label = corpus.schema["label"].dataType.simpleString() if "label" in corpus.columns else "string"
    records = _records(blocks, f"id {lists.id_type}, label {label}")
    queries = reliable_checkpoint(queries.select("id", *[c for c in ("label",) if c in queries.columns], "terms", "weights"))
    asked = reliable_checkpoint(exploded(queries, "query_id", "wq"))
    stats = reliable_checkpoint(_term_bounds(blocks))
    low = [df.agg(F.min(c)).first()[0] for df, c in ((stats, "least"), (asked, "wq"))]
    if any(x is not None and x < 0 for x in low):
        raise ValueError("weights must not be negative")
    # a query's own terms are what its row held, so windows over them are bounded by it
    own = Window.partitionBy("query_id")
    share = F.col("wq") * F.col("most")
    read = F.sum("df").over(own.orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1))
    bound = F.sum("share").over(own.orderBy("share", "term"))
    # a task doesn't know which pairs are not allowed, so it keeps as many records more: the query itself and those of `exclude`
    banned = asked.select("query_id", F.lit(0).alias("banned")) if exclude is None else exclude.select("query_id", F.lit(1).alias("banned"))
    banned = banned.groupBy("query_id").agg(F.sum("banned").alias("banned"))
    asked = reliable_checkpoint(asked.join(stats, "term").withColumn("share", share).withColumn(
        "first", F.coalesce(read, F.lit(0)) < first_round * k).withColumn("reach", bound).join(banned, "query_id", "left")
        .select("query_id", "term", "wq", "reach", "first", (F.coalesce("banned", F.lit(0)) + k + 1).alias("wanted")))

    early = _allowed(_scored(asked.where("first").withColumn("bar", F.lit(0.0)), lists, "partial"), exclude)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("partial").desc()))
    bars = early.withColumn("place", place).where(F.col("place") == k).select("query_id", (F.col("partial") - SLACK).alias("bar"))
    asked = reliable_checkpoint(asked.join(bars, "query_id", "left").withColumn("bar", F.coalesce("bar", F.lit(0.0))))
    needed = F.col("reach") >= F.col("bar")
    scored = _allowed(_scored(asked.where(needed), replace(lists, left=asked.where(~needed)), "score"), exclude)
    ranked = reliable_checkpoint(tiles.rank_window(scored, k).select("query_id", "corpus_id", "score"))
    whole = ranked.unionByName(_zeros(queries, records, ranked, k, exclude))
    return _with_relevance(tiles.rank_window(whole, k), queries, records)


def _zeros(queries: DataFrame, corpus: DataFrame, ranked: DataFrame, k: int, exclude: DataFrame | None) -> DataFrame:
    """Records of score 0 for queries with fewer than k of a higher score: the smallest ids that are left."""
    found = ranked.groupBy("query_id").agg(F.count("*").alias("found"))
    short = (queries.select(F.col("id").alias("query_id")).join(found, "query_id", "left")
             .where(F.coalesce("found", F.lit(0)) < k).select("query_id"))
    banned = 0
    if exclude is not None:
        banned = exclude.join(short, "query_id", "left_semi").groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    # of so many smallest ids, enough are neither found nor excluded nor the query itself
    least = corpus.select("id").orderBy("id").limit(k + 1 + banned).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    pairs = (short.withColumn("one", F.lit(1)).join(F.broadcast(least.withColumn("one", F.lit(1))), "one")
             .select("query_id", F.explode("ids").alias("corpus_id")))
    return _allowed(pairs, exclude).join(ranked, ["query_id", "corpus_id"], "left_anti").withColumn("score", F.lit(0.0))


def _with_relevance(ranked: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    for side, df in (("query", queries), ("corpus", corpus)):
        label = F.col("label") if "label" in df.columns else F.lit(None).cast("string")
        ranked = ranked.join(df.select(F.col("id").alias(f"{side}_id"), label.alias(f"{side}_label")), f"{side}_id", "left")
    same = F.coalesce(F.col("query_label") == F.col("corpus_label"), F.lit(False))
    return ranked.select("query_id", "corpus_id", "score", "rank", same.cast("int").alias("relevant"))
