"""Exact all-against-all scoring without ever writing the pairs.

Records are hashed into a grid: query rows into `gq` groups, corpus rows into `gc` groups, each written once
as a packed row. A task reads one group of queries and goes through a span of corpus groups, one cell after the
other, each scored by matrix products (`versionlake.functions.scorers`). What leaves a task is already reduced:
k rows a query, one best positive a query, or counts. The grid grows with the data so that the rows of one cell
side stay near `cell_rows`, whatever the table size; the shuffle carries each vector once and k result rows a
query and span. With pairs to leave out, rows are copied to the cells of their grid row or column instead, and
the shuffle carries (gq + gc) * n vectors.

Inputs have a column `id`, optionally `label` (two records with the same label are versions of one work)
and the columns of the scorer.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from versionlake.functions.scorers import DenseScorer, MultiVectorScorer, SoftmaxMeanScorer, SparseScorer, coded, split_redux
from versionlake.session import reliable_checkpoint

CELL_ROWS = 8192
# Scores, or distances behind them, that are computed at a time: few enough for a core's cache. Sparse vectors take more, as
# each block of them lays out the common terms of the corpus side.
BLOCK_CELLS = 600_000
LARGE_CELLS = 4_000_000
SCORE_DIGITS = 9
MERGED = 64
# Cells of one label a core; a label has more only if they would exceed CELL_ROWS.
GRID_CELLS = 8
# Corpus groups that a task goes through, and bytes after which a packed row of records ends.
SPAN_CELLS = 16
PACKED_BYTES = 32 << 20
# Rows of a batch that are unpacked for Spark.
UNPACKED_ROWS = 1000
# Bars that a group of queries has about.
GROUP_BARS = 2_000_000
# Scores that a task holds where it needs those of its queries with the whole corpus.
HELD_SCORES = 16_000_000
# Rows that leave a task at a time where a pair has many.
OUT_ROWS = 200_000
# Bound of scores that are held as int32, in units of their last digit.
LARGEST = 2**31 - 1


# ---------------------------------------------------------------- grid

def _items(df: DataFrame, columns: list[str], extra: tuple = ()) -> DataFrame:
    label = F.col("label") if "label" in df.columns else F.lit(None).cast("string")
    names = ["id", *dict.fromkeys(columns), *[c for c in extra if c in df.columns]]
    # fresh aliases: queries and corpus are often the same table
    return df.select(label.alias("label"), *[F.col(c).alias(c) for c in names])


def _weighted_rows(df: DataFrame, scorer) -> int:
    """Number of rows, or of vectors for records with several."""
    part = next((p for p in getattr(scorer, "parts", [scorer]) if isinstance(p, MultiVectorScorer)), None)
    if part is None:
        return df.count()
    return int(df.agg(F.coalesce(F.sum(F.size(part.column)), F.lit(0))).first()[0])


def grid_shape(queries: DataFrame, corpus: DataFrame, scorer, cell_rows: int = CELL_ROWS) -> tuple[int, int]:
    """Grid that bounds a cell side by `cell_rows` and gives every core a cell, with the fewest copies of rows.

    A query row is copied once a corpus group and the other way round, so few queries get one group.
    """
    need = 2 * queries.sparkSession.sparkContext.defaultParallelism
    n_q, n_c = (max(1, _weighted_rows(df, scorer)) for df in (queries, corpus))
    least_q, least_c = math.ceil(n_q / cell_rows), math.ceil(n_c / cell_rows)
    groups = min(n_q, max(least_q, round(math.sqrt(need * n_q / n_c))))
    return groups, min(n_c, max(least_c, math.ceil(need / groups)))


def usable(df: DataFrame, scorer) -> DataFrame:
    """Rows that can be scored: a record whose vector, or list of vectors, is null or empty takes no part."""
    for part in getattr(scorer, "parts", [scorer]):
        if isinstance(part, (DenseScorer, MultiVectorScorer)):
            df = df.where(F.size(part.column) > 0)
    return df


def unmasked(df: DataFrame, column: str = "vectors", mask: str = "mask") -> DataFrame:
    """`column` without the vectors whose entry in the array `mask` is true; the mask is dropped.

    A masked vector takes every one of its pairs out of a reduction, so leaving it out before scoring gives what a mask
    inside each reduction would. A record without a vector left takes no part; a missing mask masks nothing.
    """
    kept = F.filter(F.arrays_zip(F.col(column).alias("v"), F.col(mask).alias("m")), lambda x: ~F.coalesce(x["m"], F.lit(False)))
    return df.withColumn(column, F.when(F.col(mask).isNull(), F.col(column)).otherwise(
        F.transform(kept, lambda x: x["v"]))).drop(mask)


def _spread(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
    key = ["id", "seg"] if "seg" in df.columns else ["id"]
    return (df.withColumn(own, F.pmod(F.xxhash64(*key), F.lit(n_own)).cast("int"))
              .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))))


def _cogroup(q: DataFrame, c: DataFrame, keys: list[str], cells: int, run, schema: str) -> DataFrame:
    # A fixed number of partitions: cells are small in bytes but heavy in work, so they must not be coalesced.
    parts = max(1, min(cells, 20_000))
    q = q.repartition(parts, *keys)
    c = c.repartition(parts, *keys)
    return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(run, schema)


def _with_skips(q: DataFrame, c: DataFrame, exclude: DataFrame | None, keys: list[str]) -> DataFrame:
    """Adds `skip` to placed query rows: the corpus ids of their cell that they must not meet.

    `exclude` (query_id, corpus_id) is cut by cell, so an array never holds more than the corpus rows of one cell.
    """
    if exclude is None:
        return q
    # every corpus row has exactly one copy in the first grid row
    places = c.where("gq = 0").select(F.col("id").alias("corpus_id"), *keys)
    pairs = exclude.select(F.col("query_id").cast(q.schema["id"].dataType).alias("id"),
                           F.col("corpus_id").cast(c.schema["id"].dataType).alias("corpus_id"))
    skips = pairs.join(places, "corpus_id").groupBy("id", *keys).agg(F.collect_set("corpus_id").alias("skip"))
    return q.join(skips, ["id", *keys], "left")


def _grid(queries, corpus, scorer, cells, run, schema, extra=(), exclude=None, merge=None, bounded=False) -> DataFrame:
    """`run(key, queries, corpus)` on every cell; `merge` joins what two cells found for the same queries into one table.

    If `bounded`, `run` also gets the merged table of earlier cells, or None, and may leave out what `merge` would drop. New rows
    are then merged when they are as many as the merged ones.
    """
    q = usable(_items(queries, scorer.columns, extra + tuple(getattr(scorer, "q_columns", ()))), scorer)
    c = usable(_items(corpus, scorer.columns, extra), scorer)
    gq, gc = cells or grid_shape(q, c, scorer)
    if exclude is not None:
        q, c = _spread(q, "gq", gq, "gc", gc), _spread(c, "gc", gc, "gq", gq)
        return _cogroup(_with_skips(q, c, exclude, ["gc"]), c, ["gq", "gc"], gq * gc, run, schema)
    need = 4 * q.sparkSession.sparkContext.defaultParallelism
    spans = min(gc, max(math.ceil(need / gq), math.ceil(gc / SPAN_CELLS)))
    # each task reads the packed rows of its two partitions, so no row is copied by a shuffle
    words = word_columns(scorer)
    pairs = (_packed(c, gc, words).select(F.col("packed").alias("c")).coalesce(spans)
             .crossJoin(_packed(q, gq, words).select("number", F.col("packed").alias("q")).hint("shuffle_replicate_nl")))

    def go_through(batches):
        held, new = {}, {}
        for batch in batches:
            for i, number in enumerate(batch["number"].to_pylist()):
                known = (held.get(number),) if bounded else ()
                found = run(None, _unpacked(batch["q"][i]), _unpacked(batch["c"][i]), *known)
                if merge is None:
                    # batches as they come, or a table of them
                    yield from found.to_batches() if isinstance(found, pa.Table) else found
                elif number not in held:
                    held[number] = found
                elif not bounded:
                    held[number] = merge(held[number], found)
                else:
                    new.setdefault(number, []).append(found)
                    if sum(table.num_rows for table in new[number]) >= held[number].num_rows:
                        held[number] = merge(held[number], pa.concat_tables(new.pop(number)))
        for number, found in held.items():
            if number in new:
                found = merge(found, pa.concat_tables(new.pop(number)))
            yield from found.to_batches()

    return pairs.select("number", "q", "c").mapInArrow(go_through, schema)


def word_columns(scorer) -> tuple:
    """Columns of lists of terms, whose words a packed row holds once."""
    return tuple(part.terms for part in getattr(scorer, "parts", [scorer]) if isinstance(part, SparseScorer))


def _packed(df: DataFrame, groups: int, words: tuple = (), by_id: bool = False) -> DataFrame:
    """Records hashed into groups and written once, as one row of Arrow bytes a group (several for wide records), with a `number`."""
    key = ["id", "seg"] if "seg" in df.columns else ["id"]
    dealt = df.repartitionById(groups, F.pmod(F.xxhash64(*key), F.lit(groups)).cast("int"))
    dealt = dealt.sortWithinPartitions("id") if by_id else dealt
    return reliable_checkpoint(dealt.mapInArrow(packer(words), "packed binary").withColumn("number", F.monotonically_increasing_id()))


def packer(words: tuple = ()):
    """Function for `mapInArrow`: batches to rows of Arrow bytes."""
    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= PACKED_BYTES:
                yield _packed_row(held, words)
                held, size = [], 0
        if sum(batch.num_rows for batch in held):
            yield _packed_row(held, words)
    return run


def _packed_row(batches: list[pa.RecordBatch], words: tuple = ()) -> pa.RecordBatch:
    """`words` are lists of terms: these are numbered, and the row is compressed."""
    rows = pa.Table.from_batches(batches)
    for name in words:
        lists = rows[name].combine_chunks()
        ends = np.append(0, np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)))
        numbered = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), coded(lists.flatten()))
        rows = rows.set_column(rows.column_names.index(name), name, numbered)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd" if words else None)) as writer:
        writer.write_table(rows.combine_chunks() if words else rows)
    return pa.record_batch({"packed": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _unpacked(packed: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(packed.as_buffer()).read_all().combine_chunks()


def compact_checkpoint(df: DataFrame, words: tuple) -> DataFrame:
    """`reliable_checkpoint` of rows with lists of terms, `words`: written as compressed packed rows in which each word is held once
    a row. Partitions and their rows stay as they are."""
    packed = reliable_checkpoint(df.mapInArrow(packer(words), "packed binary"))

    def run(batches):
        for batch in batches:
            for row in batch["packed"]:
                rows = _unpacked(row)
                for name in words:
                    lists = rows[name].combine_chunks()
                    plain = pa.ListArray.from_arrays(lists.offsets, lists.values.dictionary_decode())
                    rows = rows.set_column(rows.column_names.index(name), name, plain)
                yield from rows.to_batches(max_chunksize=UNPACKED_ROWS)

    return packed.mapInArrow(run, df.schema)


def _label_grid(queries, corpus, scorer, cell_rows, run, schema, exclude=None) -> DataFrame:
    """Cells hold whole labels: many small ones together; a label above `cell_rows` gets a grid of its own.

    Small cells are only made for as many tasks as there is use for: what would give a label more than GRID_CELLS cells a
    core gets larger ones, up to CELL_ROWS, so that the copies of a row don't grow with the label until then. The list of such labels has at most rows / cell_rows entries; it grows with the table, so no broadcast is asked for.
    """
    q = _items(queries, scorer.columns, tuple(getattr(scorer, "q_columns", ()))).where("label is not null")
    c = _items(corpus, scorer.columns).where("label is not null")
    q, c = usable(q, scorer), usable(c, scorer)
    n = _weighted_rows(c, scorer)
    cores = q.sparkSession.sparkContext.defaultParallelism
    most = max(cell_rows, CELL_ROWS)
    buckets = max(2 * cores, math.ceil(n / min(max(cell_rows, math.ceil(n / (GRID_CELLS * cores))), most)))
    many = next((p.column for p in getattr(scorer, "parts", [scorer]) if isinstance(p, MultiVectorScorer)), None)
    load = F.sum(F.lit(1) if many is None else F.size(many))
    sizes = (q.groupBy("label").agg(load.alias("nq"), F.lit(0).alias("nc"))
             .unionByName(c.groupBy("label").agg(F.lit(0).alias("nq"), load.alias("nc")))
             .groupBy("label").agg(F.sum("nq").alias("nq"), F.sum("nc").alias("nc")))
    spread = math.ceil(math.sqrt(GRID_CELLS * cores))

    def groups(load):
        side = F.least(F.greatest(F.lit(cell_rows), F.ceil(F.col(load) / spread)), F.lit(most))
        return F.ceil(F.col(load) / side).cast("int")

    hot = (sizes.where((F.col("nq") > cell_rows) | (F.col("nc") > cell_rows))
           .select("label", groups("nq").alias("sq"), groups("nc").alias("sc")))

    def place(df, own, n_own, other, n_other):
        placed = df.join(hot, "label", "left")
        size = F.greatest(F.coalesce(F.col(n_own), F.lit(1)), F.lit(1))
        copies = F.greatest(F.coalesce(F.col(n_other), F.lit(1)), F.lit(1))
        return (placed
                .withColumn("hot", F.when(F.col(n_own).isNotNull(), F.xxhash64("label")).otherwise(F.lit(0)))
                .withColumn("bucket", F.when(F.col(n_own).isNull(), F.pmod(F.xxhash64("label"), F.lit(buckets)))
                            .otherwise(F.lit(-1)))
                .withColumn(own, F.pmod(F.xxhash64("id"), size).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), copies - 1)))
                .drop("sq", "sc"))

    keys = ["bucket", "hot", "gq", "gc"]
    q, c = place(q, "gq", "sq", "gc", "sc"), place(c, "gc", "sc", "gq", "sq")
    return _cogroup(_with_skips(q, c, exclude, ["bucket", "hot", "gc"]), c, keys, buckets, run, schema)


def label_cells(queries: DataFrame, corpus: DataFrame, scorer, run, schema: str, cell_rows: int = CELL_ROWS) -> DataFrame:
    """`run(key, queries, corpus)` on Arrow tables of cells that hold whole labels, or parts of labels above `cell_rows`.

    `scorer` names the `columns` that travel, and `q_columns` those of queries alone. A cell may hold several labels.
    """
    return _label_grid(queries, corpus, scorer, cell_rows, run, schema)


# ---------------------------------------------------------------- one cell

class _Cell:
    """Arrays of one cell: corpus rows sorted by id, so that a smaller column number is a smaller id."""

    def __init__(self, scorer, q: pa.Table, c: pa.Table):
        self.scorer = scorer
        self.q = q
        self.c = c if _ascending(c["id"]) else c.sort_by([("id", "ascending")])
        self.qs = scorer.prepare(self.q)
        self.cs = scorer.prepare(self.c)
        self.c_ids = self.c["id"].combine_chunks()
        self.self_at = (pc.index_in(self.q["id"], value_set=self.c_ids)
                        .fill_null(-1).to_numpy().astype(np.int64))
        self.skips = self.q["skip"].to_pylist() if "skip" in self.q.column_names else None
        if self.skips is not None:
            lists = self.q["skip"].combine_chunks()
            lengths = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            # a list may name records of other cells
            cols = pc.index_in(lists.flatten(), value_set=self.c_ids).fill_null(-1).to_numpy()
            self.skip_rows = np.repeat(np.arange(self.q.num_rows), lengths)[cols >= 0]
            self.skip_cols = cols[cols >= 0]
        labels = pc.unique(self.c["label"])
        self.q_label = pc.index_in(self.q["label"], value_set=labels, skip_nulls=True).fill_null(-1).to_numpy()
        self.c_label = pc.index_in(self.c["label"], value_set=labels, skip_nulls=True).fill_null(-2).to_numpy()
        # index_in gives the place of a null inside the value set as null, so null labels never match

    def blocks(self):
        """(lo, hi, scores): slices of query rows; a query itself scores -inf."""
        for lo, hi, scores in self.raw_blocks():
            scores = np.round(scores, SCORE_DIGITS, out=scores)
            scores += 0.0
            scores[self.left_out(lo, hi)] = -np.inf
            yield lo, hi, scores

    def left_out(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows (from `lo`) and columns of the pairs that don't count: a query with itself, and what it must not meet."""
        rows = np.flatnonzero(self.self_at[lo:hi] >= 0)
        cols = self.self_at[lo:hi][rows]
        if self.skips is not None:
            here = (self.skip_rows >= lo) & (self.skip_rows < hi)
            rows, cols = np.concatenate([rows, self.skip_rows[here] - lo]), np.concatenate([cols, self.skip_cols[here]])
        return rows, cols

    def raw_blocks(self):
        """`blocks` before scores are rounded and pairs left out."""
        width = max(1, int(self.scorer.weight(self.c).sum()))
        heavy = self.scorer.weight(self.q)
        sparse = any(isinstance(part, SparseScorer) for part in getattr(self.scorer, "parts", [self.scorer]))
        limit = LARGE_CELLS if sparse else BLOCK_CELLS
        lo, n = 0, self.q.num_rows
        while lo < n:
            hi, load = lo, 0
            while hi < n and (hi == lo or (load + heavy[hi]) * width <= limit):
                load += heavy[hi]
                hi += 1
            yield lo, hi, self.scorer.score(self.qs, self.cs, lo, hi)
            lo = hi

    def relevant(self, rows, cols):
        return (self.q_label[rows] == self.c_label[cols]).astype(np.int32)


def _ascending(ids: pa.ChunkedArray) -> bool:
    """Whether whole numbers rise already, as in rows that were sorted before they were packed."""
    if not pa.types.is_integer(ids.type) or ids.null_count or ids.num_chunks != 1:
        return False
    return bool((np.diff(ids.to_numpy()) > 0).all())


def _first_k(scores: np.ndarray, k: int):
    """Row, column and value of the k best entries a row; ties go to the smaller column. -inf never appears."""
    n = scores.shape[1]
    keep = scores > -np.inf
    if k < n:
        keep &= scores >= np.partition(scores, n - k, axis=1)[:, n - k][:, None]
    rows, cols = np.nonzero(keep)
    values = scores[rows, cols]
    return _k_a_row(rows, cols, values, k)


def _k_a_row(rows, cols, values, k: int):
    order = np.lexsort((cols, -values, rows))
    rows, cols, values = rows[order], cols[order], values[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    return rows[place < k], cols[place < k], values[place < k]


def _first_k_from(cell: _Cell, lo: int, hi: int, scores: np.ndarray, bars: np.ndarray, k: int):
    """`_first_k` of a raw block, of the scores only that reach the `bars` of their rows. Few do, so only these are rounded."""
    bars = bars[lo:hi]
    keep = scores >= (bars - 10.0 ** -SCORE_DIGITS - 1e-14 * np.abs(bars))[:, None]
    keep[cell.left_out(lo, hi)] = False
    rows, cols = np.nonzero(keep)
    values = np.round(scores[rows, cols], SCORE_DIGITS) + 0.0
    reach = values >= bars[rows]
    return _k_a_row(rows[reach], cols[reach], values[reach], k)


def _bars(best: pa.Table, k: int) -> tuple[pa.Array, np.ndarray]:
    """Query ids of `best`, and the least score of each that has k rows; -inf for the others and, at the end, for unknown ids."""
    names = best["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    code = names.indices.to_numpy()
    bars = np.full(len(names.dictionary) + 1, -np.inf)
    full = np.bincount(code, minlength=len(bars)) >= k
    least = np.full(len(bars), np.inf)
    np.minimum.at(least, code, best["score"].to_numpy())
    bars[full] = least[full]
    return names.dictionary, bars


def _concat(tables: list[pa.Table], schema: pa.Schema) -> pa.Table:
    return pa.concat_tables(tables) if tables else schema.empty_table()


def _id_type(df: DataFrame) -> str:
    return df.schema["id"].dataType.simpleString()


def _pair_table(cell: _Cell, rows, cols, values, **more) -> pa.Table:
    data = {"query_id": cell.q["id"].take(pa.array(rows)), "corpus_id": cell.c_ids.take(pa.array(cols)),
            "score": pa.array(values, pa.float64())}
    data.update(more)
    return pa.table(data)


# ---------------------------------------------------------------- operators

def rank_window(scored: DataFrame, k: int | None, descending: bool = True) -> DataFrame:
    """Rank 1..k per query by score, ties by corpus id."""
    order = F.col("score").desc() if descending else F.col("score").asc()
    ranked = scored.withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "corpus_id")))
    return ranked.where(F.col("rank") <= k) if k is not None else ranked


def top_k(queries: DataFrame, corpus: DataFrame, scorer, k: int = 100,
          cells: tuple[int, int] | None = None, max_vectors: int = 4096,
          exclude: DataFrame | None = None) -> DataFrame:
    """The k best corpus records of every query: query_id, corpus_id, score, rank, relevant.

    A record is never its own result, nor are the pairs of `exclude` (query_id, corpus_id); the next records
    move up. `relevant` is 1 for an equal non-null label. A record with more than
    `max_vectors` vectors is cut into pieces that go to different cells; its pairs are then finished from
    per-piece partial values, so one huge record is neither one task's burden nor left out.
    """
    schema = (f"query_id {_id_type(queries)}, corpus_id {_id_type(corpus)}, score double, relevant int")
    if isinstance(scorer, MultiVectorScorer):
        return _top_k_pieces(queries, corpus, scorer, k, cells, max_vectors, exclude)

    return _ordered(rank_window(_grid(queries, corpus, scorer, cells, _best_of_cell(scorer, k, exclude is None), schema,
                                      exclude=exclude, merge=_best_of_both(k), bounded=exclude is None), k))


def _best_of_cell(scorer, k: int, bounded: bool = False):
    """The k best corpus rows of a cell for each of its queries; if `bounded`, as far as they can be among the k best with
    those of `best`."""
    def run(key, q, c, best):
        out, bars = [], None
        if q.num_rows and c.num_rows:
            cell = _Cell(scorer, q, c)
            if best is not None and best.num_rows:
                names, least = _bars(best, k)
                bars = least[pc.index_in(q["id"], value_set=names).fill_null(len(least) - 1).to_numpy()]
            for lo, hi, scores in cell.blocks() if bars is None else cell.raw_blocks():
                rows, cols, values = (_first_k(scores, k) if bars is None
                                      else _first_k_from(cell, lo, hi, scores, bars, k))
                out.append(_pair_table(cell, rows + lo, cols, values,
                                       relevant=pa.array(cell.relevant(rows + lo, cols), pa.int32())))
        return _concat(out, _pair_schema(q, c))

    return run if bounded else lambda key, q, c: run(key, q, c, None)


def _best_of_both(k: int):
    """The k best rows a query out of two tables (query_id, corpus_id, score, ...); ties go to the smaller corpus id."""
    def merge(a: pa.Table, b: pa.Table) -> pa.Table:
        # a query's k-th score in the one table is a bar for its rows in the other
        names, bars = _bars(a, k)
        at = pc.index_in(b["query_id"], value_set=names).fill_null(len(bars) - 1).to_numpy()
        b = b.filter(pa.array(b["score"].to_numpy() >= bars[at]))
        both = pa.concat_tables([a, b])
        # nulls first, as in the order of `rank_window`
        order = [("query_id", "ascending"), ("score", "descending"), ("corpus_id", "ascending")]
        both = both.take(pc.sort_indices(both, sort_keys=order, null_placement="at_start"))
        code = pc.rank(both["query_id"].combine_chunks(), null_placement="at_start", tiebreaker="dense").to_numpy()
        place = np.arange(len(code)) - np.searchsorted(code, code, side="left")
        return both.filter(pa.array(place < k)).combine_chunks()

    return merge


@dataclass
class StoredCorpus:
    """A corpus written by cell: name of the bucketed table, number of cells."""
    name: str
    cells: int


def store_by_cell(corpus: DataFrame, scorer, name: str, path: str, cell_rows: int = CELL_ROWS) -> StoredCorpus:
    """Write `corpus` once as the table `name` in `path`, bucketed by cell, so that later rankings neither count nor
    shuffle it. A cell has about `cell_rows` rows (or vectors), and every core gets one."""
    rows = usable(_items(corpus, scorer.columns), scorer)
    cells = max(2 * corpus.sparkSession.sparkContext.defaultParallelism, math.ceil(_weighted_rows(rows, scorer) / cell_rows))
    placed = rows.withColumn("gc", F.pmod(F.xxhash64("id"), F.lit(cells)).cast("int"))
    (placed.repartition(cells, "gc").write.option("path", path).bucketBy(cells, "gc").sortBy("gc").saveAsTable(name))
    return StoredCorpus(name, cells)


def top_k_stored(queries: DataFrame, stored: StoredCorpus, scorer, k: int = 100) -> DataFrame:
    """`top_k` of a batch of queries against a stored corpus: only the queries move, one copy a cell."""
    schema = (f"query_id {_id_type(queries)}, corpus_id {_id_type(queries.sparkSession.table(stored.name))}, "
              "score double, relevant int")
    q = usable(_items(queries, scorer.columns), scorer).withColumn(
        "gc", F.explode(F.sequence(F.lit(0), F.lit(stored.cells - 1))))
    c = queries.sparkSession.table(stored.name)
    found = q.groupBy("gc").cogroup(c.groupBy("gc")).applyInArrow(_best_of_cell(scorer, k), schema)
    return _ordered(rank_window(found, k))


def _pair_schema(q: pa.Table, c: pa.Table) -> pa.Schema:
    return pa.schema([("query_id", q.schema.field("id").type), ("corpus_id", c.schema.field("id").type),
                      ("score", pa.float64()), ("relevant", pa.int32())])


def _ordered(ranked: DataFrame) -> DataFrame:
    return ranked.select("query_id", "corpus_id", "score", "rank", "relevant")


def _pieces(df: DataFrame, column: str, size: int) -> DataFrame:
    count = F.ceil(F.size(column) / size).cast("int")
    return (df.where(F.size(column) > 0)
              .withColumn("segs", count)
              .withColumn("seg", F.explode(F.sequence(F.lit(0), count - 1)))
              .withColumn(column, F.when(F.col("segs") == 1, F.col(column))
                          .otherwise(F.slice(F.col(column), F.col("seg") * size + 1, F.lit(size)))))


def _piece_values(d: np.ndarray, redux: str, row0: int, col0: int):
    """What one pair of pieces contributes: (s1, s2, value, n) rows, enough to finish `redux` later."""
    name, k = split_redux(redux)
    s1 = np.arange(row0, row0 + d.shape[0])
    none = np.full(d.shape[0], -1)
    if name in ("min", "max"):
        return np.array([-1]), np.array([-1]), np.array([getattr(d, name)()]), np.array([1])
    if name == "mean":
        return np.array([-1]), np.array([-1]), np.array([d.sum()]), np.array([d.size])
    if name in ("meanmin", "bestmin"):
        return s1, none, d.min(1), np.ones(len(s1), int)
    if name == "meanmax":
        return s1, none, d.max(1), np.ones(len(s1), int)
    if name == "minmean":
        return s1, none, d.sum(1), np.full(len(s1), d.shape[1])
    if name in ("best", "worst"):
        flat = d.ravel()
        at = np.argsort(flat if name == "best" else -flat, kind="stable")[:k]
    else:
        k = min(d.shape) if k is None else k
        by_row = np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1) < k
        by_col = np.argsort(np.argsort(d, axis=0, kind="stable"), axis=0) < k
        at = np.flatnonzero(np.ones(d.size, bool) if split_redux(redux)[1] is None else (by_row & by_col).ravel())
    rows, cols = np.divmod(at, d.shape[1])
    return rows + row0, cols + col0, d.ravel()[at], np.ones(len(at), int)


def _top_k_pieces(queries, corpus, scorer, k, cells, max_vectors, exclude=None) -> DataFrame:
    similarity = scorer.mode in ("cosine", "cossim", "dotsim")
    sign = 1.0 if similarity else -1.0
    mirrored = split_redux(scorer.redux)[0][:1] == "s"
    inner = scorer.redux[1:] if mirrored else scorer.redux
    fields = [("score", pa.float64()), ("relevant", pa.int32()), ("side", pa.int32()), ("s1", pa.int64()),
              ("s2", pa.int64()), ("n", pa.int64())]
    schema = (f"query_id {_id_type(queries)}, corpus_id {_id_type(corpus)}, score double, relevant int, "
              "side int, s1 long, s2 long, n long")

    def run(key, q, c):
        out = []
        if q.num_rows and c.num_rows:
            cell = _Cell(scorer, q, c)
            q_cut = q["segs"].to_numpy() > 1
            c_cut = cell.c["segs"].to_numpy() > 1
            q_seg, c_seg = q["seg"].to_numpy(), cell.c["seg"].to_numpy()
            same = cell.q["id"].to_pylist() if (q_cut.any() or c_cut.any()) else None
            c_names = cell.c_ids.to_pylist() if same is not None else None
            for lo, hi, scores in cell.blocks():
                whole = scores.copy()
                whole[q_cut[lo:hi], :] = -np.inf
                whole[:, c_cut] = -np.inf
                rows, cols, values = _first_k(whole, k)
                filler = pa.array(np.full(len(rows), -1), pa.int64())
                out.append(_pair_table(
                    cell, rows + lo, cols, values,
                    relevant=pa.array(cell.relevant(rows + lo, cols), pa.int32()),
                    side=pa.array(np.full(len(rows), -1), pa.int32()), s1=filler, s2=filler, n=filler))
                if same is None:
                    continue
                d = scorer.pair_values(cell.qs, cell.cs, lo, hi)
                for r in range(lo, hi):
                    top = cell.qs[2][r] - cell.qs[2][lo]
                    block = d[top:top + cell.qs[1][r]]
                    skip = set(cell.skips[r] or ()) if cell.skips is not None else ()
                    for j in np.flatnonzero(c_cut | q_cut[r]):
                        if same[r] == c_names[j] or c_names[j] in skip:
                            continue
                        part = block[:, cell.cs[2][j]:cell.cs[2][j + 1]]
                        at = (int(q_seg[r]) * max_vectors, int(c_seg[j]) * max_vectors)
                        sides = [(0, part, at)] + ([(1, part.T, at[::-1])] if mirrored else [])
                        for side, values2d, (r0, c0) in sides:
                            s1, s2, value, n = _piece_values(values2d, inner, r0, c0)
                            size = len(s1)
                            out.append(_pair_table(
                                cell, np.full(size, r), np.full(size, j), value,
                                relevant=pa.array(np.full(size, cell.relevant(r, j)), pa.int32()),
                                side=pa.array(np.full(size, side), pa.int32()), s1=pa.array(s1, pa.int64()),
                                s2=pa.array(s2, pa.int64()), n=pa.array(n, pa.int64())))
        names = [("query_id", q.schema.field("id").type), ("corpus_id", c.schema.field("id").type)]
        return _concat(out, pa.schema(names + fields))

    q = _pieces(queries, scorer.column, max_vectors)
    c = _pieces(corpus, scorer.column, max_vectors)
    scored = _grid(q, c, scorer, cells, run, schema, extra=("seg", "segs"), exclude=exclude)
    if not _has_cut(queries, corpus, scorer.column, max_vectors):
        return _ordered(rank_window(scored.select("query_id", "corpus_id", "score", "relevant"), k))
    whole = scored.where("side = -1").select("query_id", "corpus_id", "score", "relevant")
    parts = scored.where("side >= 0").withColumnRenamed("score", "value")
    finished = (reduce_parts(parts, inner, ["query_id", "corpus_id", "relevant", "side"])
                .groupBy("query_id", "corpus_id", "relevant").agg(F.avg("value").alias("value"))
                .select("query_id", "corpus_id", F.round(F.col("value") * sign, SCORE_DIGITS).alias("score"),
                        "relevant"))
    return _ordered(rank_window(whole.unionByName(finished), k))


def _has_cut(queries, corpus, column, max_vectors) -> bool:
    """Whether any record is cut; without one the partial branch is left out of the plan."""
    return any(not df.where(F.size(column) > max_vectors).limit(1).isEmpty() for df in (queries, corpus))


def reduce_parts(parts: DataFrame, redux: str, keys: list[str]) -> DataFrame:
    """Finish a reduction over rows (keys, s1, s2, value, n); also serves an exploded distance relation
    with n = 1. Output: keys, value."""
    name, k = split_redux(redux)
    value, n = F.col("value"), F.col("n")
    if name in ("min", "max"):
        return parts.groupBy(*keys).agg(getattr(F, name)("value").alias("value"))
    if name == "mean":
        return parts.groupBy(*keys).agg((F.sum("value") / F.sum("n")).alias("value"))
    if name in ("meanmin", "meanmax"):
        inner = F.min("value") if name == "meanmin" else F.max("value")
        return (parts.groupBy(*keys, "s1").agg(inner.alias("value"))
                .groupBy(*keys).agg(F.avg("value").alias("value")))
    if name == "minmean":
        return (parts.groupBy(*keys, "s1").agg((F.sum("value") / F.sum("n")).alias("value"))
                .groupBy(*keys).agg(F.min("value").alias("value")))
    if name in ("best", "worst", "bestmin"):
        rows = parts
        if name == "bestmin":
            rows = (parts.groupBy(*keys, "s1").agg(F.min("value").alias("value"))
                    .withColumn("s2", F.lit(-1).cast("long")))
        order = value.desc() if name == "worst" else value.asc()
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(order, "s1", "s2"))
        return (rows.withColumn("place", place).where(F.col("place") <= k)
                .groupBy(*keys).agg(F.avg("value").alias("value")))
    if name == "bpwr" and k is not None:
        # k picks, each the smallest entry outside the rows and columns of the earlier picks
        w = Window.partitionBy(*keys)
        rows = parts
        for i in range(k):
            free = F.lit(True)
            for j in range(i):
                free = free & (F.col("s1") != F.col(f"pick{j}.s1")) & (F.col("s2") != F.col(f"pick{j}.s2"))
            rows = rows.withColumn(
                f"pick{i}", F.min(F.when(free, F.struct("value", "s1", "s2"))).over(w))
        picks = F.filter(F.array(*[F.col(f"pick{i}.value") for i in range(k)]), lambda x: x.isNotNull())
        return (rows.withColumn("picks", picks).groupBy(*keys).agg(F.first("picks").alias("picks"))
                .select(*keys, (F.aggregate("picks", F.lit(0.0), lambda a, x: a + x) / F.size("picks"))
                        .alias("value")))
    raise ValueError(f"reduction not available on an exploded relation: {redux}")


def best_positive(queries: DataFrame, corpus: DataFrame, scorer, cell_rows: int = CELL_ROWS,
                  exclude: DataFrame | None = None) -> DataFrame:
    """Best-scored record with the label of the query (not itself, not excluded): query_id, corpus_id, score."""
    schema = f"query_id {_id_type(queries)}, corpus_id {_id_type(corpus)}, score double"

    def run(key, q, c):
        out = []
        if q.num_rows and c.num_rows:
            cell = _Cell(scorer, q, c)
            for lo, hi, scores in cell.blocks():
                scores[cell.q_label[lo:hi, None] != cell.c_label[None, :]] = -np.inf
                rows, cols, values = _first_k(scores, 1)
                out.append(_pair_table(cell, rows + lo, cols, values))
        return _concat(out, pa.schema(list(_pair_schema(q, c))[:3]))

    found = _label_grid(queries, corpus, scorer, cell_rows, run, schema, exclude)
    return (found.groupBy("query_id")
            .agg(F.min(F.struct((-F.col("score")).alias("minus"), "corpus_id")).alias("best"))
            .select("query_id", F.col("best.corpus_id").alias("corpus_id"),
                    (-F.col("best.minus")).alias("score")))


def positives(queries: DataFrame, corpus: DataFrame, scorer, floor: float | None = None,
              cell_rows: int = CELL_ROWS) -> DataFrame:
    """Scores of the records that share the label of the query, optionally only from `floor` upwards."""
    runs = positive_runs(queries, corpus, scorer, floor, cell_rows)
    return (runs.select("query_id", F.explode(F.arrays_zip("corpus_ids", "scores")).alias("p"))
            .select("query_id", F.col("p.corpus_ids").alias("corpus_id"), F.col("p.scores").alias("score")))


def positive_runs(queries: DataFrame, corpus: DataFrame, scorer, floor: float | None = None, cell_rows: int = CELL_ROWS,
                  exclude: DataFrame | None = None) -> DataFrame:
    """Records that share the label of the query, as one row a query and cell: query_id, scores, corpus_ids.

    A run is in ranking order (score down, id up) and holds what one cell holds of the label, `cell_rows` at most.
    """
    schema = f"query_id {_id_type(queries)}, scores array<double>, corpus_ids array<{_id_type(corpus)}>"

    def run(key, q, c):
        out = []
        if q.num_rows and c.num_rows:
            cell = _Cell(scorer, q, c)
            for lo, hi, scores in cell.blocks():
                keep = (cell.q_label[lo:hi, None] == cell.c_label[None, :]) & (scores > -np.inf)
                if floor is not None:
                    keep &= scores >= floor
                rows, cols = np.nonzero(keep)
                values = scores[rows, cols]
                order = np.lexsort((cols, -values, rows))
                rows, cols, values = rows[order], cols[order], values[order]
                present, starts = np.unique(rows, return_index=True)
                ends = pa.array(np.append(starts, len(rows)), pa.int32())
                out.append(pa.table({
                    "query_id": cell.q["id"].take(pa.array(present + lo)),
                    "scores": pa.ListArray.from_arrays(ends, pa.array(values, pa.float64())),
                    "corpus_ids": pa.ListArray.from_arrays(ends, cell.c_ids.take(pa.array(cols)))}))
        return _concat(out, pa.schema([("query_id", q.schema.field("id").type), ("scores", pa.list_(pa.float64())),
                                       ("corpus_ids", pa.list_(c.schema.field("id").type))]))

    return _label_grid(queries, corpus, scorer, cell_rows, run, schema, exclude)


def ranked_parts(runs: DataFrame, part_rows: int) -> DataFrame:
    """The runs of each query merged in ranking order and cut into parts: query_id, part, before, scores, corpus_ids.

    `before` counts the entries of earlier parts. A part has at most twice `part_rows` entries, however many a query
    has: of every run each s-th entry is a sample, s being part_rows / runs, and every so many samples end a part.
    Entries are cut by score and id, so ties are no hot part. Rows go with queries and cells, never with entries.
    """
    sizes = runs.groupBy("query_id").agg(F.count("*").alias("runs"), F.sum(F.size("scores")).alias("entries"))
    whole = sizes.where((F.col("entries") <= part_rows) | (F.col("runs") == 1) & (F.col("entries") <= 2 * part_rows))
    entry = F.arrays_zip(F.transform("scores", lambda x: -x).alias("minus"), F.col("corpus_ids").alias("id"))
    marked = runs.select("query_id", entry.alias("entries"))
    small = marked.join(whole.select("query_id"), "query_id", "left_semi").withColumn("part", F.lit(0))

    # few queries: those with more positives than a part holds
    large = sizes.join(whole.select("query_id"), "query_id", "left_anti").select(
        "query_id", "runs", F.greatest(F.lit(1), F.floor(F.lit(part_rows) / F.col("runs"))).cast("int").alias("step"))
    cut = marked.join(large, "query_id")
    sample = F.transform(F.sequence(F.lit(0), F.floor((F.size("entries") - 1) / F.col("step")).cast("int")),
                         lambda i: F.get("entries", (i * F.col("step")).cast("int")))
    samples = cut.select("query_id", "runs", sample.alias("s")).groupBy("query_id", "runs").agg(
        F.sort_array(F.flatten(F.collect_list("s"))).alias("s"))
    edges = samples.select("query_id", F.filter("s", lambda x, i: (i > 0) & (i % F.col("runs") == 0)).alias("edges"))
    # where each edge falls in a run; runs are sorted, so the places rise
    places = F.transform("edges", lambda e: F.size(F.filter("entries", lambda x: x < e)))
    spots = cut.join(edges, "query_id").withColumn("places", F.concat(F.array(F.lit(0)), places, F.array(F.size("entries"))))
    pieces = (spots.withColumn("part", F.explode(F.sequence(F.lit(0), F.size("places") - 2)))
              .withColumn("low", F.get("places", F.col("part"))).withColumn("high", F.get("places", F.col("part") + 1))
              .where("high > low")
              .select("query_id", F.slice("entries", F.col("low") + 1, F.col("high") - F.col("low")).alias("entries"), "part"))
    merged = small.unionByName(pieces).groupBy("query_id", "part").agg(
        F.sort_array(F.flatten(F.collect_list("entries"))).alias("entries"))
    earlier = Window.partitionBy("query_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.size("entries")).over(earlier), F.lit(0))
    return merged.select("query_id", "part", before.alias("before"), F.transform(
        "entries", lambda x: -x["minus"]).alias("scores"), F.transform("entries", lambda x: x["id"]).alias("corpus_ids"))


def count_ahead(queries: DataFrame, corpus: DataFrame, scorer, bars: DataFrame,
                cells: tuple[int, int] | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """`ahead_arrays` as one row a bar: query_id, part, slot (0-based place in the arrays), n_ahead."""
    return ahead_arrays(queries, corpus, scorer, bars, cells, exclude).select(
        "query_id", "part", F.posexplode("ahead").alias("slot", "n_ahead"))


def ahead_arrays(queries: DataFrame, corpus: DataFrame, scorer, bars: DataFrame,
                 cells: tuple[int, int] | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """For each bar of a query, how many corpus records rank before it.

    `bars`: query_id, part, bar_scores ARRAY<DOUBLE>, bar_ids, in ranking order (score down, id up), none of them
    excluded. Output: query_id, part, ahead (a count for each bar). Neither self nor excluded pairs are counted. What
    leaves a cell is one row a query and part.
    """
    schema = f"query_id {_id_type(queries)}, part int, ahead array<bigint>"
    with_bars = (_items(queries, scorer.columns, tuple(getattr(scorer, "q_columns", ())))
                 .join(bars.withColumnRenamed("query_id", "id"), "id"))
    extra = ("part", "bar_scores", "bar_ids")

    def run(key, q, c):
        rows, counts = [], []
        if q.num_rows and c.num_rows:
            cell = _Cell(scorer, q, c)
            lengths = pc.list_value_length(q["bar_scores"]).to_numpy()
            ends = np.cumsum(lengths)
            bar_scores = q["bar_scores"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            bar_ids = q["bar_ids"].combine_chunks().flatten()
            # place of each bar id among the sorted corpus ids: the number of smaller ids
            smaller = _count_smaller(cell.c_ids, bar_ids)
            # a bar that is in this cell ties with itself; only further ties need a look at the ids
            inside = pc.is_in(bar_ids, value_set=cell.c_ids).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, scores in cell.blocks():
                for r in range(lo, hi):
                    row = scores[r - lo]
                    at = slice(ends[r] - lengths[r], ends[r])
                    asc = np.sort(row)
                    above = len(row) - np.searchsorted(asc, bar_scores[at], side="right")
                    tied = len(row) - np.searchsorted(asc, bar_scores[at], side="left") - above
                    for t in np.flatnonzero(tied > inside[at]):
                        above[t] += int((row[:smaller[at][t]] == bar_scores[at][t]).sum())
                    rows.append(r)
                    counts.append(above)
        sizes = np.concatenate([[0], np.cumsum([len(c) for c in counts])]).astype(np.int32)
        flat = pa.array(np.concatenate(counts) if counts else np.array([], np.int64), pa.int64())
        picked = pa.array(rows, pa.int64())
        return pa.table({"query_id": q["id"].take(picked), "part": q["part"].take(picked),
                         "ahead": pa.ListArray.from_arrays(pa.array(sizes), flat)})

    def add(a, b):
        # both have the rows of one group of queries, in its order
        lists = a["ahead"].combine_chunks()
        total = pc.add(lists.flatten(), b["ahead"].combine_chunks().flatten())
        return a.set_column(2, "ahead", pa.ListArray.from_arrays(lists.offsets, total))

    if exclude is None:
        # bars travel with the queries: where they have many, a group has fewer queries
        gq, gc = cells or grid_shape(with_bars, corpus, scorer)
        entries = bars.agg(F.sum(F.size("bar_scores"))).first()[0] or 0
        cells = max(gq, math.ceil(entries / GROUP_BARS)), gc
    counted = _grid(with_bars, corpus, scorer, cells, run, schema, extra=extra, exclude=exclude, merge=add)
    # whole arrays are added, as integers (a floating-point mean of many cells would lose single ranks), at most
    # MERGED arrays in one row
    counted = counted.withColumn("cell", F.pmod(F.spark_partition_id(), F.lit(MERGED)))
    for keys in (["query_id", "part", "cell"], ["query_id", "part"]):
        counted = counted.groupBy(*keys).agg(F.collect_list("ahead").alias("all")).select(*keys, F.aggregate(
            F.slice("all", 2, F.size("all")), F.get("all", F.lit(0)),
            lambda a, x: F.zip_with(a, x, lambda m, n: m + n)).alias("ahead"))
    return counted


def placed_positives(queries: DataFrame, corpus: DataFrame, scorer, cells: tuple[int, int] | None = None,
                     exclude: DataFrame | None = None, cell_rows: int = CELL_ROWS, held_scores: int = HELD_SCORES) -> DataFrame:
    """Sums over the places that the records with the label of a query take in its whole ranking: query_id, precision
    (the sum of i / place of the i-th), r1 (the first place), n_relevant, all_ahead (the sum of places, counted from 0).

    No positive leaves its task: each holds a group of queries, reads the packed corpus cell after cell, and places the
    positives when it has all scores of a query, so a row a query is all that is written. A group has about `held_scores`
    scores, one query at least; see `ranking.full_ranking_metrics` for a corpus larger than that.
    """
    schema = f"query_id {_id_type(queries)}, precision double, r1 long, n_relevant long, all_ahead long"
    q = usable(_items(queries, scorer.columns, tuple(getattr(scorer, "q_columns", ()))), scorer).where("id is not null")
    c = usable(_items(corpus, scorer.columns), scorer)
    cores = q.sparkSession.sparkContext.defaultParallelism
    n_q, n_c, load = max(1, q.count()), max(1, c.count()), max(1, _weighted_rows(c, scorer))
    # small cells only for as many tasks as there is use for, as in the grids of labels
    side = min(max(cell_rows, math.ceil(load / (GRID_CELLS * cores))), CELL_ROWS)
    groups, parts = cells or (4 * cores, math.ceil(load / side))
    # scores are held as whole numbers of half the size
    groups = min(n_q, max(groups, math.ceil(n_q * n_c / (2 * held_scores))))
    if exclude is not None:
        skips = (exclude.select(F.col("query_id").cast(q.schema["id"].dataType).alias("id"),
                                F.col("corpus_id").cast(c.schema["id"].dataType).alias("corpus_id"))
                 .groupBy("id").agg(F.collect_set("corpus_id").alias("skip")))
        q = q.join(skips, "id", "left")
    # one partition of the whole corpus, which is read as a stream
    pairs = (_packed(c, min(n_c, parts), by_id=True).select(F.col("packed").alias("c")).coalesce(1)
             .crossJoin(_packed(q, groups).select("number", F.col("packed").alias("q")).hint("shuffle_replicate_nl")))

    def go_through(batches):
        asked, held, ids, labels = {}, {}, {}, {}
        for batch in batches:
            for i, number in enumerate(batch["number"].to_pylist()):
                cell = _Cell(scorer, _unpacked(batch["q"][i]), _unpacked(batch["c"][i]))
                if number not in asked:
                    asked[number] = cell.q.select(["id", "label"])
                    held[number], ids[number], labels[number] = [], [], []
                held[number].append(_held(cell))
                # copies, which keep no buffer of a batch alive
                ids[number].append(cell.c_ids.take(pa.array(np.arange(len(cell.c_ids)))))
                labels[number].append(cell.c["label"].combine_chunks().take(pa.array(np.arange(len(cell.c_ids)))))
        for number, q in asked.items():
            yield _places(q, held.pop(number), pa.chunked_array(ids.pop(number)), pa.chunked_array(labels.pop(number)))

    return pairs.select("number", "q", "c").mapInArrow(go_through, schema)


def _held(cell: _Cell) -> np.ndarray:
    """Scores of a cell in units of the last digit they are rounded to, as int32 where they fit, else as they are; what doesn't
    count has the least value."""
    unit, out = 10.0 ** SCORE_DIGITS, np.empty((cell.q.num_rows, cell.c.num_rows), np.int32)
    for lo, hi, scores in cell.raw_blocks():
        scores *= unit
        np.rint(scores, out=scores)
        # not so if any is NaN
        if scores.size and not (scores.min() > -LARGEST and scores.max() < LARGEST):
            plain = np.empty(out.shape)
            for lo, hi, scores in cell.blocks():
                plain[lo:hi] = scores
            return plain
        out[lo:hi] = scores
        rows, cols = cell.left_out(lo, hi)
        out[rows + lo, cols] = -LARGEST
    return out


def _places(q: pa.Table, cells: list[np.ndarray], ids: pa.ChunkedArray, labels: pa.ChunkedArray) -> pa.RecordBatch:
    """The rows of `placed_positives` for queries whose scores with the corpus lie in `cells`, side by side."""
    least = -LARGEST
    if any(cell.dtype != np.int32 for cell in cells):
        least = -np.inf
        cells = [cell if cell.dtype != np.int32 else np.where(cell == -LARGEST, -np.inf, cell / 10.0 ** SCORE_DIGITS) for cell in cells]
    known = pc.unique(q["label"]).drop_null()
    q_label = pc.index_in(q["label"], value_set=known, skip_nulls=True).fill_null(-1).to_numpy()
    c_label = pc.index_in(labels, value_set=known, skip_nulls=True).fill_null(-2).to_numpy()
    members = {code: np.flatnonzero(c_label == code) for code in np.unique(q_label) if code >= 0}
    c_rank = pc.rank(ids.combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64)
    names = q["id"].combine_chunks().dictionary_encode()
    code = names.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    found = []
    for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
        # a query whose id repeats is ranked as one, with the candidates of all its rows
        scores = [np.concatenate([cell[r] for cell in cells]) for r in rows]
        own = []
        for r, row in zip(rows, scores):
            mine = members.get(q_label[r], np.empty(0, np.int64))
            own.append(mine[row[mine] > least])
        if not sum(map(len, own)):
            continue
        if len(rows) == 1:
            ahead = _ahead_of_own(scores[0], c_rank, own[0])
        else:
            bars = np.concatenate([row[mine] for row, mine in zip(scores, own)])
            ranks = np.concatenate([c_rank[mine] for mine in own])
            placed = np.lexsort((ranks, -bars))
            ahead = sum(_ahead(row, c_rank, bars[placed], ranks[placed]) for row in scores)
        found.append((code[rows[0]], float((np.arange(1, len(ahead) + 1) / (ahead + 1)).sum()), int(ahead.min()) + 1,
                      len(ahead), int(ahead.sum())))
    which, precision, r1, n, total = zip(*found) if found else ((),) * 5
    return pa.record_batch({
        "query_id": names.dictionary.take(pa.array(which, pa.int64())), "precision": pa.array(precision, pa.float64()),
        "r1": pa.array(r1, pa.int64()), "n_relevant": pa.array(n, pa.int64()), "all_ahead": pa.array(total, pa.int64())})


def _ahead_of_own(row: np.ndarray, c_rank: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How many scores of `row` come before each of those at `own`, ascending; equal ones come by rank. Values are sorted without
    their places; only where a value repeats are its places looked up."""
    asc, bars = np.sort(row), np.sort(row[own])
    upto = np.searchsorted(asc, bars, side="right")
    ahead = len(row) - upto
    tied = (upto >= 2) & (asc[upto - 2] == bars)
    if tied.any():
        values = np.unique(bars[tied])
        if row.dtype == np.int32:
            # few values: most of the row is ruled out by its last bits
            near = np.zeros(1 << 16, dtype=bool)
            near[values & 0xFFFF] = True
            at, mine = np.flatnonzero(near.take(row & 0xFFFF)), own[near[row[own] & 0xFFFF]]
            at = at[np.isin(row[at], values)]
        else:
            at, mine = np.flatnonzero(np.isin(row, values)), own
        # value, then rank, as one number
        which = np.searchsorted(values, row[at])
        width = int(c_rank.max()) + 1
        keys = np.sort(which * width + c_rank[at])
        mine = mine[np.isin(row[mine], values)]
        which = np.searchsorted(values, row[mine])
        before = np.searchsorted(keys, which * width + c_rank[mine]) - np.searchsorted(keys, which * width)
        ahead = np.concatenate([ahead[~tied], len(row) - np.searchsorted(asc, row[mine], side="right") + before])
    return np.sort(ahead)


def _ahead(row: np.ndarray, c_rank: np.ndarray, bars: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """How many scores of `row` come before each bar: larger ones, and equal ones whose id has a smaller rank."""
    asc = np.sort(row)
    upto = np.searchsorted(asc, bars, side="right")
    ahead = len(row) - upto
    at = np.flatnonzero((upto > 0) & (asc[upto - 1] == bars))
    # score and rank as one number, smaller for what comes first
    values = np.unique(asc)
    width = int(c_rank.max()) + 1
    keys = np.sort((len(values) - 1 - np.searchsorted(values, row)) * width + c_rank)
    ahead[at] = np.searchsorted(keys, (len(values) - 1 - np.searchsorted(values, bars[at])) * width + ranks[at])
    return ahead


def _count_smaller(sorted_ids: pa.Array, wanted: pa.Array) -> np.ndarray:
    """How many of the ascending ids are smaller than each wanted id (any orderable Arrow type)."""
    n = len(sorted_ids)
    both = pa.table({"id": pa.concat_arrays([wanted.cast(sorted_ids.type), sorted_ids]),
                     "side": pa.array([0] * len(wanted) + [1] * n, pa.int8()),
                     "at": pa.array(list(range(len(wanted))) + [0] * n, pa.int64())})
    both = both.sort_by([("id", "ascending"), ("side", "ascending")])
    side = both["side"].to_numpy()
    seen = np.cumsum(side)
    out = np.empty(len(wanted), dtype=np.int64)
    out[both["at"].to_numpy()[side == 0]] = seen[side == 0]
    return out


def softmax_stats(queries: DataFrame, corpus: DataFrame, scorer: SoftmaxMeanScorer,
                  cells: tuple[int, int] | None = None) -> DataFrame:
    """Row maximum and row sum of exponentials over the whole corpus, one array entry a part."""
    schema = f"query_id {_id_type(queries)}, part int, top double, total double"
    plain = _PlainParts(scorer.parts, None)

    def run(key, q, c):
        out = []
        if q.num_rows and c.num_rows:
            cell = _Cell(plain, q, c)
            for i in range(len(plain.parts)):
                plain.pick = i
                for lo, hi, scores in cell.blocks():
                    top = scores.max(1)
                    live = top > -np.inf
                    total = np.exp(scores[live] - top[live, None]).sum(1)
                    out.append(pa.table({
                        "query_id": cell.q["id"].take(pa.array(np.flatnonzero(live) + lo)),
                        "part": pa.array(np.full(len(total), i), pa.int32()),
                        "top": pa.array(top[live], pa.float64()), "total": pa.array(total, pa.float64())}))
        return _concat(out, pa.schema([("query_id", q.schema.field("id").type), ("part", pa.int32()),
                                       ("top", pa.float64()), ("total", pa.float64())]))

    def rescaled(a, b):
        both = pa.concat_tables([a, b])
        both = both.take(pc.sort_indices(both, sort_keys=[("query_id", "ascending"), ("part", "ascending")]))
        code = pc.rank(both["query_id"].combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64)
        code = code * len(plain.parts) + both["part"].to_numpy()
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        top, total = both["top"].to_numpy(), both["total"].to_numpy()
        most = np.maximum.reduceat(top, starts) if len(starts) else top
        total = total * np.exp(top - np.repeat(most, np.diff(np.append(starts, len(code)))))
        return pa.table({"query_id": both["query_id"].take(pa.array(starts)), "part": both["part"].take(pa.array(starts)),
                         "top": pa.array(most, pa.float64()),
                         "total": pa.array(np.add.reduceat(total, starts) if len(starts) else total, pa.float64())})

    local = _grid(queries, corpus, plain, cells, run, schema, merge=rescaled)
    # merged by the usual rescaling: every local sum is brought to the overall maximum
    parts = F.sort_array(F.collect_list(F.struct("part", "top", "total")))
    return (local.groupBy("query_id", "part")
            .agg(F.collect_list(F.struct("top", "total")).alias("cells"))
            .withColumn("top", F.array_max(F.transform("cells", lambda x: x["top"])))
            .withColumn("total", F.aggregate("cells", F.lit(0.0),
                                             lambda acc, x: acc + x["total"] * F.exp(x["top"] - F.col("top"))))
            .groupBy("query_id").agg(parts.alias("parts"))
            .select("query_id", F.transform("parts", lambda x: x["top"]).alias("soft_max"),
                    F.transform("parts", lambda x: x["total"]).alias("soft_sum")))


class _PlainParts:
    """One part of a compound scorer at a time."""

    def __init__(self, parts, pick):
        self.parts, self.pick = parts, pick

    @property
    def columns(self):
        return [name for part in self.parts for name in part.columns]

    def weight(self, table):
        return np.max([part.weight(table) for part in self.parts], axis=0)

    def prepare(self, table):
        return [part.prepare(table) for part in self.parts]

    def score(self, q, c, lo, hi):
        return self.parts[self.pick].score(q[self.pick], c[self.pick], lo, hi)


def above_bar(queries: DataFrame, corpus: DataFrame, scorer, other_label: bool = True,
              cells: tuple[int, int] | None = None) -> DataFrame:
    """Pairs whose score is greater than the `bar` of the query (a column of `queries`), by default only
    between different labels: query_id, corpus_id, score. Nothing below the bar leaves a cell."""
    schema = f"query_id {_id_type(queries)}, corpus_id {_id_type(corpus)}, score double"

    def run(key, q, c):
        out = []
        if q.num_rows and c.num_rows:
            cell = _Cell(scorer, q, c)
            bar = q["bar"].to_numpy()
            for lo, hi, scores in cell.blocks():
                keep = scores > bar[lo:hi, None]
                if other_label:
                    keep &= cell.q_label[lo:hi, None] != cell.c_label[None, :]
                rows, cols = np.nonzero(keep)
                out.append(_pair_table(cell, rows + lo, cols, scores[rows, cols]))
        return _concat(out, pa.schema(list(_pair_schema(q, c))[:3]))

    return _grid(queries, corpus, scorer, cells, run, schema, extra=("bar",))


def above_each_bar(queries: DataFrame, corpus: DataFrame, scorer, other_label: bool = True,
                   cells: tuple[int, int] | None = None) -> DataFrame:
    """For every bar of a query, the pairs whose score is greater, by default only between different labels: query_id, bar_id,
    bar_score, corpus_id, score.

    `queries` have `bar_scores`, ascending, and `bar_ids`. A pair meets the bars where it is scored, and its rows leave the task
    OUT_ROWS at a time, so nothing of a size beyond the two inputs is shuffled, written or held.
    """
    bar_type = queries.schema["bar_ids"].dataType.elementType.simpleString()
    schema = (f"query_id {_id_type(queries)}, bar_id {bar_type}, bar_score double, corpus_id {_id_type(corpus)}, score double")

    def run(key, q, c):
        cell = _Cell(scorer, q, c)
        bar_lists = q["bar_scores"].combine_chunks()
        starts = np.append(0, np.cumsum(pc.list_value_length(bar_lists).fill_null(0).to_numpy(zero_copy_only=False)))
        bars = bar_lists.flatten().to_numpy(zero_copy_only=False)
        bar_ids = q["bar_ids"].combine_chunks().flatten()
        lowest = np.full(q.num_rows, np.inf)
        some = np.diff(starts) > 0
        lowest[some] = bars[starts[:-1][some]]
        for lo, hi, scores in cell.blocks():
            keep = scores > lowest[lo:hi, None]
            if other_label:
                keep &= cell.q_label[lo:hi, None] != cell.c_label[None, :]
            rows, cols = np.nonzero(keep)
            values, ends = scores[rows, cols], np.searchsorted(rows, np.arange(hi - lo + 1))
            rows += lo
            passed = np.empty(len(rows), np.int64)
            for r in np.flatnonzero(np.diff(ends)):
                own = slice(ends[r], ends[r + 1])
                passed[own] = np.searchsorted(bars[starts[lo + r]:starts[lo + r + 1]], values[own])
            total = np.cumsum(passed)
            at = 0
            while at < len(rows):
                upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + OUT_ROWS, side="right")))
                n = passed[at:upto]
                pair = np.repeat(np.arange(at, upto), n)
                bar = starts[rows[pair]] + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.record_batch({
                    "query_id": cell.q["id"].combine_chunks().take(pa.array(rows[pair])), "bar_id": bar_ids.take(pa.array(bar)),
                    "bar_score": pa.array(bars[bar], pa.float64()), "corpus_id": cell.c_ids.take(pa.array(cols[pair])),
                    "score": pa.array(values[pair], pa.float64())})
                at = upto

    return _grid(queries, corpus, scorer, cells, run, schema, extra=("bar_scores", "bar_ids"))


# Default distance and reduction of known audio baselines.
MODEL_DISTANCES = {
    "bytecover": ("cos", "min"),
    "clews": ("nsqeuc", "bpwr-5"),
    "cqtnet": ("cos", "min"),
    "dvinet": ("cos", "min"),
}


def model_scorer(name: str, column: str = "vectors") -> MultiVectorScorer:
    """Scorer with the distance and reduction a model was made for. `unmasked` takes masked shingles out."""
    if name not in MODEL_DISTANCES:
        raise ValueError(f"unknown model: {name}")
    mode, redux = MODEL_DISTANCES[name]
    return MultiVectorScorer(column, mode, redux)
