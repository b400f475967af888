"""New recordings, arriving as files, are ranked against a stored corpus."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from versionlake.operators import tiles
from versionlake.session import shared_folder


# Queries of a micro-batch that are ranked at a time: a task holds all of them beside one cell of the corpus.
SLICE_ROWS = 32_768


def rank_arrivals(arrivals: DataFrame, corpus: DataFrame | tiles.StoredCorpus, scorer, out_path: str, checkpoint: str,
                  k: int = 100) -> StreamingQuery:
    """Every micro-batch of queries (id, label, columns of the scorer) gets its top k, written under its
    batch number: a replayed batch replaces its own output, so each query appears once.

    The corpus is laid out by cell once, before the first batch (or was, by `tiles.store_by_cell`); a batch
    neither counts nor shuffles it. A large batch is ranked slice after slice, about SLICE_ROWS queries at a time.
    """
    if isinstance(corpus, tiles.StoredCorpus):
        stored = corpus
    else:
        stored = tiles.store_by_cell(corpus, scorer, f"corpus_{uuid.uuid4().hex}", shared_folder(corpus.sparkSession, "corpus"))

    def write(batch: DataFrame, number: int) -> None:
        slices = math.ceil(batch.count() / SLICE_ROWS)
        for at in range(slices):
            part = batch if slices == 1 else batch.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == at)
            tiles.top_k_stored(part, stored, scorer, k).write.mode("append" if at else "overwrite").parquet(
                f"{out_path}/batch={number}")

    return (arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
