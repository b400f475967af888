"""Packing of documents into windows of equal length by multiway differencing (Karmarkar-Karp)."""

from __future__ import annotations

import base64
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import query, table, text_of

#: Tokens of a window, documents planned together, and the share of padding up to which the window count may rise.
WINDOW = 2048
SHARD_DOCS = 2000
RISE_SHARE = 0.05
#: Longer texts go through the tokenizers library itself, whose pattern engine has no backtracking limit.
LONG_TEXT = 400_000


class ByteBpe:
    """The byte-level vocabulary, by its rank file, with the same ids as the tokenizers file beside it."""

    def __init__(self, pattern: str, ranks: str, spec: str):
        import tiktoken
        from tokenizers import Tokenizer

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.exact = Tokenizer.from_str(spec)
        special = {t.content: i for i, t in self.exact.get_added_tokens_decoder().items()}
        self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if len(text) > LONG_TEXT:
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4")


def difference(sizes: list[int], ways: int) -> list[list[int]]:
    """Deal items over `ways` sets with near-equal sums: the largest-differencing method for many sets.

    A partial partition lists its non-empty sets from the heaviest down; the others are empty. The two partitions with
    the widest spread are merged again and again, the heaviest set of one with the lightest of the other, so that their
    imbalances cancel. Returns the item numbers of each set, heaviest set first; ties go by item order.
    """
    heap, parts = [], {}
    for i, size in enumerate(sizes):
        parts[i] = [(-size, i, [i])]
        heap.append((-size if ways > 1 else 0, i))
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        a, b = parts.pop(heapq.heappop(heap)[1]), parts.pop(heapq.heappop(heap)[1])
        over = max(0, len(a) + len(b) - ways)
        # with `over` sets too many, the lightest sets of both meet in opposite order; all others meet an empty set
        merged = a[:len(a) - over] + b[:len(b) - over]
        if over:
            for (x, first, left), (y, _, right) in zip(a[-over:], reversed(b[-over:])):
                merged.append((x + y, first, left + right))
        # sets are (negated sum, first item, items), so their plain order is heaviest first
        merged.sort()
        lightest = merged[-1][0] if len(merged) == ways else 0
        parts[number] = merged
        heapq.heappush(heap, (merged[0][0] - lightest, number))
        number += 1
    sets = [members for _, _, members in parts[heap[0][1]]] if heap else []
    return sets + [[] for _ in range(ways - len(sets))]


def _dealt(sizes: list[int], ways: int) -> tuple[list[list[int]], list[int]]:
    sets = difference(sizes, ways)
    return sets, [sum(sizes[i] for i in s) for s in sets]


def plan_windows(sizes: list[int], window: int, rise_share: float = RISE_SHARE) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (item, start, length); items are shorter than a window.

    The window count starts at the fewest that hold all tokens and rises while a set exceeds the window, each time by
    the share that the heaviest set is over, until all sets fit and no item is cut. Only where they don't fit with padding within
    `rise_share` (items that fill windows badly, such as many of just over half a window) the fewest windows are
    taken; what exceeds one is cut off its last item and laid into windows with room.
    """
    total = sum(sizes)
    if not total:
        return []
    fewest = -(-total // window)
    most = max(fewest, int(total / window / (1 - rise_share)))
    sets, loads = first, heavy = _dealt(sizes, fewest)
    ways = fewest
    while max(loads) > window and ways < most:
        ways = min(most, ways + max(1, ways * (max(loads) - window) // window))
        sets, loads = _dealt(sizes, ways)
    if max(loads) > window:
        sets, loads = first, heavy
    plan, spare = [], []
    for members, load in zip(sets, loads):
        pieces = [(i, 0, sizes[i]) for i in members]
        while load > window:
            item, start, length = pieces.pop()
            cut = min(load - window, length)
            spare.append((item, start + length - cut, cut))
            load -= cut
            if length > cut:
                pieces.append((item, start, length - cut))
        plan.append(pieces)
    for pieces in plan:
        room = window - sum(p[2] for p in pieces)
        while room and spare:
            item, start, length = spare.pop()
            take = min(room, length)
            pieces.append((item, start, take))
            if length > take:
                spare.append((item, start + take, length - take))
            room -= take
    return plan


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, window: int = WINDOW,
         shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Cut documents into pieces and lay them into windows of `window` tokens.

    A document is its ids and then `end_id`; null is the empty text, so every row has at least one token. Whole windows of
    a document stand alone. The tails of about `shard_docs` documents are planned together, and only they are shuffled.
    One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Rows with the same id are packed as
    separate documents. Empty input gives no rows. Numbers are unique over shards: local number x shards + shard.
    """
    import public_tokenizers

    spark = docs.sparkSession
    files = {}
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json"):
        with open(public_tokenizers.path(name), encoding="utf-8") as file:
            files[name] = file.read()
    spec = spark.sparkContext.broadcast(
        (public_tokenizers.PATTERN, files["byte_bpe_50k.tiktoken"], files["byte_bpe_50k.json"]))
    shards = max(1, -(-docs.count() // shard_docs))
    rows = docs.select(F.col(id_col).alias("id"), text_of(docs, text_col).alias("text"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.length("text")), F.lit(shards)))
    kind = rows.schema["id"].dataType.simpleString()
    block = window * 4

    def cut(batches):
        model = ByteBpe(*spec.value)
        for batch in batches:
            tokens, sums, tails = [], [], []
            for value in batch.column("text"):
                packed = np.append(model.ids(value.as_py()), np.uint32(end_id)).astype("<u4").tobytes()
                whole = len(packed) // block
                tokens.append(len(packed) // 4)
                sums.append([zlib.crc32(packed[i * block:(i + 1) * block]) for i in range(whole)])
                tails.append(packed[whole * block:])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("shard"), pa.array(tokens, pa.int64()),
                 pa.array(sums, pa.list_(pa.int64())), pa.array(tails, pa.binary())],
                ["id", "shard", "tokens", "sums", "tail"])

    cut_rows = rows.select("id", "shard", "text").mapInArrow(
        cut, f"id {kind}, shard bigint, tokens bigint, sums array<bigint>, tail binary")

    def lay(group: pa.Table) -> pa.Table:
        ids, tokens, tails = (group[c].to_pylist() for c in ("id", "tokens", "tail"))
        # a fixed order, so that a task that runs again gives the same plan
        order = sorted(range(group.num_rows), key=lambda i: (ids[i] is not None, ids[i] or 0, tokens[i], tails[i]))
        sums, shard = group["sums"].to_pylist(), group["shard"][0].as_py()
        out, number = [], 0
        for i in order:
            for k, crc in enumerate(sums[i]):
                out.append((ids[i], k * window, window, crc, tokens[i], number * shards + shard, 0))
                number += 1
        with_tail = [i for i in order if tails[i]]
        for pieces in plan_windows([len(tails[i]) // 4 for i in with_tail], window):
            offset = 0
            for item, start, length in pieces:
                i = with_tail[item]
                crc = zlib.crc32(tails[i][start * 4:(start + length) * 4])
                out.append((ids[i], len(sums[i]) * window + start, length, crc, tokens[i], number * shards + shard,
                            offset))
                offset += length
            number += bool(pieces)
        columns = list(zip(*out))
        kinds = [group.schema.field("id").type] + [pa.int64()] * 6
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)],
                        names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    out = cut_rows.groupBy("shard").applyInArrow(
        lay, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
             "offset bigint")
    return out.withColumnRenamed("id", id_col)


@query("op9_packing")
def op9_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
