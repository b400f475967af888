"""Benchmark decontamination: a prefix-filtered join of benchmark windows with whole documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import query, table, text_of, written

#: Words of a window and of a shingle.
WINDOW = 10
SHINGLE = 5
#: Bits of the filter that documents are read through: a multiple of the tokens, up to 2 ** MOST_BITS (32 MB).
BITS_A_TOKEN = 64
MOST_BITS = 28
#: Hits of a token that a task takes; a token with more is salted. At most MOST_HOT tokens are.
HOT_HITS = 200_000
MOST_HOT = 100_000

#: Bytes of words stay, A-Z are lower-cased, all others part words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every `size` consecutive words."""
    count = len(hashes) - size + 1
    mixed = np.full(max(0, count), np.uint64(size * 0x5851F42D4C957F2D % 2 ** 64))
    for i in range(size if count > 0 else 0):
        mixed = (mixed ^ hashes[i:i + count]) * _MIX[0]
        mixed ^= mixed >> np.uint64(29)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX[1]
    return mixed ^ (mixed >> np.uint64(31))


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), text_of(docs, text_col).cast("binary").alias("text"))


def item_windows(items: DataFrame, window: int, shingle: int, item_col: str, text_col: str) -> DataFrame:
    """item, n, words, tokens: every `window` consecutive words of each item, a shorter item as one, and their shingles.

    words is the window with a space between words; a window shorter than a shingle is one token.
    """
    rows = _texts(items, item_col, text_col).select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("item"), "text")

    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column("item"), batch.column("text")):
                parts = words_of(text.as_py())
                size = min(window, len(parts))
                if not size:
                    continue
                every = _signed(shingle_hashes(_hashed(parts), min(shingle, size)))
                step = size - min(shingle, size) + 1
                starts = range(len(parts) - size + 1)
                for lo in range(0, len(starts), 5000):
                    some = starts[lo:lo + 5000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item.as_py()] * len(some), pa.string()), pa.array([size] * len(some), pa.int32()),
                         pa.array([b" ".join(parts[s:s + size]) for s in some], pa.binary()),
                         pa.array([every[s:s + step] for s in some], pa.list_(pa.int64()))],
                        ["item", "n", "words", "tokens"])

    return rows.mapInArrow(run, "item string, n int, words binary, tokens array<bigint>")


def token_filter(tokens: DataFrame) -> tuple[int, bytes]:
    """(bits of a place, bitmap): the places of all `token`s by their highest bits. At most 2 ** MOST_BITS bits.

    The bitmap is put together in Spark in pieces of 4 KB; what reaches the driver is bounded by its size. It lets some
    other tokens pass, which the join removes.
    """
    n = tokens.count()
    bits = int(min(MOST_BITS, max(16, np.ceil(np.log2(max(1, n) * BITS_A_TOKEN)))))
    place = F.shiftrightunsigned("token", 64 - bits)
    chunk = 15

    def pack(group: pa.Table) -> pa.Table:
        flags = np.zeros(1 << chunk, np.uint8)
        flags[group["place"].to_numpy() & ((1 << chunk) - 1)] = 1
        return pa.table({"piece": group["piece"].slice(0, 1).combine_chunks(),
                         "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    pieces = tokens.select(place.alias("place")).distinct().withColumn("piece", F.shiftright("place", chunk))
    out = bytearray(1 << (bits - 3))
    for row in pieces.groupBy("piece").applyInArrow(pack, "piece bigint, bits binary").toLocalIterator():
        at = row["piece"] << (chunk - 3)
        out[at:at + len(row["bits"])] = row["bits"]
    return bits, bytes(out)


def _found(hashes: np.ndarray, bits: int, bitmap: np.ndarray) -> np.ndarray:
    """Positions of the hashes that pass the filter."""
    place = hashes >> np.uint64(64 - bits)
    return np.flatnonzero((bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1)


def token_counts(docs: DataFrame, tokens: DataFrame, sizes: list[int]) -> DataFrame:
    """token, df: occurrences in all documents of the given tokens, shingles of the given sizes."""
    bits, bitmap = token_filter(tokens)
    spec = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        flags = np.frombuffer(spec.value, np.uint8)
        for batch in batches:
            hit = []
            for text in batch.column("text"):
                hashes = _hashed(words_of(text.as_py()))
                for size in sizes:
                    own = shingle_hashes(hashes, size)
                    hit.append(own[_found(own, bits, flags)])
            values, counts = np.unique(np.concatenate(hit) if hit else np.empty(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(values)), pa.array(counts.astype(np.int64))], ["token", "df"])

    seen = docs.select("text").mapInArrow(run, "token bigint, df bigint")
    return seen.groupBy("token").agg(F.sum("df").alias("df")).join(tokens, "token")


def document_hits(docs: DataFrame, tokens: DataFrame, sizes: list[int], window: int) -> DataFrame:
    """id, n_words and the hits of every document: token, start (from 0), left, around.

    around is the text of the words that any window with the token may have, left the number of those before it.
    """
    bits, bitmap = token_filter(tokens)
    spec = docs.sparkSession.sparkContext.broadcast(bitmap)
    kind = docs.schema["id"].dataType.simpleString()
    fields = [("token", pa.int64()), ("start", pa.int64()), ("left", pa.int32()), ("around", pa.binary())]

    def run(batches):
        flags = np.frombuffer(spec.value, np.uint8)
        for batch in batches:
            counts, ends = [], [0]
            columns: list[list] = [[], [], [], []]
            for text in batch.column("text"):
                parts = words_of(text.as_py())
                hashes = _hashed(parts)
                for size in sizes:
                    own = shingle_hashes(hashes, size)
                    places = _found(own, bits, flags)
                    columns[0] += _signed(own[places]).tolist()
                    for at in places.tolist():
                        first = max(0, at - window + size)
                        columns[1].append(at)
                        columns[2].append(at - first)
                        columns[3].append(b" ".join(parts[first:at + window]))
                counts.append(len(parts))
                ends.append(len(columns[0]))
            hits = pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits)],
                ["id", "n_words", "hits"])

    return docs.mapInArrow(run, f"id {kind}, n_words bigint, "
                                "hits array<struct<token:bigint,start:bigint,left:int,around:binary>>")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "doc_id",
          text_col: str = "text", item_col: str = "item_id", item_text: str = "text", hot_hits: int = HOT_HITS) -> DataFrame:
    """id, n_words, spans, items of every document: where it holds `window` consecutive words of a benchmark item.

    Words are runs of 0-9, letters and all characters from U+0080 on, A-Z lower-cased. An item with fewer words, but not
    none, is one window. spans are the merged (start, end) of word positions that occurrences cover, end exclusive; items the
    sorted distinct ids, as text, of the items with an occurring window. Null texts have no words; a null item id is the
    empty text. Repeated documents and ids each get a row; repeated items and ids are one. Texts are read whole. Other
    columns are ignored; an empty benchmark leaves all documents clean, an empty table gives no rows.

    1. Every window is a set of shingles with their offsets. Occurrences of all of them are counted over all documents,
       which gives the rarity order.
    2. A document that holds a window holds all its shingles, so the rarest is a prefix that suffices: it alone is joined
       with the documents. A window whose rarest shingle never occurs is left out.
    3. Candidates must have room for the window before and after the shingle (position and length), and are verified word by
       word over the window.
    Documents are read through a bitmap of bounded size; what passes it is joined exactly. Tokens with very many hits are
    salted by the counts of step 1.
    """
    texts = _texts(docs, id_col, text_col)
    windows = written(item_windows(benchmark, window, shingle, item_col, item_text))
    distinct = windows.dropDuplicates(["words"]).select("words", "n", "tokens")
    tokens = written(distinct.select(F.explode("tokens").alias("token")).distinct())
    sizes = [r["size"] for r in windows.select(F.least("n", F.lit(shingle)).alias("size")).distinct().orderBy("size").collect()]
    counts = written(token_counts(texts, tokens, sizes))

    # rare first; a shingle that occurs nowhere rules its window out
    order = F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token", "offset")
    placed = distinct.select("words", "n", F.posexplode("tokens").alias("offset", "token"))
    rarest = placed.join(counts, "token", "left").groupBy("words", "n").agg(F.min(order).alias("rarest"))
    prefix = written(rarest.where("rarest.df > 0").select("words", "n", "rarest.*"))

    found = document_hits(texts, prefix.select("token").distinct(), sizes, window)
    rows = written(found.withColumn("row", F.monotonically_increasing_id()))
    hits = rows.select("row", "n_words", F.explode("hits").alias("hit")).select("row", "n_words", "hit.*")
    # at most MOST_HOT tokens are salted, so their list may be sent to all tasks
    total = prefix.select("token", "df").distinct().agg(F.sum("df")).first()[0] or 0
    many = max(hot_hits, total // MOST_HOT)
    salts = prefix.select("token", "df").distinct().where(F.col("df") > many).select(
        "token", F.ceil(F.col("df") / many).cast("int").alias("salts"))
    hits = hits.join(F.broadcast(salts), "token", "left").withColumn(
        "salt", F.pmod(F.xxhash64("row", "start"), F.coalesce("salts", F.lit(1)))).drop("salts")
    prefix = prefix.join(F.broadcast(salts), "token", "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("salts", F.lit(1)).cast("bigint") - 1))).drop("salts")
    start = F.col("start") - F.col("offset")
    place = F.col("left") - F.col("offset") + 1
    near = hits.join(prefix, ["token", "salt"]).where((start >= 0) & (start + F.col("n") <= F.col("n_words")))
    around = F.split(F.col("around").cast("string"), " ")
    same = F.array_join(F.slice(around, place, F.col("n")), " ") == F.col("words").cast("string")
    exact = written(near.where(same).select("row", start.alias("start"), "n", "words"))

    # covered words: the longest window from each start, cut where an earlier one reaches
    longest = exact.groupBy("row", "start").agg((F.col("start") + F.max("n")).alias("end"))
    before = F.max("end").over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    opened = longest.withColumn("before", before)
    island = F.sum(F.when(F.col("before") >= F.col("start"), 0).otherwise(1)).over(
        Window.partitionBy("row").orderBy("start"))
    spans = (opened.withColumn("island", island).groupBy("row", "island")
             .agg(F.min("start").alias("start"), F.max("end").alias("end"))
             .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")))
    items = (exact.select("row", "words").distinct().join(windows.select("words", "item").distinct(), "words")
             .groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return (rows.select("row", "id", "n_words").join(spans, "row", "left").join(items, "row", "left")
            .select(F.col("id").alias(id_col), "n_words", F.coalesce("spans", none).alias("spans"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def covered(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, {_SPLIT} AS w FROM benchmark),
windows AS (
  SELECT item_id, least({WINDOW}, len(w)) AS n, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS s,
         array_to_string(w[s:s + n - 1], ' ') AS words FROM b WHERE len(w) > 0),
places AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, array_to_string(w[s:s + n - 1], ' ') AS words
  FROM d, (SELECT DISTINCT n FROM windows)),
hits AS (SELECT doc_id, places.s, n, item_id FROM places JOIN windows USING (n, words)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op11_decontaminate", SQL)
def op11_decontaminate(spark, sf_dir):
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", covered(F.col("spans")).alias("n_hit"),
                        F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"))
