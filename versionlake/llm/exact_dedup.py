"""Exact deduplication by salted, skew-safe combining; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import query, table, text_of, written

#: Salts of a hot digest. A digest is hot from a share of all rows on, and in large tables from HOT_ROWS rows on, so that
#: no more come to one task; HOT_MOST bounds the list of hot digests, which is broadcast.
SALTS = 64
HOT_SHARE = 0.001
HOT_ROWS = 100_000
HOT_MOST = 200_000


def hot_bar(total: int, share: float = HOT_SHARE) -> float:
    """Rows above which a digest is hot. At most the larger of 1 / `share` and HOT_MOST digests are above it."""
    return max(1.0, min(total * share, max(HOT_ROWS, total / HOT_MOST)))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS,
                 hot_share: float = HOT_SHARE) -> DataFrame:
    """For every row, the row that stays of all rows with an equal text.

    Texts are equal when identical after deleting ASCII white space; null counts as empty. Of equal texts the row with
    the most code points stays, then the smallest id (a null id comes before others). Returns one row per input row:
    id, keep_id, group_size, kept, text_sha256. Rows that repeat id and text share their group; each is kept if its id
    is keep_id. Empty input gives no rows; other input columns are ignored.

    Rows are combined inside each task first, then by digest and salt, then the winners of the salts of hot digests are
    combined; the normalised text is part of the key each time, so a digest alone never makes two texts equal. A text
    is shuffled once. Only digests with more than one content (a collision) need the text again when rows are matched
    with their winners.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(docs, text_col).alias("text")).select(
        "id", F.length("text").alias("size"), F.regexp_replace("text", r"[\x20\x09-\x0D]+", "").alias("norm"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    digests = written(rows.select("id", "digest"))
    counted = digests.groupBy("digest").count()
    total = digests.count()
    hot = written(counted.where(F.col("count") > F.lit(hot_bar(total, hot_share))).select(
        "digest", F.lit(True).alias("hot")))

    def salted(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(hot), "digest", "left").withColumn(
            "salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(salts))).otherwise(F.lit(-1)))

    # longest text first, then smallest id; the local combine is the partial aggregate before the shuffle
    best = F.min(F.struct((-F.col("size")).alias("size"), F.col("id"))).alias("best")
    winners = salted(rows).groupBy("digest", "salt", "norm").agg(best, F.count("*").alias("n"))
    winners = written(winners)
    merged = (winners.where("salt >= 0").groupBy("digest", "norm")
              .agg(F.min("best").alias("best"), F.sum("n").alias("n")))
    final = (winners.where("salt < 0").select("digest", "norm", "best", "n")
             .unionByName(merged).select("digest", "norm", F.col("best.id").alias("keep_id"), F.col("n")))
    # contents per digest: more than one only where two texts collide
    single = final.groupBy("digest").agg(F.count("*").alias("contents"), F.min("keep_id").alias("keep_id"),
                                         F.sum("n").alias("n"))
    lists = single.join(F.broadcast(hot), "digest", "left").withColumn(
        "salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(-1)))))
    placed = salted(digests).select("id", "digest", F.col("salt").cast("int").alias("salt"))
    plain = placed.join(lists.where("contents = 1").select("digest", "salt", "keep_id", "n"), ["digest", "salt"])
    collided = single.where("contents > 1").select("digest")
    exact = (rows.join(collided, "digest", "left_semi").select("id", "digest", "norm")
             .join(final, ["digest", "norm"]).select("id", "digest", "keep_id", "n")) \
        if not collided.isEmpty() else None
    out = plain.select("id", "digest", "keep_id", "n")
    if exact is not None:
        out = out.unionByName(exact)
    return out.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"),
                      F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS size,
                  sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256 FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""


@query("op2_exact_dedup", SQL)
def op2_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))
