"""Readers. Schemas are declared, never inferred, and ids are always strings."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from versionlake.functions.seeded import seeded_hash
from versionlake.operators.ids import require_columns
from versionlake.operators.numbering import number_rows
from versionlake.operators.splits import shuffle_batches
from versionlake.operators.vectors import mean_pool

EMBEDDING_SCHEMA = "id string, chunk_id int, embedding array<float>"
LINE_SCHEMA = "map<string,string>"
CORRUPT = "_corrupt_record"


def read_metadata(spark: SparkSession, path: str, columns: dict[str, str], required: list[str] | None = None,
                  id_columns: tuple = ("version_id", "md5_encoded", "clique_id")) -> DataFrame:
    """CSV with a header, quoted multi-line cells allowed. `columns` maps name to type in file order; id
    columns are read as strings whatever it says. NaN in a double column becomes NULL."""
    fields = ", ".join(f"`{n}` {'string' if n in id_columns else t}" for n, t in columns.items())
    df = (spark.read.schema(fields).option("header", True).option("multiLine", True).option("escape", '"')
          .option("nanValue", "NaN").csv(path))
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    df = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles}) if doubles else df
    return require_columns(df, required or [])


def read_lenient_csv(spark: SparkSession, path: str, columns: dict[str, str],
                     keep_bad: bool = False) -> DataFrame:
    """CSV whose lines with too many fields are skipped, or kept with the raw line in `_corrupt_record`.

    Short lines and values of another type stay, with NULL for what is missing; so the rows don't depend on the columns
    that are read.
    """
    fields = ", ".join(f"`{n}` {t}" for n, t in columns.items())
    rows = (spark.read.option("header", True).schema(f"{fields}, {CORRUPT} string").option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).csv(path))
    if keep_bad:
        return rows
    separators = F.length(F.regexp_replace(F.regexp_replace(CORRUPT, r'"(?:[^"\\]|\\.|"")*"', ""), "[^,]", ""))
    # Spark reads no CSV for the raw line alone, so the test also looks at a column, whose length does not count
    first = F.length(F.coalesce(F.col(f"`{next(iter(columns))}`").cast("string"), F.lit("")))
    return rows.where(F.col(CORRUPT).isNull() | (separators + F.least(F.lit(0), first) < len(columns))).drop(CORRUPT)


def read_embeddings(spark: SparkSession, path: str, single: bool = False) -> DataFrame:
    """id, chunk_id, embedding from Parquet; `single` gives one mean vector an id."""
    df = spark.read.schema(EMBEDDING_SCHEMA).parquet(path)
    return mean_pool(df, "id") if single else df


def import_npz(spark: SparkSession, path: str) -> DataFrame:
    """One-off import of `.npz` archives (id -> (d,) or (n, d)); one file is decoded by one task."""
    def decode(batches):
        for files in batches:
            for content in files["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as archive:
                    for name in archive.files:
                        rows = np.atleast_2d(archive[name]).astype(np.float32)
                        yield pd.DataFrame({"id": name, "chunk_id": np.arange(len(rows), dtype=np.int32),
                                            "embedding": list(rows)})
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, EMBEDDING_SCHEMA)


#: A quoted string, or what stands between strings.
LITERAL_PIECE = r"""'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^'"]+"""


def parse_literal(cell: Column, schema: str) -> Column:
    """A Python list literal of tuples, lists, dicts or strings as `schema`; NULL if it does not parse.

    Tuples of a struct schema are read as JSON arrays and turned into the struct by position.
    """
    def as_json(piece: Column) -> Column:
        first = F.substring(piece, 1, 1)
        inner = F.regexp_replace(F.substring(piece, F.lit(2), F.length(piece) - 2), "\\\\'", "'")
        # a double quote inside single quotes stands bare or escaped
        inner = F.when(first == "'", F.regexp_replace(inner, '\\\\?"', '\\\\\\"')).otherwise(inner)
        inner = F.regexp_replace(inner, "\\\\x([0-9a-fA-F]{2})", "\\\\u00$1")
        other = F.translate(piece, "()", "[]")
        for python, json in (("True", "true"), ("False", "false"), ("None", "null")):
            other = F.regexp_replace(other, f"\\b{python}\\b", json)
        other = F.regexp_replace(other, ",\\s*([\\]}])", "$1")
        return F.when(first.isin("'", '"'), F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(other)

    # strings are pieces of their own, so that marks inside them stay
    pieces = F.regexp_extract_all(cell, F.lit(LITERAL_PIECE), F.lit(0))
    text = F.array_join(F.transform(pieces, as_json), "")
    return F.from_json(text, schema)


def parse_pairs(cell: Column) -> Column:
    """`[(a, b), ...]` as ARRAY<STRUCT<start, end>>."""
    return F.transform(parse_literal(cell, "array<array<double>>"),
                       lambda p: F.struct(p[0].alias("start"), p[1].alias("end")))


def parse_segments(cell: Column) -> Column:
    """`[{'start': ..., 'end': ..., 'vocalness': ...}, ...]` as an array of structs."""
    return parse_literal(cell, "array<struct<start:double,end:double,vocalness:double>>")


def unparsed_count(df: DataFrame, raw: str, parsed: str) -> DataFrame:
    """One row: how many non-null cells did not parse."""
    return df.agg(F.count(F.when(F.col(raw).isNotNull() & F.col(parsed).isNull(), 1)).alias("unparsed"))


def line_fields(line: Column) -> Column:
    """A line as MAP<STRING,STRING>: JSON when it starts with a brace, else tab-separated key:value; a value
    keeps its own colons."""
    plain = F.map_from_entries(F.transform(
        F.filter(F.split(line, "\t"), lambda p: p.contains(":")),
        lambda p: F.struct(F.substring_index(p, ":", 1).alias("k"),
                           F.substring(p, F.locate(":", p) + 1, F.length(p)).alias("v"))))
    return F.when(F.ltrim(line).startswith("{"), F.from_json(line, LINE_SCHEMA)).otherwise(plain)


def read_lines(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Line dataset as a typed table; blank lines are dropped, absent keys are NULL."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(line_fields(F.trim("value")).alias("f"))
    return parsed.select(*[F.try_element_at("f", F.lit(n)).cast(t).alias(n) for n, t in columns.items()])


def read_manifest(spark: SparkSession, path: str, extension: str = "mp3") -> DataFrame:
    """Files of a tree with an extension: path, length, modificationTime, name (stem). Contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", f"*.{extension}").load(path).select("path", "length", "modificationTime"))
    name = F.regexp_replace(F.substring_index("path", "/", -1), f"\\.{extension}$", "")
    return files.withColumn("name", name)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Pair table query_id, corpus_id."""
    return spark.read.schema("query_id string, corpus_id string").option("header", True).csv(path)


def positives_by_query(truth: DataFrame) -> DataFrame:
    return truth.groupBy("query_id").agg(F.sort_array(F.collect_set("corpus_id")).alias("positives"))


def read_ids(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("string").alias("id"))


def read_plain(spark: SparkSession, path: str, kind: str, schema: str | None = None, skip_header: bool = False,
               limit: int | None = None) -> DataFrame:
    """Plain text lines, CSV, JSON documents or JSON lines."""
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "txt":
        df = spark.read.text(path)
    elif kind == "csv":
        df = reader.option("header", skip_header).csv(path)
    elif kind == "json":
        df = reader.option("multiLine", True).json(path)
    elif kind == "jsons":
        df = reader.json(path)
    else:
        raise ValueError(f"unknown kind: {kind}")
    return df.limit(limit) if limit is not None else df


def read_shards(spark: SparkSession, path: str, last_shard: int | None = None, key: str = "uid",
                batch_size: int | None = None, seed: int | None = None) -> DataFrame:
    """Training shards 0..last_shard (partition pruning), optionally in seeded order with batch ids."""
    df = spark.read.parquet(path)
    if last_shard is not None:
        df = df.where(F.col("shard_id") <= last_shard)
    if batch_size is not None:
        return shuffle_batches(df, key, batch_size, seed if seed is not None else 42)
    if seed is not None:
        return df.orderBy(seeded_hash(seed, key))
    return df


def batch_slice(df: DataFrame, order: list[str], batch: int, size: int = 10_000) -> DataFrame:
    """Rows batch * size .. (batch + 1) * size - 1 of the table in the given order."""
    numbered = number_rows(df, order, "_no")
    return numbered.where((F.col("_no") > batch * size) & (F.col("_no") <= (batch + 1) * size)).drop("_no")
