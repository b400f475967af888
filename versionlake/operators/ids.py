"""Ids, names, column choices and small set operations on recording tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from versionlake.operators.numbering import first_per_key, number_rows
from versionlake.operators.ranking import restrict_to

# Column names that mean the same, name of a speed variant, length limit of a track.
TRANSCRIPT_ALIASES = {"transcription": "transcription_vocal"}
VOCAL_ALIASES = {"vocalness_score": "vocalness", "vocal_segments": "segments", "chunks_sec": "segments"}
SPEED_VARIANT = r"^sp_[0-9.]+-.+"
MAX_TRACK_SECONDS = 240.0
LINE_COLUMNS = ["perf", "work", "work_id", "version_id", "dur_s"]


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


# ---------------------------------------------------------------- names and ids

def md5_from_file(file: Column) -> Column:
    """File name up to the first dot."""
    return F.substring_index(file, ".", 1)


def _rename(df: DataFrame, aliases: dict) -> DataFrame:
    for old, new in aliases.items():
        if new not in df.columns and old in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def with_md5(df: DataFrame) -> DataFrame:
    """Make sure of `md5_encoded`, from the file name if need be."""
    if "md5_encoded" in df.columns:
        return df
    if "file" not in df.columns:
        raise ValueError("neither md5_encoded nor file is present")
    return df.withColumn("md5_encoded", md5_from_file(F.col("file")))


def normalize_transcripts(df: DataFrame) -> DataFrame:
    return require_columns(_rename(with_md5(df), TRANSCRIPT_ALIASES), ["transcription_vocal"]).select(
        "md5_encoded", "transcription_vocal")


def normalize_vocals(df: DataFrame) -> DataFrame:
    """md5_encoded, segments, vocalness; a table without vocalness gets NULL there."""
    named = require_columns(_rename(with_md5(df), VOCAL_ALIASES), ["segments"])
    vocalness = F.col("vocalness") if "vocalness" in named.columns else F.lit(None).cast("double").alias("vocalness")
    return named.select("md5_encoded", "segments", vocalness)


def chunk_uid(version_id: Column, chunk_id: Column, only_prefixed: bool = False) -> Column:
    """version_id without `V-` and `_`, then the chunk number. `only_prefixed` leaves ids without `V-` alone."""
    bare = F.regexp_replace(version_id, "V-|_", "")
    if only_prefixed:
        bare = F.when(version_id.contains("V-"), bare).otherwise(version_id)
    return F.concat(bare, chunk_id.cast("string"))


def fan_out_path(uid: Column) -> Column:
    return F.concat_ws("/", F.substring(uid, 1, 3), uid)


def split_uid(df: DataFrame, uid: str = "uid") -> DataFrame:
    """Back to (version_id, chunk_id); the chunk is the last character, so chunks from 10 on are ambiguous."""
    return df.withColumns({"version_id": F.expr(f"left({uid}, length({uid}) - 1)"),
                           "chunk_id": F.expr(f"right({uid}, 1)")})


def rename_keys(embeddings: DataFrame, metadata: DataFrame, old: str = "md5_encoded",
                new: str = "version_id") -> DataFrame:
    """Embeddings keyed by `new` instead of `old`; unknown keys are dropped."""
    return embeddings.join(metadata.select(old, new).distinct(), old).drop(old)


def audio_path(df: DataFrame, root: str, suffix: str = ".mp3") -> DataFrame:
    name = F.coalesce("md5_encoded", "version_id") if "md5_encoded" in df.columns else F.col("version_id")
    return df.withColumn("path", F.concat(F.lit(root.rstrip("/") + "/"), name, F.lit(suffix)))


# ---------------------------------------------------------------- filters and projections

def exact_duration(df: DataFrame, duration: float = 30.0, tolerance: float = 0.0) -> DataFrame:
    length = F.col("end") - F.col("start")
    return df.where(length == duration) if tolerance == 0 else df.where(F.abs(length - duration) <= tolerance)


def filter_truth(truth: DataFrame, valid: DataFrame, valid_column: str = "id") -> DataFrame:
    """Truth pairs whose query and corpus ids both have embeddings."""
    kept = restrict_to(truth, valid, "query_id", valid_column)
    return restrict_to(kept, valid, "corpus_id", valid_column)


def vocal_only(df: DataFrame) -> DataFrame:
    return df.where("is_vocal")


def drop_speed_variants(df: DataFrame, column: str = "perf") -> DataFrame:
    return df.where(~F.col(column).rlike(SPEED_VARIANT))


def clean_lines(df: DataFrame) -> DataFrame:
    """Known columns only; feature columns where a feature file exists, the raw file otherwise."""
    base = [c for c in LINE_COLUMNS if c in df.columns]
    has_feature = F.col("feat").isNotNull() if "feat" in df.columns else F.lit(False)
    extra = [F.when(has_feature, F.col(c)).alias(c) for c in ("feat", "feat_len") if c in df.columns]
    raw = [F.when(~has_feature, F.col("wav")).alias("wav")] if "wav" in df.columns else []
    return df.select(*base, *extra, *raw)


def truncate_duration(duration: Column, limit: float = MAX_TRACK_SECONDS) -> Column:
    return F.least(duration, F.lit(limit))


def in_batches(df: DataFrame, batch_ids: list, column: str = "batch", key: str = "md5_encoded") -> DataFrame:
    """Recordings of the given batches, one row each (the smallest by all other columns)."""
    rest = [c for c in df.columns if c != key]
    return first_per_key(df.where(F.col(column).isin(batch_ids)), [key], rest)


# ---------------------------------------------------------------- joins and sets

def merge_sources(metadata: DataFrame, transcripts: DataFrame, vocals: DataFrame, order: list[str] | None = None,
                  key: str = "md5_encoded") -> DataFrame:
    """Metadata with transcript and segments, one row a version_id, both present."""
    joined = (metadata.join(transcripts, key, "left").join(vocals, key, "left"))
    first = first_per_key(joined, ["version_id"], order or [key])
    return first.where(F.col("transcription_vocal").isNotNull() & F.col("segments").isNotNull())


def attach_texts(errors: DataFrame, metadata: DataFrame, columns: list[str], id_col: str = "version_id",
                 roles: dict | None = None) -> DataFrame:
    """Columns of the metadata for each role of an error row, prefixed with the role (left joins)."""
    for role, column in (roles or {"q": "query_id", "fp": "fp_id", "fn": "fn_id"}).items():
        side = metadata.select(F.col(id_col).alias(column), *[F.col(c).alias(f"{role}_{c}") for c in columns])
        errors = errors.join(side, column, "left")
    return errors


def overlap_map(queries: DataFrame, references: DataFrame, key: str = "perf", position: str = "position") -> DataFrame:
    """Positions of performances that are in both sets: query_pos, ref_pos."""
    return (queries.select(key, F.col(position).alias("query_pos"))
            .join(references.select(key, F.col(position).alias("ref_pos")), key)
            .select("query_pos", "ref_pos"))


def pending(df: DataFrame, done: DataFrame, key: str = "md5_encoded") -> DataFrame:
    """Rows whose key is not in the output yet."""
    return df.join(done.select(key), key, "left_anti")


def candidates_in_corpus(ranked: DataFrame, corpus: DataFrame, corpus_column: str = "id") -> DataFrame:
    return restrict_to(ranked, corpus, "corpus_id", corpus_column)


def with_files(metadata: DataFrame, manifest: DataFrame, key: str = "md5_encoded") -> tuple[DataFrame, DataFrame]:
    """(rows whose file exists, with its path and size; rows without a file)."""
    files = manifest.select(F.col("name").alias(key), "path", "length")
    return metadata.join(files, key), metadata.join(files.select(key), key, "left_anti")


def tag_union(parts: dict[str, DataFrame], column: str = "type") -> DataFrame:
    """Stack tables, each tagged with its name; missing columns become NULL."""
    frames = [df.withColumn(column, F.lit(tag)) for tag, df in parts.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def clique_overlap(a: DataFrame, b: DataFrame, clique: str = "clique_id") -> DataFrame:
    """Cliques present in both splits."""
    return a.select(clique).intersect(b.select(clique))


# ---------------------------------------------------------------- works, cliques, labels

def add_work_ids(df: DataFrame, position: str, work: str = "work") -> tuple[DataFrame, DataFrame]:
    """Dense work ids in order of first appearance: (rows with work_id, map work_id -> work)."""
    firsts = df.groupBy(work).agg(F.min(position).alias("_first"))
    ids = number_rows(firsts, ["_first", work], "_no").select(work, (F.col("_no") - 1).cast("int").alias("work_id"))
    return df.join(ids, work), ids.select("work_id", work)


def dedupe_perfs(df: DataFrame, order: list[str], key: str = "perf") -> DataFrame:
    """One row a performance (first in the given order), sorted by performance."""
    return first_per_key(df, [key], order).orderBy(key)


def small_cliques(df: DataFrame, clique: str = "clique_id", minimum: int = 2) -> DataFrame:
    return df.groupBy(clique).agg(F.count("*").alias("n")).where(F.col("n") < minimum)


def clique_ids(splits: dict[str, DataFrame], clique: str = "clique_id", limit: int | None = None) -> DataFrame:
    """Dense id of every clique of every split, counted on from split to split: split, clique, dense_id, n."""
    out, offset = None, 0
    for name, df in splits.items():
        sizes = df.groupBy(clique).agg(F.count("*").alias("n"))
        if limit is not None:
            sizes = sizes.orderBy(clique).limit(limit)
        numbered = number_rows(sizes, [clique], "_no")
        part = numbered.select(F.lit(name).alias("split"), clique,
                               (F.col("_no") - 1 + offset).alias("dense_id"), "n")
        offset += sizes.count()
        out = part if out is None else out.unionByName(part)
    return out


def speed_variants(df: DataFrame, speeds: list[float], perf: str = "perf", duration: str = "dur_s") -> DataFrame:
    """One row a speed: duration divided by it (2 digits), perf named after it; 0.99 to 1.01 is unchanged."""
    speed = F.col("speed")
    same = (speed > 0.99) & (speed < 1.01)
    spread = df.withColumn("speed", F.explode(F.array(*[F.lit(float(s)) for s in speeds])))
    return spread.withColumns({
        duration: F.when(same, F.col(duration)).otherwise(F.round(F.col(duration) / speed, 2)),
        perf: F.when(same, F.col(perf)).otherwise(
            F.concat(F.lit("sp_"), speed.cast("string"), F.lit("-"), F.col(perf)))})


def inconsistent_labels(df: DataFrame, key: str = "perf", label: str = "work_id") -> DataFrame:
    """Recordings with more than one label, by the smallest and largest label seen."""
    return (df.groupBy(key).agg(F.min(label).alias("low"), F.max(label).alias("high"))
            .where(F.col("low") != F.col("high")))
