"""Table flows from detections and transcripts to training chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from versionlake.functions import text as X
from versionlake.operators import ids, segments, transcripts


def training_chunks(metadata: DataFrame, transcript_table: DataFrame, vocal_table: DataFrame,
                    pad_mode: str = "half") -> DataFrame:
    """One row a chunk with its text: version_id, clique_id, md5_encoded, chunk_id, start, end, duration,
    vocalness, transcription, and deezer_id where the metadata has it. Without a vocalness in `vocal_table` it is NULL.

    `vocal_table` holds segments ARRAY<STRUCT<start, end, ..>> and the recording's vocalness; the transcript
    is the joined text, cut at blank lines and aligned with the chunks.
    """
    ids.require_columns(metadata, ["version_id", "clique_id", "md5_encoded"])
    joined = ids.merge_sources(metadata, ids.normalize_transcripts(transcript_table),
                               ids.normalize_vocals(vocal_table))
    spans = joined.select("version_id", F.explode("segments").alias("s")).select("version_id", "s.start", "s.end")
    chunks = segments.pad_merge_slice(spans, "version_id", pad_mode=pad_mode)
    pieces = joined.select("version_id", X.split_pieces(F.col("transcription_vocal")).alias("pieces"))
    aligned = segments.align_pieces(chunks, pieces, "version_id")
    names = ["version_id", "clique_id", "md5_encoded", *[c for c in ("deezer_id",) if c in metadata.columns], "vocalness"]
    return aligned.join(joined.select(*names), "version_id")


def transcribed_tracks(chunks: DataFrame, tracks: DataFrame, done: DataFrame | None = None,
                       phrases: list[str] | None = None) -> DataFrame:
    """Raw chunk texts to one transcript row a track (version_id, md5_encoded, texts, mask, joined), for the
    tracks that are not in `done` yet."""
    todo = tracks if done is None else ids.pending(tracks, done)
    texts = chunks.join(todo.select("md5_encoded"), "md5_encoded", "left_semi")
    cleaned = transcripts.clean_chunks(texts, "text", phrases)
    out = transcripts.regroup_text(cleaned, "md5_encoded", "chunk_id", tracks=todo)
    return todo.select("version_id", "md5_encoded").join(out, "md5_encoded")
