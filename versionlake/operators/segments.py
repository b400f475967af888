"""Time segments of recordings: classify, merge, pad, slice, and plan sample cuts.

A segment table has one row a segment: a key column (default `md5_encoded`), `start` and `end` in seconds,
and `vocalness` where a model scored it. Merging walks a recording in time order, so one recording with a
huge share of all rows would be one task's work; the timeline is therefore cut in spans of `SPAN` seconds,
each span is scanned by itself, and only one summary row a span is carried along the recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

VOCAL_THRESHOLD = 0.5
CHUNK_SECONDS = 30.0
MAX_PAD_SECONDS = 10.0
INSTRUMENTAL_MEAN = 0.2
SPAN = 3600.0


# ---------------------------------------------------------------- islands

def mark_islands(df: DataFrame, key: str, touching: bool, span: float = SPAN) -> DataFrame:
    """Add `island` (start of the first member) and `span_no` to rows with key, start, end.

    `touching`: a row continues the island only if it starts exactly at the end of the row before it.
    Otherwise it continues while its start is not after the largest end so far (overlap or touch).
    """
    rows = df.withColumn("span_no", F.floor(F.col("start") / span))
    inside = Window.partitionBy(key, "span_no").orderBy("start", "end")
    if touching:
        rows = rows.withColumn("_prev", F.lag("end").over(inside))
        last_end = F.max_by("end", F.struct("start", "end"))
        opens = F.col("start") != F.col("_prev")
    else:
        rows = rows.withColumn(
            "_prev", F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
        last_end = F.max("end")
        opens = F.col("start") > F.col("_prev")
    # the first row of a span has no _prev: whether it opens an island depends on the earlier spans
    rows = rows.withColumn("_opens", F.when(F.col("_prev").isNotNull() & opens, F.col("start")))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_local", F.last("_opens", ignorenulls=True).over(upto))

    spans = rows.groupBy(key, "span_no").agg(
        F.min("start").alias("_first"), last_end.alias("_last_end"), F.max("_opens").alias("_last_open"))
    along = Window.partitionBy(key).orderBy("span_no")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    if touching:
        carried, breaks = F.lag("_last_end").over(along), F.col("_first") != F.col("_carried")
    else:
        carried, breaks = F.max("_last_end").over(before), F.col("_first") > F.col("_carried")
    spans = spans.withColumn("_carried", carried)
    spans = spans.withColumn("_fresh", F.col("_carried").isNull() | breaks)
    newest = F.coalesce("_last_open", F.when(F.col("_fresh"), F.col("_first")))
    spans = spans.withColumn("_newest", newest)
    spans = spans.select(key, "span_no", F.when(F.col("_fresh"), F.col("_first")).otherwise(
        F.last("_newest", ignorenulls=True).over(before)).alias("_entry"))
    return (rows.join(spans, [key, "span_no"])
            .withColumn("island", F.coalesce("_local", "_entry"))
            .drop("_prev", "_opens", "_local", "_entry"))


def merge_vocal(segments: DataFrame, key: str = "md5_encoded", threshold: float = VOCAL_THRESHOLD,
                span: float = SPAN) -> DataFrame:
    """Merge exactly touching vocal segments: key, start, end, vocalness.

    The vocalness of a merged segment is folded pairwise in time order, (previous + next) / 2. A run of n
    values maps an incoming value p to p / 2**n + c, so each span folds its own part to (n, c, value if the
    run starts here) and the parts of an island are folded again.
    """
    vocal = segments.where(F.col("vocalness") > threshold).select(key, "start", "end", "vocalness")
    marked = mark_islands(vocal, key, touching=True, span=span)
    values = F.transform(F.sort_array(F.collect_list(F.struct("start", "end", "vocalness"))),
                         lambda s: s["vocalness"])
    parts = (marked.groupBy(key, "span_no", "island")
             .agg(F.min("start").alias("start"), F.max("end").alias("end"), values.alias("v"))
             .withColumn("shift", F.aggregate("v", F.lit(0.0), lambda acc, x: (acc + x) / 2))
             .withColumn("scale", F.pow(F.lit(0.5), F.size("v")))
             .withColumn("fresh", F.aggregate(F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(1))),
                                              F.element_at("v", 1), lambda acc, x: (acc + x) / 2)))
    folded = F.aggregate(
        F.sort_array(F.collect_list(F.struct("span_no", "fresh", "scale", "shift"))),
        F.lit(None).cast("double"),
        lambda acc, p: F.when(acc.isNull(), p["fresh"]).otherwise(acc * p["scale"] + p["shift"]))
    return (parts.groupBy(key, "island")
            .agg(F.min("start").alias("start"), F.max("end").alias("end"), folded.alias("vocalness"))
            .drop("island"))


def accept_tracks(segments: DataFrame, key: str = "md5_encoded", threshold: float = VOCAL_THRESHOLD,
                  recordings: DataFrame | None = None) -> DataFrame:
    """key, vocalness_score (mean over all segments, 0.0 without any), is_vocal (score >= threshold)."""
    means = segments.groupBy(key).agg(F.avg("vocalness").alias("vocalness_score"))
    if recordings is not None:
        means = recordings.select(key).distinct().join(means, key, "left")
    score = F.coalesce(F.col("vocalness_score"), F.lit(0.0))
    return means.select(key, score.alias("vocalness_score"), (score >= threshold).alias("is_vocal"))


def instrumental_flags(segments: DataFrame, key: str = "md5_encoded", threshold: float = VOCAL_THRESHOLD,
                       mean_threshold: float = INSTRUMENTAL_MEAN) -> DataFrame:
    """all_instrumental (no vocal segment), is_instrumental (mean below the limit), share of such segments."""
    quiet = F.col("vocalness") <= threshold
    return segments.groupBy(key).agg(
        F.bool_and(quiet).alias("all_instrumental"),
        (F.avg("vocalness") < mean_threshold).alias("is_instrumental"),
        F.avg(quiet.cast("double")).alias("per_instrumental_segments"))


# ---------------------------------------------------------------- pad, merge, slice

def pad_segments(segments: DataFrame, chunk: float = CHUNK_SECONDS, max_pad: float = MAX_PAD_SECONDS,
                 pad_mode: str = "full") -> DataFrame:
    """Grow short segments on both sides towards `chunk` seconds, by at most `max_pad` a side (`full`) or
    `max_pad / 2` a side (`half`). The left edge stops at 0; longer segments stay."""
    if pad_mode not in ("full", "half"):
        raise ValueError(f"unknown pad mode: {pad_mode}")
    limit = max_pad if pad_mode == "full" else max_pad / 2
    missing = chunk - (F.col("end") - F.col("start"))
    pad = F.when(missing > 0, F.least(F.lit(limit), missing / 2)).otherwise(F.lit(0.0))
    start, end = F.greatest(F.lit(0.0), F.col("start") - pad), F.col("end") + pad
    return segments.withColumns({"start": start, "end": end})


def merge_windows(windows: DataFrame, key: str = "md5_encoded", span: float = SPAN) -> DataFrame:
    """Merge overlapping or touching windows of a recording: key, start, end."""
    marked = mark_islands(windows.select(key, "start", "end"), key, touching=False, span=span)
    return (marked.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
            .drop("island"))


def slice_windows(windows: DataFrame, chunk: float = CHUNK_SECONDS) -> DataFrame:
    """Cut every window in pieces of exactly `chunk` seconds; a rest longer than zero is kept."""
    length = F.col("end") - F.col("start")
    pieces = F.ceil(length / chunk).cast("int")
    left = F.col("start") + F.col("_i") * chunk
    return (windows.where(length > 0)
            .withColumn("_i", F.explode(F.sequence(F.lit(0), pieces - 1)))
            .withColumns({"start": left, "end": F.least(F.col("end"), left + chunk)})
            .where(F.col("end") > F.col("start")).drop("_i"))


def pad_merge_slice(segments: DataFrame, key: str = "md5_encoded", chunk: float = CHUNK_SECONDS,
                    max_pad: float = MAX_PAD_SECONDS, pad_mode: str = "full") -> DataFrame:
    """Segments to non-overlapping chunks of at most `chunk` seconds: key, start, end."""
    return slice_windows(merge_windows(pad_segments(segments, chunk, max_pad, pad_mode), key), chunk)


def detect_only(segments: DataFrame, key: str = "md5_encoded", threshold: float = VOCAL_THRESHOLD,
                recordings: DataFrame | None = None) -> DataFrame:
    """Per recording: is_vocal, vocalness_score, res_detection (merged segments in time order)."""
    merged = merge_vocal(segments, key, threshold).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "vocalness"))).alias("res_detection"))
    empty = F.array().cast("array<struct<start:double,end:double,vocalness:double>>")
    return (accept_tracks(segments, key, threshold, recordings).join(merged, key, "left")
            .withColumn("res_detection", F.coalesce("res_detection", empty)))


def detection_record(segments: DataFrame, recordings: DataFrame, key: str = "md5_encoded",
                     threshold: float = VOCAL_THRESHOLD, pad_mode: str = "full") -> DataFrame:
    """One row a recording: version_id ('' if absent), key, is_vocal, vocalness_score, res_detection,
    chunks_sec. A rejected recording keeps its segments and has no chunks."""
    version = F.coalesce(F.col("version_id").cast("string"), F.lit("")) if "version_id" in recordings.columns \
        else F.lit("")
    names = recordings.select(key, version.alias("version_id")).dropDuplicates([key])
    verdict = accept_tracks(segments, key, threshold, recordings)
    merged = merge_vocal(segments, key, threshold)
    listed = merged.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "vocalness"))).alias("res_detection"))
    accepted = merged.join(verdict.where("is_vocal").select(key), key, "left_semi")
    chunks = (pad_merge_slice(accepted.select(key, "start", "end"), key, pad_mode=pad_mode).groupBy(key)
              .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("chunks_sec")))
    no_segments = F.array().cast("array<struct<start:double,end:double,vocalness:double>>")
    no_chunks = F.array().cast("array<struct<start:double,end:double>>")
    return (names.join(verdict, key).join(listed, key, "left").join(chunks, key, "left")
            .select("version_id", key, "is_vocal", "vocalness_score",
                    F.coalesce("res_detection", no_segments).alias("res_detection"),
                    F.coalesce("chunks_sec", no_chunks).alias("chunks_sec")))


def count_columns(records: DataFrame) -> DataFrame:
    return records.withColumns({"nb_vocal_segments": F.size("res_detection"),
                                "nb_audio_chunks": F.size("chunks_sec")})


# ---------------------------------------------------------------- grids and sample plans

def fixed_grid(recordings: DataFrame, duration: str = "duration", chunk: float = CHUNK_SECONDS) -> DataFrame:
    """Chunks 0..n-1 of `chunk` seconds over each recording; `pad` says how much the last one lacks."""
    pieces = F.ceil(F.col(duration) / chunk).cast("int")
    start = F.col("chunk_id") * F.lit(chunk)
    return (recordings.where(F.col(duration) > 0)
            .withColumn("chunk_id", F.explode(F.sequence(F.lit(0), pieces - 1)))
            .withColumns({"start": start, "end": F.least(F.col(duration), start + chunk)})
            .withColumn("pad", F.lit(chunk) - (F.col("end") - F.col("start"))))


def sample_plan(chunks: DataFrame, sample_rate: int, target: float = CHUNK_SECONDS,
                rounding: str = "round") -> DataFrame:
    """Sample indexes of given windows, and how many samples to pad or cut to reach `target` seconds.
    `round` is half-to-even, `floor` truncates."""
    if rounding not in ("round", "floor"):
        raise ValueError(f"unknown rounding: {rounding}")

    def index(seconds: Column) -> Column:
        scaled = seconds * sample_rate
        return (F.bround(scaled, 0) if rounding == "round" else F.floor(scaled)).cast("long")

    size = F.col("end_sample") - F.col("start_sample")
    wanted = int(round(target * sample_rate))
    return (chunks.withColumns({"start_sample": index(F.col("start")), "end_sample": index(F.col("end"))})
            .withColumns({"pad": F.greatest(F.lit(wanted) - size, F.lit(0)),
                          "cut": F.greatest(size - wanted, F.lit(0))}))


def fixed_windows(perfs: DataFrame, window: float, shift: float, frame_rate: int = 25,
                  out_dir: str | None = None) -> DataFrame:
    """Windows over each performance (perf, dur_s): start_s, start (frame), perf renamed with its start.
    The first window always exists; later ones only while they end before the performance does."""
    steps = F.greatest(F.ceil((F.col("dur_s") - window) / shift), F.lit(1)).cast("int")
    start = F.col("_i") * F.lit(float(shift))
    out = (perfs.withColumn("_i", F.explode(F.sequence(F.lit(0), steps - 1)))
           .withColumn("start_s", start)
           .where((F.col("start_s") + window < F.col("dur_s")) | (F.col("_i") == 0))
           .withColumn("start", F.floor(F.col("start_s") * frame_rate).cast("int"))
           .withColumn("perf", F.format_string("%s-▁start-%d", F.col("perf").cast("string"),
                                               F.floor("start_s"))).drop("_i"))
    if out_dir is not None:
        out = out.withColumn("embed", F.concat(F.lit(out_dir.rstrip("/") + "/"), F.col("perf"), F.lit(".npy")))
    return out


def source_perf(perf: Column) -> Column:
    """The recording a window name belongs to."""
    return F.substring_index(perf, "-▁start-", 1)


# ---------------------------------------------------------------- frame arrays

def shingle_frames(df: DataFrame, frames: str, length: int, step: int, pad: str | None = "zeros") -> DataFrame:
    """Add `shingles`: slices of `length` frames every `step` frames. `zeros` or `repeat` pads the tail so
    that the last slice is full; None keeps full slices only. Frames are scalars or vectors."""
    n, f = F.size(frames), F.col(frames)
    if pad is None:
        count, source = F.floor((n - length) / step).cast("int") + 1, f
    else:
        count = F.greatest(F.ceil((n - length) / step), F.lit(0)).cast("int") + 1
        total = (count - 1) * step + length
        if pad == "repeat":
            source = F.slice(F.flatten(F.array_repeat(f, F.ceil(total / n).cast("int"))), F.lit(1), total)
        elif pad == "zeros":
            first = F.element_at(f, 1)
            kind = df.schema[frames].dataType.elementType
            zero = F.transform(first, lambda x: x * 0) if kind.typeName() == "array" else first * 0
            source = F.concat(f, F.array_repeat(zero, F.greatest(total - n, F.lit(0))))
        else:
            raise ValueError(f"unknown padding: {pad}")
    slices = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(source, i * step + 1, length))
    empty = F.slice(F.array(f), 2, 1)
    return df.withColumn("shingles", F.when((count > 0) & (n > 0), slices).otherwise(empty))


def pool_frames(df: DataFrame, key: str, frames: str, size: int) -> DataFrame:
    """Mean over each `size` consecutive frames, rest dropped: key, pool_id, frame (vector of means)."""
    count = F.floor(F.size(frames) / size).cast("int")
    groups = (df.where(count > 0).select(key, frames, F.explode(F.sequence(F.lit(0), count - 1)).alias("pool_id"))
              .select(key, "pool_id", F.slice(F.col(frames), F.col("pool_id") * size + 1, F.lit(size)).alias("g")))
    width = F.size(F.element_at("g", 1))
    mean = F.transform(F.sequence(F.lit(1), width), lambda b: F.aggregate(
        F.col("g"), F.lit(0.0), lambda acc, fr: acc + F.element_at(fr, b)) / size)
    return groups.select(key, "pool_id", mean.alias("frame"))


def frame_chunk(df: DataFrame, frames: str, length: int, start: Column | int = 0, filler: float = -100.0) -> DataFrame:
    """Add `chunk`: `length` frames from `start`, short ones filled up with frames of `filler`."""
    at = F.lit(start) if isinstance(start, int) else start
    f = F.col(frames)
    kind = df.schema[frames].dataType.elementType
    first = F.element_at(f, 1)
    blank = F.transform(first, lambda x: F.lit(filler).cast(kind.elementType)) if kind.typeName() == "array" \
        else F.lit(filler).cast(kind)
    part = F.slice(f, at + 1, F.lit(length))
    return df.withColumn("chunk", F.concat(part, F.array_repeat(blank, F.greatest(
        F.lit(length) - F.size(part), F.lit(0)))))


# ---------------------------------------------------------------- transcripts against chunks

def align_pieces(chunks: DataFrame, pieces: DataFrame, key: str = "md5_encoded") -> DataFrame:
    """Pair transcript pieces with chunks, one row a chunk.

    `chunks`: key, start, end; `pieces`: key, pieces ARRAY<STRING>. With more chunks than pieces the longest
    chunks are kept, in time order; surplus pieces are dropped. Output: key, chunk_id, start, end, duration,
    transcription.
    """
    length = (F.col("end") - F.col("start"))
    counts = pieces.select(key, "pieces", F.size("pieces").alias("n"))
    by_length = Window.partitionBy(key).orderBy(length.desc(), "start")
    kept = (chunks.join(counts.select(key, "n"), key).withColumn("_size_rank", F.row_number().over(by_length))
            .where(F.col("_size_rank") <= F.col("n")))
    kept = kept.withColumn("chunk_id", F.row_number().over(Window.partitionBy(key).orderBy("start")) - 1)
    texts = counts.select(key, F.posexplode("pieces").alias("chunk_id", "transcription"))
    return (kept.join(texts, [key, "chunk_id"])
            .select(key, "chunk_id", "start", "end", length.alias("duration"), "transcription"))
