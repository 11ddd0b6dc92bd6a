"""Shot tables: boundary detection from frame features, normalising, key-frame plans, packages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_at
from ..functions.text import relativize
from .ordered import entry_states, group_quantiles, id_bucket, with_neighbors, with_ordinal, with_running
from .staging import materialize

K = ["video_id"]
FRAME_BLOCK = 4096


def _mean_abs_diff(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return total / F.greatest(F.lit(1), F.size(b))


def _bhattacharyya(a: Column, b: Column) -> Column:
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    shared = total(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)))
    return F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - shared / F.sqrt(total(a) * total(b))))


def frame_diff(features: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Score of each frame against the one before: half gray, 0.4 histogram, 0.1 edge difference."""
    prev = {"_g": "gray", "_h": "hist", "_e": "edge"}
    d = with_neighbors(features, keys, ["frame_idx"], id_bucket(F.col("frame_idx"), FRAME_BLOCK), prev=prev)
    score = (
        _mean_abs_diff(F.col("_g"), F.col("gray")) / 255.0 * 0.5
        + _bhattacharyya(F.col("_h"), F.col("hist")) * 0.4
        + _mean_abs_diff(F.col("_e"), F.col("edge")) / 255.0 * 0.1
    )
    return d.where(F.col("_g").isNotNull()).select(*keys, "frame_idx", score.alias("score"))


def cut_threshold(scores: DataFrame, threshold: float = 0.5, keys: Sequence[str] = K) -> DataFrame:
    """Adaptive threshold per video from the median, the median deviation and a high percentile."""
    t = min(0.99, max(0.01, float(threshold)))
    rank = max(90.0, min(99.7, 99.3 - (1.0 - t) * 5.0)) / 100.0
    q = group_quantiles(scores, keys, "score", {"median": F.lit(0.5), "pct": F.lit(rank), "p99": F.lit(0.99)})
    dev = scores.join(q.select(*keys, "median"), list(keys)).select(
        *keys, F.abs(F.col("score") - F.col("median")).alias("score")
    )
    mad = group_quantiles(dev, keys, "score", {"mad": F.lit(0.5)}).drop("n_values")
    level = F.greatest(
        F.lit(0.045),
        F.col("median") + F.lit(max(2.2, t * 5.0)) * F.greatest(F.col("mad"), F.lit(0.002)),
        F.col("pct"),
    )
    return q.join(mad, list(keys)).select(*keys, "n_values", "median", "mad", "pct", "p99", level.alias("cut_level"))


def peak_candidates(scores: DataFrame, levels: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Frames at or above the level and not below either neighbour (a missing neighbour counts as -1)."""
    b = id_bucket(F.col("frame_idx"), FRAME_BLOCK)
    d = with_neighbors(scores, keys, ["frame_idx"], b, prev={"_l": "score"}, next_={"_r": "score"})
    d = d.join(levels.select(*keys, "cut_level"), list(keys))
    return d.where(
        (F.col("score") >= F.col("cut_level"))
        & (F.col("score") >= F.coalesce("_l", F.lit(-1.0)))
        & (F.col("score") >= F.coalesce("_r", F.lit(-1.0)))
    ).select(*keys, "frame_idx", "score")


def min_gap_select(
    candidates: DataFrame, gap: int, at: str = "frame_idx", keys: Sequence[str] = K, anchor: int | None = 0, block: int = 256
) -> DataFrame:
    """Greedy choice in order: accept a candidate at least ``gap`` after the last accepted one.

    ``anchor`` is accepted first (None: the first candidate is). A candidate at least ``gap`` after its direct
    predecessor is always accepted, so the sequence splits there into independent islands. An island is folded in
    blocks of positions; one that spans several blocks first learns how far the last choice reaches into each:
    state 0 is "free", state ``j`` is a last choice ``gap - j`` before the block.
    """
    width = max(block, gap)
    pts = candidates.select(*keys, F.col(at).cast("bigint").alias("_x")).distinct()
    if anchor is not None:
        zero = pts.select(*keys).distinct().withColumn("_x", F.lit(anchor).cast("bigint"))
        pts = pts.where(F.col("_x") > anchor).unionByName(zero)
    b = id_bucket(F.col("_x"), 65536)
    pts = with_neighbors(materialize(pts), keys, ["_x"], b, prev={"_p": "_x"})
    head = F.col("_p").isNull() | (F.col("_x") - F.col("_p") >= gap)
    pts = with_running(pts, keys, ["_x"], b, head.cast("int"), "_isl")
    ids = [*keys, "_isl"]
    packed = materialize(
        pts.groupBy(*ids, F.floor(F.col("_x") / width).alias("_blk")).agg(F.sort_array(F.collect_list("_x")).alias("_xs"))
    )
    spread = packed.groupBy(*ids).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*ids)
    start = F.col("_blk") * width

    def last_from(state: Column) -> Column:
        """Last choice before the block; far enough back when free."""
        return F.when(state > 0, start - gap + state).otherwise(start - 2 * gap)

    def end_state(last: Column) -> Column:
        return F.greatest(F.lit(0).cast("bigint"), last - (start + width - gap)).cast("int")

    if spread.isEmpty():
        d = packed.withColumn("entry_state", F.lit(0))
    else:
        wide = packed.join(spread, ids, "left_semi")
        before = wide.select(*ids, (F.col("_blk") + 1).alias("_blk"), F.col("_xs").alias("_px"))
        wide = wide.join(before, [*ids, "_blk"], "left")
        # Only candidates in the last gap before the block can reach into it.
        near = F.filter(F.coalesce("_px", F.array().cast("array<bigint>")), lambda x: x > start - gap)
        states = F.concat(F.array(F.lit(0)), F.transform(near, lambda x: (x - (start - gap)).cast("int")))
        ends = F.transform(
            states,
            lambda r0: F.struct(
                end_state(F.aggregate("_xs", last_from(r0), lambda last, x: F.when(x - last >= gap, x).otherwise(last))).alias("r"),
                F.lit(0).cast("bigint").alias("k"),
            ),
        )
        d = packed.join(entry_states(wide.withColumn("fn", F.map_from_arrays(states, ends)), ids), [*ids, "_blk"], "left")
    d = d.withColumn("_last", last_from(F.coalesce("entry_state", F.lit(0))))
    fold = F.aggregate(
        "_xs",
        F.array("_last"),
        lambda acc, x: F.when(x - F.element_at(acc, -1) >= gap, F.concat(acc, F.array(x))).otherwise(acc),
    )
    return d.withColumn("_kept", fold).select(*keys, F.explode(F.slice("_kept", F.lit(2), F.size("_kept"))).alias(at))


def cuts_to_bounds(cuts: DataFrame, frame_counts: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """``[cut, next cut - 1]``; the last one ends at the last frame. ``cuts`` starts with frame 0."""
    d = with_neighbors(cuts, keys, ["frame_idx"], id_bucket(F.col("frame_idx"), 65536), next_={"_n": "frame_idx"})
    return d.join(frame_counts, list(keys)).select(
        *keys,
        F.col("frame_idx").cast("bigint").alias("start_frame"),
        (F.coalesce("_n", "frame_count") - 1).cast("bigint").alias("end_frame"),
    )


def merge_short_scenes(bounds: DataFrame, min_frames: int, keys: Sequence[str] = K) -> DataFrame:
    """Merge scenes in order of ``seq``; keys, seq, start_frame, end_frame, frame_count.

    Rules per scene, after clipping to the video: inverted scenes are skipped; a
    scene that starts inside the kept one extends it; a long one (or the first) is
    appended; a short one sets the end of the kept one. Each step only ever moves
    the kept end forward, so it equals the running maximum of the ends: a scene
    opens exactly where a long one starts beyond that maximum, and ends at the
    largest end up to the next opening.
    """
    last = F.greatest(F.lit(0).cast("bigint"), F.col("frame_count") - 1)
    d = bounds.withColumn("s", F.greatest(F.lit(0).cast("bigint"), F.col("start_frame"))).withColumn(
        "e", F.least(last, F.col("end_frame"))
    )
    ok = d.where(F.col("e") >= F.col("s"))
    b = id_bucket(F.col("seq"), 4096)
    run = with_running(ok, keys, ["seq"], b, F.col("e"), "_reach", "max", inclusive=False)
    opens = F.col("_reach").isNull() | (
        (F.col("s") > F.col("_reach")) & (F.col("e") - F.col("s") + 1 >= min_frames)
    )
    run = with_running(run, keys, ["seq"], b, opens.cast("int"), "_isl")
    folded = run.groupBy(*keys, "_isl").agg(F.min_by("s", "seq").alias("start_frame"), F.max("e").alias("end_frame")).drop("_isl")
    lost = bounds.groupBy(*keys).agg(F.max("frame_count").alias("frame_count")).join(
        ok.select(*keys).distinct(), list(keys), "left_anti"
    )
    return folded.unionByName(
        lost.select(
            *keys,
            F.lit(0).cast("bigint").alias("start_frame"),
            F.greatest(F.lit(0).cast("bigint"), F.col("frame_count") - 1).alias("end_frame"),
        )
    )


def frames_to_time(bounds: DataFrame, fps: Column, duration: Column) -> DataFrame:
    """Frame bounds to seconds, clipped to the duration, at least one frame long."""
    start = F.greatest(F.lit(0.0), F.col("start_frame") / fps)
    plain = (F.col("end_frame") + 1) / fps
    end = F.least(F.coalesce(F.nullif(duration, F.lit(0.0)), plain), plain)
    return bounds.withColumn("start_sec", start).withColumn(
        "end_sec", F.when(end <= start, start + F.lit(1.0) / fps).otherwise(end)
    )


def clean_positions(positions: Sequence[float] | str | None) -> list[float]:
    """Key-frame positions: parsed, clamped to 0.05..0.95, distinct and sorted."""
    default = [0.2, 0.4, 0.6, 0.8]
    if positions is None:
        return default
    raw = [p for p in positions.split(",") if p.strip()] if isinstance(positions, str) else list(positions)
    return sorted({min(0.95, max(0.05, float(p))) for p in raw}) or default


def keyframe_plan(shots: DataFrame, fps: Column, positions: Sequence[float] | str | None = None) -> DataFrame:
    """One row per shot and position with the time and frame to take."""
    pos = F.array(*[F.lit(p) for p in clean_positions(positions)])
    t = F.col("start_sec") + F.greatest(F.lit(1e-6), F.col("end_sec") - F.col("start_sec")) * F.col("position")
    return (
        shots.select(*shots.columns, F.posexplode(pos).alias("_p", "position"))
        .withColumn("time_sec", t)
        .withColumn("frame", F.floor(F.col("time_sec") * fps + 0.5))
        .withColumn("role", F.format_string("fifth_%d", F.col("_p") + 1))
        .drop("_p")
    )


def sample_plan(shots: DataFrame, sample_fps: float, max_frames: int) -> DataFrame:
    """Evenly spaced sample times with a margin of 8 % or 0.25 s; the midpoint when there is one."""
    dur = F.col("end_sec") - F.col("start_sec")
    n = F.least(F.lit(max_frames), F.greatest(F.lit(1), F.floor(dur * sample_fps + 0.5).cast("int")))
    margin = F.least(dur * 0.08, F.lit(0.25))
    lo = F.col("start_sec") + margin
    hi = F.greatest(lo, F.col("end_sec") - margin)
    d = shots.where((F.col("end_sec") > F.col("start_sec")) & F.lit(sample_fps > 0 and max_frames > 0))
    d = d.withColumn("_n", n).withColumn("_lo", lo).withColumn("_step", (hi - lo) / F.greatest(F.lit(1), F.col("_n") - 1))
    d = d.withColumn("sample_no", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    t = F.when(F.col("_n") == 1, (F.col("start_sec") + F.col("end_sec")) / 2.0).otherwise(
        F.col("_lo") + F.col("_step") * (F.col("sample_no") - 1)
    )
    return d.withColumn("time_sec", t).drop("_n", "_lo", "_step")


def normalize_shots(raw: DataFrame, root: Column) -> DataFrame:
    """Detector rows to the shot table.

    ``raw``: keys, seq, shot_id, start, start_sec, end, end_sec, duration,
    keyframe_times array<struct<path,position,time>>, keyframes array<string>.
    A zero counts as missing in the fallback chains.
    """
    z = F.lit(0.0)
    sid = F.coalesce(F.nullif("shot_id", F.lit("")), F.format_string("shot_%03d", "seq"))
    d = raw.withColumn("_id", sid)
    d = d.withColumn("_s", F.coalesce(F.nullif("start", z), F.nullif("start_sec", z), z))
    d = d.withColumn("_e", F.coalesce(F.nullif("end", z), F.nullif("end_sec", z), "_s"))
    d = d.withColumn("_d", F.coalesce(F.nullif("duration", z), F.greatest(z, F.col("_e") - F.col("_s"))))

    def frame(no: Column, position: Column, time: Column, path: Column) -> Column:
        return F.struct(
            F.format_string("%s_%02d", F.col("_id"), no).alias("frame_id"),
            position.cast("double").alias("position"),
            time.cast("double").alias("time_sec"),
            relativize(path, root).alias("path"),
        )

    timed = F.filter(
        F.transform(
            "keyframe_times",
            lambda f, i: F.when(
                F.coalesce(f["path"], F.lit("")) != "",
                frame(i + 1, F.coalesce(f["position"], z), F.coalesce(f["time"], z), f["path"]),
            ),
        ),
        lambda f: f.isNotNull(),
    )
    d = d.withColumn("_t", F.coalesce(timed, F.array().cast("array<struct<frame_id:string,position:double,time_sec:double,path:string>>")))
    d = d.withColumn("_kf", F.coalesce("keyframes", F.array().cast("array<string>")))
    mid = round_at(F.col("_s") + F.col("_d") * 0.5, 3)
    rest = F.filter(
        F.transform("_kf", lambda p, i: F.struct(i.alias("i"), frame(F.size("_t") + 1 + i, z, mid, p).alias("f"), p.alias("p"))),
        lambda r: ~F.exists("_t", lambda t: t["path"] == r["f"]["path"]) & (F.array_position("_kf", r["p"]) == r["i"] + 1),
    )
    d = d.withColumn("keyframe_rows", F.concat("_t", F.transform(rest, lambda r: r["f"])))
    return d.select(
        *[c for c in raw.columns if c in ("video_id", "seq")],
        F.col("_id").alias("shot_id"),
        round_at(F.col("_s"), 3).alias("start_sec"),
        round_at(F.col("_e"), 3).alias("end_sec"),
        round_at(F.col("_d"), 3).alias("duration_sec"),
        F.col("keyframe_rows").alias("keyframes"),
        F.when(F.size("keyframe_rows") == 0, F.array(F.lit("no_keyframes"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


def fallback_single_shot(videos: DataFrame, shots: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Shots plus one whole-length shot, flagged, for each video that has none."""
    lone = videos.join(shots.select(*keys).distinct(), list(keys), "left_anti")
    end = round_at(F.greatest(F.coalesce("duration_sec", F.lit(0.0)), F.lit(0.001)), 3)
    return shots.select(*keys, "shot_id", "start_sec", "end_sec", F.lit(False).alias("degraded")).unionByName(
        lone.select(*keys, F.lit("shot_001").alias("shot_id"), F.lit(0.0).alias("start_sec"), end.alias("end_sec"), F.lit(True).alias("degraded"))
    )


def missing_files(refs: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """References whose file is not in the catalog."""
    return refs.join(files.select(F.col("path").alias(path)).distinct(), path, "left_anti")


def build_packages(
    shots: DataFrame, aligned: DataFrame, missing: DataFrame, bucket: Column, keys: Sequence[str] = K
) -> DataFrame:
    """Shots with their subtitle text, neighbours and sorted unique warnings.

    ``missing``: keys, shot_id, path of frames without a file.
    """
    lost = missing.groupBy(*keys, "shot_id").agg(
        F.collect_set(F.concat(F.lit("missing_frame:"), "path")).alias("_lost")
    )
    none = F.array().cast("array<string>")
    d = shots.join(aligned.select(*keys, "shot_id", "subtitle_text"), [*keys, "shot_id"], "left").join(
        lost, [*keys, "shot_id"], "left"
    )
    d = with_neighbors(
        d, keys, ["seq"], bucket, prev={"previous_shot_id": "shot_id"}, next_={"next_shot_id": "shot_id"}
    )
    return d.withColumn("subtitle_text", F.coalesce("subtitle_text", F.lit(""))).withColumn(
        "warnings", F.sort_array(F.array_distinct(F.concat("warnings", F.coalesce("_lost", none))))
    ).drop("_lost")


def detect_shots(
    features: DataFrame, fps: float, threshold: float = 0.5, min_gap_seconds: float = 0.35,
    min_shot_seconds: float = 0.15, keys: Sequence[str] = K, least_frames: int = 2,
) -> DataFrame:
    """Frame features to shots with frame and time bounds and a shot number.

    A scene shorter than ``min_shot_seconds`` or ``least_frames`` joins the one before; with 0 and 1 every cut opens a shot.
    """
    scores = materialize(frame_diff(features, keys))
    levels = cut_threshold(scores, threshold, keys)
    peaks = peak_candidates(scores, levels, keys)
    counts = features.groupBy(*keys).agg((F.max("frame_idx") + 1).cast("bigint").alias("frame_count"))
    zero = features.select(*keys).distinct().withColumn("frame_idx", F.lit(0).cast("bigint"))
    gap = max(1, round(fps * max(0.0, min_gap_seconds)))  # halves to the even frame
    # Every video keeps its frame 0 even when it has no peak.
    cuts = min_gap_select(peaks, gap, keys=keys).unionByName(zero).distinct()
    bounds = cuts_to_bounds(materialize(cuts), counts, keys).join(counts, list(keys)).withColumn("seq", F.col("start_frame"))
    bounds = materialize(bounds)
    scenes = merge_short_scenes(bounds, max(least_frames, round(fps * max(0.0, min_shot_seconds))), keys)
    timed = frames_to_time(scenes.join(counts, list(keys)), F.lit(float(fps)), F.col("frame_count") / F.lit(float(fps)))
    d = with_ordinal(timed, keys, [F.col("start_frame")], id_bucket(F.col("start_frame"), 65536), "shot_no")
    return d.select(
        *keys, "shot_no", F.format_string("shot_%03d", "shot_no").alias("shot_id"), "start_frame", "end_frame",
        round_at(F.col("start_sec"), 3).alias("start_sec"), round_at(F.col("end_sec"), 3).alias("end_sec"),
    )
