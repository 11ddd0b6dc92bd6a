"""File sources, sinks and streams on temporary folders."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from shotloom.operators import subtitles as sub
from shotloom.sources import artifacts as ar
from shotloom.streaming import stages as ss


def test_artifacts_and_lines(spark, tmp_path):
    for v in ("v1", "v2"):
        (tmp_path / v).mkdir()
        (tmp_path / v / "outline.json").write_text(json.dumps({"title": f"T {v}", "chapters": []}, indent=2))
        (tmp_path / v / "cards.jsonl").write_text('{"shot_id": "a"}\n\n{"shot_id": "b"}\n' + ("oops\n" if v == "v2" else ""))
    got = ar.read_artifacts(spark, f"{tmp_path}/*/outline.json", "title string")
    assert {(r.video_id, r.title) for r in got.collect()} == {("v1", "T v1"), ("v2", "T v2")}
    schema = StructType().add("shot_id", StringType())
    loose = ar.read_jsonl(spark, f"{tmp_path}/*/cards.jsonl", schema, strict=False).cache()
    assert loose.where("_corrupt_record is not null").count() == 1 and loose.count() == 5
    with pytest.raises(Exception):
        ar.read_jsonl(spark, f"{tmp_path}/*/cards.jsonl", schema).collect()
    assert ar.discover_lines(spark, str(tmp_path)).count() == 7
    files = ar.catalog_files(spark, str(tmp_path), "*.json")
    assert files.count() == 2 and files.where("size_bytes > 0 and length(sha256) = 64").count() == 2


def test_bad_lines_are_named_by_file_and_line(spark, tmp_path):
    """Line numbers go on over the splits of a file; blank lines count."""
    bad = {"a": [], "b": [4, 700, 2_999], "c": [1]}
    for name, at in bad.items():
        (tmp_path / name).mkdir()
        lines = ["" if k % 11 == 0 else "{oops" if k in at else json.dumps({"shot_id": f"s{k}"}) for k in range(1, 3_000)]
        (tmp_path / name / "cards.jsonl").write_text("\n".join(lines) + "\n")
    schema = StructType().add("shot_id", StringType())
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in zip(keep, ("2000", "100")):
            spark.conf.set(k, v)
        got = ar.jsonl_errors(spark, f"{tmp_path}/*/cards.jsonl", schema).collect()
        assert sorted((r.path.split("/")[-2], r.line_no, r.line) for r in got) == [("b", 4, "{oops"), ("b", 700, "{oops"), ("b", 2_999, "{oops"), ("c", 1, "{oops")]
        with pytest.raises(ValueError, match=r"b/cards\.jsonl:4$"):
            ar.read_jsonl(spark, f"{tmp_path}/*/cards.jsonl", schema)
        assert ar.read_jsonl(spark, f"{tmp_path}/a/cards.jsonl", schema).count() == 2_999 - 2_999 // 11
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_a_file_above_two_gigabytes_is_hashed_in_slices(spark, tmp_path):
    import hashlib

    size, zeros = (2 << 30) + 5, bytes(1 << 20)
    with open(tmp_path / "long name é.bin", "wb") as f:
        f.truncate(size)
    (tmp_path / "small.bin").write_bytes(b"abc")
    digest = hashlib.sha256()
    for _ in range(size >> 20):
        digest.update(zeros)
    digest.update(bytes(5))
    got = {r.size_bytes: r.sha256 for r in ar.catalog_files(spark, str(tmp_path)).collect()}
    assert got == {size: digest.hexdigest(), 3: hashlib.sha256(b"abc").hexdigest()}


def test_srt_round_trip(spark, tmp_path):
    (tmp_path / "clip.srt").write_text("1\n00:00:01,000 --> 00:00:02,500\nhello\n\n2\n00:00:03,000 --> 00:00:03,000\nzero\n\n3\n00:00:04,000 --> 00:00:05,000\n<i>two</i>\nlines\n")
    files = ar.read_texts(spark, str(tmp_path))
    got = [(r.video_id, r.segment_id, r.start_sec, r.end_sec, r.text) for r in sub.parse_srt(files).orderBy("seq").collect()]
    assert got == [("clip", "sub_0001", 1.0, 2.5, "hello"), ("clip", "sub_0002", 4.0, 5.0, "<i>two</i> lines")]
    lines = [r.line for r in sub.compact_srt(files).orderBy("line_no").collect()]
    assert lines == ["[00:00:01,000-00:00:02,500] hello", "[00:00:03,000-00:00:03,000] zero", "[00:00:04,000-00:00:05,000] two lines"]


@pytest.mark.parametrize("fmt", ["srt", "txt", "json", "raw-json"])
def test_export(spark, tmp_path, fmt):
    d = spark.createDataFrame([("v1", 1, 0, 1000, "a"), ("v1", 2, 1000, 900, "b")], "video_id string, seq long, start_time long, end_time long, text string")
    ar.export_segments(d, f"{tmp_path}/{fmt}", fmt)
    assert spark.read.text(f"{tmp_path}/{fmt}").count() > 0


def test_lines_are_written_by_the_tasks(spark, tmp_path):
    """F16, F17: files of a local folder do not pass through Spark's writer, which leaves a checksum file beside each; layout and contents stay."""
    ids = ["a", "a b", "x/y:z=%41", "ü#?", "_u", ".d", "07", "[q]^{", "back\\slash\t\"'*", "", None]
    rows = [(i, n, None if n == 2 else f"{i} line {n}") for i in ids for n in range(5)]
    d = spark.createDataFrame(rows, "video_id string, seq long, line string").withColumn("line", F.expr("if(seq = 4, cast(X'FF41' as string), line)"))
    plain = d.repartitionByRange("video_id", "seq").sortWithinPartitions("video_id", "seq").select("video_id", "line")
    plain.write.partitionBy("video_id").text(f"{tmp_path}/plain")
    path = f"{tmp_path}/lines"
    ar.write_lines(spark.createDataFrame([("gone", 1, "old")], d.schema), f"file:{path}", ["seq"], "line")
    ar.write_lines(d, path, ["seq"], "line")

    def contents(folder):
        return {f.name: sorted(x.read_bytes() for x in f.iterdir() if not x.name.startswith(".")) for f in folder.iterdir() if f.is_dir()}

    assert contents(tmp_path / "lines") == contents(tmp_path / "plain")
    assert (tmp_path / "lines" / "_SUCCESS").exists()
    assert not [x for x in (tmp_path / "lines").rglob("*") if x.name.startswith(".") and x.parent.name.startswith("video_id=")]
    read = lambda p: sorted(map(str, spark.read.text(p).select("video_id", F.hex("value")).collect()))
    assert read(path) == read(f"{tmp_path}/plain") and len(read(path)) == len(rows)
    ar.write_lines(d, path, ["seq"], "line", per_file=2)
    assert max(x.read_bytes().count(b"\n") for x in (tmp_path / "lines").rglob("part-*")) == 2
    assert read(path) == read(f"{tmp_path}/plain")


def test_export_rejects_other_formats(spark):
    with pytest.raises(ValueError):
        ar.export_segments(spark.range(1), "/tmp/none", "pdf")


def test_stage_state_stream_equals_batch(spark, tmp_path):
    rows = [
        ("v", "s", "running", 1, None), ("v", "s", "failed", 2, "bad"), ("v", "s", "running", 3, None), ("v", "s", "done", 4, None),
        ("w", "s", "running", 1, None), ("w", "s", "failed", 5, "worse"), ("x", "s", "running", 9, None),
    ]
    d = spark.createDataFrame(rows, "video_id string, stage string, status string, seq long, error string").withColumn("time", F.timestamp_seconds("seq"))
    d.repartition(3).write.json(f"{tmp_path}/in")
    ss.stream_stage_state(ss.read_stage_events(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/chk").awaitTermination()
    show = lambda df: sorted((r.video_id, r.status, r.error, r.finished_at is None) for r in df.collect())
    got = show(ss.latest_state(spark, f"{tmp_path}/out"))
    assert got == show(ss.stage_state(d)) == [("v", "done", None, False), ("w", "failed", "worse", False), ("x", "running", None, True)]
