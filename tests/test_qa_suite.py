"""The table checks of a library together."""

from shotloom.operators import qa


def test_suite(spark):
    f = spark.createDataFrame
    got = qa.qa_suite(
        videos=f([("v",), ("w",), ("x",)], "video_id string"),
        cards=f([("v", "s1"), ("v", "s2"), ("w", "s1")], "video_id string, shot_id string"),
        outline=f([("v", "c1"), ("w", "c1")], "video_id string, chapter_id string"),
        chapter_shots=f([("v", "c1", "s1"), ("v", "c1", "s9"), ("w", "c1", "s1")], "video_id string, chapter_id string, shot_id string"),
        heads=f([("v", "s1"), ("w", "s1")], "video_id string, shot_id string"),
        sub_shots=f([("v", "c1", "u1", "s1"), ("w", "c1", "u1", "s1")], "video_id string, chapter_id string, subsection_id string, shot_id string"),
        sub_heads=f([("v", "c1", "u1", "s1"), ("w", "c1", "u1", "s1")], "video_id string, chapter_id string, subsection_id string, shot_id string"),
        planned=f([("v", "c1", 1, "One"), ("v", "c1", 2, "Two"), ("w", "c1", 1, "One")], "video_id string, chapter_id string, ord int, title string"),
        bodies=f(
            [("v", "c1", "## One\ntext", "missing.jpg", ["oversized_subsection:u1", "other"]), ("v", "c7", " ", "a.jpg", []), ("w", "c1", "### One\n", "a.jpg", None)],
            "video_id string, chapter_id string, body_markdown string, representative_frame string, warnings array<string>",
        ),
        refs=f([("v", "c1", "s2"), ("v", "c1", "s1"), ("w", "c1", "s1")], "video_id string, chapter_id string, shot_id string"),
        files=f([("a.jpg",), ("a.jpg",)], "path string"),
    )
    of = {(r.video_id, r.name): (r.status, r.n_bad) for r in got.collect()}
    assert of[("v", "outline_shot_refs")] == ("failed", 1) and of[("v", "chapter_images")] == ("failed", 1)
    assert of[("v", "chapter_body")] == ("failed", 1) and of[("v", "chapter_refs")] == ("failed", 2)
    assert of[("v", "chapter_subsection_body")] == ("failed", 1) and of[("v", "chapter_write_warnings")] == ("warning", 1)
    assert {of[k] for k in of if k[0] == "w"} == {("passed", 0)} and {of[k] for k in of if k[0] == "x"} == {("skipped", 0)}
    total = {r.video_id: (r.status, r.errors, r.warnings) for r in qa.qa_rollup(got, ["video_id"]).collect()}
    assert total == {"v": ("failed", 5, 1), "w": ("passed", 0, 0), "x": ("passed", 0, 6)}
