"""Planning answers as whole rows: references, summaries, duplicates, limits and warnings."""

import json
import random

import pytest
from pyspark.sql import functions as F

from shotloom.functions import nested
from shotloom.operators import answers, freshness, ocr
from shotloom.operators.staging import staging_dir

SHOTS = [f"shot_{n:03d}" for n in range(1, 9)]


def one(spark, parse, text, valid=SHOTS, **kw):
    return parse(spark.createDataFrame([(1, text, valid)], "id int, response string, valid array<string>"), "response", "valid", **kw).first()


def test_outline(spark):
    text = """<THEME>1. Main theme</THEME><SECTION chunks="chunk_001, chunk_999">Opening</SECTION>
    <SECTION chunks="chunk_002">Opening</SECTION><SECTION> </SECTION><section source_chunks='chunk_002;chunk_002'>Second</section>"""
    got = one(spark, answers.parse_outline_answers, text, ["chunk_001", "chunk_002"])
    assert (got.status, got.style, got.theme) == ("ok", "structured_report", "Main theme")
    assert [(s.title, s.source_chunks) for s in got.sections] == [("Opening", ["chunk_001"]), ("Second", ["chunk_002"])]
    assert got.warnings == ["duplicate_section_removed:Opening", "invalid_section_chunks_removed:chunk_999"]
    many = "<THEME>t</THEME><STYLE> essay </STYLE>" + "".join(f"<SECTION>Part {'abcdefgh'[k]}</SECTION>" for k in range(8))
    got = one(spark, answers.parse_outline_answers, many)
    assert got.style == "essay" and len(got.sections) == 6 and got.warnings == ["too_many_sections_truncated:8"]
    assert one(spark, answers.parse_outline_answers, "<SECTION>x</SECTION>").status == "failed"
    assert one(spark, answers.parse_outline_answers, None).status == "failed"


def test_planner_keeps_summaries_with_their_chapter(spark):
    text = """<TITLE>Video</TITLE><DESCRIPTION>About it</DESCRIPTION><CHAPTER shots="shot_001"></CHAPTER><SUMMARY>of the empty one</SUMMARY>
    <CHAPTER shots="shot_001-shot_003, nope">Alpha</CHAPTER><SUMMARY>first</SUMMARY><CHAPTER shots="zz">Beta</CHAPTER>
    <CHAPTER shots="shot_006-shot_005">Gamma</CHAPTER> no summary <CHAPTER shots="shot_007">Alpha</CHAPTER><SUMMARY>again</SUMMARY>"""
    got = one(spark, answers.parse_planner_answers, text)
    assert (got.status, got.title, got.description) == ("ok", "Video", "About it")
    assert [(c.title, c.summary, c.shot_ids) for c in got.chapters] == [("Alpha", "first", SHOTS[:3]), ("Gamma", "Gamma", SHOTS[4:6])]
    assert got.warnings == ["empty_outline_chapter_removed:Beta", "duplicate_outline_chapter_removed:Alpha", "invalid_outline_shots_removed:nope,zz"]


def test_planner_limit_ends_the_reading(spark):
    text = "".join(f'<CHAPTER shots="shot_00{k}{",bad" if k == 3 else ""}">Part {"abcdefgh"[k]}</CHAPTER>' for k in range(1, 5))
    got = one(spark, answers.parse_planner_answers, text, limit=2)
    assert [c.title for c in got.chapters] == ["Part b", "Part c"]
    assert got.warnings == ["too_many_outline_chapters_truncated:4"]
    assert one(spark, answers.parse_planner_answers, "nothing").status == "failed"


def test_subsections(spark):
    got = one(spark, answers.parse_subsection_answers, '<SUB shots="shot_001-shot_002">One</SUB><SUB shots="">Two</SUB><SUB shots="shot_003">One</SUB><KEEP/>')
    assert got["mode"] == "split" and [(s.title, s.shot_ids) for s in got.subsections] == [("One", SHOTS[:2])]
    assert got.warnings == ["empty_subsection_removed:Two", "duplicate_subsection_removed:One"]
    assert one(spark, answers.parse_subsection_answers, "< keep / >")["mode"] == "keep"
    assert one(spark, answers.parse_subsection_answers, "?")["mode"] == "failed"


@pytest.mark.parametrize("raw,texts", [
    ('[[{"rec_text":"A"}]]', ["A"]),
    ('{"res":{"res":{"res":{"res":{"res":{"res":{"text":"deep"}}}}}}}', ["deep"]),
    ("[" * 200 + '"x"' + "]" * 200, ["x"]),
    ('{"rec_texts":["b","a"],"rec_scores":[0.9,0.1],"items":["c"," b "]}', ["b", "c"]),
    ("[" * 50_000 + '{"data":["y"],"text":"x"}' + "]" * 50_000, ["x", "y"]),
    ('{"rec_texts":["a",7,null],"rec_scores":["?",0.1],"text":true,"other":{"text":"no"},"data":"d","res":{"items":[1,"r"]}}', ["a", "True", "r", "d"]),
    ("no json", []),
    ('{"text":"x"', []),
])
def test_recognised_texts_at_any_depth(spark, raw, texts):
    df = spark.createDataFrame([(1, raw)], "id int, result string")
    assert [r.text for r in ocr.explode_ocr(df, ["id"], "result", 0.5).orderBy("ord").collect()] == texts


def test_redaction_masks_objects_lists_and_nulls(spark):
    raw = '{"secret":{"a":"tok"},"Authorization":["Bearer x"],"ok":[{"my_password":null,"n":1}],"u":"data:image/png;base64,AAAA","t":"' + "y" * 40 + '"}'
    safe = nested.redact_payloads(spark.createDataFrame([(1, raw), (2, "plain tok"), (3, None)], "i int, p string"), "p", 30).orderBy("i").select("p").collect()
    assert safe[0][0].startswith('{"secret":"***redacted***","Authorization":"***redacted***","ok":[{"my_password":"***redacted***","n":1}],"u":{"redacted":true,')
    assert "AAAA" not in safe[0][0] and "truncated chars=40" in safe[0][0] and safe[1][0] == "plain tok" and safe[2][0] is None


def plain_masked(value):
    if isinstance(value, dict):
        return {k: nested.MASK if any(p in k.lower() for p in nested.SENSITIVE_KEY_PARTS) else plain_masked(v) for k, v in value.items()}
    return [plain_masked(v) for v in value] if isinstance(value, list) else value


def random_json(rng, depth):
    kind = rng.choice("ollllosssn" if depth else "sn")
    if kind == "o":
        return {rng.choice(["a", "b\\", 'q"q', "SECRET_k", "x_Password", "ké", "{[:,"]) + str(i): random_json(rng, depth - 1) for i in range(rng.randrange(4))}
    if kind == "l":
        return [random_json(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice(["", 'he said "x"', "tail\\", "]},{", "é\n\t", "password"]) if kind == "s" else rng.choice([1, -2.5, None, True, False])


def test_redaction_of_random_values(spark):
    rng = random.Random(9)
    values = [[random_json(rng, 5) for _ in range(2)] for _ in range(150)]
    df = spark.createDataFrame([(i, json.dumps(x, ensure_ascii=bool(i % 2), indent=i % 3 or None)) for i, x in enumerate(values)], "i int, p string")
    got = nested.redact_payloads(df, "p").orderBy("i").collect()
    assert [r.p for r in got] == [json.dumps(plain_masked(x), ensure_ascii=False, separators=(",", ":")) if not (i % 2) else r.p for i, (x, r) in enumerate(zip(values, got))]
    assert [json.loads(r.p) for r in got] == [plain_masked(x) for x in values]
    plan = nested.redact_payloads(df, "p")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_redaction_of_deep_and_odd_texts(spark):
    deep = '{"k":' * 3000 + '{"secret":{"a":["tok"]},"n":1.50}' + "}" * 3000
    rows = [(1, deep), (2, '{"secret":[1],"secret":"tok"}'), (3, '{"secret":"tok'), (4, "[]"), (5, '"a b"'), (6, ""), (7, '{"secret":{}} x'), (8, '{"a":[{"token":1,"secret":{"b":{}}},2]}')] + [(9, '{"password":["tok"]}')] * 3
    got = sorted((r.i, r.p) for r in nested.redact_payloads(spark.createDataFrame(rows, "i int, p string"), "p").collect())
    m = f'"{nested.MASK}"'
    assert got == [
        (1, '{"k":' * 3000 + f'{{"secret":{m},"n":1.50}}' + "}" * 3000), (2, f'{{"secret":{m},"secret":{m}}}'), (3, '{"secret":"tok'), (4, "[]"), (5, '"a b"'), (6, ""), (7, '{"secret":{}} x'),
        (8, f'{{"a":[{{"token":1,"secret":{m}}},2]}}'), *[(9, f'{{"password":{m}}}')] * 3,
    ]


def test_render_at_any_depth(spark):
    long = json.dumps({"a": ["w " * 60, {"b": "v" * 90}]})
    df = spark.createDataFrame([("[" * 50_000 + '{"a":"x"}' + "]" * 50_000,), (long,)], "v string")
    assert [r[0] for r in df.select(nested.render_value("v")).collect()] == ["a=x", "a=" + ("w " * 40).rstrip()[:79].rstrip() + "..."]
    df = spark.createDataFrame([('{"a":{"b":{"c":{"d":1}}},"t":true,"e":[]}',), (" x  y ",), (None,)], "v string")
    assert [r[0] for r in df.select(nested.render_value("v")).collect()] == ["a=b=c=d=1; t=True", "x y", ""]


def test_closure_of_a_long_chain(spark):
    edges = spark.range(66).select(F.col("id").alias("node"), (F.col("id") + 1).alias("depends_on"))
    got = freshness.upstream_closure(edges)
    assert got.count() == 66 * 67 // 2 and got.agg(F.max("depth")).first()[0] == 66


def test_staging_needs_a_shared_folder_off_local_masters(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging_dir(Session())
    assert staging_dir(spark)


def test_closure_of_random_graphs_and_cycles(spark):
    rng = random.Random(6)
    pairs = {(a, b) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(70)) if a < b}
    longest = {}
    for a in sorted({a for a, _ in pairs}, reverse=True):
        for x, b in pairs:
            if x == a:
                longest[a, b] = max(longest.get((a, b), 0), 1)
                for (y, c), n in [*longest.items()]:
                    if y == b:
                        longest[a, c] = max(longest.get((a, c), 0), n + 1)
    schema = "node int, depends_on int"
    got = freshness.upstream_closure(spark.createDataFrame([*pairs, *list(pairs)[:5], (1, None)], schema))
    assert {(r.node, r.upstream): r.depth for r in got.collect()} == longest
    with pytest.raises(ValueError, match="cycle through 7, 8, 9"):
        freshness.upstream_closure(spark.createDataFrame([(6, 7), (7, 8), (8, 9), (9, 7)], schema))
    assert freshness.upstream_closure(spark.createDataFrame([], schema)).count() == 0
