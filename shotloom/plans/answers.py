"""Queries over whole planning answers, built from all lines of each document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import answers
from . import views as v
from .registry import query

SHOTS = [f"s{n}" for n in range(1, 8)]


def answer_rows(spark, d, tag: str, head: Column):
    """One answer per document: a block for each line, titled by the line's first word, with ranges, unknown ids and summaries."""
    lines = F.split("text", "\n")

    def block(line: Column, k: Column) -> Column:
        i = k + 1
        refs = F.when(i % 5 == 0, F.lit("zz, y-")).otherwise(F.concat(F.lit("s"), (1 + i % 7).cast("string"), F.lit("-s"), (1 + (i * 3) % 7).cast("string")))
        tail = F.when(i % 2 == 0, F.concat(F.lit(" then <SUMMARY> sum  "), i.cast("string"), F.lit("</SUMMARY>"))).otherwise(F.lit(" none "))
        return F.concat(F.lit(f'<{tag} shots="'), refs, F.lit('">'), F.regexp_extract(line, "[A-Za-z]{3,9}", 0), F.lit(f"</{tag}>"), tail)

    text = F.concat(head, F.array_join(F.transform(lines, block), " "))
    return v.table(spark, d, "documents").select("doc_id", text.alias("response"), F.array(*[F.lit(s) for s in SHOTS]).alias("valid"))


def settled_sql(limit: int, cut: int) -> str:
    """Lines as blocks: which are kept, and up to which line the answer is read."""
    return f"""
  WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
  b AS (SELECT doc_id, lang, i, left(regexp_extract(line, '[A-Za-z]{{3,9}}'), {cut}) AS title, i % 5 = 0 AS bad, least(1 + i % 7, 1 + (i * 3) % 7) AS lo, greatest(1 + i % 7, 1 + (i * 3) % 7) AS hi, count(*) OVER (PARTITION BY doc_id) AS total FROM l),
  f AS (SELECT *, min(i) FILTER (NOT bad) OVER (PARTITION BY doc_id, title) AS first FROM b WHERE title <> ''),
  s AS (SELECT *, CASE WHEN first < i THEN 'duplicate' WHEN bad THEN 'empty' ELSE 'kept' END AS state FROM f),
  n AS (SELECT *, sum(CAST(state = 'kept' AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM s),
  r AS (SELECT * FROM n WHERE k < {limit} OR (k = {limit} AND state = 'kept')),
  g AS (SELECT d.doc_id, d.lang, coalesce(max(r.total), max(len(string_split(d.text, chr(10))))) AS total, count(r.i) FILTER (state = 'kept') AS blocks,
    coalesce(string_agg(title, '|' ORDER BY i) FILTER (state = 'kept'), '') AS titles,
    coalesce(string_agg(array_to_string(['s' || x for x in range(lo, hi + 1)], ','), '|' ORDER BY i) FILTER (state = 'kept'), '') AS shots,
    coalesce(string_agg(CASE WHEN i % 2 = 0 THEN 'sum ' || i ELSE title END, '|' ORDER BY i) FILTER (state = 'kept'), '') AS summaries,
    coalesce(string_agg(CASE state WHEN 'duplicate' THEN '@d:' ELSE '@e:' END || title, '|' ORDER BY i) FILTER (state <> 'kept'), '') AS removed,
    coalesce(bool_or(bad AND state = 'empty'), false) AS unknown
    FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY ALL)"""


def _flat(df, items: str, *fields: str):
    join = lambda name: F.array_join(F.transform(items, lambda b: F.array_join(b[name], ",") if name == "shot_ids" else b[name]), "|")
    return df.select("doc_id", *[c for c in ("status", "mode", "title") if c in df.columns], *[join(f).alias({"title": "titles", "summary": "summaries", "shot_ids": "shots"}[f]) for f in fields], F.array_join("warnings", "|").alias("warnings"))


def _warnings(dup: str, empty: str, unknown: str, many: str, limit: int) -> str:
    parts = f"""CASE WHEN removed <> '' THEN replace(replace(removed, '@d:', '{dup}:'), '@e:', '{empty}:') END, CASE WHEN unknown THEN '{unknown}:zz,y-' END,
      CASE WHEN blocks >= {limit} AND total > {limit} THEN '{many}:' || total END"""
    return f"concat_ws('|', {parts}) AS warnings"


@query("parse_planner_answers", settled_sql(8, 28) + f"""
  SELECT doc_id, CASE WHEN blocks = 0 THEN 'failed' ELSE 'ok' END AS status, lang AS title, titles, summaries, shots,
    {_warnings('duplicate_outline_chapter_removed', 'empty_outline_chapter_removed', 'invalid_outline_shots_removed', 'too_many_outline_chapters_truncated', 8)} FROM g""")
def _(spark, d):
    rows = answer_rows(spark, d, "CHAPTER", F.concat(F.lit("<TITLE>"), "lang", F.lit("</TITLE><DESCRIPTION>x</DESCRIPTION>")))
    return _flat(answers.parse_planner_answers(rows, "response", "valid"), "chapters", "title", "summary", "shot_ids")


@query("parse_subsection_answers", settled_sql(5, 24) + f"""
  SELECT doc_id, CASE WHEN blocks > 0 THEN 'split' WHEN lang = 'en' THEN 'keep' ELSE 'failed' END AS mode, titles, shots,
    {_warnings('duplicate_subsection_removed', 'empty_subsection_removed', 'invalid_subsection_shots_removed', 'too_many_subsections_truncated', 5)} FROM g""")
def _(spark, d):
    rows = answer_rows(spark, d, "SUB", F.when(F.col("lang") == "en", "<KEEP/>").otherwise(""))
    return _flat(answers.parse_subsection_answers(rows, "response", "valid"), "subsections", "title", "shot_ids")


@query("parse_outline_answers", """
  WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
  b AS (SELECT doc_id, i, regexp_extract(line, '[A-Za-z]{3,9}') AS title, CASE WHEN i % 5 = 0 THEN 'zz,y-' WHEN 1 + i % 7 = 1 + (i * 3) % 7 THEN 's' || (1 + i % 7) || '-s' || (1 + i % 7) ELSE 's' || (1 + i % 7) || '-s' || (1 + (i * 3) % 7) END AS refs FROM l),
  n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, title ORDER BY i) AS again FROM b WHERE title <> ''),
  u AS (SELECT doc_id, string_agg(x, ',' ORDER BY ff, pos) AS bad FROM (SELECT doc_id, x, min(i) AS ff, min(pos) AS pos FROM (SELECT doc_id, i, unnest(string_split(refs, ',')) AS x, generate_subscripts(string_split(refs, ','), 1) AS pos FROM n WHERE again = 1) GROUP BY doc_id, x) GROUP BY doc_id),
  k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS no FROM n WHERE again = 1),
  g AS (SELECT doc_id, count(*) AS sections, string_agg(title, '|' ORDER BY i) FILTER (no <= 6) AS titles FROM k GROUP BY doc_id),
  w AS (SELECT doc_id, string_agg('duplicate_section_removed:' || title, '|' ORDER BY i) AS dups FROM n WHERE again > 1 GROUP BY doc_id)
  SELECT d.doc_id, CASE WHEN sections IS NULL THEN 'failed' ELSE 'ok' END AS status, coalesce(titles, '') AS titles,
    concat_ws('|', dups, 'invalid_section_chunks_removed:' || bad, CASE WHEN sections > 6 THEN 'too_many_sections_truncated:' || sections END) AS warnings
  FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN w USING (doc_id)""")
def _(spark, d):
    rows = answer_rows(spark, d, "SECTION", F.concat(F.lit("<THEME>"), "lang", F.lit("</THEME>"))).withColumn("response", F.regexp_replace("response", 'shots="', 'chunks="'))
    return _flat(answers.parse_outline_answers(rows, "response", "valid"), "sections", "title")
