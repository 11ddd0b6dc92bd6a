"""SQL fragments of the fixture views and text rules for the side-by-side check."""

from __future__ import annotations

from ..functions.text import (
    GENERIC_TITLES, PLACEHOLDER_TOPICS, STOP_WORDS, TITLE_PREFIX, TITLE_WORD_PATTERN, WORD_PATTERN, WS,
)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lits(items: list[str]) -> str:
    return ", ".join(lit(i) for i in items)


def strip(e: str) -> str:
    return f"regexp_replace({e}, {lit('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def clean(e: str) -> str:
    return f"trim(regexp_replace(coalesce({e}, ''), {lit(WS + '+')}, ' ', 'g'))"


def cut(t: str, n: int) -> str:
    """Length limit on an already cleaned text column."""
    return f"CASE WHEN length({t}) <= {n} THEN {t} ELSE rtrim(left({t}, {n - 1})) || '...' END"


def compact(e: str, n: int) -> str:
    return cut(clean(e), n)


def title(e: str) -> str:
    return f"trim(trim(regexp_replace({clean(e)}, {lit(TITLE_PREFIX)}, '')), '`#*- ')"


def words(e: str) -> str:
    return (
        f"list_filter(regexp_extract_all({e}, {lit(WORD_PATTERN)}), "
        f"lambda w: lower(w) NOT IN ({lits(STOP_WORDS)}))"
    )


def title_words(e: str) -> str:
    low = f"lower({clean(e)})"
    han = f"array_to_string(regexp_extract_all({low}, {lit('[' + chr(92) + 'x{4e00}-' + chr(92) + 'x{9fff}]')}), '')"
    return (
        f"list_distinct(list_concat(regexp_extract_all({low}, {lit(TITLE_WORD_PATTERN)}), "
        f"list_transform(range(1, length({han})), lambda i: substring({han}, i, 2))))"
    )


def rnd(e: str, d: int) -> str:
    s = f"{10 ** d}::DOUBLE"
    return f"floor(({e}) * {s} + 0.5) / {s}"


PLACEHOLDERS = lits(PLACEHOLDER_TOPICS)
GENERIC = lits([g.lower() for g in GENERIC_TITLES])

EPOCH = "epoch_us(ts) / 1e6"

VIEWS: dict[str, str] = {
    "v_shots": f"""
      SELECT video_id, shot_id, seq, start_sec, end_sec FROM (
        SELECT CAST(user_id AS VARCHAR) AS video_id, 'shot_' || event_id AS shot_id, event_id AS seq, {EPOCH} AS start_sec,
               lead({EPOCH}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS end_sec
        FROM events WHERE event_type = 'view') WHERE end_sec IS NOT NULL""",
    "v_segments": f"""
      SELECT CAST(user_id AS VARCHAR) AS video_id, 'sub_' || event_id AS segment_id, event_id AS seq, {EPOCH} AS start_sec,
             {EPOCH} + value * 3600 AS end_sec, event_type || ' ' || event_id AS text
      FROM events WHERE event_type = 'click'""",
    "v_text": f"""
      SELECT source AS video_id, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ord,
             {clean('text')} AS clean_text
      FROM documents""",
    "v_card_words": f"""
      SELECT video_id, ord, w, count(*) AS n FROM (SELECT video_id, ord, unnest({words('text')}) AS w FROM v_text)
      GROUP BY ALL""",
    "v_card_keys": """
      SELECT video_id, ord, w AS token, n,
             row_number() OVER (PARTITION BY video_id, ord ORDER BY n DESC, length(w), w) AS rank
      FROM v_card_words""",
    "v_card_lists": """
      SELECT video_id, ord, list(token ORDER BY rank) FILTER (rank <= 3) AS topic_tags,
             list(token ORDER BY rank) FILTER (rank <= 4) AS key_entities
      FROM v_card_keys GROUP BY ALL""",
    "v_cards": f"""
      SELECT t.video_id, t.doc_id, t.ord, printf('shot_%03d', t.ord) AS shot_id, 10.0::DOUBLE * t.ord AS start_sec,
             10.0::DOUBLE * t.ord + 8 AS end_sec, t.text AS merged_summary, t.clean_text,
             coalesce(l.topic_tags, ['内容提取']) AS topic_tags, coalesce(l.key_entities, []::VARCHAR[]) AS key_entities,
             CASE WHEN length({strip('t.text')}) > 0 THEN 'explanation' ELSE 'unknown' END AS narrative_role,
             {rnd("least(0.9::DOUBLE, greatest(0.15::DOUBLE, 0.25::DOUBLE + least(length(" + strip('t.text') + "), 180) / 260.0::DOUBLE))", 3)} AS importance_score
      FROM v_text t LEFT JOIN v_card_lists l USING (video_id, ord)""",
    "v_frames": """
      SELECT CAST(label AS VARCHAR) AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx,
             list_transform(e[1:32], lambda x: abs(x) * 255) AS gray,
             list_transform(e[33:64], lambda x: abs(x) * 255) AS edge,
             list_transform(e, lambda x: x * x) AS hist
      FROM (SELECT label, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)""",
    "v_units": """
      SELECT CAST(l_orderkey AS VARCHAR) AS chapter_id, row_number() OVER (PARTITION BY l_orderkey
               ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS ord,
             CAST(l_quantity AS INT) AS shot_count, l_partkey, l_suppkey, l_linenumber
      FROM lineitem""",
    "v_calls": f"""
      SELECT event_id AS call_id, event_type AS function, user_id, {EPOCH} AS time,
             CASE WHEN event_type = 'error' OR value > 20 THEN 'failure' ELSE 'success' END AS status,
             CASE WHEN event_id % 3 = 0 THEN 'provider_call' ELSE 'function_call' END AS record_type,
             value AS elapsed_sec, props AS payload,
             CASE WHEN event_type = 'error' THEN 'Connection reset by peer'
                  WHEN value > 20 THEN 'Request timed out' END AS error
      FROM events""",
}

NEEDS: dict[str, list[str]] = {
    "v_card_words": ["v_text"],
    "v_card_keys": ["v_card_words"],
    "v_card_lists": ["v_card_keys"],
    "v_cards": ["v_text", "v_card_lists"],
}


def with_views(names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause holding the named views and what they need, then ``body``."""
    extra = extra or {}
    done: list[str] = []

    def add(n: str) -> None:
        for d in NEEDS.get(n, []):
            add(d)
        if n not in done:
            done.append(n)

    for n in names.split():
        add(n)
    parts = [f"{n} AS ({VIEWS[n]})" for n in done] + [f"{n} AS ({q})" for n, q in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body

SIZE = 12  # chunk size of the fixtures

VIEWS["v_chunked"] = f"""
  SELECT c.*, n, CASE WHEN p < x * (b + 1) THEN p // (b + 1) ELSE x + (p - x * (b + 1)) // b END + 1 AS chunk_no FROM (
    SELECT *, ord - 1 AS p, n // k AS b, n % k AS x FROM (
      SELECT *, CAST(ceil(n / {SIZE}::DOUBLE) AS BIGINT) AS k FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM v_cards))) c"""
VIEWS["v_chunk_text"] = f"""
  SELECT video_id, chunk_no, count(*) AS card_count, min_by(shot_id, ord) AS first_shot, max_by(shot_id, ord) AS last_shot,
    string_agg(array_to_string(topic_tags, ' '), ' ' ORDER BY ord) AS tag_text,
    string_agg(nullif({strip('merged_summary')}, ''), ' ' ORDER BY ord) AS body,
    list(shot_id ORDER BY importance_score DESC, ord)[1:5] AS important_shots
  FROM v_chunked GROUP BY ALL"""
VIEWS["v_chunk_keys"] = f"""
  SELECT video_id, chunk_no, list(w ORDER BY n DESC, length(w), w)[1:5] AS topics FROM (
    SELECT video_id, chunk_no, w, count(*) AS n FROM (
      SELECT video_id, chunk_no, unnest({words("concat_ws(' ', tag_text, body)")}) AS w FROM v_chunk_text) GROUP BY ALL) GROUP BY ALL"""
VIEWS["v_chunks"] = f"""
  SELECT t.video_id, t.chunk_no, printf('chunk_%03d', t.chunk_no) AS chunk_id, card_count, first_shot, last_shot,
    coalesce(topics, ['视频笔记']) AS main_topics,
    CASE WHEN body IS NULL THEN '该片段没有提取到可用于笔记的文字内容。' ELSE {compact('body', 280)} END AS summary, important_shots
  FROM v_chunk_text t LEFT JOIN v_chunk_keys k ON k.video_id = t.video_id AND k.chunk_no = t.chunk_no"""
VIEWS["v_topics"] = f"""
  SELECT video_id, topic, min(chunk_no * 1000 + pos) AS first_at FROM (
    SELECT video_id, chunk_no, {clean('unnest(main_topics)')} AS topic, generate_subscripts(main_topics, 1) AS pos FROM v_chunks) WHERE topic <> '' GROUP BY ALL"""
VIEWS["v_sections"] = f"""
  SELECT video_id, {compact('t', 28)} AS title, chunk_id, row_number() OVER (PARTITION BY video_id ORDER BY chunk_no) AS section_no FROM (
    SELECT video_id, t, min(chunk_no) AS chunk_no, min(chunk_id) AS chunk_id FROM (
      SELECT video_id, chunk_no, chunk_id, {title('coalesce(nullif(main_topics[1], \'\'), summary)')} AS t FROM v_chunks) WHERE t <> '' GROUP BY ALL)
  QUALIFY section_no <= 6"""
VIEWS["v_final_sections"] = f"""
  SELECT video_id, title, chunk_id, row_number() OVER (PARTITION BY video_id ORDER BY section_no) AS section_no FROM (
    SELECT video_id, title, min(section_no) AS section_no, min_by(chunk_id, section_no) AS chunk_id FROM v_sections
    WHERE title NOT IN ({PLACEHOLDERS}) AND title <> '' GROUP BY ALL)"""
NEEDS.update({
    "v_chunked": ["v_cards"], "v_chunk_text": ["v_chunked"], "v_chunk_keys": ["v_chunk_text"], "v_chunks": ["v_chunk_text", "v_chunk_keys"],
    "v_topics": ["v_chunks"], "v_sections": ["v_chunks"], "v_final_sections": ["v_sections"],
})

# Cards split evenly into three chapters.
VIEWS["v_chapter_cards"] = """
  SELECT c.*, (ord - 1) // per + 1 AS chapter_no, (ord - 1) % per AS pos, count(*) OVER (PARTITION BY video_id, (ord - 1) // per) AS chap_n FROM (
    SELECT *, CAST(ceil(n / 3.0) AS BIGINT) AS per FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM v_cards)) c"""
VIEWS["v_card_tokens"] = f"""
  SELECT video_id, chapter_no, pos, chap_n, list_distinct(list_concat(list_filter(list_concat(topic_tags, key_entities), lambda x: x NOT IN ({PLACEHOLDERS})),
    CASE WHEN narrative_role <> 'unknown' THEN [narrative_role] ELSE [] END)) AS tokens FROM v_chapter_cards"""
VIEWS["v_shift_points"] = """
  SELECT video_id, chapter_no, pos FROM (
    SELECT *, list_distinct(flatten(list(tokens) OVER (PARTITION BY video_id, chapter_no ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))) AS l,
      list_distinct(flatten(list(tokens) OVER (PARTITION BY video_id, chapter_no ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))) AS r FROM v_card_tokens)
  WHERE chap_n >= 6 AND pos >= 2 AND pos < chap_n - 2 AND len(l) > 0 AND len(r) > 0
    AND len(list_intersect(l, r))::DOUBLE / greatest(1, len(list_distinct(list_concat(l, r)))) < 0.25"""
VIEWS["v_shift_next"] = """
  SELECT a.video_id, a.chapter_no, a.pos, min(b.pos) AS nxt FROM v_shift_points a JOIN v_shift_points b ON a.video_id = b.video_id AND a.chapter_no = b.chapter_no AND b.pos > a.pos + 3 GROUP BY ALL"""
VIEWS["v_shift_pick"] = """
  SELECT video_id, chapter_no, min(pos) AS pos FROM v_shift_points GROUP BY ALL
  UNION ALL SELECT p.video_id, p.chapter_no, n.nxt FROM v_shift_pick p JOIN v_shift_next n ON n.video_id = p.video_id AND n.chapter_no = p.chapter_no AND n.pos = p.pos"""
VIEWS["v_metrics"] = """
  SELECT c.video_id, c.chapter_no, c.shot_count, c.duration_sec, coalesce(t.k, 0) AS topic_count, coalesce(s.k, 0) AS shifts, c.thirds AS important_thirds,
    sum(c.shot_count) OVER (PARTITION BY c.video_id) AS video_shots, count(*) OVER (PARTITION BY c.video_id) AS chapter_count FROM (
      SELECT video_id, chapter_no, count(*) AS shot_count, greatest(0, max(end_sec) - min(start_sec)) AS duration_sec,
        count(DISTINCT CASE WHEN importance_score >= 0.7 THEN least(2, pos * 3 // chap_n) END) AS thirds FROM v_chapter_cards GROUP BY ALL) c
  LEFT JOIN (SELECT video_id, chapter_no, count(DISTINCT t) AS k FROM (SELECT video_id, chapter_no, unnest(tokens) AS t FROM v_card_tokens) GROUP BY ALL) t ON t.video_id = c.video_id AND t.chapter_no = c.chapter_no
  LEFT JOIN (SELECT video_id, chapter_no, count(*) AS k FROM v_shift_pick GROUP BY ALL) s ON s.video_id = c.video_id AND s.chapter_no = c.chapter_no"""
NEEDS.update({
    "v_chapter_cards": ["v_cards"], "v_card_tokens": ["v_chapter_cards"], "v_shift_points": ["v_card_tokens"], "v_shift_next": ["v_shift_points"],
    "v_shift_pick": ["v_shift_next"], "v_metrics": ["v_shift_pick"],
})


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)
