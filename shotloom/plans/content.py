"""Queries over text, tags, JSON and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..functions import jsontext as js
from ..functions import nested
from ..functions import numbers as num
from ..functions import tags as tg
from ..functions import text as tx
from ..operators import calls as cl
from ..operators import cards
from ..operators import ocr
from . import oracle as o
from . import views as v
from .registry import query


def docs(spark, d):
    return v.table(spark, d, "documents")


def lines(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "ln"))


LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)"


@query("compact_text", f"SELECT doc_id, {o.compact('text', 120)} AS short_text, {o.compact('text', 280)} AS long_text FROM documents")
def _(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", tx.compact_text(t, 120).alias("short_text"), tx.compact_text(t, 280).alias("long_text"))


@query("clean_text", f"SELECT doc_id, {o.clean('text')} AS text FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", tx.clean_text(F.col("text")).alias("text"))


MARKED = "(CASE i % 6 WHEN 0 THEN '- ' WHEN 1 THEN '12) ' WHEN 2 THEN '第 3 章：' WHEN 3 THEN '三、' WHEN 4 THEN '`## ' ELSE '' END || ln || CASE i % 2 WHEN 0 THEN ' *-' ELSE '' END)"


@query("clean_title", f"WITH {LINES} SELECT doc_id, i, {o.title(MARKED)} AS title FROM l")
def _(spark, d):
    marked = F.expr(MARKED.replace("`##", "`##"))
    return lines(spark, d).select("doc_id", "i", tx.clean_title(marked).alias("title"))


@query("title_tokens", f"""
  WITH {LINES}, h AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '视频 内容提取 ' ELSE '' END || ln AS t FROM l WHERE i = 0)
  SELECT doc_id, unnest({o.title_words('t')}) AS token FROM h""")
def _(spark, d):
    t = F.concat(F.when(F.col("doc_id") % 3 == 0, "视频 内容提取 ").otherwise(""), F.col("ln"))
    return lines(spark, d).where("i = 0").select("doc_id", F.explode(F.array_distinct(tx.title_tokens(t))).alias("token"))


GENERIC_CASE = "CASE doc_id % 5 WHEN 0 THEN 'overview' WHEN 1 THEN 'Part ' || doc_id WHEN 2 THEN ' 小节 ' WHEN 3 THEN '  ' ELSE left(text, 12) END"


@query("is_generic_title", f"""
  SELECT doc_id, (t = '' OR lower(t) IN ({o.GENERIC}) OR starts_with(lower(t), 'part ') OR starts_with(lower(t), 'section ')) AS generic
  FROM (SELECT doc_id, {o.clean(GENERIC_CASE)} AS t FROM documents)""")
def _(spark, d):
    return docs(spark, d).select("doc_id", tx.is_generic_title(F.expr(GENERIC_CASE)).alias("generic"))


@query("slug", """
  SELECT c_custkey, coalesce(nullif(trim(regexp_replace(trim(' ' || replace(c_name, '#', ' / ') || '._'), '[^A-Za-z0-9._-]+', '_', 'g'), '._-'), ''), 'video') AS slug FROM customer""")
def _(spark, d):
    c = F.concat(F.lit(" "), F.replace(F.col("c_name"), F.lit("#"), F.lit(" / ")), F.lit("._"))
    return v.table(spark, d, "customer").select("c_custkey", tx.slug(c).alias("slug"))


@query("extract_tag", f"""
  SELECT page_id, {o.strip("nullif(regexp_extract(html, '(?is)<\\s*h1(?:\\s+[^>]*)?\\s*>(.*?)<\\s*/\\s*h1\\s*>', 1), '')")} AS h1,
   {o.strip("nullif(regexp_extract(html, '(?is)<\\s*title(?:\\s+[^>]*)?\\s*>(.*?)<\\s*/\\s*title\\s*>', 1), '')")} AS title FROM pages""")
def _(spark, d):
    c = F.col("html")
    return v.table(spark, d, "pages").select(
        "page_id", F.nullif(tg.extract_tag(c, "H1"), F.lit("")).alias("h1"), F.nullif(tg.extract_tag(c, "title"), F.lit("")).alias("title")
    )


@query("explode_tags", f"""
  SELECT page_id, n AS tag_ord, nullif(regexp_extract(a, '(?i)href\\s*=\\s*"([^"]*)"', 1), '') AS href, {o.strip('b')} AS body FROM (
    SELECT page_id, unnest(regexp_extract_all(html, '(?is)<\\s*a([^>]*)>(.*?)<\\s*/\\s*a\\s*>', 1)) AS a,
      unnest(regexp_extract_all(html, '(?is)<\\s*a([^>]*)>(.*?)<\\s*/\\s*a\\s*>', 2)) AS b,
      generate_subscripts(regexp_extract_all(html, '(?is)<\\s*a([^>]*)>(.*?)<\\s*/\\s*a\\s*>', 1), 1) AS n FROM pages)""")
def _(spark, d):
    got = tg.explode_tags(v.table(spark, d, "pages").select("page_id", "html"), "html", "a")
    return got.select("page_id", "tag_ord", F.nullif(F.col("attrs")["href"], F.lit("")).alias("href"), "body")


LIST_SRC = "CASE page_id % 4 WHEN 0 THEN '<X>- a' || page_id || chr(10) || '2) b' || chr(10) || '- a' || page_id || '</X>' WHEN 1 THEN '<x>`c`, d；e| c、' || page_id || '</x>' WHEN 2 THEN '<X>None</X>' ELSE html END"


@query("tag_list", """
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a' || page_id || '|b' WHEN 1 THEN 'c|d|e|' || page_id ELSE '' END AS items FROM pages""")
def _(spark, d):
    src = F.expr(LIST_SRC.replace("chr(10)", "char(10)"))
    return v.table(spark, d, "pages").select("page_id", F.array_join(tg.tag_list(src, "X"), "|").alias("items"))


@query("resolve_choice", """
  SELECT DISTINCT l_partkey, CASE l_partkey % 4 WHEN 0 THEN 'kf/' || l_partkey || '_b.jpg' WHEN 1 THEN 'kf/' || l_partkey || '_b.jpg' ELSE 'kf/' || l_partkey || '_a.jpg' END AS chosen,
   l_partkey % 4 = 2 AS fell_back FROM lineitem""")
def _(spark, d):
    p = v.table(spark, d, "lineitem").select("l_partkey").distinct()
    a = F.concat(F.lit("kf/"), "l_partkey", F.lit("_a.jpg"))
    b = F.concat(F.lit("kf/"), "l_partkey", F.lit("_b.jpg"))
    k = F.col("l_partkey") % 4
    said = F.when(k == 0, F.concat(F.lit("`"), b, F.lit("` "))).when(k == 1, F.concat("l_partkey", F.lit("_b.jpg"))).when(k == 2, "x.jpg").otherwise("None")
    r = tg.resolve_choice(said, F.array(a, b))
    return p.select("l_partkey", r["chosen"].alias("chosen"), r["fell_back"].alias("fell_back"))


@query("has_flag_tag", "SELECT page_id, page_id % 3 = 0 AS keep FROM pages")
def _(spark, d):
    c = F.concat("html", F.when(F.col("page_id") % 3 == 0, "< keep / >").when(F.col("page_id") % 3 == 1, "<KEEP>").otherwise(""))
    return v.table(spark, d, "pages").select("page_id", tg.has_flag_tag(c, "KEEP").alias("keep"))


@query("split_refs", f"""
  SELECT doc_id, count(*) AS n, string_agg(p, '|' ORDER BY i) AS refs FROM (
    SELECT doc_id, trim(p, '"''`') AS p, i FROM (SELECT doc_id, unnest(s) AS p, generate_subscripts(s, 1) AS i FROM (
      SELECT doc_id, regexp_split_to_array(text, {o.lit('(?:[,，、;；]|' + tx.WS + ')+')}) AS s FROM documents))) WHERE p <> '' GROUP BY doc_id""")
def _(spark, d):
    got = docs(spark, d).select("doc_id", tx.split_refs(F.col("text")).alias("r")).where(F.size("r") > 0)
    return got.select("doc_id", F.size("r").alias("n"), F.array_join("r", "|").alias("refs"))


@query("keyword_rank", o.with_views("v_card_keys", "SELECT video_id, ord, token, n, rank FROM v_card_keys WHERE rank <= 6"))
def _(spark, d):
    t = v.texts(spark, d)
    k = tx.ranked_keywords(tx.words(F.col("text")), 6)
    return t.select("video_id", "ord", F.posexplode(k).alias("p", "k")).select(
        "video_id", "ord", F.col("k.token").alias("token"), (-F.col("k.neg_count")).alias("n"), (F.col("p") + 1).alias("rank")
    )


@query("keyword_rank_library", f"""
  WITH w AS (SELECT source AS video_id, unnest({o.words('text')}) AS token FROM documents), c AS (SELECT video_id, token, count(*) AS n FROM w GROUP BY ALL)
  SELECT video_id, token, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, length(token), token) AS rank FROM c) WHERE rank <= 20""")
def _(spark, d):
    from ..operators.cards import keyword_rank

    return keyword_rank(docs(spark, d).select(F.col("source").alias("video_id"), "text"), 20)


@query("ordered_distinct", f"""
  WITH {LINES} SELECT doc_id, t AS item, min(i) AS first_at FROM (SELECT doc_id, i, {o.clean('ln')} AS t FROM l) WHERE t <> '' GROUP BY ALL""")
def _(spark, d):
    got = docs(spark, d).select("doc_id", tx.ordered_distinct(F.split("text", "\n")).alias("items"), F.transform(F.split("text", "\n"), tx.clean_text).alias("all"))
    return got.select("doc_id", F.explode("items").alias("item"), "all").select(
        "doc_id", "item", (F.array_position("all", F.col("item")) - 1).alias("first_at")
    )


@query("drop_placeholder_topics", o.with_views("v_card_lists", f"""
  SELECT video_id, ord, array_to_string(list_filter(list_concat(['visual', '', '总结'], topic_tags), lambda x: x <> '' AND x NOT IN ({o.PLACEHOLDERS})), '|') AS topics FROM v_card_lists"""))
def _(spark, d):
    t = v.texts(spark, d).select("video_id", "ord", tx.keywords(F.col("text"), 3).alias("k")).where(F.size("k") > 0)
    items = F.concat(F.array(F.lit("visual"), F.lit(""), F.lit("总结")), "k")
    return t.select("video_id", "ord", F.array_join(tx.drop_placeholders(items), "|").alias("topics"))


@query("jaccard", o.with_views("v_card_lists", f"""
  SELECT a.video_id, a.ord, {o.rnd('''CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 ELSE len(list_intersect(x, y))::DOUBLE / greatest(1, len(list_distinct(list_concat(x, y)))) END''', 6)} AS similarity
  FROM (SELECT l.video_id, l.ord, list_distinct(l.key_entities) AS x, list_distinct(coalesce(m.key_entities, []::VARCHAR[])) AS y FROM v_card_lists l LEFT JOIN v_card_lists m ON m.video_id = l.video_id AND m.ord = l.ord + 1) a"""))
def _(spark, d):
    t = v.texts(spark, d).select("video_id", "ord", tx.keywords(F.col("text"), 4).alias("x")).where(F.size("x") > 0)
    nxt = t.select("video_id", (F.col("ord") - 1).alias("ord"), F.col("x").alias("y"))
    got = t.join(nxt, ["video_id", "ord"], "left").withColumn("y", F.coalesce("y", F.array().cast("array<string>")))
    return got.select("video_id", "ord", num.round_at(tx.jaccard(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("clamp_score", f"""
  SELECT event_id, CASE WHEN event_type = 'error' THEN 0.5 ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, (value - 10) / 10)) END AS score
  FROM (SELECT event_id, event_type, floor(value) AS value FROM events)""")
def _(spark, d):
    x = F.format_string("score is %.1f of 1", (F.floor("value") - 10) / 10.0)
    return v.events(spark, d).select("event_id", num.score_from_text(F.when(F.col("event_type") == "error", "no idea").otherwise(x), 0.5).alias("score"))


@query("importance", f"""
  SELECT doc_id, {o.rnd('least(0.9::DOUBLE, greatest(0.15::DOUBLE, 0.25::DOUBLE + least(n, 180) / 260.0::DOUBLE))', 3)} AS text_only,
   {o.rnd('least(0.95::DOUBLE, greatest(CASE WHEN k > 0 THEN 0.85::DOUBLE WHEN n > 0 THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END, 0.25::DOUBLE + k * 0.08::DOUBLE + least(n, 160) / 320.0::DOUBLE))', 3)} AS with_ocr
  FROM (SELECT doc_id, doc_id % 9 AS k, length({o.strip('text')}) AS n FROM documents)""")
def _(spark, d):
    t, k = tx.strip(F.col("text")), F.col("doc_id") % 9
    return docs(spark, d).select(
        "doc_id", num.round_at(num.text_importance(t), 3).alias("text_only"), num.round_at(num.ocr_importance(t, k), 3).alias("with_ocr")
    )


HEADED = "CASE doc_id % 3 WHEN 0 THEN '## ' || t || ' ' || chr(10) || chr(10) || text WHEN 1 THEN t || chr(10) || text ELSE text END"


@query("strip_repeated_heading", f"""
  SELECT doc_id, {o.strip('text')} AS body FROM documents""")
def _(spark, d):
    t = F.lit("Repeated title")
    body = F.expr(HEADED.replace("chr(10)", "char(10)").replace(" t ", " 'Repeated title' "))
    return docs(spark, d).select("doc_id", tx.strip_repeated_heading(body, t).alias("body"))


@query("markdown_inline_strip", """
  SELECT doc_id, 'see x * y and site bold more word ' || doc_id || ' end ' || i AS plain FROM (SELECT doc_id, doc_id % 7 AS i FROM documents)""")
def _(spark, d):
    src = F.concat(
        F.lit("see `x * y` and [site](https://a.example/b) **bold** __more__ *word* "), F.col("doc_id"), F.lit(" _end_ "), F.col("doc_id") % 7
    )
    return docs(spark, d).select("doc_id", tx.inline_plain(src).alias("plain"))


@query("plain_text_corpus")
def _(spark, d):
    return docs(spark, d).select("doc_id", tx.inline_plain(F.col("text")).alias("plain"))


@query("relativize_paths", """
  SELECT page_id, CASE WHEN starts_with(url, 'http://') THEN substring(url, 8) ELSE url END AS inside,
   CASE page_id % 3 WHEN 0 THEN '/data/p1/' || substring(url, 9) WHEN 1 THEN '/abs/' || page_id END AS resolved FROM pages""")
def _(spark, d):
    k = F.col("page_id") % 3
    path = F.when(k == 0, F.substring("url", 9, 10000)).when(k == 1, F.concat(F.lit("/abs/"), "page_id")).otherwise("")
    return v.table(spark, d, "pages").select(
        "page_id", tx.relativize(F.col("url"), F.lit("http:/")).alias("inside"), tx.resolve(path, F.lit("/data/p1")).alias("resolved")
    )


@query("coerce", """
  SELECT event_id, CASE event_type WHEN 'error' THEN 7.5 WHEN 'view' THEN 7.5 ELSE value END AS num,
    CASE WHEN event_type = 'view' THEN 3 ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS whole,
    CASE event_type WHEN 'click' THEN true WHEN 'signup' THEN false WHEN 'purchase' THEN true ELSE true END AS flag FROM events""")
def _(spark, d):
    t = F.col("event_type")
    raw = F.when(t == "error", "n/a").when(t == "view", "NaN").otherwise(F.col("value").cast("string"))
    whole = F.when(t == "view", "3.x").otherwise(F.get_json_object("props", "$.k"))
    flag = F.when(t == "click", " Yes").when(t == "signup", "OFF").when(t == "purchase", "1").otherwise("maybe")
    return v.events(spark, d).select(
        "event_id", num.to_double(raw, 7.5).alias("num"), num.to_int(whole, 3).alias("whole"), num.to_bool(flag, True).alias("flag")
    )


@query("error_category", """
  SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'timeout' WHEN 1 THEN 'http' WHEN 2 THEN 'network' WHEN 3 THEN 'parse_or_contract' WHEN 4 THEN 'contract' WHEN 5 THEN 'empty_output'
    WHEN 6 THEN NULL ELSE CASE WHEN contains(lower(text), 'timeout') OR contains(lower(text), 'timed out') THEN 'timeout' WHEN contains(lower(text), 'http') THEN 'http'
      WHEN contains(lower(text), 'urlopen') OR contains(lower(text), 'connection') OR contains(lower(text), 'network') THEN 'network'
      WHEN contains(lower(text), 'json') OR contains(lower(text), 'parse') OR contains(lower(text), 'tag') THEN 'parse_or_contract'
      WHEN contains(lower(text), 'missing') OR contains(lower(text), 'required') THEN 'contract' WHEN contains(lower(text), 'empty') THEN 'empty_output'
      WHEN text = '' THEN NULL ELSE 'unknown' END END AS category FROM documents""")
def _(spark, d):
    said = ["Read timed out (http)", "HTTP 500 connection", "urlopen failed: tag", "bad JSON, missing", "field required, empty", "Empty answer", ""]
    k = F.col("doc_id") % 8
    msg = F.col("text")
    for i, s in enumerate(said):
        msg = F.when(k == i, s).otherwise(msg)
    return docs(spark, d).select("doc_id", tx.error_category(msg).alias("category"))


# --- JSON ------------------------------------------------------------------------

DAMAGED = """CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```'
  WHEN 2 THEN replace(props, '}', ',}') WHEN 3 THEN 'Answer: ' || props || ' done' ELSE left(props, length(props) - 1) END"""


def damaged(spark, d):
    return v.table(spark, d, "events").select("event_id", F.expr(DAMAGED.replace("chr(10)", "char(10)")).alias("c"))


@query("repair_json", """
  SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'ok' WHEN 4 THEN 'failed' ELSE 'fixed' END AS status,
    CASE WHEN event_id % 5 < 4 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS k FROM events""")
def _(spark, d):
    r = js.repaired_json(F.col("c"))
    return damaged(spark, d).select("event_id", r.alias("r")).select(
        "event_id", F.col("r.status").alias("status"), F.get_json_object("r.text", "$.k").cast("bigint").alias("k")
    )


@query("json_valid", "SELECT event_id, event_id % 5 = 0 AS valid FROM events")
def _(spark, d):
    return damaged(spark, d).select("event_id", js.json_valid(F.col("c")).alias("valid"))


PROPS2 = """CASE event_type WHEN 'view' THEN '{"shot_id":"s' || event_id || '","text":"","warnings":["a","b"]}'
  WHEN 'click' THEN '{"text":"t","merged_summary":null,"shot_id":""}' WHEN 'error' THEN '[1, 2]' ELSE props END"""


@query("required_keys", """
  SELECT event_id, CASE event_type WHEN 'view' THEN 'merged_summary' WHEN 'click' THEN '' WHEN 'error' THEN '<root_object>' ELSE 'shot_id,merged_summary' END AS missing FROM events""")
def _(spark, d):
    e = v.table(spark, d, "events").select("event_id", F.expr(PROPS2).alias("c"))
    return e.select("event_id", F.array_join(js.missing_keys(F.col("c"), ["shot_id", "merged_summary"]), ",").alias("missing"))


@query("contract_check", """
  SELECT CAST(user_id AS VARCHAR) AS path, CASE WHEN count(m) > 0 THEN 'failed' ELSE 'passed' END AS status, count(m) AS n_missing, min(m) AS first_missing FROM (
    SELECT user_id, unnest(CASE event_type WHEN 'view' THEN ['line_' || event_id || ':merged_summary'] WHEN 'click' THEN [NULL] WHEN 'error' THEN ['line_' || event_id || ':<root_object>']
     ELSE ['line_' || event_id || ':shot_id', 'line_' || event_id || ':merged_summary'] END) AS m FROM events) GROUP BY user_id""")
def _(spark, d):
    from ..operators.qa import contract_check

    rows = v.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("line_no"), F.expr(PROPS2).alias("line")
    )
    rep, gaps = contract_check(rows, ["shot_id", "merged_summary"])
    first = gaps.groupBy("path").agg(F.min("missing").alias("first_missing"))
    return rep.join(first, "path", "left").select("path", "status", "n_missing", "first_missing")


@query("canonical_hash", """
  SELECT event_id, canonical, sha256(canonical) AS sha256 FROM (SELECT event_id, CASE event_type WHEN 'view' THEN '{"shot_id":"s' || event_id || '","text":"","warnings":["a","b"]}'
    WHEN 'click' THEN '{"merged_summary":null,"shot_id":"","text":"t"}' WHEN 'error' THEN '[1,2]' ELSE replace(props, ' ', '') END AS canonical FROM events)""")
def _(spark, d):
    return v.table(spark, d, "events").select("event_id", js.canonical(F.expr(PROPS2)).alias("canonical"), js.canonical_hash(F.expr(PROPS2)).alias("sha256"))


@query("payload_profile", """
  SELECT event_id, CASE event_type WHEN 'view' THEN 'shot_id,text,warnings' WHEN 'click' THEN 'merged_summary,shot_id,text' WHEN 'error' THEN '' ELSE 'k' END AS top_keys,
    CASE event_type WHEN 'view' THEN length(event_id::VARCHAR) + 46 WHEN 'click' THEN 47 WHEN 'error' THEN 5 ELSE length(props) - 1 END AS n_bytes,
    CASE event_type WHEN 'view' THEN 'warnings:2' ELSE '' END AS list_counts,
    CASE event_type WHEN 'view' THEN 'text' WHEN 'click' THEN 'merged_summary,shot_id' ELSE '' END AS empty_fields,
    CASE event_type WHEN 'view' THEN 2 ELSE 0 END AS warnings FROM events""")
def _(spark, d):
    e = v.table(spark, d, "events").select("event_id", F.expr(PROPS2).alias("c"))
    c = F.col("c")
    blank = lambda x: F.coalesce(F.array_join(x, ","), F.lit(""))
    return e.select(
        "event_id", blank(js.top_level_keys(c)).alias("top_keys"), F.octet_length(js.canonical(c)).alias("n_bytes"),
        blank(js.list_counts(c)).alias("list_counts"), blank(js.empty_fields(c)).alias("empty_fields"), js.warning_count(c).alias("warnings"),
    )


@query("redact", """
  SELECT event_id, '{"Api_Key":"***redacted***","n":1,"my_password":"***redacted***","k":"' || event_type || '"}' AS safe FROM events""")
def _(spark, d):
    raw = F.expr("""'{"Api_Key": "sk-' || event_id || ',\\\\"x", "n": 1, "my_password": ' || event_id || ', "k": "' || event_type || '"}'""")
    return nested.redact_payloads(v.table(spark, d, "events").select("event_id", raw.alias("safe")), "safe")


@query("redact_long_text", """
  SELECT doc_id, CASE WHEN length(text) > 2000 THEN rtrim(left(text, 2000), chr(32)) || '... [truncated chars=' || length(text) || ' sha256=' || sha256(text) || ']' ELSE text END AS safe FROM documents""")
def _(spark, d):
    return docs(spark, d).select("doc_id", js.trim_long(F.col("text"), 2000).alias("safe"))


@query("redact_nested", """
  SELECT doc_id, '{"a":{"secret_id":"***redacted***","b":[{"Password":"***redacted***","v":' || doc_id || ',"l":[[{"Bearer_x":"***redacted***"},null,true]]}]},"authorization":"***redacted***","u":{"redacted":true,"reason":"image_base64","data_url_prefix":"data:image/png;base64","chars":'
    || (22 + length(lang) * 2) || ',"sha256":"' || sha256('data:image/png;base64,' || lang || lang) || '"},"t":"'
    || CASE WHEN length(w) > 500 THEN rtrim(left(w, 500), ' ') || '... [truncated chars=' || length(w) || ' sha256=' || sha256(w) || ']' ELSE w END || '"}' AS safe
  FROM (SELECT doc_id, lang, regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g') AS w FROM documents)""")
def _(spark, d):
    w = F.array_join(F.regexp_extract_all("text", F.lit("[A-Za-z0-9 ]+"), F.lit(0)), "")
    raw = F.concat(
        F.lit('{"a":{"secret_id":{"x":[1,{"y":"z"}]},"b":[{"Password":["p",null],"v":'), F.col("doc_id").cast("string"),
        F.lit(',"l":[[{"Bearer_x":null},null,true]]}]},"authorization":{"k":["Bearer q"]},"u":"data:image/png;base64,'), "lang", "lang", F.lit('","t":"'), w, F.lit('"}'),
    )
    return nested.redact_payloads(docs(spark, d).select("doc_id", raw.alias("safe")), "safe", 500)


@query("usage_fields", """
  SELECT event_id, CASE WHEN event_type <> 'error' THEN event_id % 1000 END AS total_tokens, CASE WHEN event_type = 'view' THEN 'stop' WHEN event_type <> 'error' THEN 'length' END AS finish_reason FROM events""")
def _(spark, d):
    raw = F.expr("""CASE event_type WHEN 'error' THEN 'oops' ELSE '{"usage":{"total_tokens":' || (event_id % 1000) || '},"choices":[{"finish_reason":"' ||
      CASE event_type WHEN 'view' THEN 'stop' ELSE 'length' END || '"}]}' END""")
    return cl.usage_fields(v.table(spark, d, "events").select("event_id", raw.alias("response"))).select("event_id", "total_tokens", "finish_reason")


@query("usage_object", """
  SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN '{"completion_tokens":' || (event_id % 7) || ',"total_tokens":' || (event_id % 1000) || '}' END AS usage, NULL::BIGINT AS prompt_tokens,
    CASE WHEN event_type IN ('view', 'click') THEN event_id % 7 END AS completion_tokens, CASE WHEN event_type IN ('view', 'click') THEN event_id % 1000 END AS total_tokens,
    CASE event_type WHEN 'view' THEN 'stop' WHEN 'purchase' THEN 'length' END AS finish_reason FROM events""")
def _(spark, d):
    raw = F.expr("""CASE event_type WHEN 'error' THEN 'oops' WHEN 'signup' THEN '[1]' WHEN 'purchase' THEN '{"usage":null,"choices":[{"finish_reason":"length"},{"finish_reason":"stop"}]}'
      ELSE '{"usage":{"total_tokens":' || (event_id % 1000) || ',"completion_tokens":' || (event_id % 7) || '},"choices":' || CASE event_type WHEN 'view' THEN '[{"finish_reason":"stop"}]' ELSE '[]' END || '}' END""")
    return cl.usage_fields(v.table(spark, d, "events").select("event_id", raw.alias("response"))).drop("response")


@query("render_value", """
  SELECT event_id, CASE event_type WHEN 'view' THEN 'k=' || regexp_extract(props, '([0-9]+)', 1) || '; list=a, b; o=x=1; deep=p=q=r=s=' || event_id || '; on=True' WHEN 'click' THEN 'a, b, c, False' ELSE 'plain text' END AS rendered,
   CASE WHEN event_type = 'error' THEN 'none' ELSE event_type || ', x' END AS joined FROM events""")
def _(spark, d):
    raw = F.expr("""CASE event_type WHEN 'view' THEN '{"k":' || get_json_object(props, '$.k') || ',"list":["a"," b "],"none":"","o":{"x":1},"deep":{"p":{"q":{"r":{"s":' || event_id || '}}}},"on":true}'
      WHEN 'click' THEN '["a","",["b",[["c",null]]],false]' ELSE ' plain  text ' END""")
    items = F.when(F.col("event_type") == "error", F.array(F.lit(" "))).otherwise(F.array("event_type", F.lit(""), F.lit(" x ")))
    return v.table(spark, d, "events").select("event_id", nested.render_value(raw).alias("rendered"), tx.plain_join(items).alias("joined"))


# --- recognised text and boxes -----------------------------------------------------


@query("explode_ocr", """
  SELECT event_id, ord, text FROM (SELECT event_id, 1 AS ord, event_type AS text FROM events
   UNION ALL SELECT event_id, 2, 'n' || event_id FROM events WHERE value > 10
   UNION ALL SELECT event_id, CASE WHEN value > 10 THEN 3 ELSE 2 END, 'inner text' FROM events
   UNION ALL SELECT event_id, CASE WHEN value > 10 THEN 4 ELSE 3 END, 'last' FROM events
   UNION ALL SELECT event_id, CASE WHEN value > 10 THEN 5 ELSE 4 END, 'in lists ' || event_id FROM events
   UNION ALL SELECT event_id, CASE WHEN value > 10 THEN 6 ELSE 5 END, 'eight down ' || event_id FROM events)""")
def _(spark, d):
    raw = F.expr("""'[{"res":{"rec_texts":[" ' || event_type || ' ","n' || event_id || '","' || event_type || '"],"rec_scores":[0.9,' ||
      CASE WHEN value > 10 THEN '0.8' ELSE '0.2' END || ',0.7],"data":{"items":[{"text":"inner  text"}]}}},{"rec_text":"last","rec_score":0.6},{"rec_text":"low","rec_score":0.1},
      [[[{"rec_text":"in lists ' || event_id || '"}]]],{"res":{"data":{"items":{"result":{"ocr_result":{"overall_ocr_res":{"res":[{"label":"eight down ' || event_id || '"}]}}}}}}}]'""")
    e = v.table(spark, d, "events").select("event_id", raw.alias("result"))
    return ocr.explode_ocr(e, ["event_id"], "result", 0.5)


def boxes(spark, d):
    """Sixteen boxes per image from the embedding components, on a 1920 x 1080 page."""
    def corner(i, off, size):
        return F.floor((F.get("embedding", i * 4 + off).cast("double") + 0.5) * size).cast("double")

    one = lambda i: bx.flat_bounds(F.array(corner(i, 0, 1920), corner(i, 1, 1080), corner(i, 2, 1920), corner(i, 3, 1080)))
    return v.table(spark, d, "embeddings").select("vec_id", "label", F.transform(F.sequence(F.lit(0), F.lit(15)), one).alias("boxes"))


BOXES = """
  raw AS (SELECT vec_id, label, i, floor((CAST(embedding[i * 4 + 1] AS DOUBLE) + 0.5) * 1920) AS a, floor((CAST(embedding[i * 4 + 2] AS DOUBLE) + 0.5) * 1080) AS b,
     floor((CAST(embedding[i * 4 + 3] AS DOUBLE) + 0.5) * 1920) AS c, floor((CAST(embedding[i * 4 + 4] AS DOUBLE) + 0.5) * 1080) AS d FROM embeddings, range(16) t(i)),
  bx AS (SELECT vec_id, label, i, least(a, c) AS x0, least(b, d) AS y0, greatest(a, c) AS x1, greatest(b, d) AS y1 FROM raw)"""


def flat(spark, d):
    b = boxes(spark, d).select("vec_id", "label", F.posexplode("boxes").alias("i", "b"))
    return b.select("vec_id", "label", "i", "b.*", "b")


@query("polygon_bounds", f"WITH {BOXES} SELECT vec_id, i, x0, y0, x1, y1 FROM bx")
def _(spark, d):
    b = flat(spark, d)
    pts = F.array(F.array("x1", "y0"), F.array("x0", "y1"), F.array("x0", "y0"), F.array(F.lit(5.0)))
    return b.select("vec_id", "i", bx.polygon_bounds(pts).alias("p")).select("vec_id", "i", "p.*")


@query("whole_frame_box", f"""WITH {BOXES} SELECT vec_id, i, (x1 - x0) * (y1 - y0) >= w * h * 0.75::DOUBLE AND x1 - x0 >= w * 0.85::DOUBLE AND y1 - y0 >= h * 0.55::DOUBLE AS whole
  FROM (SELECT *, 300.0::DOUBLE AS w, 150.0::DOUBLE AS h FROM bx)""")
def _(spark, d):
    return flat(spark, d).select("vec_id", "i", bx.whole_frame(F.array("b"), F.lit(300.0), F.lit(150.0)).alias("whole"))


OVERLAP_BOX = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"


@query("overlap_ratio", f"""WITH {BOXES}, p AS (SELECT a.vec_id, a.i, {OVERLAP_BOX} AS inter, (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ab
   FROM bx a JOIN bx b ON a.vec_id = b.vec_id AND b.i = a.i + 1)
  SELECT vec_id, i, {o.rnd('CASE WHEN aa + ab - inter = 0 THEN 0 ELSE inter / (aa + ab - inter) END', 6)} AS iou, {o.rnd('CASE WHEN least(aa, ab) = 0 THEN 0 ELSE inter / least(aa, ab) END', 6)} AS small,
   {o.rnd('CASE WHEN greatest(aa, ab) = 0 THEN 0 ELSE inter / greatest(aa, ab) END', 6)} AS large FROM p""")
def _(spark, d):
    pair = F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: F.struct(i.alias("i"), F.get("boxes", i).alias("a"), F.get("boxes", i + 1).alias("b")))
    p = boxes(spark, d).select("vec_id", F.explode(pair).alias("p"))
    a, b = F.col("p.a"), F.col("p.b")
    r = lambda mode: num.round_at(bx.overlap_ratio(a, b, mode), 6)
    return p.select("vec_id", F.col("p.i").alias("i"), r("union").alias("iou"), r("small").alias("small"), r("large").alias("large"))


CLAMPED = "c AS (SELECT vec_id, label, i, greatest(0, least(1000, x0)) AS x0, greatest(0, least(600, y0)) AS y0, greatest(0, least(1000, x1)) AS x1, greatest(0, least(600, y1)) AS y1 FROM bx)"


@query("clamp_box", f"WITH {BOXES}, {CLAMPED} SELECT vec_id, i, x0, y0, x1, y1 FROM c WHERE x1 - x0 >= 24 AND y1 - y0 >= 12")
def _(spark, d):
    return flat(spark, d).select("vec_id", "i", bx.clamp_box(F.col("b"), 1000, 600).alias("c")).where("c is not null").select("vec_id", "i", "c.*")


@query("reading_order", f"""WITH {BOXES} SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY floor(y0 / 40), x0, -((x1 - x0) * (y1 - y0)), i) AS pos, x0, y0, x1, y1
  FROM bx QUALIFY pos <= 10""")
def _(spark, d):
    got = boxes(spark, d).select("vec_id", F.posexplode(bx.reading_order(F.col("boxes"), 10)).alias("p", "b"))
    return got.select("vec_id", (F.col("p") + 1).alias("pos"), "b.*")


@query("dedupe_boxes", f"""WITH RECURSIVE {BOXES}, s AS (SELECT *, (x1 - x0) * (y1 - y0) AS a, row_number() OVER (PARTITION BY vec_id ORDER BY (x1 - x0) * (y1 - y0), i) AS n FROM bx),
  k AS (SELECT vec_id, 1::BIGINT AS n, [{{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] AS kept FROM s WHERE n = 1
   UNION ALL SELECT b.vec_id, b.n, CASE WHEN len(list_filter(kept, lambda q: greatest(0, least(q.x1, b.x1) - greatest(q.x0, b.x0)) * greatest(0, least(q.y1, b.y1) - greatest(q.y0, b.y0)) / greatest(1, b.a) > 0.9)) > 0
     THEN kept ELSE list_append(kept, {{'x0': b.x0, 'y0': b.y0, 'x1': b.x1, 'y1': b.y1}}) END FROM k JOIN s b ON b.vec_id = k.vec_id AND b.n = k.n + 1)
  SELECT vec_id, u.x0, u.y0, u.x1, u.y1 FROM (SELECT vec_id, unnest(kept) AS u FROM k WHERE n = 16)""")
def _(spark, d):
    return boxes(spark, d).select("vec_id", F.explode(bx.dedupe_boxes(F.col("boxes"))).alias("b")).select("vec_id", "b.*")


@query("enclosing_box", f"""WITH {BOXES} SELECT e.vec_id, coalesce(min(x0), 0) AS x0, coalesce(min(y0), 0) AS y0, coalesce(max(x1), 0) AS x1, coalesce(max(y1), 0) AS y1
  FROM embeddings e LEFT JOIN (SELECT * FROM bx WHERE x0 > 1100) b ON b.vec_id = e.vec_id GROUP BY e.vec_id""")
def _(spark, d):
    return ocr.enclosing_box(flat(spark, d).where("x0 > 1100"), v.table(spark, d, "embeddings"), ["vec_id"])


@query("provided_boxes", """
  SELECT page_id, coalesce(min(x0), 0)::DOUBLE AS x0, 0::DOUBLE AS y0, coalesce(max(x0 + w), 0)::DOUBLE AS x1, coalesce(max(y + 1), 0)::DOUBLE AS y1 FROM (
    SELECT page_id, y, length(ln) - length(ltrim(ln, ' ')) AS x0, length(ltrim(ln, ' ')) AS w FROM (
      SELECT page_id, unnest(string_split(html, chr(10))) AS ln, unnest(range(len(string_split(html, chr(10))))) AS y FROM pages)) GROUP BY page_id""")
def _(spark, d):
    def lines(pages):
        """A provider of the user's: one box per line of a page, as wide as its text."""
        box = lambda y, ln: {"x0": float(len(ln) - len(ln.lstrip(" "))), "y0": float(y), "x1": float(len(ln)), "y1": y + 1.0}
        return pages.map(lambda t: [box(y, ln) for y, ln in enumerate(t.split("\n"))] if t is not None else [])

    pages = v.table(spark, d, "pages")
    boxes = cards.with_boxes(pages.select("page_id", "html"), lines, "html").select("page_id", F.inline("boxes"))
    return ocr.enclosing_box(boxes, pages, ["page_id"])


@query("sheet_bounds", """
  SELECT sheet, min(r1) AS min_row, max(r2) AS max_row, min(c1) AS min_col, max(c2) AS max_col FROM (
    SELECT l_suppkey AS sheet, l_partkey + 1 AS r1, l_partkey + 1 AS r2, l_linenumber + 1 AS c1, l_linenumber + 1 AS c2 FROM lineitem WHERE l_tax > 0.02::DOUBLE AND l_partkey + 1 <= 1500
    UNION ALL SELECT s_suppkey, s_nationkey + 1, least(1500, s_nationkey + 1600), 2, 3 FROM supplier
    UNION ALL SELECT s_suppkey, s_nationkey * 100 + 1, s_nationkey * 100 + 1, 12, 12 FROM supplier WHERE s_nationkey * 100 + 1 <= 1500) GROUP BY sheet""")
def _(spark, d):
    li, s = v.table(spark, d, "lineitem"), v.table(spark, d, "supplier")
    cells = li.select(F.col("l_suppkey").alias("sheet"), (F.col("l_partkey") + 1).alias("row"), (F.col("l_linenumber") + 1).alias("col"), F.when(F.col("l_tax") > 0.02, F.col("l_quantity")).alias("value"))
    merges = s.select(F.col("s_suppkey").alias("sheet"), (F.col("s_nationkey") + 1).alias("r1"), (F.col("s_nationkey") + 1600).alias("r2"), F.lit(2).alias("c1"), F.lit(3).alias("c2"))
    images = s.select(F.col("s_suppkey").alias("sheet"), (F.col("s_nationkey") * 100).alias("row0"), F.lit(11).alias("col0"))
    return ocr.sheet_bounds(cells, merges, images, ["sheet"], 1500)
