"""Mixing sources to target weights by iterative proportional fitting over token counts, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotloom.operators.staging import materialize

MARGINS = ("source", "lang", "topic")
#: Target share of a margin's value: its token share to this power, normalised.
POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.9}
#: Share of all tokens that the sample is to hold.
BUDGET = 0.5
ROUNDS = 6
SALTS = 16
SEED = "mix-1"
NONE = "(none)"


def default_topic(text: Column) -> Column:
    """Kind of a text by its marks: license lines, tables, shouting, marked words, else prose."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(t, F.lit("Licensed under")), "license").when(F.contains(t, F.lit(" | ")), "table")
        .when(F.contains(t, F.lit("!!")), "shout").when(F.contains(t, F.lit("***")), "marked").otherwise("prose")
    )


def default_tokens(text: Column) -> Column:
    """Words parted by ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _labelled(docs: DataFrame, id_col: str, text_col: str, topic: Column | None) -> DataFrame:
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    kind = F.coalesce(topic, F.lit(NONE)) if topic is not None else default_topic(F.col(text_col))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
        F.col(text_col).alias("_text"), label("source").alias("source"), label("lang").alias("lang"), kind.alias("topic"),
    )


def rake(cells: DataFrame, powers: dict[str, float] | None = None, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """Cells (source, lang, topic, tokens) with `probability`: the share of a cell's tokens to sample.

    Each round scales the cells to the token target of every source, then language, then topic, and lastly holds each
    cell at the tokens it has, since no document is taken twice. Works on cells, never on documents.
    """
    powers = powers or POWERS
    df = cells.filter("tokens > 0").withColumn("w", F.col("tokens").cast("double"))
    for m in MARGINS:
        raised = F.pow(F.sum("tokens").over(Window.partitionBy(m)).cast("double"), F.lit(powers[m]))
        df = df.withColumn(f"_raised_{m}", raised)
    totals = [df.groupBy(m).agg(F.first(f"_raised_{m}").alias("r")).agg(F.sum("r").alias(f"_sum_{m}")) for m in MARGINS]
    one = df.agg((F.sum("tokens") * F.lit(budget)).alias("_budget"))
    for t in totals:  # one row each
        one = one.join(F.broadcast(t))
    df = materialize(df.join(F.broadcast(one)))
    for _ in range(rounds):
        for m in MARGINS:
            target = F.col("_budget") * F.col(f"_raised_{m}") / F.col(f"_sum_{m}")
            df = df.withColumn("w", F.col("w") * target / F.sum("w").over(Window.partitionBy(m)))
        df = materialize(df.withColumn("w", F.least("w", "tokens")))
    return df.select(*MARGINS, "tokens", F.round(F.col("w") / F.col("tokens"), 6).alias("probability"))


def _with_probability(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Salted join: a cell of a third of all rows is spread over SALTS keys. Spark broadcasts the rates where it measures them small."""
    salted = rates.select(*MARGINS, "probability", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
    drawn = F.conv(F.substring(F.md5(F.concat(F.col("_id"), F.lit("/" + SEED))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    out = rows.join(salted, [*MARGINS, "_salt"], "left").withColumn("probability", F.coalesce("probability", F.lit(1.0)))
    return out.withColumn("kept", drawn < F.col("probability"))


def _rates(rows: DataFrame, powers, budget, rounds) -> DataFrame:
    cells = rows.groupBy(*MARGINS).agg(F.sum(default_tokens(F.col("_text"))).alias("tokens"))
    return rake(materialize(cells), powers, budget, rounds)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None, powers: dict[str, float] | None = None, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: `id_col`, source, lang, topic, n_tokens, probability, kept.

    Token counts are raked to target shares of source, language and topic (`powers`, `budget`), and each document is kept
    with the probability of its cell, drawn from the MD5 of its id, so a repeated job keeps the same documents. Targets
    that need more tokens than a cell has are met as far as it goes.

    Null source, lang or topic is a value of its own, "(none)"; null text has no tokens; cells without tokens are kept
    whole (probability 1). A null id draws as empty text. Rows with equal ids draw alike. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    rows = _labelled(docs, id_col, text_col, topic)
    out = _with_probability(rows, _rates(rows, powers, budget, rounds))
    return out.select(F.col(f"_all.`{id_col}`").alias(id_col), *MARGINS, default_tokens(F.col("_text")).alias("n_tokens"), "probability", "kept")


def sample_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None, powers: dict[str, float] | None = None, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """The documents that `mix` keeps, with all their columns."""
    rows = _labelled(docs, id_col, text_col, topic)
    return _with_probability(rows, _rates(rows, powers, budget, rounds)).filter("kept").select("_all.*")


def oracle_sql(powers: dict[str, float] | None = None, budget: float = BUDGET, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for `mix` over `documents`."""
    powers = powers or POWERS
    ctes = [f"""rows AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
  CASE WHEN contains(coalesce(text, ''), 'Licensed under') THEN 'license' WHEN contains(coalesce(text, ''), ' | ') THEN 'table'
    WHEN contains(coalesce(text, ''), '!!') THEN 'shout' WHEN contains(coalesce(text, ''), '***') THEN 'marked' ELSE 'prose' END AS topic,
  CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents)""",
        "cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM rows GROUP BY ALL HAVING sum(n_tokens) > 0)"]
    for m in MARGINS:
        ctes.append(f"t_{m} AS (SELECT {m}, {budget} * (SELECT sum(tokens) FROM cells) * r / sum(r) OVER () AS target FROM (SELECT {m}, pow(CAST(sum(tokens) AS DOUBLE), {powers[m]}) AS r FROM cells GROUP BY {m}))")
    last = "w0"
    ctes.append("w0 AS (SELECT *, CAST(tokens AS DOUBLE) AS w FROM cells)")
    for k in range(rounds):
        for m in MARGINS:
            ctes.append(f"w{k}_{m} AS (SELECT source, lang, topic, tokens, w * target / sum(w) OVER (PARTITION BY {m}) AS w FROM {last} JOIN t_{m} USING ({m}))")
            last = f"w{k}_{m}"
        ctes.append(f"w{k}_held AS (SELECT source, lang, topic, tokens, least(w, tokens) AS w FROM {last})")
        last = f"w{k}_held"
    ctes.append(f"p AS (SELECT source, lang, topic, round(w / tokens, 6) AS probability FROM {last})")
    draw = f"CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/{SEED}'), 1, 12) AS BIGINT) AS DOUBLE) / {float(1 << 48)}"
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, source, lang, topic, n_tokens, coalesce(probability, 1.0) AS probability, {draw} < coalesce(probability, 1.0) AS kept
FROM rows LEFT JOIN p USING (source, lang, topic)"""
