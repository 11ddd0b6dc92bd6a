"""Quality rules as robust multivariate outliers: minimum-covariance-determinant estimates per language and source."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotloom.llm.common import WordTable, mix, per_text, released, ship, text_slices, with_exact_ids
from shotloom.operators.staging import materialize

WINDOW = 5
BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
#: Transformed statistics: symbols, repeated lines, repeated words, upper case, other marks, mean word length.
STATS = 6
#: Share of a group that a concentration step keeps, and rows below which a group uses its language's estimate.
SHARE, LEAST_ROWS = 0.75, 200
#: Concentration steps of every start, and further ones of the start with the least determinant.
FIRST_STEPS, LAST_STEPS, STARTS = 2, 2, 3
#: Distances are counted in bins of this many to a doubling; concentration and the cut lie at a bin edge.
BINS = 8
#: Median and 0.999 quantile of chi-squared with STATS degrees of freedom.
_CHI_MEDIAN, _CHI_FAR = 5.348, 22.458
#: The cut ends the first doubling of squared distance beyond _CHI_FAR that holds at most this share of the judged rows.
GAP_SHARE = 0.002
#: Words that one repeated window covers with its copy, and squared variation of word lengths, for the sampling variances.
_CLUMP, _LENGTH_CV2 = 2 * WINDOW, 0.25
NONE = "(none)"

_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))


def _word_values(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per word: code points, symbols, upper-case letters, other ASCII marks."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    symbol = _SYMBOLS[data]
    mark = ((data > 32) & (data < 48) | (data > 57) & (data < 65) | (data > 90) & (data < 97) | (data > 122) & (data < 127)) & ~symbol
    parts = np.stack([(data & 0xC0) != 0x80, symbol, mark], 1).astype(np.int64)
    sums = np.add.reduceat(parts, np.concatenate(([0], np.cumsum(lens)[:-1])), axis=0) if len(words) else np.zeros((0, 3), np.int64)
    upper = np.fromiter((sum(map(str.isupper, w.decode())) for w in words), np.int64, len(words))
    return np.column_stack([sums[:, :2], upper, sums[:, 2]]), np.zeros(len(words))


def repeat_words(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a WINDOW-word window which the text holds twice or more.

    Windows are compared by 64-bit hashes of their word numbers and their text's number.
    """
    n = len(words)
    out = np.zeros(len(counts), np.int64)
    if n < WINDOW:
        return out
    own = np.repeat(np.arange(len(counts)), counts)
    hashed = mix(own[: n - WINDOW + 1].astype(np.uint64) + np.uint64(1))
    for j in range(WINDOW):
        hashed = mix(hashed * np.uint64(0x9E3779B97F4A7C15) + words[j: n - WINDOW + 1 + j].astype(np.uint64))
    inside = np.flatnonzero(own[: n - WINDOW + 1] == own[WINDOW - 1:])
    _, inverse, many = np.unique(hashed[inside], return_inverse=True, return_counts=True)
    starts = inside[many[inverse] > 1]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    covered = (np.cumsum(edge[:-1]) > 0).astype(np.int64)
    return np.bincount(own, covered, len(counts)).astype(np.int64)


def dup_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and all lines with a word."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines)), len(lines)


def statistics(table: WordTable, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Base counts of each text (columns as in BASE), and its STATS transformed statistics followed by their sampling variances.

    The arcsine of the root of a share of n items varies by 1 / 4n from text to text of one kind, whatever the share.
    """
    words, counts = table.number(texts)
    sums = per_text(table.rows[0][words], counts) if len(words) else np.zeros((len(texts), 4), np.int64)
    lines = np.array([dup_lines(t) for t in texts], np.int64).reshape(-1, 2)
    repeats = repeat_words(words, counts)
    base = np.column_stack([counts, sums[:, 0], sums[:, 1], lines[:, 0], repeats])
    chars = np.maximum(sums[:, 0], 1)
    part = lambda a, b, slack: np.arcsin(np.sqrt(np.clip(a / (b + slack), 0, 1)))
    x = np.column_stack([
        part(sums[:, 1], chars, 20), part(lines[:, 0], lines[:, 1], 3), part(repeats, counts, 10), part(sums[:, 2], chars, 20),
        part(sums[:, 3], chars, 20), np.log((sums[:, 0] + 25) / (counts + 5)),
        *[0.25 / (n + slack) * clump for n, slack, clump in ((chars, 20, 1), (lines[:, 1], 3, 1), (counts, 10, _CLUMP), (chars, 20, 1), (chars, 20, 1))],
        _LENGTH_CV2 / (counts + 5),
    ])
    return base, x


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: _id, _lang, _source, the base counts, and `x`, the transformed statistics."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = WordTable(_word_values)
        for b in batches:
            for lo, hi, texts in text_slices(b["_text"]):
                base, x = statistics(table, texts)
                out = b.iloc[lo:hi][["_id", "_lang", "_source"]].copy()
                for c, name in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")):
                    out[name] = base[:, c]
                out["x"] = list(x)
                yield out

    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), label("lang").alias("_lang"), label("source").alias("_source"))
    return with_exact_ids(rows, run, f"_lang string, _source string, {BASE}, x array<double>")


_PAIRS = [(i, j) for i in range(STATS) for j in range(i, STATS)]


def _distance() -> Column:
    """Squared Mahalanobis distance of `x` by the columns `mean` and `prec` (upper triangle, row by row)."""
    gap = [F.col("x")[i] - F.col("mean")[i] for i in range(STATS)]
    terms = [F.col("prec")[k] * gap[i] * gap[j] * (1.0 if i == j else 2.0) for k, (i, j) in enumerate(_PAIRS)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.greatest(total, F.lit(0.0))


_PARAMS = "g string, start int, mean array<double>, prec array<double>, noise array<double>, logdet double"


def _square(upper: np.ndarray) -> np.ndarray:
    out = np.zeros((STATS, STATS))
    for v, (i, j) in zip(upper, _PAIRS):
        out[i, j] = out[j, i] = v
    return out


def _param(g: str, start: int, mean: np.ndarray, cov: np.ndarray, noise: np.ndarray) -> tuple:
    """The sampling variances join the covariance: no statistic is told apart more finely than texts of one kind vary."""
    full = cov + np.diag(noise)
    inverse = np.linalg.inv(full)
    return g, start, mean, [inverse[i, j] for i, j in _PAIRS], noise, np.linalg.slogdet(full)[1]


def _first(robust: DataFrame) -> DataFrame:
    """STARTS estimates per group about the medians: absolute deviations alone, and with the correlations of signs and of squashed values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for g, mean, mad, noise, sign, squashed in zip(b["g"], b["mean"], b["mad"], b["noise"], b["sign"], b["squashed"]):
                spread = 1.4826 * np.asarray(mad)
                out.append(_param(g, 0, mean, np.diag(spread**2), noise))
                for start, moments in ((1, sign), (2, squashed)):
                    m = _square(moments)
                    size = np.sqrt(np.maximum(np.diag(m), 1e-12))
                    out.append(_param(g, start, mean, m / np.outer(size, size) * np.outer(spread, spread), noise))
            yield pd.DataFrame(out, columns=["g", "start", "mean", "prec", "noise", "logdet"])

    return robust.mapInPandas(released(run), _PARAMS)


def _solve(moments: DataFrame) -> DataFrame:
    """Mean, precision and determinant per group and start from counts, sums and products; one of them is one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for g, start, noise, n, s, p in zip(b["g"], b["start"], b["noise"], b["n"], b["s"], b["p"]):
                mean = np.asarray(s) / n
                out.append(_param(g, start, mean, _square(np.asarray(p) / n) - np.outer(mean, mean), noise))
            yield pd.DataFrame(out, columns=["g", "start", "mean", "prec", "noise", "logdet"])

    return moments.mapInPandas(released(run), _PARAMS)


def _with_group(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Salted join on the group, since one language and source can hold a third of all rows; a group is one row in `params`."""
    salts = 16
    spread = params.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("x", "_id"), F.lit(salts)).cast("int")).join(spread, ["g", "_salt"]).drop("_salt")


def _binned(rows: DataFrame, params: DataFrame) -> DataFrame:
    return _with_group(rows, params).withColumn("bin", _bin(_distance()))


def _bin(distance: Column) -> Column:
    return F.floor(F.log2(distance + 1e-6) * BINS).cast("int")


def _step(rows: DataFrame, params: DataFrame) -> DataFrame:
    """One concentration step of every start: all rows are counted by bin of distance, the nearest SHARE is fitted again."""
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(STATS)] + [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{k}") for k, (i, j) in enumerate(_PAIRS)]
    keys = ["g", "start"]
    bins = materialize(_binned(rows, params).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.any_value("noise").alias("noise"), *sums))
    below = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin")) - F.col("n")
    near = bins.withColumn("_below", below).withColumn("_all", F.sum("n").over(Window.partitionBy(*keys))).filter(F.col("_below") < F.col("_all") * SHARE)
    total = near.groupBy(*keys).agg(
        F.any_value("noise").alias("noise"), F.sum("n").alias("n"),
        F.array(*[F.sum(f"s{i}") for i in range(STATS)]).alias("s"), F.array(*[F.sum(f"p{k}") for k in range(len(_PAIRS))]).alias("p"),
    )
    return materialize(_solve(total))


def concentrated(rows: DataFrame) -> DataFrame:
    """Robust estimate per group `g` over all rows with `x`: g, mean, prec, logdet, scale.

    STARTS first estimates take FIRST_STEPS concentration steps each; the one whose covariance has the least determinant
    takes LAST_STEPS more. A step counts all rows by group, start and bin of distance, with the moments of each bin, and
    refits on the nearest SHARE of the group's rows. Only bins are shuffled, after a partial sum in each task. `scale`
    brings a median distance above that of chi-squared down to it.
    """
    middle = lambda c: F.percentile_approx(c, 0.5, 1000)
    med = materialize(rows.groupBy("g").agg(
        F.array(*[middle(F.col("x")[i]) for i in range(STATS)]).alias("mean"), F.array(*[middle(F.col("x")[STATS + i]) for i in range(STATS)]).alias("noise"),
    ))
    off = [F.abs(F.col("x")[i] - F.col("mean")[i]) for i in range(STATS)]
    mad = materialize(_with_group(rows, med).groupBy("g", "mean", "noise").agg(F.array(*[middle(c) for c in off]).alias("mad")))
    z = [(F.col("x")[i] - F.col("mean")[i]) / F.sqrt((F.col("mad")[i] * 1.4826) ** 2 + F.col("noise")[i]) for i in range(STATS)]
    apart = _with_group(rows, mad).withColumn("z", F.array(*z)).withColumn("_far", F.aggregate("z", F.lit(1e-9), lambda t, v: t + v * v))
    both = lambda one: F.array(*[F.avg(one(i) * one(j)) for i, j in _PAIRS])
    robust = apart.groupBy("g", "mean", "mad", "noise").agg(
        both(lambda i: F.col("z")[i] / F.sqrt("_far")).alias("sign"), both(lambda i: F.tanh(F.col("z")[i])).alias("squashed"),
    )
    params = materialize(_first(robust))
    for _ in range(FIRST_STEPS):
        params = _step(rows, params)
    params = materialize(params.groupBy("g").agg(F.min(F.struct("logdet", "start", "mean", "prec", "noise")).alias("b")).select("g", "b.start", "b.mean", "b.prec", "b.noise", "b.logdet"))
    for _ in range(LAST_STEPS):
        params = _step(rows, params)
    bins = _binned(rows, params).groupBy("g", "bin").count()
    half = bins.withColumn("_below", F.sum("count").over(Window.partitionBy("g").orderBy("bin")) - F.col("count")).withColumn("_all", F.sum("count").over(Window.partitionBy("g")))
    at = half.filter(F.col("_below") < F.col("_all") * 0.5).groupBy("g").agg(F.max("bin").alias("bin"))
    scale = at.select("g", (F.lit(_CHI_MEDIAN) / F.greatest(F.pow(F.lit(2.0), (F.col("bin") + 1) / BINS), F.lit(_CHI_MEDIAN))).alias("scale"))
    return materialize(params.select("g", "mean", "prec", "logdet").join(scale, "g"))


def cut_from_counts(counts: dict[int, int]) -> float:
    """Squared distance that ends the first sparse doubling beyond the chi-squared quantile; `counts` are judged rows per bin.

    The rows below it are the body and its tail. Where nothing lies apart, the tail runs out and hardly a row is beyond.
    """
    total, at = sum(counts.values()), math.ceil(math.log2(_CHI_FAR) * BINS)
    while sum(counts.get(at + k, 0) for k in range(BINS)) > total * GAP_SHARE:
        at += 1
    return 2.0 ** ((at + BINS) / BINS)


def reject_outliers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float | None = None) -> DataFrame:
    """One row per input row: `id_col`, the base counts, base_failed, distance, kept.

    Robust estimates are made for each language and source; a pair with fewer than LEAST_ROWS rows uses the estimate of
    its language, a language with fewer that of all rows. `kept` needs the base rules and a squared distance up to `cut`;
    None takes it from the distances of all rows that pass the base rules (`cut_from_counts`).

    Null text has no words and fails the base rules; null language or source is a value of its own, "(none)". Repeated
    rows get the same answer. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    rows = materialize(measured(docs, id_col, text_col))
    sizes = rows.groupBy("_lang", "_source").agg(F.count("*").alias("n"))
    by_lang = Window.partitionBy("_lang")
    of_lang, every = F.concat(F.lit("l\x1f"), "_lang"), F.lit("all")
    level = sizes.withColumn("_in_lang", F.sum("n").over(by_lang)).select(
        "_lang", "_source",
        F.when(F.col("n") >= LEAST_ROWS, F.concat_ws("\x1f", F.lit("p"), "_lang", "_source")).when(F.col("_in_lang") >= LEAST_ROWS, of_lang).otherwise(every).alias("g"),
        F.explode(F.sequence(F.lit(0), F.lit(15))).alias("_salt"),
    )
    level = materialize(level)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("x", "_id"), F.lit(16)).cast("int"))
    tagged = materialize(salted.join(level, ["_lang", "_source", "_salt"]).drop("_salt"))
    some = level.select("g").distinct()
    wide = tagged.select(F.explode(F.array_distinct(F.array("g", of_lang, every))).alias("g"), "x", "_id").join(some, "g", "left_semi")
    params = concentrated(materialize(wide))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    judged = materialize(_with_group(tagged, params).select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (_distance() * F.col("scale")).alias("distance"),
    ))
    if cut is None:
        cut = cut_from_counts({r["bin"]: r["count"] for r in judged.where(~F.col("base_failed")).groupBy(_bin(F.col("distance")).alias("bin")).count().collect()})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= cut))
