"""Values nested to any depth in JSON texts: masking, plain rendering and recognised texts.

A text is cut into tokens, which needs no recursion. Masking works on token columns: one token and its two neighbours tell keys,
scalar values and long texts, inside the row, and a fold over the tokens takes out what a sensitive object or list holds; only of
texts with very many tokens are these put in rows, where running sums of brackets give the levels. Rendering and recognised texts reduce a text from the inside out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..operators.staging import materialize
from ..session import ship
from .jsontext import redact_data_url, trim_long
from .text import clean_text, let

# Keys whose values are masked, the mask, and the fields of a recognition result.
SENSITIVE_KEY_PARTS = ["api_key", "authorization", "access_token", "refresh_token", "secret", "password", "bearer"]
MASK = "***redacted***"
CONTAINER_KEYS = ["res", "ocr_result", "overall_ocr_res", "result", "data", "items"]
TEXT_KEYS = ["text", "transcription", "label"]
#: Characters of a text that a log keeps.
LOG_TEXT_CHARS = 12_000
#: Characters of a nested part that plain rendering keeps.
PART_CHARS = 80
#: Tokens of a text whose sensitive objects and lists are taken out inside the row; longer texts are shuffled.
IN_ROW = 1024

# Two control characters, which no JSON string holds as such, stand for an escaped backslash and an escaped quote.
_HIDDEN = (("\\\\", "\x01"), ('\\"', "\x02"))
_TOKEN = r'"[^"]*"|[{}\[\],:]|[^\s{}\[\],:"]+'
_SCALAR = r"^(true|false|null|NaN|-?Infinity|-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?)$"
#: Neighbours that no JSON has: s string, n other scalar, x anything else.
_MISFIT = r"x|[sn}\]][sn{\[]|[{,\[:][,:]|[,:][}\]]|[{][\[{n\]]|[\[][}]"


def _tokens(c: Column) -> Column:
    for shown, hidden in _HIDDEN:
        c = F.replace(c, F.lit(shown), F.lit(hidden))
    return F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(0))


def _shown(token: Column) -> Column:
    for shown, hidden in reversed(_HIDDEN):
        token = F.replace(token, F.lit(hidden), F.lit(shown))
    return token


def _quoted(text: Column) -> Column:
    return let(F.to_json(F.array(text)), lambda array: F.substring(array, F.lit(2), F.length(array) - 2))


def _value(token: Column) -> Column:
    """Text of a string token."""
    decoded = lambda raw: F.when(raw.contains("\\"), F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>")[0]).otherwise(F.substring(raw, F.lit(2), F.length(raw) - 2))
    return let(_shown(token), decoded)


def _is_key(token: Column) -> Column:
    return token.startswith('"') & F.coalesce(F.lower(_value(token)).rlike("|".join(SENSITIVE_KEY_PARTS)), F.lit(False))


def _fits(c: Column, tokens: Column) -> Column:
    """JSON by its brackets and neighbours, which also settles what a parser refuses (repeated keys, great depth)."""
    kind = lambda t: F.when(t.startswith('"'), "s").when(t.isin(*"{}[],:"), t).when(t.rlike(_SCALAR), "n").otherwise("x")
    many = lambda t: F.size(F.filter(tokens, lambda x: x == t))
    whole = F.get(tokens, F.lit(0)).isin("{", "[") & (many("{") == many("}")) & (many("[") == many("]"))
    return F.when(F.size(tokens) == 1, F.try_parse_json(c).isNotNull()).otherwise(F.coalesce(whole & ~F.array_join(F.transform(tokens, kind), "").rlike(_MISFIT), F.lit(False)))


def _safe_text(text: Column, limit: int) -> Column:
    return let(text, lambda t: let(redact_data_url(t), lambda url: F.when(url != t, url).otherwise(_quoted(trim_long(t, limit)))))


def _walked(c: Column, limit: int) -> Column:
    """struct(json, open, parts: array<struct(tok, safe, open)>): safe forms of all tokens; `open` marks a sensitive object or list."""

    def one(tokens: Column) -> Column:
        def part(t: Column, i: Column) -> Column:
            before, key = F.get(tokens, i - 1), F.get(tokens, i - 2)
            masked = F.when((i > 1) & (before == ":"), _is_key(key)).otherwise(F.lit(False))
            text = t.startswith('"') & F.coalesce(F.get(tokens, i + 1) != ":", F.lit(True))
            safe = F.when(masked, F.lit(f'"{MASK}"')).when(text & ((F.length(t) > limit) | t.startswith('"data:') | t.contains("\\")), _safe_text(_value(t), limit)).otherwise(_shown(t))
            return F.struct(t.alias("tok"), safe.alias("safe"), (masked & t.isin("{", "[")).alias("open"))

        return let(F.transform(tokens, part), lambda parts: F.struct(_fits(c, tokens).alias("json"), F.exists(parts, lambda p: p["open"]).alias("open"), parts.alias("parts")))

    return let(_tokens(c), one)


def _left(parts: Column) -> Column:
    """Safe text of the tokens outside sensitive objects and lists: one fold over a text's tokens, which tells where each of those ends."""
    state = F.struct(F.lit(0).alias("level"), F.lit(None).cast("int").alias("at"), F.array().cast("array<string>").alias("kept"))

    def step(s: Column, p: Column) -> Column:
        opens, closes, inside = p["tok"].isin("{", "["), p["tok"].isin("}", "]"), s["at"].isNotNull()
        return F.struct(
            (s["level"] + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("level"),
            F.when(inside, F.when(~closes | (s["level"] != s["at"]), s["at"])).when(p["open"], s["level"] + 1).alias("at"),
            F.when(inside, s["kept"]).otherwise(F.concat(s["kept"], F.array(p["safe"]))).alias("kept"),
        )

    return F.array_join(F.aggregate(parts, state, step)["kept"], "")


def redact_payloads(df: DataFrame, column: str, limit: int = LOG_TEXT_CHARS) -> DataFrame:
    """`df` with payloads safe to store, as compact JSON: sensitive keys masked whatever they hold, data URLs described, long texts cut.

    Works at every depth and keeps numbers as they are written. Text that is no JSON is one text; text whose brackets and separators
    fit counts as JSON even where a parser refuses it, so nothing stays unmasked for its depth or for repeated keys. Null stays null.
    A sensitive key's object or list is taken out inside the row; texts of more than IN_ROW tokens in which one stands are shuffled,
    once per distinct text.
    """
    # what a text for the shuffle has; the walk then tells. JSON has at most one token between two of these marks.
    likely = F.col(column).rlike(rf"(?i){'|'.join(SENSITIVE_KEY_PARTS)}|\\u") & (F.regexp_count(column, F.lit(r"[{}\[\],:]")) * 2 >= IN_ROW)
    walked = lambda rows: rows.select("*", F.explode(F.array(_walked(F.col(column), limit))).alias("_walk"))  # noqa: E731  a generator, so that what follows does not work it out again
    deep = F.coalesce(F.col("_walk.json") & F.col("_walk.open"), F.lit(False))
    long = F.size("_walk.parts") > IN_ROW
    plain = F.when(F.col("_walk.json"), F.when(F.col("_walk.open"), _left(F.col("_walk.parts"))).otherwise(F.array_join(F.col("_walk.parts.safe"), "")))
    url = redact_data_url(F.col(column))
    flat = walked(df).filter(~(deep & long)).withColumn(column, F.coalesce(plain, F.when(url != F.col(column), url).otherwise(trim_long(F.col(column), limit)))).drop("_walk")
    hard = materialize(walked(df.filter(likely)).filter(deep & long).withColumn("_hash", F.sha2(column, 256)).withColumn("_parts", F.col("_walk.parts")).drop("_walk"))
    tokens = hard.select("_hash", "_parts").dropDuplicates(["_hash"]).select("_hash", F.posexplode("_parts").alias("_pos", "_part")).select("_hash", "_pos", "_part.*")
    step = F.when(F.col("tok").isin("{", "["), 1).when(F.col("tok").isin("}", "]"), -1).otherwise(0)
    whole = Window.partitionBy("_hash").orderBy("_pos")  # one text
    # an opening and a closing bracket have the level of what is between them; what never closes goes to the end
    levels = tokens.withColumn("_step", step).withColumn("_level", F.sum("_step").over(whole) + F.when(F.col("_step") < 0, 1).otherwise(0))
    partner = F.coalesce(F.lead("_pos").over(Window.partitionBy("_hash", "_level", F.col("_step") != 0).orderBy("_pos")), F.lit(2**31 - 1))
    covered = F.max(F.when(F.col("open"), F.col("_end"))).over(whole.rowsBetween(Window.unboundedPreceding, -1))
    left = levels.withColumn("_end", partner).withColumn("_until", covered).filter("_until IS NULL OR _until < _pos")
    texts = left.groupBy("_hash").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "safe"))), lambda p: p["safe"]), "").alias("_safe"))
    joined = hard.join(texts, "_hash").withColumn(column, F.col("_safe")).select(*df.columns)
    return flat.select(*df.columns).unionByName(joined)


def _column(fn: Callable, kind) -> Callable[[Column | str], Column]:
    udf = F.pandas_udf(lambda texts: texts.map(fn), kind)

    def call(c: Column | str) -> Column:
        session = SparkSession.getActiveSession()
        if session is not None:
            ship(session)
        return udf(c)

    return call


class NotJson(ValueError):
    pass


def reduce_json(text: str, scalar: Callable, members: Callable, elements: Callable):
    """A JSON text from the inside out, at any depth: ``scalar(value)`` for the leaves, then ``members({key: reduced})`` of each object and
    ``elements([reduced])`` of each list. Of repeated keys the last counts."""
    try:
        json.loads(text)
    except RecursionError:
        pass  # deeper than the parser goes; the walk below does not nest
    except (TypeError, ValueError):
        raise NotJson from None
    for shown, hidden in _HIDDEN:
        text = text.replace(shown, hidden)
    open_: list[list] = [[]]
    keys: list[list] = [[]]
    for token in _steps(text):
        if token in "{[":
            open_.append([])
            keys.append([])
        elif token in "}]":
            if len(open_) == 1:
                raise NotJson
            inside, names = open_.pop(), keys.pop()
            open_[-1].append(members(dict(zip(names, inside))) if token == "}" else elements(inside))
        elif token.endswith(":"):
            keys[-1].append(_leaf(token[:-1]))
        else:
            open_[-1].append(scalar(_leaf(token)))
    if len(open_) != 1 or len(open_[0]) != 1:
        raise NotJson
    return open_[0][0]


def _steps(text: str) -> Iterator[str]:
    """Tokens without commas; a key carries its colon."""
    last = None
    for m in re.finditer(_TOKEN, text):
        token = m[0]
        if token == ":":
            yield (last or "") + ":"
            last = None
        else:
            if last is not None:
                yield last
            last = None if token == "," else token
    if last is not None:
        yield last


def _leaf(token: str):
    for shown, hidden in reversed(_HIDDEN):
        token = token.replace(hidden, shown)
    return json.loads(token)


def _collapsed(text: str) -> str:
    return " ".join(text.split())


def _part(text: str) -> str:
    """A nested part, white space collapsed and cut to PART_CHARS."""
    text = _collapsed(text)
    return text if len(text) <= PART_CHARS else f"{text[:PART_CHARS - 1].rstrip()}..."


def render_value(c: Column | str) -> Column:
    """Plain text of a JSON text, at any depth: objects ``k=v; ...``, lists ``a, b``, scalars with white space collapsed.

    Nested parts are cut to PART_CHARS characters each. True and false read ``True`` and ``False``, null is empty. Text that
    holds no object or list is collapsed as it stands; null is empty.
    """

    def pairs(inside: dict) -> str:
        shown = {k: _part(v) for k, v in inside.items()}
        return "; ".join(f"{k}={v}" for k, v in shown.items() if v)

    def listed(inside: list) -> str:
        return ", ".join(filter(None, map(_part, inside)))

    def one(text):
        if not isinstance(text, str):
            return ""
        if text.lstrip()[:1] in ("{", "["):
            try:
                return reduce_json(text, lambda v: "" if v is None else _collapsed(str(v)), pairs, listed)
            except NotJson:
                pass
        return _collapsed(text)

    return _column(one, StringType())(c)


class _Found:
    """What a part of a recognition result holds: its texts in reading order, and its elements or its scalar."""

    __slots__ = ("texts", "elements", "scalar")

    def __init__(self, texts=(), elements=None, scalar=None):
        self.texts, self.elements, self.scalar = texts, elements, scalar


def _low(score: _Found | None, least: float) -> bool:
    """Whether a score is a number under `least`; anything else passes."""
    try:
        return score is not None and score.elements is None and float(score.scalar) < least
    except (TypeError, ValueError):
        return False


def recognised_texts(c: Column | str, min_score: float = 0.0) -> Column:
    """Distinct cleaned texts of a recognition result, in reading order, from any depth. Text that is no JSON has none.

    An object gives its scored texts, its single text, its plain texts, and then those of its containers in their fixed order; a list
    gives those of its elements; a string gives itself.
    """

    def leaf(value) -> _Found:
        return _Found((value,) if isinstance(value, str) else (), None, value)

    def listed(inside: list[_Found]) -> _Found:
        return _Found(inside[0].texts if len(inside) == 1 else [t for x in inside for t in x.texts], inside)

    def of_object(inside: dict[str, _Found]) -> _Found:
        out: list[str] = []
        word = lambda x: str(x.scalar or "")
        if (own := inside.get("rec_texts")) and own.elements is not None:
            scores = inside.get("rec_scores")
            scores = scores.elements if scores and scores.elements is not None and min_score > 0 else []
            out += [word(t) for i, t in enumerate(own.elements) if i >= len(scores) or not _low(scores[i], min_score)]
        if (single := inside.get("rec_text")) and isinstance(single.scalar, str) and not (min_score > 0 and _low(inside.get("rec_score"), min_score)):
            out.append(single.scalar)
        out += [word(inside[k]) for k in TEXT_KEYS if k in inside]
        nested = [inside[k].texts for k in CONTAINER_KEYS if k in inside]
        if not out and len(nested) == 1:
            return _Found(nested[0])
        return _Found([*out, *(t for texts in nested for t in texts)])

    def one(text):
        try:
            return list(reduce_json(text, leaf, of_object, listed).texts)
        except NotJson:
            return []

    cleaned = F.transform(_column(one, ArrayType(StringType()))(c), clean_text)
    return F.array_distinct(F.filter(cleaned, lambda t: t != ""))
