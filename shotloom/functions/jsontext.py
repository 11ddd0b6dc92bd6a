"""JSON held in text columns: validity, repair, required keys, long texts, profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, let, strip

def json_valid(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def _unfence(c: Column) -> Column:
    t = strip(F.regexp_replace(strip(c), r"^\x{feff}+", ""))
    fence = r"(?is)^```(?:json)?\s*(.*?)\s*```$"
    return F.when(t.rlike(fence), strip(F.regexp_extract(t, fence, 1))).otherwise(t)


def _outer_slice(c: Column) -> Column:
    """Text from the first opening to the last closing brace or bracket."""
    return F.when(
        c.rlike(r"(?s)[{\[].*[}\]]"), F.regexp_extract(c, r"(?s)([{\[].*[}\]])", 1)
    ).otherwise(c)


def repaired_json(c: Column) -> Column:
    """Struct ``(status, text)``: status is ok, fixed or failed; text parses unless failed."""

    def cut(bare: Column) -> Column:
        return let(
            F.regexp_replace(_outer_slice(bare), r",\s*([}\]])", "$1"), lambda t: F.when(json_valid(t), t)
        )

    # Sound text is settled first; the repairs run only for the rest.
    mended = F.when(~json_valid(c), let(_unfence(c), lambda bare: F.when(json_valid(bare), bare).otherwise(cut(bare))))
    return let(
        mended,
        lambda m: F.struct(
            F.when(m.isNotNull(), "fixed").when(json_valid(c), "ok").otherwise("failed").alias("status"),
            F.when(m.isNotNull(), m).when(json_valid(c), c).alias("text"),
        ),
    )


def missing_keys(c: Column, keys: list[str]) -> Column:
    """Required top-level keys that are absent; ``<root_object>`` when the text is no object."""
    have = F.json_object_keys(c)
    return F.when(have.isNull(), F.array(F.lit("<root_object>"))).otherwise(
        F.array_except(F.array(*[F.lit(k) for k in keys]), have)
    )


def canonical(c: Column) -> Column:
    """Sorted-key compact JSON."""
    return F.to_json(F.try_parse_json(c))


def canonical_hash(c: Column) -> Column:
    return F.sha2(canonical(c), 256)


def top_level_keys(c: Column) -> Column:
    return F.sort_array(F.coalesce(F.json_object_keys(c), F.array().cast("array<string>")))


def trim_long(c: Column, limit: int) -> Column:
    """Over-long text: right-trimmed head plus its length and hash."""
    tail = F.concat(F.lit("... [truncated chars="), F.length(c).cast("string"), F.lit(" sha256="), F.sha2(c, 256), F.lit("]"))
    return F.when(F.length(c) > limit, F.concat(F.rtrim(F.substring(c, 1, limit)), tail)).otherwise(c)


def redact_data_url(c: Column) -> Column:
    """Base64 data URLs become ``prefix chars sha256``; other text is unchanged."""
    is_url = c.startswith("data:") & F.substring(c, 1, 128).contains(";base64,")
    return F.when(
        is_url,
        F.to_json(
            F.struct(
                F.lit(True).alias("redacted"),
                F.lit("image_base64").alias("reason"),
                F.substring_index(c, ",", 1).alias("data_url_prefix"),
                F.length(c).alias("chars"),
                F.sha2(c, 256).alias("sha256"),
            )
        ),
    ).otherwise(c)


def preview(c: Column, limit: int = 120) -> Column:
    t = clean_text(c)
    cut = F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("...")))
    return F.nullif(cut, F.lit(""))


def list_counts(c: Column) -> Column:
    """``key:length`` of the list-valued top-level fields, sorted by key."""
    entries = F.map_entries(F.from_json(c, "map<string,string>"))
    lists = F.filter(entries, lambda e: e["value"].startswith("["))
    return F.sort_array(
        F.transform(lists, lambda e: F.concat(e["key"], F.lit(":"), F.json_array_length(e["value"]).cast("string")))
    )


def empty_fields(c: Column) -> Column:
    """First 20 top-level fields holding null, '', [] or {}."""
    entries = F.map_entries(F.from_json(c, "map<string,string>"))
    bare = F.filter(entries, lambda e: e["value"].isNull() | e["value"].isin("", "[]", "{}"))
    return F.slice(F.transform(bare, lambda e: e["key"]), 1, 20)


def warning_count(c: Column) -> Column:
    """Length of a ``warnings`` list; 1 for a non-blank text."""
    w = F.get_json_object(c, "$.warnings")
    return F.when(w.isNull(), 0).when(w.startswith("["), F.json_array_length(w)).when(strip(w) != "", 1).otherwise(0)
