"""Column expressions of the dialect, all inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(text: Column) -> Column:
    """Lower case; letters and digits stay; runs of blank, dash and underscore are one dash; the rest goes."""
    kept = F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd} _-]", "")
    return F.regexp_replace(F.regexp_replace(kept, "[ _-]+", "-"), r"^-|-\z", "")


def class_token(text: Column) -> Column:
    """Lower case; every run of other characters is one dash."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", "-"), r"^-|-\z", "")


def label(text: Column) -> Column:
    """A link label as it is compared: lower case, white space collapsed, without brackets."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, r"^\[+|\]+\z", "")), r"(?U)\s+", " "))


def attr(name: str, attrs: str = "attrs") -> Column:
    """The attribute, or the empty string."""
    return F.coalesce(F.element_at(attrs, name), F.lit(""))


def level() -> Column:
    """Level of a heading, 0 of all else."""
    return F.when(F.col("type") == "Heading", attr("level").cast("int")).otherwise(F.lit(0))


def words(text: Column) -> Column:
    """White-space separated words of a text."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def reading_minutes(count: Column) -> Column:
    return F.when(count == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(count / 200))).cast("int")


def escape_html(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fence_language(info: Column) -> Column:
    """First field of a fence's info, lower case, without braces and dots, underscores as dashes."""
    first = F.lower(F.regexp_extract(info, r"^\s*(\S+)", 1))
    return F.replace(F.regexp_replace(first, r"^\{?\.?|\}\z", ""), F.lit("_"), F.lit("-"))


def direct_media(src: Column) -> Column:
    from quillspark.functions.vocabulary import MEDIA

    return F.lower(F.regexp_replace(src, "[?#].*", "")).rlike(rf"\.({'|'.join(MEDIA)})\z")
