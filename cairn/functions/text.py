"""Scalar text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CJK = "[\\u3400-\\u4dbf\\u4e00-\\u9fff\\u3040-\\u30ff\\uac00-\\ud7af]"
PLACEHOLDERS = ("n/a", "na", "无", "未知", "待补充", "todo", "tbd", "???")
AXIS_NOISE = " \t\r\n.,;:!?、，。；：！？「」『』（）()【】[]{}<>《》…—～~·|/\\\"@#$%^&*+=_`'’‘“”"
REPO_HOSTS = ("github.com", "gitlab.com", "gitee.com")


def units(text: Column) -> Column:
    """Information units: every CJK, kana or hangul character and every run of word characters is one."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(t, F.lit(CJK)) + F.regexp_count(t, F.lit("[A-Za-z0-9_]+"))


def fewer_units(text: Column, least: int) -> Column:
    """Whether a text has fewer than ``least`` units. No beginning of a text has more units than the whole, so a long text is mostly not read to its end."""
    return (units(F.substring(text, 1, 20 * least)) < least) & (units(text) < least)


def is_blank(text: Column) -> Column:
    """Null, white space or a placeholder."""
    words = "|".join(re.escape(x) for x in PLACEHOLDERS)
    return F.coalesce(text, F.lit("")).rlike(rf"(?i)\A[ \t\r\n\x0B\f]*+(?:{words})?+[ \t\r\n\x0B\f]*+\z")  # no text is read beyond its first other word


def grams(text: Column) -> Column:
    """All overlapping three-character pieces in order, repeats included. Linear in the length of the text."""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), 1)


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a stripped text in order of appearance; none under three characters."""
    return F.array_distinct(grams(F.btrim(text, F.lit(" \t\r\n\x0b\x0c"))))


def axis_signature(text: Column, literal_letters: bool = False) -> Column:
    """What is left of a text without punctuation and space, in lower case. ``literal_letters`` also strips r and q before lowering."""
    noise = AXIS_NOISE + ("rq" if literal_letters else "")
    return F.lower(F.translate(F.coalesce(text, F.lit("")), noise, ""))


def normalised_code(code: Column) -> Column:
    """Stripped non-empty lines without those that only mark an omission."""
    lines = F.transform(F.split(F.coalesce(code, F.lit("")), "\r\n|\r|\n"), lambda x: F.btrim(x, F.lit(" \t")))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(//|#|--|/\*)?\s*(\.\.\.|…)\s*(\*/)?$")), "\n")


def h2_sections(markdown: Column) -> Column:
    """The sections of a Markdown text that begin with a second-level heading, each with its heading."""
    parts = F.split(F.coalesce(markdown, F.lit("")), "(?m)^(?=## )")
    return F.transform(F.filter(parts, lambda x: F.startswith(x, F.lit("## "))), lambda x: F.btrim(x, F.lit(" \r\n\t")))


def slug(text: Column) -> Column:
    s = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unnamed"))


def repo_parts(url: Column, hosts: tuple[str, ...] = REPO_HOSTS) -> Column:
    """(host, owner, name) of an https or scp-style repository address on an allowed host, else null."""
    u = F.btrim(F.coalesce(url, F.lit("")))
    web, scp = r"^https://([^/]+)/([^/]+)/([^/?#]+?)(?:[.]git)?/?$", r"^(?:[\w.-]+@)?([\w.-]+):([^/]+)/(.+?)(?:[.]git)?$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(u, web, i), F.lit("")), F.nullif(F.regexp_extract(u, scp, i), F.lit("")))
    host = F.lower(part(1))
    return F.when(host.isin(*hosts) & part(3).isNotNull(), F.struct(host.alias("host"), part(2).alias("owner"), part(3).alias("name")))


def repo_id(parts: Column) -> Column:
    return F.when(parts.isNotNull(), F.concat_ws("__", *[parts.getField(k) for k in ("host", "owner", "name")]))


def hostname(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1)), F.lit(""))


def normalised_url(url: Column) -> Column:
    """Without fragment, query, final slash and .git, in lower case."""
    u = F.regexp_replace(F.lower(F.btrim(F.coalesce(url, F.lit("")))), "[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(u, "/+$", ""), "[.]git$", "")


def pointer_token(text: Column) -> Column:
    """A key as a token of a JSON pointer."""
    return F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def first_sentence(text: Column, limit: int = 80) -> Column:
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n"))
    return F.substring(F.regexp_extract(t, r"^([^.!?。！？\n]*[.!?。！？]?)", 1), 1, limit)


def excerpt(text: Column, limit: int = 240) -> Column:
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n"))
    return F.when(F.char_length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("…"))).otherwise(t)


def clean_tags(tags: Column) -> Column:
    """Lower-case tags of letters, digits and ._-, each once, in order."""
    cleaned = F.transform(tags, lambda x: F.btrim(F.regexp_replace(F.lower(x), "[^a-z0-9._-]+", "-"), F.lit("-._")))
    return F.array_distinct(F.filter(cleaned, lambda x: x.isNotNull() & (x != "")))


def card_anchor(card_id: Column) -> Column:
    """f<i>-c<j> of an id that ends with _<i>_<j>, else null."""
    at = lambda i: F.regexp_extract(card_id, r"_([0-9]+)_([0-9]+)$", i)
    return F.when(at(2) != "", F.concat(F.lit("f"), at(1), F.lit("-c"), at(2)))


def short_hash(*parts: Column, length: int = 16) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, length)


def chunk_id(kind: str, ref: Column, ordinal: Column | None = None) -> Column:
    return F.concat_ws("~", F.lit(kind), ref.cast("string"), *([ordinal.cast("string")] if ordinal is not None else []))


def json_flag(document: Column, path: str) -> Column:
    """Whether a JSON text holds true or 1 at the path; malformed JSON holds nothing."""
    return F.coalesce(F.get_json_object(document, path).isin("true", "1"), F.lit(False))
