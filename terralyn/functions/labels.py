"""Texts of imported attributes as column expressions: exact numbers, readable labels, folded accents, signatures."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The label of an empty value, digits that a double holds, ends of web pages.
NO_LABEL, DIGITS, WEB_ENDS = "(no variety)", 15, r"(?i)\.(html?|php|aspx?|jsp)$"


def _accents() -> tuple[str, str]:
    """Letters of Latin blocks that are a plain letter with marks, and those plain letters."""
    pairs = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x250)}
    pairs = {c: p for c, p in pairs.items() if p != c and p.isascii()}
    return "".join(pairs), "".join(pairs.values())


def folded(text: Column) -> Column:
    """Lower case without accents."""
    letters, plain = _accents()
    return F.lower(F.translate(F.regexp_replace(text, "[̀-ͯ]", ""), letters, plain))


def word_rank(text: Column, words: list[str]) -> Column:
    """The place, from 0, of the first of some words that a name has among its parts; null where it has none."""
    parts = F.split(folded(text), "[^a-z0-9]+")
    return F.array_min(F.filter(F.transform(parts, lambda p: F.array_position(F.array(*map(F.lit, words)), p) - 1), lambda k: k >= 0))


def _rounded(number: Column) -> Column:
    """A finite double to DIGITS digits, without trailing zeros; whole ones as they are."""
    exact = F.format_string(f"%.{DIGITS - 1}e", number).cast("decimal(38, 18)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(exact, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(plain == "-0", "0").otherwise(plain)


def tidy_number(text: Column) -> Column:
    """A number's text without padding, exact: it is rounded only where its fraction holds more digits than a double.

    Blank texts and overflow stars are empty; a text that is no number stays as it is.
    """
    own = F.trim(text)
    shape = r"^([+-]?)(\d*)(?:\.(\d*))?$"
    sign, whole, part = (F.regexp_extract(own, shape, k) for k in (1, 2, 3))
    whole = F.regexp_replace(whole, r"^0+(?=\d)", "")
    whole, part = F.when(whole == "", "0").otherwise(whole), F.regexp_replace(part, "0+$", "")
    body = F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))
    exact = F.when((sign == "-") & body.rlike("[1-9]"), F.concat(F.lit("-"), body)).otherwise(body)
    long = (part != "") & (F.length(F.regexp_replace(F.concat(whole, part), "^0+", "")) > DIGITS)
    double = own.try_cast("double")
    finite = double.isNotNull() & ~F.isnan(double) & (F.abs(double) != float("inf"))
    return F.when((own == "") | own.rlike(r"^\*+$"), "").when(own.rlike(shape) & own.rlike(r"\d"), F.when(long, _rounded(double)).otherwise(exact)).when(finite & own.rlike(r"\d$"), _rounded(double)).otherwise(own)


def tidy_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, "_", " "), r"\s+", " "))


def variety_label(value: Column) -> Column:
    """A readable label of a variety, from a plain text or an address.

    An address whose host has no dot is a namespace: its first part is the variety. Of other addresses the last part counts,
    without a page's ending and a leading number; if it is all lower case its words get capitals, a first word of two or
    three letters wholly.
    """
    own = F.trim(value)
    shape = r"(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)([^?#]*)"
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(own, shape, 1), "^[^@]*@", ""), r":\d+$", "")
    decoded = lambda s: F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)
    parts = F.filter(F.transform(F.split(F.regexp_extract(own, shape, 2), "/"), decoded), lambda s: F.trim(s) != "")
    last = F.regexp_replace(F.element_at(parts, -1), WEB_ENDS, "")
    short = F.regexp_replace(last, r"^\d+[-_.\s]+(?=\S)", "")
    slug = F.when(short != "", short).otherwise(last)
    words = F.transform(F.filter(F.split(slug, r"[-_\s]+"), lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))
    first = F.when((F.size(words) > 1) & words[0].rlike("^[A-Za-z]{2,3}$"), F.upper(words[0])).otherwise(words[0])
    readable = F.when(~slug.rlike("[A-Z]") & slug.rlike("[a-z]"), F.concat_ws(" ", F.array(first), F.slice(words, 2, F.size(words)))).otherwise(slug)
    name = F.when(~F.contains(host, F.lit(".")), F.when(F.size(parts) > 0, parts[0]).otherwise(host)).when(F.size(parts) > 0, readable).otherwise(host)
    label = tidy_text(F.when(own.rlike(shape), name).otherwise(own))
    return F.when((own == "") | own.isNull(), NO_LABEL).when(label == "", own).otherwise(label)


def number_token(x: Column) -> Column:
    """A double's exact text: the shortest that reads back as the same bits, so -0.0 and neighbours differ."""
    return F.concat(F.lit("n"), F.coalesce(x.cast("double").cast("string"), F.lit("null")))


def text_token(s: Column) -> Column:
    """A text behind its length, so that no two lists of tokens read alike."""
    return F.coalesce(F.concat(F.lit("s"), F.length(s).cast("string"), F.lit(":"), s), F.lit("s-"))


def signature(tokens: Column) -> Column:
    """A 128-bit fingerprint of an array of tokens, in their order."""
    return F.md5(F.concat_ws("|", F.size(tokens).cast("string"), tokens))
