"""Texts as columns: cleaning, statistics, entities, document numbers, dates, pages, kinds of files."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rules
from .rules import FLAGS


def once(c: Column, of: Callable[[Column], Column]) -> Column:
    """of(c), for which c is computed once a row, however often `of` names it."""
    return F.element_at(F.transform(F.array(c), of), 1)


def _normal_form(form: str):
    @F.pandas_udf(T.StringType())
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize(form, x), na_action="ignore")

    return normal


def normal_form(c: Column, form: str = "NFC") -> Column:
    """Unicode normal form. ASCII texts, which it leaves alone, don't leave the JVM."""
    return F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(_normal_form(form)(F.when(~c.rlike(r"^\p{ASCII}*$"), c)))


def sanitize(c: Column) -> Column:
    """T1. No NUL, line ends as \\n, at most three in a row, NFC, trimmed; null is empty."""
    c = F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "\0", ""), "\r\n?", "\n")
    return F.regexp_replace(normal_form(F.regexp_replace(c, "\n{4,}", "\n\n\n")), r"^\s+|\s+$", "")


def text_stats(c: Column) -> dict[str, Column]:
    """T2. Characters, words, lines and paragraphs; zeros for null or empty."""
    c = F.coalesce(c, F.lit(""))
    some = F.length(c) > 0
    count = lambda pattern: F.size(F.filter(F.split(c, pattern), lambda x: F.length(F.regexp_replace(x, r"\s", "")) > 0))
    return {"characters": F.length(c), "words": count(r"\s+"), "lines": F.when(some, F.size(F.split(c, "\n"))).otherwise(0), "paragraphs": count(r"\n\s*\n")}


def truncate(c: Column, most: int) -> Column:
    """T2. At most so many characters, the last three being dots where something was cut."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def html_to_text(c: Column) -> Column:
    """T3. Line ends for <br> and ends of blocks, other tags out, six entities, squeezed blanks."""
    c = F.regexp_replace(c, r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr)>", "\n")
    c = F.regexp_replace(c, "<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n\s*\n\s*\n+", "\n\n"))


def decode_entities(c: Column) -> Column:
    """T4. &amp; first, so double-encoded entities decode too; names keep their case."""
    c = F.regexp_replace(c, "&amp;|&#38;", "&")
    return reduce(lambda c, x: F.regexp_replace(c, "|".join(f"&{n};" for n in x[1]), x[0]), rules.ENTITIES.items(), c)


def session_code(year: Column) -> Column:
    """T7. The two-character code of a parliament session: a letter and a base-36 digit, H8 for 2020."""
    index = year.try_cast("int") - 2020 + 7 * 36 + 8
    letter = F.char(F.lit(65) + F.floor(index / 36).cast("int"))
    return F.when((index >= 0) & (index < 26 * 36), F.concat(letter, F.upper(F.conv((index % 36).cast("string"), 10, 36))))


def document_number(c: Column) -> Column:
    """T7. struct(number, evidence) of the first kind of number that a text has; nulls without one."""
    return once(decode_entities(F.coalesce(c, F.lit(""))), _document_number)


def _document_number(text: Column) -> Column:
    part = lambda kind, i: F.regexp_extract(text, "(?i)" + rules.NUMBERS[kind], i)
    has = lambda kind: text.rlike("(?i)" + rules.NUMBERS[kind])
    glue = lambda kind, form: F.when(has(kind), F.struct(F.format_string(form, *(part(kind, i + 1) for i in range(form.count("%s")))).alias("number"), F.lit(kind).alias("evidence")))
    code = session_code(part("bet_pattern", 1))
    bet = F.when(has("bet_pattern") & code.isNotNull(), F.struct(F.concat(code, F.lit("01"), part("bet_pattern", 3)).alias("number"), F.lit("bet_pattern").alias("evidence")))
    dossier = F.when(has("dossier_pattern"), F.struct(F.concat(F.initcap(part("dossier_pattern", 1)), part("dossier_pattern", 2), F.lit("/"), part("dossier_pattern", 3)).alias("number"), F.lit("dossier_pattern").alias("evidence")))
    return F.coalesce(bet, glue("sou_pattern", "SOU %s:%s"), glue("dir_pattern", "Dir. %s:%s"), glue("prop_pattern", "Prop. %s/%s:%s"), glue("ds_pattern", "Ds %s:%s"), glue("fpm_pattern", "%s:FPM%s"), dossier)


def normal_number(c: Column) -> Column:
    """T8. A number for comparison: trimmed, upper case, single blanks, one blank behind a dot."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), r"\s+", " "), r"\.\s*", ". ")


def swedish_date(c: Column) -> Column:
    """T9. struct(date, precision): ISO dates, "7 april 2025", "den 7 april 2025" (day), "i april 2025" (month, the 1st)."""
    return once(F.lower(F.coalesce(c, F.lit(""))), _swedish_date)


def _swedish_date(low: Column) -> Column:
    months = "|".join(rules.MONTHS)
    number = lambda name: F.array_position(F.array(*map(F.lit, rules.MONTHS)), name).cast("int")
    iso = F.try_to_timestamp(F.nullif(F.regexp_extract(low, r"\b(\d{4}-\d{2}-\d{2})\b", 1), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")
    full = rf"(?:^|\D)(\d{{1,2}})\s+({months})\s+(\d{{4}})"
    short = rf"\b({months})\s+(\d{{4}})"
    text = lambda y, m, d: F.try_to_timestamp(F.format_string("%s-%02d-%s", y, m, F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    day = F.when(low.rlike(full), text(F.regexp_extract(low, full, 3), number(F.regexp_extract(low, full, 2)), F.regexp_extract(low, full, 1)))
    month = F.when(low.rlike(short), text(F.regexp_extract(low, short, 2), number(F.regexp_extract(low, short, 1)), F.lit("1")))
    of = lambda x, p: F.when(x.isNotNull(), F.struct(x.alias("date"), F.lit(p).alias("precision")))
    return F.coalesce(of(iso, "day"), of(day, "day"), of(month, "month"))


def estimate_page(text: Column, excerpt: Column, per_page: int = 2_500) -> Column:
    """T10. The page that an excerpt's place points to, from 1; null where the text lacks it."""
    place = F.instr(text, excerpt)
    return F.when(place > 0, (F.floor((place - 1) / per_page) + 1).cast("int"))


def file_kind(url: Column, text: Column | None = None) -> Column:
    """T11. pdf, excel, word or other, by the URL's ending, else by the words of the link."""
    low = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), "[?#].*$", ""))
    by = lambda c, marks: c.rlike(marks)
    out = F.when(by(low, r"\.pdf$"), "pdf").when(by(low, r"\.xlsx?$"), "excel").when(by(low, r"\.(docx?|odt|rtf)$"), "word")
    if text is not None:
        words = F.lower(F.coalesce(text, F.lit("")))
        out = out.when(by(words, r"\bpdf\b"), "pdf").when(by(words, r"\b(excel|xlsx?)\b"), "excel").when(by(words, r"\b(word|docx?)\b"), "word")
    return out.otherwise("other")


def link_kind(url: Column, anchor: Column) -> dict[str, Column]:
    """T6. reference_type, target_number, confidence, external, external_type of a link."""
    low, words = F.lower(F.coalesce(url, F.lit(""))), F.coalesce(anchor, F.lit(""))
    outside = F.when(low.rlike("/pressmeddelanden/|/press/"), "press_release").when(low.rlike(r"\.(zip|rar|tar\.gz)$"), "document_bundle").when(~low.rlike(r"regeringen\.se|riksdagen\.se"), "external")
    named = reduce(lambda c, x: c.when(words.rlike(FLAGS + x[0]), x[1]), rules.ANCHORS, F.when(F.lit(False), "")).otherwise("related")
    kind = lambda name: low.rlike("(?i)" + rules.DOCUMENT_URLS[name])
    placed = F.when(kind("proposition"), "based_on").when(kind("directive") | kind("sou"), "cites").otherwise("related")
    number = document_number(url)["number"]
    some = named != "related"
    sure = F.when(number.isNotNull() & some, "high").when(number.isNull() & ~some, "low").otherwise("medium")
    inside = outside.isNull()
    return {
        "reference_type": F.when(inside, F.when(some, named).otherwise(placed)).otherwise("related"),
        "target_number": F.when(inside, number), "confidence": F.when(inside, sure).otherwise("low"), "external": ~inside, "external_type": outside,
    }


def embedding_input(summary: Column, aim: Column, keywords: Column, most: int = 1_800) -> Column:
    """T22. What an embedding is made of: a marker, the summary, the aim and the keywords, cut."""
    return F.substring(F.concat(F.lit("passage: "), F.concat_ws(" ", summary, aim, F.concat_ws(", ", keywords))), 1, most)


def focus_text(text: Column, doc_type: Column) -> Column:
    """T23. The part of a document that says most: by type its first 5,000, 15,000 or 10,000 characters, of bills also the end."""
    bill = F.concat(F.substring(text, 1, 15_000), F.lit("\n"), F.right(text, F.lit(10_000)))
    return F.when(doc_type.isin("proposition", "prop"), F.when(F.length(text) > 25_000, bill).otherwise(text)).when(doc_type.isin("directive", "dir"), F.substring(text, 1, 5_000)).when(doc_type == "sou", F.substring(text, 1, 15_000)).otherwise(F.substring(text, 1, 10_000))
