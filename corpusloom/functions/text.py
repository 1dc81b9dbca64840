"""Column expressions for cleaning article text. All are narrow and built-in, none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import config as C

ColumnOrName = Column | str

# A capital letter, then only letters, white space, commas and full stops up to an em dash.
# Anything a longer formulation with separate parts accepts is covered by this single run, and
# with a possessive quantifier the match is linear in the text.
_DATELINE = rf"^[A-Z][A-Za-z{C.WHITESPACE_CLASS},.]++—"
_SENTENCE_GAP = rf"(?<=[.!?])[{C.WHITESPACE_CLASS}]+"


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: ColumnOrName) -> Column:
    """Take Unicode white space off both ends (``trim`` alone only takes off spaces)."""
    return F.btrim(_col(text), F.lit(C.WHITESPACE))


def url_date(url: ColumnOrName) -> Column:
    """The first year/month/day in the URL as a date; NULL where there is none."""
    found = F.regexp_extract(_col(url), C.DATE_IN_URL, 0)
    return F.when(
        found.rlike("^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$"), F.try_to_date(found, "y/M/d")
    )


def url_tail(url: ColumnOrName) -> Column:
    """What follows the last date in the URL; NULL where there is no date."""
    parts = F.split(_col(url), C.DATE_IN_URL)
    return F.when(F.size(parts) > 1, F.element_at(parts, -1))


def news_category(url: ColumnOrName) -> Column:
    """The folders between the date and the last part of the URL, joined by hyphens."""
    folders = F.regexp_replace(url_tail(url), "/?[^/]*$", "")
    return F.btrim(F.translate(folders, "/", "-"), F.lit("-"))


def headline(url: ColumnOrName) -> Column:
    """The last part of the URL without ``.html``, hyphens turned into spaces."""
    last = F.substring_index(url_tail(url), "/", -1)
    return F.translate(F.replace(last, F.lit(".html")), "-", " ")


def remove_dateline(text: ColumnOrName) -> Column:
    """Drop a leading ``WASHINGTON — `` and strip what remains."""
    return strip(F.regexp_replace(_col(text), _DATELINE, ""))


def has_no_cjk(text: ColumnOrName) -> Column:
    """True where the text holds no Hangul, kana or Han character."""
    return ~_col(text).rlike(C.CJK_CLASS)


def blank_sign_up_lists(text: ColumnOrName) -> Column:
    """Empty the text of briefings that are only a sign-up list."""
    text = _col(text)
    return F.when(F.contains(text, F.lit(C.SIGN_UP_SENTENCE)), F.lit("")).otherwise(text)


def remove_underscores(text: ColumnOrName) -> Column:
    """Drop every underscore."""
    return F.replace(_col(text), F.lit("_"))


def clean_text(text: ColumnOrName) -> Column:
    """Dateline, sign-up lists and underscores, in that order."""
    # A dateline has no question mark and so cannot hold the sign-up sentence: testing the text as
    # it is gives the same answer and leaves the dateline to be searched once.
    text = _col(text)
    is_list = F.contains(text, F.lit(C.SIGN_UP_SENTENCE))
    return remove_underscores(F.when(is_list, F.lit("")).otherwise(remove_dateline(text)))


def is_article_start(line: ColumnOrName) -> Column:
    return F.startswith(_col(line), F.lit(C.ARTICLE_PREFIX))


def remove_article_prefix(line: ColumnOrName) -> Column:
    return F.replace(strip(line), F.lit(C.ARTICLE_PREFIX))


def join_lines(lines: ColumnOrName) -> Column:
    """Strip each line, leave out blank ones, join the rest by one space."""
    stripped = F.transform(_col(lines), strip)
    return F.array_join(F.filter(stripped, lambda line: line != ""), " ")


def sentences(text: ColumnOrName) -> Column:
    """The sentences of a text, split after ``.``, ``!`` or ``?`` and white space."""
    return F.split(_col(text), _SENTENCE_GAP)
