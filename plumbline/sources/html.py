"""Titles and main text of HTML pages, as cascades of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where a page may hold its title and abstract, best first.
TITLE_TIERS = [
    r"""(?is)<meta[^>]+property=["']og:title["'][^>]+content=["']([^"']*)["']""",
    r"""(?is)<meta[^>]+name=["']citation_title["'][^>]+content=["']([^"']*)["']""",
    r"(?is)<title[^>]*>([^<]*)</title>",
]
SECTION = r"""(?is)<section\b[^>]*\bid=["']abstract["'][^>]*>(.*?)</section>"""
ROLE_PARAGRAPH = r"""(?is)<(\w+)\b[^>]*\brole=["']paragraph["'][^>]*>(.*?)</\1>"""
FULL_DIV = r"""(?is)<div\b(?=[^>]*abstractSection)(?=[^>]*abstractInFull)[^>]*>(.*?)</div>"""
ANY_DIV = r"""(?is)<div\b(?=[^>]*abstractSection)[^>]*>(.*?)</div>"""
PARAGRAPH = r"(?is)<p\b[^>]*>(.*?)(?:</p>|(?=<p\b)|$)"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def unescape(c: Column) -> Column:
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def without_code(html: Column) -> Column:
    """Scripts, styles and comments go first: they may hold text that looks like markup."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->", " ")


def plain(html: Column) -> Column:
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(html, r"(?s)<[^>]+>", " ")), r"\s+", " "))


def title(html: Column) -> Column:
    """The first tier that has one, cut before " | "; '' where none has."""
    found = F.coalesce(*(F.nullif(F.trim(F.regexp_extract(html, t, 1)), F.lit("")) for t in TITLE_TIERS), F.lit(""))
    return F.trim(F.split(unescape(found), r" \| ")[0])


def abstract(html: Column) -> Column:
    """The first tier that has text: paragraphs by role in the abstract's section, paragraphs of the
    abstract's div (the full one first), all text of the section; null where none has.

    Parts that say only "abstract" don't count, and the section's leading "abstract" goes.
    """
    page = without_code(F.coalesce(html, F.lit("")))

    def texts(block: Column, pattern: str, group: int) -> Column:
        parts = F.transform(F.regexp_extract_all(block, F.lit(pattern), F.lit(group)), lambda x: plain(x))
        return F.array_join(F.filter(parts, lambda x: (x != "") & (F.lower(x) != "abstract")), " ")

    section = F.regexp_extract(page, SECTION, 1)
    whole = F.trim(F.regexp_replace(plain(section), "(?i)^abstract", ""))
    tiers = [texts(section, ROLE_PARAGRAPH, 2), texts(F.regexp_extract(page, FULL_DIV, 1), PARAGRAPH, 1), texts(F.regexp_extract(page, ANY_DIV, 1), PARAGRAPH, 1), whole]
    return F.coalesce(*(F.nullif(t, F.lit("")) for t in tiers))


def paragraphs(html: Column) -> Column:
    """Texts of a page's paragraphs, each up to its end or the next one's begin."""
    found = F.regexp_extract_all(without_code(F.coalesce(html, F.lit(""))), F.lit(r"(?is)<p\b[^>]*>(.*?)(?=</p>|<p\b|</article>|$)"), F.lit(1))
    return F.filter(F.transform(found, lambda x: plain(x)), lambda x: x != "")
