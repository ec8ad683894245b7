"""Column functions for titles, texts, names, DOIs and labels.

All are built-in expressions but `nfkc` and `lemmas`, which have no built-in
form and run as Arrow UDFs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Patterns that results depend on.
LATEX = r"\$[^$]*\$"
TAG = r"<[^>]+>"
ARTICLES = r"^(?:on\s+(?:a\s+|an\s+|the\s+)?|a\s+|an\s+|the\s+)+"
ALPHA_WORD = r"(?U)\b[a-z][a-z]+\b"
ANY_WORD = r"(?U)\b\w\w+\b"
LABEL_WORDS, LABEL_PART = 3, 14
LABEL_PREFIXES = ["Topic label:", "Label:", "Topic:", "Topic name:"]
JOINING_WORDS = ["in", "with", "for", "of", "on", "to", "from", "the", "a", "an", "into", "via", "using", "based", "and", "or", "at", "by"]


def _collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def normalize(c: Column, compose: bool = True) -> Column:
    """Lower-case text without LaTeX and tags, white space collapsed; '' for null.

    With compose=False the NFKC step, the only one outside the JVM, is left
    out; the two agree on text that is NFKC already.
    """
    c = F.coalesce(c, F.lit(""))
    c = nfkc(c) if compose else c
    return _collapse(F.lower(F.regexp_replace(F.regexp_replace(c, LATEX, " "), TAG, " ")))


def clean_markup(c: Column) -> Column:
    return _collapse(F.regexp_replace(F.coalesce(c, F.lit("")), TAG, " "))


def clean_author(c: Column, digits: str = "{3,}") -> Column:
    """A name without its numeric suffix."""
    return F.trim(F.regexp_replace(c, rf"\s+\d{digits}$", ""))


def normalize_doi(c: Column) -> Column:
    return F.nullif(F.lower(F.replace(c, F.lit("https://doi.org/"), F.lit(""))), F.lit(""))


def doi_of_links(links: Column) -> Column:
    """The part after doi.org/ of the first link that has one; null otherwise."""
    hit = F.filter(links, lambda x: x.rlike(r"doi\.org/(.+)$"))
    return F.when(F.size(hit) > 0, F.lower(F.regexp_extract(F.get(hit, F.lit(0)), r"doi\.org/(.+)$", 1)))


def first_link(links: Column) -> Column:
    return F.get(F.filter(links, lambda x: x != ""), F.lit(0))


def doi_of_url(c: Column) -> Column:
    """What follows /doi/ in a URL's path, lower-case; null where nothing does."""
    return F.nullif(F.lower(F.trim(F.regexp_extract(c, r"/doi/([^?]*)", 1), F.lit("/"))), F.lit(""))


def loose_key(c: Column, compose: bool = True) -> Column:
    """Normalized text without punctuation and leading articles."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(normalize(c, compose), "[^a-z0-9 ]", " "), " +", " "))
    return F.regexp_replace(plain, ARTICLES, "")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is made once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def inverted_index(words: Column) -> Column:
    """Word -> positions map of a list of words, in the order of the words; null for a null list.

    One sort of (word, position) and one pass over the places where a new word
    begins; nothing leaves the row.
    """

    def runs(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["w"] != F.get(s, i - 1)["w"]))
        return _once(begins, lambda b: F.transform(b, lambda at, k: F.struct(at.alias("a"), F.coalesce(F.get(b, k + 1), F.size(s)).alias("b"))))

    def index(s: Column) -> Column:
        entry = lambda r: F.struct(F.get(s, r["a"])["w"].alias("k"), F.transform(F.slice(s, r["a"] + 1, r["b"] - r["a"]), lambda x: x["p"]).alias("v"))
        none = F.create_map().cast("map<string,array<int>>")
        return F.when(s.isNull(), F.lit(None)).when(F.size(s) > 0, F.map_from_entries(F.transform(runs(s), entry))).otherwise(none)

    return _once(F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("p")))), index)


def inverted_index_text(index: Column) -> Column:
    """Words of a word -> positions map in the order of their positions; null for an empty map."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.isNull().alias("none"), p.alias("p"), e["key"].alias("w")))))
    return _once(F.array_join(F.transform(F.sort_array(pairs), lambda s: s["w"]), " "), lambda t: F.when(t != "", t))


def strong_concepts(concepts: Column, least: float = 0.3) -> Column:
    """Names of concepts with at least this score (null: 0)."""
    return F.transform(F.filter(F.coalesce(concepts, F.array().cast("array<struct<display_name:string,score:double>>")), lambda x: F.coalesce(x["score"], F.lit(0.0)) >= least), lambda x: x["display_name"])


def joined(list_: Column, by: str = "; ") -> Column:
    return F.coalesce(F.array_join(list_, by), F.lit(""))


def author_line(names: Column, most: int = 4) -> Column:
    names = F.filter(F.transform(names, lambda n: clean_author(n, "{4}")), lambda n: n != "")
    line = F.array_join(F.slice(names, 1, most), ", ")
    return F.coalesce(F.when(F.size(names) > most, F.concat(line, F.lit(", et al."))).otherwise(line), F.lit(""))


def short_label(words: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(words, 1, n), " · ")


def split_words(c: Column) -> Column:
    """A comma-joined word list as an array without blanks and repeats."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda w: F.trim(w)), lambda w: w != ""))


def clean_label(c: Column) -> Column:
    """A model's label in at most three capitalised words.

    First line, without quotes, end marks and leading prefixes such as
    "label:", each taken off once and in turn; a single
    run-on word of over 14 letters is cut at its capitals; "and" and "&" go;
    after the cut to three words, joining words go from both ends.
    """
    line = F.trim(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\n")[0])
    line = F.regexp_replace(F.regexp_replace(line, "^[\"'`]+|[\"'`]+$", ""), "[.:;,]+$", "")
    for prefix in LABEL_PREFIXES:
        line = F.trim(F.regexp_replace(line, f"(?i)^{prefix}", ""))
    run_on = ~line.contains(" ") & (F.length(line) > LABEL_PART)
    line = F.when(run_on, F.regexp_replace(line, "(?<=[a-z])(?=[A-Z])", " ")).otherwise(line)
    line = F.regexp_replace(line, r"(?i)\s*&\s*|\s+and\s+", " ")
    kept = F.slice(F.filter(F.split(line, r"\s+"), lambda w: w != ""), 1, LABEL_WORDS)
    joining = F.array(*map(F.lit, JOINING_WORDS))
    # What stays lies between the first and the last word that isn't a joining word.
    place = F.filter(F.transform(kept, lambda w, i: F.when(~F.array_contains(joining, F.lower(w)), i)), lambda p: p.isNotNull())
    first, last = F.array_min(place), F.array_max(place)
    trimmed = F.when(F.size(place) > 0, F.slice(kept, first + 1, last - first + 1)).otherwise(F.array().cast("array<string>"))
    return F.initcap(F.array_join(trimmed, " "))


def bucket(year: Column, width: int = 5) -> Column:
    return (F.floor(year / width) * width).cast("int")


def decade(year: Column) -> Column:
    return F.concat(bucket(year, 10).cast("string"), F.lit("s"))


def previous_decade(d: Column) -> Column:
    return F.concat((F.regexp_extract(d, r"^(\d+)s$", 1).cast("int") - 10).cast("string"), F.lit("s"))


def window_label(start: Column, width: int = 5, last_year: Column | None = None, short: bool = True) -> Column:
    """1975–79, or 1975–1979 with short=False; the last window ends with the data."""
    end = start + width - 1
    end = F.least(end, last_year) if last_year is not None else end
    shown = F.lpad((end % 100).cast("string"), 2, "0") if short else end.cast("string")
    return F.when(end == start, start.cast("string")).otherwise(F.concat(start.cast("string"), F.lit("–"), shown))


def tokens(c: Column, pattern: str = ALPHA_WORD) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(pattern), F.lit(0))


# Shorthand words and their base forms.
SHORTHAND = {"apps": "app", "devs": "dev", "libs": "lib", "repos": "repo", "vms": "vm", "uis": "ui", "guis": "gui", "apis": "api", "ides": "ide", "llms": "llm", "dnns": "dnn", "cnns": "cnn", "rnns": "rnn", "asts": "ast"}
# Words whose base form the rules below would miss.
IRREGULAR = SHORTHAND | {"using": "use", "used": "use", "data": "data", "criteria": "criterion", "analyses": "analysis", "hypotheses": "hypothesis", "children": "child", "people": "people", "series": "series", "species": "species", "wrote": "write", "written": "write", "built": "build", "made": "make", "found": "find", "software": "software"}


def lemma(word: str) -> str:
    """A base form by suffix rules: plural nouns, then -ing and -ed forms.

    No dictionary is at hand, so this stands in for a lexical lemmatizer and
    won't agree with one on every word.
    """
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    if len(word) > 4 and re.search(r"(?:s|x|z|ch|sh)es$", word):
        return word[:-2]
    if len(word) > 3 and word.endswith("s") and not word.endswith(("ss", "us", "is")):
        return word[:-1]
    for end in ("ing", "ed"):
        stem = word[: -len(end)]
        if word.endswith(end) and len(stem) > 2 and re.search("[aeiouy]", stem):
            if len(stem) > 3 and stem[-1] == stem[-2] and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if re.search(r"(?:at|iz|is|us|uc|rv|nc|ag|ur|ibl)$", stem) else stem
    return word


@F.pandas_udf(ArrayType(StringType()))
def lemmas(s: pd.Series) -> pd.Series:
    """Base form of each word of an array; words met before are looked up."""
    known: dict[str, str] = {}

    def of(w: str) -> str:
        if w not in known:
            known[w] = lemma(w)
        return known[w]

    return s.map(lambda ws: [of(w) for w in ws], na_action="ignore")


def cache_key(*parts: Column, length: int | None = None) -> Column:
    """SHA-1 of the parts, or its beginning."""
    key = F.sha1(F.concat(*parts))
    return F.substring(key, 1, length) if length else key


def set_cache_key(values: Column) -> Column:
    """SHA-1 of a list whatever its order."""
    return F.sha1(F.array_join(F.sort_array(values), "|"))


def log_fold_change(share: Column, before: Column, most: float = 2.0) -> Column:
    return F.greatest(F.lit(-most), F.least(F.lit(most), F.log2(share / before)))


def growth_line(state: Column, percent: Column, before: Column) -> Column:
    """What a card says of a topic's growth against the decade before; the wordings are fixed values."""
    line = F.format_string("growth vs %s: %+.0f%% of share", before, percent.cast("double"))
    return F.when(state == "na", "growth: — (no earlier decade)").when(state == "new", F.concat(F.lit("new vs "), before)).otherwise(line)


def text_color(color: Column) -> Column:
    """Black or white, whichever reads better on a #rrggbb or rgb(r, g, b) colour."""
    numbers = F.regexp_extract_all(color, F.lit(r"[\d.]+"), F.lit(0))
    part = lambda i: F.when(color.startswith("#"), F.conv(F.substring(color, 2 * i + 2, 2), 16, 10).cast("double")).otherwise(F.try_element_at(numbers, F.lit(i + 1)).cast("double"))
    return F.when(part(0) * 0.299 + part(1) * 0.587 + part(2) * 0.114 > 140, "#1a1a1a").otherwise("#ffffff")


def rgba(color: Column, alpha: float) -> Column:
    part = lambda i: F.conv(F.substring(color, i, 2), 16, 10)
    return F.concat(F.lit("rgba("), part(2), F.lit(","), part(4), F.lit(","), part(6), F.lit(f",{alpha:g})"))


def escape_html(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def escape_script(c: Column) -> Column:
    """JSON that can stand within a script element."""
    return F.replace(c, F.lit("</"), F.lit("<\\/"))


def percent(c: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", c * 100)


def unit(vector: Column, tiny: float = 1e-9) -> Column:
    """The vector over its length."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / (norm + tiny))


def wrapped(text: str, width: int = 80, lines: int = 6) -> str:
    import textwrap

    cut = textwrap.wrap(text or "", width)
    return "\n".join(cut[:lines]) + (" ..." if len(cut) > lines else "")


def smoothstep(steps: int = 20) -> Column:
    """Points (t, 3t^2 - 2t^3) of a ribbon's edge from 0 to 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.struct((i / steps).alias("t"), (3 * F.pow(i / steps, 2) - 2 * F.pow(i / steps, 3)).alias("s")))
