"""Column expressions over text.  Every function takes and returns a Column."""

from __future__ import annotations

import html

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from tomewright import fixed as K


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def group(c: Column, pattern: str, n: int = 1) -> Column:
    """Group ``n`` of the first match, null when there is no match or it is empty."""
    return F.nullif(F.regexp_extract(c, pattern, n), F.lit(""))


def ustrip(c: Column) -> Column:
    """Strip Unicode whitespace (``trim`` alone only knows the space)."""
    return F.regexp_replace(c, K.U + rf"^{K.WS}+|{K.WS}+\z", "")


def urstrip(c: Column) -> Column:
    return F.regexp_replace(c, K.U + rf"{K.WS}+\z", "")


def no_space(c: Column) -> Column:
    return F.translate(c, K.WS_CHARS, "")


def lines_of(c: Column) -> Column:
    return F.split(c, "\n", -1)


def first_line(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)


# -- normalisation --------------------------------------------------------
# Characters that NFKC may change or compose with; ASCII and accented Latin letters are
# stable.  One positive class of few ranges: the regex engine tests it some ten times
# faster than the equivalent negated union.
MAY_CHANGE = r"[\x80-\xBF\u0132\u0133\u013F\u0140\u0149\u017F-\x{10FFFF}]"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def nfkc(c: Column) -> Column:
    """NFKC.  Only rows holding characters that may change reach Python."""
    return F.coalesce(_nfkc(F.when(c.rlike(MAY_CHANGE), c)), c)


def squeeze_for_match(c: Column) -> Column:
    """Remove whitespace and quotation marks (``translate`` is far cheaper than a regex)."""
    return F.translate(c, K.WS_CHARS + K.QUOTE_CHARS, "")


def normalize(c: Column) -> Column:
    """Comparison form: NFKC, no whitespace, no quotation marks."""
    return squeeze_for_match(nfkc(c))


def strip_quote_edges(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{K.QUOTE_EDGE}]+|[{K.QUOTE_EDGE}]+\z", "")


def match_segments(norm: Column) -> Column:
    """Pieces between ellipses that are long enough to be searched for."""
    return F.filter(F.split(norm, K.ELLIPSIS, -1), lambda s: F.length(s) >= K.MIN_SEGMENT_CHARS)


def cjk_ratio(c: Column) -> Column:
    head = F.substring(c, 1, K.ENCODING_SAMPLE_CHARS)
    return F.when(F.length(head) > 0,
                  F.length(F.regexp_replace(head, r"[^一-鿿]+", "")) / F.length(head)
                  ).otherwise(F.lit(0.0))


# -- ordered sums inside one array ---------------------------------------
@F.pandas_udf(ArrayType(LongType()))
def sums_before(s: pd.Series) -> pd.Series:
    """Exclusive prefix sums of each array (only integers cross to Python)."""
    def one(a):
        if a is None:
            return None
        out = np.zeros(len(a), dtype=np.int64)
        if len(a) > 1:
            np.cumsum(np.asarray(a, dtype=np.int64)[:-1], out=out[1:])
        return out
    return s.map(one)


# -- numerals -------------------------------------------------------------
def cn_number(c: Column) -> Column:
    """Chinese or ASCII numeral to BIGINT; null when any other character occurs."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("total"), zero.alias("section"), zero.alias("digit"))

    def step(a, ch):
        d = F.instr(F.lit(K.CN_DIGIT_ORDER), ch) - 1
        p = F.instr(F.lit(K.CN_UNIT_ORDER), ch)
        unit = F.element_at(F.array(*[F.lit(10 ** i).cast("long") for i in range(1, 5)]),
                            F.greatest(p, F.lit(1)))
        is_digit = d >= 0
        is_wan = p == 4
        return F.struct(
            F.when(is_wan, a["total"] + (a["section"] + a["digit"]) * unit)
             .otherwise(a["total"]).alias("total"),
            F.when(is_digit, a["section"]).when(is_wan, zero)
             .otherwise(a["section"] + F.when(a["digit"] == 0, F.lit(1)).otherwise(a["digit"]) * unit)
             .alias("section"),
            F.when(is_digit, d.cast("long")).otherwise(zero).alias("digit"))

    def read(s):
        han = F.translate(s, *K.CN_DIGIT_VARIANTS)
        folded = F.aggregate(F.regexp_extract_all(han, F.lit("."), F.lit(0)), start, step,
                             lambda a: a["total"] + a["section"] + a["digit"])
        return (F.when(s.rlike("^[0-9]+$"), s.try_cast("long"))
                 .when(s.rlike(K.CN_NUM_ONLY), folded))

    return let(ustrip(c), read)


# -- headings -------------------------------------------------------------
def heading_kind(s: Column, loose_numbered: bool = False) -> Column:
    """'volume', 'chapter', 'special' or null for one stripped line."""
    numbered = K.NUMBERED_HEADING_LOOSE if loose_numbered else K.NUMBERED_HEADING
    ok = (F.length(s).between(1, K.MAX_HEADING_CHARS)) & ~F.contains(s, F.lit(K.FULL_STOP))
    return F.when(ok, F.when(s.rlike(K.VOLUME_HEADING), "volume")
                  .when(s.rlike(K.CHAPTER_HEADING) | s.rlike(K.LATIN_HEADING), "chapter")
                  .when(s.rlike(numbered) & (F.length(ustrip(F.regexp_extract(s, numbered, 2))) > 0),
                        "chapter")
                  .when(s.rlike(K.SPECIAL_HEADING), "special"))


def heading(s: Column, loose_numbered: bool = False) -> Column:
    """STRUCT<kind, num, title> for one stripped line; kind is null for body text."""
    numbered = K.NUMBERED_HEADING_LOOSE if loose_numbered else K.NUMBERED_HEADING

    def part(pattern, n):
        return F.regexp_extract(s, pattern, n)

    def classic(pattern):
        return ustrip(F.concat(F.lit("第"), part(pattern, 1), part(pattern, 2), F.lit(" "),
                               ustrip(part(pattern, 3))))

    latin = part(K.LATIN_HEADING, 1).try_cast("long")

    def build(kind):
        title = (F.when(kind == "volume", classic(K.VOLUME_HEADING))
                 .when(kind == "special", s)
                 .when(s.rlike(K.CHAPTER_HEADING), classic(K.CHAPTER_HEADING))
                 .when(s.rlike(K.LATIN_HEADING),
                       ustrip(F.concat(F.lit("Chapter "), latin.cast("string"), F.lit(" "),
                                       ustrip(part(K.LATIN_HEADING, 2)))))
                 .when(kind == "chapter",
                       F.concat(part(numbered, 1), F.lit(". "), ustrip(part(numbered, 2)))))
        digits = F.when(kind == "volume", part(K.VOLUME_HEADING, 1)).when(
            kind == "chapter", F.coalesce(group(s, K.CHAPTER_HEADING), group(s, K.LATIN_HEADING),
                                          group(s, numbered)))
        return F.struct(kind.alias("kind"), cn_number(digits).alias("num"),
                        F.when(kind.isNotNull(), title).alias("title"))

    return let(heading_kind(s, loose_numbered), build)


def file_title(title: Column) -> Column:
    """Title made safe for a file name."""
    t = F.regexp_replace(F.regexp_replace(title, K.TITLE_NUMBER_PREFIX, ""), K.FILE_UNSAFE, "_")
    t = F.regexp_replace(t, r"^[ ._]+|[ ._]+\z", "")
    return F.substring(F.when(F.length(t) > 0, t).otherwise(K.UNTITLED), 1, K.FILE_TITLE_CHARS)


def chapter_label(idx: Column, title: Column) -> Column:
    t = ustrip(F.coalesce(title, F.lit("")))
    bare = F.concat(F.lit("第"), idx.cast("string"), F.lit("章"))
    return (F.when(t == "", bare).when(t.rlike("^(?:第|[0-9])"), t)
             .otherwise(F.concat(bare, F.lit(" "), t)))


# -- chapter references ---------------------------------------------------
def _pairs(text: Column, pattern: str) -> Column:
    a = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    b = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.arrays_zip(a.alias("a"), b.alias("b"))


def ref_pairs(text: Column, pattern: str) -> Column:
    """ARRAY<STRUCT<a, b>> of non-zero chapter pairs in text order, whatever their direction."""
    nums = F.transform(_pairs(text, pattern),
                       lambda p: F.struct(cn_number(p["a"]).alias("a"), cn_number(p["b"]).alias("b")))
    return F.filter(nums, lambda p: (p["a"] > 0) & (p["b"] > 0))


def ref_ranges(text: Column, pattern: str = K.COVER_RANGE) -> Column:
    """Those pairs that ascend."""
    return F.filter(ref_pairs(text, pattern), lambda p: p["b"] >= p["a"])


def ref_singles(text: Column, pattern: str = K.COVER_SINGLE) -> Column:
    """ARRAY<BIGINT> of single chapter references (zero dropped)."""
    nums = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), cn_number)
    return F.filter(nums, lambda n: n > 0)


def plain_digits(c: Column) -> Column:
    """Full-width, Arabic-Indic and Devanagari digits as ASCII ones, as a Unicode ``\\d`` would accept them."""
    other = "".join(chr(base + i) for base in (0xFF10, 0x0660, 0x06F0, 0x0966) for i in range(10))
    return F.translate(c, other, "0123456789" * 4)


def chapter_list(s: Column, widest: int | None = K.LIST_SPAN_CAP) -> Column:
    """Sorted distinct chapters of a list such as ``3、5–8``.

    Falling spans, and spans over ``widest`` chapters (None: no bound), keep their ends only.
    """
    s = plain_digits(s)

    def expand(p):
        a, b = p["a"].cast("long"), p["b"].cast("long")
        near = (b > a) & (b - a <= widest) if widest is not None else b > a
        return F.when(near, F.sequence(a, F.when(near, b).otherwise(a))).otherwise(F.array(a, b))

    spans = F.flatten(F.transform(_pairs(s, K.LIST_RANGE), expand))
    rest = F.regexp_replace(s, K.LIST_RANGE, " ")
    singles = F.transform(F.regexp_extract_all(rest, F.lit(K.LIST_SINGLE), F.lit(0)),
                          lambda x: x.cast("long"))
    return F.array_sort(F.array_distinct(F.concat(spans, singles)))


def declared_chapter(label: Column) -> Column:
    """Chapter number that a quotation marker declares, else null."""
    label = plain_digits(label)
    return F.coalesce(group(label, K.U + r"第\s*([0-9]+)").try_cast("long"),
                      F.when(ustrip(label).rlike("^[0-9]+$"), ustrip(label).try_cast("long")))


def name_number(name: Column) -> Column:
    """First run of one to six digits in a file name."""
    return group(name, r"^\D*?([0-9]{1,6})").try_cast("int")


def leading_number(name: Column) -> Column:
    return F.coalesce(group(name, "^([0-9]+)").try_cast("long"), F.lit(10 ** 9).cast("long"))


def guess_range(*texts: Column, span: int | None = K.SHELF_RANGE_SPAN) -> Column:
    """STRUCT<a, b> of the first text holding a chapter range of less than ``span`` chapters (None: any)."""
    def one(t):
        t = plain_digits(t)
        a = group(t, K.SHELF_RANGE, 1).cast("int")
        b = group(t, K.SHELF_RANGE, 2).cast("int")
        return F.when((a <= b) & (b - a < span) if span is not None else a <= b, F.struct(a.alias("a"), b.alias("b")))
    return F.coalesce(*[one(t) for t in texts])


def clean_title(t: Column) -> Column:
    return ustrip(F.regexp_replace(F.coalesce(t, F.lit("")), K.RANGE_TAIL, ""))


# -- keys and labels ------------------------------------------------------
def progress_key(path: Column, explicit: Column | None = None) -> Column:
    """Stable key of a source document: file stem and a short path hash."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    key = F.concat(stem, F.lit("-"), F.substring(F.sha2(F.lower(path), 256), 1, 16))
    return key if explicit is None else F.coalesce(F.nullif(explicit, F.lit("")), key)


def progress_label(pct: Column) -> Column:
    before, after = K.PROGRESS_PART.split("{}")
    return (F.when(pct >= 100, K.PROGRESS_DONE)
             .otherwise(F.concat(F.lit(before), pct.cast("string"), F.lit(after))))


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def html_unescape(c: Column) -> Column:
    """Named and numeric entities as characters; texts without an ampersand stay in the JVM."""
    return F.when(F.contains(c, F.lit("&")), _unescape(F.when(F.contains(c, F.lit("&")), c))).otherwise(c)


# -- alias cells ----------------------------------------------------------
def clean_cell(c: Column) -> Column:
    return ustrip(F.regexp_replace(c, K.EMPHASIS, ""))


def clean_name_cell(c: Column) -> Column:
    return clean_cell(F.regexp_replace(c, K.PAREN_NOTE, ""))


def alias_pieces(cell: Column) -> Column:
    """Candidate aliases of one table cell, prefixes such as 'also called' removed."""
    return F.transform(F.split(clean_name_cell(cell), K.ALIAS_SPLIT, -1),
                       lambda a: ustrip(F.regexp_replace(a, K.ALIAS_PREFIX, "")))


def admissible_alias(a: Column) -> Column:
    return ((F.length(a).between(1, K.ALIAS_MAX_CHARS)) & ~a.rlike(K.U + r"\s") & ~a.rlike(r"(?U)\d")
            & ~a.rlike(K.ALIAS_PLACEHOLDER) & ~a.rlike(K.ALIAS_NOTE) & ~a.isin(*K.GENERIC_NAMES))
