"""Text preparation as column expressions; each takes and returns columns and needs no shuffle."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera import params



@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility normalisation; Spark has no expression for it."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where an inner lambda uses it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_invisible(text: Column) -> Column:
    """Deletes zero-width characters, direction marks, soft hyphens and word joiners."""
    return F.regexp_replace(text, r"[\u200B-\u200D\uFEFF\u00AD\u200E\u200F\u202A-\u202E\u2060-\u206F]", "")


def sanitize(text: Column) -> Column:
    """Normalises look-alikes, then deletes invisible characters. Null gives an empty text.

    Every row goes through Python here; ``sanitized`` spares those of plain ASCII.
    """
    return strip_invisible(nfkc(F.coalesce(text, F.lit(""))))


def sanitized(rows: DataFrame, column: str) -> DataFrame:
    """The rows with ``column`` sanitised. Plain ASCII needs nothing and stays out of Python: the two kinds are separate branches."""
    whole = rows.withColumn(column, F.coalesce(F.col(column), F.lit("")))
    plain = F.length(column) == F.octet_length(column)
    return whole.where(plain).unionByName(whole.where(~plain).withColumn(column, sanitize(F.col(column))))


def strip_markdown(text: Column) -> Column:
    """Images go, links become their labels."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"!\[.*?\]\(.*?\)", ""), r"\[(.*?)\]\(.*?\)", "$1")


# Patterns of identifiers, names and fences.
LABELLED_ID = (
    r"(?i)\b(?:Student\s*(?:ID|Id|No|Number)|Roll(?:\s*(?:No|Number|\.))?|Reg(?:istration)?(?:\s*(?:No|Number|\.))?"
    r"|Matric(?:\s*(?:No|Number|\.))?)\s*[:\-\s#=]+\s*([A-Za-z0-9][A-Za-z0-9\-\/_]{1,30})"
)
PLAIN_ID = r"(?i)\bID\s*[:\-\s#=]+\s*([A-Za-z0-9][A-Za-z0-9\-\/_]{1,30})"
BARE_ID = r"\b([0-9]{4,14}|[0-9]{4}-[0-9]{1,2}-[0-9]{2,3}-[0-9]{3,4}|UG-[0-9]{4}\/[0-9]{2,4})\b"
LABELLED_NAME = r"(?i)\b(?:Student(?:'s)?\s*Name|Full\s*Name|Name\s*of\s*Student|Submitted\s*By)\s*[:\-\s=]+\s*([^\r\n]{2,80})"
PLAIN_NAME = (
    r"(?i)(?<!\bProgram\s)(?<!\bProject\s)(?<!\bCourse\s)(?<!\bFile\s)(?<!\bAssignment\s)(?<!\bLab\s)(?<!\bTopic\s)(?<!\bSubject\s)(?<!\bFunction\s)(?<!\bClass\s)"
    r"\bName\s*[:\-\s=]+\s*([^\r\n]{2,80})"
)
NAME_END = (
    r"(?i)\s*(?:\b(?:ID|Student|Roll|Reg|Date|Course|Assignment|Department|Batch|Semester|Instructor|Faculty|Teacher"
    r"|Dr\.|Prof\.|Submitted\s*To|Section)\b|[:\-\|#])"
)


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))


def student_id(text: Column) -> Column:
    """Identifier on the first 3000 characters: labelled, then after ``ID:``, then a bare number or structured id."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 3000)
    words = F.array(*map(F.lit, params.NOT_AN_ID))
    known = lambda c: F.array_contains(words, F.lower(c))
    one = lambda h: let(_found(h, LABELLED_ID), lambda c: F.when(~known(c) & (c.rlike("[0-9]") | (F.length(c) >= 3)), c))
    two = lambda h: let(_found(h, PLAIN_ID), lambda c: F.when(~known(c) & c.rlike("[0-9]"), c))
    return let(head, lambda h: F.coalesce(one(h), two(h), _found(h, BARE_ID)))


def student_name(text: Column) -> Column:
    """Name on the first 3000 characters, cut at the next field; null if it holds a word that no name holds."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 3000)
    raw = let(head, lambda h: F.coalesce(_found(h, LABELLED_NAME), _found(h, PLAIN_NAME)))
    name = F.regexp_replace(F.element_at(F.split(raw, NAME_END, -1), 1), r"^[ :\-\u2013\t]+|[ :\-\u2013\t]+$", "")

    def known(name):
        words = F.regexp_extract_all(F.lower(name), F.lit(r"\b([a-z]+)\b"), F.lit(1))
        odd = F.arrays_overlap(words, F.array(*map(F.lit, params.NOT_AN_ID)))
        return F.when(~F.coalesce(odd, F.lit(False)) & (F.length(name) >= 2), name)

    return let(name, known)


# Fixed value.
FENCE = r"(?s)```(?:\w+)?\n(.*?)```"


def fenced_code(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(FENCE), F.lit(1))


def without_fences(text: Column) -> Column:
    return F.regexp_replace(text, FENCE, "")


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def is_code_line(line: Column, in_code: Column | bool = False) -> Column:
    """Holds a code mark, ends or begins like code, or is indented and no bullet; * lines only while in code."""
    bare = F.trim(line)
    inside = in_code if isinstance(in_code, Column) else F.lit(in_code)
    return (
        _any([line.contains(m) for m in params.CODE_MARKS])
        | _any([bare.endswith(e) for e in params.CODE_ENDS])
        | _any([bare.startswith(s) for s in params.CODE_STARTS])
        | (inside & bare.startswith("*"))
        | ((line.startswith("    ") | line.startswith("\t")) & ~bare.rlike(r"^[*#-]"))
    )


def split_code(text: Column) -> Column:
    """Struct (prose, blocks): fenced bodies and runs of code lines are blocks.

    A run keeps blank lines and up to two others; the third line in it that is not code ends it and is prose.
    Blocks have more than five characters. One fold over the lines, inside one expression.
    """
    return let(strip_markdown(text), _split)


def _split(clean: Column) -> Column:
    """``split_code`` of a text without Markdown."""
    lines = F.split(without_fences(clean), r"\r\n|\r|\n")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("block"), none.alias("prose"), none.alias("blocks"), F.lit(False).alias("open"), F.lit(0).alias("other"))

    def state(block, prose, blocks, is_open, other):
        return F.struct(block.alias("block"), prose.alias("prose"), blocks.alias("blocks"), is_open.alias("open"), other.alias("other"))

    def step(s, line):
        one = F.array(line)
        into_block = state(F.concat(s["block"], one), s["prose"], s["blocks"], s["open"], s["other"])
        into_prose = state(s["block"], F.concat(s["prose"], one), s["blocks"], s["open"], s["other"])
        code = state(F.concat(s["block"], one), s["prose"], s["blocks"], F.lit(True), F.lit(0))
        tolerated = state(F.concat(s["block"], one), s["prose"], s["blocks"], F.lit(True), s["other"] + 1)
        closed = state(none, F.concat(s["prose"], one), F.concat(s["blocks"], F.array(F.array_join(s["block"], "\n"))), F.lit(False), F.lit(0))
        blank = F.trim(line) == ""
        return (
            F.when(blank & s["open"], into_block)
            .when(blank, into_prose)
            .when(is_code_line(line, s["open"]), code)
            .when(s["open"] & (s["other"] < 2), tolerated)
            .when(s["open"], closed)
            .otherwise(into_prose)
        )

    def finish(s):
        tail = F.when(F.size(s["block"]) > 0, F.array(F.array_join(s["block"], "\n"))).otherwise(none)
        strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
        found = F.concat(fenced_code(clean), F.transform(F.concat(s["blocks"], tail), strip))
        return F.struct(strip(F.array_join(s["prose"], "\n")).alias("prose"), F.filter(found, lambda b: F.length(strip(b)) > 5).alias("blocks"))

    return F.aggregate(lines, start, step, finish)


def merge_blocks(a: Column, b: Column) -> Column:
    """Distinct blocks in order of first appearance; null if there are none."""
    none = F.array().cast("array<string>")
    both = F.array_distinct(F.concat(F.coalesce(a, none), F.coalesce(b, none)))
    return F.when(F.size(both) > 0, both)


def parse_status(text: Column) -> Column:
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) > 0, "ok").otherwise("parse_error")


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def content_tokens(text: Column) -> Column:
    """Lower-cased words of letters and digits only, without stop words; repeats stay."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?<!\S)[\p{L}\p{N}]++(?!\S)"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(params.STOP_WORDS))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def text_profile(text: Column, blocks: Column | None = None) -> Column:
    """Struct of counts a report shows: words, characters, paragraphs (at most 40 shown), sentences, code lines shown."""
    whole = F.coalesce(text, F.lit(""))
    paragraphs = lambda sep: F.filter(F.split(whole, sep), lambda p: F.length(F.trim(p)) > 0)
    some = F.when(F.size(paragraphs(r"\n\s*\n")) > 1, paragraphs(r"\n\s*\n")).otherwise(paragraphs(r"\n"))
    shown = F.transform(F.slice(blocks, 1, 5), lambda b: F.slice(F.split(b, "\n"), 1, 25)) if blocks is not None else F.array().cast("array<array<string>>")
    return F.struct(
        F.size(words(text)).cast("long").alias("n_words"),
        F.length(whole).cast("long").alias("n_chars"),
        F.size(some).cast("long").alias("n_paragraphs"),
        F.size(F.slice(some, 1, 40)).cast("long").alias("n_shown"),
        F.size(F.filter(F.split(whole, r"(?<=[.!?])\s+"), lambda s: F.length(F.trim(s)) > 0)).cast("long").alias("n_sentences"),
        F.aggregate(shown, F.lit(0), lambda s, b: s + F.size(b)).cast("long").alias("n_code_lines"),
    )


def safe_name(name: Column, fallback: Column) -> Column:
    return F.regexp_replace(F.coalesce(F.nullif(name, F.lit("")), F.substring(fallback, 1, 8)), "[^a-zA-Z0-9_-]", "_")


def _clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def _punctuation(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, "[.,;:!?]", ""))


def stylometric(text: Column) -> Column:
    """0 to 1 from sentence length, vocabulary repetition and punctuation; null without words or sentences."""
    density = _punctuation(text) / F.greatest(F.length(text), F.lit(1))
    low = words(F.lower(text))
    counts = F.struct(F.size(sentences(text)).alias("s"), low.alias("w"))

    def score(c):
        n = F.size(c["w"])
        variety = F.size(F.array_distinct(c["w"])) / n
        x = 0.3 * F.least(n / c["s"] / 25, F.lit(1.0)) + 0.4 * (1 - variety) + 0.3 * (1 - F.least(density * 10, F.lit(1.0)))
        return F.when((n > 0) & (c["s"] > 0), _clip(x))

    return let(counts, score)


def stylometric_features(text: Column) -> Column:
    """Struct of rounded features from alphabetic words; zeros without any."""
    w, s = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![\p{L}\p{N}_])[a-zA-Z]++(?![\p{L}\p{N}_])"), F.lit(0)), sentences(text)
    some = (F.size(w) > 0) & (F.size(s) > 0)
    length, variety = F.size(w) / F.size(s), F.size(F.array_distinct(F.transform(w, F.lower))) / F.size(w)
    density = _punctuation(text) / F.greatest(F.length(text), F.lit(1))
    score = _clip(0.35 * F.least(length / 22, F.lit(1.0)) + 0.45 * (1 - variety) + 0.20 * (1 - F.least(density * 15, F.lit(1.0))))
    of = lambda c, n: F.coalesce(F.when(some, F.round(c, n)), F.lit(0.0))
    return F.struct(of(variety, 3).alias("ttr"), of(length, 2).alias("avg_sent_len"), of(density, 3).alias("punct_density"), of(score, 3).alias("stylometric_score"))
