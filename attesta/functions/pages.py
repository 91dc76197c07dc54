"""Page content as columns: plain text, tables as prose, walls and retractions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta import constants as K
from attesta.functions.text import flat, let, strip


def html_text(html: Column) -> Column:
    """Text without scripts, styles and tags, white space flattened."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return flat(F.regexp_replace(bare, r"(?s)<[^>]+>", " "))


def table_prose(text: Column) -> Column:
    """Rows of pipe tables as sentences: one cell is a subject ("A. "), more are "A was B. "; separators go.

    Rows are the runs of pipes and cells between other text; what stands right before a separator goes with it. Text
    without pipes is unchanged.
    """
    row = r"(?:\|[^\n|]*)+\s*"
    rows = F.regexp_extract_all(text, F.lit(f"({row})"), F.lit(1))
    between = F.split(text, row, -1)

    def prose(r: Column) -> Column:
        def said(cells: Column) -> Column:
            rules = F.forall(cells, lambda c: c.rlike("^[-:]+$"))
            one = F.concat(F.get(cells, F.lit(0)), F.lit(". "))
            return F.when((F.size(cells) == 0) | rules, F.lit("")).when(F.size(cells) == 1, one).otherwise(F.concat(F.get(cells, F.lit(0)), F.lit(" was "), F.get(cells, F.lit(1)), F.lit(". ")))

        return let(F.filter(F.transform(F.split(r, r"\|"), strip), lambda c: c != ""), said)

    woven = F.zip_with(between, F.transform(rows, prose), lambda a, b: F.when(F.coalesce(b, F.lit("-")) == "", b).otherwise(F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))))
    return F.when(F.contains(text, F.lit("|")), F.array_join(woven, "")).otherwise(text)


def has_paywall(content: Column) -> Column:
    return F.coalesce(content.rlike("(?i)" + "|".join(f"(?:{p})" for p in K.PAYWALL)), F.lit(False))


def has_retraction(content: Column) -> Column:
    return F.coalesce(content.rlike("(?i)" + "|".join(f"(?:{p})" for p in K.RETRACTION)), F.lit(False))
