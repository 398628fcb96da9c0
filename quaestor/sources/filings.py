"""Filings: the column-wise feed of submissions, choice of earnings releases and exhibits, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Form and item of an earnings release, kinds of exhibit in order of preference, releases a company.
FORM, ITEM, RELEASES = "8-K", "2.02", 2
EXHIBIT = r"^EX-99(\.0?1)?$"


def submissions(feed: DataFrame) -> DataFrame:
    """Rows of a feed of parallel arrays: ticker, form, items, accessionNumber, filingDate, place."""
    zipped = feed.select("ticker", F.arrays_zip("form", "items", "accessionNumber", "filingDate").alias("r"))
    return zipped.select("ticker", F.posexplode("r").alias("place", "r")).select("ticker", "place", "r.*")


def releases(rows: DataFrame, exhibits: DataFrame, n: int = RELEASES) -> DataFrame:
    """The first n filings of each company that report earnings and carry an exhibit, with that exhibit.

    exhibits: accessionNumber, kind, url. Preferred kinds first, then the smallest address.
    """
    fit = exhibits.where(F.upper("kind").rlike(EXHIBIT))
    best = fit.groupBy("accessionNumber").agg(F.min(F.struct((~F.upper("kind").isin("EX-99.1", "EX-99.01")).alias("other"), "url"))["url"].alias("url"))
    own = rows.where((F.col("form") == FORM) & F.coalesce(F.col("items"), F.lit("")).contains(ITEM)).join(best, "accessionNumber")
    w = Window.partitionBy("ticker").orderBy("place")
    return own.withColumn("nth", F.row_number().over(w).cast("long")).where(F.col("nth") <= n)


def company_name(title: Column) -> Column:
    """A filer's title as a name: no state or marker behind a slash, words capitalised, short ones in capitals kept."""
    words = F.filter(F.split(F.regexp_replace(F.trim(title), r"\s*/[A-Z]{2,}/?\s*$", ""), r"\s+"), lambda w: w != "")
    short = lambda w: (F.length(w) <= 3) & (F.upper(w) == w) & (F.lower(w) != w)
    return F.array_join(F.transform(words, lambda w: F.when(short(w), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))), " ")


def rendered(company: Column, ticker: Column, filed: Column, url: Column, body: Column, most: int = 80_000) -> Column:
    """A release as a document: its header, and the body cut at a paragraph in its second half."""
    head = F.substring(body, 1, most)
    at = F.length(head) - F.instr(F.reverse(head), "\n\n") - 1
    paragraph = (F.instr(F.reverse(head), "\n\n") > 0) & (at > most // 2)
    text = F.when(F.length(body) <= most, body).when(paragraph, F.substring(head, F.lit(1), at)).otherwise(head)
    return F.concat(F.lit("COMPANY: "), company, F.lit(" ("), ticker, F.lit(")\nDOCUMENT: Earnings release, filed "), filed, F.lit("\nSOURCE: "), url, F.lit("\n\n"), text)


def question_document(id_: Column, pre: Column, table: Column, post: Column) -> Column:
    """A question's source as a document: its texts, and its table as labelled lines; nothing of the answer."""
    header = F.element_at(table, 1)
    name = lambda i: F.when(i <= F.size(header), F.element_at(header, i)).otherwise(F.concat(F.lit("column "), (i - 1).cast("string")))
    cell = lambda row: F.transform(F.slice(row, F.lit(2), F.greatest(F.size(row), F.lit(1))), lambda c, i: F.concat(name((i + 2).cast("int")), F.lit(": "), c))
    line = lambda row: F.concat(F.lit("TABLE ROW "), row[0], F.lit(" | "), F.array_join(cell(row), " ; "))
    rows = F.when(F.size(table) > 0, F.concat(F.array(F.concat(F.lit("TABLE HEADERS: "), F.array_join(header, " | "))), F.transform(F.slice(table, F.lit(2), F.greatest(F.size(table), F.lit(1))), line)))
    parts = F.concat(F.array(F.concat(F.lit("SOURCE: "), F.regexp_replace(id_, "-[^-]*$", ""))), F.coalesce(pre, F.array()), F.coalesce(rows, F.array()), F.coalesce(post, F.array()))
    return F.array_join(parts, "\n\n")


def report_id(id_: Column) -> Column:
    return F.substring_index(id_, "/", 2)


def decoded(raw: Column) -> Column:
    """Bytes as UTF-8, else as Windows-1252."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "windows-1252"))
