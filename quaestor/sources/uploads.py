"""Files as documents: reading folders and uploads, validation of a batch, PDF where a parser is installed.

Defined results: bytes that are no UTF-8 are left out of text files in folders, and refuse an upload; an upload is taken
whole or not at all; file names are cut to what `safe_filename` gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions import text as T

#: Limits of an upload and the kinds of files.
FILES, MEGABYTES, PAGES, KINDS = 10, 10.0, 40, ("txt", "md", "pdf")
_KEEP = "\U0010fffe"


def decoded(raw: Column) -> Column:
    """Bytes as text, without those that are no UTF-8."""
    text = F.replace(raw.cast("string"), F.lit("�"), F.lit(_KEEP))  # replacement marks of the text itself stay
    return F.replace(F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit("")), F.lit(_KEEP), F.lit("�"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def kind(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def pdf_pages(content: Column) -> Column:
    """Pages of a PDF as an array of texts; null where the file can't be read. Needs pypdf, which is imported where it runs."""

    @F.pandas_udf("array<string>")
    def pages(files):
        from io import BytesIO

        from pypdf import PdfReader

        def one(data):
            try:
                return [p.extract_text() or "" for p in PdfReader(BytesIO(data)).pages]
            except Exception:  # a parser meets anything in files from outside
                return None

        return files.map(one)

    return pages(content)


def _parser() -> bool:
    from importlib.util import find_spec

    return find_spec("pypdf") is not None


def texts(files: DataFrame) -> DataFrame:
    """doc_id, text of files (path, content). PDF pages are parted by blank lines; without a parser PDF files are an error."""
    k = kind(F.col("path"))
    plain = files.where(k != "pdf").select(stem(F.col("path")).alias("doc_id"), decoded(F.col("content")).alias("text"))
    pdf = files.where(k == "pdf")
    if not _parser():
        stop = F.raise_error(F.lit("PDF files need pypdf, which is not installed")).cast("string")
        return plain.unionByName(pdf.select(stem(F.col("path")).alias("doc_id"), stop.alias("text")))
    return plain.unionByName(pdf.select(stem(F.col("path")).alias("doc_id"), F.array_join(pdf_pages(F.col("content")), "\n\n").alias("text")))


def folder(spark: SparkSession, path: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """doc_id, text of a folder's files, in the order of their paths."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{','.join(kinds)}}}").load(path)
    return texts(raw.orderBy("path").select("path", "content"))


def checked(files: DataFrame, megabytes: float = MEGABYTES, pages: int = PAGES) -> DataFrame:
    """name, doc_id, chars, refused of each uploaded file (name, content): the reason why it can't be taken, or null."""
    name = T.safe_filename(F.col("name"))
    raw, k = F.col("content"), kind(name)
    empty = F.length(F.trim(F.regexp_replace(F.decode(raw, "iso-8859-1"), r"\s+", ""))) == 0
    reason = F.when(~k.isin(*KINDS), "kind of file").when(F.octet_length(raw) > megabytes * 2**20, "too large").when(empty, "empty")
    reason = reason.when((k == "pdf") & (F.substring(raw, 1, 4) != F.lit(b"%PDF")), "no PDF").when((k != "pdf") & ~F.is_valid_utf8(raw.cast("string")), "no UTF-8")
    out = files.select(name.alias("name"), stem(name).alias("doc_id"), "content", reason.alias("refused"))
    chars = F.when(F.col("refused").isNull() & (kind(F.col("name")) != "pdf"), F.length(raw.cast("string")))
    if _parser():
        out = out.withColumn("pages", F.when(F.col("refused").isNull() & (kind(F.col("name")) == "pdf"), pdf_pages(F.col("content"))))
        bad = F.when(F.col("pages").isNull(), "no readable PDF").when(F.size("pages") > pages, "too many pages").when(F.length(F.trim(F.array_join("pages", ""))) == 0, "no text")
        out = out.withColumn("refused", F.when(F.col("refused").isNull() & (kind(F.col("name")) == "pdf"), bad).otherwise(F.col("refused")))
        chars = F.coalesce(chars, F.length(F.array_join("pages", "\n")))
    else:
        out = out.withColumn("refused", F.when(F.col("refused").isNull() & (kind(F.col("name")) == "pdf"), "no parser for PDF").otherwise(F.col("refused")))
    return out.select("name", "doc_id", chars.cast("long").alias("chars"), "refused")


def accepted(files: DataFrame, most: int = FILES) -> DataFrame:
    """path, content of a batch, all of it; raises with the reasons if any file is refused, names repeat, or there are too many."""
    rows = checked(files).limit(most + 1).collect()  # one batch of a form
    bad = [f"{r.name}: {r.refused}" for r in rows if r.refused]
    if not rows or len(rows) > most:
        bad.append(f"1 to {most} files")
    if len({r.doc_id for r in rows}) < len(rows):
        bad.append("names repeat")
    if bad:
        raise ValueError("; ".join(bad))
    return files.select(T.safe_filename(F.col("name")).alias("path"), "content")
