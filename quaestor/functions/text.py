"""Column expressions over text: tokens, names, values, periods, predicates. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns and word lists whose matches define the results.
TOKEN = r"([a-z]+|[0-9]+(?:\.[0-9]+)?)"
BOILERPLATE = (
    r"(?im)forward-looking statements|safe harbor|private securities litigation reform act|investor relations|media contact|^contacts?:|conference call|webcast|"
    r"non-gaap financial measures? (?:are|is|should)|not (?:been )?prepared in accordance with gaap|undue reliance|risk factors.{0,40}annual report on form 10-k"
)
PERIODS = (
    r"(?i)^Q[1-4]\s+20\d\d$",
    r"(?i)^H[12]\s+20\d\d$",
    r"(?i)^FY\s?20\d\d$",
    r"^20\d\d$",
    r"^[A-Z][a-z]+\.?\s+\d{1,2},?\s+20\d\d$",
)
VALUE = r"(?i)^\(?\s*[$€£]?\s*\(?\s*[-–—]?\s*[0-9][0-9,]*(?:\.[0-9]+)?\s*\)?\s*(?:%|x|pts?|bps)?\s*\)?$"
RATE = r"(?i)per share|per gallon|\(cents\)|margin|ratio|percent|%|rate\b|yield|per available|days|employees"
SUFFIX = r"(?i),?\s+(inc|corp|corporation|co|company|llc|plc|ltd|holdings)\.?$"
NUMBER_TOKEN = r"([0-9]+(?:\.[0-9]+)?|\b[qh][1-4]\b|\bfy[0-9]*\b)"
YEAR = r"\b(20[0-9]{2})\b"
LITERALS = ("up", "down", "increase", "decrease", "increased", "decreased", "flat", "higher", "lower", "unchanged", "yes", "no", "true", "false", "none", "n/a")
CORPORATE = r"\b(inc|corp|llc|plc|ltd)\b"
PREDICATES = (
    ("has_value", r"(?i)\bvalue\b|\bwas\b|totaled|amounted|^is\b"),
    # As defined, `year` must not be followed by `.over.year`; SQL engines have no such look ahead. Nothing is lost: where it
    # would exclude one `year`, the last one of the same words matches.
    ("in_period", r"(?i)period|quarter|fiscal|month|year"),
    ("comparison", r"(?i)increas|decreas|compar|grew|declin|versus|\bvs\b|sequential|year.over.year|yoy|up |down "),
    ("reports", r"(?i)segment|report|division|subsidiary"),
    ("role", r"(?i)officer|chairman|ceo|cfo|president|director|appoint"),
    ("guidance", r"(?i)expect|guidance|outlook|forecast|project"),
)
ABSTAIN = r"(?i)cannot be (established|determined)|insufficient|not (provided|available|mentioned) in the (evidence|context)|no documents have been ingested"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 1)


def squeezed(text: Column) -> Column:
    """White space and no-break spaces as single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, " ", " "), r"\s+", " "))


def without_article(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(name), r"(?i)^(the|this)\s+", ""), r"\s+", " ")


def match_form(name: Column) -> Column:
    """Lower case, without a corporate suffix."""
    return F.lower(F.regexp_replace(F.trim(name), SUFFIX, ""))


def number_key(name: Column) -> Column:
    """The sorted set of numbers and quarters: names may merge only if these are equal."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit(NUMBER_TOKEN), 1)))


def entity_text(name: Column, type_: Column, description: Column) -> Column:
    """What a name is embedded as."""
    return F.concat(name, F.lit(" ("), type_, F.lit("): "), F.coalesce(description, F.lit("")))


def years(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(YEAR), 1))


def year_conflict(a: Column, b: Column) -> Column:
    x, y = years(a), years(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)


def is_period(text: Column) -> Column:
    token, out = F.trim(text), F.lit(False)
    for pattern in PERIODS:
        out = out | token.rlike(pattern)
    return out


def is_value(text: Column) -> Column:
    return F.trim(text).rlike(VALUE)


def is_literal(text: Column) -> Column:
    """A value rather than a thing: a word of direction, or a short phrase with a digit and no corporate word."""
    t = F.lower(F.trim(text))
    return t.isin(*LITERALS) | (t.rlike("[0-9]") & (F.size(F.split(t, r"\s+")) <= 6) & ~t.rlike(CORPORATE))


def predicate_bucket(predicate: Column) -> Column:
    """The first relation whose pattern is found, else other."""
    out = F.lit("other")
    for name, pattern in reversed(PREDICATES):
        out = F.when(predicate.rlike(pattern), name).otherwise(out)
    return out


def canonical_model(name: Column) -> Column:
    base = F.replace(F.substring_index(F.lower(F.coalesce(name, F.lit(""))), "/", -1), F.lit(":"), F.lit("-"))
    return F.regexp_replace(base, r"-(instruct|chat|it)$", "")


def question_key(question: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(question, r"\s+", " ")))


def cache_key(question: Column, *parts: Column) -> Column:
    """SHA-256 of the normalised question and the settings, in a fixed order."""
    return F.sha2(F.concat_ws("\x1f", question_key(question), *parts).cast("binary"), 256)


def strip_boilerplate(text: Column) -> Column:
    """Paragraphs without legal and logistics phrases."""
    return F.array_join(F.filter(F.split(text, r"\n\s*\n"), lambda p: ~p.rlike(BOILERPLATE)), "\n\n")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4))


def abstains(answer: Column) -> Column:
    return F.coalesce(answer, F.lit("")).rlike(ABSTAIN)


def safe_filename(name: Column) -> Column:
    """Last path part, odd characters as underscores, 80 characters at most, `document` if nothing is left."""
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^.*[\\/]", ""), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(F.substring(base, 1, 80), F.lit("")), F.lit("document"))


def unit(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, r"(?i)\bin (thousands|millions|billions)\b", 1))


def route_group(path: Column) -> Column:
    """Limiter group of a request path."""
    return F.when(path.startswith("/api/query"), "query").when(path.startswith("/api/ingest"), "ingest").otherwise("other")


def client_ip(forwarded: Column, peer: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.split_part(forwarded, F.lit(","), F.lit(1))), F.lit("")), peer)
