"""URL filters in DataFrame operations alone: a blocked Bloom filter, and an exact hash join for what it lets pass.

The list holds two sorts of entries: rules (host and start of a path, with a verdict) and canonical URLs. Each entry is one
key; a key's hash names one block of 256 bits, four words of 64, and sets two bits in each word. A URL asks for few keys: its
canonical form, and for each shape of the rules (labels of the host, length of the path) its own host's last labels with that
much of its path. The blocks, a few bytes for each entry, are joined to the keys asked for; what the filter lets pass,
wrongly now and then, is joined with the entries themselves. Of the rules that fit the longest wins.

Canonical: scheme and fragment go, A-Z of the host are lower-cased, default ports and slashes at the end of the path go,
parameters are sorted and those of TRACKING dropped. The query's list is made of the table itself: canonical URLs of more than
one page. Of these, pages with another than the smallest page_id are blocked (they were fetched already) unless a rule
decides; pages without rule or entry are allowed.

Defined results: urls that are null or without `://` have empty host and path and no canonical form, no rule fits them and
they are allowed; null ids count as larger than all others; equal rows, and rows of equal id, get equal verdicts; of equally
long rules that fit, that of the longer host wins, and of equal rules block; an empty table gives an empty result; columns
other than page_id and url are left out, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PLACE, cut, located, own_columns, read, spread_join

#: The contract's rules (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Parameters that do not change what a URL names.
TRACKING = "^(utm_[a-z_]+|ref|fbclid|gclid)="
PORTS = ":(80|443)$"
#: Entries for each block of 256 bits: with 8 bits an entry about one key in 200 passes wrongly.
PER_BLOCK = 16
#: Blocks in one broadcast, about 30 MB at the executors, for 4 million entries. Beyond, keys and blocks meet by shuffle.
BLOCKS = 1 << 18
WORDS = 4


def parts(url: Column) -> dict[str, Column]:
    """host, path and query of a URL, empty where there is none; `whole`: whether there is a `://`."""
    at = F.instr(url, "://")
    whole = F.coalesce(at > 0, F.lit(False))
    rest = F.when(whole, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = F.substr(rest, F.length(host) + 1)
    path = F.regexp_extract(after, "^[^?#]*", 0)
    query = F.regexp_extract(F.substr(after, F.length(path) + 1), r"^\?([^#]*)", 1)
    lowered = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return {"whole": whole, "host": lowered, "path": path, "query": query}


def canonical(host: Column, path: Column, query: Column) -> Column:
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(F.regexp_replace(host, PORTS, ""), F.regexp_replace(path, "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


# ---- the filter ----------------------------------------------------------------------------------------------------


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long")


def _masks(key: Column) -> list[Column]:
    """For each word the two bits that the key sets."""
    h = F.xxhash64(key, F.lit("bits"))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int"))
    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(WORDS)]


def bloom(entries: DataFrame, blocks: int) -> DataFrame:
    """block, w0 .. w3: one row for each block that has an entry."""
    masks = [m.alias(f"m{w}") for w, m in enumerate(_masks(F.col("key")))]
    rows = entries.select(_block(F.col("key"), blocks).alias("block"), *masks)
    return rows.groupBy("block").agg(*[F.bit_or(f"m{w}").alias(f"w{w}") for w in range(WORDS)])


def passing(asked: DataFrame, entries: DataFrame, at_most: int = BLOCKS) -> DataFrame:
    """The rows of asked whose `key` the filter of the entries' keys lets pass: all that are listed, and a few others."""
    blocks = max(1, -(-entries.count() // PER_BLOCK))
    table = bloom(entries, blocks)
    table = F.broadcast(table) if blocks <= at_most else table
    met = asked.withColumn("block", _block(F.col("key"), blocks)).join(table, "block")
    fits = F.lit(True)
    for w, m in enumerate(_masks(F.col("key"))):
        fits = fits & (F.col(f"w{w}").bitwiseAND(m) == m)
    return met.where(fits).select(*asked.columns)


# ---- rules and listed URLs -----------------------------------------------------------------------------------------


def _rule_entries(rules: DataFrame) -> DataFrame:
    low = F.translate("host", string.ascii_uppercase, string.ascii_lowercase)
    rule = F.concat(low, F.col("path"))
    order = F.struct(F.length(rule).alias("length"), F.length(low).alias("host"), F.col("verdict").alias("verdict"), rule.alias("rule"))
    return rules.where("host <> '' AND path IS NOT NULL").select(F.concat(F.lit("^"), rule).alias("key"), order.alias("fits")).groupBy("key").agg(F.max("fits").alias("fits"))


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, canonical, listed.

    rules: host, path, verdict; listed: canonical, first (a page of that id is not blocked by the entry; null: all are).
    """
    d = located(pages, "page_id", "url")
    p = parts(F.col("url"))
    d = d.select(*PLACE, "page_id", *[p[k].alias(k) for k in p])
    d = d.select(*PLACE, "page_id", "host", "path", F.when(F.col("whole"), canonical(F.col("host"), F.col("path"), F.col("query"))).alias("canonical"))

    rule_keys = _rule_entries(rules)
    shapes = [(r.labels, r.start) for r in rules.where("host <> '' AND path IS NOT NULL").select(F.size(F.split("host", r"\.", -1)).alias("labels"), F.length("path").alias("start")).distinct().collect()]  # a bounded table: labels by lengths
    seen = own_columns(listed, "canonical", "first").where("canonical IS NOT NULL")
    entries = cut(rule_keys.select("key", "fits", F.lit(None).cast(seen.schema["first"].dataType).alias("first")).unionByName(seen.groupBy("canonical").agg(F.max("first").alias("first")).select(F.concat(F.lit("="), F.col("canonical")).alias("key"), "first"), allowMissingColumns=True))

    labels = F.size(F.split("host", r"\.", -1))
    own = [F.when((labels >= n) & (F.length("path") >= start), F.concat(F.lit("^"), F.substring_index("host", ".", -n), F.substring("path", 1, start))) for n, start in sorted(shapes)]
    keys = F.array_compact(F.array(F.concat(F.lit("="), F.col("canonical")), *own))
    asked = d.where("canonical IS NOT NULL").select(*PLACE, F.explode(keys).alias("key"))
    hits = cut(passing(asked, entries.select("key")))

    found = entries.join(hits.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    met = spread_join(hits, cut(found), ["key"])
    said = met.groupBy(*PLACE).agg(F.max("fits").alias("fits"), F.max(F.col("key").startswith("=")).alias("listed"), F.max("first").alias("first"))
    out = d.join(said, list(PLACE), "left")
    again = F.coalesce(F.col("listed"), F.lit(False)) & (F.col("first").isNull() | ~F.col("first").eqNullSafe(F.col("page_id")))
    verdict = F.coalesce(F.col("fits.verdict"), F.when(again, F.lit("block")), F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("fits.rule").alias("rule"), verdict.alias("verdict"), "canonical", F.coalesce("listed", F.lit(False)).alias("listed"))


def repeated(pages: DataFrame) -> DataFrame:
    """canonical, first: canonical URLs of pages of more than one id, with the smallest; null ids count as one, larger than all."""
    p = parts(F.col("url"))
    d = own_columns(pages, "page_id", "url").select("page_id", *[p[k].alias(k) for k in p]).where("whole")
    d = d.select("page_id", canonical(F.col("host"), F.col("path"), F.col("query")).alias("canonical"))
    some = F.col("page_id").isNotNull()
    each = d.groupBy("canonical").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.max(~some).alias("without"))
    return each.where("first IS NOT NULL AND (first < last OR without)").select("canonical", "first")


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    rows = [F.struct(*[F.lit(v).alias(k) for k, v in zip(("host", "path", "verdict"), r, strict=True)]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def op13_blocked_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return judge(pages, rule_table(spark), repeated(pages))


SQL = rf"""
WITH r(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}
), a AS (SELECT row_number() OVER () AS rid, page_id, coalesce(instr(url, '://') > 0, false) AS whole, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h FROM a
), c AS (SELECT *, substr(rest, length(h) + 1) AS after FROM b
), d AS (SELECT *, translate(h, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(after, '^[^?#]*') AS path FROM c
), e AS (SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_extract(substr(after, length(path) + 1), '^\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}'))), '&') AS kept FROM d
), f AS (SELECT rid, page_id, host, path, CASE WHEN whole THEN regexp_replace(host, '{PORTS}', '') || regexp_replace(path, '/+$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canonical FROM e
), l AS (SELECT canonical, min(page_id) AS first FROM f WHERE canonical IS NOT NULL GROUP BY canonical HAVING min(page_id) < max(page_id) OR (count(page_id) < count(*) AND count(page_id) > 0)
), m AS (SELECT rid, rule_host || rule_path AS rule, rule_verdict, row_number() OVER (PARTITION BY rid ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, rule_verdict DESC) AS k FROM f JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT f.page_id, f.host, f.path, m.rule, CASE WHEN m.rule IS NOT NULL THEN m.rule_verdict WHEN l.first IS NOT NULL AND f.page_id IS DISTINCT FROM l.first THEN 'block' ELSE 'allow' END AS verdict,
       f.canonical, l.first IS NOT NULL AS listed
FROM f LEFT JOIN m ON f.rid = m.rid AND m.k = 1 LEFT JOIN l ON f.canonical = l.canonical
"""
