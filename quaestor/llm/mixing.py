"""Mixing sources to target weights by a low-discrepancy source schedule, in DataFrame operations alone.

Each source's documents, in a shuffled order, form one stream of words, cut into blocks of equal length. Slot k of the
schedule has the golden-ratio point frac(k * phi); cumulative weights map the point to a source; the slot's rank among
the source's slots says which block it takes (after the last block the stream starts again). A source's slots end where
it has its target. Golden-ratio points differ from the ideal share of any interval by O(log slots), so a schedule that is
longer by that much for each source reaches every target.

Defined results: a null text has size 0; documents without words have taken 0; a source without words has target 0; the
null source is a source of its own, last; rows that repeat are documents of their own; an empty table gives an empty
result. Runs agree: the order is that of md5 of id and size.

Sources may be as many as web domains: they are numbered by range partitions, shares come from few passes over the table of
sources, and a source that holds a third of all documents meets its row by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, own_columns, read, spread, spread_join

BLOCK = 256  # words
WEIGHTS = (5, 2, 1)
SHARE = 1.5
#: The golden ratio's fraction, and that of 2**20 times it.
PHI, PHI20 = 0.6180339887498949, 0.6088378504735308
CHUNK, SUPER = 512, 2048


def sized(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    size = F.expr(f"regexp_count(coalesce(text, ''), r'{WORD}')").cast("long").alias("size")
    return spread(own_columns(docs, "doc_id", "text", "source", *keep)).select("doc_id", "source", *keep, size)


def _name() -> Column:
    """The source as a value that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def _numbered(s: DataFrame) -> DataFrame:
    """`sid`: place of the source by code point, null last, from 0."""
    order = F.asc_nulls_last("source")
    s = s.repartitionByRange(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), order).sortWithinPartitions(order)
    s = cut(s.withColumn("at", F.monotonically_increasing_id()))
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    parts = s.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return s.withColumn("part", part).join(F.broadcast(before), "part").withColumn("sid", (row + F.col("before")).cast("int")).drop("at", "part", "before")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """sid, source, name, docs, source_size, target of each source: shares by weight, none above twice its size.

    `level` is what a unit of weight gets. Each pass takes the sources that reach their cap out and shares what is left; the
    level only rises, so that the capped only grow, and it ends when none joins them.
    """
    s = _numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")))
    w = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    s = cut(s.withColumn("w", w).withColumn("cap", 2.0 * F.col("source_size")).withColumn("name", _name()))
    sums = F.coalesce(F.sum("cap"), F.lit(0.0)).alias("cap"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")
    all_, held, level = s.agg(*sums).first(), (0.0, 0.0), None
    while all_.w > held[1]:
        level = (share * all_.cap / 2 - held[0]) / (all_.w - held[1])
        now = s.where(F.col("w") * level >= F.col("cap")).agg(*sums).first()
        if (now.cap, now.w) == held:
            break
        held, level = (now.cap, now.w), None
    target = F.col("cap") if level is None else F.least("cap", F.col("w") * level)
    return s.select("sid", "source", "name", "docs", "source_size", target.alias("target"))


def _running(df: DataFrame, group: str, digits: list[str], value: str, out: str) -> DataFrame:
    """`out`: the sum of `value` before the row, in order of the digits; no task sees more than one leading digit of a group."""
    sums = df.groupBy(group, *digits[:-1]).agg(F.sum(value).alias(value))
    if len(digits) > 1:
        sums = cut(sums)
        ahead = f"{out}_ahead"
        before = _running(sums, group, digits[:-1], value, ahead).select(group, *digits[:-1], ahead)
    w = Window.partitionBy(group, *digits[:-1]).orderBy(digits[-1]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn(out, F.sum(value).over(w) - F.col(value))
    if len(digits) > 1:
        df = df.join(before, [group, *digits[:-1]]).withColumn(out, F.col(out) + F.col(ahead)).drop(ahead)
    return df


def schedule(spark: SparkSession, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """The slots: k, sid, rank, block (of the source's stream), take (words of the block's start)."""
    goal = F.floor(F.col("target") + 0.5)
    full = F.floor(goal / F.col("source_size"))
    per_pass = F.ceil(F.col("source_size") / block)
    need = F.when(F.col("source_size") > 0, full * per_pass + F.ceil((goal - full * F.col("source_size")) / block)).otherwise(0).cast("long")
    s = sources.select("sid", "source_size", goal.cast("long").alias("goal"), per_pass.cast("long").alias("per_pass"), need.alias("need")).where("need > 0")
    all_, n = s.agg(F.sum("need"), F.count(F.lit(1))).first()
    if not n:
        return spark.createDataFrame([], "k long, sid int, rank long, block long, take long")
    pad = 8 + 2 * (all_ + 64 * n).bit_length()  # above what the counts of golden-ratio points can be off
    points = all_ + pad * n
    s = s.withColumn("all", F.lit(0)).withColumn("far", F.expr("sid div 1048576")).withColumn("near", F.expr("sid div 1024")).withColumn("width", F.col("need") + pad)
    s = _running(cut(s), "all", ["far", "near", "sid"], "width", "lo").withColumn("hi", F.col("lo") + F.col("width")).drop("all", "far", "near", "width")
    grid = max(1024, 1 << (2 * n).bit_length())  # cells: a few sources in each
    cell = lambda c: F.floor(F.col(c) * float(grid) / points)
    s = cut(s.withColumn("cell", F.explode(F.sequence(F.greatest(cell("lo") - 1, F.lit(0)), F.least(cell("hi") + 1, F.lit(grid - 1))))))
    k = F.col("k")
    x = F.expr(f"(k div 1048576) * {PHI20!r}D")
    x = (x - F.floor(x)) + (k % 1048576) * F.lit(PHI)
    p = spark.range(points).withColumnRenamed("id", "k").withColumn("x", x - F.floor(x))
    p = p.withColumn("cell", F.floor(F.col("x") * grid)).withColumn("y", F.col("x") * float(points))
    p = p.join(s, "cell").where("y >= lo AND y < hi").select("k", "sid", "source_size", "goal", "per_pass", "need", F.lit(1).cast("long").alias("one"))
    p = cut(p.withColumn("far", F.expr(f"k div {CHUNK * SUPER}")).withColumn("near", F.expr(f"k div {CHUNK}")))
    p = _running(p, "sid", ["far", "near", "k"], "one", "rank").where("rank < need")
    p = p.withColumn("block", F.expr("rank % per_pass"))
    start = F.expr(f"(rank div per_pass) * source_size + block * {block}")
    take = F.least(F.lit(block), F.col("source_size") - F.col("block") * block, F.col("goal") - start)
    return p.select("k", "sid", "rank", "block", take.cast("long").alias("take")).where("take > 0")


def mix(docs: DataFrame, block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken, and the kept columns."""
    spark = docs.sparkSession
    sizes = cut(sized(docs, keep))
    sources = cut(targets(sizes, weights, share))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")).cast("binary"))
    rows = spread_join(sizes.withColumn("name", _name()).drop("source"), sources.select("name", "sid", "docs", "source_size", "target"), ["name"], "docs")
    rows = rows.select("sid", "doc_id", *keep, "size", "source_size", "target", key.alias("key"), F.substring(key, 1, 3).alias("bin"))
    out = ("doc_id", "size", "source_size", "target", "taken", *keep)
    none = rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*out)
    some = cut(rows.where("size > 0").withColumn("order", F.struct("key", F.col("doc_id").isNull().alias("noid"), "doc_id", *keep)))
    some = _running(some, "sid", ["bin", "order"], "size", "off").select("sid", "doc_id", *keep, "size", "source_size", "target", "off")
    slots = cut(schedule(spark, sources, block).groupBy("sid", "block", "take").agg(F.count(F.lit(1)).alias("times")))
    parts = some.withColumn("block", F.explode(F.expr(f"sequence(off div {block}, (off + size - 1) div {block})")))
    parts = parts.join(slots, ["sid", "block"], "left")
    start = F.col("block") * block
    words = F.greatest(F.lit(0).cast("long"), F.least(F.col("off") + F.col("size"), start + F.col("take")) - F.greatest("off", start))
    taken = parts.groupBy("sid", "off", "doc_id", *keep, "size", "source_size", "target").agg(F.coalesce(F.sum(F.col("times") * words), F.lit(0)).cast("long").alias("taken"))
    return taken.select(*out).unionByName(none)


def op6_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source
), s1 AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][(sid % 3 + 1)::INT] AS w, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS total FROM s0
), s2 AS (
  SELECT *, (1.5::DOUBLE * total - (sum(cap) OVER up - cap)) / (sum(w) OVER () - sum(w) OVER up + w) AS level
  FROM s1 WINDOW up AS (ORDER BY source_size / w, sid ROWS UNBOUNDED PRECEDING)
), s AS (
  SELECT sid, source, source_size, coalesce(least(cap, w * (SELECT level FROM s2 WHERE level * w < cap ORDER BY source_size / w, sid LIMIT 1)), cap) AS target FROM s2
), n AS (
  SELECT sid, source_size, goal, per_pass, (goal // source_size) * per_pass + ceil((goal % source_size) / {BLOCK})::BIGINT AS need FROM (
    SELECT sid, source_size, floor(target + 0.5)::BIGINT AS goal, ceil(source_size / {BLOCK})::BIGINT AS per_pass FROM s WHERE source_size > 0)
), n1 AS (SELECT * FROM n WHERE need > 0
), a AS (
  SELECT sum(need)::BIGINT AS need, count(*) AS n, 8 + 2 * length(bin((sum(need) + 64 * count(*))::BIGINT)) AS pad FROM n1
), n2 AS (
  SELECT n1.*, sum(n1.need + pad) OVER (ORDER BY sid ROWS UNBOUNDED PRECEDING) - n1.need - pad AS lo, sum(n1.need + pad) OVER (ORDER BY sid ROWS UNBOUNDED PRECEDING) AS hi FROM n1, a
), k AS (SELECT unnest(range(0, (SELECT need + pad * n FROM a)::BIGINT)) AS k
), x0 AS (SELECT k, (k // 1048576) * {PHI20!r}::DOUBLE AS a FROM k
), x1 AS (SELECT k, (a - floor(a)) + (k % 1048576) * {PHI!r}::DOUBLE AS b FROM x0
), p AS (
  SELECT k, sid, source_size, goal, per_pass, need, row_number() OVER (PARTITION BY sid ORDER BY k) - 1 AS rank
  FROM (SELECT k, (b - floor(b)) * (SELECT need + pad * n FROM a)::DOUBLE AS y FROM x1) JOIN n2 ON y >= lo AND y < hi
), slots AS (
  SELECT sid, rank % per_pass AS block,
         least({BLOCK}, source_size - (rank % per_pass) * {BLOCK}, goal - ((rank // per_pass) * source_size + (rank % per_pass) * {BLOCK})) AS take
  FROM p WHERE rank < need
), o AS (
  SELECT sid, doc_id, size, source_size, target, sum(size) OVER (PARTITION BY sid ORDER BY md5(coalesce(doc_id::VARCHAR, '') || ':' || size), doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) - size AS off
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
), f AS (
  SELECT *, unnest(range((off // {BLOCK})::BIGINT, ((off + size - 1) // {BLOCK})::BIGINT + 1)) AS block FROM o WHERE size > 0
)
SELECT doc_id, size, source_size, target, coalesce(sum(greatest(0, least(off + size, f.block * {BLOCK} + coalesce(take, 0)) - greatest(off, f.block * {BLOCK}))), 0)::BIGINT AS taken
FROM f LEFT JOIN slots ON f.sid = slots.sid AND f.block = slots.block AND take > 0 GROUP BY f.sid, off, doc_id, size, source_size, target
UNION ALL SELECT doc_id, size, source_size, target, 0 FROM o WHERE size = 0
"""
