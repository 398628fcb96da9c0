"""Secret scans in DataFrame operations alone: fixed patterns, and sliding-window Shannon entropy per character class.

A regular expression marks its matches in the text with two control characters; the marked text is split, and the pieces'
lengths give the spans in code points. Candidate strings of a class (base64-like, hexadecimal) are scanned with a window
of fixed length: moving it by one character changes the counts of two characters, and with them the sum of c*log2(c)
from which the entropy follows. A candidate's span runs from the first to the last window at or above the class's
threshold. An allow-list suppresses entropy spans (words, numbers, placeholders); spans of fixed patterns stay.

Defined results: null and empty texts have no spans and the hash of the empty string; repeated rows and null ids stay; an empty
table gives an empty result; columns other than doc_id and text are left out, whatever their names; the marks' own characters in a text count as other characters. Times are linear in a
candidate's length, and in the text's: the pieces are summed up in groups of GROUP.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_columns, read, spread, text_of

GROUP = 256
#: Parts of a bit in which entropies are summed.
UNIT = 1 << 40
#: The contract's patterns. Group 2 is what must be long enough. Of access and hex, only long runs are
#: marked: a match ends where its run ends, so a short match never hides a long one.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 6),
    "access": (r"()(AKIA[A-Z0-9]{16,})", 20),
    "hex": (r"()([0-9a-f]{24,})", 24),
}


NEEDS = {"assign": ":=", "access": "K"}


@dataclass(frozen=True)
class EntropyClass:
    kind: str
    pattern: str
    window: int
    bits: float


CLASSES = (EntropyClass("entropy64", r"()([A-Za-z0-9+/_=-]{20,})", 20, 3.87), EntropyClass("entropy16", r"()([0-9A-Fa-f]{20,})", 20, 2.97))
#: Candidates that match are no secrets: no digit or no letter, joined words, placeholders.
ALLOW = (r"^[^0-9]*$", r"^[^A-Za-z]*$", r"^[A-Za-z][A-Za-z/_=-]*[0-9]{0,4}$", r"(?i)example|placeholder|dummy|sample|xxxx|0000|1234567")


def pieces(text: Column, pattern: str, needs: str = "") -> Column:
    """The text cut at the pattern's matches: every second piece is a match, as prefix, mark, rest.

    needs: every match has one of these characters; other texts are not searched.
    """
    clean = F.when((F.instr(text, "\x01") > 0) | (F.instr(text, "\x02") > 0), F.translate(text, "\x01\x02", "\x03\x03")).otherwise(text)
    marked = F.regexp_replace(clean, pattern, "\x01$1\x02$2\x01")
    if needs:
        marked = F.when(_any([F.contains(text, F.lit(c)) for c in needs]), marked).otherwise(clean)
    return F.split(marked, "\x01", -1)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(lengths: Column, upto: Column) -> Column:
    return F.aggregate(F.slice(lengths, F.lit(1), upto), F.lit(0), lambda a, b: a + b)


def spans(pieces: Column) -> Column:
    """array<struct<start, end, tail>> of the matches; tail: the pattern's second group."""

    def found(part: Column, lengths: Column) -> Column:
        even = F.filter(F.sequence(F.lit(1), F.size(part)), lambda i: i % 2 == 0)
        one = lambda i: F.struct(_total(lengths, i - 1).alias("start"), _total(lengths, i).alias("end"), F.substring_index(F.element_at(part, i), "\x02", -1).alias("tail"))
        return F.struct(_total(lengths, F.size(part)).alias("length"), F.transform(even, one).alias("found"))

    def group(part: Column) -> Column:
        return _let(F.transform(part, lambda p: F.length(F.replace(p, F.lit("\x02"), F.lit("")))), lambda lengths: found(part, lengths))

    def grouped(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / GROUP).cast("int")), lambda g: _let(F.slice(p, g * GROUP + 1, GROUP), group))

    def shifted(groups: Column) -> Column:
        move = lambda g, base: F.transform(g["found"], lambda s: F.struct((s["start"] + base).alias("start"), (s["end"] + base).alias("end"), s["tail"].alias("tail")))
        lengths = F.transform(groups, lambda g: g["length"])
        return F.flatten(_let(lengths, lambda n: F.transform(groups, lambda g, i: _let(_total(n, i), lambda base: move(g, base)))))

    return F.when(F.size(pieces) > 1, _let(pieces, lambda p: _let(grouped(p), shifted)))


def hot_windows(s: Column, window: int, bits: float) -> Column:
    """struct<first, last>: starts of the first and last window whose entropy reaches `bits`; null if none does.

    A window's sum of c*log2(c) moves by what the character that comes in adds to the count of its kind, and by what the one
    that goes out takes away; both counts are taken over the characters that stay, window - 1 of them. Sums are whole
    numbers of 1 / UNIT, so that they do not drift over long candidates.
    """
    term = [round(c * math.log2(c) * UNIT) if c else 0 for c in range(window + 1)]
    gain = F.array(*[F.lit(term[d + 1] - term[d]).cast("long") for d in range(window)])  # one more beside d of a kind
    most = int((math.log2(window) - bits) * window * UNIT)  # the entropy reaches `bits` while the sum is at most this

    def moves(codes: Column) -> Column:
        def move(i: Column) -> Column:
            staying = F.slice(codes, F.greatest(i - window + 1, F.lit(1)), F.least(i - 1, F.lit(window - 1)))
            beside = lambda kept, at: F.element_at(gain, F.size(F.filter(kept, lambda x: x == F.element_at(codes, at))) + 1)
            return _let(staying, lambda kept: beside(kept, i) - F.when(i > window, beside(kept, i - window)).otherwise(F.lit(0).cast("long")))

        return F.transform(F.sequence(F.lit(1), F.size(codes)), move)

    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("read"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def step(state: Column, moved: Column) -> Column:
        read, total = state["read"] + 1, state["sum"] + moved
        hot = (read >= window) & (total <= most)
        at = read - window
        return F.struct(total.alias("sum"), read.alias("read"), F.when(hot & state["first"].isNull(), at).otherwise(state["first"]).alias("first"), F.when(hot, at).otherwise(state["last"]).alias("last"))

    codes = F.filter(F.split(s, ""), lambda c: c != "")
    return _let(F.aggregate(_let(codes, moves), start, step, lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"))), lambda done: F.when(done["first"].isNotNull(), done))


def _kinds(classes: tuple[EntropyClass, ...]) -> list[str]:
    return [*BASE, *(c.kind for c in classes)]


def _span(start: Column, kind: int, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))


def _fixed(found: Column, kind: int, least: int) -> Column:
    kept = F.filter(found, lambda s: F.length(s["tail"]) >= least)
    return F.transform(kept, lambda s: _span(s["start"], kind, s["end"]))


def _entropic(found: Column, kind: int, c: EntropyClass, allow: tuple[str, ...]) -> Column:
    kept = F.filter(found, lambda s: ~_any([s["tail"].rlike(a) for a in allow]))
    hot = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), hot_windows(s["tail"], c.window, c.bits).alias("hot")))
    return F.transform(F.filter(hot, lambda s: s["hot"].isNotNull()), lambda s: _span(s["start"] + s["hot"]["first"], kind, s["start"] + s["hot"]["last"] + c.window))


def scan(docs: DataFrame, classes: tuple[EntropyClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, and found: array<struct<start, kind (number), end>> in order."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    d = spread(own_columns(docs, "doc_id", "text")).select("doc_id", text_of().alias("text"))
    patterns = {**{k: p for k, (p, _) in BASE.items()}, **{c.kind: c.pattern for c in classes}}
    d = d.select("doc_id", *[pieces(F.col("text"), p, NEEDS.get(k, "")).alias(f"p_{k}") for k, p in patterns.items()])
    d = d.select("doc_id", *[spans(F.col(f"p_{k}")).alias(f"s_{k}") for k in patterns])
    lists = [F.coalesce(_fixed(F.col(f"s_{k}"), n, least), none).alias(k) for n, (k, (_, least)) in enumerate(BASE.items())]
    lists += [F.coalesce(_entropic(F.col(f"s_{c.kind}"), n, c, allow), none).alias(c.kind) for n, c in enumerate(classes, len(BASE))]
    return d.select("doc_id", *lists)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _joined(lists: list[str], kinds: list[str]) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    ordered = F.array_sort(F.concat(*[F.col(k) for k in lists]))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = _kinds(CLASSES)
    d = scan(read(spark, sf_dir, "documents"))
    return d.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(_joined(list(BASE), kinds).cast("binary"), 256).alias("base_sha256"), _joined(kinds, kinds).alias("spans"))


def _sql() -> str:
    """The same in DuckDB: spans from the lengths of the pieces, entropies of all windows from their counts."""
    kinds = _kinds(CLASSES)
    patterns = [*((k, p, least) for k, (p, least) in BASE.items()), *((c.kind, c.pattern, 0) for c in CLASSES)]
    cuts = " UNION ALL ".join(f"SELECT doc_id, {n} AS kind, {least} AS least, string_split(regexp_replace(t, '{p.replace(chr(39), chr(39) * 2)}', chr(1) || '\\1' || chr(2) || '\\2' || chr(1), 'g'), chr(1)) AS p FROM d" for n, (k, p, least) in enumerate(patterns))
    allow = " OR ".join(f"regexp_matches(tail, '{a}')" for a in ALLOW)
    windows = " UNION ALL ".join(f"SELECT *, {c.window} AS w, {c.bits} AS bits FROM m WHERE kind = {len(BASE) + n} AND NOT ({allow})" for n, c in enumerate(CLASSES))
    names = "[" + ", ".join(f"'{k}'" for k in kinds) + "]"
    return rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS t FROM documents
), c AS ({cuts}
), e AS (SELECT doc_id, kind, least, unnest(p) AS p, unnest(range(1, len(p) + 1)) AS i FROM c WHERE len(p) > 1
), l AS (SELECT *, length(replace(p, chr(2), '')) AS n FROM e
), q AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto FROM l
), m AS (SELECT doc_id, kind, upto - n AS start, upto AS stop, string_split(p, chr(2))[2] AS tail FROM q WHERE i % 2 = 0 AND length(string_split(p, chr(2))[2]) >= least
), b AS (SELECT doc_id, kind, start, stop FROM m WHERE kind < {len(BASE)}
), w0 AS ({windows}
), w1 AS (SELECT *, unnest(range(0, length(tail) - w + 1)) AS pos FROM w0
), w2 AS (SELECT *, unnest(string_split(substr(tail, pos + 1, w), '')) AS ch FROM w1
), w3 AS (SELECT doc_id, kind, start, pos, w, bits, ch, count(*) AS n FROM w2 WHERE ch <> '' GROUP BY ALL
), w4 AS (SELECT doc_id, kind, start, pos, w FROM w3 GROUP BY doc_id, kind, start, pos, w, bits HAVING sum(n * log2(n)) <= (log2(w) - bits) * w
), x AS (SELECT doc_id, kind, start + min(pos) AS start, start + max(pos) + w AS stop FROM w4 GROUP BY doc_id, kind, w4.start, w
), a AS (SELECT * FROM b UNION ALL SELECT * FROM x
), g AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         coalesce(string_agg({names}[kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind) FILTER (kind < {len(BASE)}), '') AS base,
         string_agg({names}[kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind) AS spans
  FROM a GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


SQL = _sql()
