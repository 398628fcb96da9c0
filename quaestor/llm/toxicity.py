"""Toxicity behind obfuscation: a noisy-channel decoder, then a score of the restored text.

Tokens that look written around a filter (letters mixed with digits and symbols, separators between letters, letters
repeated three times and more) and runs of short tokens (words that are spelled or broken up) become lattices of characters:
a symbol may stand for the letters it resembles, a separator for nothing, a run of a letter for one or two, and a space for a
word's end or for nothing. Viterbi finds the path of least cost under a character trigram model and the channel's costs. The
restored text is scored by naive Bayes over words and word beginnings whose association with label 1 is significant (G2 of at
least MIN_G2) and strong (a log ratio of at least MIN_WEIGHT).

The trigrams are counted over all documents; they are of the letters of LETTERS, so their table is bounded. The classifier is
learned from a bounded sample of the labelled training rows: SAMPLE rows at most, those of least hash.

Runs of short tokens are most of any text, so only those are decoded whose skeleton (one letter for all that look alike, no
repeats, no spaces) holds the skeleton of a feature: no path through another run's lattice could spell one.

Defined results: null and empty texts get the prior; scores lie between 0 and 1; repeated rows and null ids stay; without
labelled rows every score is 0; conflicting labels of one document count one each; an empty table gives an empty result;
columns other than doc_id, text and toxic are left out. Texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, own_columns, read, remainder, spread

SAMPLE = 20_000
MIN_G2, MIN_WEIGHT, PREFIX, SUPPORT = 16.0, 3.7, 5, 2
#: Letters that digits and symbols resemble.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = set(".-_*~'`^,:;/\\#")
EDGE = " \t\n\r\x0b\x0c.,;:!?\"'()[]{}<>«»„“”…*#~^`-_%&=/\\"
#: Letters of the character model: a to z and those of Latin-1.
LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
#: Two tokens and more of at most four characters each; three single letters and more among such tokens.
SHORT = re.compile(r"(?<!\S)\S{1,4}(?:[ ]{1,2}\S{1,4})+(?!\S)")
SPELLED = re.compile(r"(?<!\S)[^\W\d_](?: {1,2}[^\W\d_]){2,}(?!\S)")
REPEATED = re.compile(r"(.)\1\1")
#: Cost of a space that is no word's end.
JOIN = 0.3
REMEMBER, WORDS = 400_000, 200_000
_ALIKE = str.maketrans({**dict.fromkeys("".join(SEPARATORS) + EDGE, ""), **{k: "i" if v in ("il", "l") else v for k, v in LEET.items()}, "l": "i"})


def skeleton(text: str) -> str:
    """What all readings of a text share: letters that look alike as one, no separators, spaces and repeats."""
    return re.sub(r"(.)\1+", r"\1", text.translate(_ALIKE))


class Channel:
    """Character trigram model with back-off by interpolation, and the lattice decoder."""

    def __init__(self, grams: dict[str, int]):
        two, three, one = Counter(), Counter(), Counter()
        for g, n in grams.items():
            three[g] += n
            two[g[1:]] += n
            one[g[2]] += n
        self.three, self.two, self.one = three, two, one
        self.before3, self.before2 = Counter(), Counter()
        for g, n in three.items():
            self.before3[g[:2]] += n
            self.before2[g[1]] += n
        self.total = sum(one.values()) or 1
        self.memory: dict[str, float] = {}

    def cost(self, a: str, b: str, c: str) -> float:
        g = a + b + c
        x = self.memory.get(g)
        if x is None:
            p = 0.05 * (self.one[c] + 0.1) / (self.total + 10)
            p += 0.25 * self.two[b + c] / self.before2[b] if self.before2[b] else 0
            p += 0.7 * self.three[g] / self.before3[a + b] if self.before3[a + b] else 0
            x = self.memory[g] = -math.log(p + 1e-9)
        return x

    @staticmethod
    def lattice(token: str) -> list[list[tuple[str, float]]]:
        """For each run of a character, what it may stand for and at what cost."""
        out = []
        for m in re.finditer(r"(.)\1*", token, re.S):
            c, n = m[1], len(m[0])
            if c == " ":
                out.append([(" ", 0.0), ("", JOIN)])
            elif c.isalpha():
                out.append([(c, 0.2 if n > 2 else 0.0 if n == 1 else 1.5), *([(c * 2, 0.0 if n == 2 else 0.7)] if n > 1 else [])])
            elif c in LEET:
                out.append([(x * k, 0.7 * k) for x in LEET[c] for k in ((1, 2) if n > 1 else (1,))])
            else:
                out.append([("", 0.3 if c in SEPARATORS else 2.0)])
        return out

    def decode(self, token: str) -> str:
        """The letters of least cost. Times are linear in the token: a state is the last two letters."""
        states: dict[tuple[str, str], tuple[float, tuple | None]] = {("^", "^"): (0.0, None)}
        for options in self.lattice(token):
            after: dict[tuple[str, str], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in states.items():
                for letters, own in options:
                    x, y, total, way = a, b, cost + own, path
                    if letters == " ":  # a word ends and another starts
                        if y == "^":
                            continue
                        total, x, y, way = total + self.cost(x, y, "$"), "^", "^", (" ", way)
                    else:
                        for c in letters:
                            total, x, y, way = total + self.cost(x, y, c), y, c, (c, way)
                    if (x, y) not in after or after[x, y][0] > total:
                        after[x, y] = (total, way)
            states = after
        way = min(((cost + self.cost(a, b, "$"), path) for (a, b), (cost, path) in states.items()), key=lambda x: x[0], default=(0, None))[1]
        out = []
        while way:
            out.append(way[0])
            way = way[1]
        return "".join(reversed(out))

    def restore(self, token: str) -> str:
        """A lower-case token as a word; tokens without disguise stay as they are, without punctuation around."""
        if token.isalpha() and not REPEATED.search(token):
            return token
        core = token.strip(EDGE)
        if core.isalpha() and not REPEATED.search(core):
            return core
        core = token.strip("\"'()[]{}<>«»„“”….,;:?%&=~^`#").rstrip("!?.")
        if not any(c.isalpha() for c in core):
            return ""
        return self.decode(core)


    def words(self, run: str) -> list[str]:
        """The words of a run of short tokens, wherever its spaces stand; and, as `a` and `i` are words of their own, what is
        left of a word without one of them at its ends."""
        parts = [p.strip("\"'()[]{}<>«»„“”….,;:?%&=~^`#").rstrip("!?.") for p in run.split()]
        out = self.decode(" ".join(filter(None, parts))).split()
        alone = {"a", "i"}.intersection(parts)
        return out + [w[1:] for w in out if w[0] in alone and len(w) > 3] + [w[:-1] for w in out if w[-1] in alone and len(w) > 3]


def tokens(text: str) -> set[str]:
    """Distinct lower-case tokens."""
    return set(text.lower().split())


def runs(text: str, pattern: re.Pattern = SHORT) -> set[str]:
    """Distinct runs of short tokens in a lower-case text."""
    return {m[0] for m in pattern.finditer(text)}


def features(word: str) -> list[str]:
    return [word, *([word[:PREFIX] + "*"] if len(word) > PREFIX else [])] if word else []


def trigrams(docs: DataFrame) -> dict[str, int]:
    """Trigrams of the letters of all documents' words, those that occur more than once. docs: text."""

    def grams(batches):
        import pyarrow as pa

        words: Counter = Counter()

        def told():
            n: Counter = Counter()
            for w, k in words.items():
                w = w.strip(EDGE)
                if LETTERS.fullmatch(w):
                    w = f"^^{w}$"
                    for i in range(len(w) - 2):
                        n[w[i : i + 3]] += k
            words.clear()
            return pa.RecordBatch.from_pydict({"gram": list(n), "n": list(n.values())}, schema=pa.schema([("gram", pa.string()), ("n", pa.int64())]))

        for b in batches:
            for t in b.column("text").to_pylist():
                if t:
                    words.update(t.lower().split())
                    if len(words) > WORDS:
                        yield told()
        yield told()
        give_back()

    n = spread(own_columns(docs, "text")).mapInArrow(grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: r.n for r in n.where("n > 1").collect()}  # of LETTERS: bounded


def learn(rows: DataFrame, found: dict[str, int]) -> tuple[dict[str, int], dict[str, float], float]:
    """Trigram counts (found), weights of features, prior. rows: text, toxic of the sample."""
    spark = rows.sparkSession

    def seen(batches):
        import pyarrow as pa

        channel, memory = Channel(found), {}
        for b in batches:
            n: Counter = Counter()
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                own = set()
                for w in tokens(t or ""):
                    if (f := memory.get(w)) is None:
                        if len(memory) > REMEMBER:
                            memory.clear()
                        f = memory[w] = features(channel.restore(w))
                    own.update(f)
                for run in runs((t or "").lower(), SPELLED):
                    own.update(f for w in channel.words(run) for f in features(w))
                n.update((f, y) for f in own)
            yield pa.RecordBatch.from_pydict({"f": [f for f, _ in n], "toxic": [y for _, y in n], "n": list(n.values())}, schema=pa.schema([("f", pa.string()), ("toxic", pa.int32()), ("n", pa.int64())]))

    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 + n0:
        return found, {}, 0.0
    counts = rows.select("text", "toxic").mapInArrow(seen, "f string, toxic int, n long").groupBy("f").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    share = (a + b) / float(n1 + n0)
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    g2 = 2 * (part(a, share * n1) + part(b, share * n0) + part(n1 - a, (1 - share) * n1) + part(n0 - b, (1 - share) * n0))
    weight = F.log((a + 0.5) / (n1 + 1.0)) - F.log((b + 1.5) / (n0 + 2.0))
    # Of a bounded sample; only features that speak for label 1.
    kept = counts.where(f"a >= {SUPPORT}").select("f", g2.alias("g2"), weight.alias("w")).where(f"g2 >= {MIN_G2} AND w >= {MIN_WEIGHT}").collect()
    weights = {r.f: r.w for r in kept}

    def hits(batches):
        import pyarrow as pa

        channel = Channel(found)
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                words = [channel.restore(w) for w in tokens(t or "")] + [w for run in runs((t or "").lower(), SPELLED) for w in channel.words(run)]
                out.append(sorted({f for w in words for f in features(w) if f in weights}))
            yield pa.RecordBatch.from_pydict({"hits": out}, schema=pa.schema([("hits", pa.list_(pa.string()))]))

    # Rare words of a toxic text, and of its copies, stand beside the words that make it toxic: a feature stays if it is the
    # most significant one of at least SUPPORT texts.
    having: dict[str, set[int]] = {}
    for i, r in enumerate(rows.where("toxic = 1").mapInArrow(hits, "hits array<string>").collect()):
        for f in r.hits:
            having.setdefault(f, set()).add(i)
    explained: set[int] = set()
    stay = {}
    for r in sorted(kept, key=lambda r: (-r.g2, r.f)):
        if len(own := having.get(r.f, set()) - explained) >= SUPPORT:
            explained |= own
            stay[r.f] = r.w
    return found, stay, (n1 + 0.5) / (n1 + n0 + 1.0)


def score(docs: DataFrame, model: tuple[dict[str, int], dict[str, float], float]) -> DataFrame:
    """doc_id and score of each row."""
    grams, weights, prior = model

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        channel = Channel(grams)
        memory: dict[str, str] = {}
        spelled: dict[str, frozenset[str]] = {}
        shapes = ahocorasick.Automaton()
        for f in weights:
            shapes.add_word(skeleton(f.rstrip("*")), True)
        shapes.make_automaton()
        start = math.log(prior / (1 - prior)) if 0 < prior < 1 else -math.inf

        def best_of(word: str) -> str:
            hits = [x for x in features(word) if x in weights]
            return max(hits, key=weights.__getitem__) if hits else ""

        def decoded(text: str) -> frozenset[str]:
            if (x := spelled.get(text)) is None:
                if len(spelled) > REMEMBER:
                    spelled.clear()
                x = spelled[text] = frozenset(filter(None, map(best_of, channel.words(text))))
            return x

        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                found: set[str] = set()
                for w in tokens(t or ""):
                    f = memory.get(w)
                    if f is None:
                        if len(memory) > REMEMBER:
                            memory.clear()
                        f = memory[w] = best_of(channel.restore(w))
                    if f:
                        found.add(f)
                if weights and t:
                    for text in SHORT.findall(t.lower()):
                        shape = text.replace(" ", "")  # a mark at a token's end may be read or left out
                        if next(shapes.iter(skeleton(shape)), None) or "!" in shape and next(shapes.iter(skeleton(shape.replace("!", ""))), None):
                            found |= decoded(text)
                z = start + sum(weights[f] for f in sorted(found))
                out.append(1 / (1 + math.exp(-max(z, -700.0))) if z > -math.inf else 0.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])
        give_back()

    d = spread(own_columns(docs, "doc_id", "text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double")


def sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """text, toxic of at most `bound` labelled training rows (held-out rows are left out), those of least hash."""
    own = own_columns(labels, "doc_id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", 3) != 1))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(bound)
    return own_columns(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def op8_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    out = score(docs, learn(sample(docs, labels), trigrams(docs)))
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
