"""Alignment of two tokenizers' tokens over one text, and counts of linked ids over all documents.

A text with a space in front is encoded by tokenizer A (byte-level) and, without that space, by tokenizer B (pieces, which adds
it). A two-pointer merge of the tokens' cumulative ends cuts both sequences where ends coincide: the tokens between two
such places are a group, and each A token of a group is linked to each of its B tokens. No token of either side crosses a
single space between two characters that are not white space, so texts fall into segments there, which are
encoded and merged by themselves; segments repeat a lot, so each worker remembers short ones.

Each task packs its documents: a packet (an Arrow batch) has a table of the distinct id pairs that its documents hold, with the
number of documents for each, and documents refer to that table by place. Spark sums the tables' counts by pair, takes
the largest count of each A id and of each B id, and joins both back to the packets' tables, not to the documents' links; packets
then meet their answers. A packet's table has at most as many pairs as its texts have links, about 4 MB of text.

Defined results: texts that are null, empty, or that one tokenizer does not spell byte for byte (U+2581 itself, for one)
have no tokens: zeros and an empty groups_sha256; repeated rows count as documents each, and they and null ids stay; an
empty table gives an empty result; columns other than doc_id and text are left out, whatever their names. Texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, only, own_columns, read, spread

#: What a worker remembers of segments, in bytes, about; characters that are encoded in one call.
REMEMBER, CALL = 96 << 20, 1 << 16
#: Between a character and a single space with another character behind: where no token of either side goes across.
EDGE = re.compile(r"(?<=\S)(?= \S)")
#: White space other than the space.
WHITE = [chr(c) for c in (*range(9, 14), *range(28, 32), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)]
#: Links of a group beyond which they are counted by distinct ids instead of one by one.
WIDE = 4096
#: Fixed value: how the byte-level tokenizer cuts texts before it merges.
CUTTER = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What follows a token in the text of groups: another of its side, the other side, another group, nothing.
MARKS = [",", "|", ";", ""]
#: An id pair as one number.
SIDE = 32


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level tokenizers write bytes: printable ones stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_level(path: str):
    """An encoder of the file's vocabulary (text to ids, no special tokens), and the bytes of each id.

    tiktoken merges by rank, so ids must follow the order of merges; files that are not so, or cut texts otherwise, are refused.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, cutter = file["model"], file["pre_tokenizer"]
    special, letters = {t["content"] for t in file["added_tokens"]}, byte_letters()
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
    made = [vocabulary[t if isinstance(t, str) else "".join(t)] for t in (m.replace(" ", "") if isinstance(m, str) else m for m in model["merges"])]
    if file["normalizer"] or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or model.get("ignore_merges") or made != sorted(made) or made[0] < 256:
        raise ValueError("not a byte-level vocabulary in the order of its merges")
    ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items()}
    by_id = [b""] * (1 + max(model["vocab"].values()))
    for t, i in ranks.items():
        by_id[i] = t
    return tiktoken.Encoding("byte level", pat_str=CUTTER, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, by_id


def merged(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Both runs of cumulative ends merged; for each end that both have: how many A tokens and B tokens lie before it."""
    both = np.concatenate([a_ends, b_ends])
    both.sort(kind="stable")  # two sorted runs: one merge
    twice = both[1:][both[1:] == both[:-1]]
    return np.stack([np.searchsorted(a_ends, twice) + 1, np.searchsorted(b_ends, twice) + 1], axis=1)


def keys(text: str) -> list[str]:
    """The text's segments, each without the space in front of it."""
    white = WHITE[:9] if text.isascii() else WHITE
    if text[0] != " " and text[-1] != " " and "  " not in text and not any(c + " " in text or " " + c in text for c in white):
        return text.split(" ")  # the common case: every space is an edge
    return [s[1:] for s in EDGE.split(" " + text)]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each range, one after the other."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))


class Aligner:
    """Both tokenizers of a worker, and the segments that it remembers, by number."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a, self.a_bytes = byte_level(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.a_long, self.b_long = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        ids = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.written = np.array([i + mark for i in ids for mark in MARKS], object)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.pair_number: dict[int, int] = {}
        self.pair = np.empty(0, np.int64)  # id pairs by number
        self.counts = np.empty((0, 5), np.int64)  # A tokens, B tokens, groups, links, spelled (0 or 1)
        self.start, self.links, self.times = np.zeros(1, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)  # links of segment k: start[k] to start[k + 1]
        self.size = 0

    # -- segments that are new

    def learn(self, fresh: list[str]) -> None:
        """Numbers and entries for segments; those that start or end in white space are encoded by themselves."""
        part: list[str] = []
        length, got = 0, []
        for k in fresh:
            if not k or k[0].isspace() or k[-1].isspace():
                got += self._encoded([k])
                continue
            part.append(k)
            length += len(k)
            if length > CALL:
                got += self._encoded(part)
                part, length = [], 0
        if part:
            got += self._encoded(part)
        self._store(got)

    def _encoded(self, part: list[str]) -> list[tuple]:
        """(segments, groups' texts, counts, links by segment, pairs, times) of segments that stand beside one another in one text."""
        text = " ".join(part)
        raw = " " + text
        a, b = self.a(raw), self.b.encode(text, num_threads=1)
        raw = raw.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            if len(part) == 1:
                return [(part, [""], np.zeros((1, 5), np.int64), np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]
            half = len(part) // 2
            return self._encoded(part[:half]) + self._encoded(part[half:])
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends = np.cumsum(self.a_long[a])
        to = merged(ends, np.cumsum(self.b_long[b]))  # groups' ends, in tokens
        last = np.cumsum([len(k.encode()) + 1 for k in part])  # segments' ends, in bytes,
        upto = np.searchsorted(ends[to[:, 0] - 1], last) + 1  # and in groups
        n_a, n_b = np.diff(to, axis=0, prepend=0).T
        group_a, group_b = np.repeat(np.arange(len(to)), n_a), np.repeat(np.arange(len(to)), n_b)
        # Written down: of each group the A tokens, then the B tokens, each with the mark that follows it.
        out = np.empty(len(a) + len(b), np.int64)
        at_a, at_b = np.arange(len(a)) + (to[:, 1] - n_b)[group_a], np.arange(len(b)) + to[:, 0][group_b]
        out[at_a], out[at_b] = a * len(MARKS), b * len(MARKS)
        out[at_a[to[:, 0] - 1]] += MARKS.index("|")
        out[at_b[to[:, 1] - 1]] += MARKS.index(";")
        out[at_b[to[upto - 1, 1] - 1]] += MARKS.index("") - MARKS.index(";")
        words, stops = self.written[out].tolist(), [0, *to[upto - 1].sum(axis=1).tolist()]
        groups = ["".join(words[i:j]) for i, j in zip(stops, stops[1:])]
        bounds = np.append(0, upto)
        product = n_a * n_b
        whole = lambda v: np.add.reduceat(v, bounds[:-1])
        counts = np.stack([whole(n_a), whole(n_b), np.diff(bounds), whole(product), np.ones(len(part), np.int64)], axis=1)
        pair, time, per_group = self._links(a, b, n_a, n_b, product)
        return [(part, groups, counts, whole(per_group), pair, time)]

    def _links(self, a, b, n_a, n_b, product):
        """Pairs with times, and how many stand for each group."""
        if product.max() > WIDE:
            (a, ta, n_a), (b, tb, n_b) = _distinct(a, n_a), _distinct(b, n_b)
        else:
            ta, tb = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
        each = np.repeat(n_b, n_a)  # for each A token the B tokens of its group
        right = _ranges(np.repeat(np.cumsum(n_b) - n_b, n_a), each)
        return np.repeat(a, each) << SIDE | b[right], np.repeat(ta, each) * tb[right], n_a * n_b

    def _store(self, got: list[tuple]) -> None:
        pairs = np.concatenate([g[4] for g in got])
        known, place = np.unique(pairs, return_inverse=True)
        number = self.pair_number
        links = np.array([number.setdefault(p, len(number)) for p in known.tolist()], np.int32)[place]
        self.pair = np.concatenate([self.pair, np.fromiter(itertools.islice(number, len(self.pair), None), np.int64, len(number) - len(self.pair))])
        for g in got:
            self.number.update(zip(g[0], range(len(self.groups), len(self.groups) + len(g[0]))))
            self.groups += g[1]
            self.size += sum(map(len, g[0])) + sum(map(len, g[1])) + 200 * len(g[0])
        self.size += 12 * len(links)
        self.counts = np.concatenate([self.counts, *[g[2] for g in got]])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.concatenate([g[3] for g in got]))])
        self.links = np.concatenate([self.links, links])
        self.times = np.concatenate([self.times, *[g[5] for g in got]])

    # -- texts

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For each text the counts and the groups' digest, and for each text and pair that it holds: text, number of the pair, times."""
        if self.size > REMEMBER:
            self.forget()
        parts = [keys(t) if t else [] for t in texts]
        flat = [k for p in parts for k in p]
        found = list(map(self.number.get, flat))
        missing = [i for i, k in enumerate(found) if k is None]
        if missing:
            self.learn(list(dict.fromkeys([flat[i] for i in missing])))
            for i in missing:
                found[i] = self.number[flat[i]]
        n, lengths = len(texts), np.array([len(p) for p in parts], np.int64)
        seg, doc = np.array(found, np.int64), np.repeat(np.arange(n), lengths)
        bad = np.zeros(n, bool)
        bad[doc[self.counts[seg, 4] == 0]] = True
        sha, at, groups = [], 0, self.groups
        for k, m in enumerate(lengths.tolist()):
            own = found[at : at + m]
            sha.append("" if not m or bad[k] else hashlib.sha256(";".join([groups[i] for i in own]).encode()).hexdigest())
            at += m
        seg, doc = seg[~bad[doc]], doc[~bad[doc]]
        each = self.start[seg + 1] - self.start[seg]
        where = _ranges(self.start[seg], each)
        code = np.repeat(doc, each) << SIDE | self.links[where]
        times = self.times[where]
        if len(times) and times.max() > 1:
            code, place = np.unique(code, return_inverse=True)
            times = np.bincount(place, times).astype(np.int64)
        else:
            code.sort()
            first = np.flatnonzero(np.diff(code, prepend=-1))
            code, times = code[first], np.diff(first, append=len(code))
        counts = np.stack([np.bincount(doc, self.counts[seg, k], n).astype(np.int64) for k in range(4)], axis=1)
        return counts, sha, code >> SIDE, code & ((1 << SIDE) - 1), times


def _distinct(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each group the distinct ids, their times, and their number."""
    code, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) << SIDE | ids, return_counts=True)
    return code & ((1 << SIDE) - 1), times, np.bincount(code >> SIDE, minlength=len(sizes))


@lru_cache(1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


PACKET = "packet long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places array<int>, times array<long>, pairs array<long>, holders array<long>"


def _lists(values: np.ndarray, lengths: np.ndarray, kind):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, kind))


def _packet(al: Aligner, number: int, ids, texts: list[str | None]):
    """The packet's documents, and its table of pairs as one more row at the end."""
    import pyarrow as pa

    n = len(texts)
    counts, sha, doc, link, times = al.align(texts)
    holders = np.bincount(link, minlength=len(al.pair))
    held = np.flatnonzero(holders)
    place = (np.cumsum(holders > 0) - 1)[link]
    lengths = np.append(np.bincount(doc, minlength=n), 0)
    none = np.zeros(n + 1, np.int64)
    none[n] = len(held)
    longs = lambda v: pa.array(np.append(v, 0), pa.int64())
    fields = [
        pa.concat_arrays([ids, pa.nulls(1, ids.type)]), pa.array(np.full(n + 1, number), pa.int64()), *[longs(counts[:, k]) for k in range(4)], pa.array([*sha, None], pa.string()),
        _lists(place, lengths, pa.int32()), _lists(times, lengths, pa.int64()), _lists(al.pair[held], none, pa.int64()), _lists(holders[held], none, pa.int64()), pa.array(np.arange(n + 1) == n),
    ]
    return pa.RecordBatch.from_arrays(fields, ["doc_id", *(f.split()[0] for f in PACKET.split(", ")), "is_table"])


def packets(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Documents' alignments in packets, with one more row (is_table) for each packet's pairs."""

    def run(batches):
        from pyspark import TaskContext

        al = aligner(a_path, b_path)
        only("alignment", al.forget)
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            if b.num_rows:
                yield _packet(al, number, b.column("doc_id"), b.column("text").to_pylist())
                number += 1

    d = spread(own_columns(docs, "doc_id", "text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {PACKET}, is_table boolean")


def pair_counts(tables: DataFrame) -> DataFrame:
    """pair, count (documents that hold it), best (no pair of its A id has more), b_best (likewise of its B id)."""
    counts = cut(tables.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.holders").alias("count")))
    a, b = F.shiftright("pair", SIDE), F.col("pair").bitwiseAND((1 << SIDE) - 1)
    most = lambda side, name: counts.groupBy(side.alias(name)).agg(F.max("count").alias(f"most_{name}"))
    both = counts.withColumn("a", a).withColumn("b", b).join(most(a, "a"), "a").join(most(b, "b"), "b")
    return cut(both.select("pair", "a", "b", "count", (F.col("count") == F.col("most_a")).alias("best"), (F.col("count") == F.col("most_b")).alias("b_best")))


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_mutual (links best on both sides)."""
    packed = cut(packets(docs, a_path, b_path))
    tables = packed.where("is_table")
    asked = tables.select("packet", F.posexplode("pairs").alias("place", "pair"))
    told = asked.join(pair_counts(tables), "pair").groupBy("packet").agg(F.array_sort(F.collect_list(F.struct("place", "count", "best", "b_best"))).alias("told"))
    told = told.select(F.col("packet").alias("of"), F.col("told.count").alias("count"), F.col("told.best").alias("best"), F.col("told.b_best").alias("b_best"))
    kind = packed.schema["doc_id"].dataType.simpleString()

    def run(rows, answers):
        import pyarrow as pa

        n = rows.num_rows
        sums = np.zeros((3, n), np.int64)
        if answers.num_rows:
            count, best, b_best = (np.asarray(answers.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)) for c in ("count", "best", "b_best"))
            places, times = rows.column("places").combine_chunks(), np.asarray(rows.column("times").combine_chunks().flatten())
            place, upto = np.asarray(places.flatten()), np.cumsum(np.asarray(places.value_lengths()))
            for k, v in enumerate((best[place], count[place], best[place] & b_best[place])):
                sums[k] = np.diff(np.append(0, np.cumsum(times * v))[upto], prepend=0)
        kept = [rows.column(c) for c in ("n_a", "n_b", "n_groups", "n_links")]
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_mutual"]
        return pa.table([rows.column("doc_id"), *kept, pa.array(sums[0]), pa.array(sums[1]), rows.column("groups_sha256"), pa.array(sums[2])], names)

    rows = packed.where("NOT is_table").drop("pairs", "holders", "is_table")
    out = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_mutual long"
    return rows.groupBy("packet").cogroup(told.groupBy("of")).applyInArrow(run, out)


def default_models() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(read(spark, sf_dir, "documents"), *default_models())
