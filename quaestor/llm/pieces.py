"""SentencePiece encoding and decoding: exact merge-type (BPE) encoding by backtracking, without the library.

The text is escaped (white space becomes U+2581, one is put in front) and falls into segments that no merge can cross:
before each U+2581 that follows another character, and around characters that are no pieces (these are spelled as bytes).
A segment is encoded by backtracking: take the longest piece that an Aho-Corasick automaton finds at the position; if it
is compatible with the piece before (re-merging the two gives the two again) go on, else take the next shorter one; a
bitfield remembers positions from which no way leads to the end. Pieces that merging never makes are not in the
automaton. Segments with several U+2581 in a row are merged directly: the pieces of such runs all have the same score, so
that compatibility of neighbours does not decide. Segments repeat a lot, so each worker remembers recent ones.

Defined results: null counts as empty; empty texts have no ids; repeated rows and null ids stay as they are; an empty table
gives an empty result; columns other than doc_id and text are left out. Texts are encoded whole, in time linear in their
length. A model of other settings than the Codec's (see `settings`) is refused.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from .common import only, own_columns, read, spread

SPACE = "▁"
#: Segments that a worker remembers at most, half of them of the time before; pairs of pieces whose compatibility it knows.
REMEMBER, PAIRS = 320_000, 1 << 17


def read_model(path: str) -> tuple[list[tuple[str, float, int]], dict]:
    """(piece, score, type) of each id, and the settings, from the model's protocol buffer.

    Field 1 is a piece, of text 1, float 2, enum 3; field 2 the training, of type 3, suffix 24, bytes 35; field 3 the
    normaliser, of table 2, prefix 3, squeezing 4, escaping 5.
    """
    with open(path, "rb") as f:
        data = f.read()
    pieces, training, normaliser = [], {}, {}
    for number, v in _fields(data, 0, len(data)):
        x = dict(_fields(data, *v)) if number in (1, 2, 3) else {}
        if number == 1:
            pieces.append((data[slice(*x[1])].decode(), x.get(2, 0.0), x.get(3, 1)))
        elif number == 2:
            training = x
        elif number == 3:
            normaliser = x
    table = normaliser.get(2, (0, 0))
    settings = {"merges": training.get(3, 1) == 2, "suffix": bool(training.get(24, 0)), "bytes": bool(training.get(35, 0))}
    settings |= {"table": table[1] > table[0], "prefix": bool(normaliser.get(3, 1)), "squeezes": bool(normaliser.get(4, 1)), "escapes": bool(normaliser.get(5, 1))}
    return pieces, settings


#: What the Codec does: merges, byte fallback, a space in front, U+2581 for spaces, no other change of the text.
SETTINGS = {"merges": True, "suffix": False, "bytes": True, "table": False, "prefix": True, "squeezes": False, "escapes": True}


def _fields(data: bytes, at: int, end: int):
    """(number, value) of the fields between two places; values of length are (start, end)."""
    import struct

    def varint(at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            b = data[at]
            n |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return n, at

    while at < end:
        tag, at = varint(at)
        if tag & 7 == 0:
            v, at = varint(at)
        elif tag & 7 == 5:
            v, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
        elif tag & 7 == 1:
            v, at = None, at + 8
        else:
            n, at = varint(at)
            v, at = (at, at + n), at + n
        yield tag >> 3, v


class Codec:
    """Encoder and decoder of a merge-type model with byte fallback, no normalisation, and a leading space."""

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, path: str, remember: int = REMEMBER):
        import ahocorasick

        self.remember = remember
        model, settings = read_model(path)
        if settings != SETTINGS:
            raise ValueError(f"a model of other settings: {sorted(k for k in SETTINGS if settings[k] != SETTINGS[k])}")
        self.text = [p for p, _, _ in model]
        self.kind = [k for _, _, k in model]
        self.score = {p: s for p, s, k in model if k == self.NORMAL}
        self.id = {p: i for i, (p, _, k) in enumerate(model) if k == self.NORMAL}
        self.byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(model) if k == self.BYTE}
        self.value = {i: b for b, i in self.byte.items()}
        self.unknown = next(i for i, (_, _, k) in enumerate(model) if k == self.UNKNOWN)
        self.chars = {p for p in self.id if len(p) == 1}
        self.digits = [str(i) for i in range(len(model))]
        made = {p: i for p, i in self.id.items() if len(p) == 1 or p.strip(SPACE) and self.merge(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p, i in made.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.length = [len(p) for p in self.text]
        #: The next shorter piece that a piece starts with.
        self.shorter = {i: next((made[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in made), -1) for p, i in made.items()}
        self.compatible = lru_cache(PAIRS)(self._compatible)
        #: What `_segment` says of a segment.
        self.memory: dict[str, bytes | tuple[bytes, str]] = {}
        self.older: dict[str, bytes | tuple[bytes, str]] = {}

    # -- merging, the definition

    def merge(self, segment: str) -> list[str]:
        """Pieces by merging the neighbours of best score, leftmost first: n log n, for re-merging and for runs."""
        score, part = self.score, list(segment)
        n = len(part)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := score.get(x := part[i] + part[j])) is not None:
                heapq.heappush(heap, (-s, i, j, x))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, x = heapq.heappop(heap)
            if not part[i] or not part[j] or right[i] != j or part[i] + part[j] != x:
                continue
            part[i], part[j] = x, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in part if p]

    def _compatible(self, a: int, b: int) -> bool:
        x, y = self.text[a], self.text[b]
        return self.merge(x + y) == [x, y]

    # -- backtracking

    def encode_run(self, run: str) -> list[int]:
        """Ids of characters that are all pieces."""
        if SPACE * 2 in run:
            return [self.id[p] for p in self.merge(run)]
        # The first way: longest matches throughout. Most often all neighbours are compatible, and it is the encoding.
        ids = [i for _, i in self.automaton.iter_long(run)]
        if all(map(self.compatible, ids, ids[1:])) and sum(map(self.length.__getitem__, ids)) == len(run):
            return ids
        return self.backtrack(run)

    def backtrack(self, run: str) -> list[int]:
        n, length, shorter, compatible = len(run), self.length, self.shorter, self.compatible
        longest = [0] * n  # at each position the longest piece, as those that end later come later
        for end, i in self.automaton.iter(run):
            longest[end - length[i] + 1] = i
        failed = bytearray((n + 8) // 8)  # a bit for each position
        taken: list[int] = []
        position, i = 0, longest[0]
        while position < n:
            while i >= 0:
                end = position + length[i]
                if not failed[end >> 3] >> (end & 7) & 1 and (not taken or compatible(taken[-1], i)):
                    break
                i = shorter[i]
            if i >= 0:
                taken.append(i)
                position = end
                i = longest[end] if end < n else -1
            elif taken:
                failed[position >> 3] |= 1 << (position & 7)
                position -= length[taken[-1]]
                i = shorter[taken.pop()]
            else:
                raise ValueError(f"no encoding of {run!r}")
        return taken

    # -- texts

    def _segment(self, s: str) -> bytes | tuple[bytes, str]:
        """Ids of one segment, joined by commas; with the decoded segment, unless its pieces spell it as it is.

        Plain bytes, as hundreds of thousands of them are remembered.
        """
        if self.chars.issuperset(s):
            return ",".join([self.digits[i] for i in self.encode_run(s)]).encode()
        ids: list[int] = []
        known: list[str] = []

        def flush() -> None:
            if known:
                ids.extend(self.encode_run("".join(known)))
                known.clear()

        for c in s:
            if c in self.chars:
                known.append(c)
            else:
                flush()
                ids.extend(self.byte.get(b, self.unknown) for b in c.encode())
        flush()
        return ",".join(map(str, ids)).encode(), self.pieces_text(ids)

    def pieces_text(self, ids: list[int]) -> str:
        """Pieces' text and bytes, before the leading space goes; bytes that are no UTF-8 become U+FFFD one by one."""
        out: list[str] = []
        raw = bytearray()

        def flush() -> None:
            while raw:
                try:
                    out.append(raw.decode())
                    raw.clear()
                except UnicodeDecodeError as e:
                    out.append(raw[: e.start].decode() + "�")
                    del raw[: e.start + 1]

        for i in ids:
            if (b := self.value.get(i)) is not None:
                raw.append(b)
                continue
            flush()
            if self.kind[i] == self.UNKNOWN:
                out.append(" ⁇ ")
            elif self.kind[i] != self.CONTROL:
                out.append(self.text[i].replace(SPACE, " "))
        flush()
        return "".join(out)

    def run(self, text: str | None) -> tuple[str, int, str]:
        """The text's ids joined by commas, their number, and the decoded text."""
        if not text:
            return "", 0, ""
        if len(self.memory) > self.remember // 2:  # what is asked for again moves on, the rest goes
            self.memory, self.older = {}, self.memory
        memory, older = self.memory, self.older
        parts = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", SPACE + text.replace(" ", SPACE))
        got = list(map(memory.get, parts))
        if None in got:
            for k, x in enumerate(got):
                if x is None:
                    s = parts[k]
                    got[k] = x = memory.get(s) or older.get(s) or self._segment(s)
                    if len(s) < 64:
                        memory[s] = x
        if tuple in set(map(type, got)):
            both = [x if type(x) is tuple else (x, p) for p, x in zip(parts, got, strict=True)]
            got, text = [x for x, _ in both], "".join([t for _, t in both]).replace(SPACE, " ")[1:]
        else:
            text = text.replace(SPACE, " ")
        ids = b",".join(got)
        return ids.decode(), ids.count(b",") + 1, text

    def encode(self, text: str | None) -> list[int]:
        ids = self.run(text)[0]
        return [int(i) for i in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        text = self.pieces_text(ids)
        return text[1:] if text[:1] == " " else text


@lru_cache(2)
def codec(path: str, remember: int = REMEMBER) -> Codec:
    return Codec(path, remember)


def encode_column(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>), decoded: the operator's own output."""

    def run(batches):
        import pyarrow as pa

        c = codec(path)
        only("pieces", codec.cache_clear)
        for b in batches:
            ids = [c.encode(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(i) for i in ids], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    d = own_columns(docs, "doc_id", "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>, decoded string")


def digest_column(docs: DataFrame, path: str, remember: int = REMEMBER) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text. remember: segments that a worker keeps; no result depends on it."""

    def run(batches):
        import pyarrow as pa

        c, sha = codec(path, remember), lambda s: hashlib.sha256(s.encode()).hexdigest()
        only("pieces", codec.cache_clear)
        for b in batches:
            pa.default_memory_pool().release_unused()
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = []
                for t in part.column("text").to_pylist():
                    ids, n, text = c.run(t)
                    rows.append((n, sha(ids), sha(text)))
                n, i, t = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(i), pa.array(t)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    d = spread(own_columns(docs, "doc_id", "text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_piece_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_column(read(spark, sf_dir, "documents"), default_model())
