"""Overlapping character chunks of documents, cut at paragraphs, sentences or lines where one ends in the second half."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size and overlap in characters, and where a chunk may end, in order of preference.
SIZE, OVERLAP = 1800, 200
ENDS = ("\n\n", ". ", "\n")
#: Documents whose texts a worker holds as Python objects at a time.
SLICE = 128


def spans(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Start and end of each window: the next one starts `overlap` before the end, and always after this one's start."""
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            ends = (p + len(sep) for sep in ENDS if (p := text.rfind(sep, start, end) - start) > size * 0.5)
            end = start + next(ends, end - start)
        out.append((start, end))
        if end == len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, key: str = "doc_id") -> DataFrame:
    """chunk_id, key, idx, text: stripped chunks; idx counts those that are not empty. Null texts have none."""

    def run(batches):
        import pyarrow as pa

        for b in (b.slice(at, SLICE) for b in batches for at in range(0, max(1, b.num_rows), SLICE)):
            ids, idx, texts = [], [], []
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                t, n = (t or "").strip(), 0
                for x, y in spans(t, size, overlap):
                    if piece := t[x:y].strip():
                        ids.append(i)
                        idx.append(n)
                        texts.append(piece)
                        n += 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("id").type), pa.array(idx, pa.int64()), pa.array(texts, pa.string())], ["id", "idx", "text"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("id"), "text").mapInArrow(run, f"id {kind}, idx long, text string")
    return out.select(F.concat(F.col("id").cast("string"), F.lit("::chunk"), F.col("idx").cast("string")).alias("chunk_id"), F.col("id").alias(key), "idx", "text")
