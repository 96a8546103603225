"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams, scanned over the token windows of
each document; hits are verified word by word, and spans or whole documents are removed.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. A window is `n` consecutive
words of an item; an item with fewer words, but not none, is one window. A document word inside any occurrence of a
window is hit.

Defined cases: a null or empty text (document or item) has no words; an empty benchmark hits nothing; items that share a
window are all reported; repeated item ids count once, null item ids are ignored; every document row is judged on its own, so
repeated rows and null ids give one result each; columns the operator doesn't know pass through untouched, but for one that is named like the result,
whose place the result takes; very long texts are scanned whole, in overlapping slabs of words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BYTES, fresh, others

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("hits", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


class WindowIndex:
    """The hash set, in flat arrays: the items' normalised text, and for each window length the sorted 64-bit hashes of its windows with the place of
    each in that text. A window is a range of bytes, as words are joined by one space; equal hashes are verified byte by byte.

    A word of the benchmark takes its bytes, one more, and 16 bytes for its window.
    """

    def __init__(self, items: list[tuple[str, str]], n: int):
        import numpy as np

        texts, starts, self.names, at = [], [], [], 0
        places: dict[int, list] = {}
        for item, text in sorted(set(items)):
            words = (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()
            if not words:
                continue
            size = min(n, len(words))
            first, end = _edges(words)
            places.setdefault(size, []).append((at + first[: len(words) - size + 1], at + end[size - 1 :]))
            texts.append(b" ".join(words))
            starts.append(at)
            self.names.append(item)
            at += len(texts[-1]) + 1
        self.text = b" ".join(texts)
        self.starts = np.array(starts, dtype=np.int64)
        self.windows = {}
        for size, ranges in sorted(places.items()):
            first, end = np.concatenate([r[0] for r in ranges]), np.concatenate([r[1] for r in ranges])
            hashes = np.concatenate([_hashes(self.text[a[0] : b[-1]], a - a[0], b - a[0]) for a, b in ranges])
            order = np.argsort(hashes, kind="stable")
            self.windows[size] = hashes[order], first[order], (end - first)[order].astype(np.int32)

    @property
    def nbytes(self) -> int:
        return len(self.text) + self.starts.nbytes + sum(a.nbytes for w in self.windows.values() for a in w)

    #: Of a benchmark's text in UTF-8: a word and what parts it from the next take two bytes or more.
    MOST_BYTES_A_BYTE = 1 + 20 / 2


def _edges(words: list[bytes]):
    """Where each word begins and ends in the words joined by one space."""
    import numpy as np

    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    return end - size, end


_POWERS: dict[str, object] = {}
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64


def _powers(n: int):
    """BASE to the 0, 1, ..., n-1 and its inverse likewise, modulo 2^64."""
    import numpy as np

    if len(_POWERS.get("up", ())) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            made = np.full(size, base, dtype=np.uint64)
            made[0] = 1
            _POWERS[name] = np.cumprod(made, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def _hashes(text: bytes, first, end):
    """A 64-bit hash of each range of the text that depends on its bytes alone, from one running sum over the text."""
    import numpy as np

    up, down = _powers(len(text) + 1)
    scattered = (np.frombuffer(text, dtype=np.uint8).astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    total = np.concatenate(([np.uint64(0)], np.cumsum((scattered ^ (scattered >> np.uint64(32))) * up[: len(text)], dtype=np.uint64)))
    h = (total[end] - total[first]) * down[first]
    return h ^ (h >> np.uint64(29))


def _scanner(index: WindowIndex, slab: int = 16_384):
    """A function from a document's bytes to (number of words, item ids, merged hit intervals in words). Long texts are scanned in slabs of words
    that overlap by a window."""
    import numpy as np

    sizes = sorted(index.windows)

    def items_of(hashes, places, lengths, key, window: bytes) -> set[str]:
        found = set()
        for at in range(int(np.searchsorted(hashes, key, "left")), int(np.searchsorted(hashes, key, "right"))):
            place = int(places[at])
            if lengths[at] == len(window) and index.text[place : place + len(window)] == window:
                found.add(index.names[int(np.searchsorted(index.starts, place, "right")) - 1])
        return found

    def scan(text: bytes | None):
        words = text.translate(WORD_BYTES).split() if text else []
        items: set[str] = set()
        if not sizes or len(words) < sizes[0]:
            return len(words), items, []
        delta, known = None, {}
        for base in range(0, len(words), slab):
            some = words[base : base + slab + sizes[-1] - 1]
            joined = b" ".join(some)
            first, end = _edges(some)
            for size in sizes:
                if size > len(some):
                    break
                hashes, places, lengths = index.windows[size]
                a, b = first[: len(some) - size + 1], end[size - 1 :]
                h = _hashes(joined, a, b)
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                for s in np.nonzero(hashes[at] == h)[0].tolist():
                    window = joined[a[s] : b[s]]
                    if (size, window) not in known:  # a passage that a text repeats is looked up once
                        known[size, window] = items_of(hashes, places, lengths, h[s], window)
                        items |= known[size, window]
                    if known[size, window]:
                        if delta is None:
                            delta = np.zeros(len(words) + 1, dtype=np.int64)
                        delta[base + s] += 1
                        delta[base + s + size] -= 1
        if delta is None:
            return len(words), items, []
        edge = np.diff(np.concatenate(([0], (np.cumsum(delta) > 0).astype(np.int8))))
        return len(words), items, list(zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist(), strict=True))

    return scan


def _merge(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def annotate(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    out: str = "decontam",
    max_index_bytes: int = 256_000_000,
) -> DataFrame:
    """docs with one more column `out`: struct(n_words, items array<string> sorted, hits array of [first, end) word spans).

    An index takes at most 11 times its items' bytes. A benchmark whose index could outgrow max_index_bytes is split by a hash of the items into parts that
    can't (but one item is never split); each part is a broadcast of its own, and a task holds one at a time, for each batch of documents.
    The documents are read once, however many parts there are.
    """
    docs = docs.select(*others(docs, out))
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, math.ceil(total * WindowIndex.MOST_BYTES_A_BYTE / max_index_bytes))
    items = items.withColumn("p", F.pmod(F.xxhash64("i", "t"), F.lit(parts)))
    indexes = []
    for part in range(parts):
        rows = items.where(F.col("p") == part).collect()
        indexes.append(spark.sparkContext.broadcast(WindowIndex([(r.i, r.t) for r in rows], n)))
    place = docs.columns.index(next(c for c in docs.columns if c.lower() == text_col.lower()))

    def scan_batches(batches: Iterator):
        import pyarrow as pa

        kind = pa.struct([("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("hits", pa.list_(pa.list_(pa.int64())))])
        for batch in batches:
            texts = batch.column(place).cast(pa.binary())
            found: list[tuple] = [(0, set(), [])] * batch.num_rows
            for index in indexes:
                scan = _scanner(index.value)
                for k in range(batch.num_rows):
                    words, names, hits = scan(texts[k].as_py())
                    found[k] = (words, found[k][1] | names, found[k][2] + hits)
                if len(indexes) > 1:
                    vars(index).pop("_value", None)  # it is read again from this machine's copy
            made = [{"n_words": w, "items": sorted(names), "hits": _merge(hits)} for w, names, hits in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind)], names=[*[f.name for f in batch.schema], out])

    return docs.mapInArrow(scan_batches, T.StructType([*docs.schema.fields, T.StructField(out, RESULT)]))


def n_hit(out: str = "decontam"):
    """The number of hit words of an annotated document."""
    return F.aggregate(F.col(f"{out}.hits"), F.lit(0).cast("long"), lambda acc, h: acc + h[1] - h[0])


def _cut(text: str | None, hits) -> str | None:
    data = text.encode("utf-8")
    spans = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(WORD_BYTES))]
    kept, at = [], 0
    for first, end in hits:
        kept.append(data[at : spans[first][0]])
        at = spans[end - 1][1]
    return b"".join([*kept, data[at:]]).decode("utf-8")


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text_col: str = "text", **options) -> DataFrame:
    """The documents without benchmark passages, with the columns of docs.

    mode "documents" drops each contaminated document; "spans" keeps it and cuts the hit words, with what stands between
    them, out of its text.
    """
    if mode not in ("documents", "spans"):
        raise ValueError("mode is 'documents' or 'spans'")
    out = fresh(docs, "decontam")
    marked = annotate(docs, benchmark, text_col=text_col, out=out, **options)
    if mode == "documents":
        return marked.where(F.size(f"{out}.hits") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])

    @F.udf("string", useArrow=True)
    def cut(text, hits):
        return text if text is None or not len(hits) else _cut(text, hits)

    return marked.withColumn(text_col, cut(F.col(text_col), F.col(f"{out}.hits"))).select(*[F.col(f"`{c}`") for c in docs.columns])
