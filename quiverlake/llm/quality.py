"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays that numpy
traverses for a whole batch at a time.

The trees are fitted on the driver from at most `max_rows` labelled documents (a documented bound); every document of the
corpus is scored in a map-only pass. Labels are read only from training rows; ids, sources and languages are no inputs.

Defined cases: null and empty texts have all statistics 0 and get that leaf's score; without a training row every score is
0.5; with one class only, the score is its smoothed prior; repeated rows get equal scores; null ids are scored but never
trained on; very long texts are read whole; a column named like the score gives way to it, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, fold, fresh, labelled_sample, others, text_bytes

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "upper", "lower", "digit", "space", "newline", "ascii_symbol", "non_ascii",
    "stop_mark", "comma", "loud_mark", "bar", "brace", "at_slash", "long_word", "short_word", "upper_word", "symbol_end",
    "distinct_words", "top_word", "distinct_lines", "mean_line", "short_lines", "log_lines", "byte_entropy", "word_repeats",
)


def statistics(text: bytes | None):
    """One row of STATISTICS for a whole text."""
    from collections import Counter

    import numpy as np

    out = np.zeros(len(STATISTICS))
    if not text:
        return out
    n = len(text)
    count = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    m, k = max(len(words), 1), max(len(lines), 1)
    tally = Counter(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1)
    heads = np.frombuffer(bytes([w[0] for w in words]), dtype=np.uint8) if words else np.zeros(1, np.uint8)
    seconds = np.frombuffer(bytes([w[1] if len(w) > 1 else 0 for w in words]), dtype=np.uint8) if words else np.zeros(1, np.uint8)
    tails = np.frombuffer(bytes([w[-1] for w in words]), dtype=np.uint8) if words else np.zeros(1, np.uint8)
    share = count[count > 0] / n
    letters = count[65:91].sum() + count[97:123].sum()
    symbols = count[33:127].sum() - letters - count[48:58].sum()
    plain_end = np.isin(tails, np.frombuffer(b".,;:!?", dtype=np.uint8)) | (tails >= 128)
    alnum = ((tails >= 48) & (tails < 58)) | ((tails >= 65) & (tails < 91)) | ((tails >= 97) & (tails < 123))
    out[:] = (
        np.log1p(n), np.log1p(len(words)), size.mean(), count[65:91].sum() / n, count[97:123].sum() / n, count[48:58].sum() / n,
        (count[32] + count[9]) / n, count[10] / n, symbols / n, count[128:].sum() / n, count[46] / m, count[44] / m, count[33] / m,
        (count[124] + count[95]) / m, (count[123] + count[125] + count[60] + count[62] + count[59]) / m, (count[64] + count[47]) / m,
        (size > 14).mean(), (size <= 3).mean(), ((heads >= 65) & (heads < 91) & (seconds >= 65) & (seconds < 91)).mean(),
        (~plain_end & ~alnum).mean(), len(tally) / m, max(tally.values(), default=0) / m, len(set(lines)) / k, np.log1p(n / k),
        sum(len(x) < 25 for x in lines) / k, np.log1p(len(lines)), -(share * np.log2(share)).sum(), sum(a == b for a, b in zip(words, words[1:], strict=False)) / m,
    )
    return out


@dataclass
class Trees:
    """All trees in flat arrays: node i tests feature[i] <= threshold[i], children at left[i] and left[i] + 1; -1 is a leaf."""

    feature: object
    threshold: object
    left: object
    value: object
    roots: object
    prior: float
    depth: int

    def margin(self, x):
        """The summed leaf values, all trees and rows advancing one level at a time."""
        import numpy as np

        total = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                left = self.left[at]
                inner = left >= 0
                step = left + (x[rows, self.feature[at]] > self.threshold[at])
                at = np.where(inner, step, at)
            total += self.value[at]
        return total

    def score(self, x):
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(x, y, rounds: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 2.0, least: int = 8) -> Trees:
    """Second-order boosting of the logistic loss with per-feature histograms; depth-wise growth."""
    import numpy as np

    n = len(y)
    p = (np.sum(y) + 1) / (n + 2) if n else 0.5
    prior = float(np.log(p / (1 - p)))
    feature, threshold, left, value, roots = [], [], [], [], []
    if n and 0 < np.sum(y) < n:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        flat = code + np.arange(x.shape[1]) * bins
        margin = np.full(n, prior)
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-margin))
            g, h = q - y, q * (1 - q)
            roots.append(len(feature))
            stack = [(np.arange(n), 0, len(feature))]
            feature.append(0), threshold.append(0.0), left.append(-1), value.append(0.0)
            while stack:
                rows, level, node = stack.pop()
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = -rate * gs / (hs + ridge)
                best = None
                if level < depth and len(rows) >= 2 * least:
                    f = flat[rows].ravel()
                    wide = x.shape[1] * bins
                    hist = [np.bincount(f, weights=np.repeat(w, x.shape[1]), minlength=wide).reshape(-1, bins) for w in (g[rows], h[rows], np.ones(len(rows)))]
                    cg, ch, cn = (np.cumsum(a, axis=1)[:, :-1] for a in hist)
                    gain = cg**2 / (ch + ridge) + (gs - cg) ** 2 / (hs - ch + ridge) - gs**2 / (hs + ridge)
                    gain[(cn < least) | (len(rows) - cn < least)] = -1
                    j, b = np.unravel_index(np.argmax(gain), gain.shape)
                    if gain[j, b] > 1e-3 and b < len(cuts[j]):
                        best = (j, b)
                if best is None:
                    margin[rows] += value[node]
                    continue
                j, b = best
                feature[node], threshold[node], left[node] = int(j), float(cuts[j][b]), len(feature)
                for side in (rows[code[rows, j] <= b], rows[code[rows, j] > b]):
                    stack.append((side, level + 1, len(feature)))
                    feature.append(0), threshold.append(0.0), left.append(-1), value.append(0.0)
    as_array = lambda a, kind: np.array(a, dtype=kind)
    return Trees(as_array(feature, np.int64), as_array(threshold, float), as_array(left, np.int64), as_array(value, float), roots, prior if n else 0.0, depth)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000, keep=None, id_col: str = "doc_id", text_col: str = "text", **options) -> Trees:
    """Fit on at most max_rows labelled documents, of which only the statistics are collected. keep: a condition on column `id` of the labels; by default crc32 mod 3 isn't 1."""
    import numpy as np

    sample = labelled_sample(docs, labels, label, max_rows, fold("id", 3) != 1 if keep is None else keep, id_col, text_col)

    def count(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            rows = [statistics(t).tolist() for t in text_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["id", "y", "x"])

    kind = sample.schema["id"].dataType.simpleString()
    rows = bounded(sample.mapInArrow(count, f"id {kind}, y int, x array<double>"), max_rows).collect()
    rows.sort(key=lambda r: (str(r.id), r.x))  # the same rows in the same order give the same trees
    x = np.array([r.x for r in rows], dtype=float).reshape(len(rows), len(STATISTICS))
    return fit_trees(x, np.array([r.y for r in rows], dtype=float), **options)


def score(docs: DataFrame, model: Trees, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with one more column `out`: the likelihood of label 1, in 0 to 1. A column of docs with that name gives way to it."""
    docs = docs.select(*others(docs, out))

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            x = np.stack([statistics(t) for t in texts]) if texts else np.zeros((0, len(STATISTICS)))
            names = [f.name for f in batch.schema]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x), pa.float64())], names=[*names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def keep_good(docs: DataFrame, model: Trees, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score at least threshold, with the columns of docs."""
    out = fresh(docs, "score")
    return score(docs, model, text_col, out).where(F.col(out) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
