"""Toxicity: cumulative-link ordinal regression. P(grade <= k) = sigmoid(threshold[k] - w.x) with one weight vector shared
by all ordered thresholds; the severity is the expected grade.

Features are sparse: which of the vocabulary's words and beginnings of words a whole text holds, however long it is. The vocabulary (at most
`max_features` entries) and the weights are fitted on at most `max_rows` labelled documents (documented bounds).

Grades: the labels only tell clean (0) from toxic (1), so the grades of toxic training rows are derived from them: a word is
telling if its document frequency, or that of one of its beginnings, among toxic rows exceeds that among clean rows by `telling` standard errors; a toxic
row with at most one telling word has grade 1, with two or three grade 2, with more grade 3. Clean rows have grade 0.

Defined cases: null and empty texts have no feature and get the severity of the intercept alone; without training rows, or
with one class only, every severity is 0; repeated rows get equal results; rows with null ids are scored, not learned from; very long texts are read whole; id columns named like a result
(severity, grade, p_toxic, toxic) are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BYTES, bounded, fold, labelled_sample, others, text_bytes


def words_of(text: bytes | None) -> set[bytes]:
    """The distinct words of a whole text, A-Z lower-cased."""
    return set(text.translate(WORD_BYTES).split()) if text else set()


def features_of(words: set[bytes]) -> set[bytes]:
    """The words themselves and, marked with ^, their beginnings of 3 to 8 bytes."""
    return words.union(*[{b"^" + w[:n] for w in words if len(w) > n} for n in range(3, 9)])


@dataclass
class Ordinal:
    """vocabulary: word -> column; weights; ascending thresholds, one less than there are grades."""

    vocabulary: dict[bytes, int]
    weights: object
    thresholds: object

    def above(self, texts: list[bytes | None]):
        """P(grade > k) for each text and k."""
        import numpy as np

        get, w = self.vocabulary.get, self.weights
        z = np.array([sum(w[j] for x in features_of(words_of(t)) if (j := get(x)) is not None) for t in texts], dtype=float)
        if not len(self.thresholds):
            return np.zeros((len(texts), 1))
        return 1 / (1 + np.exp(-np.clip(z[:, None] - np.asarray(self.thresholds)[None, :], -40, 40)))


def fit(texts: list[bytes | None], toxic, max_features: int = 4096, telling: float = 7.0, rounds: int = 800, ridge: float = 1e-4, least_z: float = 6.0, least_share: float = 0.01) -> Ordinal:
    """Select the vocabulary, derive grades and fit by Adam on the penalised likelihood."""
    from collections import Counter

    import numpy as np

    # rows with the same words and label say one thing; many copies of a text must not make its words look telling
    rows = sorted({(b" ".join(sorted(words_of(t))), bool(y)) for t, y in zip(texts, toxic, strict=True)})
    texts, toxic = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=bool)
    bad, good = int(toxic.sum()), int((~toxic).sum())
    if not bad or not good:
        return Ordinal({}, np.zeros(0), np.zeros(0))
    df = [Counter(), Counter()]
    for text, t in zip(texts, toxic, strict=True):  # the features of one row at a time; their counts alone are kept
        df[int(t)].update(features_of(words_of(text)))
    z = {}
    for word in df[0].keys() | df[1].keys():
        a, b = df[1][word], df[0][word]
        if a < max(3, least_share * bad) and b < max(3, least_share * good):
            continue  # too few rows hold it; one family of near copies may be all of them
        p = (a + b) / (bad + good)
        z[word] = (a / bad - b / good) / np.sqrt(p * (1 - p) * (1 / bad + 1 / good) + 1e-12)
    chosen = sorted((w for w in z if abs(z[w]) >= least_z), key=lambda w: (-abs(z[w]), w))[:max_features]
    vocabulary = {w: j for j, w in enumerate(chosen)}
    # a telling word is rare in clean texts, or its excess is no more than chance in long texts
    tells = {w for w in chosen if z[w] >= telling and df[0][w] / good <= 0.2 * df[1][w] / bad}
    hits, rows, columns = [], [], []
    for i, text in enumerate(texts):
        own = words_of(text)
        hits.append(sum(not tells.isdisjoint(features_of({w})) for w in own))
        mine = [vocabulary[f] for f in features_of(own) if f in vocabulary]
        rows += [i] * len(mine)
        columns += mine
    hits, rows, columns = np.array(hits), np.array(rows, dtype=int), np.array(columns, dtype=int)
    grade = np.where(~toxic, 0, np.where(hits <= 1, 1, np.where(hits <= 3, 2, 3)))
    grades = np.unique(grade)
    grade = np.searchsorted(grades, grade)
    k = len(grades) - 1
    n, d = len(texts), len(chosen)
    share = np.array([np.mean(grade > c) for c in range(k)])
    cut = -np.log(share / (1 - share))
    # thresholds stay ordered: the first is free, the gaps are exponentials
    params = np.concatenate([np.zeros(d), cut[:1], np.log(np.maximum(np.diff(cut), 1e-3))])
    m1, m2 = np.zeros_like(params), np.zeros_like(params)
    weight = 1 / (1 + np.abs([z[w] for w in chosen]))  # words told apart less surely are shrunk more
    for step in range(1, rounds + 1):
        w, theta = params[:d], np.cumsum(np.concatenate([params[d : d + 1], np.exp(params[d + 1 :])]))
        score = np.bincount(rows, weights=w[columns], minlength=n)
        up = 1 / (1 + np.exp(-np.clip(score[:, None] - theta[None, :], -40, 40)))
        padded = np.concatenate([np.ones((n, 1)), up, np.zeros((n, 1))], axis=1)
        hi, lo = padded[np.arange(n), grade], padded[np.arange(n), grade + 1]
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p / n, lo * (1 - lo) / p / n  # d log p / d(score - threshold)
        gs = dlo - dhi
        gt = np.zeros(k)
        np.add.at(gt, grade[grade > 0] - 1, dhi[grade > 0])
        np.add.at(gt, grade[grade < k], -dlo[grade < k])
        tail = np.cumsum(gt[::-1])[::-1]
        grad = np.concatenate([np.bincount(columns, weights=gs[rows], minlength=d) + ridge * weight * w, tail[:1], tail[1:] * np.exp(params[d + 1 :])])
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        params = params - 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    theta = np.cumsum(np.concatenate([params[d : d + 1], np.exp(params[d + 1 :])]))
    return Ordinal(vocabulary, params[:d].tolist(), theta.tolist())


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 6_000, keep=None, id_col: str = "doc_id", text_col: str = "text", **options) -> Ordinal:
    """Fit on at most max_rows labelled documents; what is collected are their distinct words. keep: a condition on column
    `id` of the labels; by default crc32 mod 5 isn't 0."""
    sample = labelled_sample(docs, labels, label, max_rows, fold("id", 5) != 0 if keep is None else keep, id_col, text_col)

    def distinct(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            bags = [b" ".join(sorted(words_of(t))) for t in text_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(bags, pa.binary())], names=["y", "bag"])

    made = bounded(sample.mapInArrow(distinct, "y int, bag binary"), max_rows)
    rows = sorted((bytes(r.bag), r.y) for r in made.collect())
    return fit([r[0] for r in rows], [r[1] for r in rows], **options)


def grade(docs: DataFrame, model: Ordinal, id_cols: list, text_col: str = "text") -> DataFrame:
    """id_cols, severity double (expected grade), grade int (the most likely), p_toxic double (grade over 0), toxic boolean
    (p_toxic of a half or more), for each row."""
    ids = docs.select(*id_cols, F.col(f"`{text_col}`").alias("__text"))
    kept = ids.select(*others(ids, "severity", "grade", "p_toxic", "toxic"))

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            up = model.above(text_bytes(batch.column(batch.num_columns - 1)))
            each = -np.diff(np.concatenate([np.ones((len(up), 1)), up, np.zeros((len(up), 1))], axis=1), axis=1)
            made = [pa.array(up.sum(axis=1)), pa.array(each.argmax(axis=1), pa.int32()), pa.array(up[:, 0]), pa.array(up[:, 0] >= 0.5)]
            names = [f.name for f in batch.schema][:-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*names, "severity", "grade", "p_toxic", "toxic"])

    extra = [T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("toxic", T.BooleanType())]
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields[:-1], *extra]))
