"""Language identification by compression: a text is encoded with one zstandard raw-content dictionary per language, and
the language of the smallest encoding wins; a narrow margin is flagged as rejected.

Whole texts count: the normalised text (lower case, words joined by one space) is cut into blocks of `block` bytes, each
encoded with every dictionary, and the sizes are added, so the dictionary matters throughout a long text. The dictionaries
hold at most `dictionary_bytes` a language, from about `samples` blocks of text a language, of at most `max_languages` languages (documented bounds).

Defined cases: a null text, or one without any letter, is `und` with score 0; ties go to the language that is more frequent
in the training rows, then to the smaller name; without training rows every text is `und`; rows with a null language are not learned from; repeated rows
are learned once and judged alike; very long texts are judged whole, block by block; id columns named like a result (lang, score, margin, rejected) are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import fold, others

WORDS = re.compile(r"[^\W\d_]+")


def normalise(text: str) -> bytes:
    """The words of letters only, lower-cased, joined and enclosed by one space."""
    words = WORDS.findall(text.lower())
    return b" " + " ".join(words).encode("utf-8", "replace") + b" " if words else b""


def train(
    docs: DataFrame, keep=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    samples: int = 400, block_chars: int = 2_000, dictionary_bytes: int = 200_000, max_languages: int = 256,
) -> dict[str, bytes]:
    """Language -> dictionary content, the most frequent language first.

    Texts count as blocks of block_chars characters, so every part of every training text is as likely to be learned as any other. Blocks are counted over all
    training rows; then those are chosen by a hash of id, text and place, at a rate that yields about `samples` a language. At most twice as many
    different ones a language are collected, of at most max_languages languages, the most frequent ones.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("id", 5) != 0 if keep is None else keep))
    blocks = F.greatest(F.ceil(F.length("text") / block_chars), F.lit(1))
    frequent = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(blocks).alias("blocks")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    if not frequent:
        return {}
    counts = {r.lang: r.n for r in frequent}
    rate = F.create_map(*[F.lit(x) for r in frequent for x in (r.lang, min(1.0, samples / r.blocks))])
    spread = lambda i: F.pmod(F.xxhash64(F.lit("lang"), F.col("id"), F.col("hash"), i), F.lit(1 << 30)) / float(1 << 30)
    named = rows.where(F.col("lang").isin(list(counts))).withColumn("rate", rate[F.col("lang")]).withColumn("hash", F.xxhash64("text"))
    chosen = F.filter(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1), lambda i: spread(i) < F.col("rate"))
    parts = named.select("id", "lang", "hash", "text", F.explode(chosen).alias("i"))
    parts = parts.select("lang", spread(F.col("i")).alias("at"), F.substring("text", (F.col("i") * block_chars + 1).cast("int"), F.lit(block_chars)).alias("part"))
    parts = parts.groupBy("lang", "part").agg(F.min("at").alias("at"))  # repeated rows count once
    place = F.row_number().over(W.partitionBy("lang").orderBy("at", "part"))
    picked = parts.withColumn("place", place).where(F.col("place") <= 2 * samples).collect()
    content: dict[str, bytes] = {}
    for lang in sorted(counts, key=lambda x: (-counts[x], x)):
        got, used, seen = [], 0, set()
        for r in sorted((r for r in picked if r.lang == lang), key=lambda r: (r.at, r.part)):
            part = normalise(r.part)
            if part not in seen and used + len(part) <= dictionary_bytes:
                seen.add(part)
                got.append(part)
                used += len(part)
        content[lang] = b"".join(got)
    return content


class Encoders:
    """One compressor a language; kept by each Python worker."""

    def __init__(self, content: dict[str, bytes], level: int, block: int):
        import zstandard as z

        self.langs, self.block, self.encode = list(content), block, []
        for data in content.values():
            d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT) if len(data) >= 8 else None
            if d is not None:
                d.precompute_compress(level=level)
            self.encode.append(z.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False).compress)

    def sizes(self, data: bytes) -> list[int]:
        parts = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        return [sum(len(e(p)) for p in parts) for e in self.encode]

    def judge(self, text: str | None, narrow: float):
        """(language, score, margin, rejected)."""
        import math

        data = normalise(text) if text else b""
        if not data or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0, True
        sizes = self.sizes(data)
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        if len(sizes) == 1:
            return self.langs[0], 1.0, 1.0, False
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = (second - sizes[best]) / second
        weight = sum(math.exp(-min(60.0, 0.35 * (s - sizes[best]))) for s in sizes)
        return self.langs[best], 1 / weight, margin, margin < narrow


def identify(docs: DataFrame, content: dict[str, bytes], id_cols: list, text_col: str = "text", level: int = 3, block: int = 2_048, narrow: float = 0.01) -> DataFrame:
    """id_cols (names or columns), lang string, score double (0 to 1), margin double, rejected boolean, for each row.

    margin: by how much of its size the second smallest encoding is larger. rejected: no letter, or a margin under `narrow`.
    """
    ids = docs.select(*id_cols, F.col(f"`{text_col}`").alias("__text"))
    kept = ids.select(*others(ids, "lang", "score", "margin", "rejected"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(content)  # at most languages x dictionary_bytes

    def run(batches: Iterator):
        import pyarrow as pa

        encoders = Encoders(shared.value, level, block)
        for batch in batches:
            found = [encoders.judge(t.as_py(), narrow) for t in batch.column(batch.num_columns - 1)]  # one text decoded at a time
            made = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            names = [f.name for f in batch.schema][:-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*names, "lang", "score", "margin", "rejected"])

    extra = [T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields[:-1], *extra]))
