"""URL filters with a Bloom filter cascade; DataFrame functions only.

A rule is a host, which covers its subdomains, and a path prefix. A url's keys are its host's suffixes joined to its path's prefixes,
of the lengths that rules have. The first filter encodes the listed keys; the second the false positives of the first over
the complete universe of the corpus's keys; the third the listed keys that pass the second, and so on until nothing passes
wrongly. For any key of the universe membership is then exact, and it is tested row by row, without a join.

A filter's size follows the listed keys alone (false positives of a level are fewer than those before). Filters are literals of the plan, once a level, so a
cascade takes `max_bytes` at most: more keys are dealt by a hash into cascades of that size, which are built and applied one after the other, with
the narrow table of urls written between them. Membership stays exact, and no rule or shape of rules is left out.

Defined cases: a null url, or one without `://`, has an empty host and path and fits no rule; of the rules that fit, the longest wins, block
before allow at equal length; repeated rules count once; without rules every verdict is `allow`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, release

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Cascade:
    """Filters as (number of bits, words of 64 bits), tested in turn; last: the keys that pass them all, if `max_levels` filters don't separate them."""

    def __init__(self, levels: list[tuple[int, list[int]]], hashes: int, last: list[str] | None = None):
        self.levels, self.hashes, self.last = levels, hashes, last

    def _passes(self, key: Column, level: int) -> Column:
        bits, words = self.levels[level]
        data = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")  # folded into one literal
        places = F.array(*[F.pmod(F.xxhash64(F.lit(level), F.lit(j), key), F.lit(bits)) for j in range(self.hashes)])
        return F.forall(places, lambda at: F.getbit(F.element_at(data, (at / 64).cast("int") + 1), (at % 64).cast("int")) == 1)

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe; a null key is in no list."""
        if not self.levels:
            return F.lit(False)
        # the first level that a key fails tells: odd levels encode listed keys, even levels the others
        chain = None
        for level in range(len(self.levels)):
            fails = ~self._passes(key, level)
            chain = F.when(fails, F.lit(level % 2 == 1)) if chain is None else chain.when(fails, F.lit(level % 2 == 1))
        end = F.lit(len(self.levels) % 2 == 1)
        if self.last is not None:
            end = F.array_contains(F.array(*map(F.lit, self.last)).cast("array<string>"), key) == F.lit(len(self.levels) % 2 == 0)
        return F.coalesce(F.when(key.isNotNull(), chain.otherwise(end)), F.lit(False))

    @classmethod
    def build(cls, universe: DataFrame, listed: DataFrame, bits_per_key: int = 12, hashes: int = 4, max_levels: int = 64) -> Cascade:
        """universe, listed: a column `key` each; repeats count once. The universe is streamed once to find the first false
        positives; all later levels work on sets no larger than those."""
        made = cls([], hashes)
        inside = listed.where("key IS NOT NULL").distinct()
        outside, written = universe.where("key IS NOT NULL").select("key"), []
        while (n := inside.count()) > 0:
            level = len(made.levels)
            if level >= max_levels:  # by then no more than a few keys are left
                made.last = [r.key for r in inside.collect()]
                break
            bits = 64 * max(1, -(-n * bits_per_key // 64))
            at = F.array(*[F.pmod(F.xxhash64(F.lit(level), F.lit(j), F.col("key")), F.lit(bits)) for j in range(hashes)])
            one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
            rows = inside.select(F.explode(at).alias("at")).groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(one).alias("set")).collect()
            words = [0] * (bits // 64)
            for r in rows:
                words[r.word] = r.set
            made.levels.append((bits, words))
            wrong = outside.where(made._passes(F.col("key"), level)).distinct()
            if level == 0:
                wrong = wrong.join(inside, "key", "left_anti")
            inside, outside = materialize(wrong), materialize(inside)
            written += [inside, outside]
        release(*written)
        return made


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rules(spark: SparkSession, rules: DataFrame | Iterable[tuple[str, str, str]]) -> DataFrame:
    frame = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "host string, path string, verdict string")
    return frame.select(F.concat(F.translate("host", UPPER, LOWER), F.col("path")).alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length"), "verdict")


def _keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys that rules of any of the shapes (labels of the host, length of the path) could have for a url."""
    listed = F.split(F.lit(",".join(f"{labels}:{length}" for labels, length in shapes)), ",")

    def key(shape: Column) -> Column:
        labels, length = F.split(shape, ":")[0].cast("int"), F.split(shape, ":")[1].cast("int")
        made = F.concat(F.call_function("substring_index", host, F.lit("."), -labels), F.substring(path, F.lit(1), length))
        return F.when((F.length(path) >= length) & (host != ""), made)

    return F.array_distinct(F.array_compact(F.transform(listed, key)))


def judge(
    pages: DataFrame,
    rules: DataFrame | Iterable[tuple[str, str, str]],
    url_col: str = "url",
    keep: list[str] | None = None,
    default: str = "allow",
    bits_per_key: int = 12,
    max_bytes: int = 4_000_000,
    **options,
) -> DataFrame:
    """keep columns (default: all of pages), then host, path, rule and verdict of each row; clashing columns of pages are dropped."""
    listed = _rules(pages.sparkSession, rules)
    names = [c for c in (keep or pages.columns) if c.lower() not in ("host", "path", "rule", "verdict")]
    url = F.col(f"`{url_col}`")
    shown = pages.select(*[F.col(f"`{c}`") for c in names], host_of(url).alias("host"), path_of(url).alias("path"))
    shapes = sorted((r.labels, r.length) for r in listed.select("labels", "length").distinct().collect())
    if not shapes:
        return shown.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    parts = max(1, -(-listed.select("key").distinct().count() * bits_per_key // (8 * max_bytes)))
    part_of = lambda key: F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts))
    universe = pages.select(F.explode(_keys(host_of(url), path_of(url), shapes)).alias("key"))
    best = fresh(shown, "best")
    kind = "struct<n:int,blocked:boolean,key:string>"
    shown = shown.withColumn(best, F.lit(None).cast(kind))
    for part in range(parts):
        number = F.lit(part)
        own = listed.where(part_of(F.col("key")) == number)
        keys = own.select("key")
        known = Cascade.build(universe.where(part_of(F.col("key")) == number), keys, bits_per_key, **options)
        block = Cascade.build(keys, own.where("verdict = 'block'").select("key"), bits_per_key, **options)
        near = F.filter(_keys(F.col("host"), F.col("path"), shapes), lambda k: (part_of(k) == number) & known.contains(k))  # noqa: B023  used at once
        fits = F.transform(near, lambda k: F.struct(F.length(k).alias("n"), block.contains(k).alias("blocked"), k.alias("key")).cast(kind))  # noqa: B023
        old, shown = shown, shown.withColumn(best, F.array_max(F.array_compact(F.array(F.col(best), F.array_max(fits)))))
        if part < parts - 1:
            shown = materialize(shown)
            release(old)
    rule = F.col(best)["key"]
    verdict = F.when(rule.isNull(), F.lit(default)).when(F.col(best)["blocked"], F.lit("block")).otherwise(F.lit("allow"))
    return shown.withColumn("rule", rule).withColumn("verdict", verdict).drop(best)


# The rules of the contract.
CONTRACT_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

ORACLE = """
WITH r(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
p AS (SELECT page_id, row_number() OVER () AS rid, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
f AS (SELECT rid, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
      FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (rid)
"""
