"""Secret scans over a trigram inverted index; DataFrame functions only.

A Boolean trigram query (an OR of ANDs) is derived from each rule's regular expression. One pass over the texts posts
(trigram, document) for the trigrams that any query names; postings are intersected by counting, for each document and
conjunct, how many of its trigrams are there; candidates of a rule are then verified with the rule's own expression.
Rules without a mandatory trigram scan every text. The index is over lower-cased text, so it never misses a match.

Defined cases: a null text is empty; spans are in code points, end exclusive; matches of one rule never overlap, those of
different rules may; equal spans of two rules are both reported, in the rules' order; rows with one id share their candidates,
which only means more to verify, and are judged by their own text; null ids are an id of their own; unknown columns pass through, but for one that is named
like the result, whose place the result takes; very long texts with very many matches are gathered in blocks, so time grows little faster than the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, others, release

try:  # the parser of the standard library moved in 3.11
    from re import _constants as sre_c
    from re import _parser as sre_p
except ImportError:
    import sre_constants as sre_c
    import sre_parse as sre_p


@dataclass(frozen=True)
class Rule:
    """pattern: an expression that Java, RE2 and Python read alike; a match counts if `group` has `least` characters or more.

    quick, if given, is a cheaper expression that every counted match holds; it is tried first where a rule scans fully.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    quick: str | None = None


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The base rules of the contract.
KEYWORDS = ("password", "passwd", "secret", "token")
BASE = (
    Rule("assign", "(" + "|".join(map(_either_case, KEYWORDS)) + "|" + _either_case("api") + "_?" + _either_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}", 0, 24, "[0-9a-f]{24}"),  # a run of 24 or more is the base rule's match of such a run
)
# Well-known public token formats that the base doesn't name.
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 20),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
)
RULES = BASE + MORE


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _either(a: set, b: set) -> set:
    """Absorb: a conjunct that asks for more than another is redundant in an OR."""
    both = a | b
    return {x for x in both if not any(y < x for y in both)}


def _both(a: set, b: set, limit: int = 256) -> set:
    made = _either(set(), {x | y for x in a for y in b})
    return made if len(made) <= limit else a  # a weaker query stays right


def trigram_query(pattern: str, most_exact: int = 64) -> set[frozenset[str]]:
    """An OR of ANDs of lower-case trigrams that every match of pattern fulfils; {frozenset()} is always true."""
    always = {frozenset()}

    def flush(exact: set[str]) -> set:
        out: set = set()
        for s in exact:
            out = _either(out, {_grams(s)})
        return out or always

    def one(op, arg) -> tuple[set[str] | None, set]:
        """(all strings it matches, if few, else None; the query)."""
        if op is sre_c.LITERAL:
            return {chr(arg).lower()}, always
        if op is sre_c.IN:
            chars: set[str] = set()
            for kind, value in arg:
                if kind is sre_c.LITERAL:
                    chars.add(chr(value).lower())
                elif kind is sre_c.RANGE and value[1] - value[0] < 16:
                    chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    return None, always
            return (chars, always) if len(chars) <= 8 else (None, always)
        if op is sre_c.SUBPATTERN:
            return many(arg[-1])
        if op is sre_c.BRANCH:
            parts = [many(x) for x in arg[1]]
            if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= most_exact:
                return set().union(*[e for e, _ in parts]), always
            query: set = set()
            for exact, own in parts:
                query = _either(query, own if exact is None else flush(exact))
            return None, query
        if op in (sre_c.MAX_REPEAT, sre_c.MIN_REPEAT):
            least, most, body = arg
            exact, own = many(body)
            if (least, most) == (0, 1) and exact is not None:
                return exact | {""}, always
            if least == 0:
                return None, always
            return (exact, own) if (least, most) == (1, 1) else (None, own if exact is None else flush(exact))
        return None, always

    def many(items) -> tuple[set[str] | None, set]:
        run, query, whole = {""}, always, True
        for op, arg in items:
            exact, own = one(op, arg)
            if exact is not None and len(run) * len(exact) <= most_exact:
                run = {a + b for a in run for b in exact}
                continue
            query, whole = _both(query, flush(run)), False
            if exact is None:
                query, run = _both(query, own), {""}
            else:
                run = exact
        return (run, always) if whole else (None, _both(query, flush(run)))

    exact, query = many(sre_p.parse(pattern))
    return flush(exact) if exact is not None else query


def candidates(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rules array<int>): for each id with any, the numbers of the indexed rules whose trigram query holds."""
    wanted = [(r, c, g) for r, rule in enumerate(rules) for c, grams in enumerate(sorted(map(sorted, trigram_query(rule.pattern)))) for g in grams]
    spark = docs.sparkSession
    queries = spark.createDataFrame(wanted, "rule int, conjunct int, trigram string")
    need = queries.groupBy("rule", "conjunct").agg(F.count("*").alias("need"))
    lowered = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("low"))  # a column of its own, made once a row
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in sorted({g for _, _, g in wanted})]))
    postings = lowered.select("id", F.explode(held).alias("trigram"))
    # queries and needs are as long as the rules' texts, never as the corpus
    hits = postings.join(F.broadcast(queries), "trigram").groupBy("id", "rule", "conjunct").agg(F.count_distinct("trigram").alias("n"))
    true = hits.join(F.broadcast(need), ["rule", "conjunct"]).where("n = need")
    return true.groupBy("id").agg(F.collect_set("rule").alias("rules"))


def _gather(items: Column, step, made: str, block: int = 64) -> tuple[Column, Column]:
    """(where the last step ended, array of all that steps made): step(at, x) gives a struct of the next `at` and an array.

    What steps make is appended inside blocks of items and blocks are joined at the end, as appending copies the array.
    """
    inner = f"struct<at:int,out:array<{made}>>"
    outer = f"struct<at:int,out:array<array<{made}>>>"
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / block).cast("int") - 1, F.lit(0))), lambda i: F.slice(items, i * block + 1, F.lit(block))
    )

    def inside(at: Column, some: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().alias("out")).cast(inner)

        def add(acc, x):
            one = step(acc["at"], x)
            return F.struct(one["at"].alias("at"), F.concat(acc["out"], one["out"]).alias("out")).cast(inner)

        return F.aggregate(some, start, add)

    def join(acc, some):
        # a lambda over one element, so that a block is worked through once
        return F.transform(F.array(inside(acc["at"], some)), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")).cast(outer))[0]

    whole = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(outer), join)
    return whole["at"], F.flatten(whole["out"])


SPAN = "struct<start:int,rule:int,end:int>"


def _spans(text: Column, number: int, rule: Rule) -> Column:
    """array<struct(start, rule, end)> of one rule's counted matches: what stands between matches and the matches
    themselves, taken in turn, add up to positions."""
    pattern = F.lit(rule.pattern)
    between, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    pairs = F.arrays_zip(
        F.transform(F.slice(between, 1, F.size(found)), F.length).alias("between"), F.transform(found, F.length).alias("found"), F.transform(value, F.length).alias("value")
    )

    def step(at, x):
        first = at + x["between"]
        span = F.array(F.struct(first.alias("start"), F.lit(number).alias("rule"), (first + x["found"]).alias("end")))
        return F.struct((first + x["found"]).alias("at"), F.when(x["value"] >= rule.least, span).otherwise(F.array().cast(f"array<{SPAN}>")).alias("out"))

    return _gather(pairs, step, SPAN)[1]


def _held(low: Column, rules, number: int) -> Column:
    """Whether a text's own postings fulfil a rule's trigram query: the index of one document."""
    found = F.lit(False)
    for grams in sorted(map(sorted, trigram_query(rules[number].pattern))):
        every = F.lit(True)
        for g in grams:
            every = every & F.contains(low, F.lit(g))
        found = found | every
    return found


def scan(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", out: str = "secrets", max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs with one more column `out`: array<struct(start, rule, end)> ordered by start, then rule (a number in `rules`).

    Candidates are few narrow rows. They are written and counted; up to max_broadcast_rows they are broadcast to the texts. Were there more, each text's
    own postings are intersected where the text is, which gives the same candidates. Either way no text is shuffled, and every document takes part.
    """
    docs = docs.select(*others(docs, out))
    key, may = fresh(docs, "secret_id"), fresh(docs, "secret_rules")
    found = materialize(candidates(docs, rules, id_col, text_col).select(F.struct("id").alias(key), F.col("rules").alias(may)))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    few = found.count() <= max_broadcast_rows
    if few:  # a struct of the id joins null ids too
        joined = docs.join(F.broadcast(found), F.struct(F.col(f"`{id_col}`").alias("id")) == F.col(key), "left")
    else:
        release(found)
        joined = docs.withColumn(key, F.lower(text)).withColumn(may, F.lit(None).cast("array<int>"))
    empty = F.array().cast(f"array<{SPAN}>")
    parts = []
    for number, rule in enumerate(rules):
        if trigram_query(rule.pattern) == {frozenset()}:
            test = text.rlike(rule.quick or rule.pattern)
        else:
            test = F.coalesce(F.array_contains(F.col(may), number), F.lit(False)) if few else _held(F.col(key), rules, number)
        parts.append(F.when(test, _spans(text, number, rule)).otherwise(empty))
    return joined.withColumn(out, F.array_sort(F.concat(*parts))).drop(key, may)


def span_text(spans: Column, rules=RULES, only: int | None = None) -> Column:
    """kind:start:end, comma-joined; only: of the first so many rules."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    chosen = spans if only is None else F.filter(spans, lambda s: s["rule"] < only)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", F.element_at(kinds, s["rule"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", mark: str = "[{}]", length_col: str | None = None) -> DataFrame:
    """docs with each secret in its text replaced by mark (with the kind of the span that begins first) and, if named, the
    length column brought up to date where the text changed. The columns and the rows are those of docs."""
    out = fresh(docs, "secrets")
    text = F.col(f"`{text_col}`")
    marks = F.array(*[F.lit(mark.format(r.kind)) for r in rules])

    def step(at, span):
        more = F.array(F.substring(text, at + 1, span["start"] - at), F.element_at(marks, span["rule"] + 1))
        return F.struct(F.greatest(at, span["end"]).alias("at"), F.when(span["start"] >= at, more).otherwise(F.array().cast("array<string>")).alias("out"))

    end, pieces = _gather(F.col(out), step, "string")
    clean = F.concat(F.array_join(pieces, ""), F.substring(text, end + 1, F.length(text)))
    marked = scan(docs, rules, id_col, text_col, out)
    dirty = F.size(out) > 0
    changed = marked.withColumn(text_col, F.when(dirty, clean).otherwise(text))
    if length_col is not None:
        changed = changed.withColumn(length_col, F.when(dirty, F.length(text).cast(docs.schema[length_col].dataType)).otherwise(F.col(f"`{length_col}`")))
    return changed.select(*[F.col(f"`{c}`") for c in docs.columns])


def _oracle_part(number: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
SELECT doc_id, rid, {number} AS k, '{rule.kind}' AS kind, start, start + len(m) AS stop FROM (
  SELECT doc_id, rid, m, v, (sum(len(b)) OVER w + sum(len(m)) OVER w - len(m))::BIGINT AS start FROM (
    SELECT doc_id, rid, unnest(regexp_extract_all(t, '{pattern}', 0)) AS m, unnest(regexp_extract_all(t, '{pattern}', {rule.group})) AS v,
           unnest(string_split_regex(t, '{pattern}')[:len(regexp_extract_all(t, '{pattern}', 0))]) AS b, unnest(range(len(regexp_extract_all(t, '{pattern}', 0)))) AS i FROM d)
  WINDOW w AS (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE len(v) >= {rule.least}"""


def oracle() -> str:
    """DuckDB SQL of the query's rows, which scans every text with every rule."""
    parts = " UNION ALL ".join(_oracle_part(i, r) for i, r in enumerate(RULES))
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
s AS ({parts}),
g AS (SELECT rid, count(*) FILTER (WHERE k = 0) AS a, count(*) FILTER (WHERE k = 1) AS b, count(*) FILTER (WHERE k = 2) AS h,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (WHERE k < {len(BASE)}) AS base,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS every FROM s GROUP BY rid)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN g USING (rid)
"""
