"""Secrets in texts: fixed patterns, and runs of high entropy.

``find`` adds to each row the spans of its secrets. Three kinds come from patterns: ``assign`` (a value given to a name such as
password or token), ``access`` (access key ids) and ``hex`` (long runs of hexadecimal digits). A fourth, ``entropy``, comes from a
window that slides over candidate strings, maximal runs of the letters, digits and signs that keys are written with:

* For each character class (``CLASSES``) the window moves over the candidate's stretches of that class. It holds a count for each
  character of the class and the sum of ``c * log2(c)`` over the counts. A step takes one character out and one in, so two
  counts and two terms of the sum change, however wide the window. Entropy is ``log2(WINDOW) - sum / WINDOW``;
  the terms are whole numbers of 2^-20, so that every order of adding gives the same spans.
* Overlapping or touching windows at or over the class's threshold form one span, over all classes.
* A candidate on the allow-list is passed over: words (also joined ones and paths), numbers, UUIDs and placeholders. Spans that lie
  in one of a fixed pattern are reported already and not again. Fixed patterns are never suppressed.

All is column expressions over one row: nothing is shuffled, and a text costs what its matches cost. Running
positions are added up in blocks, so that a text of very many matches stays near linear.

Defined cases: a null or empty text has no spans. Repeated rows and null ids are rows like any other. Offsets count code points, ends
are exclusive. Other columns are passed on; those named like the result (``secrets``) are replaced. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("assign", "access", "hex", "entropy")
# Names of secrets, and the shapes of patterns.
NAMES = ("password", "passwd", "secret", "token", "api_?key")
_NAME = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in NAMES)
ASSIGN = rf"""({_NAME})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"  # greedy runs, so that the length can be asked for at once
HEX = "[0-9a-f]{16,}"
LEAST_VALUE = 12
#: Characters of a window, and the strings that windows move over.
WINDOW = 20
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
#: Character classes: alphabet, pattern of one character, least entropy in bits. Random strings of a window's length have some 3.3 bits
#: in hexadecimal digits, 3.9 in digits and letters of one case and 4.1 in all; prose run together has 3.0 to 3.7.
CLASSES = (
    (_DIGITS + "abcdef", "[0-9a-f]", 3.0),
    (_DIGITS + "ABCDEF", "[0-9A-F]", 3.0),
    (_DIGITS + _LOWER, "[0-9a-z]", 3.7),
    (_DIGITS + _UPPER, "[0-9A-Z]", 3.7),
    (_DIGITS + _LOWER + _UPPER + "+/_=-", "[A-Za-z0-9+/_=-]", 3.8),
)
#: The allow-list: candidates in which one of these is found. Words are dealt with in ``allowed``.
ALLOWED = (
    "^[0-9+/_=-]+$",
    "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    "[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp]laceholder|PLACEHOLDER|[Cc]hange_?me|[Yy]our[-_]|YOUR[-_]|[Xx]{6}|[*]{6}|0{8}|123456789|abcdefgh|ABCDEFGH",
)
#: Elements of an array whose sums are formed together.
BLOCK = 64
TERMS = [0, *(round(c * log2(c) * 2**20) for c in range(1, WINDOW + 1))]


def most(bits: float) -> int:
    """The sum of terms up to which a window has that entropy."""
    return round(WINDOW * (log2(WINDOW) - bits) * 2**20)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def running(steps: Column) -> Column:
    """The sums of an array of at least one int, up to and with each element."""

    def of(steps: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(steps), F.lit(BLOCK)), lambda at: F.slice(steps, at, BLOCK))
        return let(blocks, lambda blocks: let(F.transform(blocks, total), lambda sums: F.flatten(F.transform(blocks, lambda b, k: let(total(F.slice(sums, 1, k)), lambda base: F.transform(b, lambda _, i: base + total(F.slice(b, 1, i + 1))))))))

    return let(steps, of)


def matches(text: Column, pattern: Column) -> Column:
    """``start, end, value`` of every match of a pattern, leftmost first, that do not overlap."""
    kind = "array<struct<start:int,end:int,value:string>>"

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        ends = running(F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m)))
        return F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(F.array()).cast(kind))


def assigned(text: Column) -> Column:
    """The matches of ``ASSIGN`` whose value is long enough."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    whole = lambda spans: F.zip_with(spans, values, lambda s, v: F.when(F.length(v) >= LEAST_VALUE, s))
    return let(matches(text, F.lit(ASSIGN)), lambda spans: F.when(F.size(spans) > 0, F.filter(whole(spans), lambda s: s.isNotNull())).otherwise(spans))


def allowed(candidate: Column) -> Column:
    """Whether a candidate is on the allow-list, or words: letters and joints alone, which seldom change from lower to upper case."""
    words = ~candidate.rlike("[0-9]") & (F.regexp_count(candidate, F.lit("[a-z][A-Z]")) * 6 <= F.length(candidate))
    for pattern in ALLOWED:
        words = words | candidate.rlike(pattern)
    return words


def merged(spans: Column) -> Column:
    """Spans ``start, end`` in order of their starts, those that overlap or touch made one."""
    kind = "struct<done:array<struct<start:int,end:int>>,start:int,end:int>"
    first = F.struct(F.array().alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("end")).cast(kind)
    last = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    closed = lambda s: F.when(s["start"] >= 0, F.concat(s["done"], F.array(last(s)))).otherwise(s["done"])

    def step(s: Column, x: Column) -> Column:
        more = F.struct(s["done"].alias("done"), s["start"].alias("start"), F.greatest(s["end"], x["end"]).alias("end"))
        new = F.struct(closed(s).alias("done"), x["start"].alias("start"), x["end"].alias("end"))
        return F.when(x["start"] <= s["end"], more).otherwise(new).cast(kind)

    return F.aggregate(spans, first, step, closed)


def dense(run: Column, alphabet: Column, most: Column) -> Column:
    """``start, end`` of the stretches of a run of one class that windows cover whose terms sum to ``most`` or less.

    The counts of a window are a string with a character for each one of the alphabet; a count of c is the character c places after ``0``.
    """
    terms, held = F.array(*(F.lit(t) for t in TERMS)), "struct<counts:string,sum:int,done:array<struct<start:int,end:int>>,start:int,end:int>"
    span = "struct<start:int,end:int>"
    first = F.struct(F.repeat(F.lit("0"), F.length(alphabet)).alias("counts"), F.lit(0).alias("sum"), F.array().alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("end")).cast(held)
    closed = lambda s: F.when(s["start"] >= 0, F.concat(s["done"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")).cast(span)))).otherwise(s["done"])

    def moved(counts: Column, sum_: Column, at: Column, by: int) -> Column:
        """The counts and their sum after the character at a place of the alphabet has come or gone."""
        change = lambda c: F.struct(F.overlay(counts, F.char(c + 48 + by), at, F.lit(1)).alias("counts"), (sum_ + terms[c + by] - terms[c]).alias("sum"))
        return let(F.ascii(F.substring(counts, at, F.lit(1))) - 48, change)

    def windows(places: Column) -> Column:
        def step(s: Column, k: Column) -> Column:
            full = k >= WINDOW
            out = F.when(full, moved(s["counts"], s["sum"], places[k - WINDOW], -1)).otherwise(F.struct(s["counts"].alias("counts"), s["sum"].alias("sum")))

            def marked(now: Column) -> Column:
                hit = (k >= WINDOW - 1) & (now["sum"] <= most)
                apart = hit & (k - (WINDOW - 1) > s["end"])
                return F.struct(
                    now["counts"].alias("counts"),
                    now["sum"].alias("sum"),
                    F.when(apart, closed(s)).otherwise(s["done"]).alias("done"),
                    F.when(apart, k - (WINDOW - 1)).otherwise(s["start"]).alias("start"),
                    F.when(hit, k + 1).otherwise(s["end"]).alias("end"),
                ).cast(held)

            return let(let(out, lambda o: moved(o["counts"], o["sum"], places[k], 1)), marked)

        return F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), first, step, closed)

    return let(F.transform(F.split(run, ""), lambda c: F.position(c, alphabet)), windows)


def entropic(text: Column) -> Column:
    """``start, end`` of the stretches of high entropy in all candidates of a text, in order."""
    shifted = lambda spans, by: F.transform(spans, lambda s: F.struct((by + s["start"]).alias("start"), (by + s["end"]).alias("end")))

    classes = F.array(*(F.struct(F.lit(a).alias("alphabet"), F.lit(f"{one}{{{WINDOW},}}").alias("runs"), F.lit(most(bits)).alias("most")) for a, one, bits in CLASSES))

    def in_class(candidate: Column, kind: Column) -> Column:
        return F.flatten(F.transform(matches(candidate, kind["runs"]), lambda run: shifted(dense(run["value"], kind["alphabet"], kind["most"]), run["start"])))

    def of(candidate: Column) -> Column:
        found = F.flatten(F.transform(classes, lambda kind: in_class(candidate["value"], kind)))
        return shifted(merged(F.array_sort(found)), candidate["start"])

    return F.flatten(F.transform(F.filter(matches(text, F.lit(CANDIDATE)), lambda c: ~allowed(c["value"])), of))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: ``start, end, kind, value`` of every secret of a row, by start, then kind as in ``KINDS``."""
    whole = F.coalesce(F.col(text), F.lit(""))

    def of(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("rank"), s["end"].alias("end"), s["value"].alias("value")))

    base = F.concat(of(assigned(whole), 0), of(matches(whole, F.lit(ACCESS)), 1), of(matches(whole, F.lit(HEX)), 2))

    def added(base: Column) -> Column:
        new = F.filter(entropic(whole), lambda e: ~F.exists(base, lambda b: (b["start"] <= e["start"]) & (b["end"] >= e["end"])))
        return F.concat(base, F.transform(new, lambda e: F.struct(e["start"].alias("start"), F.lit(3).alias("rank"), e["end"].alias("end"), F.substring(whole, e["start"] + 1, e["end"] - e["start"]).alias("value"))))

    kinds = F.array(*(F.lit(k) for k in KINDS))
    return docs.withColumn("secrets", F.transform(F.array_sort(let(base, added)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), kinds[s["rank"]].alias("kind"), s["value"].alias("value"))))


def listed(secrets: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and a digest of the fixed kinds, and all spans, of every whole text."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(k) for k in KINDS[:3]]
    base = F.filter("secrets", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def _located(source: str, name: str, patterns: list[tuple[str, str]]) -> str:
    """SQL of the matches of patterns, each with a kind, in ``source`` (``id, body``): ``id, kind, v, first, last``."""
    parts = " UNION ALL ".join(f"SELECT id, '{kind}' AS kind, regexp_extract_all(body, '{p}') AS m, regexp_extract_all(body, '{p}', {2 * (kind == 'assign')}) AS v, regexp_split_to_array(body, '{p}') AS g FROM {source}" for kind, p in ((k, p.replace("'", "''")) for k, p in patterns))
    return f"""{name}_all AS ({parts}),
{name}_each AS (SELECT id, kind, i, m[i] AS m, v[i] AS v, g[i] AS g FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM {name}_all)),
{name} AS (SELECT id, kind, i, m, v, last - length(m) AS first, last FROM (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY id, kind ORDER BY i) AS last FROM {name}_each))"""


_ALLOWED_SQL = " OR ".join(f"regexp_matches(m, '{p}')" for p in ALLOWED)
#: Windows written out and counted one by one.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS body FROM documents),
{_located("d", "fixed", [("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)])},
base AS (SELECT id, kind, first, last FROM fixed WHERE kind <> 'assign' OR length(v) >= {LEAST_VALUE}),
{_located("d", "candidates", [("candidate", CANDIDATE)])},
kept AS (SELECT id AS doc, first AS at, row_number() OVER () AS id, m AS body FROM candidates
  WHERE NOT ({_ALLOWED_SQL} OR (NOT regexp_matches(m, '[0-9]') AND len(regexp_extract_all(m, '[a-z][A-Z]')) * 6 <= length(m)))),
{_located("kept", "runs", [(str(k), f"{one}{{{WINDOW},}}") for k, (_, one, _) in enumerate(CLASSES)])},
windows AS (SELECT id, kind, first + s AS first, substr(m, s + 1, {WINDOW}) AS body FROM (SELECT *, unnest(generate_series(0, length(m) - {WINDOW})) AS s FROM runs)),
counted AS (SELECT id, kind, first, c, count(*) AS n FROM (SELECT id, kind, first, unnest(string_split(body, '')) AS c FROM windows) GROUP BY ALL),
hits AS (SELECT id, first, first + {WINDOW} AS last FROM counted GROUP BY id, kind, first
  HAVING sum(CAST(round(n * log2(n) * 1048576) AS BIGINT)) <= CASE kind {" ".join(f"WHEN '{k}' THEN {most(bits)}" for k, (_, _, bits) in enumerate(CLASSES))} END),
marked AS (SELECT *, first > coalesce(max(last) OVER (PARTITION BY id ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS is_new FROM hits),
islands AS (SELECT *, sum(is_new::INT) OVER (PARTITION BY id ORDER BY first, last) AS island FROM marked),
dense AS (SELECT k.doc AS id, 'entropy' AS kind, k.at + min(i.first) AS first, k.at + max(i.last) AS last FROM islands i JOIN kept k ON k.id = i.id GROUP BY k.id, k.doc, k.at, i.island),
spans AS (
  SELECT *, list_position(['assign', 'access', 'hex'], kind) AS rank FROM base
  UNION ALL SELECT *, 4 FROM dense e WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.id = e.id AND b.first <= e.first AND b.last >= e.last)),
texts AS (SELECT *, concat(kind, ':', first::BIGINT, ':', last::BIGINT) AS span FROM spans)
SELECT any_value(d.doc_id) AS doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY first, rank) FILTER (rank < 4), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY first, rank), '') AS spans
FROM d LEFT JOIN texts t ON t.id = d.id GROUP BY d.id
"""
