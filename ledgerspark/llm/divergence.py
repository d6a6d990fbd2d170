"""How the sources of a language differ in what words they use.

Plain relational. ``term_counts`` explodes each text's regular-expression matches and counts them by language, source and term. A language
keeps the terms that at least ``LEAST_DOCS`` of its documents have. Groups (the sources of a language) are crossed with the kept vocabulary, so that
terms which a group lacks count as zero; each then has a smoothed share, in whole numbers of 10^-9. A self-join of these shares on language and
term, summed by pair, gives each source's divergence from each other one, and a comparison with the language's own shares the terms that
set a source apart: the (p - q)^2 / q of a chi-squared statistic in both. Windows rank them.

At scale: a document hands on each of its terms once, with a count, and counts combine before every shuffle. Nothing is keyed by
language alone: the vocabulary meets its language's groups on language and a salt, over which the groups are repeated.
A kept term is one row with its counts by source, at most as many as its language has sources. The dense shares, ``terms times sources`` of a language, are made
in that row and joined with each other there, so that neither they nor their pairs are shuffled, sorted or written; both directions of a pair come from
one row of this self-join, which has a row for each term and unordered pair of sources, as the method asks. Ranks to a limit are cut in every task before their rows are shuffled.

Defined cases: null text, language and source count as empty strings, so a null source is the source ''. A group without terms has
pairs (with values by its zeros, or 0 if its language keeps no term) and no terms. Languages of one source have no pairs. Repeated rows are documents of their own, whatever their ids.
Equal values rank by the item's UTF-8 bytes. Extra columns are not read. Empty table: empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, lowered, scratch, table

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"  # letters of ASCII, and whatever is not ASCII
_BETWEEN = TERM.replace("^", "")  # what stands between two matches of it
LEAST_DOCS = 3
UNIT = 1_000_000_000
TOP = 200


def counted(terms: Column) -> Column:
    """``term, n`` of each distinct element of an array of strings."""
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def of(terms: Column) -> Column:
        firsts = F.filter(F.transform(terms, lambda t, i: F.when((i == 0) | (terms[i - 1] != t), i)), lambda i: i.isNotNull())
        ends = lambda firsts: F.concat(F.slice(firsts, F.lit(2), F.size(firsts)), F.array(F.size(terms)))
        return let(firsts, lambda firsts: F.zip_with(firsts, ends(firsts), lambda a, b: F.struct(terms[a].alias("term"), (b - a).alias("n"))))

    return let(F.sort_array(terms), lambda terms: F.when(F.size(terms) > 0, of(terms)))


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of each term in each group, and the documents that have it."""
    terms = counted(F.array_remove(F.split(lowered(F.col("text")), _BETWEEN), ""))
    each = docs.select("lang", "source", F.explode(terms).alias("t")).select("lang", "source", "t.*")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 and the smoothed share of a count, in whole parts of ``UNIT``; exact for any counts: decimals where longs would not hold the product."""
    wide = lambda c: c.cast("decimal(20,0)")
    parts = (F.lit(UNIT).cast("decimal(10,0)") * (wide(n) + F.lit(1))).cast("decimal(38,0)")
    small = (n < 9 * UNIT) & (total < 1 << 62) & (terms < 1 << 62)
    plain = F.call_function("div", F.lit(UNIT).cast("long") * (n.cast("long") + 1), total.cast("long") + terms.cast("long"))
    return F.lit(1) + F.when(small, plain).otherwise(F.call_function("div", parts, wide(total) + wide(terms)))


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: pairs of sources and the terms that set each apart, ranked."""
    spark = docs.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    with scratch(spark):
        each = F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("counts")
        kept = cut(term_counts(docs).groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), each).where(F.col("docs") >= least_docs).drop("docs"))
        langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
        known = kept.select("lang", "term", "lang_n", F.explode("counts").alias("source", "n"))
        totals = known.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        groups = cut(docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", none("total"), none("terms"), none("lang_total")))

        every = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total", "terms"))).alias("groups"))
        salted = every.select("lang", "groups", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        cells = kept.select("lang", "counts", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int").alias("salt")).join(salted, ["lang", "salt"])
        shares = F.transform("groups", lambda g: share(F.coalesce(F.try_element_at("counts", g["source"]), F.lit(0).cast("long")), g["total"], g["terms"]).cast("long"))
        dense = cells.select("lang", shares.alias("shares"))

        both = dense.select("lang", "shares", F.posexplode("shares").alias("a", "p")).select("lang", "a", "p", F.posexplode("shares").alias("b", "q")).where("a < b")
        both = both.select("lang", "a", "b", distance(F.col("p"), F.col("q")).alias("there"), distance(F.col("q"), F.col("p")).alias("back"))
        names = lambda at, name: every.select("lang", F.posexplode("groups").alias(at, "g")).select("lang", at, F.col("g.source").alias(name))
        sums = both.groupBy("lang", "a", "b").agg(F.sum("there").alias("there"), F.sum("back").alias("back"))
        sums = sums.join(names("a", "source"), ["lang", "a"]).join(names("b", "item"), ["lang", "b"])
        way = lambda a, b, v: F.struct(F.col(a).alias("source"), F.col(b).alias("item"), F.col(v).alias("value"))
        sums = sums.select("lang", F.explode(F.array(way("source", "item", "there"), way("item", "source", "back"))).alias("x")).select("lang", "x.*")
        pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
        pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", "item", none("value"))

        p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
        apart = known.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
        apart = apart.where("p > q").select("lang", "source", "item", distance(F.col("p"), F.col("q")).alias("value"))

        order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        ranked = lambda df, part: df.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
        return cut(ranked(pairs, "pair").union(ranked(apart, "term").where(F.col("rank") <= top)), kept=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
each AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TERM}')) AS term FROM d),
counts AS (SELECT lang, source, term, count(*) AS n FROM each GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS n FROM each GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST_DOCS}),
groups AS (SELECT DISTINCT lang, source FROM d),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
totals AS (SELECT lang, source, sum(n) AS total, sum(lang_n) AS lang_total, count(*) AS v FROM cells GROUP BY ALL),
shares AS (SELECT c.*, 1 + {UNIT}::HUGEINT * (n + 1) // (total + v) AS p, 1 + {UNIT}::HUGEINT * (lang_n + 1) // (lang_total + v) AS q FROM cells c JOIN totals t ON t.lang = c.lang AND t.source = c.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
