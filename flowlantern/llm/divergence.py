"""Source divergence audit: how far the words of each source lie from those of every other source of its language.

Every language keeps the terms of at least ``least`` of its documents. A group (language, source), and the language itself, gives a kept term the
integer share ``p = 1 + floor(SCALE * (count + 1) / (N + V))``; the divergence of one term is ``floor((p - q)^2 / q)``.

Pairs of sources are computed over a cube. Groups of a language fall into blocks of about ``GROUPS``, kept terms into blocks of about ``TERMS``;
a cell (group block, group block, term block) receives the two slices of counts, which are copied to the cells of a row and a column of the
cube, and gives for each ordered pair the partial sum over the terms that either block has, and their number. Partial sums are added along the
term axis; terms that neither block has differ by a constant that depends on the pair alone, times their number.

Counting is done per batch of documents before anything is shuffled, so a source with a third of all rows sends its words once per task.
Sums stay in 64 bits: shares are found by three divisions in steps of a thousand, exact while a language has fewer than 9e15 words.
A null text, language or source is ''. Rows that repeat count each time. Without documents there are no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlantern.llm.graph import stored
from flowlantern.session import BROADCAST_ROWS

SCALE = 1_000_000_000
GROUPS = 64   # groups in a block: 64 x 4096 shares of 8 bytes are 2 MB
TERMS = 4096  # terms in a block
FLUSH = 200_000  # counters held by a task before they are sent on
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")  # on UTF-8: every byte of a character beyond ASCII belongs to a term


def _count(batches):
    """(lang, source, term, n, docs) of the batches; a row without a term names a group that occurs."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def flush():
        nonlocal held
        for (lang, source), (n, docs) in seen.items():
            terms = [None, *n]
            rows = len(terms)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * rows, pa.string()), pa.array([source] * rows, pa.string()), pa.array(terms, pa.string()),
                 pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())],
                names=["lang", "source", "term", "n", "docs"])
        seen.clear()
        held = 0

    for batch in batches:
        for text, lang, source in zip(*(batch.column(i).to_pylist() for i in range(3))):
            group = seen.get((lang, source))
            if group is None:
                group = seen[lang, source] = (Counter(), Counter())
            words = _TERM.findall(text.encode().lower())  # of bytes, lower() touches A-Z only
            held -= len(group[0])
            once = Counter(words)
            group[0].update(once)
            group[1].update(once.keys())
            held += len(group[0])
            if held > FLUSH:
                yield from flush()
    yield from flush()


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), exact in 64 bits while total is below 9e15."""
    out, rest = F.lit(0).cast("long"), count + 1
    for step in (1, 1000, 1000, 1000):
        rest = rest * step
        out, rest = out * step + F.call_function("div", rest, total), rest % total
    return out + 1


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _checked(df: DataFrame) -> DataFrame:
    """Broadcast a stored table if it is counted to be small, else leave it to a join by shuffle, of which skewed parts are split."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


_CELL = "lang string, source string, item string, value long, covered long, p0 long, q0 long, v long"


def _cell(key, table):
    """Partial divergences of all ordered pairs of a cell. Two rows (one on the diagonal) name the groups of its blocks, the others are slices of those
    that have terms here. ``tblock`` -1 has no slices: its pairs begin with nothing added."""
    lang, i, j, tblock = (k.as_py() for k in key)
    groups, slices = {}, {}
    for r in range(len(table)):
        if table["source"][r].is_valid:
            slices[table["source"][r].as_py()] = table["tids"][r].values.to_numpy(), table["ps"][r].values.to_numpy()
        else:
            groups[table["block"][r].as_py()] = [(g["source"], g["p0"]) for g in table["members"][r].as_py()]
            v = table["v"][r].as_py()
    left, right = groups.get(i, []), groups.get(j, [])  # a block that no group fell into has no pairs
    out: list[tuple] = []
    if slices and left and right:
        terms = np.unique(np.concatenate([t for t, _ in slices.values()]))
        m = len(terms)

        def line(name, p0):
            found = np.full(m, p0, np.int64)
            if name in slices:
                found[np.searchsorted(terms, slices[name][0])] = slices[name][1]
            return found

        others = np.stack([line(*g) for g in right])
    if left and right and (slices or tblock < 0):
        for name, p0 in left:
            if slices:
                mine = line(name, p0)
                square = (others - mine) ** 2
                forth, back = (square // others).sum(axis=1).tolist(), (square // mine).sum(axis=1).tolist()
            else:
                m, forth, back = 0, [0] * len(right), [0] * len(right)
            for (other, q0), x, y in zip(right, forth, back):
                if other != name:
                    out.append((name, other, x, m, p0, q0, v))
                    if i != j:
                        out.append((other, name, y, m, q0, p0, v))
    columns = list(zip(*out)) or [()] * 7
    types = [pa.string(), pa.string(), *[pa.int64()] * 5]
    return pa.table([pa.array([lang] * len(out), pa.string()), *(pa.array(c, t) for c, t in zip(columns, types))],
                    names=["lang", "source", "item", "value", "covered", "p0", "q0", "v"])


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; a null term stands for the group itself."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    parts = texts.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def audited(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` rows for every other source of the language, ``term`` rows for the ``top`` terms."""
    counts = stored(counted(docs), "counts")
    kept = stored(counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("qn"), F.sum("docs").alias("df"))
                  .where(F.col("df") >= least).drop("df"), "kept")
    langs = (counts.where("term is null").groupBy("lang").agg(F.count("*").alias("groups"))
             .join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("qn").alias("qtotal")), "lang", "left").na.fill(0)
             .withColumn("gblocks", F.ceil(F.col("groups") / GROUPS).cast("int")).withColumn("tblocks", F.ceil(F.col("v") / TERMS).cast("int")))
    langs = _checked(stored(langs, "langs"))
    placed = kept.join(langs.select("lang", "tblocks"), "lang").withColumn("tblock", F.pmod(F.xxhash64("term"), "tblocks").cast("int"))
    placed = placed.select("lang", "term", "qn", "tblock",
                           F.row_number().over(Window.partitionBy("lang", "tblock").orderBy("term")).alias("tid"))
    marked = stored(counts.drop("docs").join(placed, ["lang", "term"], "left").where("term is null or tid is not null"), "marked")
    groups = (marked.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(langs, "lang")
              .withColumn("block", F.pmod(F.xxhash64("source"), "gblocks").cast("int"))
              .withColumn("gtotal", F.greatest(F.col("total") + F.col("v"), F.lit(1))).withColumn("ltotal", F.col("qtotal") + F.col("v"))
              .withColumn("p0", share(F.lit(0).cast("long"), F.col("gtotal"))))
    groups = stored(groups.select("lang", "source", "gtotal", "ltotal", "v", "p0", "block", "gblocks", "tblocks"), "groups")
    rows = (marked.where("tid is not null").join(_checked(groups.select("lang", "source", "gtotal", "ltotal")), ["lang", "source"])
            .withColumn("p", share(F.col("n"), F.col("gtotal"))).withColumn("q", share(F.col("qn"), F.col("ltotal"))))

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    slices = (rows.groupBy("lang", "source", "tblock").agg(F.collect_list(F.struct("tid", "p")).alias("x"))
              .select("lang", "source", "tblock", F.col("x.tid").alias("tids"), F.col("x.p").alias("ps")))
    # every cell learns the names of its groups from one row of each block
    blocks = (groups.groupBy("lang", "block", "v", "gblocks", "tblocks").agg(F.collect_list(F.struct("source", "p0")).alias("members"))
              .withColumn("tblock", F.explode(F.sequence(F.lit(-1), F.col("tblocks") - 1))).drop("tblocks"))
    members = blocks.schema["members"].dataType
    cells = slices.join(_checked(groups.select("lang", "source", "v", "block", "gblocks")), ["lang", "source"]).select(
        "lang", "block", "v", "gblocks", F.lit(None).cast(members).alias("members"), "tblock", "source", "tids", "ps")
    cells = cells.union(blocks.select("*", F.lit(None).cast("string"), F.lit(None).cast("array<int>"), F.lit(None).cast("array<long>")))
    cells = (cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("gblocks") - 1)))
             .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("gblocks", "other"))
    partial = cells.groupBy("lang", "i", "j", "tblock").applyInArrow(_cell, _CELL)
    pairs = partial.groupBy("lang", "source", "item").agg(
        F.sum("value").alias("value"), F.sum("covered").alias("covered"), *[F.max(c).alias(c) for c in ("p0", "q0", "v")])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item",
                         (F.col("value") + (F.col("v") - F.col("covered")) * gap(F.col("p0"), F.col("q0"))).alias("value"))
    return pairs.withColumn("rank", F.row_number().over(best)).union(terms)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS qn FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
grp AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT g.lang, count(k.term) AS v, coalesce(sum(k.qn), 0) AS qtotal FROM (SELECT DISTINCT lang FROM grp) g LEFT JOIN kept k USING (lang) GROUP BY g.lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
t AS (SELECT g.lang, g.source, l.v, l.qtotal, coalesce(sum(c.n), 0) AS total
      FROM grp g JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.total + t.v)::HUGEINT AS p,
             1 + (1000000000::HUGEINT * (k.qn + 1)) // (t.qtotal + t.v)::HUGEINT AS q
      FROM t JOIN kept k USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0)::BIGINT AS value
          FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""
