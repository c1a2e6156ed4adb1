"""Source divergence audit: how the terms of each source of a language differ from the others'.

A term is a run of letters a-z (A-Z lowered) and non-ASCII characters.  ``bytes.translate`` lowers
letters and blanks all other ASCII in one pass, ``bytes.split`` gives the terms, a Counter per
document their frequencies.  A language keeps the terms that enough of its documents hold.  Every
group (language, source) and every language gives each kept term the smoothed share p, in
billionths, and two shares are compared by their triangular discrimination (p - q)² / (p + q).

1. Counters are added up per group in each task, handed on before they grow large, and summed up by
   (language, term); a term that much of the corpus uses is a row per task and source.
2. Kept terms are dealt into blocks of a few hundred, whatever their number.  A block's counts and
   the language's sources give the part of all sums over its terms, including those of terms that a
   source lacks, and the block's foremost terms of each source.
3. The parts are summed up and ranked.  The rows of pairs are the result's own, one per pair.

Null text, language and source count as empty; a group without terms, or whose language keeps none,
has its pairs too.  Repeated rows count each.  Texts are taken whole, long terms as they are.  An
empty table gives no row.  Columns other than text, lang and source are ignored.  Shares are
computed by long division in 64 bits, exact for up to 9 · 10¹⁵ terms in a group.
"""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.llm.text import whole, written

LEAST_DOCUMENTS = 10
TOP_TERMS = 10

# What is added to each count, and the unit of a share, as three factors.
PRIOR, THOUSANDS = 2, 3

# Different terms counted before a task hands them on; terms in a block; shares held at once.
COUNT_TERMS = 1 << 19
BLOCK_TERMS = 512
SHARES = 1 << 18

# A task counts occurrences and documents in one number: these are the high bits.
ONE_DOCUMENT = 1 << 40

_TABLE = bytes(
    b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256))

PARTS = "lang string, source string, part string, item string, value bigint"


def _counted(batches):
    """lang, source, term with its occurrences and documents, summed over a part of a task."""

    def rows():
        found = [(g, t, n) for g, terms in total.items() for t, n in terms.items()]
        n = np.array([n for *_, n in found], np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([g[0] for g, *_ in found], pa.string()),
             pa.array([g[1] for g, *_ in found], pa.string()),
             pa.array([t for _, t, _ in found], pa.binary()).cast(pa.string()),
             pa.array(n % ONE_DOCUMENT), pa.array(n // ONE_DOCUMENT)],
            ["lang", "source", "term", "n", "docs"])

    total = defaultdict(dict)
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
        for text, group in zip(texts, groups):
            terms = total[group]
            seen = terms.get
            for term, n in Counter(text.translate(_TABLE).split()).items():
                terms[term] = seen(term, 0) + n + ONE_DOCUMENT
        if sum(map(len, total.values())) > COUNT_TERMS:
            yield rows()
            total = defaultdict(dict)
    yield rows()


def _groups(docs):
    return docs.select(*[whole(F.col(c)).alias(c) for c in ("lang", "source")])


def kept_terms(docs, least=LEAST_DOCUMENTS):
    """lang, term, counts (source and n, one per source that has it) of the kept terms."""
    texts = docs.select(*[whole(F.col(c)).alias(c) for c in ("text", "lang", "source")])
    # One exchange serves both groupings; the tasks have combined the rows before it.
    partial = texts.mapInArrow(
        _counted, "lang string, source string, term string, n bigint, docs bigint"
    ).repartition("lang", "term")
    by_source = partial.groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return (
        by_source.groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
        .where(F.col("docs") >= least)
        .select("lang", "term", "counts")
    )


def _languages(docs, kept):
    """lang, terms (number of kept ones) and groups (source and its total, in order)."""
    totals = kept.select("lang", F.explode("counts").alias("c")).groupBy(
        "lang", "c.source").agg(F.sum("c.n").alias("total"))
    groups = _groups(docs).distinct().join(totals, ["lang", "source"], "left")
    listed = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct(
        "source", F.coalesce("total", F.lit(0)).alias("total")))).alias("groups"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    return listed.join(sizes, "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0)))


def share(count, total, terms):
    """1 + floor(10⁹ (count + 2) / (total + 2 terms)), for arrays of counts."""
    whole_ = total + PRIOR * terms
    share, rest = np.divmod(np.asarray(count, np.int64) + PRIOR, whole_)
    for _ in range(THOUSANDS):
        digit, rest = np.divmod(rest * 1000, whole_)
        share = share * 1000 + digit
    return share + 1


def distance(p, q):
    """floor((p - q)² / (p + q))."""
    apart = p - q
    return apart * apart // (p + q)


def _block_parts(lang, terms, sources, totals, words, counts, top):
    """Rows of a block: its part of each pair's sum, its foremost terms of each source."""
    place = {s: i for i, s in enumerate(sources)}
    sums = np.zeros((len(sources), len(sources)), np.int64)
    step = max(1, SHARES // len(sources))
    foremost = [[] for _ in sources]
    for a in range(0, len(words), step):
        n = np.zeros((len(words[a:a + step]), len(sources)), np.int64)
        for row, found in enumerate(counts[a:a + step]):
            for c in found:
                n[row, place[c["source"]]] = c["n"]
        p = share(n, totals, terms)
        q = share(n.sum(axis=1), totals.sum(), terms)[:, None]
        for i in range(len(sources) - 1):
            sums[i, i + 1:] += distance(p[:, i + 1:], p[:, i:i + 1]).sum(axis=0)
        value = distance(p, q)
        for row, i in zip(*np.nonzero((n > 0) & (p > q))):
            foremost[i].append((-int(value[row, i]), words[a + row]))
        foremost = [_foremost(f, top) for f in foremost]
    sums += sums.T
    for i, source in enumerate(sources):
        for j, other in enumerate(sources):
            if i != j:
                yield lang, source, "pair", other, int(sums[i, j])
        for value, word in foremost[i]:
            yield lang, source, "term", word, -value


def _foremost(found, top):
    return sorted(found, key=lambda x: (x[0], x[1].encode()))[:top]


def _compare(top):
    names = [f.split()[0] for f in PARTS.split(", ")]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sources = [g["source"] for g in row["groups"]]
                totals = np.array([g["total"] for g in row["groups"]], np.int64)
                block = row["block"] or []
                found = list(_block_parts(
                    row["lang"], row["terms"], sources, totals, [b["term"] for b in block],
                    [b["counts"] for b in block], top))
                columns = list(zip(*found)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.string()) for c in columns[:4]),
                     pa.array(columns[4], pa.int64())], names)

    return run


def audit(docs, least=LEAST_DOCUMENTS, top=TOP_TERMS):
    """lang, source, part, item, value, rank.

    Part ``pair``: every other source of the language, by the sum over all kept terms.  Part
    ``term``: the ``top`` terms the source uses most beyond the language.
    """
    kept = written(kept_terms(docs, least), "kept-terms")
    languages = written(_languages(docs, kept), "languages")
    size = F.greatest(F.lit(BLOCK_TERMS), 4 * F.size("groups"))
    numbered = kept.join(languages.select("lang", "terms", size.alias("size")), "lang").withColumn(
        "number", F.pmod(F.xxhash64("term"), F.ceil(F.col("terms") / F.col("size"))))
    # A block is much work for its bytes: as many tasks as partitions, whatever their size.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = numbered.repartition(tasks, "lang", "number").groupBy("lang", "number").agg(
        F.collect_list(F.struct("term", "counts")).alias("block"))
    given = ["lang", "terms", "groups"]
    # Not one outer join: that would deal the blocks by language.
    blocks = blocks.join(languages, "lang").select(*given, "block").unionAll(
        languages.where("terms = 0").select(*given, F.lit(None).alias("block")))
    parts = blocks.mapInArrow(_compare(top), PARTS)
    # The blocks' rows: a sum for each pair, the first terms of each source.
    parts = written(parts, "parts")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(
        F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    terms = parts.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= top)
    return ranked.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
