"""Source divergence audit: how far the sources of a language lie apart in their terms, by one-hot level products.

Every source of a language (a group) gives each kept term a price p from its count there; two groups differ at a term by
f(p, q) = (p - q)**2 // (p + q). As p depends on the count alone, the terms of a pair of groups need only be known
by their joint table: at how many terms has the one group count level i and the other level j. The table of all pairs
comes from one matrix product: X has a row per term and an indicator column per (group, count level), and the block
of X'X at (a, i), (b, j) is that number. Products run over blocks of terms and blocks of groups; each entry that isn't
zero is priced once and multiplied by its number.

Blocks hold terms of like total count: rare terms have few levels, so many of them share a narrow X; frequent
terms have levels of their own and go in small slices. Entries are counts of at most a block's terms, exact in
float64; prices and sums are whole numbers (Python's own where 64 bits might not do).

1. Texts are counted in tasks and summed by (lang, source, term); a term of ``LEAST_DOCUMENTS`` documents of its language is kept.
2. Kept counts are dealt to (lang, block of terms, block pair of groups); the groups of the language, with their
   totals, meet them there, so that a group without a term has its level 0.
3. A task gives the partial sums of its pairs and the best ``TOP`` terms of its groups; sums and ranks follow.

Scale: a frequent term is one row per flush of a task, and one row per group in its block; a block holds about
``BLOCK_TERMS`` terms of at most ``GROUP_BLOCK`` groups each side, whatever the language's size. Groups reach a task by a join, never the driver.

Defined cases: null text, lang and source are ''; repeated rows count as documents of their own; a group without
terms still has its pairs, a language without kept terms gives them the value 0; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from culler.llm.common import prepare, written

LEAST_DOCUMENTS = 10
TOP = 10
#: Prices are shares of this many parts.
PARTS = 1_000_000_000
BLOCK_TERMS = 4096
GROUP_BLOCK = 64
#: Parts that the terms of a language and size are dealt to when they look up their number of blocks.
SALTS = 64
#: Widest one-hot matrix of a product, in columns; terms beyond it go to the next slice.
WIDEST = 3000
#: A task's partial counts are sent on at so many entries or bytes of terms.
FLUSH_ENTRIES = 400_000
FLUSH_BYTES = 1 << 25

_TERM = re.compile(rb"[a-z\x80-\xff]+")
_COUNTS = "lang string, source string, term string, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial (lang, source, term) counts: occurrences and documents."""
    found: dict[tuple, tuple[Counter, Counter]] = {}
    entries = held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            terms = list(n)
            for i in range(0, len(terms), 50_000):
                part = terms[i : i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()),
                     pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])
        found.clear()

    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2)):
            key = (lang, source)
            if key not in found:
                found[key] = (Counter(), Counter())
            n, docs = found[key]
            words = _TERM.findall((text.as_py() or b"").lower())
            once = set(words)
            before = len(n)
            n.update(words)
            docs.update(once)
            entries += len(n) - before + 1
            if len(n) > before:
                held += sum(map(len, once))
            if entries >= FLUSH_ENTRIES or held >= FLUSH_BYTES:
                yield from flush()
                entries = held = 0
    yield from flush()


def prices(counts: np.ndarray, total: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """1 + floor(PARTS (count + 2) / (total + 2 kept)), exactly."""
    if len(counts) and int(counts.max()) < 2**62 // PARTS - 2:
        return 1 + PARTS * (counts + 2) // (total + 2 * kept)
    return np.array([1 + PARTS * (int(c) + 2) // (int(t) + 2 * int(k)) for c, t, k in zip(counts, total, kept)], dtype=np.int64)


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)); prices are at most PARTS + 1, so 64 bits hold the square."""
    return (p - q) ** 2 // (p + q)


def _one_hot(groups: np.ndarray, table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indicator columns of the groups ``wanted`` (rows of ``table``, which is group x term): X, and (row in wanted, level) of each column."""
    owners, levels, column = [], [], np.empty((len(wanted), table.shape[1]), dtype=np.int64)
    width = 0
    for i, g in enumerate(wanted):
        level, place = np.unique(table[g], return_inverse=True)
        column[i] = width + place
        owners.append(np.full(len(level), i))
        levels.append(level)
        width += len(level)
    x = np.zeros((table.shape[1], width))
    x[np.arange(table.shape[1])[None, :], column] = 1.0
    return x, np.concatenate(owners), np.concatenate(levels)


def _slices(table: np.ndarray) -> Iterator[slice]:
    """Slices of terms whose one-hot matrices stay within ``WIDEST`` columns: with t terms a group has at most t levels."""
    columns = sum(len(np.unique(row)) for row in table)
    step = table.shape[1] if columns <= WIDEST else max(1, WIDEST // max(1, len(table)))
    for i in range(0, table.shape[1], step):
        yield slice(i, i + step)


def pair_sums(table: np.ndarray, total: np.ndarray, kept: int, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sum of differences over a block's terms for groups ``rows`` x ``columns``; ``table``: group x term counts."""
    out = np.zeros((len(rows), len(columns)), dtype=object)
    same = np.array_equal(rows, columns)
    used = np.concatenate([rows, columns]) if not same else rows
    for part in _slices(table[used]):
        block = table[:, part]
        x, own, level = _one_hot(rows, block, rows)
        y, other, level2 = (x, own, level) if same else _one_hot(columns, block, columns)
        joint = x.T @ y  # the joint tables of all pairs
        i, j = np.nonzero(joint)
        p = prices(level, total[rows][own], np.full(len(own), kept))
        q = prices(level2, total[columns][other], np.full(len(other), kept))
        # a block has at most BLOCK_TERMS terms of at most PARTS each, far below 2**63
        value = joint[i, j].astype(np.int64) * difference(p[i], q[j])
        sums = np.zeros(len(rows) * len(columns), dtype=np.int64)
        np.add.at(sums, own[i] * len(columns) + other[j], value)
        out += sums.reshape(out.shape)
    return out


def top_terms(terms: list[str], table: np.ndarray, total: np.ndarray, whole: np.ndarray, lang_total: int, kept: int, top: int) -> Iterator[tuple[int, str, int]]:
    """(group, term, value) of each group's ``top`` terms that it uses more than its language does."""
    whole = prices(whole, np.full(table.shape[1], lang_total), np.full(table.shape[1], kept))
    for g, row in enumerate(table):
        used = np.flatnonzero(row)
        p = prices(row[used], np.full(len(used), total[g]), np.full(len(used), kept))
        q = whole[used]
        more = p > q
        value = difference(p[more], q[more])
        best = sorted(zip((-value).tolist(), [terms[k].encode("utf-8", "surrogatepass") for k in used[more]]))[:top]
        for v, t in best:
            yield g, t.decode("utf-8", "surrogatepass"), -v


_OUT = "lang string, a int, b int, item string, value decimal(38,0)"


def _block(counts: pd.DataFrame, groups: pd.DataFrame, top: int, group_block: int) -> pd.DataFrame:
    """One block of terms against one block pair of groups: partial pair sums (item null), and the best terms of each
    group of the first block in the pair of that block with itself (b null)."""
    lang, ga, gb = groups["lang"].iloc[0], int(groups["ga"].iloc[0]), int(groups["gb"].iloc[0])
    groups = groups.sort_values("g")
    ids, total = groups["g"].to_numpy(dtype=np.int64), groups["total"].to_numpy(dtype=np.int64)
    kept, lang_total = int(groups["kept"].iloc[0]), int(groups["lang_total"].iloc[0])
    place, terms = pd.factorize(counts["term"])
    table = np.zeros((len(ids), len(terms)), dtype=np.int64)
    table[np.searchsorted(ids, counts["g"].to_numpy()), place] = counts["n"].to_numpy()
    rows, columns = np.flatnonzero(ids // group_block == ga), np.flatnonzero(ids // group_block == gb)
    # terms that none of these groups holds: level 0 against level 0
    absent = int(groups["terms"].iloc[0]) - len(terms)
    zero = prices(np.zeros(len(ids), dtype=np.int64), total, np.full(len(ids), kept))
    sums = pair_sums(table, total, kept, rows, columns) + (absent * difference(zero[rows][:, None], zero[columns][None, :])).astype(object)
    out = [(lang, int(ids[a]), int(ids[b]), None, Decimal(int(sums[i, j])))
           for i, a in enumerate(rows) for j, b in enumerate(columns) if ids[a] < ids[b]]
    if ga == gb:
        whole = np.zeros(len(terms), dtype=np.int64)
        whole[place] = counts["whole"].to_numpy()
        best = top_terms(list(terms), table[rows], total[rows], whole, lang_total, kept, top)
        out += [(lang, int(ids[rows[g]]), None, term, Decimal(v)) for g, term, v in best]
    made = pd.DataFrame(out, columns=["lang", "a", "b", "item", "value"])
    return made.astype({"a": "Int32", "b": "Int32"})


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it)."""
    prepare(docs.sparkSession)
    text = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    narrow = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    partial = narrow.mapInArrow(_count, _COUNTS)
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _groups(docs: DataFrame, counts: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, source, g (0, 1, ... per language), total, lang_total, kept of every group; last: the language's largest g."""
    text = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
    every = docs.select(text("lang"), text("source")).distinct()
    total = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("whole").alias("lang_total"))
    found = every.join(total, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    placed = found.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    return placed.withColumn("last", F.max("g").over(Window.partitionBy("lang")))


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP, block_terms: int = BLOCK_TERMS,
          group_block: int = GROUP_BLOCK) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    all_counts = written(term_counts(docs), "term-counts")
    terms = all_counts.groupBy("lang", "term").agg(F.sum("n").alias("whole"), F.sum("docs").alias("docs"))
    # terms of like total count share a block
    terms = terms.filter(F.col("docs") >= least_documents).select("lang", "term", "whole", F.floor(F.log2("whole")).cast("int").alias("size"))
    terms = written(terms, "terms")
    blocks = terms.groupBy("lang", "size").agg(F.ceil(F.count("*") / block_terms).cast("int").alias("blocks"))
    # salted, as one language and size may hold a third of all terms
    salted = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("term", F.lit("salt")), F.lit(SALTS)).cast("int")
    dealt = terms.withColumn("salt", salt).join(salted, ["lang", "size", "salt"]).drop("salt").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    counts = written(all_counts.select("lang", "source", "term", "n").join(dealt.drop("blocks"), ["lang", "term"]), "kept-counts")
    groups = written(_groups(docs, counts, terms), "groups")

    # a block of terms meets every pair of blocks of groups; a group's rows go to the pairs that its block is in
    own = F.floor(F.col("g") / group_block).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.col("last") / group_block).cast("int")), lambda i: F.struct(F.least(i, own).alias("ga"), F.greatest(i, own).alias("gb")))
    placed = groups.withColumn("pair", F.explode(pairs)).select("*", "pair.ga", "pair.gb")
    keys = ["lang", "size", "block", "ga", "gb"]
    near = counts.join(placed.select("lang", "source", "g", "ga", "gb"), ["lang", "source"]).select(*keys, "g", "term", "n", "whole")
    every_block = dealt.groupBy("lang", "size", "block").agg(F.count("*").alias("terms"))
    meet = placed.join(every_block, "lang")
    meet = meet.select(*[F.col(c).alias(c) for c in (*keys, "g", "total", "lang_total", "kept", "terms")])  # columns apart from those of ``near``
    found = near.groupBy(*keys).cogroup(meet.groupBy(*keys)).applyInPandas(lambda c, g: _block(c, g, top, group_block), _OUT)
    found = written(found, "divergence")

    named = groups.select("lang", F.col("g").alias("a"), "source")
    other = groups.select("lang", F.col("g").alias("b"), F.col("source").alias("item"))
    sums = found.filter("b is not null").groupBy("lang", "a", "b").agg(F.sum("value").cast("long").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pair = named.join(other, "lang").filter("a <> b").join(both, ["lang", "a", "b"], "left")
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    term = found.filter("b is null").join(named, ["lang", "a"]).select("lang", "source", F.lit("term").alias("part"), "item", F.col("value").cast("long"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    term = term.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pair.withColumn("rank", F.row_number().over(order)).unionByName(term)
