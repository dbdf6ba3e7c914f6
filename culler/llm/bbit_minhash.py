"""Near-duplicate documents by b-bit MinHash.

A document is the set of its distinct shingles (runs of five words, A-Z in lower case). ``HASHES`` minima per set
give ``BANDS`` band keys of ``BAND_ROWS`` minima each; of every minimum ``BITS`` low bits are kept, packed into words.
Documents that share a band key are candidates. A pair's similarity is estimated from the packed words: equal lanes
are counted with exclusive or and a bit count, and the chance agreement of 2**-BITS is taken out. Pairs whose
estimate is ``MARGIN`` standard errors or more below the threshold go; the rest are confirmed on full sets.

A pair at the threshold of 0.85 shares no band in one case in 2 million, and its estimate falls below the margin
in one in 300,000. At a threshold of 0.80 (the pipeline's stage) the bands miss one pair in 20,000.

1. Documents of equal sets become one class (count, sum and exclusive or of the shingle hashes).
2. In every bucket all classes are compared with the smallest one, the hub: work linear in the bucket.
3. Components so far. Only where a bucket still has members outside its hub's component (strays) are there pairs left
   to try: strays against all members of other components, in blocks of ``BLOCK`` by ``BLOCK``.
4. Components of all confirmed links.

Scale: the texts are read once for the signatures, and once more for the members of buckets of two or more. Nothing
collects a bucket: blocks bound each task, partners travel as lists of ids inside a block, and confirmed links leave
a block as the star edges of its components. A bucket of true copies costs its size once.

Defined cases: null or wordless texts have an empty set and link with nothing; with fewer than five words the whole
sequence is the one shingle; a row without an id isn't compared (component null, kept); rows that repeat an id and a
set are one vertex and each has its row; rows that repeat an id with other sets are vertices of their own, which the
id alone doesn't link; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from culler.llm.common import prepare, written
from culler.llm.components import connected_components, with_component, with_vertex
from culler.llm.piece_bpe import text_chunks
from culler.llm.words import mixed, ngrams, word_hashes

SEED = 7
SHINGLE = 5
#: Link at 100 * intersection >= PERCENT * union.
PERCENT = 85
HASHES, BANDS, BAND_ROWS, BITS = 128, 25, 5, 4
MARGIN = 4.5
BLOCK = 512
#: Rows of the small buckets that are compared in one group.
GROUP = 4096
#: Shingles hashed at a time, so that the working arrays stay in a core's cache.
_PIECE = 1 << 15
_LANES = 0x1111111111111111


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    flat, sizes = word_hashes(texts, lower=True)
    long_, count = ngrams(flat, sizes, SHINGLE)
    ends, word_ends = np.cumsum(count), np.cumsum(sizes)
    out = []
    for e, n, w, k in zip(ends, count, word_ends, sizes):
        if n:
            out.append(np.unique(long_[e - n : e]))
        else:
            out.append(ngrams(flat[w - k : w], np.array([k]), int(k))[0] if k else flat[:0])
    return out


def _coefficients(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def minima(sets: list[np.ndarray], seed: int = SEED) -> np.ndarray:
    """One row per non-empty set, one column per hash function."""
    a, b = _coefficients(seed)
    out = np.empty((len(sets), HASHES), dtype=np.uint64)
    start = 0
    while start < len(sets):
        stop, n = start, 0
        while stop < len(sets) and (stop == start or n + len(sets[stop]) <= _PIECE):
            n += len(sets[stop])
            stop += 1
        flat = np.concatenate(sets[start:stop])
        sizes = [len(s) for s in sets[start:stop]]
        at = np.cumsum(sizes) - sizes
        x = np.empty_like(flat)
        for k in range(HASHES):
            np.multiply(flat, a[k], out=x)
            np.add(x, b[k], out=x)
            out[start:stop, k] = np.minimum.reduceat(x, at)
        start = stop
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low[:, : BANDS * BAND_ROWS].reshape(len(low), BANDS, BAND_ROWS)
    key = mixed(rows[:, :, 0])
    for k in range(1, BAND_ROWS):
        key = mixed(key + rows[:, :, k])
    return key.view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """BITS bits of every minimum, as 64-bit words."""
    lanes = ((low >> np.uint64(20)) & np.uint64(2**BITS - 1)).reshape(len(low), HASHES * BITS // 64, 64 // BITS)
    shifts = np.arange(0, 64, BITS, dtype=np.uint64)
    return np.bitwise_or.reduce(lanes << shifts, axis=2).view(np.int64)


def most_different(percent: int = PERCENT) -> int:
    """Pairs with more different lanes than this are taken to lie below the threshold."""
    chance = 2.0**-BITS
    p = chance + (1 - chance) * percent / 100
    return math.ceil(HASHES * (1 - p) + MARGIN * math.sqrt(HASHES * p * (1 - p)))


def similarity(different: float) -> float:
    """Estimated similarity, with chance agreement taken out."""
    chance = 2.0**-BITS
    return ((1 - different / HASHES) - chance) / (1 - chance)


def _different_lanes(a: Column, b: Column) -> Column:
    def word(x: Column) -> Column:
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(_LANES)))

    return F.aggregate(F.zip_with(a, b, lambda x, y: word(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for start, stop in text_chunks([t or "" for t in texts]):
            sets = shingle_sets(texts[start:stop])
            some = [i for i, s in enumerate(sets) if len(s)]
            low = minima([sets[i] for i in some])
            n = np.array([len(s) for s in sets], dtype=np.int64)
            sums, xors = np.zeros(len(sets), dtype=np.int64), np.zeros(len(sets), dtype=np.int64)
            for i in some:
                sums[i] = sets[i].sum().view(np.int64)
                xors[i] = np.bitwise_xor.reduce(mixed(sets[i])).view(np.int64)
            bands, sigs = [None] * len(sets), [None] * len(sets)
            for i, b, s in zip(some, band_keys(low), packed(low)):
                bands[i], sigs[i] = b, s
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, stop - start), batch.column(2).slice(start, stop - start), pa.array(n), pa.array(sums), pa.array(xors),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64()))],
                names=["doc_id", "content", "n_shingles", "sum", "xor", "bands", "sig"])


_SIGNED = "doc_id long, content long, n_shingles long, sum long, xor long, bands array<long>, sig array<long>"


def _full_sets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for start, stop in text_chunks(part["text"].tolist()):
            piece = part.iloc[start:stop]
            sets = shingle_sets(piece["text"].tolist())
            yield pd.DataFrame({"doc": piece["doc"].to_numpy(), "same": [bool(s.sum().view(np.int64) == w) for s, w in zip(sets, piece["sum"])],
                                "shingles": [s.tobytes() for s in sets]})


def _shared(sets: list[np.ndarray], sizes: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    """How many shingles a set shares with others, by looking theirs up in it: for sets with few partners."""

    def common(i: int, others: np.ndarray) -> np.ndarray:
        theirs = np.concatenate([sets[j] for j in others])
        place = np.minimum(np.searchsorted(sets[i], theirs), len(sets[i]) - 1)
        return np.add.reduceat((sets[i][place] == theirs).astype(np.int64), np.cumsum(sizes[others]) - sizes[others])

    return common


def _marked(sets: list[np.ndarray], sizes: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    """The same, by numbering all shingles once: for sets with many partners."""
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    local = np.split(local, np.cumsum(sizes)[:-1])
    marks = np.zeros(int(max((x.max() for x in local if len(x)), default=0)) + 1, dtype=np.int64)

    def common(i: int, others: np.ndarray) -> np.ndarray:
        marks[local[i]] = 1
        both = np.add.reduceat(marks[np.concatenate([local[j] for j in others])], np.cumsum(sizes[others]) - sizes[others])
        marks[local[i]] = 0
        return both

    return common


def _tiles(pdf: pd.DataFrame, *within: str) -> Iterator[np.ndarray]:
    """The places of each block's rows, sorted by ``within``; several blocks share a group."""
    order = np.lexsort([pdf[c].to_numpy() for c in (*within[::-1], "t2", "t1")])
    t1, t2 = pdf["t1"].to_numpy()[order], pdf["t2"].to_numpy()[order]
    return iter(np.split(order, np.flatnonzero((t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])) + 1)) if len(order) else iter(())


def _confirmed(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Star edges of the components of the confirmed links of each block; a row has a document's shingles and partners."""
    doc, shingles, partners = (pdf[c].to_numpy() for c in ("doc", "shingles", "partners"))
    stars = [_confirmed_tile(doc[at], shingles[at], partners[at], percent) for at in _tiles(pdf, "doc")]
    return pd.DataFrame({c: np.concatenate([s[k] for s in stars] or [np.zeros(0, dtype=np.int64)]) for k, c in enumerate("ab")})


def _confirmed_tile(docs: np.ndarray, shingles: np.ndarray, wanted: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    names = docs[first]
    sets = [np.frombuffer(s, dtype=np.uint64) for s in shingles[first]]
    sizes = np.array([len(s) for s in sets])
    common = (_shared if sum(map(len, wanted)) <= 2 * len(names) else _marked)(sets, sizes)
    label = np.arange(len(names))

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for doc, partners in zip(docs, wanted):
        if not len(partners):
            continue
        i = np.searchsorted(names, doc)
        others = np.unique(np.searchsorted(names, np.asarray(partners, dtype=np.int64)))
        both = common(i, others)
        for j in others[100 * both >= percent * (sizes[i] + sizes[others] - both)]:
            a, b = sorted((root(i), root(j)))
            label[b] = a
    low = np.array([root(i) for i in range(len(names))])
    star = np.flatnonzero(low != np.arange(len(low)))
    return names[star], names[low[star]]


def _stray_partners(pdf: pd.DataFrame, limit: int) -> pd.DataFrame:
    """Of blocks of members (left) and of strays: each stray's likely partners in other components."""
    rep, label, stray, left = (pdf[c].to_numpy() for c in ("rep", "label", "stray", "left"))
    sigs = np.array(pdf["sig"].tolist(), dtype=np.int64).view(np.uint64)
    t1, t2 = pdf["t1"].to_numpy(), pdf["t2"].to_numpy()
    rows, docs, partners = [], [], []
    for at in _tiles(pdf):
        members, strays = at[left[at]], at[~left[at]]
        if not len(members) or not len(strays):
            continue
        words, a, al, also = sigs[members], rep[members], label[members], stray[members]
        used = np.zeros(len(members), dtype=bool)
        for i in strays:
            x = words ^ sigs[i]
            x |= x >> np.uint64(1)
            x |= x >> np.uint64(2)
            near = np.bitwise_count(x & np.uint64(_LANES)).sum(axis=1) <= limit
            near &= (al != label[i]) & (~also | (a < rep[i]))  # two strays meet twice
            if near.any():
                used |= near
                rows.append(i)
                docs.append(rep[i])
                partners.append(a[near])
        rows += members[used].tolist()
        docs += a[used].tolist()
        partners += [[]] * int(used.sum())
    at = np.array(rows, dtype=np.int64)
    return pd.DataFrame({"t1": t1[at], "t2": t2[at], "doc": pd.Series(docs, dtype="int64"), "partners": pd.Series(partners, dtype=object)})


def near_duplicates(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """``docs``: doc_id, text. Returns doc_id, n_shingles, component_id, kept, one row per row."""
    return labelled_rows(docs, percent, block).select("doc_id", "n_shingles", "component_id", "kept")


def _content(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def labelled_rows(docs: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """The columns of ``near_duplicates`` with content (a hash of the text) and vertex (the component's vertex; null for
    rows that aren't compared). A class's vertex is its smallest id, or a negative number made of its set's hashes where
    several classes share that id; such a component is named by its smallest id in the end."""
    prepare(docs.sparkSession)
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), _content(docs["text"]).alias("content"))
    signed = written(narrow.mapInArrow(_signatures, _SIGNED), "signatures")
    same = ["n_shingles", "sum", "xor"]
    classes = written(signed.filter("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(
        F.min(F.struct("doc_id", "content")).alias("least"), F.first("bands").alias("bands"), F.first("sig").alias("sig")).select(
        *same, F.col("least.doc_id").alias("named"), F.col("least.content").alias("content"), "bands", "sig"), "set-classes")
    classes = with_vertex(classes, *same)
    sigs = classes.select("rep", "sig")

    # buckets of two or more classes, and their members
    placed = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    buckets = placed.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("rep").alias("hub")).filter("size > 1")
    members = written(placed.join(buckets, ["band", "key"]), "bucket-members")
    involved = members.select(F.col("rep").alias("doc")).distinct().join(classes.select(F.col("rep").alias("doc"), F.col("named").alias("doc_id"), "content", "sum"), "doc")
    texts = narrow.join(involved, ["doc_id", "content"]).select("doc", "sum", F.coalesce("text", F.lit("")).alias("text"))
    sets = written(texts.mapInPandas(_full_sets, "doc long, same boolean, shingles binary").filter("same").select("doc", "shingles"), "shingle-sets")

    def confirm(rows: DataFrame, n: int) -> DataFrame:
        """``rows``: t1, t2 (the block), doc, partners; about ``n`` of them. Small blocks share a group."""
        groups = F.pmod(F.xxhash64("t1", "t2"), F.lit(max(1, n // block))).alias("group")
        return rows.join(sets, "doc").groupBy(groups).applyInPandas(lambda pdf: _confirmed(pdf, percent), "a long, b long")

    # all members against their bucket's hub
    limit = most_different(percent)
    pairs = members.filter("rep <> hub").select("hub", "rep").distinct()
    pairs = pairs.join(sigs, "rep").withColumnRenamed("sig", "sig_a").join(sigs.select(F.col("rep").alias("hub"), F.col("sig").alias("sig_b")), "hub")
    likely = written(pairs.filter(_different_lanes(F.col("sig_a"), F.col("sig_b")) <= limit).select("hub", "rep"), "hub-pairs")
    parts = likely.groupBy("hub").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    spread = likely.join(parts, "hub").select(F.col("hub").alias("t1"), F.pmod(F.xxhash64("rep"), F.col("parts")).cast("long").alias("t2"), F.col("rep").alias("doc"),
                                              F.array("hub").alias("partners"))
    hubs = parts.select(F.col("hub").alias("t1"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("t2"), F.col("hub").alias("doc"),
                        F.array().cast("array<long>").alias("partners"))
    n_likely = likely.count()
    found = connected_components(confirm(spread.unionByName(hubs), n_likely), 2 * n_likely)

    # strays: members outside their hub's component
    named = lambda of, to: found.select(F.col("id").alias(of), F.col("component").alias(to))
    labelled = members.join(named("rep", "c"), "rep", "left").withColumn("label", F.coalesce("c", "rep")).drop("c")
    labelled = labelled.join(named("hub", "c"), "hub", "left").withColumn("stray", F.col("label") != F.coalesce("c", "hub")).drop("c")
    labelled = written(labelled.select("band", "key", "size", "rep", "label", "stray"), "bucket-labels")
    open_ = labelled.groupBy("band", "key").agg(F.sum(F.col("stray").cast("int")).alias("strays")).filter("strays > 0")
    tried = labelled.join(open_, ["band", "key"]).join(sigs, "rep")
    rows_of = F.ceil(F.col("size") / block).cast("int")
    columns_of = F.ceil(F.col("strays") / block).cast("int")
    block_of = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    shape = ["band", "key", "rep", "label", "stray", "sig", "i", "j", "left", "whole"]
    tried = tried.withColumn("whole", F.col("size") <= block)
    lefts = tried.withColumn("i", block_of(rows_of)).withColumn("j", upto(columns_of)).withColumn("left", F.lit(True)).select(*shape)
    rights = tried.filter("stray").withColumn("j", block_of(columns_of)).withColumn("i", upto(rows_of)).withColumn("left", F.lit(False)).select(*shape)
    tiles = lefts.unionByName(rights).select(
        F.xxhash64("band", "key").alias("t1"), (F.col("i").cast("long") * (1 << 31) + F.col("j")).alias("t2"), "rep", "label", "stray", "sig", "left", "whole")
    # buckets of one block share groups, of about GROUP rows
    group = F.when(F.col("whole"), F.pmod(F.xxhash64("t1", "t2"), F.lit(max(1, labelled.count() // GROUP)))).otherwise(F.xxhash64("t1", "t2"))
    partners = tiles.groupBy("whole", group.alias("group")).applyInPandas(lambda pdf: _stray_partners(pdf, limit), "t1 long, t2 long, doc long, partners array<long>")
    partners = written(partners, "stray-partners")
    n_partners = partners.count()
    later = confirm(partners, n_partners)
    links = found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(later)
    components = connected_components(links, 4 * n_likely + n_partners)

    of_class = written(classes.select(*same, "rep", "named").join(components, F.col("rep") == F.col("id"), "left").select(
        *[F.col(c).alias(f"__{c}") for c in same], "named", F.coalesce("component", "rep").alias("vertex")), "class-components")
    of_class = with_component(of_class).drop("named")
    keyed = signed.select("doc_id", "content", *same)
    known = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    on = known & (F.col("n_shingles") == F.col("__n_shingles")) & (F.col("sum") == F.col("__sum")) & (F.col("xor") == F.col("__xor"))
    component = F.coalesce("component", "doc_id")
    return keyed.join(of_class, on, "left").select("doc_id", "content", "n_shingles", "vertex", component.alias("component_id"),
                                                   F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each component one row of the document with the smallest id, also where
    that id stands on rows of other components; of wordless rows of one id each text once; rows without an id stay."""
    kept = labelled_rows(docs, percent).filter("kept and doc_id is not null")
    wordless = F.when(F.col("vertex").isNull(), F.col("content"))
    kept = kept.groupBy(F.col("doc_id").alias("__kept"), "vertex", wordless.alias("wordless")).agg(F.min("content").alias("__content")).select("__kept", "__content").distinct()
    named = docs.join(kept, (docs["doc_id"].cast("long") == F.col("__kept")) & (_content(docs["text"]) == F.col("__content")))
    once = named.dropDuplicates(["__kept", "__content"]).drop("__kept", "__content")
    return once.unionByName(docs.filter(F.col("doc_id").isNull()))
