"""Near-duplicate groups by MinHash bands, sequential Bayesian pruning and exact verification.

1. Texts with the same word sequence are one class; its smallest id stands for it.
2. Representatives get a MinHash signature, cut into bands; equal bands share a bucket.
3. In each bucket every member is compared with two hubs (the smallest id, and the member that
   shares most buckets), never with every other member. Signatures are compared a batch at a
   time: a pair goes as soon as the posterior chance that its similarity reaches the threshold falls
   under ``miss``. Survivors are verified on their full shingle sets.
4. Links give components. Buckets that still hold several components form families, and there an
   exact join finds the links across components (``links_across``). It compares a family's
   sets by what sets them apart from the shingles that most of the family shares, so that
   a thousand loose variants of one text don't make a million pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from . import common
from .components import connected_components
from .substring_index import starts_ok, windows_of, word_hashes

#: Bands times rows are the hashes of a signature: a pair at similarity 0.75 misses all 32 bands of 4 with chance 5e-6.
BANDS, ROWS = 32, 4
#: Hashes compared before each pruning decision.
BATCH = 16
SLICE_BYTES = 1 << 20
#: A family of so many members is dealt into so many parts; so many families' numbers are broadcast (16 bytes each).
LARGE_FAMILY, PARTS, MOST_LARGE = 500, 64, 200_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Row and hash of each row's distinct shingles, ordered by row and hash; the 128-bit key of its word sequence."""
    low = np.frombuffer(data.tobytes().lower(), np.uint8)
    rows, row, h = word_hashes(low, offsets)
    counts = np.array([len(r) for r in rows], np.int64)
    at = np.flatnonzero(starts_ok(counts, size))
    s, of = windows_of(h, size)[at], row[at]
    short = np.flatnonzero((counts > 0) & (counts < size))
    joined = [b" ".join(r) for r in rows]
    s = np.concatenate([s, np.array([xxh3_64_intdigest(joined[i], len(rows[i])) for i in short], np.uint64)])
    of = np.concatenate([of, short])
    order = np.lexsort((s, of))
    s, of = s[order], of[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (of[1:] != of[:-1])]) if len(s) else np.zeros(0, bool)
    return of[new], s[new], [xxh3_128_digest(x) for x in joined]


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1 << 31, dtype=np.uint32, size=n) * np.uint32(2) + np.uint32(1), rng.integers(1 << 32, dtype=np.uint32, size=n)


def _signatures(of: np.ndarray, s: np.ndarray, n: int, hashes: int) -> np.ndarray:
    """Rows x hashes; rows without shingles are zero."""
    out = np.zeros((n, hashes), np.uint32)
    if len(s):
        x = (s >> np.uint64(32)).astype(np.uint32)
        has, start = np.unique(of, return_index=True)
        for i, (a, b) in enumerate(zip(*_permutations(hashes), strict=True)):
            out[has, i] = np.minimum.reduceat(x * a + b, start)
    return out


def _describe(size: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release_caches()
        for batch in batches:
            data, offsets = common.text_buffers(batch.column(1))
            for lo, hi in common.slices(offsets, SLICE_BYTES):
                part = offsets[lo : hi + 1]
                of, s, keys = shingle_sets(data[part[0] : part[-1]], part - part[0], size)
                sig = _signatures(of, s, hi - lo, hashes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.bincount(of, minlength=hi - lo), pa.int64()), pa.array(keys, pa.binary()), pa.array([r.tobytes() for r in sig], pa.binary())],
                    ["id", "n_shingles", "words_key", "signature"],
                )

    return run


def _bands(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(11)
        mult = rng.integers(1 << 62, dtype=np.uint64, size=(bands, rows)) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, bands, rows).astype(np.uint64)
            key = ((sig + np.uint64(1)) * mult).sum(2, dtype=np.uint64)
            key ^= key >> np.uint64(29)
            key = key * np.uint64(0xBF58476D1CE4E5B9) + np.arange(bands, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), bands))], ["band", "id"])

    return run


def least_matches(hashes: int, threshold: float, miss: float) -> np.ndarray:
    """For each count of compared hashes the fewest matches that keep a pair.

    With a uniform prior the posterior chance of similarity >= t after m matches of n is
    P(Binomial(n + 1, t) <= m).
    """
    out = np.zeros(hashes + 1, np.int64)
    for n in range(1, hashes + 1):
        total = 0.0
        for m in range(n + 2):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                out[n] = m
                break
    return out


def _prune(hashes: int, threshold: float, miss: float):
    least = least_matches(hashes, threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(batch.num_rows, hashes) for k in (2, 3))
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for lo in range(0, hashes, BATCH):
                hi = min(lo + BATCH, hashes)
                matches[alive] += (left[alive, lo:hi] == right[alive, lo:hi]).sum(1)
                alive = alive[matches[alive] >= least[hi]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive))], ["a", "b"])

    return run




def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = int(common.contains(q, p).sum())
                keep[i] = 100 * both >= percent * (len(p) + len(q) - both)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shingle of a set."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            raws = part.column("shingles").to_pylist()
            n = [len(x) // 8 for x in raws]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(k).to_numpy(), n)) for k in ("family", "salt", "node")] + [pa.array(np.frombuffer(b"".join(raws), np.int64))], ["family", "salt", "node", "shingle"])


def links_across(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links and candidate pairs between components of a family (columns node, c, family), exactly all of them.

    Let C be the shingles of more than half of a family, m(x) how many of them x lacks, and D(x) what x lacks of C or
    has beyond it. Two sets share |C| - m(x) - m(y) + |D(x) & D(y)| shingles, so that they reach the similarity
    where (100 + percent) * |D(x) & D(y)| >= F(x) + F(y), with F(x) = percent * |x| + (100 + percent) * (m(x) - |C| / 2).

    Pairs with F(x) + F(y) <= 0 are links whatever they share, and all of them are joined through the member with the
    least F: the first result. For any other pair the first element that D(x) and D(y) share, in one order for all,
    is among the first of both, as many as leave less than the overlap that either needs at least; and what
    the two lack and have beyond C bounds what they can share. Pairs of different components that pass
    are the second result, to be verified.
    """
    q = 100 + percent
    size = members.groupBy("family").agg(F.count("*").alias("members"))
    # a large family is dealt into parts by node; what all its members are compared with is copied to each part
    large = size.where(F.col("members") >= LARGE_FAMILY).select("family", F.lit(PARTS).alias("parts"))
    large = F.broadcast(large) if large.limit(MOST_LARGE + 1).count() <= MOST_LARGE else large
    of_family = lambda df: df.join(large, "family", "left").na.fill(1, ["parts"])
    copied = lambda df: of_family(df).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))).drop("parts")
    members = of_family(members).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("parts").cast("long"))).drop("parts")
    part = ["family", "salt"]
    rows = members.join(sets, "node").select(*part, "node", "shingles").mapInArrow(_exploded, "family long, salt long, node long, shingle long")
    counted = rows.groupBy("family", "shingle").agg(F.count("*").alias("k"))
    few = size.limit(MOST_LARGE + 1).count() <= MOST_LARGE
    common_ones = counted.join(F.broadcast(size) if few else size, "family").where("2 * k > members").select("family", "shingle")
    held = common.stored(rows.join(copied(common_ones).withColumn("in_core", F.lit(1)), [*part, "shingle"], "left"), "family-shingles")
    # no more than half the members lack one of these, so that a core is no longer than twice the mean set
    cores = copied(common_ones.groupBy("family").agg(F.collect_list("shingle").alias("core_set")))
    sizes = held.groupBy(*part, "node").agg(F.count("*").alias("n"), F.count("in_core").alias("k"), F.collect_list(F.when(F.col("in_core") == 1, F.col("shingle"))).alias("mine"))
    f = sizes.join(cores, part, "left").withColumn("core", F.coalesce(F.size("core_set"), F.lit(0))).withColumn("lacks", F.col("core") - F.col("k"))
    f = f.withColumn("lacking", F.when(F.col("lacks") > 0, F.array_except("core_set", "mine"))).drop("core_set", "mine")
    f = common.stored(f.withColumn("f2", 2 * percent * F.col("n") + 2 * q * F.col("lacks") - q * F.col("core")), "family-sizes")
    least = f.groupBy("family").agg(F.min(F.struct("f2", "node")).alias("l")).select("family", F.col("l.f2").alias("least_f2"), F.col("l.node").alias("least"))
    scored = common.stored(f.join(copied(least), part).join(members, [*part, "node"]), "family-scores")
    near = scored.where("f2 + least_f2 <= 0 and node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    # those joined to the least member by the first result are one component from here on
    joined = F.when(F.col("f2") + F.col("least_f2") <= 0, F.lit(True)).otherwise(F.lit(False))
    loose = scored.withColumn("joined", joined).withColumn("need", F.greatest(F.ceil((F.col("f2") + F.col("least_f2")) / (2 * q)), F.lit(1)))
    beyond = held.where("in_core is null").select("family", "node", "shingle", F.lit(1).alias("sign"))
    lacking = scored.where("lacks > 0").select("family", "node", F.explode("lacking").alias("shingle"), F.lit(-1).alias("sign"))
    apart = common.stored(beyond.unionByName(lacking), "family-apart")
    element = ["family", "shingle", "sign"]
    often = apart.groupBy(*element).agg(F.count("*").alias("often")).where("often > 1")
    ordered = apart.join(often, element, "left").na.fill(1, ["often"]).join(loose.select("family", "node", "c", "joined", "need", "f2", "lacks", (F.col("n") - F.col("k")).alias("extra"), (F.col("n") - F.col("k") + F.col("lacks")).alias("d")), ["family", "node"])
    # what is beyond C comes first, then by rarity: elements of one node alone lead, and can't be shared
    place = F.row_number().over(Window.partitionBy("family", "node").orderBy(F.col("sign").desc(), "often", "shingle"))
    prefix = ordered.withColumn("place", place).where("place <= d - need + 1 and often > 1").select(*element, "node", "c", "joined", "f2", "lacks", "extra")
    left, right = (prefix.select(*element, *(F.col(k).alias(k + x) for k in ("node", "c", "joined", "f2", "lacks", "extra"))) for x in "12")
    # a pair whose first common element is a lack has nothing in common beyond C
    most = F.least("lacks1", "lacks2") + F.when(F.col("sign") > 0, F.least("extra1", "extra2")).otherwise(0)
    across = (F.col("node1") < F.col("node2")) & (F.col("c1") != F.col("c2")) & ~(F.col("joined1") & F.col("joined2"))
    pairs = left.join(right, element).where(across & (2 * q * most >= F.col("f21") + F.col("f22"))).select(F.col("node1").alias("a"), F.col("node2").alias("b")).distinct()
    return near, pairs


def near_duplicate_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, shingle: int = 5, bands: int = BANDS, rows: int = ROWS, miss: float = 1e-7) -> DataFrame:
    """One row for each input row: the id, ``n_shingles``, ``component_id`` and ``kept``.

    A document's set holds its distinct ``shingle``-word shingles (ASCII letters lower-cased); with fewer
    words, the whole sequence. Two documents are linked where the sets' Jaccard similarity reaches ``percent``
    per cent; ``component_id`` is the smallest id reachable, and ``kept`` marks it. ``miss`` is the posterior
    chance under which a candidate is given up unverified.

    Texts without a word (null, empty, blank) have no shingle, are linked with nothing and are kept. A null
    id has a null component and is kept. Rows with equal ids share their fate. An empty table gives an
    empty result.
    """
    with common.Scope() as scope:
        described, of_key = _groups(docs, id_col, text_col, percent, shingle, bands, rows, miss)
    scope.drop(docs.sparkSession, but=(described, of_key))
    out = described.join(of_key, "words_key", "left").withColumn("component_id", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _groups(docs: DataFrame, id_col: str, text_col: str, percent: int, shingle: int, bands: int, rows: int, miss: float) -> tuple[DataFrame, DataFrame]:
    """Every row with its size and key, and the component of each key: both stored."""
    hashes, threshold = bands * rows, percent / 100
    kind = docs.schema[id_col].dataType
    text = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    described = common.stored(text.mapInArrow(_describe(shingle, hashes), T.StructType([T.StructField("id", kind), T.StructField("n_shingles", T.LongType()), T.StructField("words_key", T.BinaryType()), T.StructField("signature", T.BinaryType())])), "signatures")
    usable = described.where("n_shingles > 0 and id is not null")
    classes = usable.groupBy("words_key").agg(F.min("id").alias("rep"))
    # repeated rows of one id may differ in text: each (id, word sequence) is a class of its own, tied by the id
    reps = usable.join(classes.withColumnRenamed("rep", "id"), ["words_key", "id"], "left_semi").dropDuplicates(["words_key"])
    reps = common.stored(reps.withColumn("node", F.xxhash64("words_key")).select("node", "id", "n_shingles", "words_key", "signature"), "representatives")
    signatures = reps.select("node", "signature")
    buckets = reps.select("node", "signature").mapInArrow(_bands(bands, rows), "band long, id long")
    shared = buckets.groupBy("band").agg(F.count("*").alias("c"), F.min("id").alias("lo")).where("c > 1")
    members = common.stored(buckets.join(shared, "band").select("band", "id", "c", "lo"), "bands")

    def prune(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(signatures.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a")
        with_b = with_a.join(signatures.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b")
        return with_b.select("a", "b", "sa", "sb").mapInArrow(_prune(hashes, threshold, miss), "a long, b long")

    def sets_of(nodes: DataFrame, name: str) -> DataFrame:
        wanted = nodes.select("node").distinct().join(reps.select("node", "id"), "node")
        # the text of a node is that of any row with its word sequence; its id brings few rows more
        found = text.join(wanted.select("id").distinct(), "id", "left_semi").mapInArrow(_keyed_sets(shingle), "node long, shingles binary").dropDuplicates(["node"])
        return common.stored(found, name)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        survivors = common.stored(prune(pairs), name + "-survivors")
        sets = sets_of(survivors.select(F.col("a").alias("node")).union(survivors.select(F.col("b").alias("node"))), name + "-sets")
        full = survivors.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("pa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("pb")), "b")
        return full.select("a", "b", "pa", "pb").mapInArrow(_verify(percent), "a long, b long")

    weight = members.groupBy("id").agg(F.sum("c").alias("weight"))
    centres = members.join(weight, "id").groupBy("band").agg(F.max(F.struct("weight", "id")).alias("centre")).select("band", F.col("centre.id").alias("hub"))
    hubs = members.join(centres, "band").select("id", F.explode(F.array("lo", "hub")).alias("other")).where("id <> other").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    links = common.stored(verified(hubs, "hub"), "links")
    same_id = reps.groupBy("id").agg(F.min("node").alias("b"), F.count("*").alias("c")).where("c > 1").select("id", "b").join(reps.select("id", F.col("node").alias("a")), "id").where("a <> b").select("a", "b")
    found = connected_components(links.unionByName(same_id))
    placed = members.join(found.withColumnRenamed("node", "id"), "id", "left").select("band", "id", F.coalesce("component", "id").alias("c"))
    mixed = placed.groupBy("band").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.min("id").alias("first")).where("x <> y").select("band", "first")
    still = common.stored(placed.join(mixed, "band"), "open-bands")
    family = connected_components(still.select(F.col("id").alias("a"), F.col("first").alias("b")))
    in_family = common.stored(still.select("id", "c").distinct().join(family.withColumnRenamed("node", "id"), "id", "left").select(F.col("id").alias("node"), "c", F.coalesce("component", "id").alias("family")), "families")
    near, pairs = links_across(in_family, sets_of(in_family, "family-sets"), percent)
    more = common.stored(near.unionByName(verified(pairs, "across")), "links")
    found = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    groups = reps.select("node", "id", "words_key").join(found, "node", "left").withColumn("group", F.coalesce("component", "node"))
    least = groups.groupBy("group").agg(F.min("id").alias("component_id"))
    return described, common.stored(groups.join(least, "group").select("words_key", "component_id"), "components")


def _keyed_sets(size: int):
    """Shingle sets by node, the hash that Spark's xxhash64 gives the key of the word sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            data, offsets = common.text_buffers(batch.column(1))
            for lo, hi in common.slices(offsets, SLICE_BYTES):
                part = offsets[lo : hi + 1]
                of, s, keys = shingle_sets(data[part[0] : part[-1]], part - part[0], size)
                cut = np.searchsorted(of, np.arange(hi - lo + 1))
                node = np.array([xxh64_intdigest(k, 42) for k in keys], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([s[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["node", "shingles"])

    return run
