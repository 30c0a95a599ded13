"""Near-duplicate documents by one-permutation MinHash.

Plan, in the order in which data moves:

1. One Python pass makes a signature per document: every distinct shingle is hashed once, the
   top bits of its hash choose a bin, each bin keeps its smallest hash, and an empty bin takes
   the value of the first filled bin of its own fixed random order (optimal densification).
   Bands of consecutive bins become bucket keys.  Only ids and keys are written, no text.
2. Documents with the same shingle set collapse onto the smallest id by a map-side combined
   aggregate, so a group of copies is one node from here on, however large it is.
3. A bucket proposes a star: its members against one centre.  That is linear in its members.
   Proposals are verified on the whole shingle sets.
4. A star can miss a link between two members that are both unlike the centre.  Buckets whose
   members are still in several components therefore go on: a round with four further centres,
   then a last one that compares the members of different components which no star has
   compared.  So nothing is capped and no bucket emits the pairs of a connected group.  Both
   rounds first apply an exact bound: each set has a bitmap of the parities of its hashes, and
   the bits in which two bitmaps differ are at most the shingles in which the sets differ, so a
   pair with too many of them cannot reach the similarity and is never emitted.
5. Components come from alternating large-star and small-star steps on tables.

With 32 bands of 4 bins a pair at similarity 0.75 shares no bucket with probability 5e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import WordHashes, mix, shingle_set
from .storage import Workspace, held

THRESHOLD_PERCENT = 75
BINS_LOG2 = 7
ROWS_PER_BAND = 4
PARITY_BITS = 2048
#: Members of a bucket that are compared with each other at once.
BLOCK = 512
#: Salts of the further centres of a bucket in each round after the first; the empty last round
#: compares what is left.
MORE_CENTRES = ((1, 2, 3, 4), ())
_SIGNATURE = "row long, doc_id long, text_md5 string, text binary, n_shingles long, fp_hi long, fp_lo long, bands array<long>, parity array<long>"


def _bin_orders(n_bins: int) -> np.ndarray:
    """For each bin a fixed random order of all bins, for densification."""
    rng = np.random.default_rng(20170817)
    return np.stack([rng.permutation(n_bins) for _ in range(n_bins)])


def signature(shingles: np.ndarray, bins_log2: int, orders: np.ndarray) -> np.ndarray:
    """One-permutation MinHash with optimal densification of a sorted set of hashes."""
    n_bins = 1 << bins_log2
    shift = np.uint64(64 - bins_log2)
    at = np.searchsorted(shingles, np.arange(n_bins, dtype=np.uint64) << shift)
    value = shingles[np.minimum(at, len(shingles) - 1)]
    filled = (value >> shift) == np.arange(n_bins, dtype=np.uint64)
    filled &= at < len(shingles)
    empty = np.flatnonzero(~filled)
    if len(empty):
        donor = orders[empty, filled[orders[empty]].argmax(axis=1)]
        value[empty] = value[donor]
    return value


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A key per band; the band's number is part of the key."""
    parts = sig.reshape(-1, rows)
    key = np.arange(len(parts), dtype=np.uint64)
    for i in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, i])
    return key


def parities(shingles: np.ndarray) -> np.ndarray:
    """A bitmap, as 64-bit words: whether an odd number of hashes falls on each bit."""
    n = np.bincount((shingles & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS)
    return np.packbits((n & 1).astype(bool)).view(np.int64)


def _may_reach(percent: int) -> F.Column:
    """False only if the sets of sizes n and cn cannot reach the similarity.

    A similarity of at least p % means that the sets differ in at most (n + cn)(100-p)/(100+p).
    """
    differ = sum((F.bit_count(F.expr(f"parity[{i}] ^ cparity[{i}]")) for i in range(PARITY_BITS // 64)), F.lit(0))
    return F.lit(100 + percent) * differ <= F.lit(100 - percent) * (F.col("n") + F.col("cn"))


def _signatures(bins_log2: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, orders = held("words", WordHashes), _bin_orders(1 << bins_log2)
        n_bands = (1 << bins_log2) // rows
        for batch in batches:
            sizes, hi, lo, bands, parity, ends = [], [], [], [], [], [0]
            for text in batch.column(3).to_pylist():
                s = shingle_set(text, memo)
                sizes.append(len(s))
                if len(s):
                    d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                    bands.append(band_keys(signature(s, bins_log2, orders), rows).view(np.int64))
                    parity.append(parities(s))
                    hi.append(int(d[0]))
                    lo.append(int(d[1]))
                else:
                    hi.append(None)
                    lo.append(None)
                ends.append(ends[-1] + bool(len(s)))
            lists = lambda parts, n: pa.ListArray.from_arrays(pa.array(np.array(ends) * n, pa.int32()), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), lists(bands, n_bands), lists(parity, PARITY_BITS // 64)],
                names=["row", "doc_id", "text_md5", "text", "n_shingles", "fp_hi", "fp_lo", "bands", "parity"],
            )

    return run


def _alike(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, last, kept = held("words", WordHashes), None, None
        for batch in batches:
            a, b = [], []
            for ida, idb, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last is None or ta != last:
                    last, kept = ta, shingle_set(ta, memo)
                other = shingle_set(tb, memo)
                both = len(np.intersect1d(kept, other, assume_unique=True))
                if 100 * both >= percent * (len(kept) + len(other) - both) and both:
                    a.append(ida)
                    b.append(idb)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _near(percent: int):
    """Pairs of different components within runs of equal (key, low, high) that may be similar."""

    def pairs(rep, comp, n, side, words, crossed):
        for i in range(0, len(rep), 64):
            k = slice(i, i + 64)
            differ = np.bitwise_count(words[k, None, :] ^ words[None, :, :]).sum(axis=2, dtype=np.int64)
            fit = ((100 + percent) * differ <= (100 - percent) * (n[k, None] + n[None, :])) & (comp[k, None] != comp[None, :]) & (rep[k, None] < rep[None, :])
            if crossed:
                fit &= side[k, None] != side[None, :]
            yield from zip(rep[k][(at := np.nonzero(fit))[0]], rep[at[1]], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _with_end(batches):
            if batch is not None:
                table = pa.Table.from_batches([batch])
                rest = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            if rest is None or not len(rest):
                continue
            key, low, high, rep, comp, n, side = (rest.column(i).to_numpy() for i in range(7))
            words = rest.column(7).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(rest), -1)
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            ends = [*cuts, len(rest)] if batch is None else [*cuts]
            found, start = [], 0
            for end in ends:
                if end - start > 1:
                    k = slice(start, end)
                    found += pairs(rep[k], comp[k], n[k], side[k], words[k], low[start] != high[start])
                start = end
            rest = rest.slice(start)
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _across(open_: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of different components in a bucket which the parity bound lets through.

    Members of one component need no comparison.  The largest component of a bucket only meets the
    rest of the bucket, and the rest meets itself.  Each side is dealt into blocks of about BLOCK
    members and two blocks meet in one run of rows, so a large bucket spreads over many tasks, no
    task holds more than two blocks, and a large component with few outsiders gives few rows.
    """
    size = open_.groupBy("key", "component").agg(F.count("*").alias("m"))
    top = size.groupBy("key").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("all"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("long")
    top = top.select("key", F.col("top.component").alias("main"), blocks(F.col("top.m")).alias("mains"), blocks(F.col("all") - F.col("top.m")).alias("rests"))
    sized = open_.select("key", "rep", "component", "n", "parity").join(top, "key").withColumn("is_main", F.col("component") == F.col("main"))
    dealt = sized.withColumn("side", F.pmod(F.xxhash64("rep"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("rests"))))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    # a run is (low, high): two blocks of the rest, or a block of the main component, counted below zero, and one of the rest
    met = lambda low, high, side: F.struct(low.alias("low"), high.alias("high"), side.alias("side"))
    side = F.col("side")
    with_rest = F.transform(upto(F.col("rests")), lambda o: met(F.least(side, o), F.greatest(side, o), side))
    with_main = F.transform(upto(F.col("mains")), lambda o: met(-1 - o, side, side))
    as_main = F.transform(upto(F.col("rests")), lambda o: met(-1 - side, o, -1 - side))
    dealt = dealt.withColumn("run", F.explode(F.when(F.col("is_main"), as_main).otherwise(F.concat(with_rest, with_main))))
    dealt = dealt.select("key", "run.low", "run.high", "rep", "component", "n", "run.side", "parity")
    return dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(_near(percent), "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets reach the similarity.

    The member's text goes to the pair first and the pair then to its centre, so a centre with
    very many members is a skewed join side, which adaptive execution splits.
    """
    of = lambda k: texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_alike(percent), "a long, b long")


def components(edges: DataFrame, ws: Workspace, label: str) -> DataFrame:
    """(id, component): the smallest id reachable, for every id of an edge (a, b).

    Alternating large-star and small-star steps; each is a map-side combined minimum and a join
    on the node, written to the shared folder.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = ws.write(e, f"{label}-0")
    state, step = None, 0
    while True:
        step += 1
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = ws.write(small.where("u <> v").distinct(), f"{label}-{step}")
        now = new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 40)))).first()
        ws.delete(f"{label}-{step - 1}")
        e = new
        if tuple(now) == state:
            break
        state = tuple(now)
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())


def _placed(docs: DataFrame, percent: int, bins_log2: int, rows: int) -> DataFrame:
    """One row per row: row, doc_id, text_md5, n_shingles, component (its smallest row's node, null
    without links and copies), component_id and n_links."""
    spark = docs.sparkSession
    ws = Workspace(spark, "minhash")
    text = F.col("text").cast("binary")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.md5("text").alias("text_md5"), "text")
    # rows are numbered, and texts stored with their numbers, so a row is a node whatever its id
    sig = ws.write(texts.mapInArrow(_signatures(bins_log2, rows), _SIGNATURE), "signatures")
    sets = ws.write(
        sig.where("doc_id is not null and fp_hi is not null").groupBy("fp_hi", "fp_lo").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least_id"), F.min_by(F.struct("bands", "parity", F.col("n_shingles").alias("n")), "row").alias("x"), F.count("*").alias("copies")).select("fp_hi", "fp_lo", "rep", "least_id", "copies", "x.*"),
        "sets",
    )

    # members of buckets with at least two different texts; a rep has one row for each band
    member = sets.select("rep", F.explode("bands").alias("key"))
    shared = member.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("key")
    buckets = ws.write(member.join(shared, "key"), "buckets")

    # round 1: a star around the member that comes first in one random order of all documents
    order = lambda salt: F.xxhash64("rep", F.lit(salt))
    centre = buckets.groupBy("key").agg(F.min_by("rep", order(0)).alias("centre"))
    tried = ws.write(buckets.join(centre, "key").where("rep <> centre").select(F.least("centre", "rep").alias("a"), F.greatest("centre", "rep").alias("b")).distinct(), "pairs-1")
    named = sig.select(F.col("row").alias("doc_id"), "text")
    links = ws.write(verified(tried, named, percent), "links-1")
    comp = components(links, ws, "cc-1")
    for n, salts in enumerate(MORE_CENTRES, 2):
        # buckets that still hold several components; a rep without links is its own
        placed = buckets.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
        split = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
        open_ = ws.write(placed.join(split, "key").join(sets.select("rep", "n", "parity"), "rep"), f"open-{n}")
        centres = open_.select("key", F.col("rep").alias("a"), F.col("component").alias("ca"), F.col("n").alias("cn"), F.col("parity").alias("cparity"))
        if salts:
            first = open_.groupBy("key").agg(F.array_distinct(F.array(*(F.min_by("rep", order(s)) for s in salts))).alias("a"))
            centres = centres.join(first.select("key", F.explode("a").alias("a")), ["key", "a"])
            new = open_.join(centres, "key").where((F.col("component") != F.col("ca")) & _may_reach(percent)).select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct()
        else:
            new = _across(open_, percent).distinct()
        new = ws.write(new.join(tried, ["a", "b"], "left_anti"), f"pairs-{n}")
        found = ws.write(verified(new, named, percent), f"links-{n}")
        if not found.isEmpty():
            comp = components(comp.select(F.col("id").alias("a"), F.col("component").alias("b")).union(found), ws, f"cc-{n}")
        links, tried = links.union(found), tried.union(new)

    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    # only sets with copies or links differ from themselves
    moved = sets.select("fp_hi", "fp_lo", "rep", "least_id", "copies").join(comp.withColumnRenamed("id", "rep"), "rep", "left").join(degree, "rep", "left")
    moved = moved.where("copies > 1 or component is not null").select("fp_hi", "fp_lo", F.coalesce("component", "rep").alias("component"), "least_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    moved = ws.write(moved, "moved")
    # the smallest id, which is not always that of the smallest row
    least = moved.groupBy("component").agg(F.min("least_id").alias("component_id"))
    moved = moved.drop("least_id").join(least, "component")
    return sig.select("row", "doc_id", "text_md5", "n_shingles", "fp_hi", "fp_lo").join(moved, ["fp_hi", "fp_lo"], "left").select(
        "row", "doc_id", "text_md5", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).alias("n_links"),
    )


def near_duplicates(docs: DataFrame, percent: int = THRESHOLD_PERCENT, bins_log2: int = BINS_LOG2, rows: int = ROWS_PER_BAND) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, n_links.

    ``docs`` needs doc_id and text; other columns are ignored.  ``n_links`` counts the verified
    links of the document's representative that the search has used; copies carry it too.

    Defined results: a row is a document.  A null or wordless text has no shingle, is linked with
    nothing and is kept.  A row without doc_id is linked with nothing, has a null component and is
    kept.  Rows that repeat a doc_id are linked by their texts alone: with the same text they share
    all results, with unlike texts each has its own component.  An empty table gives no rows.
    """
    placed = _placed(docs, percent, bins_log2, rows)
    return placed.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "n_links")


#: Rows that are broadcast at most to leave documents out; more are joined by hash.
BROADCAST_IDS = 500_000


def representatives(docs: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, with all columns.

    The row with the smallest doc_id stays; among texts that share this id, the one with the
    smallest digest.  Rows that repeat both doc_id and text count as one document, too; rows
    without doc_id stay.  A text that is like no other is never left out, whatever ids it shares.
    """
    ws = Workspace(docs.sparkSession, "minhash-kept")
    mine, digest, best = "_glyphlake_minhash_id", "_glyphlake_minhash_md5", "_glyphlake_minhash_best"  # names that no table has
    found = ws.write(_placed(docs, percent, BINS_LOG2, ROWS_PER_BAND).where("doc_id is not null").select(F.col("doc_id").alias(mine), F.col("text_md5").alias(digest), "component", "component_id"), "kept")
    # ids that stand on several rows; of those that lead a component one text is chosen
    again = ws.write(found.groupBy(mine).count().where("count > 1").select(mine), "again")
    repeated = not again.isEmpty()
    gone = found.where(F.col(mine) != F.col("component_id"))
    if repeated:
        several = found.where(F.col("component").isNotNull() & (F.col(mine) == F.col("component_id"))).join(again, mine, "left_semi")
        first = several.groupBy("component").agg(F.min(digest).alias(best))
        gone = gone.select(mine, digest).union(several.join(first, "component").where(F.col(digest) != F.col(best)).select(mine, digest))
    gone = ws.write(gone.select(mine, digest).distinct(), "gone")
    same = F.col("doc_id").cast("long") == F.col(mine)
    left = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, same & F.md5(F.col("text").cast("binary")).eqNullSafe(F.col(digest)), "left_anti")
    if not repeated:
        return left
    once = left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, same, "left_anti").unionByName(once)
