"""Quality rules whose thresholds follow the corpus: quantile sketches per language and source.

DataFrame operations only.  One pass over the whole texts makes a narrow table of counts.  Each
rate gets a mergeable sketch for every (language, source): the numbers of documents in buckets
whose bounds grow by GAMMA, so a quantile is off by half of that at most.  Adding up the buckets of a
language's sources gives the language's sketch, and all of them the corpus's.  A rate is out of line
beyond the outer fence of its group, by quartiles or, for repetition, the 0.99 quantile, where a
group with few documents borrows its language's fence and that, if small, the corpus's.  The fences,
one row for each group, are joined back.

The sketches summarise every document and have no random part, so runs agree.  A hot source is
combined map-side like any other group; a sketch has some thousand buckets, whatever it holds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Workspace

# Fixed values of the contract.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"

SPACE = " \t\n\x0b\x0c\r"
_SPACES = r"[ \t-\r]+"
#: Distance of a fence from its quantile, in ranges between the two quantiles.
FENCE = 3.0
#: Documents below which a group borrows the fences one level up.
MIN_GROUP = 200
#: Ratio of a bucket's bounds; a quantile is within 0.5 % of the value.
GAMMA = 1.01
#: The bucket of 0, below all others.
_ZERO = -(1 << 30)
#: rate -> (upper quantile, share of FENCE, least range, whether low values are out of line too).
#: Repetition is 0 in most documents and spread thinly above it, so its fences follow the 0.99
#: quantile.  The least range only counts where the group's own range is about 0.
RATES = {"word_length": (0.75, 1.0, 0.1, True), "symbol_rate": (0.75, 1.0, 0.01, False), "dup_line_rate": (0.99, 0.5, 0.01, False), "repeat_rate": (0.99, 0.5, 0.01, False)}
#: Fences are broadcast up to so many groups, about 10 MB; beyond that they are joined by key.
BROADCAST_GROUPS = 50_000
#: Windows of a text that are sorted with their positions packed into the low bits.
_PACK_BITS = 20


def _repeat_positions(h: str) -> dict[str, Column]:
    """Steps that find the starts of windows which occur twice or more; ``h`` holds their hashes.

    Hashes are sorted with the position in their low bits, which is a plain sort of longs.
    Neighbours that agree in the high bits are compared in full; where they differ after all, or
    the text is too long to pack, the pairs of hash and position are sorted instead.
    """
    mask = (1 << _PACK_BITS) - 1
    high = lambda v: F.shiftright(v, _PACK_BITS)
    at = lambda v: v.bitwiseAND(F.lit(mask)).cast("int")
    hashes, packed, ties, pairs = F.col(h), F.col("packed"), F.col("ties"), F.col("pairs")
    code = lambda v, j: F.when((j == 0) | (high(v) != high(F.get(packed, j - 1))), F.lit(0)).when(F.get(hashes, at(v)) == F.get(hashes, at(F.get(packed, j - 1))), F.lit(1)).otherwise(F.lit(2))
    tied = lambda j: (F.get(ties, j) == 1) | F.coalesce(F.get(ties, j + 1) == 1, F.lit(False))
    same = lambda j, k: F.coalesce(F.get(pairs, j)["h"] == F.get(pairs, k)["h"], F.lit(False))
    loose = F.array_contains(ties, 2) | (F.size(hashes) > mask)
    return {
        "packed": F.sort_array(F.transform(hashes, lambda x, i: x.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))),
        "ties": F.transform(packed, code),
        "pairs": F.when(loose, F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))),
        "starts": F.sort_array(
            F.when(loose, F.filter(F.transform(pairs, lambda v, j: F.when((j > 0) & same(j, j - 1) | same(j, j + 1), v["i"]).otherwise(F.lit(-1))), lambda p: p >= 0)).otherwise(
                F.filter(F.transform(packed, lambda v, j: F.when(tied(j), at(v)).otherwise(F.lit(-1))), lambda p: p >= 0)
            )
        ),
    }


def counted(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the counts of its whole texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(*keep, text.alias("t"))
    trimmed = F.btrim("t", F.lit(SPACE))
    df = df.select(*keep, "t", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACES)).alias("words"))
    df = df.select(*keep, "t", F.size("words").cast("long").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("hw"))
    hw = F.col("hw")
    windows = F.when(F.size(hw) >= 3, F.transform(F.slice(hw, F.lit(1), F.size(hw) - 2), lambda x, i: F.xxhash64(x, F.get(hw, i + 1), F.get(hw, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    df = df.select(*keep, "t", "n_words", windows.alias("h"))
    names = [*keep, "t", "n_words", "h"]
    for name, step in _repeat_positions("h").items():
        df = df.select(*names, step.alias(name))
        names.append(name)
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    covered = F.aggregate("starts", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end")))
    df = df.select(*keep, "t", "n_words", covered["n"].cast("long").alias("n_repeat_words"), lines.alias("lines"))
    return df.select(
        *keep,
        "n_words",
        F.char_length(F.translate("t", SPACE, "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("lines").cast("long").alias("n_lines"),
    )


def _rates() -> dict[str, Column]:
    of = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {"word_length": of("word_chars", "n_words"), "symbol_rate": of("n_symbols", "n_words"), "dup_line_rate": of("n_dup_lines", "n_lines"), "repeat_rate": of("n_repeat_words", "n_words")}


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _level(name: str) -> Column:
    """A group key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("-"))


def _sketches(rates: DataFrame) -> DataFrame:
    """(g_lang, g_source, rate, bucket, n) of rows (g_lang, g_source, and a column for each rate)."""
    bucket = lambda v: F.when(v > 0, F.ceil(F.log(v) / F.lit(math.log(GAMMA))).cast("int")).otherwise(F.lit(_ZERO))
    placed = rates.select("g_lang", "g_source", F.inline(F.array(*(F.struct(F.lit(n).alias("rate"), bucket(F.col(n)).alias("bucket")) for n in RATES))))
    return placed.groupBy("g_lang", "g_source", "rate", "bucket").agg(F.count("*").alias("n"))


def _bounds(sketch: DataFrame, level: str, fence: float, *keys: str) -> DataFrame:
    """The keys and a struct ``level`` of n and the fences of each rate."""
    of = Window.partitionBy(*keys, "rate")
    ranked = sketch.withColumn("all", F.sum("n").over(of)).withColumn("upto", F.sum("n").over(of.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    value = lambda k: F.when(k == _ZERO, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), k) * (2 / (1 + GAMMA)))
    found = [F.max("all").alias("n")]
    for n, (upper, share, least, two_sided) in RATES.items():
        low, high = (value(F.min(F.when((F.col("rate") == n) & (F.col("upto") > p * (F.col("all") - 1)), F.col("bucket")))) for p in (1 - upper, upper))
        reach = F.lit(fence * share) * F.greatest(high - low, F.lit(least))
        found.append(F.struct((low - reach if two_sided else F.lit(None).cast("double")).alias("low"), (high + reach).alias("high")).alias(n))
    return ranked.groupBy(*keys).agg(*found).select(*keys, F.struct("n", *RATES).alias(level))


def fences(counts: DataFrame, fence: float = FENCE, min_group: int = MIN_GROUP) -> DataFrame:
    """One row for each (g_lang, g_source): n_group and for each rate its low and high fence."""
    rates = counts.where(~_failed()).select(_level("lang").alias("g_lang"), _level("source").alias("g_source"), *(c.alias(n) for n, c in _rates().items()))
    group = _sketches(rates)
    lang = group.groupBy("g_lang", "rate", "bucket").agg(F.sum("n").alias("n"))
    whole = lang.groupBy(F.lit(0).alias("one"), "rate", "bucket").agg(F.sum("n").alias("n"))
    # every group has its language, and there is one row of the whole; at most as many rows as languages
    up = F.broadcast(_bounds(lang, "l", fence, "g_lang").withColumn("one", F.lit(0)).join(F.broadcast(_bounds(whole, "w", fence, "one")), "one").drop("one"))
    both = _bounds(group, "g", fence, "g_lang", "g_source").join(up, "g_lang")
    pick = lambda n: F.when(F.col("g.n") >= min_group, F.col(f"g.{n}")).when(F.col("l.n") >= min_group, F.col(f"l.{n}")).otherwise(F.col(f"w.{n}")).alias(n)
    return both.select("g_lang", "g_source", F.col("g.n").alias("n_group"), *(pick(n) for n in RATES))


def _judged(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """``counts`` with base_failed and kept; ``limits`` is broadcast if it has few rows."""
    small = limits.count() <= BROADCAST_GROUPS
    joined = counts.withColumns({"g_lang": _level("lang"), "g_source": _level("source")}).join(F.broadcast(limits) if small else limits, ["g_lang", "g_source"], "left")
    fine = F.lit(True)
    for n, rate in _rates().items():
        fine &= F.coalesce(rate <= F.col(f"{n}.high"), F.lit(True)) & F.coalesce(rate >= F.col(f"{n}.low"), F.lit(True))
    return joined.withColumn("base_failed", _failed()).withColumn("kept", ~F.col("base_failed") & fine).drop("g_lang", "g_source", "n_group", *RATES)


def assess(docs: DataFrame, fence: float = FENCE, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per document: doc_id, lang, source, the counts, base_failed and kept.

    ``docs`` needs doc_id, text, lang and source; other columns are ignored.

    Defined results: a null text has no words and fails; a null language or source is a group of
    its own; a null doc_id stays null; repeated rows give repeated rows.  A group whose documents
    all fail has no fence, its documents have failed anyway.  An empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "quality")
    counts = ws.write(counted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "text"), "doc_id", "lang", "source"), "counts")
    return _judged(counts, ws.write(fences(counts, fence, min_group), "fences"))


def keep_good(docs: DataFrame, fence: float = FENCE, min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    The counts are written next to the row, so texts are counted once and never shuffled.
    """
    ws = Workspace(docs.sparkSession, "quality")
    held = docs.select(F.struct("*").alias("row"), "lang", "source", "text")
    counts = ws.write(counted(held, "row", "lang", "source"), "counts")
    return _judged(counts, ws.write(fences(counts, fence, min_group), "fences")).where("kept").select("row.*")
