"""URL verdicts: path rules first, then a list of canonical URLs behind a blocked Bloom filter.

The list holds canonical expressions ``host/path`` without scheme, query and fragment.  An entry
covers a URL if it equals one of the URL's expressions: the canonical host or a parent of it, with
the canonical path or one of the directories above it, as deep as the list goes.  A canonical host
has no user, port, escapes or dots at its end, a canonical path no escapes, empty steps or dot steps.
Each expression sets or tests its bits inside one block of the filter only.  Expressions that the filter lets through go to an exact hash join with the list,
which removes its false positives, so the result does not depend on the filter's size.

DataFrame operations only.  Only page_id and url are read, and the filter is a table of one row,
of bounded size, that a scalar subquery reads.
"""

from __future__ import annotations

import functools
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Workspace

#: (verdict, host, path) as the contract gives them; the longest fitting rule wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The query's list, made by a rule: sites of gambling, pharmacy and tracking are named by two words
#: in either order, below each of the suffixes.
SITE_WORDS = (
    (("casino", "poker", "bets", "slots", "jackpot", "lotto", "bingo", "roulette"), ("win", "free", "bonus", "online", "royal", "lucky", "vegas", "best")),
    (("pills", "meds", "pharma", "rx", "diet", "tablets"), ("cheap", "discount", "express", "online", "generic", "best")),
    (("ads", "adserver", "banner", "pixel", "click", "popup"), ("track", "tracker", "serve", "sync", "count", "free")),
)
SITE_SUFFIXES = ("example.com", "example.net", "example.org", "com", "net", "org", "info", "biz", "top", "site", "online", "club")
BITS_PER_ENTRY = 12
PROBES = 6
WORDS_PER_BLOCK = 8
#: A filter has at most 2^17 blocks, 8 MB; a longer list only lets more expressions through.
MAX_BLOCKS = 1 << 17


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty where there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host_ == h) | host_.endswith(f".{h}")) & path_.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def listed_sites(spark: SparkSession) -> DataFrame:
    """(entry): the query's list, some thousand hosts."""
    each = lambda *words: F.explode(F.array(*map(F.lit, words)))
    kinds = [spark.range(1).select(each(*first).alias("a"), F.lit(0).alias("k")).select("a", each(*second).alias("b")) for first, second in SITE_WORDS]
    names = functools.reduce(DataFrame.union, kinds).select(F.explode(F.array(F.concat_ws("-", "a", "b"), F.concat_ws("-", "b", "a"))).alias("name"))
    return names.select("name", each(*SITE_SUFFIXES).alias("suffix")).select(F.concat("name", F.lit("."), "suffix", F.lit("/")).alias("entry"))


def _decoded(text: Column) -> Column:
    """``text`` without escapes; as it is where one of them is damaged."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def canonical_host(host_: Column) -> Column:
    """A host without user, port and escapes, in lower case, without dots at its ends."""
    bare = F.regexp_replace(F.regexp_replace(host_, r"(?s)^.*@", ""), r":[0-9]*$", "")
    return F.btrim(F.lower(_decoded(bare)), F.lit("."))


def expressions(host_: Column, path_: Column, labels: int, depth: int) -> Column:
    """All canonical ``host/path`` expressions of a URL that a list can hold.

    Its entries have at most ``labels`` labels and ``depth`` slashes in the path, so the work for a
    URL grows with its length only.
    """
    parts = F.split(canonical_host(host_), r"\.")
    suffixes = F.transform(F.sequence(F.greatest(F.size(parts) - (labels - 1), F.lit(1)), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, labels), "."))
    decoded = _decoded(path_)
    steps = F.filter(F.split(decoded, "/"), lambda x: (x != "") & (x != "."))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"))
    # no more than the first ``depth`` steps are ever kept
    push = lambda a, x: F.struct(F.when(a["n"] < depth, F.concat(a["kept"], F.array(x))).otherwise(a["kept"]).alias("kept"), (a["n"] + 1).alias("n"))
    pop = lambda a: F.struct(F.slice(a["kept"], F.lit(1), F.least(F.size(a["kept"]), F.greatest(a["n"] - 1, F.lit(0)))).alias("kept"), F.greatest(a["n"] - 1, F.lit(0)).alias("n"))
    folded = F.aggregate(steps, start, lambda a, x: F.when(x == "..", pop(a)).otherwise(push(a, x)))
    is_dir = (decoded == "") | decoded.rlike(r"(?s)(^|/)\.{0,2}$")
    # taken out of a one-element array, so that the fold runs once for a URL
    prefixes = F.element_at(F.transform(F.array(folded), lambda f: F.concat(
        F.transform(F.sequence(F.lit(0), F.least(F.lit(depth - 1), F.greatest(f["n"] - F.when(is_dir, 0).otherwise(1), F.lit(0)))), lambda i: F.concat(F.lit("/"), F.array_join(F.transform(F.slice(f["kept"], F.lit(1), i), lambda x: F.concat(x, F.lit("/"))), ""))),
        F.when(~is_dir & (f["n"] > 0) & (f["n"] <= depth), F.array(F.concat(F.lit("/"), F.array_join(f["kept"], "/")))).otherwise(F.array().cast("array<string>")),
    )), 1)
    return F.when(F.element_at(parts, -1) != "", F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))).otherwise(F.array().cast("array<string>"))


def _bits(entry: Column, blocks: int) -> list[tuple[Column, Column]]:
    """(word, mask) of each probe; all words lie in one block."""
    h, g = F.xxhash64(entry), F.xxhash64(entry, F.lit(1))
    base = F.pmod(h, F.lit(blocks)) * WORDS_PER_BLOCK
    # nine bits of the second hash for each probe: three choose the word, six the bit
    nine = [F.shiftrightunsigned(g, 9 * i).bitwiseAND(F.lit(511)) for i in range(PROBES)]
    return [((base + F.shiftright(x, 6)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))) for x in nine]


def bloom(listed: DataFrame, n: int) -> tuple[DataFrame, int]:
    """A one-row frame with the filter's words (array<bigint>) for n entries, and the number of blocks."""
    blocks = min(MAX_BLOCKS, 1 << max(0, math.ceil(math.log2(max(1, n) * BITS_PER_ENTRY / (64 * WORDS_PER_BLOCK)))))
    set_ = listed.select(F.inline(F.array(*(F.struct(w.alias("word"), m.alias("mask")) for w, m in _bits(F.col("entry"), blocks)))))
    words = set_.groupBy("word").agg(F.bit_or("mask").alias("bits"))
    empty = listed.sparkSession.range(0, blocks * WORDS_PER_BLOCK, 1, 1).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    dense = empty.unionByName(words).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    # at most MAX_BLOCKS * WORDS_PER_BLOCK numbers meet here
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words")), blocks


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, listed_verdict: str = "block", other_verdict: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, listed.

    ``pages`` needs page_id and url, ``listed`` a string column entry; other columns are ignored.
    ``listed`` in the result is the shortest entry that covers the URL, else null.

    Defined results: a null url, or one without ``://``, has an empty host and path and gets
    ``other_verdict``; a null page_id stays null; repeated rows give repeated rows.  An empty list
    lists nothing; an empty table gives no rows.  The rules judge the host and path as they stand,
    the list their canonical forms; an entry that is not canonical covers nothing.
    """
    ws = Workspace(pages.sparkSession, "urls")
    entries = ws.write(listed.where("entry is not null").select("entry").distinct(), "entries")
    size = entries.agg(F.count("*"), F.max(F.size(F.split(F.substring_index("entry", "/", 1), r"\."))), F.max(F.size(F.split("entry", "/")) - 1)).first()
    n, labels, depth = (x or 1 for x in size)
    words, blocks = bloom(entries, n)
    words = ws.write(words, "filter")
    url = F.col("url").cast("string")
    parts = pages.select("page_id", host(url).alias("host"), path(url).alias("path"))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    parts = parts.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"))
    # hosts and paths repeat more than urls; each distinct pair is tested once
    tested = parts.select("host", "path").distinct().select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), labels, depth)).alias("entry"))
    view = f"glyphlake_bloom_{uuid.uuid4().hex}"
    words.createOrReplaceTempView(view)
    filter_ = F.expr(f"(select words from {view})")
    passed = tested.where(_all([F.get(filter_, w).bitwiseAND(m) != 0 for w, m in _bits(F.col("entry"), blocks)]))
    pages.sparkSession.catalog.dropTempView(view)  # the plan holds the table by now
    covered = passed.join(entries, "entry").groupBy("host", "path").agg(F.min_by("entry", F.struct(F.length("entry"), "entry")).alias("listed"))
    found = parts.join(covered, ["host", "path"], "left")
    other = F.when(F.col("listed").isNotNull(), F.lit(listed_verdict)).otherwise(F.lit(other_verdict))
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", other).alias("verdict"), "listed")


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out
