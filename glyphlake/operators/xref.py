"""Cross-reference tables and trailers of PDF files, as column expressions over their bytes.

Only classic tables are understood; a file that keeps its table in a stream yields the error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes at the end of a file that are searched for its last startxref.
TAIL = 1024


def _text(b: Column) -> Column:
    """Bytes as characters of the same number."""
    return F.decode(b, "ISO-8859-1")


def start_offset(content: Column) -> Column:
    """The number after the last ``startxref``; null if there is none or it has no number."""
    tail = _text(F.substring(content, F.greatest(F.length(content) - TAIL + 1, F.lit(1)), F.lit(TAIL)))
    last = F.element_at(F.split(tail, "startxref"), -1)
    digits = F.regexp_extract(last, r"^[ \t\r\n]*(\d+)", 1)
    return F.when((F.instr(tail, "startxref") > 0) & (digits != ""), digits.cast("bigint"))


def located(files: DataFrame) -> DataFrame:
    """(doc_id, xref_offset, body, error): the text from the table on."""
    offset = start_offset(F.col("content"))
    found = files.select("doc_id", "content", offset.alias("xref_offset"))
    body = _text(F.substring("content", (F.col("xref_offset") + 1).cast("int"), F.length("content")))
    found = found.select("doc_id", "xref_offset", F.when(F.col("xref_offset") < F.length("content"), F.ltrim(body)).alias("body"))
    error = F.when(F.col("xref_offset").isNull(), F.lit("no startxref")).when(F.coalesce(~F.col("body").startswith("xref"), F.lit(True)), F.lit("no classic table"))
    return found.withColumn("error", error)


def entries(files: DataFrame) -> DataFrame:
    """(doc_id, obj, gen, kind, offset, next_free), the last record of an object."""
    table = located(files).where("error is null").select("doc_id", F.regexp_extract("body", r"(?s)^xref(.*?)(?:trailer|\z)", 1).alias("t"))
    # a section is a head line of two numbers and records of ten and five digits and a letter
    section = r"(?m)^[ \t\r\n]*\d+[ \t]+\d+[ \t]*(?:\r\n|\n|\r)(?:\d{10} \d{5} [a-z][ \t]*(?:\r\n|\n|\r|\z))*"
    cut = table.select("doc_id", F.posexplode(F.regexp_extract_all("t", F.lit(section), F.lit(0))).alias("section", "s"))
    cut = cut.withColumn("first", F.regexp_extract("s", r"^\s*(\d+)", 1).cast("bigint")).withColumn("records", F.regexp_extract_all("s", F.lit(r"(\d{10} \d{5} [a-z])"), F.lit(1)))
    rows = cut.select("doc_id", "section", "first", F.posexplode("records").alias("i", "r"))
    number = lambda a, n: F.substring("r", a, n).cast("bigint")
    free = F.substring("r", 18, 1) == "f"
    rows = rows.select("doc_id", "section", "i", (F.col("first") + F.col("i")).alias("obj"), number(12, 5).cast("int").alias("gen"), F.when(free, F.lit("free")).otherwise(F.lit("in-use")).alias("kind"), F.when(~free, number(1, 10)).alias("offset"), F.when(free, number(1, 10)).alias("next_free"))
    last = F.max_by(F.struct("gen", "kind", "offset", "next_free"), F.struct("section", "i"))
    return rows.groupBy("doc_id", "obj").agg(last.alias("e")).select("doc_id", "obj", "e.*")


def trailers(files: DataFrame) -> DataFrame:
    """(doc_id, xref_offset, size, root_obj, root_gen, info_obj, info_gen, prev)."""
    found = located(files).where("error is null").select("doc_id", "xref_offset", F.regexp_extract("body", r"(?s)trailer.*?<<(.*)", 1).alias("t"))
    one = lambda key: F.regexp_extract("t", rf"/{key}[ \t\r\n]*(\d+)", 1)
    two = lambda key: F.regexp_extract("t", rf"/{key}[ \t\r\n]*\d+[ \t\r\n]+(\d+)", 1)
    value = lambda c: F.when(c != "", c.cast("bigint"))
    return found.select("doc_id", "xref_offset", value(one("Size")).alias("size"), value(one("Root")).alias("root_obj"), value(two("Root")).alias("root_gen"), value(one("Info")).alias("info_obj"), value(two("Info")).alias("info_gen"), value(one("Prev")).alias("prev")).where("size is not null and root_obj is not null")


def summary(found: DataFrame) -> DataFrame:
    """(doc_id, in_use, free) from entries."""
    return found.groupBy("doc_id").agg(F.count(F.when(F.col("kind") == "in-use", 1)).alias("in_use"), F.count(F.when(F.col("kind") == "free", 1)).alias("free"))


def dump(found: DataFrame, show_free: bool = False) -> DataFrame:
    """(doc_id, obj, line): a printed line for each entry; free object 0 only on demand."""
    shown = found if show_free else found.where("kind <> 'free' or obj <> 0")
    detail = F.when(F.col("kind") == "free", F.concat(F.lit("free      next="), F.col("next_free"))).otherwise(F.concat(F.lit("in-use    offset="), F.col("offset")))
    return shown.select("doc_id", "obj", F.concat(F.format_string("  %4d  %3d  ", "obj", "gen"), detail).alias("line"))


def trailer_dump(found: DataFrame) -> DataFrame:
    """(doc_id, text): the printed block of a trailer, from ``trailers``."""
    reference = lambda name, key: F.concat(F.lit(f"\n  /{name}  "), f"{key}_obj", F.lit(" "), F.coalesce(F.col(f"{key}_gen"), F.lit(0)), F.lit(" R"))
    optional = lambda text: F.coalesce(text, F.lit(""))
    prev = F.concat(F.lit("\n  /Prev  "), "prev", F.lit("  (incremental update)"))
    return found.select("doc_id", F.concat(F.lit("Trailer"), reference("Root", "root"), optional(reference("Info", "info")), F.concat(F.lit("\n  /Size  "), "size"), optional(prev)).alias("text"))


def parse_events(files: DataFrame) -> DataFrame:
    """(doc_id, seq, event, payload): what a reader of the tables meets, in order, as JSON.

    One StartXRef, an XRefEntry for each object and one Trailer a file; files without a classic
    table have none.
    """
    fine = located(files).where("error is null")
    none = {"ignoreNullFields": "true"}
    start = fine.select("doc_id", F.lit(0).cast("bigint").alias("seq"), F.lit("StartXRef").alias("event"), F.to_json(F.struct(F.col("xref_offset").alias("offset"))).alias("payload"))
    entry = entries(files).select("doc_id", (F.col("obj") + 1).alias("seq"), F.lit("XRefEntry").alias("event"), F.to_json(F.struct("obj", "gen", "kind", "offset", "next_free"), none).alias("payload"))
    last = trailers(files).select("doc_id", F.lit((1 << 62)).alias("seq"), F.lit("Trailer").alias("event"), F.to_json(F.struct("root_obj", "root_gen", "info_obj", "info_gen", "size", "prev"), none).alias("payload"))
    return start.unionByName(entry).unionByName(last)
