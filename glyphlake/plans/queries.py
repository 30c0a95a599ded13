"""Queries over the test tables and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphlake.functions import geometry as G
from glyphlake.functions import text as T
from glyphlake.operators import clustering, cmap, content, interpreter, layout, listing, mapping, ordering, paint, trace, xref
from glyphlake.plans.layout import PageLayout
from glyphlake.sources import pdf

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _layout(spark: SparkSession, sf_dir: str) -> PageLayout:
    return PageLayout(layout.pages_of_text(_docs(spark, sf_dir)))


def _glyph_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped glyphs as rows, made and mapped by column expressions."""
    return mapping.map_glyphs(layout.glyphs_of_text(_docs(spark, sf_dir)))


# The layout of documents in SQL: lines, glyphs, words by lag and running sum, and lines of words.
_GLYPHS = """
ln as (select doc_id, unnest(string_split(text, chr(10))) as s, unnest(range(len(string_split(text, chr(10))))) as ln from documents),
gl as (select doc_id, ln, i, substr(s, cast(i + 1 as int), 1) as ch, unicode(substr(s, cast(i + 1 as int), 1)) as glyph_id,
              72 + 6 * i as x, 720 - 12 * ln - 18 * (ln // 5) as y
       from (select *, unnest(range(length(s))) as i from ln))"""
_WORDS = f"""{_GLYPHS},
wb as (select *, case when ch = ' ' then 0
                      when lag(ch) over w is null or lag(ch) over w = ' ' or x - lag(x) over w > 2 * 10 then 1 else 0 end as brk
       from gl window w as (partition by doc_id, ln order by x)),
wn as (select *, sum(brk) over (partition by doc_id, ln order by x rows unbounded preceding) as wno from wb),
wd as (select doc_id, ln, wno, string_agg(ch, '' order by x) as word, min(x) as x0, max(x) + 6 as x1, min(y) as y0, max(y) + 10 as y1, count(*) as n, any_value(y) as y
       from wn where ch <> ' ' group by all)"""
_LINES = f"""{_WORDS},
li as (select doc_id, ln, string_agg(word, ' ' order by wno) as line, count(*) as n_words, min(x0) as x0, max(x1) as x1, min(y0) as y0, max(y1) as y1, any_value(y) as baseline
       from wd group by doc_id, ln),
lb as (select *, sum(case when brk then 1 else 0 end) over (partition by doc_id order by ln rows unbounded preceding) as block_no
       from (select *, coalesce(abs(lag(baseline) over (partition by doc_id order by ln) - baseline) > 1.5 * 10, false) as brk from li)),
bl as (select doc_id, block_no, string_agg(line, chr(10) order by ln) as block, count(*) as n_lines, min(x0) as x0, max(x1) as x1, min(y0) as y0, max(y1) as y1
       from lb group by doc_id, block_no)"""


@query(f"""with {_GLYPHS} select doc_id, count(*) as n_glyphs, cast(sum(x) as double) as sum_x, cast(sum(y) as double) as sum_y, sum(glyph_id) as sum_id from gl group by doc_id""")
def glyph_layout_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = clustering.visible(layout.glyphs_of_text(_docs(spark, sf_dir)))
    return seen.groupBy("doc_id").agg(F.count("*").alias("n_glyphs"), F.sum(F.col("x").cast("double")).alias("sum_x"), F.sum(F.col("y").cast("double")).alias("sum_y"), F.sum("glyph_id").alias("sum_id"))


@query(f"""with {_GLYPHS} select case when glyph_id between 32 and 126 or glyph_id between 160 and 255 then chr(cast(glyph_id as int)) end as unicode, glyph_id,
case when glyph_id between 32 and 126 or glyph_id between 160 and 255 then 'Heuristic' else 'Unmapped' end as mapping_method, count(*) as n from gl group by all""")
def map_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _glyph_rows(spark, sf_dir).groupBy("unicode", "glyph_id", "mapping_method").agg(F.count("*").alias("n"))


@query(f"""with {_GLYPHS} select doc_id, count(*) as n_glyphs, count(case when glyph_id between 32 and 126 or glyph_id between 160 and 255 then 1 end) as n_mapped from gl group by doc_id""")
def mapping_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.mapping_rate(_glyph_rows(spark, sf_dir), "doc_id")


def _shifted_cmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A character map for even documents: lower-case letters turn by one, 'a' is given twice."""
    rows = "5 beginbfchar\n<61> <0078>\n<61> <0062>\nendbfchar\n1 beginbfrange\n<62> <79> <0063>\n<7A> <7A> [<0061>]\nendbfrange"
    return table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id", F.lit(0).alias("page"), F.lit("/F1").alias("font_name"), F.encode(F.lit(rows), "UTF-8").alias("content"))


@query(f"""with {_GLYPHS} select mapping_method, unicode, count(*) as n from (
select case when doc_id % 2 = 0 and glyph_id between 97 and 122 then 'ToUnicode' when glyph_id between 32 and 126 or glyph_id between 160 and 255 then 'Heuristic' else 'Unmapped' end as mapping_method,
       case when doc_id % 2 = 0 and glyph_id between 97 and 122 then chr(cast(97 + (glyph_id - 96) % 26 as int)) when glyph_id between 32 and 126 or glyph_id between 160 and 255 then ch end as unicode
from gl) group by all""")
def map_cmap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = cmap.page_cmap(_shifted_cmap(spark, sf_dir))
    return PageLayout(layout.pages_of_text(_docs(spark, sf_dir)), maps).pages.rows("glyphs").groupBy("mapping_method", "unicode").agg(F.count("*").alias("n"))


def _font_rows(spark: SparkSession, sf_dir: str, line: str, section: str) -> DataFrame:
    """A character map for each part, whose lines hold numbers of the part."""
    part = table(spark, sf_dir, "part")
    text = F.concat(F.lit(f"/CIDInit findresource\n1 begin{section}\n"), F.expr(line), F.lit(f"\nend{section}\n<41> <0042>"))
    return part.select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("page"), F.lit("/F1").alias("font_name"), F.encode(text, "UTF-8").alias("content"))


@query("""select p_partkey as doc_id, p_partkey % 65536 as glyph_id, chr(cast(19968 + p_partkey % 20000 as int)) as unicode from part""")
def cmap_bfchar(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "concat('<', lpad(hex(p_partkey % 65536), 4, '0'), '> <', lpad(hex(19968 + p_partkey % 20000), 4, '0'), '>')"
    return cmap.page_cmap(_font_rows(spark, sf_dir, line, "bfchar")).select("doc_id", "glyph_id", "unicode")


@query("""select p_partkey as doc_id, p_partkey % 1000 + i as glyph_id, chr(cast(65 + p_partkey % 100 + i as int)) as unicode from part, range(20) r(i) where i <= p_size % 20""")
def cmap_bfrange_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "concat('<', hex(p_partkey % 1000), '> <', hex(p_partkey % 1000 + p_size % 20), '> <', lpad(hex(65 + p_partkey % 100), 4, '0'), '>')"
    return cmap.page_cmap(_font_rows(spark, sf_dir, line, "bfrange")).select("doc_id", "glyph_id", "unicode")


@query("""select p_partkey as doc_id, p_partkey % 1000 + i as glyph_id, chr(cast(19968 + p_partkey % 1000 + 7 * i as int)) as unicode from part, range(3) r(i) where i <= p_size % 4""")
def cmap_bfrange_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = "concat('<', hex(19968 + p_partkey % 1000 + {}), '> ')"
    line = f"concat('<', hex(p_partkey % 1000), '> <', hex(p_partkey % 1000 + p_size % 4), '> [', {token.format(0)}, {token.format(7)}, {token.format(14)}, ']')"
    return cmap.page_cmap(_font_rows(spark, sf_dir, line, "bfrange")).select("doc_id", "glyph_id", "unicode")


@query("""with recursive y as (select distinct l_orderkey as doc_id, cast(700 as float) - cast(l_partkey % 40 as float) * cast(0.75 as float) as y from lineitem),
a as (select doc_id, max(y) as anchor from y group by doc_id
      union all
      select doc_id, (select max(y.y) from y where y.doc_id = a.doc_id and a.anchor - y.y > cast(2 as float)) as anchor from a where anchor is not null),
al as (select doc_id, anchor from a where anchor is not null)
select y.doc_id, cast(y.y as double) as y, cast(min(al.anchor) as double) as anchor from y join al on al.doc_id = y.doc_id and al.anchor >= y.y group by y.doc_id, y.y""")
def line_anchor_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    fl = lambda c: c.cast("float")
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.col("l_linenumber").cast("bigint").alias("seq"), F.lit(65).cast("bigint").alias("glyph_id"),
        fl(F.lit(10) * F.col("l_linenumber")).alias("x"), fl(F.lit(700.0).cast("float") - fl(fl(F.col("l_partkey") % 40) * F.lit(0.75).cast("float"))).alias("y"), F.lit(10.0).cast("float").alias("font_size"),
    )
    return clustering.with_lines(items).select("doc_id", F.col("y").cast("double").alias("y"), F.col("anchor").cast("double").alias("anchor")).distinct()


def _digest(value: str, *by: str):
    """md5 of ordered strings, so that a row for each document stands for all of its values."""
    return F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, value))), lambda x: x[value]), "|"))


@query(f"""with {_WORDS} select doc_id, count(*) as n_words, md5(string_agg(word, '|' order by ln, wno)) as digest from wd group by doc_id""")
def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layout(spark, sf_dir).words.groupBy("doc_id").agg(F.count("*").alias("n_words"), _digest("text", "line_no", "word_no").alias("digest"))


@query(f"""with {_WORDS} select doc_id, cast(sum(x0) as double) as x0, cast(sum(x1) as double) as x1, cast(sum(y0) as double) as y0, cast(sum(y1) as double) as y1, cast(sum(n) as bigint) as n_glyphs from wd group by doc_id""")
def word_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layout(spark, sf_dir).words.groupBy("doc_id").agg(*(F.sum(F.col(c).cast("double")).alias(c) for c in ("x0", "x1", "y0", "y1")), F.sum("n_glyphs").alias("n_glyphs"))


@query(f"""with {_GLYPHS},
ph as (select doc_id, ln, i, x, case when ch = ' ' then ' ' when glyph_id > 126 then '[' || upper(to_hex(glyph_id)) || ']' else ch end as ch from gl),
t as (select doc_id, ln, unnest(string_split(string_agg(ch, '' order by i), ' ')) as w from ph group by doc_id, ln)
select doc_id, count(*) as n_words, sum(length(w)) as n_chars from t where w <> '' group by doc_id""")
def unmapped_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    only_ascii = PageLayout(layout.pages_of_text(_docs(spark, sf_dir), plain=((0x20, 0x7E),)))
    return only_ascii.words.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.sum(F.length("text")).alias("n_chars"))


@query(f"""with {_LINES} select doc_id, count(*) as n_lines, cast(sum(baseline) as double) as baselines, cast(sum(x1) as double) as right_edges, sum(n_words) as n_words, md5(string_agg(line, '|' order by ln)) as digest from li group by doc_id""")
def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _layout(spark, sf_dir).lines
    return found.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.col("baseline_y").cast("double")).alias("baselines"), F.sum(F.col("x1").cast("double")).alias("right_edges"), F.sum("n_words").alias("n_words"), _digest("text", "line_no").alias("digest"))


@query("""select l_orderkey as doc_id, cast(max(8 + l_linenumber) as double) as max_font_size, count(distinct l_linenumber) as n_words from lineitem group by 1""")
def line_max_font(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is one line whose glyphs stand far apart, in sizes by line number."""
    fl = lambda c: c.cast("float")
    x, n = fl(F.lit(100) * F.col("l_linenumber")), F.col("l_linenumber")
    glyphs = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), n.cast("bigint").alias("seq"), F.lit(65).cast("bigint").alias("glyph_id"), F.lit("A").alias("unicode"), x.alias("x"), F.lit(100.0).cast("float").alias("y"),
        x.alias("x0"), F.lit(100.0).cast("float").alias("y0"), fl(x + 6).alias("x1"), F.lit(110.0).cast("float").alias("y1"), fl(n + 8).alias("font_size"), F.lit("/F1").alias("font_name"),
    )
    return PageLayout(glyphs).lines.select("doc_id", F.col("max_font_size").cast("double").alias("max_font_size"), "n_words")


@query(f"""with {_LINES} select doc_id, count(*) as n_blocks, cast(sum(x0) as double) as x0, cast(sum(x1) as double) as x1, cast(sum(y0) as double) as y0, cast(sum(y1) as double) as y1, max(n_lines) as max_lines from bl group by doc_id""")
def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _layout(spark, sf_dir).blocks
    return found.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), *(F.sum(F.col(c).cast("double")).alias(c) for c in ("x0", "x1", "y0", "y1")), F.max("n_lines").alias("max_lines"))


@query(f"""with {_LINES} select doc_id, 0 as page, string_agg(block, chr(10) || chr(10) order by block_no) as text from bl group by doc_id""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layout(spark, sf_dir).text


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles from the items of an order; whole numbers."""
    fl = lambda c: c.cast("float")
    x, y = F.lit(60) * (F.col("l_partkey") % 5), F.lit(40) * (F.col("l_suppkey") % 10)
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), nth.alias("block_no"), fl(x).alias("x0"), fl(y).alias("y0"), fl(x + 50).alias("x1"), fl(y + 30).alias("y1"))


_BOXES = """bx as (select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as block_no,
 60 * (l_partkey % 5) as x0, 40 * (l_suppkey % 10) as y0, 60 * (l_partkey % 5) + 50 as x1, 40 * (l_suppkey % 10) + 30 as y1 from lineitem)"""


@query(f"""with {_BOXES}, o as (select *, coalesce(min(y0) over (partition by doc_id order by y1 desc, block_no rows between unbounded preceding and 1 preceding) - y1 > 1, false) as opens from bx)
select doc_id, block_no, cast(sum(case when opens then 1 else 0 end) over (partition by doc_id order by y1 desc, block_no rows unbounded preceding) as bigint) as band from o""")
def h_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.with_bands(_boxes(spark, sf_dir)).select("doc_id", "block_no", F.col("band").cast("bigint").alias("band"))


@query(f"""with {_BOXES} select doc_id, block_no, row_number() over (partition by doc_id order by (y0 + y1) / 2 desc, (x0 + x1) / 2, block_no) - 1 as rank from bx""")
def fallback_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("doc_id", "block_no", ordering.fallback_rank("doc_id").alias("rank"))


@query(f"""with {_BOXES} select doc_id, block_no, row_number() over (partition by doc_id order by y0 desc, x0, block_no) - 1 as reading_order from bx""")
def xy_cut_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes stand in a grid with gaps of 10, so rows from the top and columns from the left."""
    return ordering.reading_order(_boxes(spark, sf_dir)).select("doc_id", "block_no", "reading_order")


def _matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two matrices and a point of small whole numbers for each part."""
    k = F.col("p_partkey")
    m = G.matrix([k % 7 - 3, k % 5, k % 3 - 1, k % 11 - 5, k % 100, k % 90])
    n = G.matrix([k % 4, k % 6 - 2, k % 9 - 4, k % 8, k % 70, k % 60 - 30])
    return table(spark, sf_dir, "part").select("p_partkey", m.alias("m"), n.alias("n"), (k % 50).alias("x"), (k % 40 - 20).alias("y"))


_MATRICES = """mt as (select p_partkey, p_partkey % 7 - 3 as a, p_partkey % 5 as b, p_partkey % 3 - 1 as c, p_partkey % 11 - 5 as d, p_partkey % 100 as e, p_partkey % 90 as f,
 p_partkey % 4 as g, p_partkey % 6 - 2 as h, p_partkey % 9 - 4 as i, p_partkey % 8 as j, p_partkey % 70 as k, p_partkey % 60 - 30 as l, p_partkey % 50 as x, p_partkey % 40 - 20 as y from part)"""


@query(f"""with {_MATRICES} select p_partkey, cast(a * x + c * y + e as double) as tx, cast(b * x + d * y + f as double) as ty from mt""")
def matrix_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = G.transform_point(F.col("m"), F.col("x"), F.col("y"))
    return _matrices(spark, sf_dir).select("p_partkey", p["x"].cast("double").alias("tx"), p["y"].cast("double").alias("ty"))


@query(f"""with {_MATRICES} select p_partkey, cast(a * g + c * h as double) as m0, cast(b * g + d * h as double) as m1, cast(a * i + c * j as double) as m2, cast(b * i + d * j as double) as m3,
cast(a * k + c * l + e as double) as m4, cast(b * k + d * l + f as double) as m5 from mt""")
def matrix_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _matrices(spark, sf_dir).withColumn("p", G.concat(F.col("m"), F.col("n")))
    return found.select("p_partkey", *((F.col("p")[i].cast("double") + 0.0).alias(f"m{i}") for i in range(6)))


@query(f"""with {_MATRICES} select p_partkey, round(greatest((sqrt(a * a + b * b) + sqrt(c * c + d * d)) * 0.5, 0.01), 3) as scale from mt""")
def ctm_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrices(spark, sf_dir).select("p_partkey", F.round(G.mean_scale(F.col("m")).cast("double"), 3).alias("scale"))


@query("""with b as (select doc_id, x0, y0, x1, y1 from (select l_orderkey as doc_id, 60 * (l_partkey % 5) as x0, 40 * (l_suppkey % 10) as y0, 60 * (l_partkey % 5) + 50 as x1, 40 * (l_suppkey % 10) + 30 as y1 from lineitem))
select doc_id, cast(min(x0) as double) as x0, cast(min(y0) as double) as y0, cast(max(x1) as double) as x1, cast(max(y1) as double) as y1 from b group by doc_id""")
def bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _boxes(spark, sf_dir).groupBy("doc_id").agg(*G.bounds())
    return found.select("doc_id", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))


@query("""select p_partkey, cast(case when p_size % 5 > 0 and p_size % 3 > 0 then 100 * (p_size % 5) else 595 end as double) as width,
cast(case when p_size % 5 > 0 and p_size % 3 > 0 then 100 * (p_size % 3) else 842 end as double) as height from part""")
def page_size_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = G.page_size(F.lit(100) * (F.col("p_size") % 5), F.lit(100) * (F.col("p_size") % 3))
    return table(spark, sf_dir, "part").select("p_partkey", size["width"].cast("double").alias("width"), size["height"].cast("double").alias("height"))


@query(r"""select p_partkey, regexp_replace(format('{:.4f}', cast(p_retailprice as double) / 7), '\.?0+$', '') as operand from part""")
def real_operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.trimmed_real(F.col("p_retailprice").cast("double") / 7).alias("operand"))


# Structure of files, on tables that are written from orders


def _xref_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table file for each order: object 0 is free, then o_custkey % 7 objects in use, one free."""
    n = F.col("o_custkey") % 7
    used = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), n + 1), lambda i: F.concat(F.lpad((F.col("o_orderkey") % 1000 + 10 * i).cast("string"), 10, "0"), F.when(i == n + 1, F.lit(" 00002 f\r\n")).otherwise(F.lit(" 00001 n\r\n")))), "")
    head = F.concat(F.lit("%PDF-1.4\n% order "), F.col("o_orderkey"), F.lit("\n"))
    table_ = F.concat(F.lit("xref\n0 "), n + 2, F.lit("\n0000000000 65535 f\r\n"), used, F.lit("trailer\n<< /Size "), n + 2, F.lit(" /Root 1 0 R"), F.when(n > 2, F.concat(F.lit(" /Info "), n, F.lit(" 1 R"))).otherwise(F.lit("")), F.lit(" /Prev "), F.col("o_custkey"), F.lit(" >>\nstartxref\n"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.encode(F.concat(head, table_, F.length(head), F.lit("\n%%EOF")), "ISO-8859-1").alias("content"))


@query("""select o_orderkey as doc_id, i as obj, case when i = 0 then 65535 when i = o_custkey % 7 + 1 then 2 else 1 end as gen, case when i = 0 or i = o_custkey % 7 + 1 then 'free' else 'in-use' end as kind,
case when i > 0 and i < o_custkey % 7 + 1 then o_orderkey % 1000 + 10 * i end as "offset", case when i = 0 then 0 when i = o_custkey % 7 + 1 then o_orderkey % 1000 + 10 * i end as next_free
from orders, range(8) r(i) where i <= o_custkey % 7 + 1""")
def xref_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xref.entries(_xref_files(spark, sf_dir))


@query("""select o_orderkey as doc_id, o_custkey % 7 as in_use, 2 as free from orders""")
def xref_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xref.summary(xref.entries(_xref_files(spark, sf_dir)))


@query("""select o_orderkey as doc_id, i as obj, case when i = o_custkey % 7 + 1 then format('  {:>4}  {:>3}  free      next={}', i, 2, o_orderkey % 1000 + 10 * i) else format('  {:>4}  {:>3}  in-use    offset={}', i, 1, o_orderkey % 1000 + 10 * i) end as line
from orders, range(1, 8) r(i) where i <= o_custkey % 7 + 1""")
def xref_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xref.dump(xref.entries(_xref_files(spark, sf_dir)))


@query("""select o_orderkey as doc_id, length('%PDF-1.4' || chr(10) || '% order ' || o_orderkey || chr(10)) as xref_offset, o_custkey % 7 + 2 as size, 1 as root_obj, 0 as root_gen,
case when o_custkey % 7 > 2 then o_custkey % 7 end as info_obj, case when o_custkey % 7 > 2 then 1 end as info_gen, o_custkey as prev from orders""")
def trailer_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xref.trailers(_xref_files(spark, sf_dir))


# Content streams


@query(f"""with {_GLYPHS} select doc_id, count(*) as n_glyphs, cast(sum(x) as double) as sum_x, cast(sum(y) as double) as sum_y, sum(glyph_id) as sum_id from gl group by doc_id""")
def interpret_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream that shows a document's text gives the glyphs of the plain layout."""
    seen = interpreter.interpret(layout.stream_of_text(_docs(spark, sf_dir)))
    return seen.groupBy("doc_id").agg(F.count("*").alias("n_glyphs"), F.sum(F.col("x").cast("double")).alias("sum_x"), F.sum(F.col("y").cast("double")).alias("sum_y"), F.sum("glyph_id").alias("sum_id"))


@query("""with ln as (select doc_id, unnest(string_split(text, chr(10))) as s from documents),
n as (select doc_id, count(*) filter (where s <> '') as shown from ln group by doc_id)
select doc_id, operator, n from (select doc_id, unnest(['BT', 'ET', 'Tf', 'Tm', 'Tj']) as operator, unnest([1, 1, 1, shown, shown]) as n from n) where n > 0""")
def content_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.content_ops(layout.stream_of_text(_docs(spark, sf_dir))).groupBy("doc_id", "operator").agg(F.count("*").alias("n"))


_LISTED = {op: text for op, (_, text) in listing.OPERATORS.items()}


def _listed_row(op: str, line_no: str, tree: str, command: str, note: str) -> str:
    return f"select doc_id, 0 as page, {line_no} as line_no, '{tree}' as tree, {command} as command, '{_LISTED[op]}' as description, {note} as note from "


_STREAM_LISTING = f"""with ln as (select doc_id, unnest(string_split(text, chr(10))) as s, unnest(range(len(string_split(text, chr(10))))) as ln from documents where text is not null),
shown as (select doc_id, s, 720 - 12 * ln - 18 * (ln // 5) as y, row_number() over (partition by doc_id order by ln) as nth from ln where s <> ''),
n as (select d.doc_id, count(s.doc_id) as n from documents d left join shown s on s.doc_id = d.doc_id where d.text is not null group by 1)
{_listed_row("BT", "1", "┌ ", "'BT'", "''")} n union all {_listed_row("Tf", "2", "│   ", "'/F1 10 Tf'", "'font=/F1  size=10'")} n
union all {_listed_row("Tm", "1 + 2 * nth", "│   ", "'1 0 0 1 72 ' || y || ' Tm'", "'a=1  b=0  c=0  d=1  x=72  y=' || y")} shown
union all {_listed_row("Tj", "2 + 2 * nth", "│   ", "'(' || s || ') Tj'", "chr(34) || s || chr(34)")} shown
union all {_listed_row("ET", "3 + 2 * n", "└ ", "'ET'", "''")} n"""


@query(_STREAM_LISTING)
def content_ops_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.listing(content.content_ops(layout.stream_of_text(_docs(spark, sf_dir))))


@query(f"""with {_LINES} select doc_id, 0 as page, string_agg(block, chr(10) || chr(10) order by block_no) as text from bl group by doc_id""")
def pdf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to streams to files, parsed again, interpreted and assembled."""
    files = pdf.write_files(layout.stream_of_text(_docs(spark, sf_dir)))
    pages = pdf.parse(files)
    return PageLayout(interpreter.pages(pages)).text


@query("""with p as (select conv_id, turn, string_split(replace(text, chr(10), ' '), ' ') as w from conversations)
select conv_id as doc_id, cast(turn as int) as page, array_to_string(list_filter(w, lambda x: x <> ''), ' ') as text from p where len(list_filter(w, lambda x: x <> '')) > 0""")
def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents whose turns are pages of one line."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), F.regexp_replace("text", "\n", " ").alias("text"))
    return PageLayout(layout.pages_of_text(turns)).text


@query(f"""with {_WORDS} select doc_id, 'word' as stage, count(*) as n from wd group by doc_id""")
def trace_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _layout(spark, sf_dir)
    found = trace.events(p.glyphs, p.words, p.lines, p.blocks).where("stage = 'word'")
    return found.groupBy("doc_id", "stage").agg(F.count(F.get_json_object("payload", "$.text")).alias("n"))


@query(f"""with {_LINES} select doc_id, block_no, format('<rect x="{{:.1f}}" y="{{:.1f}}" width="{{:.1f}}" height="{{:.1f}}" fill="none" stroke="#cc0000" stroke-width="0.5"/>', cast(x0 as double), cast(y0 as double), cast(x1 - x0 as double), cast(y1 - y0 as double)) as rect from bl""")
def svg_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _layout(spark, sf_dir).blocks
    return trace.rects(found, "blocks", F.col("block_no")).select("doc_id", F.col("seq").alias("block_no"), "rect")


def _painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each part with a rectangle and a stroked line under a scaled matrix."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("q 2 0 0 2 "), k % 50, F.lit(" 10 cm 1 0 0 rg "), k % 30, F.lit(" 5 "), k % 20 + 1, F.lit(" 8 re f Q 3 w "), k % 40, F.lit(" 0 m 100 "), k % 60 + 1, F.lit(" l S"))
    return table(spark, sf_dir, "part").select(k.alias("doc_id"), F.lit(0).alias("page"), F.encode(text, "UTF-8").alias("content"))


@query("""select p_partkey as doc_id, 0 as seq, 'f' as operator, cast(2 * (p_partkey % 30) + p_partkey % 50 as double) as x0, 20.0::double as y0, cast(2 * (p_partkey % 30 + p_partkey % 20 + 1) + p_partkey % 50 as double) as x1, 36.0::double as y1, 2.0::double as width from part
union all select p_partkey, 1, 'S', cast(p_partkey % 40 as double), 0.0::double, 100.0::double, cast(p_partkey % 60 + 1 as double), 3.0::double from part""")
def paint_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paint.paint_paths(_painted(spark, sf_dir)).select("doc_id", "seq", "operator", "x0", "y0", "x1", "y1", "width")


@query("""select o_orderkey as doc_id, e as event, n from (select o_orderkey, unnest(['StartXRef', 'XRefEntry', 'Trailer']) as e, unnest([1, o_custkey % 7 + 2, 1]) as n from orders)""")
def parse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xref.parse_events(_xref_files(spark, sf_dir)).groupBy("doc_id", "event").agg(F.count("payload").alias("n"))


@query("""select conv_id as doc_id, count(*) as n_pages from conversations group by 1""")
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as files with a page for each turn, and read again."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    return pdf.page_counts(pdf.parse(pdf.write_files(layout.stream_of_text(turns))))


# Text operators: streams of whole numbers at size 10, whose glyphs are 6 wide


def _shown(spark: SparkSession, sf_dir: str, *parts) -> DataFrame:
    """The glyphs of a stream for each part; strings are text, columns numbers."""
    text = F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    streams = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("page"), F.encode(text, "UTF-8").alias("content"))
    return interpreter.interpret(streams).select("doc_id", "seq", F.chr("glyph_id").alias("ch"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("x1").cast("double").alias("x1"))


def _shown_sql(*glyphs: tuple[str, str, str]) -> str:
    """Rows (ch, x, y) as SQL over k, the number of the part; ``step`` is the advance after a glyph."""
    rows = " union all ".join(f"select k as doc_id, {i} as seq, '{ch}' as ch, ({x})::double as x, ({y})::double as y, ({x} + greatest({step}, 0))::double as x1 from p" for i, (ch, x, y, step) in enumerate(glyphs))
    return f"with p as (select p_partkey as k from part) {rows}"


@query(_shown_sql(("A", "k % 100", "700 - k % 50", "6 + k % 5"), (" ", "k % 100 + 6 + k % 5", "700 - k % 50", "6 + k % 5 + k % 7"), ("B", "k % 100 + 12 + 2 * (k % 5) + k % 7", "700 - k % 50", "6 + k % 5"), ("C", "k % 100", "690 - k % 50 - k % 3", "6 + k % 5")))
def text_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tc, Tw, TL, Td and T*."""
    k = F.col("p_partkey")
    return _shown(spark, sf_dir, "BT /F1 10 Tf ", k % 5, " Tc ", k % 7, " Tw ", 10 + k % 3, " TL ", k % 100, " ", 700 - k % 50, " Td (A B) Tj T* (C) Tj ET")


@query(_shown_sql(("A", "k % 90", "k % 80 + k % 4", "3 * (1 + k % 3)"), ("B", "k % 90 + (3 + 5 * (k % 6)) * (1 + k % 3)", "k % 80 + k % 4", "3 * (1 + k % 3)"), ("C", "k % 90 + (1 + k % 3)", "k % 80 + k % 4", "3 * (1 + k % 3)")))
def text_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tz, Ts and TJ with kerns to the right and to the left."""
    k = F.col("p_partkey")
    return _shown(spark, sf_dir, "BT /F1 10 Tf ", 50 * (1 + k % 3), " Tz ", k % 4, " Ts ", k % 90, " ", k % 80, " Td [(A) -", 1000 * (k % 6), " (B) ", 1000 * (k % 6) + 1000, " (C)] TJ ET")


@query(_shown_sql(("A", "k % 60", "680 - k % 20", "6"), ("B", "k % 60", "660 - 2 * (k % 20)", "6"), ("C", "k % 60", "640 - 3 * (k % 20)", "6"), ("D", "k % 60", "620 - 4 * (k % 20)", "6 + k % 5"), (" ", "k % 60 + 6 + k % 5", "620 - 4 * (k % 20)", "6 + k % 5 + k % 9"), ("E", "k % 60 + 12 + 2 * (k % 5) + k % 9", "620 - 4 * (k % 20)", "6 + k % 5")))
def text_next_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TD, which sets the leading, T*, ' and \"."""
    k = F.col("p_partkey")
    return _shown(spark, sf_dir, "BT /F1 10 Tf 0 700 Td ", k % 60, " -", 20 + k % 20, " TD (A) Tj T* (B) Tj (C) ' ", k % 9, " ", k % 5, ' (D E) " ET')


@query(_shown_sql(("A", "k % 30 + k % 20 + 10", "k % 40 + 14", "6"), ("B", "k % 30", "k % 40", "6"), ("C", "k % 30 + 5", "k % 40", "6")))
def text_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q, cm, Q, Tm and BT, which resets; text outside BT and ET is not shown."""
    k = F.col("p_partkey")
    return _shown(spark, sf_dir, "1 0 0 1 ", k % 30, " ", k % 40, " cm q 2 0 0 2 ", k % 20, " 0 cm BT /F1 10 Tf 1 0 0 1 5 7 Tm (A) Tj ET Q BT (B) Tj ET Q BT 10 0 Td -5 0 Td (C) Tj ET (D) Tj")


# Parts of files


def _part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each part: a page of its own size and four kinds of fonts."""
    k = F.col("p_partkey")
    stream = lambda body: F.concat(F.lit("<< /Length "), F.length(body), F.lit(" >>\nstream\n"), body, F.lit("\nendstream"))
    lit = F.lit
    objects = [
        lit("<< /Type /Catalog /Pages 2 0 R >>"),
        lit("<< /Type /Pages /Count 1 /Kids [3 0 R] >>"),
        F.concat(lit("<< /Type /Page /MediaBox [0 0 "), k % 7 * 100, lit(" "), 200 + k % 9, lit("] /Contents [10 0 R 11 0 R] /Resources << /Font << /T3 4 0 R /T0 5 0 R /TT 6 0 R /T1 7 0 R >> >> >>")),
        F.concat(lit("<< /Subtype /Type3 /FontMatrix [0.5 0 0 0.25 0 "), k % 9, lit("] /Encoding << /Differences [65 /a /b 97 /a] >> /CharProcs << /a 10 0 R /b 11 0 R >> /FirstChar 65 /Widths ["), k % 100, lit(" "), k % 50, lit("] /ToUnicode 12 0 R >>")),
        lit("<< /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [8 0 R] >>"),
        lit("<< /Subtype /TrueType /FontDescriptor 9 0 R >>"),
        lit("<< /Subtype /Type1 /BaseFont /Courier >>"),
        lit("<< /Subtype /CIDFontType2 /FontDescriptor 9 0 R >>"),
        lit("<< /FontFile2 13 0 R >>"),
        stream(F.concat(lit("0 0 "), k % 30, lit(" 5 re f"))),
        stream(lit("q Q")),
        stream(F.concat(lit("beginbfchar\n<41> <"), F.lpad(F.hex(19968 + k % 500), 4, "0"), lit(">\nendbfchar"))),
        stream(F.concat(lit("program "), k)),
    ]
    head = F.concat(lit("%PDF-1.4\n"), *(F.concat(lit(f"{i} 0 obj\n"), o, lit("\nendobj\n")) for i, o in enumerate(objects, 1)))
    made = table(spark, sf_dir, "part").select(k.alias("doc_id"), head.alias("head"))
    whole = F.concat("head", lit("xref\n0 1\n0000000000 65535 f\r\ntrailer\n<< /Size 14 /Root 1 0 R >>\nstartxref\n"), F.length("head"), lit("\n%%EOF"))
    return made.select("doc_id", F.concat("doc_id", lit(".pdf")).alias("path"), F.encode(whole, "ISO-8859-1").alias("content"))


@query("""select p_partkey as doc_id, case when p_partkey % 7 = 0 then 595 else p_partkey % 7 * 100 end::double as width, case when p_partkey % 7 = 0 then 842 else 200 + p_partkey % 9 end::double as height,
'0 0 ' || p_partkey % 30 || ' 5 re f' || chr(10) || 'q Q' as content from part""")
def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and joined content streams of pages as they are read."""
    return pdf.parse(_part_files(spark, sf_dir)).select("doc_id", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"), F.decode("content", "UTF-8").alias("content"))


@query("""select p_partkey as doc_id, f.* from part, (select unnest([
 {'font_name': '/T3', 'kind': 'type3', 'two_byte': false}, {'font_name': '/T0', 'kind': 'truetype', 'two_byte': true}, {'font_name': '/TT', 'kind': 'truetype', 'two_byte': false}, {'font_name': '/T1', 'kind': 'unsupported', 'two_byte': false}]) as f)""")
def font_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.page_fonts(pdf.parse(_part_files(spark, sf_dir))).select("doc_id", "font_name", "kind", "two_byte")


@query("""select p_partkey as doc_id, 0.25::double as scale, (p_partkey % 9)::double as shift, (p_partkey % 100 + p_partkey % 50)::double as widths, '65,66,97' as codes, '0 0 ' || p_partkey % 30 || ' 5 re f' as glyph from part""")
def type3_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fonts = pdf.page_fonts(pdf.parse(_part_files(spark, sf_dir))).where("kind = 'type3'")
    widths = F.aggregate(F.map_values("widths"), F.lit(0.0), lambda a, w: a + w.cast("double"))
    return fonts.select("doc_id", F.get("font_matrix", F.lit(3)).cast("double").alias("scale"), F.get("font_matrix", F.lit(5)).cast("double").alias("shift"), widths.alias("widths"), F.array_join(F.array_sort(F.map_keys("char_procs")), ",").alias("codes"), F.decode(F.try_element_at("char_procs", F.lit(97)), "UTF-8").alias("glyph"))


@query("""select p_partkey as doc_id, f as font_name, 'program ' || p_partkey as program from part, (select unnest(['/T0', '/TT']) as f)""")
def font_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.page_fonts(pdf.parse(_part_files(spark, sf_dir))).where("program is not null").select("doc_id", "font_name", F.decode("program", "UTF-8").alias("program"))


@query("""select p_partkey as doc_id, '/T3' as font_name, 65 as glyph_id, chr(cast(19968 + p_partkey % 500 as int)) as unicode from part""")
def unicode_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character maps from the streams that fonts name."""
    return cmap.page_cmap(pdf.unicode_programs(pdf.parse(_part_files(spark, sf_dir)))).select("doc_id", "font_name", "glyph_id", "unicode")


@query("""with n as (select conv_id, count(*) as n from conversations group by 1)
select conv_id as doc_id, p as page, case when p >= n then 'page ' || p || ' not found' end as error from n, (select unnest([0, 2, 9]) as p)""")
def page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by number; those that a file lacks are errors."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    return pdf.parse(pdf.write_files(layout.stream_of_text(turns)), pages=[0, 2, 9]).select("doc_id", "page", "error")


@query("""select o_orderkey as doc_id, case o_custkey % 4 when 0 then 'no startxref' when 1 then 'no classic table' when 2 then 'no startxref' end as error from orders""")
def xref_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without a table, with one in a stream, with one that is cut off, and whole ones."""
    whole, kind = _xref_files(spark, sf_dir), F.col("o_custkey") % 4
    kinds = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), kind.alias("kind"))
    part = F.when(F.col("kind") == 0, F.encode(F.lit("%PDF-1.4"), "UTF-8")).when(F.col("kind") == 1, F.encode(F.lit("1 0 obj << /Type /XRef >>\nstartxref\n0\n%%EOF"), "UTF-8")).when(F.col("kind") == 2, F.encode(F.lit("xref\n0 0\nstartxref\n%%EOF"), "UTF-8")).otherwise(F.col("content"))
    return xref.located(whole.join(kinds, "doc_id").select("doc_id", part.alias("content"))).select("doc_id", "error")


@query("""select o_orderkey as doc_id, 'Trailer' || chr(10) || '  /Root  1 0 R' || case when o_custkey % 7 > 2 then chr(10) || '  /Info  ' || o_custkey % 7 || ' 1 R' else '' end || chr(10) || '  /Size  ' || (o_custkey % 7 + 2)
|| chr(10) || '  /Prev  ' || o_custkey || '  (incremental update)' as text from orders""")
def xref_trailers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xref.trailer_dump(xref.trailers(_xref_files(spark, sf_dir)))


@query("""select p_partkey, p_name || 'é' as text from part""")
def pdf_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same text in the three encodings of strings."""
    k, text = F.col("p_partkey"), F.concat("p_name", F.lit("é"))
    raw = F.when(k % 3 == 0, F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE"))).when(k % 3 == 1, F.encode(text, "UTF-8")).otherwise(F.encode(text, "ISO-8859-1"))
    return table(spark, sf_dir, "part").select("p_partkey", T.pdf_string(raw).alias("text"))


@query("""select p_partkey, (p_size % 9)::double as width, (p_partkey % 8)::double as height, (p_partkey % 50 + 3 * (p_size % 7))::double as x, (p_partkey % 40)::double as y from part""")
def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides of rectangles, and corners moved by a product of matrices that begins with the identity."""
    k, n = F.col("p_partkey"), F.col("p_size")
    r = G.rect(k % 50, k % 40, n % 9, k % 8)
    m = G.product(F.array(G.identity(), G.matrix([F.lit(1), F.lit(0), F.lit(0), F.lit(1), 2 * (n % 7), F.lit(0)]), G.matrix([F.lit(1), F.lit(0), F.lit(0), F.lit(1), n % 7, F.lit(0)])))
    found = table(spark, sf_dir, "part").select("p_partkey", r.alias("r"), m.alias("m"))
    p = G.transform_point(F.col("m"), F.col("r.x0"), F.col("r.y0"))
    return found.select("p_partkey", G.width(F.col("r")).cast("double").alias("width"), G.height(F.col("r")).cast("double").alias("height"), p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))


def _colored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each part with fills and strokes in gray and RGB, curves, and paths that are not painted."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("0.5 g 0.25 0.5 0.75 RG "), k % 30, F.lit(" 0 10 10 re B 1 0 0 sc 0 0 m 3 0 6 0 "), 9 + k % 5, F.lit(" 0 c 0 "), 4 + k % 3, F.lit(" l b* q 0 1 0 scn 0.5 SC 0 0 m 2 2 "), 4 + k % 4, F.lit(" 4 v s Q 7 7 m 8 8 9 9 y F 1 1 5 5 re W n 1 i /x gs 2 2 2 2 re f*"))
    return table(spark, sf_dir, "part").select(k.alias("doc_id"), F.lit(0).alias("page"), F.encode(text, "UTF-8").alias("content"))


@query("""select p_partkey as doc_id, c.* from part, lateral (select unnest([
 {'seq': 0, 'operator': 'B', 'even_odd': false, 'fill': '0.5,0.5,0.5', 'stroke': '0.25,0.5,0.75', 'x1': (p_partkey % 30 + 10)::double, 'y1': 10.0::double},
 {'seq': 1, 'operator': 'b*', 'even_odd': true, 'fill': '1,0,0', 'stroke': '0.25,0.5,0.75', 'x1': (9 + p_partkey % 5)::double, 'y1': (4 + p_partkey % 3)::double},
 {'seq': 2, 'operator': 's', 'even_odd': false, 'fill': null, 'stroke': '0.5,0.5,0.5', 'x1': (4 + p_partkey % 4)::double, 'y1': 4.0::double},
 {'seq': 3, 'operator': 'F', 'even_odd': false, 'fill': '1,0,0', 'stroke': null, 'x1': 9.0::double, 'y1': 9.0::double},
 {'seq': 4, 'operator': 'f*', 'even_odd': true, 'fill': '1,0,0', 'stroke': null, 'x1': 4.0::double, 'y1': 4.0::double}]) as c)""")
def paint_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    shade = lambda c: F.array_join(F.transform(c, lambda v: T.trimmed_real(v)), ",")
    found = paint.paint_paths(_colored(spark, sf_dir))
    return found.select("doc_id", "seq", "operator", "even_odd", shade("fill").alias("fill"), shade("stroke").alias("stroke"), F.round("x1", 6).alias("x1"), F.round("y1", 6).alias("y1"))
