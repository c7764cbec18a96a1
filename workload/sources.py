"""Documents, reference tables and sinks on data derived from the given tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, functions as F

from statloom.operators import grid
from statloom.session import ensure_checkpoint_dir
from statloom.sources import html, sinks, tables
from statloom.sources.landing import land, spread
from workload import cells, shapes as s
from workload.base import query, table


def _documents(spark, d) -> DataFrame:
    """One HTML document per customer with two tables: a marked header and a bare one."""
    c = table(spark, d, "customer")
    key, seg, bal = F.col("c_custkey").cast("string"), F.col("c_mktsegment"), F.format_string("%.2f", "c_acctbal")
    page = F.concat(
        F.lit("<!DOCTYPE html><html><x:Name>Ark1</x:Name><x:Name>Ark1</x:Name><table><thead><tr><th></th><th>Balance &amp; more</th><th>Segment</th></tr></thead>"),
        F.lit('<tr><th scope="row">Q1 '), key, F.lit("</th><td>"), bal, F.lit("</td><td><b>"), seg, F.lit("</b></td></tr>"),
        F.lit('<tr><th scope="row">Q2 '), key, F.lit("</th><td></td><td>&lt;none&gt;</td></tr></table>"),
        F.lit("<TABLE><tr><td colspan='2'>wide</td></tr><tr><td>"), key, F.lit("</td><td>x</td></tr></TABLE></html>"))
    return c.select(F.concat(F.lit("c"), key).alias("doc"), page.alias("html"))


GRID_SQL = """grid AS (SELECT 'c' || c_custkey AS doc, * FROM customer),
cells AS (SELECT doc, 'Ark1' AS sheet, 0 AS row_idx, 1 AS col_idx, 'Balance & more' AS value, true AS is_header FROM grid UNION ALL SELECT doc, 'Ark1', 0, 0, NULL, true FROM grid
UNION ALL SELECT doc, 'Ark1', 0, 2, 'Segment', true FROM grid UNION ALL SELECT doc, 'Ark1', 1, 0, 'Q1 ' || c_custkey, false FROM grid
UNION ALL SELECT doc, 'Ark1', 1, 1, printf('%.2f', c_acctbal), false FROM grid UNION ALL SELECT doc, 'Ark1', 1, 2, c_mktsegment, false FROM grid
UNION ALL SELECT doc, 'Ark1', 2, 0, 'Q2 ' || c_custkey, false FROM grid UNION ALL SELECT doc, 'Ark1', 2, 1, NULL, false FROM grid UNION ALL SELECT doc, 'Ark1', 2, 2, '<none>', false FROM grid
UNION ALL SELECT doc, 'Ark1_2', 0, 0, 'wide', false FROM grid UNION ALL SELECT doc, 'Ark1_2', 0, 1, 'wide', false FROM grid
UNION ALL SELECT doc, 'Ark1_2', 1, 0, CAST(c_custkey AS VARCHAR), false FROM grid UNION ALL SELECT doc, 'Ark1_2', 1, 1, 'x', false FROM grid)"""


@query("html_cells_s1", "doc:s sheet:s row_idx:i col_idx:i value:s is_header:b", f"WITH {GRID_SQL} SELECT * FROM cells")
def _(spark, d):
    return html.html_cells(_documents(spark, d))


@query("html_spans_s1", "doc:s sheet:s row_idx:i col_idx:i value:s is_header:b", """WITH c AS (SELECT 'c' || c_custkey AS doc, 1 + c_custkey % 5 AS k, * FROM customer),
r AS (SELECT *, unnest(range(k)) AS i FROM c),
h(y, x, v) AS (VALUES (0, 0, 'Area'), (0, 1, 'Power'), (0, 2, 'Power'), (0, 3, 'Power'), (1, 0, 'Area'), (1, 1, 'No'), (1, 2, 'Left'), (1, 3, 'Right'))
SELECT doc, 'html_table_0' AS sheet, y AS row_idx, x AS col_idx, v AS value, true AS is_header FROM c, h
UNION ALL SELECT doc, 'html_table_0', 2 + i, 0, 'N' || c_custkey, false FROM r UNION ALL SELECT doc, 'html_table_0', 2 + i, 1, CAST(i AS VARCHAR), false FROM r
UNION ALL SELECT doc, 'html_table_0', 2 + i, 2, c_mktsegment, false FROM r UNION ALL SELECT doc, 'html_table_0', 2 + i, 3, c_mktsegment, false FROM r
UNION ALL SELECT doc, 'html_table_0', 2 + k, 0, 'S inner', false FROM c UNION ALL SELECT doc, 'html_table_1', 0, 0, 'inner', false FROM c""")
def _(spark, d):
    """One document per customer: a cell over one to five rows, one over rows and columns, a nested table, a span beyond the end."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", (F.col("c_custkey") % 5 + 1).cast("int").alias("k"))
    k = F.col("k").cast("string")
    more = F.array_join(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.concat(F.lit("<tr><td>"), i.cast("string"), F.lit("</td></tr>"))), "")
    first = F.concat(F.lit("<tr><th rowspan="), k, F.lit(">N"), F.col("c_custkey"), F.lit("<td>0<td rowspan='"), k, F.lit("' colspan=2>"), F.col("c_mktsegment"), F.lit("</td></tr>"))
    page = F.concat(
        F.lit('<table><thead><tr><th rowspan="9">Area</th><th colspan="3">Power</th></tr><tr><th>No<th>Left<th>Right</thead><tbody>'), first,
        F.substring_index(more, "<tr><td>0</td></tr>", -1), F.lit("<tr><td rowspan=3>S<table><tr><td>inner</td></tr></table></td></tr></table>"))
    return html.html_cells(c.select(F.concat(F.lit("c"), "c_custkey").alias("doc"), page.alias("html")))


@query("container_sniff_s2", "is_html:b n:i", "SELECT true AS is_html, count(*) AS n FROM pages WHERE regexp_matches(substr(html, 1, 500), '<html|<!doctype html|<table', 'i') UNION ALL SELECT false, count(*) FROM documents WHERE NOT regexp_matches(substr(text, 1, 500), '<html|<!doctype html|<table', 'i')")
def _(spark, d):
    pages = table(spark, d, "pages").select(F.encode("html", "UTF-8").alias("content"))
    docs = table(spark, d, "documents").select(F.encode("text", "UTF-8").alias("content"))
    return pages.unionByName(docs).groupBy(html.looks_like_html(F.col("content")).alias("is_html")).agg(F.count(F.lit(1)).alias("n"))


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("file_listing_s3", "doc:s publisher:s has_size:b", " UNION ALL ".join(f"SELECT '{t}.parquet' AS doc, '_root' AS publisher, true AS has_size" for t in TABLES))
def _(spark, d):
    return html.list_files(spark, d, "*.parquet").select("doc", "publisher", (F.col("n_bytes") > 0).alias("has_size"))


@query("source_listing_s3_k5", "doc:s publisher:s has_size:b digest_length:i", " UNION ALL ".join(f"SELECT '{t}.parquet' AS doc, '_root' AS publisher, true AS has_size, 64 AS digest_length" for t in TABLES))
def _(spark, d):
    files = html.list_documents(spark, d, "*.parquet")
    return files.select("doc", "publisher", (F.col("n_bytes") > 0).alias("has_size"), F.length("sha256").alias("digest_length"))


@query("optional_scan_s4_s6", "s_suppkey:i s_acctbal:2", "SELECT s_suppkey, s_acctbal FROM supplier")
def _(spark, d):
    missing = tables.read_optional(spark, f"{d}/not_there.parquet")
    return missing if missing is not None else tables.read_optional(spark, f"{d}/supplier.parquet").select("s_suppkey", "s_acctbal")


CATALOG_SQL = " UNION ALL ".join(f"SELECT '{t}' AS sheet_id, (SELECT count(*) FROM {t}) AS n_rows, (SELECT count(*) FROM (DESCRIBE {t})) AS n_cols" for t in TABLES)


@query("catalog_scan_s5", "sheet_id:s n_rows:i n_cols:i", CATALOG_SQL)
def _(spark, d):
    base, name = d.rstrip("/").rsplit("/", 1)
    return tables.catalog(spark, base, name)


@query("latest_run_s7", "o_orderpriority:s n:i", """WITH r AS (SELECT o_orderpriority, 'run-' || year(o_orderdate) AS run_id FROM orders)
SELECT o_orderpriority, count(*) AS n FROM r WHERE run_id = (SELECT max(run_id) FROM r) GROUP BY 1""")
def _(spark, d):
    runs = table(spark, d, "orders").select("o_orderpriority", F.concat(F.lit("run-"), F.year("o_orderdate")).alias("run_id"))
    return tables.latest_run_rows(runs).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("header_detection_d1_d2", "sheet:s header_row:i detected:b", "SELECT c_name AS sheet, 2 AS header_row, true AS detected FROM customer")
def _(spark, d):
    """One sheet per customer: a title, a note across the row, the header, then four rows of numbers."""
    c = table(spark, d, "customer")

    def row(i, cells):
        return [F.struct(F.lit(i).alias("row_idx"), F.lit(k).alias("col_idx"), v.cast("string").alias("value")) for k, v in enumerate(cells)]

    blank, note = F.lit(None).cast("string"), F.lit("same note everywhere")
    numbers = [F.col("c_custkey"), F.col("c_nationkey"), F.col("c_acctbal")]
    rows = [*row(0, [F.lit("2024"), blank, blank]), *row(1, [note] * 3), *row(2, [F.lit("Key"), F.lit("Place"), F.lit("Balance")])]
    for i in range(3, 7):
        rows += row(i, numbers)
    return grid.header_rows(c.select(F.col("c_name").alias("sheet"), F.inline(F.array(*rows))), ["sheet"])


@query("header_anywhere_d1_d2", "sheet:s header_row:i detected:b", "SELECT c_name AS sheet, 1 + c_custkey % 500 AS header_row, true AS detected FROM customer")
def _(spark, d):
    """One sheet per customer: one to 500 rows of notes by key, the header of 203 columns or three, then rows of numbers."""
    c = spread(table(spark, d, "customer").select("c_name", "c_custkey", "c_nationkey", "c_acctbal", (F.col("c_custkey") % 500 + 1).cast("int").alias("k")))
    wide = F.when(F.col("c_custkey") % 100 == 0, 203).otherwise(3)
    rows = c.withColumn("wide", wide).select("*", F.explode(F.sequence(F.lit(0), F.col("k") + 7)).alias("row_idx"))
    cells_ = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("col_idx"))
    header = F.concat(F.lit("Column "), F.col("col_idx"))
    value = F.when(F.col("row_idx") < F.col("k"), F.when(F.col("col_idx") == 0, F.concat(F.lit("Note "), "row_idx"))).when(
        F.col("row_idx") == F.col("k"), header).otherwise(F.format_string("%.2f", F.col("c_acctbal") + F.col("col_idx")))
    return grid.header_rows(cells_.select(F.col("c_name").alias("sheet"), "row_idx", "col_idx", value.alias("value")), ["sheet"])


@query("metadata_anywhere_d4", "sheet:s n_labels:i meta_last_row:i", """SELECT s_name AS sheet, 5 AS n_labels, s_suppkey % 60 + 14 AS meta_last_row FROM supplier""")
def _(spark, d):
    """Per supplier a body with up to 59 rows of text, a block of five labels with notes between them, and a label among the data."""
    x = spread(table(spark, d, "supplier").select(F.col("s_name").alias("sheet"), (F.col("s_suppkey") % 60).cast("int").alias("k"), "s_acctbal"))
    rows = x.select("*", F.explode(F.sequence(F.lit(0), F.col("k") + 20)).alias("body_row"))
    at = F.col("body_row") - F.col("k")
    first = F.when(at == 0, "Title").when(at == 1, "CDID").when(at == 2, "Unit").when(at == 8, "Release date").when(at == 14, "Next release").when(at == 18, "unit").when(at > 14, F.concat(F.lit("19"), at)).otherwise("text")
    second = F.when(at > 14, F.format_string("%.2f", "s_acctbal")).otherwise("words")
    cells_ = rows.select("sheet", "body_row", F.inline(F.array(
        F.struct(F.lit(0).alias("col_idx"), first.alias("value")), F.struct(F.lit(1).alias("col_idx"), second.alias("value")))))
    return grid.metadata_split(land(cells_), ["sheet"])


@query("sheet_body_d3_w10", "doc:s column:s n:i", f"""WITH {GRID_SQL} SELECT doc, 'unnamed_0' AS "column", 2 AS n FROM grid UNION ALL SELECT doc, 'balance_more', 2 FROM grid UNION ALL SELECT doc, 'segment', 2 FROM grid
UNION ALL SELECT doc, 'wide', 1 FROM grid UNION ALL SELECT doc, 'wide_2', 1 FROM grid""")
def _(spark, d):
    body, _ = grid.split_sheets(land(html.html_cells(_documents(spark, d))), ["doc", "sheet"])
    return body.groupBy("doc", "column").agg(F.count(F.lit(1)).alias("n"))


def _series_sheets(spark, d) -> DataFrame:
    """Per supplier a sheet with a three-line metadata block above two data rows."""
    x = table(spark, d, "supplier").select(F.col("s_name").alias("sheet"), "s_suppkey", "s_acctbal")

    def cell(row, col, value):
        return F.struct(F.lit(row).alias("row_idx"), F.lit(col).alias("col_idx"), value.cast("string").alias("value"), F.lit(row == 0).alias("is_header"))

    rows = [("Label", F.lit("Value")), ("Title", F.col("s_suppkey")), ("CDID", F.lit("ABC")), ("Unit", F.lit("GBP")), ("2001", F.col("s_acctbal")), ("2002", F.col("s_suppkey")), ("", F.lit(""))]
    cells_ = F.array(*[cell(i, c, F.lit(a) if c == 0 else v) for i, (a, v) in enumerate(rows) for c in (0, 1)])
    return x.select("sheet", F.inline(cells_)).withColumn("value", F.nullif("value", F.lit("")))


@query("metadata_split_d4", "sheet:s part:s row_idx:i value:s", """SELECT s_name AS sheet, 'data' AS part, 0 AS row_idx, '2001' AS value FROM supplier UNION ALL SELECT s_name, 'data', 1, '2002' FROM supplier
UNION ALL SELECT s_name, 'meta', 1, 'Title' FROM supplier UNION ALL SELECT s_name, 'meta', 2, 'CDID' FROM supplier UNION ALL SELECT s_name, 'meta', 3, 'Unit' FROM supplier""")
def _(spark, d):
    body, meta = grid.split_sheets(land(_series_sheets(spark, d)), ["sheet"])
    pick = lambda df, name: df.where(F.col("col_idx") == 0).select("sheet", F.lit(name).alias("part"), "row_idx", "value")
    return pick(body, "data").unionByName(pick(meta, "meta"))


@query("csv_number_format_k2", "c_custkey:i text:s", "SELECT c_custkey, printf('%.6g', c_acctbal) AS text FROM customer")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("text"))
    return sinks.csv_view(c, 6)


@query("typed_reference_s9_k2", "year:i cpi_index_2024_base:4", """SELECT year(o_orderdate) AS year, 50.0 + count(DISTINCT o_custkey) / 7.0 AS cpi_index_2024_base FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def _(spark, d):
    """A price index written as CSV, with rows that lack a year or a number, and read back with its types."""
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'")
    index = o.groupBy(F.year("o_orderdate").cast("string").alias("year")).agg((50.0 + F.count_distinct("o_custkey") / 7.0).alias("cpi_index_2024_base"))
    gaps = o.limit(2).select(F.lit(None).cast("string").alias("year"), F.lit(1.0).alias("cpi_index_2024_base")).unionByName(
        o.limit(1).select(F.lit("1990").alias("year"), F.lit(None).cast("double").alias("cpi_index_2024_base")))
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/reference-{uuid4().hex}"
    sinks.write_csv(index.unionByName(gaps), f"{path}/cpi.csv", digits=12)
    return tables.load_cpi(spark, f"{path}/cpi.csv").unionByName(tables.load_cpi(spark, f"{path}/absent.csv"))


@query("metadata_sidecar_k3", "sheet:s row_idx:i value:s", "SELECT s_name AS sheet, r AS row_idx, v AS value FROM supplier, (VALUES (1, 'Title'), (2, 'CDID'), (3, 'Unit')) AS x(r, v)")
def _(spark, d):
    """The rows above the data written beside a table and read back."""
    _, meta = grid.split_sheets(land(_series_sheets(spark, d)), ["sheet"])
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/sidecar-{uuid4().hex}"
    sinks.write_metadata(meta.where("col_idx = 0").select("sheet", "row_idx", "value"), f"{root}/pub/all__metadata.csv")
    return tables.load_metadata(spark, root, "pub", "all").toDF("sheet", "row_idx", "value")


@query("metadata_rows_k3", "n_sheets:i n_cells:i", "SELECT count(*) AS n_sheets, 6 * count(*) AS n_cells FROM supplier")
def _(spark, d):
    _, meta = grid.split_sheets(land(_series_sheets(spark, d)), ["sheet"])
    return meta.agg(F.count_distinct("sheet").alias("n_sheets"), F.count(F.lit(1)).alias("n_cells"))


@query("run_manifest_k4", "workbook:s rows_in:i rows_out:i issues_raised:i output_stem:s", """SELECT 'lines/' || o_orderpriority || '.xls' AS workbook, count(*) AS rows_in, count(*) FILTER (WHERE o_orderstatus = 'F') AS rows_out,
count(DISTINCT o_orderstatus) AS issues_raised, replace(o_orderpriority, ' ', '_') || '__Main_sheet' AS output_stem FROM orders GROUP BY 1, 5""")
def _(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("lines/"), "o_orderpriority", F.lit(".xls")).alias("workbook"), F.lit("Main sheet").alias("sheet"), "o_orderstatus")
    shape = lambda df: df.groupBy("workbook", "sheet").agg(F.count(F.lit(1)).alias("n_rows"), F.lit(6).alias("n_cols"))
    return sinks.run_manifest(shape(o), shape(o.where(F.col("o_orderstatus") == "F")), o.distinct())


@query("row_checksums_k5", "l_returnflag:s n_rows:i stable:b", "SELECT l_returnflag, count(*) AS n_rows, true AS stable FROM lineitem GROUP BY 1")
def _(spark, d):
    line = table(spark, d, "lineitem")
    one = sinks.row_checksums(line, ["l_returnflag"])
    again = sinks.row_checksums(line.repartition(7), ["l_returnflag"]).select(F.col("l_returnflag"), F.col("content_hash").alias("again"))
    return one.join(again, "l_returnflag").withColumn("stable", F.col("content_hash") == F.col("again"))


@query("issue_summary_k6", "issue_code:s n_issues:i rows_affected:i", f"""SELECT issue_code, count(*) AS n_issues, sum(rows_affected) AS rows_affected FROM ({cells.ISSUES_SQL}) WHERE rows_affected > 0 GROUP BY 1""")
def _(spark, d):
    from workload.briefs import _issues

    return sinks.issue_summary(_issues(spark, d))


@query("written_and_read_back_k1_s6", "country:s n:i gwh:2", f"WITH {s.COUNTRY_SQL} SELECT country, count(*) AS n, sum(gwh) AS gwh FROM country GROUP BY 1")
def _(spark, d):
    landed = land(s.country(spark, d))
    return landed.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.sum("electricity_generation_gwh").alias("gwh"))
