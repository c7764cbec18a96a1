"""HTML tables to a cell grid, all documents in one job.

The grid is (doc, sheet, row_idx, col_idx, value, is_header): thousands of
tables with different columns fit in one DataFrame.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from statloom.sources import landing

HELD_BYTES = 64 * 1024 * 1024  # a longer file is not held as one value for its checksum
STREAMS = 8  # files read at once for their checksums

# Named entities seen in exported tables.
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
    ("&apos;", "'"), ("&pound;", "£"), ("&euro;", "€"), ("&amp;", "&"),
)


def _files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    inside = F.regexp_replace(F.col("path"), "^.*?" + _literal(root.rstrip("/")) + "/+", "")
    return found.withColumn("doc", inside)


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Files below ``root``: path, publisher (first folder) and size, from file metadata alone; nothing is read of them."""
    parts = F.split("doc", "/")
    return _files(spark, root, glob).select("doc", F.when(F.size(parts) > 1, parts[0]).otherwise(F.lit("_root")).alias("publisher"), F.col("length").alias("n_bytes"))


def list_documents(spark: SparkSession, root: str, glob: str = "*.xls") -> DataFrame:
    """As ``list_files``, with checksum and content: for documents, each of which is one value.

    Checksums are right for files of any size: those above ``HELD_BYTES`` are streamed. Their content is read only where it is
    asked for.
    """
    parts = F.split("doc", "/")
    most = min(HELD_BYTES, int(spark.conf.get("spark.sql.sources.binaryFile.maxLength")))
    files = _files(spark, root, glob)
    long = files.where(F.col("length") > most)
    digests = streamed_digests(spark, [r["path"] for r in long.select("path").collect()])
    held = files.where(F.col("length") <= most).withColumn("sha256", F.sha2("content", 256))
    both = held.unionByName(long.join(spark.createDataFrame(digests, "path string, sha256 string"), "path")) if digests else held
    return both.select(
        "doc", F.when(F.size(parts) > 1, parts[0]).otherwise(F.lit("_root")).alias("publisher"), F.col("length").alias("n_bytes"), "sha256", "content")


def streamed_digests(spark: SparkSession, paths: list[str]) -> list[tuple[str, str]]:
    """(path, sha256) of files of any size in any store that Spark reads.

    A sha256 is one pass over its file, and Spark's readers give a file out whole or not at all, so the driver's JVM reads
    these files in small pieces, ``STREAMS`` at once, and holds none of them.
    """
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()

    def digest(name: str) -> tuple[str, str]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        stream = jvm.java.io.BufferedInputStream(path.getFileSystem(conf).open(path), 1 << 20)
        try:
            return name, jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()

    with ThreadPoolExecutor(STREAMS) as pool:
        return [*pool.map(digest, paths)]


def _literal(text: str) -> str:
    return r"\Q" + text + r"\E"


def looks_like_html(content: Column) -> Column:
    """True if the text has an HTML or table tag."""
    # Latin-1 gives every byte a character, so a cut inside a UTF-8 letter does no harm.
    head = F.lower(F.decode(content, "ISO-8859-1"))
    return head.rlike("<html|<!doctype html|<table")


def decode_text(content: Column) -> Column:
    """UTF-8 text without a byte order mark; broken bytes become replacement characters."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^\ufeff", "")


def numbered_entities(t: Column) -> Column:
    """Decimal and hexadecimal character references decoded, each different one once; numbers of no character stay.

    An ampersand becomes ``&amp;``, so that the names, decoded afterwards, do not read it as their own.
    """
    found = F.array_distinct(F.regexp_extract_all(t, F.lit(r"&#(?:[xX]0*[0-9a-fA-F]{1,6}|0*[0-9]{1,7});"), F.lit(0)))

    def decoded(text: Column, mark: Column) -> Column:
        body = F.regexp_extract(mark, r"&#([^;]+);", 1)
        hexadecimal = F.lower(body).startswith("x")
        code = F.when(hexadecimal, F.conv(F.substr(body, F.lit(2)), 16, 10)).otherwise(body).try_cast("long")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(valid, F.replace(text, mark, F.when(code == 38, F.lit("&amp;")).otherwise(char))).otherwise(text)

    return F.when(t.contains("&#"), F.aggregate(found, t, decoded)).otherwise(t)


def cell_text(c: Column) -> Column:
    """Text of one cell: tags out, entities decoded, blanks collapsed."""
    t = F.regexp_replace(c, r"(?is)^<t[dh]\b[^>]*>", "")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    t = numbered_entities(t)
    for name, char in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def sheet_names(html: Column, n_tables: Column) -> Column:
    """One name per table from the sheet markers; repeats get _2, _3, …"""
    marks = F.regexp_extract_all(html, F.lit(r"(?i)<x:Name>([^<]+)</x:Name>"), F.lit(1))
    places = F.when(n_tables > 0, F.sequence(F.lit(0), n_tables - 1)).otherwise(F.array().cast("array<int>"))
    base = F.transform(
        places,
        lambda i: F.coalesce(
            F.nullif(F.trim(F.regexp_replace(F.get(marks, i), r"\s+", " ")), F.lit("")),
            F.concat(F.lit("html_table_"), i.cast("string")),
        ),
    )

    def unique(name: Column, i: Column) -> Column:
        earlier = F.size(F.filter(F.slice(base, F.lit(1), i), lambda other: other == name))
        return F.when(earlier > 0, F.concat(name, F.lit("_"), (earlier + 1).cast("string"))).otherwise(name)

    return F.transform(base, unique)


TABLE_MARKS = r"(?i)</?(?:table|thead|tbody|tfoot|tr|td|th|caption|colgroup|col)\b[^>]*>"
# Limits of the HTML standard for the two attributes.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def table_pieces(html: Column) -> Column:
    """struct(open, n, out): the text cut at table tags, and for each piece the tables it stands in.

    Tables are numbered in the order of their start tags. A piece inside a nested table belongs to it as it is, and to the
    tables around it as plain text, without marks of rows and cells. A table that is not closed ends with the text.
    """
    pieces = F.split(html, r"(?i)(?=<table\b|</table\s*>)")
    empty = F.struct(
        F.array().cast("array<int>").alias("open"), F.lit(0).alias("n"), F.array().cast("array<struct<t:int,s:string>>").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        opens = piece.rlike(r"(?i)^<table\b")
        closes = piece.rlike(r"(?i)^</table\s*>")
        inside = F.when(opens, F.concat(acc["open"], F.array(acc["n"]))).when(
            closes, F.slice(acc["open"], F.lit(1), F.greatest(F.size(acc["open"]) - 1, F.lit(0)))).otherwise(acc["open"])
        text = F.regexp_replace(piece, r"(?i)^</table\s*>", " ")
        plain = F.regexp_replace(text, TABLE_MARKS, " ")
        return _let(inside, lambda now: F.struct(
            now.alias("open"), (acc["n"] + F.when(opens, 1).otherwise(0)).alias("n"),
            F.concat(acc["out"], F.transform(now, lambda t, i: F.struct(t.alias("t"), F.when(i == F.size(now) - 1, text).otherwise(plain).alias("s")))).alias("out")))

    return F.aggregate(pieces, empty, step)


def span_of(cell: Column, name: str, most: int) -> Column:
    found = F.regexp_extract(cell, rf"""(?i)^<t[dh]\b[^>]*?\b{name}\s*=\s*["']?\s*([0-9]+)""", 1)
    return F.least(F.greatest(F.coalesce(F.when(found != "", F.coalesce(found.try_cast("int"), F.lit(most))), F.lit(1)), F.lit(1)), F.lit(most))


def row_units(row: Column) -> Column:
    """Cells of a row, each as often as it is wide: array of struct(v, rows)."""
    cells = F.transform(
        F.slice(F.split(row, r"(?i)(?=<t[dh]\b)"), 2, 100_000_000),
        lambda cell: F.regexp_replace(cell, r"(?is)</t[dh]\b.*$", ""))
    return F.flatten(F.transform(cells, lambda cell: F.array_repeat(
        F.struct(F.nullif(cell_text(cell), F.lit("")).alias("v"), span_of(cell, "rowspan", MAX_ROWSPAN).alias("rows")), span_of(cell, "colspan", MAX_COLSPAN))))


def occupied_rows(rows: Column, n_head: Column) -> Column:
    """Places of the cells of a table whose cells may span rows: for each row an array of struct(c, v) without gaps.

    A fold over the rows carries the spans that are still open. They keep their columns; the row's own cells take the free
    columns from the left, and what stays free in between is blank. Open spans end with the header and with the table.
    ``rows`` is an array of arrays of struct(v, rows).
    """
    empty = F.struct(
        F.array().cast("array<struct<c:int,v:string,left:int>>").alias("open"), F.array().cast("array<array<struct<c:int,v:string>>>").alias("out"))
    numbered = F.transform(rows, lambda units, i: F.struct(i.alias("i"), units.alias("units")))

    def placed(opened: Column, units: Column) -> Column:
        free = F.array_except(F.sequence(F.lit(0), F.size(units) + F.size(opened)), F.transform(opened, lambda o: o["c"]))
        own = F.zip_with(F.slice(free, F.lit(1), F.size(units)), units, lambda c, u: F.struct(c.alias("c"), u["v"].alias("v"), (u["rows"] - 1).alias("left")))
        below = F.transform(opened, lambda o: F.struct(o["c"].alias("c"), o["v"].alias("v"), (o["left"] - 1).alias("left")))
        return F.concat(below, own)

    def without_gaps(cells: Column) -> Column:
        columns = F.transform(cells, lambda x: x["c"])
        gaps = F.array_except(F.sequence(F.lit(0), F.coalesce(F.array_max(columns), F.lit(0))), columns)
        filled = F.transform(cells, lambda x: F.struct(x["c"].alias("c"), x["v"].alias("v")))
        blank = F.transform(gaps, lambda c: F.struct(c.alias("c"), F.lit(None).cast("string").alias("v")))
        return F.when(F.size(cells) > 0, F.array_sort(F.concat(filled, blank))).otherwise(F.array().cast("array<struct<c:int,v:string>>"))

    def step(acc: Column, row: Column) -> Column:
        still = F.when(row["i"] == n_head, F.filter(acc["open"], lambda o: F.lit(False))).otherwise(acc["open"])
        return _let(_let(still, lambda opened: placed(opened, row["units"])), lambda cells: F.struct(
            F.filter(cells, lambda x: x["left"] > 0).alias("open"), F.concat(acc["out"], F.array(without_gaps(cells))).alias("out")))

    return F.aggregate(numbered, empty, step, lambda acc: acc["out"])


def html_cells(docs: DataFrame, doc: str = "doc", html: str = "html") -> DataFrame:
    """Explode every table of every document into cells. Blank cells are NULL.

    A cell that spans columns or rows stands in each of them. Nested tables are tables of their own, and text of the cell
    around them. End tags of rows and cells may be missing. Header rows are those of ``thead``, else the first rows
    that have header cells only. Documents are dealt out over all cores, as reading one costs far more than moving it.
    """
    texts = landing.spread(docs.select(F.col(doc).alias("doc"), F.col(html).alias("_html")).where(F.col("_html").rlike(r"(?i)<table\b")))
    # arrays of one element keep what is computed from being computed again for each use
    cut = texts.select("doc", "_html", F.explode(F.array(table_pieces(F.col("_html")))).alias("_p"))
    parts = F.transform(F.sequence(F.lit(0), F.col("_p.n") - 1), lambda t: F.array_join(
        F.transform(F.filter(F.col("_p.out"), lambda x: x["t"] == t), lambda x: x["s"]), ""))
    named = cut.select("doc", sheet_names(F.col("_html"), F.col("_p.n")).alias("_names"), parts.alias("_tables"))
    each = named.select("doc", "_names", F.posexplode("_tables").alias("_t", "_table"))
    head = F.regexp_extract("_table", r"(?is)<thead\b.*?(?:</thead|<tbody\b|$)", 0)
    lines = F.transform(
        F.slice(F.split("_table", r"(?i)(?=<tr\b)"), 2, 100_000_000), lambda row: F.regexp_replace(row, r"(?is)</tr\b.*$", ""))
    rows = each.select("doc", F.get("_names", F.col("_t")).alias("sheet"), F.regexp_count(head, F.lit(r"(?i)<tr\b")).alias("_marked"), F.explode(F.array(lines)).alias("_lines"))
    other = F.array_position(F.transform("_lines", lambda row: row.rlike(r"(?i)<th\b") & ~row.rlike(r"(?i)<td\b")), F.lit(False)).cast("int")
    leading = F.when(other == 0, F.size("_lines")).otherwise(other - 1)
    spread = rows.select(
        "doc", "sheet", F.when(F.col("_marked") > 0, F.col("_marked")).otherwise(leading).alias("_n_head"),
        F.explode(F.array(F.transform("_lines", row_units))).alias("_rows"))
    spans = F.exists("_rows", lambda row: F.exists(row, lambda u: u["rows"] > 1))
    plain = F.transform("_rows", lambda row: F.transform(row, lambda u, i: F.struct(i.alias("c"), u["v"].alias("v"))))
    placed = spread.select("doc", "sheet", "_n_head", F.posexplode(F.when(spans, occupied_rows(F.col("_rows"), F.col("_n_head"))).otherwise(plain)).alias("row_idx", "_cells"))
    return placed.select("doc", "sheet", "row_idx", (F.col("row_idx") < F.col("_n_head")).alias("is_header"), F.inline("_cells")).select(
        "doc", "sheet", "row_idx", F.col("c").alias("col_idx"), F.col("v").alias("value"), "is_header")


def read_html_tables(spark: SparkSession, root: str, glob: str = "*.xls") -> DataFrame:
    """Cell grid of every HTML document below ``root``."""
    docs = list_documents(spark, root, glob).where(looks_like_html(F.col("content")))
    return html_cells(docs.select("doc", decode_text(F.col("content")).alias("html")))
