from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from statloom.operators import cleaning, contract, grid
from statloom.plans import landing_run
from statloom.sources import contract as contract_source
from statloom.sources import html, sinks, tables
from statloom.sources.landing import land

SHEET = """<html><x:Name>Ark1</x:Name><x:Name>Ark1</x:Name><table><thead><tr><th></th><th>Gas &amp; oil</th><th>Gas-oil</th></tr></thead>
<tr><th scope="row">Q1 1998</th><td>1.5</td><td>[c]</td></tr><tr><th scope="row">Q2 1998</th><td>2.5</td><td>n/a</td></tr>
<tr><th scope="row">Q1 1999</th><td>4</td><td>3 [r]</td></tr></table><table><tr><td colspan="2">a</td></tr></table></html>"""


def test_html_cells_names_headers_and_spans(spark):
    docs = spark.createDataFrame([("d1", SHEET), ("d2", "no table")], "doc string, html string")
    cells = html.html_cells(docs).collect()
    assert {c["sheet"] for c in cells} == {"Ark1", "Ark1_2"}
    first = {(c["row_idx"], c["col_idx"]): c["value"] for c in cells if c["sheet"] == "Ark1"}
    assert first[(0, 1)] == "Gas & oil" and first[(0, 0)] is None and first[(3, 2)] == "3 [r]"
    assert [c["value"] for c in cells if c["sheet"] == "Ark1_2"] == ["a", "a"]
    assert {c["row_idx"] for c in cells if c["is_header"]} == {0}


def test_numbered_entities(spark):
    texts = ["&#8364;5 &#x20ac; &#x1F600;", "it&#39;s &#38;lt; &amp;#8364;", "&#38;#39;", "&#xD800; &#0; &#9999999; &#; &#x;", "a&#160;b", None]
    cells = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in cells.orderBy("i").select(html.cell_text(F.col("t"))).collect()]
    assert got == ["€5 € 😀", "it's &lt; &#8364;", "&#39;", "&#xD800; &#0; &#9999999; &#; &#x;", "a b", None]


def test_documents_to_cleaned_cells(spark, tmp_path):
    folder = tmp_path / "pub"
    folder.mkdir()
    (folder / "gen.xls").write_text(SHEET, encoding="utf-8-sig")
    (folder / "bad.xls").write_bytes(b"\xd0\xcf\x11\xe0binary")
    run = landing_run.run_cleaning(spark, str(tmp_path))
    cells = {(c["sheet"], c["row_idx"], c["column"]): c for c in run.cells.collect()}
    assert {k[2] for k in cells if k[0] == "Ark1"} == {"unnamed_0", "gas_oil", "gas_oil_2"}
    assert cells[("Ark1", 0, "gas_oil")]["number"] == 1.5
    assert cells[("Ark1", 0, "gas_oil_2")]["flag"] == "suppressed_confidential" and cells[("Ark1", 0, "gas_oil_2")]["value"] is None
    assert cells[("Ark1", 2, "gas_oil_2")]["value"] == "3" and cells[("Ark1", 2, "gas_oil_2")]["raw"] == "3 [r]"
    codes = {(i["column"], i["issue_code"]): i["rows_affected"] for i in run.issues.collect()}
    assert codes[("gas_oil_2", "footnote_marker_stripped")] == 2 and codes[("gas_oil_2", "placeholder_to_na")] == 1
    manifest = {r["sheet"]: r for r in run.manifest.collect()}
    assert (manifest["Ark1"]["rows_in"], manifest["Ark1"]["rows_out"], manifest["Ark1"]["output_stem"]) == (4, 3, "gen__Ark1")
    assert run.checksums.count() == 2
    columns = landing_run.sheet_columns(run.cells, "pub/gen.xls", "Ark1")
    assert landing_run.as_table(run.cells, "pub/gen.xls", "Ark1", columns).count() == 3


def as_grid(spark, rows):
    cells = [("s", r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)]
    return spark.createDataFrame(cells, "sheet string, row_idx int, col_idx int, value string")


def test_header_below_title_and_notes(spark):
    g = as_grid(spark, [["2024", None, None], ["note", "note", "note"], ["Area", "Count", "Share"], ["x", "1", "2"], ["y", "3", "4"], [None, None, None]])
    head = grid.header_rows(g, ["sheet"]).first()
    assert (head["header_row"], head["detected"]) == (2, True)
    body, meta = grid.split_sheets(g, ["sheet"])
    assert body.groupBy("row_idx").count().count() == 2 and {r["column"] for r in body.collect()} == {"area", "count", "share"}
    assert meta.where(F.col("value").isNotNull()).count() == 4


def test_metadata_block_is_split_off(spark):
    g = as_grid(spark, [["Label", "Value"], ["Title", "t"], ["CDID", "abc"], ["Unit", "m"], ["2001", "5"], ["2002", "6"]])
    body, meta = grid.split_sheets(g, ["sheet"])
    assert sorted(r["value"] for r in body.where("col_idx = 0").collect()) == ["2001", "2002"]
    assert sorted(r["value"] for r in meta.where("col_idx = 0").collect()) == ["CDID", "Title", "Unit"]


def test_colliding_headers_take_free_suffixes(spark):
    g = as_grid(spark, [["A b", "a-b", "a b 2", "A  B"], ["1", "2", "3", "4"]])
    body, _ = grid.split_sheets(g, ["sheet"])
    names = {r["col_idx"]: r["column"] for r in body.collect()}
    assert [names[i] for i in range(4)] == ["a_b", "a_b_2", "a_b_2_2", "a_b_3"]


def test_cleaned_table_keeps_provenance_only_where_needed(spark):
    rows = [(str(i), "usa" if i % 2 else "Wales", "12 [r]" if i == 3 else str(i), "19/04/2015") for i in range(20)]
    out = cleaning.clean_table(spark.createDataFrame(rows, "id string, area string, price string, day string"), "w", "s")
    assert set(out.table.columns) == {"id", "area", "price", "day", "price_flag", "day_iso_date", "raw__area", "raw__price"}
    assert dict(out.table.dtypes)["price"] == "double" and dict(out.table.dtypes)["id"] == "double"
    assert [(r["from_value"], r["to_value"], r["rows_affected"]) for r in out.log.collect()] == [("usa", "United States", 10)]


def test_nulls_survive_category_rewrite(spark):
    df = spark.createDataFrame([("usa",), ("usa",), (None,), ("Wales",)], "area string")
    assert sorted(str(r["area"]) for r in cleaning.clean_table(df, "w", "s").table.collect()) == ["None", "United States", "United States", "Wales"]


def test_contract_of_present_and_absent_tables(spark):
    text = "datasets:\n- {workbook: a.xlsx, sheet: S, publisher: p, required_columns: [x, z], min_rows: 5, max_null_pct: 10, numeric_columns: {x: {min: 0, max: 2, unit: MW}}}\n- {workbook: b.xlsx, sheet: T, publisher: p}\n"
    specs = contract_source.parse_contract(text)
    df = spark.createDataFrame([("1",), ("3",), (None,), ("-1",)], "x string")
    issues = contract.check_all({("p", "a__S"): df}, specs, spark).collect()
    got = {(i["workbook"], i["column"], i["rows_affected"]) for i in issues}
    assert got == {("a.xlsx", "z", 1), ("a.xlsx", "*", 1), ("a.xlsx", "*", 15), ("a.xlsx", "x", 2), ("b.xlsx", "*", 0)}


def test_written_tables_come_back_through_the_catalog(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, float("nan"))], "k int, v double")
    sinks.write_parquet(df, tables.table_path(str(tmp_path), "pub", "t"))
    row = tables.catalog(spark, str(tmp_path)).first()
    assert (row["publisher"], row["sheet_id"], row["n_rows"], row["n_cols"]) == ("pub", "t", 2, 2)
    sinks.write_parquet(df.where("k > 5"), tables.table_path(str(tmp_path), "other pub+é", "none 1"))
    df.write.partitionBy("k").parquet(tables.table_path(str(tmp_path), "pub", "parts"))
    found = {(r["publisher"], r["sheet_id"]): (r["n_rows"], r["n_cols"]) for r in tables.catalog(spark, str(tmp_path)).collect()}
    assert found == {("pub", "t"): (2, 2), ("other pub+é", "none 1"): (0, 2), ("pub", "parts"): (2, 2)}
    assert tables.catalog(spark, str(tmp_path), "pub").count() == 2 and tables.catalog(spark, str(tmp_path), "x").count() == 0
    assert {r["publisher"] for r in html.list_files(spark, str(tmp_path), "*.parquet").collect()} == {"pub", "other pub+é"}
    assert tables.load_table(spark, str(tmp_path), "pub", "t").where("v is null").count() == 1
    assert tables.load_table(spark, str(tmp_path), "pub", "absent") is None
    assert tables.reference_csv(spark, str(tmp_path / "no.csv"), tables.CPI_SCHEMA, ["year"]).count() == 0


@pytest.mark.parametrize("value,digits,want", [(0.1, 10, "0.1"), (123456789.125, 6, "1.23457e+08"), (1e-7, 10, "1e-07"), (-3.0, 6, "-3"), (0.0, 6, "0"), (1234.5678, 6, "1234.57")])
def test_general_number_format(spark, value, digits, want):
    df = spark.createDataFrame([(value,)], "x double")
    assert df.select(sinks.general_format(F.col("x"), digits).alias("t")).first()["t"] == want == f"%.{digits}g" % value


def test_rules_also_run_on_a_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("12 [c]",), ("n/a",)], "c string").coalesce(1).write.parquet(src)
    stream = cleaning.apply_rules(spark.readStream.schema("c string").parquet(src), {"c": F.lit(False)})
    q = stream.select(F.col("`c.value`").alias("v")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).start(out)
    q.processAllAvailable()
    q.stop()
    assert {r["v"] for r in spark.read.parquet(out).collect()} == {"12", None}


def as_cells(spark, sheets):
    rows = [(s, r, f"c{c}", v) for s, body in sheets.items() for r, row in enumerate(body) for c, v in enumerate(row) if v != "-"]
    return spark.createDataFrame(rows, "sheet string, row_idx int, column string, value string")


def test_equal_rows_of_many_sheets(spark):
    sheets = {
        "two groups": [["a", "1"], ["b", "2"], ["a", "1"], ["b", "2"], ["a", "1"], ["c", "3"]],
        "blank and missing": [["a", None], ["a", "-"], [None, "a"], [None, None], [None, None]],
        "none": [["a", "b"], ["b", "a"], ["aa", None], [None, "aa"]],
        "swapped": [["x", "y"], ["y", "x"]],
    }
    found = {r["sheet"]: r["n_duplicate_rows"] for r in cleaning.duplicate_cells(as_cells(spark, sheets), ["sheet"]).collect()}
    assert found == {"two groups": 5, "blank and missing": 4}
    issues = cleaning.clean_cells(as_cells(spark, sheets), ["sheet"]).issues.where("issue_code = 'duplicate_row'").collect()
    assert {(i["workbook"], i["sheet"], i["column"], i["rows_affected"]) for i in issues} == {(s, s, "*", n) for s, n in found.items()}


def test_fingerprints_do_not_depend_on_the_order_of_cells(spark):
    cells = as_cells(spark, {"s": [[str(i), "x", str(i % 3)] for i in range(200)] * 2})
    one = {tuple(r) for r in cleaning.row_fingerprints(cells, ["sheet"]).collect()}
    assert one == {tuple(r) for r in cleaning.row_fingerprints(cells.orderBy(F.rand(1)).repartition(7), ["sheet"]).collect()}
    assert len({r[2] for r in one}) == 200
    assert cleaning.duplicate_cells(cells, ["sheet"]).first()["n_duplicate_rows"] == 400


def test_a_run_lists_equal_rows_read_errors_and_examples(spark, tmp_path):
    folder = tmp_path / "pub"
    folder.mkdir()
    rows = "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in [("x", "41 °F"), ("y", "50 °F"), ("x", "41 °F"), ("z", "7")])
    (folder / "w.xls").write_text(f"<html><table><thead><tr><th>Area</th><th>Temp max</th></tr></thead>{rows}</table></html>")
    (folder / "bad.xls").write_bytes(b"\xd0\xcf\x11\xe0binary")
    issues = {(i["workbook"], i["issue_code"]): i for i in landing_run.run_cleaning(spark, str(tmp_path)).issues.collect()}
    assert issues["pub/w.xls", "duplicate_row"]["rows_affected"] == 2
    assert issues["pub/bad.xls", "read_error"]["confidence"] == "high"
    warm = issues["pub/w.xls", "temperature_f_to_c"]
    assert (warm["rows_affected"], warm["example_before"], warm["example_after"]) == (3, "41 °F", "5.0")


def test_categories_of_any_number_of_values(spark):
    rows = [(f"REGION NUMBER {i}", "UNITED STATES OF") for i in range(5000)]
    log = cleaning.clean_table(spark.createDataFrame(rows, "area string, one string"), "w", "s").log
    assert log.count() == 5000 and log.where("to_value = concat('Region Number ', substring(from_value, 15))").count() == 5000
    assert log.where("column = 'one'").count() == 0  # a single value is no category


def laid_out(spark, page):
    """Values by sheet, one list per row."""
    sheets = {}
    for c in html.html_cells(spark.createDataFrame([("d", page)], "doc string, html string")).orderBy("sheet", "row_idx", "col_idx").collect():
        rows = sheets.setdefault(c["sheet"], {})
        assert c["col_idx"] == len(rows.setdefault(c["row_idx"], []))
        rows[c["row_idx"]].append(c["value"])
    return {k: list(v.values()) for k, v in sheets.items()}


def test_row_spans_are_carried_down(spark):
    page = """<table><tr><td rowspan=3>a<td>b<td rowspan="2" colspan='2'>c</tr><tr><td>d</tr><tr><td>e<td>f<td>g<td>h</tr><tr><td>i</table>"""
    assert laid_out(spark, page)["html_table_0"] == [["a", "b", "c", "c"], ["a", "d", "c", "c"], ["a", "e", "f", "g", "h"], ["i"]]


def test_gaps_between_open_spans_are_blank(spark):
    page = "<table><tr><td>a<td>b<td rowspan=3>c</tr><tr><td>d</tr><tr></tr></table>"
    assert laid_out(spark, page)["html_table_0"] == [["a", "b", "c"], ["d", None, "c"], [None, None, "c"]]


def test_odd_span_numbers(spark):
    page = "<table><tr><td rowspan=0 colspan=0>a<td rowspan=x colspan=''>b<td rowspan=99999999999>c</tr><tr><td>d</tr></table>"
    assert laid_out(spark, page)["html_table_0"] == [["a", "b", "c"], ["d", None, "c"]]
    assert len(laid_out(spark, "<table><tr><td colspan=5000>a</table>")["html_table_0"][0]) == 1000


def test_spans_end_with_the_header(spark):
    page = "<table><thead><tr><th rowspan=5>h<th>k</tr></thead><tbody><tr><td>1<td>2</tr></tbody></table>"
    assert laid_out(spark, page)["html_table_0"] == [["h", "k"], ["1", "2"]]


def test_nested_and_open_tables(spark):
    page = "<table><tr><td>a<table><tr><td>b<td>c<table><tr><td>d</table></table> e<td>f</table> out <table><tr><td>g"
    assert laid_out(spark, page) == {"html_table_0": [["a b c d e", "f"]], "html_table_1": [["b", "c d"]], "html_table_2": [["d"]], "html_table_3": [["g"]]}


def test_header_rows_without_thead(spark):
    page = "<table><tr><th rowspan=2>a<th>b</tr><tr><th>c</tr><tr><th>x<td>1</tr></table>"
    cells = html.html_cells(spark.createDataFrame([("d", page)], "doc string, html string")).collect()
    assert {c["row_idx"] for c in cells if c["is_header"]} == {0, 1}


def test_long_table_with_spans(spark):
    n = 3000
    page = "<table>" + "".join(f"<tr>{f'<td rowspan=3>g{i}' if i % 3 == 0 else ''}<td>{i}" for i in range(n)) + "</table>"
    assert laid_out(spark, page)["html_table_0"] == [[f"g{i - i % 3}", str(i)] for i in range(n)]


def plain_scores(rows):
    def text(v):
        return v is not None and v.strip() != "" and not v.strip().translate(str.maketrans("", "", ",.-+")).isdigit()

    def number(v):
        try:
            return v is not None and float(v.translate(str.maketrans("", "", ",£$€")).strip()) is not None
        except ValueError:
            return False

    out, cols = {}, max(len(r) for r in rows)
    for i, row in enumerate(rows):
        filled, texts = sum(bool(v and v.strip()) for v in row), [v.strip().lower() for v in row if text(v)]
        below = rows[i + 1:i + 6]
        share = sum(number(v) for r in below for v in r) / (len(below) * cols) if below else 0.0
        if filled:
            out[i] = len(texts) / filled * (len(set(texts)) / max(len(texts), 1)) * (0.4 + share) * filled / 200
    return out


@pytest.mark.parametrize("chunk_rows", [1, 4, 5, 7, 1000])
def test_header_scores_do_not_depend_on_the_chunks(spark, chunk_rows):
    kinds = [["a", "b", "c"], ["note", "note", None], ["1", "2,000", "£3"], ["x", "4", "5"], [None, None, None], ["7", "-", "8.5"]]
    rows = [kinds[(i * i + i // 3) % 6] for i in range(60)]
    got = {r["row_idx"]: r["score"] for r in grid.header_scores(as_grid(spark, rows), ["sheet"], chunk_rows).collect()}
    assert got == pytest.approx(plain_scores(rows))


def test_wide_header_far_down(spark):
    rows = [["title"] + [None] * 259, ["text"] * 260, *[["remark"] + [None] * 259] * 40, [f"h{i}" for i in range(250)] + [None] * 10, *[["1"] * 260] * 3]
    assert grid.header_rows(as_grid(spark, rows), ["sheet"]).first()["header_row"] == 42


def body_of(spark, rows):
    return as_grid(spark, rows).withColumnRenamed("row_idx", "body_row")


@pytest.mark.parametrize("chunk_rows", [1, 5, 13, 1000])
@pytest.mark.parametrize(("labels", "numbers", "want"), [
    ({0: "Title", 1: "CDID", 2: "Unit"}, range(3, 40), (3, 2)),
    ({0: "Title", 5: "CDID", 11: "Unit", 13: "unit"}, range(12, 40), (3, 11)),  # a label below numbers, far down, is data
    ({0: "Title", 5: "CDID", 11: "Unit"}, range(1, 40), (3, 11)),  # in the first twelve rows labels always count
    ({30: "Title", 36: "CDID", 48: "Unit"}, range(49, 60), (3, 48)),
    ({30: "Title", 36: "CDID", 49: "Unit"}, range(50, 60), None),  # thirteen rows apart
    ({30: "Title", 31: "CDID", 32: "Unit"}, range(20, 60), None),  # numbers above the first label
    ({3: "Title", 9: "CDID"}, range(10, 30), None),
    ({i: "Unit" for i in range(0, 120, 10)}, range(111, 130), (12, 110)),
])
def test_metadata_blocks(spark, chunk_rows, labels, numbers, want):
    rows = [[labels.get(i, "words"), "5" if i in numbers else "words"] for i in range(130)]
    found = grid.metadata_split(body_of(spark, rows), ["sheet"], chunk_rows).first()
    assert (found and (found["n_labels"], found["meta_last_row"])) == want


CONTRACT = """
datasets:
- {workbook: w.xls, sheet: html_table_0, publisher: pub, required_columns: [area, region], min_rows: 9, max_null_pct: 20, numeric_columns: {power: {min: 0, max: 10, unit: MW}, x: {min: 1}}}
- {workbook: w.xls, sheet: html_table_0, publisher: other}
- {workbook: gone.xls, sheet: S}
"""


def test_a_run_checks_its_sheets_against_a_contract(spark, tmp_path):
    folder = tmp_path / "pub"
    folder.mkdir()
    rows = "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in [("x", "5"), ("y", "-3"), ("", "11"), ("z", ""), ("v", "12")])
    (folder / "w.xls").write_text(f"<html><table><thead><tr><th>Area</th><th>Power</th></tr></thead>{rows}</table></html>")
    run = landing_run.run_cleaning(spark, str(tmp_path), contract=CONTRACT)
    found = [i for i in run.issues.collect() if i["issue_code"] == "schema_contract_violation"]
    assert {(i["workbook"], i["column"], i["detail"], i["rows_affected"]) for i in found} == {
        ("w.xls", "region", "Columns not delivered: region", 1), ("w.xls", "*", "5 rows, agreed were 9 or more", 4),
        ("w.xls", "power", "Outside 0 to 10 [MW]: 1 too low, 2 too high", 3), ("w.xls", "*", "Expected table not found", 0),
        ("gone.xls", "*", "Expected table not found", 0),
    }  # 2 of 10 cells are blank: not above 20 per cent


def test_a_contract_that_cannot_be_read_is_an_issue(spark):
    cells = spark.createDataFrame([], "workbook string, sheet string, row_idx int, column string, value string")
    assert [i["issue_code"] for i in contract.contract_issues(cells, "a: [").collect()] == ["schema_registry_unreadable"]
    assert contract.contract_issues(cells, "").count() == 0


def test_cells_are_never_broadcast_however_small_their_files_are(spark):
    block = [["Title", "words"], ["CDID", "words"], ["Unit", "words"], *[["2001", "5"]] * 60]
    rows = [(r, c, v) for r, row in enumerate(block) for c, v in enumerate(row)]
    sheets = spark.range(2000).select(F.concat(F.lit("sheet number "), "id").alias("sheet"), F.inline(F.array(
        *[F.struct(F.lit(r).alias("body_row"), F.lit(c).alias("col_idx"), F.lit(v).alias("value")) for r, c, v in rows])))
    found = grid.metadata_split(land(sheets), ["sheet"])
    assert {(r["n_labels"], r["meta_last_row"]) for r in found.collect()} == {(3, 2)}
    found._jdf.queryExecution().executedPlan().execute()  # the plan is settled while it runs
    assert "BuildLeft" not in found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_header_scores_gather_no_cells_of_a_row(spark):
    rows = [["A", " a", "b", None], ["1", "2", "3", "x"], ["4", "", "6", "7"]]
    found = grid.header_scores(as_grid(spark, rows), ["sheet"])
    assert {r["row_idx"]: r["score"] for r in found.collect()} == pytest.approx(plain_scores(rows))
    assert "collect_set" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_file_of_many_rows_is_dealt_out_before_costly_work(spark):
    docs = spark.createDataFrame([(f"d{i}", SHEET) for i in range(200)], "doc string, html string").coalesce(1)
    cells = html.html_cells(docs)
    assert cells.rdd.getNumPartitions() > 1
    assert cells.count() == 200 * html.html_cells(docs.limit(1)).count()
    ruled = cleaning.land_ruled(spark.range(500).coalesce(1).select(F.lit("c").alias("column"), F.concat("id", F.lit(" kg")).alias("cell")), F.lit(False), ["column"])
    assert len(ruled.inputFiles()) > 1 and ruled.count() == 500


def test_table_rules_see_equal_cells_once(spark, monkeypatch):
    ruled, asked, ways = [], [], []
    land_ruled, outliers = cleaning.land_ruled, cleaning.log_mad_outliers

    def spy(*args):
        ruled.append(land_ruled(*args))
        return ruled[-1]

    def way(values, keys, small=None):
        ways.append(small)
        return outliers(values, keys, small)

    monkeypatch.setattr(cleaning, "land_ruled", spy)
    monkeypatch.setattr(cleaning, "log_mad_outliers", way)
    monkeypatch.setattr(cleaning, "FEW_VALUES", 20, raising=False)
    cells = [None, "n/a", "5 kg", "7 [r]", "-999", "1000000", *[str(i) for i in range(1, 31)]]
    rows = [(cells[i % 36], "usa" if i % 36 < 9 else "Wales", "41 °F" if i % 36 < 4 else "50 °F") for i in range(720)]
    for k in (20, 10_000):
        monkeypatch.setattr(cleaning, "FEW_VALUES", k, raising=False)
        out = cleaning.clean_table(spark.createDataFrame(rows, "price_gbp string, area string, temp_max string"), "w", "s")
        got = {(r["column"], r["issue_code"]): r["rows_affected"] for r in out.issues.collect()}
        asked.append(got)
    assert ruled[0].count() == 36 + 2 + 2 and "SortAggregate" not in ruled[0].groupBy("column").agg(*cleaning.rule_counts("cell", "n"))._jdf.queryExecution().toString()
    assert ways == [False, True] and asked[0] == asked[1]
    assert asked[0] == {
        ("*", "duplicate_row"): 720, ("price_gbp", "placeholder_to_na"): 20, ("price_gbp", "unit_embedded_normalized"): 20,
        ("price_gbp", "footnote_marker_stripped"): 20, ("price_gbp", "numeric_sentinel"): 20, ("price_gbp", "outlier_robust_log_mad"): 40,  # 1 and 1000000
        ("price_gbp", "mixed_type_numeric_string"): 660,
        ("area", "categorical_canonicalized"): 180, ("temp_max", "temperature_f_to_c"): 720,
    }
    warm = out.issues.where("issue_code = 'temperature_f_to_c'").first()
    assert (warm["example_before"], warm["example_after"]) == ("41 °F", "5.0")
    assert {(r["from_value"], r["rows_affected"]) for r in out.log.collect()} == {("usa", 180)}


def test_checksums_of_files_too_long_for_one_value(spark, tmp_path, monkeypatch):
    folder = tmp_path / "a b+é"
    folder.mkdir()
    texts = {"long.xls": bytes(range(256)) * 4000, "zeros.xls": bytes(900_000), "short.xls": b"<table>"}
    for name, text in texts.items():
        (folder / name).write_bytes(text)
    monkeypatch.setattr(html, "HELD_BYTES", 1000, raising=False)
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "2000")  # Spark refuses to hold a longer file
    try:
        found = {r["doc"]: (r["publisher"], r["n_bytes"], r["sha256"]) for r in html.list_documents(spark, str(tmp_path)).drop("content").collect()}
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)
    assert found == {f"a b+é/{name}": ("a b+é", len(text), hashlib.sha256(text).hexdigest()) for name, text in texts.items()}
    assert {r["doc"]: bytes(r["content"]) for r in html.list_documents(spark, str(tmp_path)).collect()} == {f"a b+é/{name}": text for name, text in texts.items()}


def test_header_search_packs_cells_before_they_travel(spark, monkeypatch):
    draw = random.Random(5)
    kinds = [["a", "b", "A "], ["note", None, " "], ["1", "2,000", "£3"], ["x", "4", "1e5"], [None, None, None], ["7", "-", "8.5"], ["12", "e", "3.5 kg"]]
    sheets = {name: [draw.choice(kinds) for _ in range(draw.randrange(2, 40))] for name in (None, "", "a", "b", "c", "d")}
    sheets["given"] = [["Year", "Area", "Share"], *sheets["d"]]
    cells = [(s, r, c, v) for s, rows in sheets.items() for r, row in enumerate(rows) for c, v in enumerate(row)]
    shape = "sheet string, row_idx int, col_idx int, value string"
    in_order = land(spark.createDataFrame(cells, shape).coalesce(1))
    slim = in_order.select("sheet", F.col("row_idx").cast("long").alias("row_idx"), F.xxhash64("value").alias("_digest"), F.lit(0).alias("_is_number"))
    assert grid.pack_cells(slim, ["sheet"], 2000, 5).count() == len(sheets)
    draw.shuffle(cells)
    mixed = land(spark.createDataFrame(cells, shape).repartition(5))
    want = {s: plain_scores(rows) for s, rows in sheets.items()}
    for packed, at_once, chunk_rows in ((256, 500_000, 2000), (2, 7, 4), (1, 3, 50)):
        monkeypatch.setattr(grid, "PACKED", packed)
        monkeypatch.setattr(grid, "CELLS_AT_ONCE", at_once)
        monkeypatch.setattr(grid, "HEADER_CHUNK_ROWS", chunk_rows)
        for frame in (in_order, mixed):
            got = grid.header_scores(frame, ["sheet"], chunk_rows).collect()
            assert {s: {r["row_idx"]: r["score"] for r in got if r["sheet"] == s} for s in sheets} == {s: pytest.approx(x) for s, x in want.items()}
        heads = {r["sheet"]: (r["header_row"], r["detected"]) for r in grid.header_rows(mixed, ["sheet"]).collect()}
        assert set(heads) == set(sheets) and heads["given"] == (0, False)
        for s, (row, detected) in heads.items():
            assert not detected or (want[s][row], -row) >= max((x - 1e-12, -r) for r, x in want[s].items())
