"""Finding the table inside a sheet, for every sheet of a cell grid in one job.

A grid has key columns (``keys``), row_idx, col_idx and value (text, NULL = blank).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from statloom.functions.numbers import NUMBER_PATTERN, numeric_like, text_cell
from statloom.functions.text import snake_name
from statloom.operators.ordered import attach, only, with_halo
from statloom.sources.landing import land, unweighed

LOOK_AHEAD_ROWS = 5
HEADER_WIDTH_UNIT = 200.0
SUSPICIOUS_SHARE = 0.3
METADATA_REACH = 12
METADATA_MIN_LABELS = 3
CHUNK_ROWS = 100_000
HEADER_CHUNK_ROWS = 2_000
TASK_CELLS = 2_000_000  # filled cells for which a task more is taken
PACKED = 256  # cells that travel as one value
CELLS_AT_ONCE = 500_000  # cells that a task scores at once

# Labels of the block that precedes a published time series.
METADATA_LABELS = (
    "title", "cdid", "source dataset id", "preunit", "unit", "release date",
    "next release", "important notes", "important note", "key word",
)


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def suspicious_name(c: Column) -> Column:
    """A header cell that is blank, generated, a number or absurdly long."""
    t = F.trim(c)
    number = F.replace(t, F.lit(","), F.lit("")).rlike(NUMBER_PATTERN)
    return blank(c) | t.startswith("Unnamed:") | number | (F.length(t) > 100)


def sheet_facts(grid: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _rows, _cols, _cells, real_header, _marked), landed: size and filled cells of every sheet, whether row 0 holds
    genuine column names (NULL without a row 0) and the marked header row, all in one pass."""
    v = F.col("value")
    share = F.avg(F.when(F.col("row_idx") == 0, F.when(suspicious_name(v), 1.0).otherwise(0.0)))
    marked = F.max(F.when(F.col("is_header"), F.col("row_idx"))) if "is_header" in grid.columns else F.lit(None).cast("int")
    return land(grid.groupBy(*keys).agg(
        (F.max("row_idx") + 1).alias("_rows"), (F.max("col_idx") + 1).alias("_cols"), F.count_if(~blank(v)).alias("_cells"),
        (share < SUSPICIOUS_SHARE).alias("real_header"), marked.alias("_marked")))


def pack_cells(slim: DataFrame, keys: list[str], chunk_rows: int, after: int) -> DataFrame:
    """(keys, _chunk, _packed): runs of up to ``PACKED`` cells of one chunk of a sheet as one value.

    ``slim`` has keys, row_idx, _digest of a text and _is_number. A cell is its row in the chunk, what it is and its digest. Cells of
    the ``after`` rows below a chunk go to it too. Wherever the cells of a sheet stand in the frame, the result is the same but
    for the number of runs.
    """
    packed = PACKED
    cell = np.dtype([("row", "<i4"), ("kind", "u1"), ("digest", "<i8")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row = batch.column("row_idx").to_numpy()
            digest = batch.column("_digest")
            text = digest.is_valid().to_numpy(zero_copy_only=False)
            cells = np.empty(len(row), cell)
            cells["digest"] = digest.fill_null(0).to_numpy()
            cells["kind"] = text + 2 * batch.column("_is_number").to_numpy()
            changes = np.zeros(len(row), np.int32)
            for k in keys:
                changes[pc.run_end_encode(batch.column(k)).run_ends.to_numpy()[:-1]] = 1
            sheet = np.cumsum(changes, dtype=np.int32)
            home = row // chunk_rows
            back = home - np.minimum(home, np.maximum((row - after) // chunk_rows, 0))
            for step in range(int(back.max()) + 1):
                at = np.flatnonzero(back >= step)
                chunk = home[at] - step
                new = np.flatnonzero((np.diff(sheet[at]) != 0) | (np.diff(chunk) != 0)) + 1
                runs = np.r_[0, new, len(at)]
                starts = np.concatenate([np.arange(x, y, packed) for x, y in zip(runs[:-1], runs[1:])]) if (np.diff(runs) > packed).any() else runs[:-1]
                part = cells[at]
                part["row"] = row[at] - chunk * chunk_rows
                offsets = np.r_[starts, len(at)].astype(np.int32) * cell.itemsize
                blobs = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(part.tobytes())])
                first = pa.array(at[starts])
                yield pa.record_batch([*[batch.column(k).take(first) for k in keys], pa.array(chunk[starts]), blobs], names=[*keys, "_chunk", "_packed"])

    fields = [slim.schema[k] for k in keys]
    shape = T.StructType([*[T.StructField(f.name, f.dataType) for f in fields], T.StructField("_chunk", T.LongType()), T.StructField("_packed", T.BinaryType())])
    return slim.mapInArrow(pack, shape)


def score_chunks(sorted_cells: DataFrame, keys: list[str], chunk_rows: int, after: int, best: bool) -> DataFrame:
    """(keys, row_idx, _rows, score) of the rows of each chunk that have a filled cell, or of the first row with the best score of it.

    In each partition a chunk is one record with its _chunk and the sheet's _rows and _cols, followed by records of ``pack_cells``.
    Many chunks are scored at once; the cells of a chunk without end are added up as they come.
    """
    at_once, wide, unit = CELLS_AT_ONCE, chunk_rows + 2 * after, HEADER_WIDTH_UNIT
    cell = np.dtype([("row", "<i4"), ("kind", "u1"), ("digest", "<i8")])

    def added(place, digest, text, n, numbers):
        """Cells of one row with one text, or of one row without text, as one entry with counts, in order of place."""
        order = np.lexsort((digest, text, place))
        place, digest, text, n, numbers = (x[order] for x in (place, digest, text, n, numbers))
        starts = np.flatnonzero(np.r_[True, (np.diff(place) != 0) | (np.diff(digest) != 0) | (text[1:] != text[:-1])])
        return place[starts], digest[starts], text[starts], np.add.reduceat(n, starts), np.add.reduceat(numbers, starts)

    def scored(entries, chunk, rows, cols):
        """Number of the chunk, row and score; a place is the number of the chunk times ``wide`` plus the row in it."""
        place, digest, text, n, numbers = entries
        order = np.argsort(place, kind="stable")
        place, digest, text, n, numbers = (x[order] for x in (place, digest, text, n, numbers))
        starts = np.flatnonzero(np.r_[True, np.diff(place) != 0])
        filled, numeric = np.add.reduceat(n, starts), np.add.reduceat(numbers, starts)
        texts, distinct = np.add.reduceat(n * text, starts), np.add.reduceat(text.astype(np.int64), starts)
        several = np.flatnonzero(np.repeat(distinct > 1, np.diff(np.r_[starts, len(place)])) & text)
        if len(several):
            # rows with more than one text: equal ones count once
            where = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(place)]))[several]
            order = np.lexsort((digest[several], where))
            where, digests = where[order], digest[several][order]
            distinct[distinct > 1] = 0
            np.add.at(distinct, where[np.r_[True, (np.diff(where) != 0) | (np.diff(digests) != 0)]], 1)
        at = place[starts]
        below = np.zeros(len(at), np.int64)
        for k in range(1, after + 1):
            below[:-k] += np.where(at[k:] - at[:-k] <= after, numeric[k:], 0) if k < len(at) else 0
        own = at % wide < chunk_rows
        at, filled, texts, distinct, below = (x[own] for x in (at, filled, texts, distinct, below))
        group = at // wide
        row, size, across = at % wide + chunk[group] * chunk_rows, rows[group], cols[group]
        n_below = np.minimum(after, size - 1 - row)
        share = np.where(n_below > 0, below / np.where(n_below > 0, n_below * across, 1), 0.0)
        score = (texts / filled) * (distinct / np.maximum(texts, 1)) * (0.4 + share) * (filled / unit)
        if best and len(row):
            known = np.where(np.isnan(score), -np.inf, score)
            firsts = np.flatnonzero(np.r_[True, np.diff(group) != 0])
            top = np.repeat(np.maximum.reduceat(known, firsts), np.diff(np.r_[firsts, len(group)]))
            _, first = np.unique(group[known == top], return_index=True)
            kept = np.flatnonzero(known == top)[first]
            group, row, score = group[kept], row[kept], score[kept]
        return group, row, score

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = chunk = rows = cols = entries = None  # of the chunk that is still open
        kept = 0  # its entries when they were last added up

        def done(k: int):
            group, row, result = scored(tuple(x[entries[0] < k * wide] for x in entries), chunk, rows, cols)
            return pa.record_batch(
                [*[heads[key].take(pa.array(group)) for key in keys], pa.array(row), pa.array(rows[group]), pa.array(result, from_pandas=True)], names=[*keys, "row_idx", "_rows", "score"])

        for whole in batches:
            sizes = pc.binary_length(whole.column("_packed")).fill_null(0).to_numpy() // cell.itemsize
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // at_once)) + 1
            for x, y in zip([0, *cuts], [*cuts, whole.num_rows]):
                if x == y:
                    continue
                batch = whole.slice(x, y - x)
                head = batch.column("_rows").is_valid().to_numpy(zero_copy_only=False)
                open_ = 0 if chunk is None else len(chunk)
                number = np.cumsum(head) - 1 + open_
                new = batch.filter(pa.array(head))
                values = {k: new.column(k) for k in keys}
                parts = new.column("_chunk").to_numpy(), new.column("_rows").to_numpy(), new.column("_cols").cast(pa.float64()).to_numpy(zero_copy_only=False)
                if open_:
                    heads = {k: pa.concat_arrays([heads[k], values[k]]) for k in keys}
                    chunk, rows, cols = (np.concatenate(z) for z in zip((chunk, rows, cols), parts))
                else:
                    heads, (chunk, rows, cols) = values, parts
                cells = np.frombuffer(b"".join(batch.column("_packed").drop_null().to_pylist()), cell)
                place = np.repeat(number, sizes[x:y]) * wide + cells["row"]
                kind = cells["kind"]
                fresh = place, cells["digest"].copy(), (kind & 1).astype(bool), np.ones(len(cells), np.int64), (kind >> 1).astype(np.int64)
                entries = fresh if entries is None else tuple(np.concatenate(z) for z in zip(entries, fresh))
                k = len(chunk) - 1
                if k and (entries[0] < k * wide).any():
                    yield done(k)
                # the last chunk stays open
                left = entries[0] >= k * wide
                entries = (entries[0][left] - k * wide, *[z[left] for z in entries[1:]])
                heads, chunk, rows, cols = {key: z.slice(k) for key, z in heads.items()}, chunk[k:], rows[k:], cols[k:]
                kept = 0 if k else kept
                if len(entries[0]) > max(at_once, 2 * kept):
                    entries = added(*entries)
                    kept = len(entries[0])
        if entries is not None and len(entries[0]):
            yield done(1)

    fields = [T.StructField(k, sorted_cells.schema[k].dataType) for k in keys]
    shape = T.StructType([*fields, T.StructField("row_idx", T.LongType()), T.StructField("_rows", T.LongType()), T.StructField("score", T.DoubleType())])
    return sorted_cells.mapInArrow(score, shape)


def _scored(grid: DataFrame, keys: list[str], facts: DataFrame, chunk_rows: int, best: bool, some: bool = False) -> DataFrame:
    """Scores of the sheets in ``facts``; ``some``: the grid has others too."""
    v = F.col("value")
    spark = grid.sparkSession
    filled = facts.agg(F.coalesce(F.sum("_cells"), F.lit(0))).first()[0]
    if not filled:
        return spark.createDataFrame([], T.StructType([*[grid.schema[k] for k in keys], grid.schema["row_idx"], facts.schema["_rows"], T.StructField("score", T.DoubleType())]))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), filled // TASK_CELLS)
    # Blank cells count for the size only. The others travel once, packed, to the task of their chunk; whole sheets are told
    # apart there, so that no join and no aggregate sees single cells.
    lettered = v.rlike("[A-DF-Za-df-z]")  # a text and no number, as the longer rules would find
    slim = grid.where(~blank(v) & F.col("row_idx").isNotNull()).select(
        *keys, F.col("row_idx").cast("long").alias("row_idx"),
        F.when(F.when(lettered, True).otherwise(text_cell(v)), F.xxhash64(F.lower(F.trim(v)))).alias("_digest"),
        F.when(lettered, 0).otherwise(numeric_like(v).cast("int")).alias("_is_number"))
    packed = pack_cells(slim, keys, chunk_rows, LOOK_AHEAD_ROWS)
    packed = only(packed, facts, keys) if some else packed
    last = F.floor((F.col("_rows") - 1) / F.lit(chunk_rows))
    heads = facts.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_chunk"), F.col("_rows").cast("long").alias("_rows"), F.col("_cols").cast("long").alias("_cols"))
    both = heads.unionByName(packed, allowMissingColumns=True).repartition(tasks, *keys, "_chunk")
    scores = score_chunks(both.sortWithinPartitions(*keys, "_chunk", F.col("_rows").desc_nulls_last()), keys, chunk_rows, LOOK_AHEAD_ROWS, best)
    with unweighed(spark):  # records are of some 3 KB at most
        return land(scores.withColumns({c: F.col(c).cast(t) for c, t in (("row_idx", grid.schema["row_idx"].dataType), ("_rows", facts.schema["_rows"].dataType))}))


def header_scores(grid: DataFrame, keys: list[str], chunk_rows: int = HEADER_CHUNK_ROWS) -> DataFrame:
    """(keys, row_idx, _rows, score) for every row of every sheet that has a filled cell, landed.

    score = text density * distinct ratio * (0.4 + numeric share of the next five
    rows) * filled width. Rows are cut into chunks that share five rows with the
    next one, so a sheet of any length is spread over tasks. The grid is read twice: pass a landed or cheap one.
    """
    return _scored(grid, keys, sheet_facts(grid, keys), chunk_rows, False)


def _best_rows(scores: DataFrame, keys: list[str]) -> DataFrame:
    best = F.max(F.struct("score", (-F.col("row_idx")).alias("r"))).alias("_best")
    found = scores.groupBy(*keys).agg(best, F.max("_rows").alias("_rows"))
    return found.select(
        *keys, F.when(F.col("_rows") < 2, F.lit(0)).otherwise(-F.col("_best.r")).cast("int").alias("header_row")
    )


def detect_header_row(grid: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, header_row): the first row with the best score of the whole sheet; 0 for one-row sheets."""
    return _best_rows(_scored(grid, keys, sheet_facts(grid, keys), HEADER_CHUNK_ROWS, True), keys)


def header_rows(grid: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, header_row, detected): marked header, else a genuine row 0, else the detected row.

    Only sheets that have neither of the first two are searched, over all their rows. The grid is read twice: pass
    a landed or cheap one.
    """
    given = F.col("_marked").isNotNull() | F.coalesce(F.col("real_header"), F.lit(False))
    gate = sheet_facts(grid, keys).where(F.col("real_header").isNotNull()).withColumn("_given", given)
    some = not gate.where("_given").isEmpty()
    detected = _best_rows(_scored(grid, keys, gate.where("NOT _given"), HEADER_CHUNK_ROWS, True, some), keys)
    found = attach(gate, detected, keys, "left")
    row = F.coalesce("_marked", F.when(F.col("real_header"), F.lit(0)), "header_row", F.lit(0))
    return found.select(*keys, row.alias("header_row"), (~F.col("_given")).alias("detected"))


def trim_bounds(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, last_row, last_col) of the non-blank cells."""
    return cells.where(~blank(F.col("value"))).groupBy(*keys).agg(
        F.max("row_idx").alias("last_row"), F.max("col_idx").alias("last_col")
    )


def metadata_split(cells: DataFrame, keys: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(keys, meta_last_row, n_labels) where at least three known labels lead the first column.

    ``cells`` are the rows below the header, with ``body_row`` counted from 0. The block reaches from the top to the last
    label of a chain: each label at most twelve rows below the one before. Within the first twelve rows a label always
    counts; further down only if no row of numbers lies above it since the label before (for the first label: at all).
    So a block may start anywhere and be of any length, and a label among the data does not extend it.
    """
    label = F.lower(F.trim("value")).isin(*METADATA_LABELS) & (F.col("col_idx") == 0)
    enough = cells.where(label).groupBy(*keys).agg(F.count(F.lit(1)).alias("_labels")).where(F.col("_labels") >= METADATA_MIN_LABELS)
    near = only(cells, enough, keys)
    numeric = (F.col("col_idx") > 0) & numeric_like(F.col("value"))
    rows = near.groupBy(*keys, "body_row").agg(F.coalesce(F.bool_or(label), F.lit(False)).alias("_label"), F.coalesce(F.bool_or(numeric), F.lit(False)).alias("_number"))
    rows = rows.where("_label OR _number").select(
        *keys, "body_row", F.when(F.col("_label"), F.col("body_row")).alias("_at"), F.when(~F.col("_label"), F.col("body_row")).alias("_number_at"))
    back = W.partitionBy(*keys, "_chunk").orderBy("body_row").rangeBetween(-METADATA_REACH, -1)
    seen = with_halo(rows, "body_row", chunk_rows, before=METADATA_REACH).withColumns(
        {"_before": F.max("_at").over(back), "_number_before": F.max("_number_at").over(back)}).where("_own")
    plain = F.col("_number_before").isNull() | (F.col("_number_before") < F.col("_before"))
    linked = F.col("_before").isNotNull() & ((F.col("body_row") < METADATA_REACH) | plain)
    starts = seen.groupBy(*keys).agg(F.min("_at").alias("_first"), F.min("_number_at").alias("_first_number"))
    starts = starts.where((F.col("_first") < METADATA_REACH) | F.col("_first_number").isNull() | (F.col("_first_number") > F.col("_first")))
    labels = attach(seen.where(F.col("_at").isNotNull()).withColumn("_linked", linked), starts, keys)
    breaks = labels.where(~F.col("_linked") & (F.col("_at") > F.col("_first"))).groupBy(*keys).agg(F.min("_at").alias("_break"))
    chain = attach(labels, breaks, keys, "left").where(F.col("_break").isNull() | (F.col("_at") < F.col("_break")))
    found = chain.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_labels"), F.max("_at").alias("meta_last_row"))
    return found.where(F.col("n_labels") >= METADATA_MIN_LABELS)


def column_names(grid: DataFrame, headers: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, col_idx, column): snake-case names, repeats suffixed with the next free number.

    A blank cell of a given header is ``unnamed_<position>``, of a detected one ``column``.
    Only header cells are gathered per sheet; their number is the sheet width.
    """
    cells = attach(attach(grid, headers, keys), bounds, keys)
    header = cells.where((F.col("row_idx") == F.col("header_row")) & (F.col("col_idx") <= F.col("last_col")))
    generated = F.concat(F.lit("unnamed_"), F.col("col_idx").cast("string"))
    base = F.when(blank(F.col("value")) & ~F.col("detected"), generated).otherwise(
        snake_name(F.coalesce("value", F.lit("")))
    )
    named = header.select(*keys, "col_idx", base.alias("_base"))
    listed = named.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("col_idx", "_base"))).alias("_h"))

    def next_free(acc: Column, item: Column) -> Column:
        tries = F.transform(
            F.sequence(F.lit(1), F.size(acc) + 1),
            lambda k: F.when(k == 1, item["_base"]).otherwise(F.concat(item["_base"], F.lit("_"), k.cast("string"))),
        )
        free = F.filter(tries, lambda name: ~F.array_contains(acc, name))
        return F.concat(acc, F.array(F.get(free, F.lit(0))))

    names = F.aggregate("_h", F.array().cast("array<string>"), next_free)
    return listed.select(*keys, F.explode(F.arrays_zip(F.col("_h"), names.alias("n"))).alias("_z")).select(
        *keys, F.col("_z._h.col_idx").alias("col_idx"), F.col("_z.n").alias("column")
    )


def split_sheets(grid: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(body, metadata) cells of every sheet.

    body: keys, row_idx (from 0 below header and metadata), col_idx, column, value.
    metadata: keys, row_idx, col_idx, value of the rows above.

    The grid is read several times: pass a landed one.
    """
    headers = land(header_rows(grid, keys))  # one row per sheet, read three times
    below = attach(grid, headers, keys).where(F.col("row_idx") > F.col("header_row"))
    below = below.withColumn("body_row", F.col("row_idx") - F.col("header_row") - 1)
    bounds = land(trim_bounds(below, keys))
    meta = metadata_split(below, keys)
    kept = attach(attach(below, bounds, keys), meta, keys, "left").where(
        (F.col("row_idx") <= F.col("last_row")) & (F.col("col_idx") <= F.col("last_col"))
    )
    first = F.coalesce("meta_last_row", F.lit(-1)) + 1
    data = kept.where(F.col("body_row") >= first).withColumn("row_idx", F.col("body_row") - first)
    names = column_names(grid, headers, bounds, keys)
    body = attach(data.select(*keys, "row_idx", "col_idx", "value"), names, [*keys, "col_idx"])
    above = attach(grid, headers, keys).where(F.col("row_idx") < F.col("header_row"))
    inside = kept.where(F.col("body_row") < first)
    cols = [*keys, "row_idx", "col_idx", "value"]
    return body.select(*keys, "row_idx", "col_idx", "column", "value"), above.select(*cols).unionByName(inside.select(*cols))


def sheet_table(body: DataFrame, keys: dict[str, str], columns: list[str]) -> DataFrame:
    """One sheet of the body as a wide table of text columns."""
    rows = body
    for k, v in keys.items():
        rows = rows.where(F.col(k) == v)
    wide = rows.groupBy("row_idx").pivot("column", columns).agg(F.first("value"))
    return wide.select("row_idx", *columns)


def section_block(grid: DataFrame, keys: list[str], title: str = "table 1:", label: str = "estimate") -> DataFrame:
    """(keys, sector, year, value) of a titled block inside a sheet.

    Below the title comes a row of years, then a row that repeats ``label`` per
    year; the n-th label column belongs to the n-th year. The block ends at the
    next "table " row; the first row of each sector counts.
    """
    g = grid.where(~blank(F.col("value")))
    # Empty rows do not count: rows are numbered densely per sheet.
    dense = g.select(*keys, "row_idx").distinct().withColumn(
        "_r", F.row_number().over(W.partitionBy(*keys).orderBy("row_idx"))
    )
    cells = attach(g, dense, [*keys, "row_idx"])
    low = F.lower(F.trim("value"))
    titles = cells.where((F.col("col_idx") == 0) & low.startswith(title)).groupBy(*keys).agg(F.min("_r").alias("_title"))
    at = attach(cells, titles, keys)
    starts = at.where((F.col("col_idx") == 0) & (F.col("_r") > F.col("_title") + 2) & low.startswith("table "))
    ends = starts.groupBy(*keys).agg(F.min("_r").alias("_end"))
    at = attach(at, ends, keys, "left")
    across = W.partitionBy(*keys).orderBy("col_idx")
    number = F.when(F.trim("value").rlike(NUMBER_PATTERN), F.trim("value").try_cast("double"))
    years = (
        at.where((F.col("_r") == F.col("_title") + 1) & F.floor(number).between(1990, 2100))
        .select(*keys, F.floor(number).cast("int").alias("year"), F.row_number().over(across).alias("_nth"))
    )
    labels = (
        at.where((F.col("_r") == F.col("_title") + 2) & (low == label))
        .select(*keys, "col_idx", F.row_number().over(across).alias("_nth"))
    )
    year_cols = attach(labels, years, [*keys, "_nth"]).select(*keys, "col_idx", "year")
    data = at.where((F.col("_r") > F.col("_title") + 2) & (F.col("_end").isNull() | (F.col("_r") < F.col("_end"))))
    sector = F.trim("value")
    rows = (
        data.where((F.col("col_idx") == 1) & ~low.startswith("table") & (low != "all") & ~sector.rlike(NUMBER_PATTERN))
        .groupBy(*keys, sector.alias("sector"))
        .agg(F.min("_r").alias("_r"))
    )
    values = attach(data, year_cols, [*keys, "col_idx"]).select(*keys, "_r", "year", number.alias("value"))
    return attach(values.where(F.col("value").isNotNull()), rows, [*keys, "_r"]).select(*keys, "sector", "year", "value")
