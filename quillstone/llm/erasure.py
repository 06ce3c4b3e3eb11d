"""Cascading erasure from sorted files: external sorting into Parquet files of an exact number of rows, then rewriting of those that hold victims.

Tasks spill sorted runs (Arrow files of record batches of CHUNK rows, and beside each the keys of every CHUNK-th row) into a working
folder. Multisequence selection finds for each boundary between files how many rows of each run lie before it: the
sampled keys bound the place in each run to a few chunks, and pivots are then halved in those. A file's task merges its slices of the runs
and streams them to Parquet. Lists of victims are dealt out by the files' ranges of keys; a file whose list meets none of its rows stays as it is.

Rows are ordered by a key (long), then all columns from left to right, ascending, nulls first, NaN above all numbers, -0.0 as 0.0; strings by
their UTF-8 bytes; arrays, structs and maps by their JSON text. Rows that tie are alike, so their order shows nowhere.

Tasks write under names of their own and report them in their rows; the driver moves what the successful attempts reported (at most
`files` names a table). A lost or a late attempt can therefore leave a stray file in the working folder, never in the final one. The folders
lie in spark.checkpoint.dir; executors reach it with pyarrow.fs.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.common import cut, drop, partitions, shared_dir, whole_row

#: Bytes of Arrow data that a task sorts at once, rows of a chunk of a run, rows of a row group.
RUN = 48 << 20
CHUNK = 2048
GROUP = 1 << 16
#: Files whose boundaries one task selects.
BLOCK = 10
#: A key with more than one in HOT of a table's rows is joined by broadcast; there are fewer than HOT of them.
HOT = 64


def store(uri: str):
    """The file system of a folder's URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


# Runs


def order_keys(batch: pa.RecordBatch | pa.Table, width: int) -> pa.RecordBatch:
    """The columns that the rows are ordered by, as types whose ascending order is the one wanted: the key, then each column (nested ones have their text after the last column)."""
    texts = iter(range(width + 1, batch.num_columns))
    out = []
    for i in range(width + 1):
        column = batch.column(i)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        kind = column.type
        if pa.types.is_nested(kind):
            column, kind = batch.column(next(texts)), pa.string()
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        if pa.types.is_floating(kind):
            x = column.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) + 0.0
            bits = np.where(np.isnan(x), np.nan, x).view(np.int64)
            bits = np.where(np.isnan(x), np.iinfo(np.int64).max, np.where(bits < 0, np.int64(-1) ^ (bits & np.iinfo(np.int64).max), bits))
            column = pa.array(bits, mask=column.is_null().to_numpy(zero_copy_only=False))
        elif pa.types.is_string(kind):
            column = column.cast(pa.binary())
        elif pa.types.is_large_string(kind):
            column = column.cast(pa.large_binary())
        elif pa.types.is_timestamp(kind) or pa.types.is_duration(kind):
            column = column.cast(pa.int64())
        elif pa.types.is_date(kind):
            column = column.cast(pa.int32())
        elif pa.types.is_boolean(kind) or pa.types.is_null(kind):
            column = column.cast(pa.int8())
        out.append(column)
    return pa.RecordBatch.from_arrays(out, names=[f"k{i}" for i in range(len(out))])


def sort_order(keys: pa.RecordBatch) -> pa.Array:
    return pc.sort_indices(keys, sort_keys=[(name, "ascending") for name in keys.schema.names], null_placement="at_start")


def write_run(batch: pa.RecordBatch, width: int, folder: str, chunk: int) -> str:
    """Sort a batch and write it as a run; the name of its file."""
    filesystem, path = store(folder)
    name = f"{path}/{uuid.uuid4().hex}"
    keys = order_keys(batch, width)
    order = sort_order(keys)
    batch, starts = batch.take(order), keys.take(order[::chunk])
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for suffix, what, step in ((".arrow", batch, chunk), (".keys", starts, max(1, starts.num_rows))):
        with filesystem.open_output_stream(name + suffix) as sink, pa.ipc.new_file(sink, what.schema, options=options) as out:
            for i in range(0, what.num_rows, step):
                out.write_batch(what.slice(i, step))
    return name


class Run:
    """A run as written: rows [lo, hi) by reading the chunks that hold them."""

    def __init__(self, filesystem, name: str, rows: int, chunk: int):
        self.filesystem, self.name, self.rows, self.chunk, self.file = filesystem, name, rows, chunk, None

    def starts(self) -> pa.RecordBatch:
        with self.filesystem.open_input_file(self.name + ".keys") as source:
            return pa.ipc.open_file(source).get_batch(0)

    def read(self, lo: int, hi: int) -> pa.Table:
        if self.file is None:
            self.file = pa.ipc.open_file(self.filesystem.open_input_file(self.name + ".arrow"))
        first = lo // self.chunk
        parts = [self.file.get_batch(i) for i in range(first, -(-hi // self.chunk))]
        return pa.Table.from_batches(parts, self.file.schema).slice(lo - first * self.chunk, max(0, hi - lo))


def keyed(df: DataFrame, key: Column) -> DataFrame:
    """A table as sort_files takes it: its key and its row."""
    return df.select(key.cast("long").alias("key"), whole_row(df).alias("row"))


def spilled(name: str, df: DataFrame, folder: str, run: int = RUN, chunk: int = CHUNK) -> DataFrame:
    """Sorted runs of a table: table_name, path, n. Columns travel by position."""
    fields = df.schema["row"].dataType.fields
    width, order = len(fields), [F.col("row").getField(f.name) for f in fields]
    nested = [F.to_json(F.struct(c.alias("x"))) for c, f in zip(order, fields, strict=True) if isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType)]
    rows = df.select(*[c.alias(f"c{i}") for i, c in enumerate([F.col("key"), *order, *nested])])

    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            return pa.RecordBatch.from_pydict({"table_name": [name], "path": [write_run(whole, width, folder, chunk)], "n": [whole.num_rows]})

        for batch in batches:
            held += [batch] * (batch.num_rows > 0)
            if sum(b.nbytes for b in held) >= run:
                yield out()
        if held:
            yield out()

    return rows.mapInArrow(spill, "table_name string, path string, n long")


# Exact cuts


class Keys:
    """Order keys of sorted rows. A key is (its long, the other columns as pairs that put nulls first)."""

    def __init__(self, keys: pa.RecordBatch):
        self.first = keys.column(0).to_numpy(zero_copy_only=False)
        self.rest = [keys.column(i) for i in range(1, keys.num_columns)]

    def at(self, i: int) -> tuple:
        return int(self.first[i]), [((v := c[i].as_py()) is not None, v) for c in self.rest]

    def place(self, key: tuple, right: bool) -> int:
        """How many rows are below the key (or, with right, not above it)."""
        lo, hi = (int(np.searchsorted(self.first, key[0], side)) for side in ("left", "right"))
        while lo < hi:
            mid = (lo + hi) // 2
            own = self.at(mid)[1]
            lo, hi = (mid + 1, hi) if own < key[1] or right and own == key[1] else (lo, mid)
        return lo


def windows(starts: list[pa.RecordBatch], rows: list[int], chunk: int, ranks: list[int]) -> list[list[tuple[int, int]]]:
    """For each rank and run the bounds of the cut's place, from the keys of every chunk-th row.

    In the order of all sampled rows, between c and c * chunk rows of a run are before a sample when c samples of the run are:
    the sums of these bounds enclose each sample's rank.
    """
    table = pa.Table.from_batches(starts).combine_chunks().to_batches()
    if not table:
        return [[(0, 0)] * len(rows) for _ in ranks]
    run = np.repeat(np.arange(len(starts)), [s.num_rows for s in starts])
    number = np.concatenate([np.arange(s.num_rows) for s in starts])
    keys = table[0].append_column("run", pa.array(run)).append_column("number", pa.array(number))
    order = sort_order(keys).to_numpy()
    run, number = run[order], number[order]
    size = np.minimum(chunk, np.array(rows)[run] - number * chunk)
    most = np.concatenate(([0], np.cumsum(size)))[:-1]
    least = np.concatenate(([0], np.cumsum(np.where(number == 0, 1, chunk))))[:-1]
    out = []
    for rank in ranks:
        below = int(np.searchsorted(most, rank, "right")) - 1
        above = int(np.searchsorted(least, rank, "left"))
        lo = np.bincount(run[:below], minlength=len(rows))
        hi = np.bincount(run[:above], minlength=len(rows))
        out.append([(max(0, (a - 1) * chunk + 1) if a else 0, min(b * chunk, n)) for a, b, n in zip(lo.tolist(), hi.tolist(), rows, strict=True)])
    return out


def select(parts: list[Keys], need: int) -> list[int]:
    """Multisequence selection: how many rows of each sorted part are among the first `need` of all. Equal rows count in the order of the parts."""
    lo, hi = [0] * len(parts), [len(p.first) for p in parts]
    while True:
        widest = max(range(len(parts)), key=lambda j: hi[j] - lo[j])
        if hi[widest] == lo[widest]:
            return lo
        mid = (lo[widest] + hi[widest]) // 2
        pivot = parts[widest].at(mid)
        places = [mid if j == widest else min(max(p.place(pivot, j < widest), lo[j]), hi[j]) for j, p in enumerate(parts)]
        if sum(places) == need:
            return places
        if sum(places) < need:
            lo, lo[widest] = places, mid + 1
        else:
            hi = places


def cuts(runs: list[Run], ranks: list[int], width: int) -> list[list[int]]:
    """For each rank, how many rows of each run are among the first so many of all."""
    rows = [r.rows for r in runs]
    out = []
    for rank, bounds in zip(ranks, windows([r.starts() for r in runs], rows, runs[0].chunk, ranks), strict=True):
        if rank in (0, sum(rows)):
            out.append([0 if rank == 0 else n for n in rows])
            continue
        parts = [Keys(order_keys(r.read(lo, hi), width)) for r, (lo, hi) in zip(runs, bounds, strict=True)]
        found = select(parts, rank - sum(lo for lo, _ in bounds))
        out.append([lo + k for (lo, _), k in zip(bounds, found, strict=True)])
    return out


# Files


def merged(slices: list[tuple[Run, int, int]], width: int) -> Iterator[pa.Table]:
    """The slices' rows in order. A chunk of each slice is in memory: rows up to the least last key of those that go on are all known, so they leave."""
    held: list = [None] * len(slices)
    at = [lo for _, lo, _ in slices]
    while True:
        for j, (run, _, hi) in enumerate(slices):
            if held[j] is None and at[j] < hi:
                end = min(hi, (at[j] // run.chunk + 1) * run.chunk)
                rows = run.read(at[j], end)
                held[j], at[j] = (rows, Keys(order_keys(rows, width)), 0), end
        live = [j for j in range(len(slices)) if held[j] is not None]
        if not live:
            return
        ends = [held[j][1].at(held[j][0].num_rows - 1) for j in live if at[j] < slices[j][2]]
        bound, parts = min(ends, default=None), []
        for j in live:
            rows, keys, done = held[j]
            k = rows.num_rows if bound is None else keys.place(bound, True)
            parts.append(rows.slice(done, k - done))
            held[j] = (rows, keys, k) if k < rows.num_rows else None
        whole = pa.concat_tables(parts).combine_chunks()
        yield whole.take(sort_order(order_keys(whole, width)))


class Writer:
    """Streams tables of rows into one Parquet file, by row groups of at least GROUP rows."""

    def __init__(self, folder: str):
        self.filesystem, path = store(folder)
        self.path, self.out, self.sink, self.held, self.n = f"{path}/{uuid.uuid4().hex}.parquet", None, None, [], 0

    def add(self, rows: pa.Table, last: bool = False) -> None:
        import pyarrow.parquet as pq

        self.held += [rows] * (rows.num_rows > 0)
        if self.held and (last or sum(t.num_rows for t in self.held) >= GROUP):
            whole = pa.concat_tables(self.held)
            if self.out is None:
                self.sink = self.filesystem.open_output_stream(self.path)
                self.out = pq.ParquetWriter(self.sink, whole.schema, compression="zstd")
            self.out.write_table(whole, row_group_size=max(GROUP, whole.num_rows))
            self.n += whole.num_rows
            self.held = []

    def close(self, empty: pa.Table) -> str | None:
        """The file's path, None if no row came."""
        self.add(empty, last=True)
        if self.out is None:
            return None
        self.out.close()
        self.sink.close()
        return self.path


def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Runs of rows with the same first column, as lists. The rows are few: runs of a file, or the names of its list."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and next(iter(held[0].values())) != next(iter(row.values())):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _dealt(df: DataFrame, count: int, number: str) -> DataFrame:
    """Rows by a number below count, evenly over the tasks; a number's rows are in one."""
    n = min(count, partitions(df.sparkSession))
    return df.repartitionById(n, F.col(number) % n)


FILES = "table_name string, file_no int, staged string, n long, lo_key long, lo_id long, hi_key long, hi_id long"


def sort_files(tables: dict[str, DataFrame], folder: str, work: str, files: int = 150, run: int = RUN, chunk: int = CHUNK) -> DataFrame:
    """Write each table's rows in order as Parquet files of 1 + n // files rows, <folder>/<table>/<file_no>.parquet.

    tables: by name, see keyed(). Returns one row a file: table_name, file_no, path, n, and the first and last row's key and first column
    (null unless it is an integer). A table without rows gets no file; at most `files` files come of a table.
    """
    spark = next(iter(tables.values())).sparkSession
    names = {t: df.schema["row"].dataType.names for t, df in tables.items()}
    filesystem, top = store(work)
    for sub in ("runs", "staged"):
        filesystem.create_dir(f"{top}/{sub}", recursive=True)
    runs = None
    for t, df in tables.items():
        own = spilled(t, df, f"{work}/runs", run, chunk)
        runs = own if runs is None else runs.unionByName(own)
    runs = cut(runs, "runs")
    totals = {r["table_name"]: r["n"] for r in runs.groupBy("table_name").agg(F.sum("n").alias("n")).collect()}
    blocks, number = [], 0
    for t, n in totals.items():
        size = 1 + n // files
        count = -(-n // size)
        for first in range(0, count, BLOCK):
            blocks.append((t, len(blocks), first, min(count, first + BLOCK), size, n, number))
        number += count
    if not blocks:
        drop(runs)
        return spark.createDataFrame([], "table_name string, file_no int, path string, n long, lo_key long, lo_id long, hi_key long, hi_id long")
    plan = spark.createDataFrame(blocks, "table_name string, block int, first int, last int, size long, total long, number int")

    def opened(rows: list[dict]) -> list[Run]:
        return [Run(filesystem_of(), r["path"], r["n"], chunk) for r in rows]

    def filesystem_of():
        return store(work)[0]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_group(batches):
            head, own = rows[0], opened(rows)
            ranks = [min(head["total"], f * head["size"]) for f in range(head["first"], head["last"] + 1)]
            found = cuts(own, ranks, len(names[head["table_name"]]))
            for f, lo, hi in zip(range(head["first"], head["last"]), found[:-1], found[1:], strict=True):
                some = [j for j in range(len(own)) if lo[j] < hi[j]]
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array([head["number"] + f] * len(some), pa.int32()), "table_name": [head["table_name"]] * len(some), "file_no": pa.array([f] * len(some), pa.int32()),
                    "path": [own[j].name for j in some], "n": [own[j].rows for j in some], "lo": [lo[j] for j in some], "hi": [hi[j] for j in some],
                })

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_group(batches):
            t, width = rows[0]["table_name"], len(names[rows[0]["table_name"]])
            out, ends = Writer(f"{work}/staged"), []
            for part in merged([(r, s["lo"], s["hi"]) for r, s in zip(opened(rows), rows, strict=True)], width):
                ends = [*ends[:1], *([part.slice(0, 1)] if not ends else []), part.slice(part.num_rows - 1)]
                out.add(part.select(range(1, width + 1)).rename_columns(names[t]))
            whole = pa.types.is_integer(ends[0].schema.field(1).type) if width else False
            lo, hi = ((e.column(0)[0].as_py(), e.column(1)[0].as_py() if whole else None) for e in (ends[0], ends[-1]))
            path = out.close(ends[0].select(range(1, width + 1)).rename_columns(names[t]).slice(0, 0))
            yield pa.RecordBatch.from_pydict({
                "table_name": [t], "file_no": pa.array([rows[0]["file_no"]], pa.int32()), "staged": [path], "n": [out.n],
                "lo_key": [lo[0]], "lo_id": pa.array([lo[1]], pa.int64()), "hi_key": [hi[0]], "hi_id": pa.array([hi[1]], pa.int64()),
            })

    met = runs.join(F.broadcast(plan), "table_name").select("block", "table_name", "first", "last", "size", "total", "number", "path", "n")
    slices = _dealt(met, len(blocks), "block").sortWithinPartitions("block", "path").mapInArrow(find, "id int, table_name string, file_no int, path string, n long, lo long, hi long")
    written = cut(_dealt(slices, number, "id").sortWithinPartitions("id", "path").mapInArrow(merge, FILES), "files")
    filesystem, final = store(folder)
    for t in totals:
        filesystem.create_dir(f"{final}/{t}", recursive=True)
    for r in written.select("table_name", "file_no", "staged").collect():  # at most `files` names a table
        filesystem.move(r["staged"], f"{final}/{r['table_name']}/{r['file_no']:05d}.parquet")
    filesystem.delete_dir(f"{top}/runs")
    drop(runs)
    path = F.format_string(f"{folder.replace('%', '%%')}/%s/%05d.parquet", "table_name", "file_no")
    return written.select("table_name", "file_no", path.alias("path"), "n", "lo_key", "lo_id", "hi_key", "hi_id")


def erase(catalog: DataFrame, victims: DataFrame, columns: dict[str, str], work: str) -> DataFrame:
    """Rewrite the files of sort_files that hold victims: survivors in order, under the same name; a file left without rows is removed.

    victims: table_name, key, id, the same rows once; a row goes when its column columns[table_name] has one of the table's ids. The
    key must be that of the row; where the column is a table's first one, the list is dealt by key and id, else by key. A file's list is
    an array of 8 bytes for each id in its range. Returns catalog's files that remain, with n_erased and rewritten.
    """
    spark = catalog.sparkSession
    first = F.col("v.id").isNotNull() & F.col("f.by_id")
    above = (F.col("v.key") > F.col("f.lo_key")) | (F.col("v.key") == F.col("f.lo_key")) & (~first | F.col("f.lo_id").isNull() | (F.col("v.id") >= F.col("f.lo_id")))
    below = (F.col("v.key") < F.col("f.hi_key")) | (F.col("v.key") == F.col("f.hi_key")) & (~first | F.col("f.hi_id").isNull() | (F.col("v.id") <= F.col("f.hi_id")))
    by_id = F.coalesce(F.lit(None).cast("boolean"), *[F.when(F.col("table_name") == t, F.col("first_column") == c) for t, c in columns.items()], F.lit(False))
    listed = catalog.select("*", by_id.alias("by_id"))
    # At most `files` files a table: the broadcast is bounded.
    met = victims.filter("id is not null").alias("v").join(F.broadcast(listed.alias("f")), (F.col("v.table_name") == F.col("f.table_name")) & above & below)
    count = catalog.count()
    numbers = catalog.select("table_name", "file_no").collect()
    if not numbers:
        return catalog.select("*", F.lit(0).cast("long").alias("n_erased"), F.lit(False).alias("rewritten"))
    ids = spark.createDataFrame([(r["table_name"], r["file_no"], i) for i, r in enumerate(sorted(numbers))], "table_name string, file_no int, number int")
    lists = met.select(F.col("f.table_name").alias("table_name"), "f.file_no", F.col("v.id").alias("id"), F.lit(None).cast("string").alias("path"))
    both = lists.unionByName(catalog.select("table_name", "file_no", F.lit(None).cast("long").alias("id"), "path")).join(F.broadcast(ids), ["table_name", "file_no"]).select("number", "table_name", "file_no", "path", "id")

    def one(table: str, file_no: int, path: str, ids: pa.Array) -> dict:
        import pyarrow.parquet as pq

        filesystem, where = store(path)
        column = columns[table]
        out = {"table_name": table, "file_no": file_no, "staged": None, "left": None, "n_erased": 0}
        with filesystem.open_input_file(where) as source:
            file = pq.ParquetFile(source)
            hit = sum(pc.sum(pc.is_in(b.column(0), ids)).as_py() or 0 for b in file.iter_batches(GROUP, columns=[column])) if len(ids) else 0
            if hit:
                writer = Writer(f"{work}/staged")
                for batch in file.iter_batches(GROUP):
                    writer.add(pa.Table.from_batches([batch]).filter(pc.invert(pc.is_in(batch.column(column), ids))))
                staged = writer.close(file.schema_arrow.empty_table())
                out |= {"staged": staged, "left": writer.n, "n_erased": hit}
        return out

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids = None, []

        def out() -> pa.RecordBatch:
            found = one(*held, pa.array(np.unique(np.concatenate(ids)) if ids else np.zeros(0, np.int64)))
            kinds = {"table_name": pa.string(), "file_no": pa.int32(), "staged": pa.string(), "left": pa.int64(), "n_erased": pa.int64()}
            return pa.RecordBatch.from_pydict({c: pa.array([found[c]], kinds[c]) for c in kinds})

        for batch in batches:  # by number; a file's own row, whose id is null, stands before its list
            heads = np.flatnonzero(batch.column("id").is_null().to_numpy(zero_copy_only=False)).tolist()
            for lo, hi in zip([0, *heads], [*heads, batch.num_rows], strict=True):
                if lo in heads and lo < hi:
                    if held is not None:
                        yield out()
                    held, ids = tuple(batch.column(c)[lo].as_py() for c in ("table_name", "file_no", "path")), []
                ids.append(batch.column("id").slice(lo, hi - lo).drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
        if held is not None:
            yield out()

    done = _dealt(both, count, "number").sortWithinPartitions("number", F.asc_nulls_first("id")).mapInArrow(rewrite, "table_name string, file_no int, staged string, left long, n_erased long")
    done = cut(done, "erased")
    places = {(r["table_name"], r["file_no"]): r["path"] for r in catalog.select("table_name", "file_no", "path").collect()}
    for r in done.filter("n_erased > 0").collect():  # names of files only
        filesystem, where = store(places[r["table_name"], r["file_no"]])
        if r["staged"] is None:
            filesystem.delete_file(where)
        else:
            filesystem.move(r["staged"], where)
    left = catalog.join(F.broadcast(done.drop("staged")), ["table_name", "file_no"]).filter("left is null or left > 0")
    return left.select("table_name", "file_no", "path", F.coalesce("left", "n").alias("n"), "n_erased", (F.col("n_erased") > 0).alias("rewritten"))


def read_back(catalog: DataFrame, amounts: dict[str, str]) -> DataFrame:
    """Of each file of the catalog, from the file: n_rows, cents (of the table's column in `amounts`, rounded half up; null and NaN: 0), ids_sha256 (of its first column) and columns."""
    spark = catalog.sparkSession
    rows = sorted((r["table_name"], r["file_no"], r["path"]) for r in catalog.select("table_name", "file_no", "path").collect())  # names of files only
    if not rows:
        return catalog.select(*catalog.columns, F.lit(0).cast("long").alias("n_rows"), F.lit(0).cast("long").alias("cents"), F.lit("").alias("ids_sha256"), F.lit("").alias("columns"))
    names = _dealt(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "number int, table_name string, file_no int, path string"), len(rows), "number").sortWithinPartitions("number")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for group in by_group(batches):
            r = group[0]
            filesystem, where = store(r["path"])
            digest, n, cents = hashlib.sha256(), 0, 0
            with filesystem.open_input_file(where) as source:
                file = pq.ParquetFile(source)
                names = file.schema_arrow.names
                for batch in file.iter_batches(GROUP, columns=list(dict.fromkeys([names[0], amounts[r["table_name"]]]))):
                    text = pc.binary_join(pa.array([pc.fill_null(batch.column(names[0]).cast(pa.string()), "").to_pylist()], pa.list_(pa.string())), ",")[0].as_py()
                    digest.update((("," if n else "") + text).encode())
                    x = batch.column(amounts[r["table_name"]]).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
                    cents += int(np.floor(np.where(np.isfinite(x), x, 0.0) * 100 + 0.5).astype(np.int64).sum())
                    n += batch.num_rows
            yield pa.RecordBatch.from_pydict({
                "table_name": [r["table_name"]], "file_no": pa.array([r["file_no"]], pa.int32()), "n_rows": [n], "cents": [cents], "ids_sha256": [digest.hexdigest()], "columns": [",".join(names)],
            })

    found = names.mapInArrow(read, "table_name string, file_no int, n_rows long, cents long, ids_sha256 string, columns string")
    return found.join(F.broadcast(catalog), ["table_name", "file_no"])


# The shop's cascade


def spread_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left join by a key that is unique in right. Keys with more than one in HOT of left's rows, fewer than HOT, are joined by broadcast, as are null keys, so no key's rows meet in one task."""
    counts = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("times"))
    total = left.count()
    hot = cut(counts.filter(F.col("times") * HOT > total).select(key), "hot")
    few = right.join(F.broadcast(hot), key, "left_semi").withColumn("was_hot", F.lit(True))
    kept = cut(few, "hot-rows")
    marked = left.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), key, "left")
    near = marked.filter(F.col("is_hot") | F.col(key).isNull()).drop("is_hot").join(F.broadcast(kept.drop("was_hot")), key, "left")
    far = marked.filter(F.col("is_hot").isNull() & F.col(key).isNotNull()).drop("is_hot").join(right, key, "left")
    return near.unionByName(far)


def key_of(client: str | Column) -> Column:
    """crc32 of the decimal client_id; of the empty string where it is null."""
    client = F.col(client) if isinstance(client, str) else client
    return F.crc32(F.coalesce(client.cast("string"), F.lit("")).cast("binary"))


def erase_masters(spark: SparkSession, clients: DataFrame, clicks: DataFrame, sales: DataFrame, lines: DataFrame, folder: str, files: int = 150, divisor: int = 100, run: int = RUN, chunk: int = CHUNK) -> DataFrame:
    """Sort the shop's tables into files in `folder`, then erase the victim masters, their clients, these clients' clicks and sales, and these sales' lines.

    Victims are the masters whose crc32 is divisible by `divisor`, and the one whose clients have most clicks (ties, even at none: the smallest).
    Nulls link nothing. A sale_id that is there twice counts as sold to its smallest client for the order, and goes when any of its rows goes. Without masters
    nothing goes; empty tables get no files. Returns the files that remain, see erase().
    """
    work = f"{shared_dir(spark)}/erasure-work-{uuid.uuid4().hex}"
    whole = {"clients": clients, "clicks": clicks, "sales": sales, "sale_lines": lines}
    owned = clients.select("master_id", "client_id").filter("master_id is not null and client_id is not null").distinct()
    times = clicks.filter("client_id is not null").groupBy("client_id").agg(F.count("*").alias("times"))
    masters = clients.filter("master_id is not null").select("master_id").distinct()
    sums = owned.join(times, "client_id", "left").groupBy("master_id").agg(F.sum("times").alias("times"))
    most = masters.join(sums, "master_id", "left").orderBy(F.coalesce("times", F.lit(0)).desc(), "master_id").select("master_id").limit(1).collect()
    gone = F.crc32(F.col("master_id").cast("string").cast("binary")) % divisor == 0
    gone = F.col("master_id").isNotNull() & (gone | (F.col("master_id") == F.lit(most[0][0] if most else None)))
    lost = clients.filter(gone)
    victims = lost.filter("client_id is not null").select("client_id").distinct()
    bought = spread_join(sales.select("sale_id", "client_id").filter("sale_id is not null"), victims.withColumn("lost", F.lit(True)), "client_id")
    owners = cut(bought.groupBy("sale_id").agg(F.min("client_id").alias("owner"), F.coalesce(F.max("lost"), F.lit(False)).alias("lost")), "owners")

    tables = {t: keyed(df, key_of(df["client_id"])) for t, df in whole.items() if t != "sale_lines"}
    packed = lines.select(F.col("sale_id").alias("at"), whole_row(lines).alias("row"))
    tables["sale_lines"] = spread_join(packed, owners.select(F.col("sale_id").alias("at"), "owner"), "at").select(key_of("owner").alias("key"), "row")
    catalog = sort_files(tables, folder, work, files, run, chunk)

    by_client = victims.select(key_of("client_id").alias("key"), F.col("client_id").cast("long").alias("id"))
    listed = lost.select(F.lit("clients").alias("table_name"), key_of("client_id").alias("key"), F.col("master_id").cast("long").alias("id")).distinct()
    for t in ("clicks", "sales"):
        listed = listed.unionByName(by_client.select(F.lit(t).alias("table_name"), "key", "id"))
    listed = listed.unionByName(owners.filter("lost").select(F.lit("sale_lines").alias("table_name"), key_of("owner").alias("key"), F.col("sale_id").cast("long").alias("id")))
    heads = F.coalesce(*[F.when(F.col("table_name") == t, F.lit(df.columns[0])) for t, df in whole.items()])
    out = erase(catalog.withColumn("first_column", heads), listed, {"clients": "master_id", "clicks": "client_id", "sales": "client_id", "sale_lines": "sale_id"}, work)
    filesystem, path = store(work)
    filesystem.delete_dir(path)
    return out
