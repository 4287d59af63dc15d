"""Result documents: one nested JSON file a job, written through a data source with commit and abort.

    spark.dataSource.register(ResultFiles)
    documents(result).write.format("result_files").mode("append").save(folder)

Tasks write below `_staging` under names of their own; the commit moves what the successful
attempts have written to `<job>.json`, so neither a task that ran twice nor a write that
failed leaves a file of its own. The folder may be anything that pyarrow's file systems reach
and all executors share.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from paperloom.operators import flatten
from paperloom.plans.extraction import Result

TABLE = flatten.TABLE


def documents(result: Result) -> DataFrame:
    """(job_id, document): the tables of each document with their columns, rows and warnings, the suppressed ones apart, and its summary.

    A row is a list of its cells in the order of the columns. Arrays of a table are gathered from one
    table's cells at a time, a document from its tables.
    """
    part = lambda df, name, order, *cols: df.groupBy(*TABLE).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, *cols))), lambda x: F.struct(*(x[c].alias(c) for c in cols))).alias(name))
    columns = part(result.columns, "columns", ["col_index"], "key", "label", "type", "currency", "locale", "ambiguous")
    cell = F.struct("col_index", "key", "raw", F.coalesce(F.col("value_double").cast("string"), F.col("value_bool").cast("string"), "value_string").alias("value"), "confidence", "confidence_source")
    rows = result.cells.groupBy(*TABLE, "row_index").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    rows = part(rows, "rows", ["row_index"], "cells")
    warnings = part(result.warnings, "warnings", ["ord"], "code", "column", "row_index", "value")
    tables = result.tables
    for extra in (columns, rows, warnings):
        tables = tables.join(extra, TABLE, "left")
    body = F.struct("table_id", "title", "pages", "n_rows", "n_cols", "rows_before_explosion", "header_rows", "provenance", "columns", "rows", "warnings")
    each = tables.groupBy("doc_id").agg(*(F.array_sort(F.collect_list(F.when(test, F.struct("table_id", F.to_json(body).alias("json"))))).alias(name) for name, test in (("shown", ~F.col("suppressed")), ("hidden", F.col("suppressed")))))
    joined = result.summary.select("doc_id", F.to_json(F.struct(*(c for c in result.summary.columns if c != "doc_id"))).alias("summary")).join(each, "doc_id", "left")
    texts = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(c, F.array().cast(dict(each.dtypes)[c])), lambda x: x["json"]), ","), F.lit("]"))
    return joined.select(F.col("doc_id").cast("string").alias("job_id"), F.concat(F.lit('{"summary":'), "summary", F.lit(',"tables":'), texts("shown"), F.lit(',"suppressed_tables":'), texts("hidden"), F.lit("}")).alias("document"))


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # (staged, final)


class ResultFiles(DataSource):
    """Sink of (job_id, document); format name `result_files`."""

    @classmethod
    def name(cls) -> str:
        return "result_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        missing = {"job_id", "document"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"result files need columns {sorted(missing)}")
        return ResultWriter(self.options["path"])


class ResultWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.run = path.rstrip("/"), uuid.uuid4().hex

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = self._open()
        staging = f"{root}/_staging/{self.run}/{uuid.uuid4().hex}"
        store.create_dir(staging, recursive=True)
        files = []
        for i, row in enumerate(iterator):
            if row.job_id is not None:
                with store.open_output_stream(f"{staging}/{i}") as out:
                    out.write((row.document or "null").encode())
                files.append((f"{staging}/{i}", f"{root}/{quote(str(row.job_id), safe='')}.json"))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self._open()
        for m in messages:
            for staged, final in m.files if m else ():
                store.move(staged, final)
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._open())

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/_staging/{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_staging/{self.run}")
        if store.get_file_info(f"{root}/_staging").type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(f"{root}/_staging")):
            store.delete_dir(f"{root}/_staging")
