"""A workbook of sheets, one file: rows are written by tasks, the file is put together at the end and replaces the old one at once.

Tasks write their rows as pieces of a sheet's XML into a folder beside the file, through a Python data source: a piece counts when its task
has committed, a failed attempt's does not, and a job that is aborted leaves no pieces and no new file. A sheet of the format holds
``MOST_ROWS`` rows, so what is put together is bounded; a longer table is an error, not a cut. The folder and the
file must be reachable for the driver and all executors by the same path.
"""

from __future__ import annotations

import json
import math
import os
import shutil
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

# Fixed value: the rows of a sheet, its header among them.
MOST_ROWS = 1_048_576
_MANIFEST = "_pieces.json"


def _cell(value: object) -> str:
    if value is None or isinstance(value, float) and not math.isfinite(value):
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float):
        return f"<c><v>{value!r}</v></c>"
    text = "".join(c for c in str(value) if c in "\t\n\r" or c >= " " and c not in "￾￿")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _line(values: Sequence[object]) -> str:
    return f"<row>{''.join(map(_cell, values))}</row>"


@dataclass
class Piece(WriterCommitMessage):
    partition: int
    name: str
    rows: int


class SheetWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[Row]) -> Piece:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"piece-{context.partitionId():05d}-{uuid.uuid4().hex}.xml"
        rows = 0
        with open(os.path.join(self.folder, name), "w", encoding="utf-8") as out:
            for row in iterator:
                out.write(_line(tuple(row)))
                rows += 1
        return Piece(context.partitionId(), name, rows)

    def commit(self, messages: list[Piece | None]) -> None:
        pieces = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        Path(self.folder, _MANIFEST).write_text(json.dumps([[m.name, m.rows] for m in pieces]))

    def abort(self, messages: list[Piece | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class SheetSource(DataSource):
    """``df.write.format("transitloom_sheet").option("path", folder)``: the rows in their partitions' order as pieces of a sheet."""

    @classmethod
    def name(cls) -> str:
        return "transitloom_sheet"

    def writer(self, schema: StructType, overwrite: bool) -> SheetWriter:
        return SheetWriter(self.options["path"])


@dataclass(frozen=True)
class Sheet:
    """A table and the order of its rows; an optional sheet is left out when it has none."""

    title: str
    rows: DataFrame
    order: tuple = ()
    optional: bool = True


def _put_together(path: str, staged: list[tuple[str, list[str], str]]) -> None:
    """The file from (title, column names, folder of pieces), beside its place and then in it."""
    beside = f"{path}.{uuid.uuid4().hex}.new"
    kind = "http://schemas.openxmlformats.org"
    numbers = range(1, len(staged) + 1)
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    try:
        with zipfile.ZipFile(beside, "w", zipfile.ZIP_DEFLATED) as out:
            parts = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for n in numbers)
            out.writestr(
                "[Content_Types].xml",
                f'{head}<Types xmlns="{kind}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>',
            )
            out.writestr("_rels/.rels", f'{head}<Relationships xmlns="{kind}/package/2006/relationships"><Relationship Id="rId1" Type="{kind}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            names = "".join(f'<sheet name={quoteattr(title[:31])} sheetId="{n}" r:id="rId{n}"/>' for n, (title, *_) in zip(numbers, staged, strict=True))
            out.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{kind}/spreadsheetml/2006/main" xmlns:r="{kind}/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
            links = "".join(f'<Relationship Id="rId{n}" Type="{kind}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in numbers)
            out.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{kind}/package/2006/relationships">{links}</Relationships>')
            for n, (_, columns, folder) in zip(numbers, staged, strict=True):
                with out.open(f"xl/worksheets/sheet{n}.xml", "w") as sheet:
                    sheet.write(f'{head}<worksheet xmlns="{kind}/spreadsheetml/2006/main"><sheetData>{_line(columns)}'.encode())
                    for name, _ in json.loads(Path(folder, _MANIFEST).read_text()):
                        with open(os.path.join(folder, name), "rb") as piece:
                            shutil.copyfileobj(piece, sheet)
                    sheet.write(b"</sheetData></worksheet>")
        os.replace(beside, path)
    finally:
        if os.path.exists(beside):
            os.remove(beside)


def write_workbook(sheets: Sequence[Sheet], path: str) -> list[str]:
    """Writes the sheets that are to be there, in their order, and returns their titles.

    Either the file is whole and new, or, after any failure, it is as it was.
    """
    staged: list[tuple[str, list[str], str]] = []
    folders = f"{path}.{uuid.uuid4().hex}.pieces"
    try:
        for n, sheet in enumerate(sheets):
            sheet.rows.sparkSession.dataSource.register(SheetSource)
            folder = os.path.join(folders, str(n))
            os.makedirs(folder)
            rows = sheet.rows.orderBy(*sheet.order) if sheet.order else sheet.rows
            rows.write.format("transitloom_sheet").mode("append").option("path", folder).save()
            total = sum(n for _, n in json.loads(Path(folder, _MANIFEST).read_text()))
            if total >= MOST_ROWS:
                raise ValueError(f"{sheet.title}: {total} rows, a sheet holds {MOST_ROWS - 1} and a header")
            if total or not sheet.optional:
                staged.append((sheet.title, sheet.rows.columns, folder))
        _put_together(path, staged)
    finally:
        shutil.rmtree(folders, ignore_errors=True)
    return [title for title, *_ in staged]
