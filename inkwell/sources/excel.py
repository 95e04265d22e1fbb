"""Excel workbooks, read through Spark's own file reader and written as one file in row order.

Workbooks are read as binary files, so any store that Spark reads will do, one task per file; the XML is
parsed as a stream. Every row gets ``row_no``, its place below the header, which is its identity.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a sheet can hold, a fixed value of the format.
MOST_ROWS = 1_048_576
#: Bytes of a workbook that are held at once while it is written.
CHUNK = 4 << 20
#: Paths that this session has read workbooks from: they are never written to.
_SOURCES: set[str] = set()
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _name(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def parse(content: bytes, sheet: int = 1) -> Iterator[list[str | None]]:
    """The rows of a sheet as lists of strings; cells that are not there are None."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for _, e in ElementTree.iterparse(z.open("xl/sharedStrings.xml")):
                if e.tag == f"{_NS}si":
                    shared.append("".join(t.text or "" for t in e.iter(f"{_NS}t")))
                    e.clear()
        with z.open(f"xl/worksheets/sheet{sheet}.xml") as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag != f"{_NS}row":
                    continue
                row: list[str | None] = []
                for k, c in enumerate(e.iter(f"{_NS}c")):
                    at = _column(c.get("r", "")) if c.get("r") else k
                    row += [None] * (at + 1 - len(row))
                    value = c.find(f"{_NS}v")
                    if c.get("t") == "inlineStr":
                        row[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                    elif value is not None and value.text is not None:
                        row[at] = shared[int(value.text)] if c.get("t") == "s" else value.text
                yield row
                e.clear()


class _Pipe(io.RawIOBase):
    """What a workbook's writer has written and nobody has taken yet; it cannot go back, so the writer does not try to."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.size = 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.parts.append(bytes(data))
        self.size += len(data)
        return len(data)

    def take(self) -> bytes:
        out, self.parts, self.size = b"".join(self.parts), [], 0
        return out


def build(header: list[str], rows: Iterable[Iterable], chunk: int = CHUNK) -> Iterator[bytes]:
    """A workbook with one sheet, in chunks of about so many bytes as its rows come; numbers stay numbers, nulls are empty cells."""

    def cells(n: int, values: Iterable) -> str:
        out = []
        for i, v in enumerate(values):
            ref = f"{_name(i)}{n}"
            if v is None:
                continue
            if isinstance(v, (int, float)) and not isinstance(v, bool):
                out.append(f'<c r="{ref}"><v>{v!r}</v></c>')
            else:
                out.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(_ILLEGAL.sub("", str(v)))}</t></is></c>')
        return f'<row r="{n}">{"".join(out)}</row>'

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    data = _Pipe()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{main}"><sheetData>'.encode())
            f.write(cells(1, header).encode())
            for n, row in enumerate(rows, 2):
                f.write(cells(n, row).encode())
                if data.size >= chunk:
                    yield data.take()
            f.write(b"</sheetData></worksheet>")
    yield data.take()


def read_excel(spark: SparkSession, path: str, columns: dict[str, str], sheet: int = 1, first: int = 1, last: int | None = None) -> DataFrame:
    """row_no and the named columns of a workbook, as strings; ``columns`` gives the header of each output name.

    ``first`` and ``last`` pick rows below the header (from 1), for lists that stand in part of a sheet.
    A header that is missing is an error.
    """
    names = list(columns)
    _SOURCES.add(_plain(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                rows = parse(content, sheet)
                header = next(rows, [])
                at = [header.index(columns[n]) for n in names]
                chunk: list[tuple] = []
                for k, row in enumerate(rows, 1):
                    if k < first or (last is not None and k > last):
                        continue
                    chunk.append((k, *(row[i] if i < len(row) else None for i in at)))
                    if len(chunk) == 2_000:
                        yield _batch(chunk, names)
                        chunk = []
                yield _batch(chunk, names)

    schema = ", ".join(["row_no long", *[f"`{n}` string" for n in names]])
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.string()] * len(names)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["row_no", *names])


def _plain(path: str) -> str:
    return re.sub(r"^file:/+", "/", path).rstrip("/")


def write_excel(df: DataFrame, path: str, sources: tuple[str, ...] = (), order: str = "row_no") -> None:
    """One workbook with the rows in order. A path that is a source, or was read in this session, is refused, and so are more rows than a sheet holds.

    The format wants one file, so one task writes it, as its rows come; neither that task nor the driver ever holds more than a few chunks.
    """
    if _plain(path) in {_plain(s) for s in sources} | _SOURCES:
        raise ValueError("a source is never written to")
    if df.count() >= MOST_ROWS:
        raise ValueError("more rows than a sheet holds")
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(r.values()) for b in batches for r in b.to_pylist())
        for n, part in enumerate(build(names, rows)):
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([part], pa.binary())], ["n", "part"])

    # chunks come to the driver a partition at a time
    chunks = df.repartition(1).sortWithinPartitions(order).mapInArrow(run, "n long, part binary").repartitionByRange("n").sortWithinPartitions("n")
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    try:
        for row in chunks.toLocalIterator():
            out.write(row["part"])
    finally:
        out.close()


def read_wordlist(spark: SparkSession, path: str, header: str, dim: str, first: int = 1, last: int | None = None) -> DataFrame:
    """word, dim: one column of a workbook, blank cells and repeats left out."""
    rows = read_excel(spark, path, {"word": header}, first=first, last=last)
    return rows.select(F.trim("word").alias("word")).where("word <> ''").distinct().withColumn("dim", F.lit(dim))


def read_charlist(spark: SparkSession, path: str, level: int, sha256: str | None = None) -> DataFrame:
    """ch, level: the characters of a text file, once each; with a checksum the file must have it."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha"), F.decode("content", "UTF-8").alias("t"))
    if sha256 is not None and (wrong := [r["path"] for r in files.where(F.col("sha") != sha256).select("path").collect()]):
        raise ValueError(f"checksum does not hold: {wrong}")
    return files.select(F.explode(F.split("t", "")).alias("ch")).where(~F.col("ch").rlike(r"^\s*$")).distinct().withColumn("level", F.lit(level))
