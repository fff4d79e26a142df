"""Python data sources for formats that Spark does not read: NPY matrices, zips of CIF files, xz JSON, XLSX sheets.

Register with ``register(spark)``, then ``spark.read.format("npy").load(path)`` and so on. Each splits its input into
partitions that are read independently, so a lost task reads its own part again.
"""

from __future__ import annotations

import io
import json
import lzma
import re
import zipfile
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class Rows(InputPartition):
    first: int
    end: int


def _blocks(n: int, size: int) -> list[Rows]:
    return [Rows(k, min(k + size, n)) for k in range(0, n, size)] or [Rows(0, 0)]


class NpyReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.block = options["path"], int(options.get("blockrows", 65536))

    def _header(self):
        import numpy as np

        with open(self.path, "rb") as f:
            version = np.lib.format.read_magic(f)
            shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
            if fortran or len(shape) != 2:
                raise ValueError("a matrix in row order is needed")
            return shape, dtype, f.tell()

    def partitions(self):
        return _blocks(self._header()[0][0], self.block)

    def read(self, partition):
        import numpy as np
        import pyarrow as pa

        (_, width), dtype, start = self._header()
        n = partition.end - partition.first
        with open(self.path, "rb") as f:
            f.seek(start + partition.first * width * dtype.itemsize)
            x = np.frombuffer(f.read(n * width * dtype.itemsize), dtype).astype(np.float64)
        ends = pa.array((np.arange(n + 1) * width).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.first, partition.end)), pa.ListArray.from_arrays(ends, pa.array(x))], names=["row_ix", "v"])


class NpySource(DataSource):
    """``row_ix, v``: the rows of a matrix with their number, which takes the place of file order as a key."""

    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        return "row_ix bigint, v array<double>"

    def reader(self, schema):
        return NpyReader(self.options)


def archive_member(names: list[str], candidates: list[str]) -> str | None:
    """The first candidate that an archive holds."""
    held = set(names)
    return next((c for c in candidates if c in held), None)


class ZipReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.block = options["path"], int(options.get("blockfiles", 2000))
        self.suffix, self.include, self.exclude = options.get("suffix", ".cif"), options.get("include"), options.get("exclude")
        self.password = options.get("password")

    def _members(self):
        with zipfile.ZipFile(self.path) as z:
            names = [n for n in z.namelist() if n.lower().endswith(self.suffix) and not n.startswith("__MACOSX/")]
        return [n for n in names if (not self.include or self.include in n) and (not self.exclude or self.exclude not in n)]

    def partitions(self):
        return _blocks(len(self._members()), self.block)

    def read(self, partition):
        names = self._members()[partition.first : partition.end]
        with zipfile.ZipFile(self.path) as z:
            for name in names:
                parts = name.split("/")
                stem = re.sub(r"[^A-Za-z0-9_\-]+", "_", re.sub(r"\.[^.]*$", "", parts[-1]))
                try:
                    text, error = z.read(name, self.password.encode() if self.password else None).decode("utf-8", "replace"), None
                except (RuntimeError, zipfile.BadZipFile, OSError) as e:
                    text, error = None, str(e)[:200]
                yield (name, stem, parts[1] if len(parts) > 2 else None, text, error)


class ZipSource(DataSource):
    """``member, id, family, text, error`` of the files in an archive. Options: suffix, include, exclude, password, blockfiles."""

    @classmethod
    def name(cls):
        return "cifzip"

    def schema(self):
        return "member string, id string, family string, text string, error string"

    def reader(self, schema):
        return ZipReader(self.options)


class XzReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.under = options["path"], options.get("under")

    def read(self, partition):
        with lzma.open(self.path, "rt", encoding="utf-8") as f:
            data = json.load(f)
        data = data[self.under] if self.under else data
        for item in data if isinstance(data, list) else [data]:
            yield (json.dumps(item),)


class XzSource(DataSource):
    """``value``: the items of an xz-compressed JSON document as text, one row each; parse them with ``from_json``. The format
    cannot be split, so one file is one task; give a file per task."""

    @classmethod
    def name(cls):
        return "xzjson"

    def schema(self):
        return "value string"

    def reader(self, schema):
        return XzReader(self.options)


def sheet_rows(data: bytes) -> list[list[str | None]]:
    """The cells of the first sheet of an XLSX file, by column, None where a row has no cell."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iterfind(".//m:t", ns)) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", ns)]
        sheet = min(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        root = ElementTree.fromstring(z.read(sheet))
    out = []
    for row in root.iterfind(".//m:row", ns):
        cells: dict[int, str | None] = {}
        for k, cell in enumerate(row.iterfind("m:c", ns)):
            letters = re.match(r"[A-Z]+", cell.get("r", ""))
            at = k
            if letters:
                at = 0
                for letter in letters[0]:
                    at = at * 26 + ord(letter) - 64
                at -= 1
            kind, value = cell.get("t"), cell.find("m:v", ns)
            if kind == "inlineStr":
                cells[at] = "".join(t.text or "" for t in cell.iterfind(".//m:t", ns))
            elif value is not None and value.text is not None:
                cells[at] = shared[int(value.text)] if kind == "s" else value.text
        out.append([cells.get(i) for i in range(max(cells) + 1)] if cells else [])
    return out


class XlsxReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def read(self, partition):
        with open(self.path, "rb") as f:
            for k, cells in enumerate(sheet_rows(f.read())):
                yield (k, cells)


class XlsxSource(DataSource):
    """``row, cells``: the first sheet of an XLSX file."""

    @classmethod
    def name(cls):
        return "xlsxrows"

    def schema(self):
        return "row int, cells array<string>"

    def reader(self, schema):
        return XlsxReader(self.options)


SOURCES = (NpySource, ZipSource, XzSource, XlsxSource)


def register(spark: SparkSession) -> None:
    for source in SOURCES:
        spark.dataSource.register(source)


def fetch(url: str, path: str, tries: int = 3, timeout: float = 60.0, pause: float = 1.0) -> str:
    """Downloads a shard on the driver, with growing pauses between tries; the file appears only when it is whole."""
    import os
    import time
    import urllib.request

    if os.path.exists(path):
        return path
    for attempt in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as got, open(path + ".part", "wb") as f:  # noqa: S310
                while block := got.read(1 << 20):
                    f.write(block)
            os.replace(path + ".part", path)
            return path
        except OSError:
            if attempt == tries - 1:
                raise
            time.sleep(pause * 2**attempt)
    return path
