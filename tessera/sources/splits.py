"""Data sources for files that Spark's own readers take whole: raw vectors by byte range, workbooks by sheet.

Both open files by ``pyarrow.fs``, so they must be on a mounted, Hadoop or object
store that it reaches; ``readers.read_vectors`` has a way for others. Register them with
``spark.dataSource.register``, as the readers do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that a task reads, unless ``split_bytes`` says otherwise.
SPLIT_BYTES = 64 << 20
#: Rows of an Arrow batch.
BATCH_ROWS = 8192


def listed(path: str) -> tuple[object, list]:
    """The file system of a path and its files in order of name: one file, a folder's, or those that a pattern in the last part matches."""
    from fnmatch import fnmatch

    from pyarrow import fs

    head, _, last = path.rpartition("/")
    if any(x in last for x in "*?["):
        store, root = fs.FileSystem.from_uri(head)
        found = [x for x in store.get_file_info(fs.FileSelector(root)) if x.is_file and fnmatch(x.base_name, last)]
    else:
        store, root = fs.FileSystem.from_uri(path)
        info = store.get_file_info(root)
        found = [info] if info.is_file else [x for x in store.get_file_info(fs.FileSelector(root)) if x.is_file and not x.base_name.startswith((".", "_"))]
    return store, sorted(found, key=lambda x: x.path)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    rows: int
    first: int


class RawVectors(DataSource):
    """``row long, vector array<float>`` from little-endian 32-bit floats, ``dims`` to a row; rows are numbered through all files, in order of their names.

    Options: ``path``, ``dims``, ``split_bytes``. A split's first row number follows
    from the files' sizes, so nothing has to be sorted or counted. A file that ends within a row is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "tessera_raw_vectors"

    def schema(self) -> str:
        return "row long, vector array<float>"

    def reader(self, schema) -> "RawVectorsReader":
        return RawVectorsReader(self.options)


class RawVectorsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.dims, self.split = options["path"], int(options["dims"]), int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[Range]:
        width, out, first = 4 * self.dims, [], 0
        per = max(1, self.split // width)
        for f in listed(self.path)[1]:
            if f.size % width:
                raise ValueError(f"{f.path} doesn't end with a row of {self.dims} numbers")
            n = f.size // width
            out += [Range(f.path, k * width, min(per, n - k), first + k) for k in range(0, n, per)]
            first += n
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range):
        import numpy as np
        import pyarrow as pa

        if not part.rows:
            return
        with listed(self.path)[0].open_input_file(part.path) as f:
            f.seek(part.start)
            for k in range(0, part.rows, BATCH_ROWS):
                n = min(BATCH_ROWS, part.rows - k)
                x = np.frombuffer(f.read(n * self.dims * 4), "<f4")
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * self.dims)
                yield pa.RecordBatch.from_arrays([pa.array(part.first + k + np.arange(n)), pa.ListArray.from_arrays(ends, pa.array(x))], names=["row", "vector"])


@dataclass
class Sheet(InputPartition):
    path: str
    number: int
    name: str


def _tag(e) -> str:
    return e.tag.rpartition("}")[2]


class Workbook(DataSource):
    """``file, sheet, row, col, value, link`` of the cells of workbooks, a task for each sheet.

    Options: ``path`` (a file, a folder or a pattern), ``sheet`` (a name or a number
    from 1; default: all). A sheet is read as a stream: a task holds one row, the strings
    that the sheets of its file share, and the sheet's links.
    """

    @classmethod
    def name(cls) -> str:
        return "tessera_workbook"

    def schema(self) -> str:
        return "file string, sheet string, row int, col string, value string, link string"

    def reader(self, schema) -> "WorkbookReader":
        return WorkbookReader(self.options)


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.wanted = options["path"], options.get("sheet")

    def partitions(self) -> list[Sheet]:
        import re
        import xml.etree.ElementTree as X
        import zipfile

        store, files = listed(self.path)
        out = []
        for f in files:
            with store.open_input_file(f.path) as raw, zipfile.ZipFile(raw) as book:
                numbers = sorted(int(m[1]) for n in book.namelist() if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
                names = [e.get("name") for e in X.fromstring(book.read("xl/workbook.xml")).iter() if _tag(e) == "sheet"] if "xl/workbook.xml" in book.namelist() else []
            named = [(n, names[i] if i < len(names) else f"sheet{n}") for i, n in enumerate(numbers)]
            out += [Sheet(f.path, n, name) for n, name in named if self.wanted is None or self.wanted in (name, str(n))]
        return out or [Sheet("", 0, "")]

    def read(self, part: Sheet):
        import re
        import xml.etree.ElementTree as X
        import zipfile

        if not part.number:
            return
        with listed(self.path)[0].open_input_file(part.path) as raw, zipfile.ZipFile(raw) as book:
            names = set(book.namelist())
            shared = ["".join(t.text or "" for t in si.iter() if _tag(t) == "t") for si in X.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
            rels_name = f"xl/worksheets/_rels/sheet{part.number}.xml.rels"
            rels = {r.get("Id"): r.get("Target") for r in X.fromstring(book.read(rels_name))} if rels_name in names else {}
            own = f"xl/worksheets/sheet{part.number}.xml"
            # links stand behind the cells, so the sheet is read twice
            links = {}
            with book.open(own) as f:
                for _, e in X.iterparse(f):
                    if _tag(e) == "hyperlink":
                        links[e.get("ref")] = rels.get(next((v for k, v in e.attrib.items() if k.endswith("}id")), ""))
                    elif _tag(e) == "row":
                        e.clear()
            file = part.path.rpartition("/")[2]
            with book.open(own) as f:
                for _, e in X.iterparse(f):
                    if _tag(e) != "row":
                        continue
                    for c in (c for c in e if _tag(c) == "c"):
                        letters, number = re.match(r"([A-Z]+)(\d+)", c.get("r")).groups()
                        value = next((v.text for v in c.iter() if _tag(v) in ("v", "t")), None)
                        if c.get("t") == "s" and value is not None:
                            value = shared[int(value)]
                        yield file, part.name, int(number), letters, value, links.get(c.get("r"))
                    e.clear()
