"""Binary tables of FITS files as a data source: ``spark.read.format("fits")`` and ``df.write.format("fits")``.

Rows of a binary table have a fixed length, so that a range of rows is a range of bytes: partitions are ranges of at most
``bytesPerPartition`` (64 MB) of any file, and a task reads its own range only. Files are opened by pyarrow's file
systems, so paths may be local, ``hdfs://``, ``s3://`` or ``gs://``, as long as driver and executors can reach them.

Columns may be logical (L), whole numbers (B, I, J, K, with TNULL, and TSCAL and TZERO), floating (E, D) and text (A),
each also as an array of fixed length but for text. Complex numbers, bits and heaps raise an error. Nulls: NaN for
floating numbers, the least value (TNULL) for whole ones, the zero byte for logicals, empty text for text, which reads
back as empty. Tasks write files of at most ``bytesPerFile`` (64 MB) each, under names that only a successful job
makes final.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

BLOCK, CARD = 2880, 80  # fixed values of the format: bytes of a block and of a header line
#: Fixed values of the format: code of a column, its numbers in NumPy, its type in Spark.
KINDS = {"L": ("S1", T.BooleanType()), "B": ("u1", T.ShortType()), "I": (">i2", T.ShortType()), "J": (">i4", T.IntegerType()), "K": (">i8", T.LongType()), "E": (">f4", T.FloatType()), "D": (">f8", T.DoubleType())}
CODES = {T.BooleanType(): "L", T.ByteType(): "I", T.ShortType(): "I", T.IntegerType(): "J", T.LongType(): "K", T.FloatType(): "E", T.DoubleType(): "D"}
MOST = 64 << 20


@dataclass
class Column:
    """One field of a table: ``count`` numbers (or characters) of ``code``."""

    name: str
    code: str
    count: int
    null: int | None = None
    scale: float = 1.0
    zero: float = 0.0

    @property
    def numpy(self) -> tuple:
        return (self.name, f"S{self.count}") if self.code == "A" else (self.name, KINDS[self.code][0], (self.count,))

    @property
    def spark(self) -> T.DataType:
        if self.code == "A":
            return T.StringType()
        kind = KINDS[self.code][1]
        if self.code in "BIJK" and (self.scale, self.zero) != (1.0, 0.0):
            kind = T.LongType() if self.scale == 1.0 and self.zero == int(self.zero) else T.DoubleType()
        return kind if self.count == 1 else T.ArrayType(kind)

    def decoded(self, raw: np.ndarray) -> pa.Array:
        """The column's values of a structured array."""
        own = raw[self.name]
        if self.code == "A":
            return pa.array([v.decode("ascii", "replace").rstrip(" \0") for v in own.tolist()], pa.string())
        flat = own.reshape(-1)
        if self.code == "L":
            made = pa.array(flat == b"T", mask=flat == b"")
        elif self.code in "ED":
            made = pa.array(flat.astype(flat.dtype.newbyteorder("=")), from_pandas=True)
        else:
            empty = flat == self.null if self.null is not None else np.zeros(len(flat), bool)
            kind = self.spark.elementType if self.count != 1 else self.spark
            wide = flat.astype("i2" if kind == T.ShortType() else "i4" if kind == T.IntegerType() else "i8")
            made = pa.array(wide * self.scale + self.zero if kind == T.DoubleType() else wide + int(self.zero) if self.zero else wide, mask=empty)
        return made if self.count == 1 else pa.FixedSizeListArray.from_arrays(made, self.count).cast(pa.list_(made.type)) if self.count else pa.array([[]] * len(own), pa.list_(made.type))


@dataclass
class Layout:
    """Where a file's table lies: the columns, the first row's byte, rows and their bytes."""

    columns: list[Column]
    start: int
    rows: int
    width: int


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _header(file) -> dict[str, object]:
    """The cards of the next header; the file stands at its data."""
    cards: dict[str, object] = {}
    while True:
        block = file.read(BLOCK)
        if len(block) < BLOCK:
            raise ValueError("no binary table in this file")
        for lo in range(0, BLOCK, CARD):
            card = bytes(block[lo : lo + CARD]).decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return cards
            if card[8:10] == "= ":
                text = re.match(r"\s*'((?:[^']|'')*)'", card[10:])
                value = text[1].replace("''", "'").rstrip() if text else card[10:].split("/")[0].strip()
                cards[key] = value if text else {"T": True, "F": False}.get(value, value)


def layout(path: str) -> Layout:
    """The first binary table of a file, by its headers alone."""
    system, name = open_path(path)
    with system.open_input_file(name) as file:
        while True:
            cards = _header(file)
            axes = [int(cards[f"NAXIS{i + 1}"]) for i in range(int(cards.get("NAXIS", 0)))]
            if cards.get("XTENSION") == "BINTABLE":
                break
            size = abs(int(cards.get("BITPIX", 8))) // 8 * int(np.prod(axes)) * (1 if axes else 0) + int(cards.get("PCOUNT", 0))
            file.seek(file.tell() + -(-size // BLOCK) * BLOCK)
        start = file.tell()
    columns = []
    for i in range(1, int(cards["TFIELDS"]) + 1):
        form = re.fullmatch(r"(\d*)([A-Z])(.*)", str(cards[f"TFORM{i}"]).strip())
        if not form or form[2] not in (*KINDS, "A"):
            raise ValueError(f"columns of format {cards[f'TFORM{i}']} are not read")
        null = cards.get(f"TNULL{i}")
        number = lambda key: float(str(cards.get(key)).replace("D", "E"))  # noqa: B023, E731
        columns.append(Column(str(cards.get(f"TTYPE{i}", f"col{i}")), form[2], int(form[1] or 1), None if null is None else int(str(null)), number(f"TSCAL{i}") if f"TSCAL{i}" in cards else 1.0, number(f"TZERO{i}") if f"TZERO{i}" in cards else 0.0))
    return Layout(columns, start, axes[1], axes[0])


def _files(path: str) -> list[str]:
    system, name = open_path(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(name))
    return [f"{path.rstrip('/')}/{f.base_name}" for f in sorted(found, key=lambda f: f.base_name) if f.is_file and re.search(r"\.(fits?|fts)$", f.base_name, re.I)]


@dataclass
class Rows(InputPartition):
    path: str
    columns: list[Column]
    start: int
    count: int
    width: int


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, most: int):
        self.path, self.schema, self.most = path, schema, most

    def partitions(self) -> list[Rows]:
        out = []
        for path in _files(self.path):
            table = layout(path)
            step = max(1, self.most // max(1, table.width))
            out += [Rows(path, table.columns, table.start + lo * table.width, min(step, table.rows - lo), table.width) for lo in range(0, table.rows, step)]
        return out or [Rows("", [], 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        system, name = open_path(partition.path)
        kind = np.dtype([c.numpy for c in partition.columns])
        if kind.itemsize != partition.width:
            raise ValueError(f"rows of {partition.width} bytes whose columns take {kind.itemsize}")
        by = {c.name: c for c in partition.columns}
        with system.open_input_file(name) as file:
            step = max(1, (4 << 20) // partition.width)
            for lo in range(0, partition.count, step):
                n = min(step, partition.count - lo)
                raw = np.frombuffer(file.read_at(n * partition.width, partition.start + lo * partition.width), kind)
                yield pa.RecordBatch.from_arrays([by[f.name].decoded(raw) for f in self.schema], names=self.schema.names)


def _card(key: str, value) -> bytes:
    text = f"'{str(value):<8}'" if isinstance(value, str) else f"{'T' if value is True else value!s:>20}"
    return f"{key:<8}= {text}".ljust(CARD).encode("ascii")


def _padded(body: bytes, fill: bytes) -> bytes:
    return body + fill * (-len(body) % BLOCK)


def encoded(table: pa.Table, schema: T.StructType) -> bytes:
    """A whole file: an empty primary header and one binary table."""
    columns, arrays = [], []
    for field in schema:
        column = table[field.name].combine_chunks()
        kind, size = field.dataType, 1
        if isinstance(kind, T.ArrayType):
            sizes = set(column.value_lengths().drop_null().to_pylist())
            if len(sizes) > 1 or column.null_count:
                raise ValueError(f"arrays of {field.name} must have one length and no nulls")
            size, kind, column = sizes.pop() if sizes else 1, kind.elementType, column.flatten()
        if kind == T.StringType():
            if isinstance(field.dataType, T.ArrayType):
                raise ValueError(f"{field.name}: arrays of text have no column")
            texts = [(v or "").encode("ascii", "replace") for v in column.to_pylist()]
            columns.append(Column(field.name, "A", max([1, *map(len, texts)])))
            arrays.append(np.array(texts, f"S{columns[-1].count}"))
            continue
        if kind not in CODES:
            raise ValueError(f"{field.name}: {kind.simpleString()} has no column")
        code = CODES[kind]
        if code == "L":
            values = np.array([b"" if v is None else b"T" if v else b"F" for v in column.to_pylist()], "S1")
        elif code in "ED":
            values = column.to_numpy(zero_copy_only=False).astype(KINDS[code][0])
        else:
            least = int(np.iinfo(KINDS[code][0]).min)
            values = column.fill_null(least if kind != T.ByteType() else 0).to_numpy(zero_copy_only=False).astype(KINDS[code][0])
            values[column.is_null().to_numpy(zero_copy_only=False)] = least
        columns.append(Column(field.name, code, size, int(np.iinfo(KINDS[code][0]).min) if code in "IJK" else None))
        arrays.append(values.reshape(table.num_rows, size))
    kind = np.dtype([c.numpy for c in columns])
    rows = np.zeros(table.num_rows, kind)
    for column, values in zip(columns, arrays):
        rows[column.name] = values
    head = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", kind.itemsize), ("NAXIS2", table.num_rows), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(columns))]
    for i, c in enumerate(columns, 1):
        head += [(f"TTYPE{i}", c.name), (f"TFORM{i}", f"{c.count}{c.code}"), *([(f"TNULL{i}", c.null)] if c.null is not None else [])]
    end = b"END".ljust(CARD)
    first = b"".join(_card(*x) for x in (("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True)))
    return _padded(first + end, b" ") + _padded(b"".join(_card(*x) for x in head) + end, b" ") + _padded(rows.tobytes(), b"\0")


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool, most: int):
        self.path, self.schema, self.overwrite, self.most, self.job = path.rstrip("/"), schema, overwrite, most, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = open_path(f"{self.path}/_temporary-{self.job}")
        names, held, size = [], [], 0

        def flush() -> None:
            nonlocal held, size
            if held:
                system.create_dir(base, recursive=True)
                names.append(f"part-{uuid.uuid4().hex}.fits")
                with system.open_output_stream(f"{base}/{names[-1]}") as out:
                    out.write(encoded(pa.Table.from_batches(held), self.schema))
                held, size = [], 0

        for batch in iterator:
            step = max(1, self.most * batch.num_rows // max(1, batch.nbytes))
            for part in (batch.slice(lo, step) for lo in range(0, batch.num_rows, step)):
                held.append(part)
                size += part.nbytes
                if size >= self.most:
                    flush()
        flush()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = open_path(self.path)
        system.create_dir(base, recursive=True)
        if self.overwrite:
            for old in _files(self.path):
                system.delete_file(open_path(old)[1])
        names = [n for m in messages if m for n in m.names]
        for name in names:
            system.move(f"{base}/_temporary-{self.job}/{name}", f"{base}/{name}")
        if not names and not _files(self.path):  # no rows: a table of none keeps the columns
            with system.open_output_stream(f"{base}/part-{uuid.uuid4().hex}.fits") as out:
                out.write(encoded(_empty(self.schema), self.schema))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, base = open_path(f"{self.path}/_temporary-{self.job}")
        if system.get_file_info(base).type == fs.FileType.Directory:
            system.delete_dir(base)


def _empty(schema: T.StructType) -> pa.Table:
    kinds = {T.StringType(): pa.string(), T.BooleanType(): pa.bool_(), T.ByteType(): pa.int8(), T.ShortType(): pa.int16(), T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.FloatType(): pa.float32(), T.DoubleType(): pa.float64()}
    kind = lambda t: pa.list_(kinds[t.elementType]) if isinstance(t, T.ArrayType) else kinds[t]
    return pa.table({f.name: pa.array([], kind(f.dataType)) for f in schema})


class FitsSource(DataSource):
    """Options: ``path``, a file or a folder of files with equal columns; ``bytesPerPartition``, ``bytesPerFile``."""

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> T.StructType:
        files = _files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no FITS files in {self.options['path']}")
        return T.StructType([T.StructField(c.name, c.spark) for c in layout(files[0]).columns])

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"], schema, int(self.options.get("bytesPerPartition", MOST)))

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, overwrite, int(self.options.get("bytesPerFile", MOST)))


def register(spark: SparkSession) -> None:
    """Make ``fits`` known to a session."""
    spark.dataSource.register(FitsSource)
