"""Structure files as data sources of Spark: `spark.read.format("pdb")`, `"mol2"` and `"hhm"` (A3, A4, A9), after `register`.

A large plain file is read by many tasks: each takes a range of bytes, from the first mark (a MODEL line, a molecule) in it to the first mark behind it, and
streams it by pieces. Compressed files are one range. Files are opened by pyarrow's file systems (local or mounted folders, file://, hdfs://, s3://, gs://); paths
of stores that only Spark's own readers know go through `text`.
"""

from __future__ import annotations

import gzip
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .text import FILE_NAME, with_ca

#: Bytes of a range, and of a piece that a task holds.
SPLIT, PIECE = 64 << 20, 1 << 20


def _local(path: str) -> str | None:
    """The local path that a path or file: URI names."""
    return re.sub(r"^file:(//[^/]*)?(?=/)", "", path) if path.startswith("file:") or ":/" not in path else None


def _open(path: str) -> BinaryIO:
    """A file as bytes, unpacked if it ends in .gz. Local files are opened by Python itself, which starts no threads in Spark's workers."""
    local = _local(path)
    if local is not None:
        return gzip.open(local, "rb") if local.endswith(".gz") else open(local, "rb")
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_stream(inner, compression="gzip") if inner.endswith(".gz") else system.open_input_file(inner)


def _below(folder: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file or of all files below a folder."""
    local = _local(folder)
    if local is not None:
        if os.path.isfile(local):
            return [(local, os.path.getsize(local))]
        if not os.path.isdir(local):
            raise FileNotFoundError(folder)
        return [(p, os.path.getsize(p)) for top, _, names in os.walk(local) for p in (os.path.join(top, n) for n in names)]
    system, inner = fs.FileSystem.from_uri(folder)
    info = system.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    head = folder[: len(folder) - len(inner)]
    return [(head + x.path, x.size) for x in found if x.type == fs.FileType.File]


def _listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of the files below a folder, or of those that a pattern with `*` matches; names that begin with `_` or `.` are none."""
    path = _local(path) or path
    fixed = (path.split("*")[0].rsplit("/", 1)[0] if "*" in path else path).rstrip("/")
    pattern = re.compile("[^/]*".join(re.escape(x) for x in path.split("*")) if "*" in path else re.escape(fixed) + "(/.*)?")
    hidden = lambda p: any(x[:1] in ("_", ".") for x in p[len(fixed) :].split("/") if x)
    return sorted((p, n) for p, n in _below(fixed) if pattern.fullmatch(p) and not hidden(p))


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def lines(part: Range | None, mark: bytes) -> Iterator[list[str]]:
    """The lines of a range by pieces: from its first line that begins with the mark (from the file's first line, if it starts there) to before
    the first such line behind it."""
    if part is None:  # Spark reads no range where none is planned
        return
    packed = part.path.endswith(".gz")
    with _open(part.path) as file:
        # The byte before the range tells whether a line begins with it.
        at = max(part.start - 1, 0)
        if at:
            file.seek(at)
        inside, partial, rest = part.start == 0, part.start > 0, b""
        while True:
            piece = file.read(PIECE)
            block = rest + piece
            cut = block.rfind(b"\n") + 1 if piece else len(block)
            rest, out = block[cut:], []
            for line in block[:cut].splitlines(keepends=True):
                if partial:
                    partial = False
                else:
                    if mark and line.startswith(mark):
                        if at >= part.end and not packed:
                            yield out
                            return
                        inside = True
                    if inside:
                        out.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                at += len(line)
            yield out
            if not piece:
                return


class MarkedReader(DataSourceReader):
    """Plans ranges of the files of a path, without those that a filter on their names rules out."""

    mark = b""
    named = "pdb_name"

    def __init__(self, options: dict[str, str]):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT))
        self.pattern = options.get("name", FILE_NAME)
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the name choose files; all others are Spark's."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute != (self.named,):
                yield f
            else:
                self.wanted = values if self.wanted is None else self.wanted & values

    def name_of(self, path: str) -> str:
        found = re.search(self.pattern, path)
        return found[1] if found else ""

    def partitions(self) -> list[Range]:
        out = []
        for path, size in _listed(self.path):
            if self.wanted is not None and self.name_of(path) not in self.wanted:
                continue
            step = size if path.endswith(".gz") or not self.mark else self.split
            out += [Range(path, a, min(a + step, size)) for a in range(0, max(size, 1), max(step, 1))]
        return out


def _cut(rows: pa.Array, start: int, end: int) -> pa.Array:
    """Columns of fixed-width lines, numbered from 1."""
    return pc.utf8_trim_whitespace(pc.utf8_slice_codeunits(rows, start - 1, end))


_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _numbers(texts: pa.Array) -> pa.Array:
    return pc.if_else(pc.match_substring_regex(texts, _NUMBER), texts, pa.scalar(None, pa.string())).cast(pa.float64())


class PdbReader(MarkedReader):
    mark = b"MODEL "

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        name, model = self.name_of(part.path) if part else "", "0"
        letter = name[4:5].upper()
        for piece in lines(part, self.mark):
            if not piece:
                continue
            heads = [k for k, x in enumerate(piece) if x.startswith("MODEL ")]
            models = [model, *(piece[k][6:16].strip() for k in heads)]
            of = np.searchsorted(np.array(heads, np.int64), np.arange(len(piece)), "right")
            model = models[-1]
            keep = np.array([k for k, x in enumerate(piece) if x.startswith("ATOM") and not x.rstrip(" ").endswith("H")], np.int64)
            rows = pa.array([piece[k] for k in keep], pa.string())
            chain, element, atom = _cut(rows, 22, 22), _cut(rows, 77, 78), _cut(rows, 13, 16)
            capital = pc.struct_field(pc.extract_regex(atom, r"(?P<e>[A-Z])"), "e")
            columns = {
                "pdb_name": pa.array([name] * len(rows), pa.string()), "model": pa.array([models[of[k]] for k in keep], pa.string()),
                "chain": pc.if_else(pc.equal(chain, ""), letter, chain), "residue": _cut(rows, 23, 27), "resname": _cut(rows, 18, 20),
                "x": _numbers(_cut(rows, 31, 38)), "y": _numbers(_cut(rows, 39, 46)), "z": _numbers(_cut(rows, 47, 54)),
                "element": pc.if_else(pc.equal(element, ""), pc.fill_null(capital, ""), element), "atom_name": atom, "aid": _cut(rows, 7, 11),
            }
            yield pa.RecordBatch.from_pydict(columns)


class Mol2Reader(MarkedReader):
    mark = b"@<TRIPOS>MOLECULE"

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        name, molecule, section, atoms, rows = self.name_of(part.path) if part else "", None, "", 0, []

        def number(x: list[str], k: int) -> float | None:
            return float(x[k]) if len(x) > k and re.match(_NUMBER, x[k]) else None

        def closed() -> list[tuple]:
            return [] if molecule is None or atoms else [(name, molecule, "0", None, None, None, None, None, None, "no ATOM block")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string()] * 3 + [pa.float64()] * 3 + [pa.string()] * 4
            names = ["pdb_name", "molecule", "model", "x", "y", "z", "element", "atom_name", "aid", "error"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for piece in lines(part, self.mark):
            for line in piece:
                if line.startswith("@<TRIPOS>"):
                    section = line[9:].strip()
                    if section == "MOLECULE":
                        rows += closed()
                        molecule, atoms = "", 0
                elif section == "MOLECULE" and molecule == "":
                    molecule = line.strip()
                elif section == "ATOM" and line.strip():
                    x = line.split()
                    at = [number(x, k) for k in (2, 3, 4)]
                    kind = x[5].split(".")[0] if len(x) > 5 else None
                    molecule, atoms = molecule or "", atoms + 1
                    rows.append((name, molecule, "0", *at, kind, x[1] if len(x) > 1 else None, x[0], None if None not in at else "bad coordinates"))
            if rows:
                yield batch(rows)
                rows = []
        if rows := closed():
            yield batch(rows)


class HhmReader(MarkedReader):
    named = "path"

    def name_of(self, path: str) -> str:
        return path

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        """Two passes over a file, which hold a piece each: where its head ends, then its positions."""
        head, n = -1, 0
        for piece in lines(part, b""):
            for line in piece:
                head = n if line.startswith("#") else head
                n += 1
        share = lambda t: 0.0 if t == "*" else 2.0 ** (-float(t) / 1000)
        at, position, now, done = 0, 0, None, []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*done))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["path", "position", "residue", "emissions", "transitions"])

        for piece in lines(part, b""):
            for line in piece:
                at += 1
                t = line.split()
                if not (head + 5 < at - 1 <= n - 3) or not t:
                    continue
                if len(t) == 23:
                    if now:
                        done.append(tuple(now))
                    now = [part.path, position, t[0], [share(x) for x in t[2:22]], None]
                    position += 1
                elif len(t) == 10 and now:
                    now[4] = [share(x) for x in t]
                elif len(t) != 10:
                    raise ValueError(f"profile line with {len(t)} tokens")
            if done:
                yield batch()
                done = []
        if now:
            done.append(tuple(now))
            yield batch()


class PdbSource(DataSource):
    reads = PdbReader

    @classmethod
    def name(cls) -> str:
        return "pdb"

    def schema(self) -> str:
        return "pdb_name string, model string, chain string, residue string, resname string, x double, y double, z double, element string, atom_name string, aid string"

    def reader(self, schema) -> DataSourceReader:
        return self.reads(self.options)


class Mol2Source(PdbSource):
    reads = Mol2Reader

    @classmethod
    def name(cls) -> str:
        return "mol2"

    def schema(self) -> str:
        return "pdb_name string, molecule string, model string, x double, y double, z double, element string, atom_name string, aid string, error string"


class HhmSource(PdbSource):
    reads = HhmReader

    @classmethod
    def name(cls) -> str:
        return "hhm"

    def schema(self) -> str:
        return "path string, position long, residue string, emissions array<double>, transitions array<double>"


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session, and lets filters reach them. Options: path, name (a pattern whose first group is a file's name) and
    splitBytes."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (PdbSource, Mol2Source, HhmSource):
        spark.dataSource.register(source)


def load_pdb_atoms(spark: SparkSession, path: str, name: str = FILE_NAME, split_bytes: int = SPLIT) -> DataFrame:
    """The rows of `text.read_pdb_atoms`, of files of any size (A3)."""
    register(spark)
    return with_ca(spark.read.format("pdb").option("name", name).option("splitBytes", split_bytes).load(path))
