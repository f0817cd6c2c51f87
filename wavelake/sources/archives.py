"""Archives of windows as Python data sources.

`format("pickled")` reads pickles of {(class, snr): windows}, one partition
for each key. Unpickling runs code, so the option `trust` must be "true".
`format("npz")` reads arrays samples, labels, snr_db and class_names. The zip
directory and the arrays' headers say where each row's bytes are, so a partition
is a range of rows and its task reads these bytes alone. Compressed members
have no such places: then one task reads through the archive in pieces.
"""

from __future__ import annotations

import pickle
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wavelake.functions.dsp import fourier_resample as _fourier_resample
from wavelake.vocab import CHUNK

SCHEMA = "class string, snr_db float, chunk_idx int, i array<float>, q array<float>"
ARROW = pa.schema([("class", pa.string()), ("snr_db", pa.float32()), ("chunk_idx", pa.int32()), ("i", pa.list_(pa.float32())), ("q", pa.list_(pa.float32()))])


def _open(path: str):
    from pyarrow import fs as pafs

    fs, base = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    return fs.open_input_file(base)


class Key(InputPartition):
    def __init__(self, key):
        self.key = key


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.trust = options.get("trust") == "true"

    def emit(self, label: str, snr: np.ndarray, windows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Windows (n, 2, length) to 1024 samples and unit power."""
        if windows.shape[-1] != CHUNK:
            windows = _fourier_resample(windows.astype(float), CHUNK)
        power = np.mean((windows.astype(float) ** 2).sum(axis=1), axis=-1)
        windows = windows / np.sqrt(np.maximum(power, 1e-12))[:, None, None]
        for a in range(0, len(windows), 512):
            part = windows[a : a + 512].astype(np.float32)
            n = len(part)
            yield pa.RecordBatch.from_arrays([pa.array([label] * n), pa.array(snr[a : a + n].astype(np.float32)), pa.array(np.arange(a, a + n, dtype=np.int32)), pa.array(list(part[:, 0])), pa.array(list(part[:, 1]))], schema=ARROW)


class PickledReader(_Reader):
    def _load(self) -> dict:
        if not self.trust:
            raise ValueError('unpickling runs code: set .option("trust", "true") for files that you trust')
        with _open(self.path) as f:
            return pickle.loads(f.read(), encoding="latin1")

    def partitions(self):
        return [Key(k) for k in sorted(self._load(), key=str)] or [Key(None)]

    def read(self, part):
        if part.key is not None:
            x = np.asarray(self._load()[part.key])
            yield from self.emit(str(part.key[0]), np.full(len(x), float(part.key[1])), x)


class Rows(InputPartition):
    def __init__(self, begin: int, end: int):
        self.begin, self.end = begin, end


class Member:
    """An array of an archive: its type and shape, and for stored ones the place of its first byte."""

    def __init__(self, z: zipfile.ZipFile, f, name: str):
        info = z.getinfo(f"{name}.npy")
        with z.open(info) as m:
            version = np.lib.format.read_magic(m)
            shape, fortran, self.dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(m)
            header = m.tell()
        if fortran and len(shape) > 1 or self.dtype.hasobject:
            raise ValueError(f"{name}: arrays must be in C order and hold no objects")
        self.name, self.shape = name, shape
        self.row = self.dtype.itemsize * int(np.prod(shape[1:], dtype=np.int64))
        self.at = None
        if info.compress_type == zipfile.ZIP_STORED:
            f.seek(info.header_offset)
            # Name and extra field of the local header may differ from the directory's.
            name_length, extra_length = struct.unpack("<HH", f.read(30)[26:])
            self.at = info.header_offset + 30 + name_length + extra_length + header

    def array(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, dtype=self.dtype).reshape(-1, *self.shape[1:])

    def rows(self, f, begin: int, end: int) -> np.ndarray:
        f.seek(self.at + begin * self.row)
        return self.array(f.read((end - begin) * self.row))


class NpzReader(_Reader):
    #: Bytes of samples in a partition, and rows that are read at once.
    PART, PIECE = 64 << 20, 512

    def __init__(self, options: dict):
        super().__init__(options)
        # Spark passes option names in lower case.
        self.part = int({k.lower(): v for k, v in options.items()}.get("bytesperpartition", self.PART))

    def members(self, z: zipfile.ZipFile, f) -> list[Member]:
        out = [Member(z, f, n) for n in ("samples", "labels", "snr_db")]
        if len({m.shape[0] for m in out}) != 1:
            raise ValueError(f"{self.path}: samples, labels and snr_db differ in length")
        return out

    def partitions(self):
        with _open(self.path) as f, zipfile.ZipFile(f) as z:
            members = self.members(z, f)
        n = members[0].shape[0]
        step = max(1, self.part // max(1, members[0].row)) if all(m.at is not None for m in members) else max(1, n)
        return [Rows(a, min(n, a + step)) for a in range(0, n, step)] or [Rows(0, 0)]

    def pieces(self, z: zipfile.ZipFile, f, members: list[Member], part: Rows) -> Iterator[tuple[int, list[np.ndarray]]]:
        if all(m.at is not None for m in members):
            for a in range(part.begin, part.end, self.PIECE):
                yield a, [m.rows(f, a, min(part.end, a + self.PIECE)) for m in members]
            return
        # Each member is inflated once from its start, in step with the others.
        open_ = [z.open(f"{m.name}.npy") for m in members]
        for stream in open_:
            version = np.lib.format.read_magic(stream)
            (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)
        for a in range(part.begin, part.end, self.PIECE):
            n = min(part.end, a + self.PIECE) - a
            yield a, [m.array(s.read(n * m.row)) for m, s in zip(members, open_, strict=True)]

    def read(self, part):
        with _open(self.path) as f, zipfile.ZipFile(f) as z:
            if part.end <= part.begin:
                return
            with z.open("class_names.npy") as m:
                names = np.lib.format.read_array(m, allow_pickle=False)
            for a, (samples, labels, snr) in self.pieces(z, f, self.members(z, f), part):
                for batch in self.emit("", snr, samples):
                    label = pa.array([str(names[k]) for k in labels.tolist()], pa.string())
                    place = pa.array(np.arange(a, a + len(labels), dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([label, batch["snr_db"], place, batch["i"], batch["q"]], schema=ARROW)


class PickledSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pickled"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return PickledReader(dict(self.options))


class NpzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return NpzReader(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(PickledSource)
    spark.dataSource.register(NpzSource)
