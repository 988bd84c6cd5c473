"""The folder that all executors share, and sorted hash arrays kept in it.

A set of arrays is cut into shards by ranges of the 64-bit key; each shard is written
once by the task that merged it (under another name first, so a repeated task does no
harm) and memory-mapped by whoever looks keys up. A lookup touches only the pages that
its keys fall on; nothing is broadcast or collected but the number of keys in each shard, by
which a reader tells a shard that is empty from one that it can't see: the latter raises.
"""

from __future__ import annotations

import ctypes
import gc
import mmap
import os
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def _files(spark: SparkSession, path: str):
    """Hadoop's path and file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_local(spark: SparkSession) -> bool:
    """Whether all tasks run in the driver's own process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI under spark.checkpoint.dir; it goes when the session's JVM ends. Without that setting there is a folder only if all tasks run on this machine."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/siltstream-{os.getpid()}"
        context.setCheckpointDir(base)
    at, files = _files(spark, f"{str(base).rstrip('/')}/siltstream/{name}-{uuid.uuid4().hex[:12]}")
    files.mkdirs(at)
    files.deleteOnExit(at)
    return str(files.makeQualified(at).toString())


def inner_folder(spark: SparkSession, uri: str) -> str:
    at, files = _files(spark, uri)
    files.mkdirs(at)
    return uri


def drop_folder(spark: SparkSession, uri: str) -> None:
    """Deletes what nothing reads any more, before the session ends."""
    at, files = _files(spark, uri)
    files.delete(at, True)


def through_table(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """df, written to the shared folder (or into one there) and read again: its lineage ends here."""
    path = f"{folder or shared_folder(df.sparkSession, name)}/{name if folder else 'table'}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession, size: int) -> None:
    """After a job on `size` bytes (a few are not worth the second and a half): lets Spark's cleaner delete the shuffle files of jobs that are done and whose frames nothing holds: they count against the disks for as long as the driver's heap has not been collected, which a driver that does little else seldom does. What the last command returned is held until the next one, and what is detached goes a little later: hence three times."""
    for _ in range(3 if size > SHARD_BYTES else 0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def parts_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _local(uri: str) -> str | None:
    return uri[5:].replace("///", "/", 1) if uri.startswith("file:") else uri if uri.startswith("/") else None


def shard_starts(shards: int) -> np.ndarray:
    """The least key of each shard; a key's upper 32 bits tell its shard, so that Spark can work it out (shard_column) without unsigned 64-bit numbers."""
    return np.array([-(-(s << 32) // shards) << 32 for s in range(shards)], U64)


def shard_column(key: Column, shards: int) -> Column:
    """The shard of a key that Spark holds as a signed number."""
    return F.floor(F.shiftrightunsigned(key, 32) * F.lit(shards) / F.lit(float(1 << 32))).cast("int")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes, plane by plane; the first is sorted and stored as differences. Planes of zeros vanish in Spark's compression."""
    out = []
    for k, a in enumerate(arrays):
        if k == 0:
            a = np.diff(a, prepend=a.dtype.type(0))
        out.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
    return b"".join(out)


def unpack(blob: bytes, *types) -> list[np.ndarray]:
    types = [np.dtype(t) for t in types]
    n, at, out = len(blob) // sum(t.itemsize for t in types), 0, []
    for k, t in enumerate(types):
        a = np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * t.itemsize, at).reshape(t.itemsize, n).T).view(t).reshape(n)
        at += n * t.itemsize
        out.append(np.cumsum(a, dtype=t) if k == 0 else a)
    return out


def by_shard(shards: int, keys: np.ndarray, *columns: np.ndarray) -> list[tuple[int, bytes]]:
    """(shard, packed arrays) of sorted keys and their columns."""
    edges = np.append(np.searchsorted(keys, shard_starts(shards)), len(keys))
    return [(s, pack(keys[a:b], *(c[a:b] for c in columns))) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]


def write_file(uri: str, data) -> None:
    """Under another name first: whoever reads it finds all of it."""
    if path := _local(uri):
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
    else:
        files, path = pafs.FileSystem.from_uri(uri)
        part = f"{path}.{uuid.uuid4().hex}"
        with files.open_output_stream(part) as f:
            f.write(bytes(data))
        files.move(part, path)


def read_file(uri: str) -> bytes:
    if path := _local(uri):
        with open(path, "rb") as f:
            return f.read()
    files, path = pafs.FileSystem.from_uri(uri)
    with files.open_input_stream(path) as f:
        return f.read()


def map_file(uri: str, kind: np.dtype) -> np.ndarray:
    """A file of the shared folder, mapped into memory. It raises, if the file isn't there: the folder is not shared."""
    path = _local(uri)
    if path:
        f = open(path, "rb")
    else:
        files, at = pafs.FileSystem.from_uri(uri)
        f = tempfile.TemporaryFile()  # has no name: it goes with its map
        with files.open_input_stream(at) as source:
            while block := source.read(1 << 20):
                f.write(block)
        f.flush()
    with f:
        size = os.fstat(f.fileno()).st_size
        return np.frombuffer(mmap.mmap(f.fileno(), size, prot=mmap.PROT_READ), kind) if size else np.zeros(0, kind)


def narrowed(a: np.ndarray) -> np.ndarray:
    """Unsigned numbers in as few bytes as the largest needs."""
    most = int(a.max()) if len(a) else 0
    return a.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))


def write_shard(uri: str, shard: int, tables: tuple[str, ...] = (), **columns: np.ndarray) -> None:
    """Unsigned columns but the key and the tables are narrowed: a reader tells their width by the file's size."""
    for name, a in columns.items():
        if name != "key" and name not in tables and a.dtype.kind == "u":
            a = narrowed(a)
        write_file(f"{uri}/{shard:06d}.{name}", np.ascontiguousarray(a).data)


def coded(*columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Columns that together have few different rows: each row's number among these, and the columns of these."""
    order = np.lexsort(columns)
    new = np.ones(len(order), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    codes = np.empty(len(order), np.uint64)
    codes[order] = (np.cumsum(new) - 1).astype(np.uint64)
    return codes, [c[order[new]] for c in columns]


class HashArrays:
    """Sorted keys in shards, with columns of values; opened lazily, one memory map for each file. sizes: the keys of each shard. A type such as "code:f8" is a column of numbers of rows in a table of its own, the numbers being in the column `code`."""

    opened: dict[str, "HashArrays"] = {}

    def __init__(self, uri: str, sizes: list[int], types: dict[str, str]):
        self.uri, self.types, self.sizes, self.starts = uri, {"key": "u8"} | types, sizes, shard_starts(len(sizes))
        self.maps: dict[tuple[int, str], np.ndarray] = {}

    @classmethod
    def at(cls, uri: str, sizes: list[int], types: dict[str, str]) -> "HashArrays":
        """The one that this process has open already, if it has. Those of other folders are closed: their stage is over, or will open them again."""
        if uri not in cls.opened:
            root = uri.rpartition("/")[0]
            for other in [u for u in cls.opened if u.rpartition("/")[0] != root]:
                del cls.opened[other]
            cls.opened[uri] = cls(uri, sizes, types)
        return cls.opened[uri]

    def column(self, shard: int, name: str) -> np.ndarray:
        if (shard, name) not in self.maps:
            if ":" in self.types[name]:
                self.maps[shard, name] = map_file(f"{self.uri}/{shard:06d}.{name}", np.dtype(self.types[name].partition(":")[2])) if self.sizes[shard] else np.zeros(0, self.types[name].partition(":")[2])
                return self.maps[shard, name]
            self.maps[shard, name] = self._map(f"{self.uri}/{shard:06d}.{name}", self.sizes[shard], np.dtype(self.types[name])) if self.sizes[shard] else np.zeros(0, self.types[name])
        return self.maps[shard, name]

    def _map(self, uri: str, n: int, kind: np.dtype) -> np.ndarray:
        raw = map_file(uri, np.dtype(np.uint8))
        size = len(raw)
        if size % n or not size // n <= kind.itemsize or kind.kind != "u" and size // n != kind.itemsize:
            raise OSError(f"{uri} has {size} bytes for {n} keys")
        return raw.view(f"{kind.kind}{size // n}")

    def find(self, keys: np.ndarray, *names: str, missing=0) -> list[np.ndarray]:
        """Whether each of the sorted distinct keys is there, then its values (`missing`, if not). The column "at" is its place: shard << 40 | index."""
        found = np.zeros(len(keys), bool)
        out = [np.full(len(keys), missing, np.int64 if n == "at" else self.types[n].rpartition(":")[2]) for n in names]
        edges = np.append(np.searchsorted(keys, self.starts), len(keys))
        for s in np.flatnonzero(np.diff(edges)):
            a, b = edges[s], edges[s + 1]
            have = self.column(int(s), "key")
            if not len(have):
                continue
            at = np.searchsorted(have, keys[a:b])
            at[at == len(have)] = 0
            ok = have[at] == keys[a:b]
            found[a:b] = ok
            for o, n in zip(out, names, strict=True):
                if n == "at":
                    o[a:b][ok] = (int(s) << 40) | at[ok]
                elif code := self.types[n].rpartition(":")[0]:
                    o[a:b][ok] = self.column(int(s), n)[self.column(int(s), code)[at[ok]]]
                else:
                    o[a:b][ok] = self.column(int(s), n)[at[ok]]
        return [found, *out]


#: Text that one shard's task adds up.
SHARD_BYTES = 64 << 20


def text_bytes(texts: DataFrame, text: str = "text") -> int:
    return texts.agg(F.sum(F.octet_length(text))).first()[0] or 0


def shards_for(spark: SparkSession, size: int) -> int:
    """How many shards the counts of so many bytes of text are cut into: by their measured size, so that a task's share doesn't grow with it; at least one for each shuffle partition."""
    return max(2, parts_for(spark), -(-size // SHARD_BYTES))


def sizes_of(rows, shards: int) -> list[int]:
    """By shard, of rows (shard, n): the shards that no row names are empty."""
    out = [0] * shards
    for r in rows:
        out[r["shard"]] = r["n"]
    return out


_stage: list[str] = []
_caches: list[dict] = []


def cache() -> dict:
    """A table that a worker keeps from batch to batch, emptied when another operator begins."""
    _caches.append({})
    return _caches[-1]


def begin_stage(name: str) -> None:
    """Called by a worker's function before its first batch: a worker process serves one operator after another, so what the last one kept (maps, automata, tables, freed but unreturned memory) goes first."""
    if _stage == [name]:
        return
    _stage[:] = [name]
    HashArrays.opened.clear()
    for held in _caches:
        held.clear()
    gc.collect()
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: what numpy and Arrow have let go stays with the process otherwise, beside the next step's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass
