"""The adjacency of a network as arrays in the folder that driver and executors share: tasks map the files, so searches over it shuffle nothing."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurograph.sources.tables import run_once, shared_folder

#: Bits of a neighbour's code: an edge to it or from it that may match, and any edge to it or from it.
OUT, IN, ANY_OUT, ANY_IN = 1, 2, 4, 8
#: Neighbours that one task puts in order.
BLOCK = 2_000_000


def _place(url: str) -> tuple[pafs.FileSystem, str]:
    if "://" in url:
        return pafs.FileSystem.from_uri(url)
    return pafs.LocalFileSystem(), url.removeprefix("file:")


def load(url: str, kind: type) -> np.ndarray:
    """An array of a file: mapped where the folder is a local one, else read."""
    store, path = _place(url)
    if store.get_file_info(path).size == 0:
        return np.empty(0, kind)
    if isinstance(store, pafs.LocalFileSystem):
        return np.asarray(np.memmap(path, kind, "r"))
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def save(url: str, data) -> None:
    store, path = _place(url)
    with store.open_output_stream(path, compression=None) as f:
        f.write(data)


@dataclass(frozen=True)
class Adjacency:
    """Of ``nodes`` nodes, numbered from 0: the neighbours of node k, in order, and their codes as k sees them, lie from begin[k] to begin[k + 1]."""

    folder: str
    nodes: int
    size: int

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """begin, neighbours, codes."""
        return load(f"{self.folder}/begin", np.int64), load(f"{self.folder}/near", np.int32), load(f"{self.folder}/code", np.uint8)

    def drop(self) -> None:
        store, path = _place(self.folder)
        store.delete_dir(path)


def _joined(folder: str, nodes: int, parts: DataFrame) -> Adjacency:
    """One file each from the parts (first, file, counts) that tasks have written; those of tasks that ran twice go, too."""
    found = sorted(parts.collect(), key=lambda r: r["first"])
    begin = np.zeros(nodes + 1, np.int64)
    for r in found:
        n = np.frombuffer(bytes(r["counts"]), np.int32)
        begin[r["first"] + 1 : r["first"] + 1 + len(n)] = n
    np.cumsum(begin, out=begin)
    save(f"{folder}/begin", begin)
    store, path = _place(folder)
    for kind in ("near", "code"):
        with store.open_output_stream(f"{path}/{kind}", compression=None) as out:
            for r in found:
                part = f"{path}/parts/{r['file']}.{kind}"
                with store.open_input_stream(part, compression=None) as f:
                    while data := f.read(1 << 24):
                        out.write(data)
                store.delete_file(part)
    store.delete_dir(f"{path}/parts")
    return Adjacency(folder, nodes, int(begin[-1]))


def _folder(spark: SparkSession) -> str:
    folder = f"{shared_folder(spark)}/neurograph/adjacency-{uuid.uuid4().hex}"
    store, path = _place(folder)
    store.create_dir(f"{path}/parts")
    return folder


def _part(folder: str, first: int, near: np.ndarray, code: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    name = f"{first}-{uuid.uuid4().hex}"
    save(f"{folder}/parts/{name}.near", near.astype(np.int32))
    save(f"{folder}/parts/{name}.code", code.astype(np.uint8))
    return pa.RecordBatch.from_pydict({"first": pa.array([first], pa.int64()), "file": [name], "counts": pa.array([counts.astype(np.int32).tobytes()], pa.binary())})


_PART = "first bigint, file string, counts binary"


def build(links: DataFrame, nodes: int, size: int) -> Adjacency:
    """Of (a, b, u): links between the numbers of nodes, about ``size`` of them, and whether they may match. Each is dealt to both its ends, 8 bytes a
    time, and that is all that is shuffled. Repeated links become one; a task drops those it sees in about ``BLOCK`` of its links, so that a link that is
    repeated very often doesn't fill the part it is dealt to."""
    if nodes >= 1 << 30:
        raise ValueError("more nodes than numbers")
    folder, most = _folder(links.sparkSession), BLOCK
    blocks = max(1, math.ceil(2 * size / BLOCK))
    width = max(1, math.ceil(nodes / blocks))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out():
            key = np.unique(np.concatenate(held))
            for k in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_pydict({"k": key[k : k + (1 << 16)]})

        for x in batches:
            key = x.column(0).to_numpy()
            held += [key, (key >> 2 & ((1 << 31) - 1)) << 33 | key >> 33 << 2 | key & 2 | 1]
            n += 2 * len(key)
            if n >= most:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()

    a, b, u = F.col("a").cast("bigint"), F.col("b").cast("bigint"), F.col("u").cast("bigint")
    packed = links.where("a <> b").select((F.shiftleft(a, 33) + F.shiftleft(b, 2) + u * 2).alias("k"))
    ends = packed.mapInArrow(deal, "k bigint").repartition(blocks, F.expr(f"shiftright(k, 33) div {width}"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = [x.column(0).to_numpy() for x in batches]
        if not key:
            return
        key = np.concatenate(key)
        key.sort()
        first = np.flatnonzero(np.diff(key >> 2, prepend=-1))
        code = np.bitwise_or.reduceat((ANY_OUT | (key >> 1 & 1)) << (key & 1), first)
        key = key[first]
        node, near = key >> 33, key >> 2 & ((1 << 31) - 1)
        for block in np.unique(node // width):
            lo, hi = np.searchsorted(node, [block * width, (block + 1) * width])
            yield _part(folder, int(block * width), near[lo:hi], code[lo:hi], np.bincount(node[lo:hi] - block * width, minlength=min(width, nodes - block * width)))

    with run_once(links.sparkSession):
        return _joined(folder, nodes, ends.mapInArrow(write, _PART))


def over(spark: SparkSession, size: int, step: int, work: Callable[[int, int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """The rows of ``work(lo, hi)`` over ranges of about ``step`` that make up 0 to ``size``; a task takes one range or a few."""
    ranges = max(1, math.ceil(size / step))
    tasks = min(ranges, max(4 * spark.sparkContext.defaultParallelism, math.ceil(ranges / 16)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for k in x.column(0).to_pylist():
                yield from work(k * size // ranges, (k + 1) * size // ranges)

    return spark.range(0, ranges, 1, tasks).mapInArrow(run, schema)


def owners(begin: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The nodes whose neighbours lie from ``lo`` to ``hi``."""
    if hi <= lo:
        return np.empty(0, np.int64)
    x, y = np.searchsorted(begin, [lo, hi - 1], side="right") - 1
    cuts = np.clip(begin[x : y + 2], lo, hi)
    return np.repeat(np.arange(x, y + 1), np.diff(cuts))


def spread(begin: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each neighbour of each of the nodes ``of``: which of these, and the neighbour's place."""
    n = begin[of + 1] - begin[of]
    row = np.repeat(np.arange(len(of)), n)
    return row, np.arange(len(row)) + np.repeat(begin[of] - (np.cumsum(n) - n), n)


def pieces(begin: np.ndarray, of: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of the nodes ``of`` that have about ``most`` neighbours together, and one node at least."""
    total = np.cumsum(begin[of + 1] - begin[of])
    lo = 0
    while lo < len(of):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
        yield slice(lo, hi)
        lo = hi


def forward(spark: SparkSession, whole: Adjacency) -> Adjacency:
    """Only the neighbours of greater degree, or of the same and a greater number: of m links no node has over sqrt(2 * m) then."""
    folder = _folder(spark)

    def write(lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        begin, near, code = whole.arrays()
        # nodes whose neighbours begin in this range; those after the last link have none
        x, y = np.searchsorted(begin[:-1], [lo, hi])
        if x == y:
            return
        of = np.arange(x, y)
        mine, at = slice(begin[x], begin[y]), np.repeat(of, begin[x + 1 : y + 1] - begin[x:y])
        other = near[mine].astype(np.int64)
        own, its = begin[at + 1] - begin[at], begin[other + 1] - begin[other]
        keep = (its > own) | ((its == own) & (other > at))
        yield _part(folder, int(x), near[mine][keep], code[mine][keep], np.bincount(at[keep] - x, minlength=y - x))

    return _joined(folder, whole.nodes, over(spark, whole.size, BLOCK, write, _PART))


def save_values(values: pa.Array, url: str) -> None:
    store, path = _place(url)
    with store.open_output_stream(path, compression=None) as f, pa.ipc.new_file(f, pa.schema([("value", values.type)])) as out:
        out.write_table(pa.table({"value": values}))


def load_values(url: str) -> pa.Array:
    store, path = _place(url)
    with pa.memory_map(path) if isinstance(store, pafs.LocalFileSystem) else store.open_input_file(path) as f:
        return pa.ipc.open_file(f).read_all()["value"].combine_chunks()


def save_names(ids: DataFrame, url: str) -> None:
    """The names of (name, id), in the order of ids from 0."""
    found = ids.toArrow()
    save_values(found["name"].combine_chunks().take(pa.array(np.argsort(found["id"].to_numpy()))), url)
