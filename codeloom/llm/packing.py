"""Best-fit packing of tokenised documents into sequences of bounded length.

`pieces` tokenises whole texts (null: empty) and cuts only what is longer than a sequence: full pieces
from the end, so that just the first may be shorter. `pack` deals pieces to groups of bounded size by a
hash and packs every group online: a fixed number of open bins stands in a bitset keyed by free space; a
piece goes to the bin with the least free space that still holds it; where none does and all bins are
open, the fullest closes first. Arrival rule: pieces come in the order of their hash, in windows of about
`window` pieces, and within a window the longest first, ties by hash. Bins stay open from window to window.
A packer's memory is its open bins. Groups are independent tasks, so a lost executor costs only its own.

Defined results: a null or empty text is one piece of its end id; repeated rows and rows with a null id are
packed once each, and since the hash is over all columns and the partition, no key puts more rows into one
group than a partition has; a very long text is cut like any other; an empty table gives an empty result.
Only the key and text columns are read, so further columns, whatever their names, don't matter to `pieces`;
`pack` passes the columns of its parts on, and those named sequence_id or offset are replaced.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from codeloom.llm.bpe import default_path, encoder
from codeloom.llm.common import saved, table

PIECE = "piece int, start long, length long, ids_crc32 long"


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    if n <= most:
        return [(0, n)]
    first = n % most or most
    return [(0, first)] + [(at, most) for at in range(first, n, most)]


def pieces(docs: DataFrame, path: str | None = None, most: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32 and (keep_ids) the ids themselves as little-endian 32-bit `ids`."""
    import pyarrow as pa

    path = path or default_path()
    frame = docs.select(key, text)
    kind = frame.schema[key].dataType.simpleString()

    def run(batches):
        e = encoder(path)
        for b in batches:
            at, rows, ids = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                got = np.append(e.ids(t or ""), np.uint32(end_id)).astype("<u4")
                for k, (start, n) in enumerate(cut(got.size, most)):
                    raw = got[start : start + n].tobytes()
                    at.append(i)
                    rows.append((k, start, n, zlib.crc32(raw)))
                    if keep_ids:
                        ids.append(raw)
            columns = [b.column(0).take(pa.array(at, pa.int64()))] + [pa.array([r[k] for r in rows], pa.int32() if not k else pa.int64()) for k in range(4)]
            names = [key, "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.binary())] if keep_ids else []), names=names + ["ids"] * keep_ids)

    return frame.mapInArrow(run, f"`{key}` {kind}, {PIECE}" + ", ids binary" * keep_ids)


class Packer:
    """Bounded-space online best fit."""

    def __init__(self, most: int, open_bins: int):
        self.most, self.open_bins, self.n_open, self.made = most, open_bins, 0, 0
        self.mask = 0  # bit f: an open bin has f free places
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def place(self, n: int) -> tuple[int, int]:
        """(bin, offset) for a piece of n, 1 to most."""
        fits = self.mask >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            if self.n_open == self.open_bins:
                self._take((self.mask & -self.mask).bit_length() - 1)  # the fullest closes
            free, at = self.most, self.made
            self.made += 1
        if left := free - n:
            self.bins[left].append(at)
            self.mask |= 1 << left
            self.n_open += 1
        return at, self.most - free

    def _take(self, free: int) -> int:
        at = self.bins[free].pop()
        if not self.bins[free]:
            self.mask &= ~(1 << free)
        self.n_open -= 1
        return at


def pack(parts: DataFrame, most: int = 2048, open_bins: int = 128, group_rows: int = 32_000, window: int = 256, length: str = "length", most_tasks: int = 20_000) -> DataFrame:
    """parts with sequence_id and offset. parts should be stored: it is counted first.

    A task packs one group or, beyond most_tasks, several, one after the other."""
    import pyarrow as pa

    parts = parts.drop("sequence_id", "offset")
    groups = max(1, math.ceil(parts.count() / group_rows))
    tasks, size = min(groups, most_tasks), parts.columns
    place = F.struct(F.xxhash64(*size, F.spark_partition_id()).alias("h"), F.col(length).cast("long").alias("n"))
    dealt = parts.select(F.struct(*size).alias("part"), place.alias("at"))
    dealt = dealt.select("part", "at", F.pmod("at.h", F.lit(groups)).cast("long").alias("group"), F.pmod(F.xxhash64("at.h"), F.lit(max(1, group_rows // window))).alias("window"))
    dealt = dealt.repartitionById(tasks, (F.col("group") % tasks).cast("int")).sortWithinPartitions("group", "window", F.desc("at.n"), "at.h")

    def run(batches):
        packer, group = None, None
        for b in batches:
            ids, offsets = [], []
            for g, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if g != group:
                    packer, group = Packer(most, open_bins), g
                made, offset = packer.place(n)
                ids.append((g << 32) + made)
                offsets.append(offset)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], names=["part", "sequence_id", "offset"])

    schema = StructType([dealt.schema["part"], StructField("sequence_id", LongType()), StructField("offset", LongType())])
    out = dealt.select("part", "group", "at.n").mapInArrow(run, schema)
    return out.select("part.*", "sequence_id", "offset")


def op8_best_fit_packing(spark, sf_dir):
    return pack(saved(pieces(table(spark, sf_dir, "documents")), "pieces"))
