"""Shared pieces of the text operators: row-wise Arrow passes over whole texts, word hashes, tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from rowgrad.session import discard, materialize, scratch_path

# A side is broadcast only if its counted rows stay under so many bytes.
BROADCAST_BYTES = 32 << 20
# A task works on so many bytes of text at a time; a single longer text is still taken whole. Its words take ten times as much memory.
SLICE_BYTES = 1 << 20

U = np.uint64
C1, C2, C3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An ordered pair of 64-bit fingerprints as one."""
    x = a * C1
    x ^= x >> U(29)
    x += b * C2
    x ^= x >> U(32)
    x *= C3
    x ^= x >> U(29)
    return x


class Remembered(dict):
    """Values of a function, kept until there are too many; the keys of one text are always served."""

    def __init__(self, make: Callable, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()


def hash_word(word: bytes) -> int:
    from hashlib import blake2b

    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little")


def slices(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes together, or of one row."""
    lo, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and held + n > limit:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def hand_back() -> None:
    """Give memory that a worker has freed back to the system: workers live on, and what one stage took would be missing in the next."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def over_texts(
    df: DataFrame,
    keep: list[str],
    schema: str,
    start: Callable[[], Callable[[list[bytes | None], pa.RecordBatch], list]],
    text: str = "text",
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """The ``keep`` columns of every row followed by columns computed from its text; rows are neither added nor lost.

    ``start()`` runs once in each task and returns a function from the texts (UTF-8 bytes, None for null) and
    their rows to one list or Arrow array for each column of ``schema``. A text that is kept is sent once; about ``limit`` bytes of texts
    are worked on together.
    """
    out = StructType([*df.select(*keep).schema.fields, *StructType.fromDDL(schema).fields])
    n_keep = len(keep)
    sent = text in keep and out[keep.index(text)].dataType == StringType()
    at = keep.index(text) if sent else n_keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        shape, work = to_arrow_schema(out), start()
        for batch in batches:
            hand_back()
            lengths = batch.column(at).cast(pa.binary())
            sizes = np.diff(np.frombuffer(lengths.buffers()[1], np.int32, len(lengths) + 1, lengths.offset * 4)) if len(lengths) else np.zeros(0)
            for lo, hi in slices(sizes, limit):
                part = batch.slice(lo, hi - lo)
                made = work(lengths.slice(lo, hi - lo).to_pylist(), part)
                columns = [c.cast(f.type) if isinstance(c, pa.Array) and c.type != f.type else c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip([*part.columns[:n_keep], *made], shape, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=shape)
                del made, columns, part
        # what the task remembered goes before it ends
        work = None
        hand_back()

    read = df.select(*keep) if sent else df.select(*keep, F.col(text).cast("string").cast("binary").alias("__text"))
    return read.mapInArrow(run, out)


def hinted(small: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``small`` with a broadcast hint if its counted rows are few enough; else Spark shuffles both sides. For joins whose other side is wide."""
    return F.broadcast(small) if rows * row_bytes <= BROADCAST_BYTES else small


def put(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back; ``free`` deletes the files."""
    path = scratch_path(df.sparkSession, name)
    out = materialize(df, name, path=path)
    out._scratch = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete tables that ``put`` wrote, when nothing will read them any more."""
    for t in tables:
        discard(t.sparkSession, t._scratch)


def share(spark, value):
    """Broadcast a value with the code of its class, so that executors need no copy of the package; ``opened`` gives it back in a task."""
    from pyspark import cloudpickle

    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(shared):
    import pickle

    return pickle.loads(shared.value)
