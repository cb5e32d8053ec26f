"""All blocks one step at a time.

An iterative learner of *every* block advances in the same Spark job: rows are
dealt once to (block, chunk) groups of bounded size and packed, a step hands each chunk its
block's state and returns partial sums (counts, gradients, moments), Spark adds
them up by key, and the new state of all blocks is one small table.  The number
of jobs depends on the steps alone, not on the number of blocks; a block of any
size spreads over as many chunks as it needs, so no task holds a block and
nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import AtomicType, StructType

from tessera.operators.blocks import BLOCK, materialise
from tessera.session import ensure_checkpoint_dir

#: rows a chunk holds on average; with 64 features about 10 MB
CHUNK_ROWS = 20_000
CHUNK = "_chunk"
PACKED = "_rows"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write a small state table to the shared checkpoint folder; it cuts the
    lineage, so a lost executor never replays earlier steps."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cogrouped(left: DataFrame, right: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str,
              *keys: str) -> DataFrame:
    """``fn`` on the rows of both sides with equal keys (the sides may share a source)."""
    right = right.toDF(*right.columns)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(fn, schema)


def _packed(rows: pa.Table) -> bytes:
    """The rows of a chunk as one Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def _unpacked(chunks: pa.Table, kind: pa.Schema, role: str | None) -> pa.Table:
    """The rows of a chunk (those of one role); no row where there is no chunk."""
    parts = [pa.ipc.open_stream(c.as_buffer()).read_all() for c in chunks[PACKED]]
    rows = pa.concat_tables(parts) if parts else kind.empty_table()
    return rows if role is None else rows.filter(pc.equal(rows["role"], role))


@dataclass
class Dealt:
    """Rows packed by chunk, one row a chunk, cached in partitions of whole chunks, and the
    number of chunks ``_n`` of each block.  A step brings a task's chunks in order, few packed
    rows: it neither sorts nor converts the rows in them."""

    chunks: DataFrame               # block, chunk, the chunk's rows in the order of their ids
    sizes: DataFrame
    schema: StructType              # of the rows
    col: str = BLOCK
    role: str | None = None         # the only role that steps see

    @property
    def rows(self) -> DataFrame:
        """The rows one by one, for a single pass."""
        kind, role = to_arrow_schema(self.schema), self.role

        def run(batches):
            for b in batches:
                for i in range(len(b)):
                    yield from _unpacked(pa.Table.from_batches([b.slice(i, 1)]), kind, role).to_batches()

        return self.chunks.mapInArrow(run, self.schema)

    def step(self, state: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """``fn(rows of a chunk, state rows of its block)`` for every chunk.  The
        rows stay where they are; only the state, one copy a chunk, is shuffled."""
        near = (state.join(F.broadcast(self.sizes), self.col)              # 12 bytes a block
                .withColumn(CHUNK, F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n"))
        kind, role = to_arrow_schema(self.schema), self.role
        nothing = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

        def run(chunks: pa.Table, near: pa.Table) -> pa.Table:
            rows = _unpacked(chunks, kind, role)
            return fn(rows, near) if len(rows) or len(near) else nothing

        return cogrouped(self.chunks, near, run, schema, self.col, CHUNK)

    def split(self) -> tuple[Dealt, Dealt]:
        """(blocks of one chunk, blocks of more): a chunk that is its whole block has
        nothing to add up with others, so it can take all its steps in one go."""
        sizes = [F.broadcast(self.sizes.filter(c).select(self.col)) for c in ("_n = 1", "_n > 1")]
        return tuple(replace(self, chunks=self.chunks.join(s, self.col, "left_semi"), sizes=self.sizes.join(s, self.col, "left_semi"))
                     for s in sizes)

    def any(self) -> bool:
        return self.sizes.limit(1).count() > 0

    def only(self, role: str) -> Dealt:
        """The same chunks with the rows of a role."""
        return replace(self, role=role)

    def mapped(self, state: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> Dealt:
        """Other rows (``fn`` of a chunk and its block's state) kept in the same chunks."""
        col = self.col

        def run(rows: pa.Table, near: pa.Table) -> pa.Table:
            out = fn(rows, near)
            some = near.slice(0, 1 if len(out) else 0)
            return _chunk_table(some, col, [_packed(out)] * len(some))

        kind = self.chunks.sparkSession.createDataFrame([], schema).schema
        return replace(self, chunks=_kept(self.step(state, run, _chunk_schema(self.chunks, col)), self.sizes, col), schema=kind)

    def release(self) -> None:
        self.chunks.unpersist()


def _chunk_table(keys: pa.Table, col: str, packed: list[bytes]) -> pa.Table:
    return keys.select([col, CHUNK]).append_column(PACKED, pa.array(packed, pa.binary()))


def _chunk_schema(rows: DataFrame, col: str) -> str:
    return f"`{col}` {rows.schema[col].dataType.simpleString()}, {CHUNK} int, {PACKED} binary"


def _kept(chunks: DataFrame, sizes: DataFrame, col: str) -> DataFrame:
    """Cached by block and chunk; small tables in fewer partitions than a shuffle has."""
    spark = chunks.sparkSession
    n = sizes.agg(F.sum("_n")).first()[0] or 1
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, -(-n // 4)))
    return materialise(chunks.repartition(parts, col, CHUNK))


def deal(rows: DataFrame, order: str = "row_id", col: str = BLOCK, chunk_rows: int = CHUNK_ROWS) -> Dealt:
    """Deal rows to chunks by a hash of ``order`` (their id)."""
    sizes = checkpointed(rows.groupBy(col).agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("_n")))
    chunk = F.pmod(F.xxhash64(order, F.lit("chunk")), F.col("_n")).cast("int")
    dealt = rows.join(F.broadcast(sizes), col).withColumn(CHUNK, chunk).drop("_n")
    kind = dealt.drop(CHUNK).schema
    sorts = isinstance(kind[order].dataType, AtomicType)

    def pack(part: pa.Table) -> pa.Table:
        some = part.drop_columns([CHUNK])
        return _chunk_table(part.slice(0, 1), col, [_packed(some.sort_by(order) if sorts else some)])

    chunks = dealt.groupBy(col, CHUNK).applyInArrow(pack, _chunk_schema(dealt, col))
    return Dealt(_kept(chunks, sizes, col), sizes, kind, col)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as an (n, d) array of doubles."""
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return values.reshape(len(flat), -1)


def mixed(h: np.ndarray, *salts) -> np.ndarray:
    """Repeatable uniform 64-bit numbers from row hashes and any salts (arrays
    broadcast against each other)."""
    out = np.asarray(h).astype(np.uint64)
    with np.errstate(over="ignore"):
        for salt in salts:
            out = (out ^ np.asarray(salt).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out = out ^ (out >> np.uint64(32))
    return out
