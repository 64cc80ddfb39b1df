"""Two-pass external shuffle of a table into shards.

Pass one scatters the rows with a seeded hash over buckets that each fit into
a task's memory; a task's rows for one bucket travel as one compressed pile,
which halves what is shuffled. Pass two reads one bucket at a time, orders it by content,
shuffles it by Fisher-Yates with a generator seeded by (seed, bucket) and
writes it. The buckets, one after another, are the shuffled table; shard ``s``
of ``k`` is its ``s``-th run of rows, so row counts differ by one at most (the
law ``rows``) and slots have no gaps.

Defined results: null and empty texts have size 1. Null keys, repeated keys
and repeated rows are rows like others: the hash takes the row's number too,
so repeated rows do not meet in one bucket. All columns are kept, whatever
their names: they travel as one struct, and a column named ``shard`` or
``slot`` comes back as ``doc_shard`` or ``doc_slot`` (with one more ``doc_``
while that is taken). A text may be as long as a task's memory allows. An empty
table gives empty shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from filingmill.llm.common import batches_of, text_of, work_folder

#: Bytes of text that a bucket holds on average; a task holds about four times that.
BUCKET_BYTES = 64 << 20
#: Least number of buckets, so that small tables use several tasks.
LEAST_BUCKETS = 32
SEED = 20240229
BATCH_ROWS = 2000


def fisher_yates(rows: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform order of ``rows`` places."""
    order = np.arange(rows)
    picks = (rng.random(max(rows - 1, 0)) * np.arange(rows, 1, -1)).astype(int)
    for last, pick in zip(range(rows - 1, 0, -1), picks):
        order[last], order[pick] = order[pick], order[last]
    return order


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def free_names(names: list[str]) -> list[str]:
    """The names of the result: ``shard`` and ``slot`` stay free."""
    taken, out = {n.lower() for n in names}, []
    for name in names:
        if name.lower() in ("shard", "slot"):
            name = f"doc_{name}"
            while name.lower() in taken:
                name = f"doc_{name}"
        out.append(name)
    return out


def pile_batch(piles: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    bucket, size, blob = zip(*piles)
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.array(size, pa.int64()), pa.array(blob, pa.binary())],
        ["bucket", "size", "pile"],
    )


def shuffle_to(
    docs: DataFrame, path: str, bucket_bytes: int = BUCKET_BYTES,
    seed: int = SEED, key: str = "doc_id", text: str = "text",
) -> None:
    """Write ``docs`` in shuffled order to ``path``, bucket by bucket.

    The written rows have ``row``, a struct of all columns of ``docs``, and
    ``_bucket``, ``_place``.
    """
    total = docs.agg(
        F.coalesce(F.sum(F.octet_length(text_of(text)) + 1), F.lit(0))
    ).first()[0]
    buckets = max(total // bucket_bytes + 1, LEAST_BUCKETS)
    number = F.monotonically_increasing_id()
    scattered = docs.select(
        F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"),
        F.pmod(F.xxhash64(F.lit(seed), F.col(quoted(key)), number), F.lit(buckets)).cast("int").alias("_bucket"),
        F.xxhash64(F.col(quoted(key)), F.col(quoted(text))).alias("_order"),
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One compressed pile per bucket and batch: texts shrink before they move."""
        codec = pa.Codec("zstd")
        for batch in batches:
            rows = pa.Table.from_batches([batch]).sort_by("_bucket")
            own = rows["_bucket"].to_numpy()
            rows = rows.select(["row", "_order"]).combine_chunks()
            cuts = np.flatnonzero(np.diff(own, prepend=-1, append=-1))
            held, size = [], 0
            for start, end in zip(cuts[:-1], cuts[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as out:
                    out.write_table(rows.slice(start, end - start))
                raw = sink.getvalue()
                held.append((int(own[start]), raw.size, codec.compress(raw, asbytes=True)))
                size += len(held[-1][2])
                if size > 1 << 20:
                    yield pile_batch(held)
                    held, size = [], 0
            if held:
                yield pile_batch(held)

    def shuffled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        piles: dict[int, list[pa.Table]] = {}
        for batch in batches:
            for bucket, size, blob in zip(*(c.to_pylist() for c in batch.columns)):
                raw = codec.decompress(blob, decompressed_size=size)
                piles.setdefault(bucket, []).append(pa.ipc.open_stream(raw).read_all())
        for bucket in sorted(piles):
            own = pa.concat_tables(piles.pop(bucket)).sort_by("_order")
            rng = np.random.default_rng([seed, bucket])
            order = fisher_yates(own.num_rows, rng)
            for start in range(0, len(order), BATCH_ROWS):
                part = order[start:start + BATCH_ROWS]
                rows = own.take(pa.array(part)).drop_columns("_order").combine_chunks()
                rows = rows.append_column("_bucket", pa.array([bucket] * len(part), pa.int32()))
                place = pa.array(np.arange(start, start + len(part)))
                yield from rows.append_column("_place", place).to_batches()

    schema = StructType(
        [StructField("row", docs.schema), StructField("_bucket", IntegerType()), StructField("_place", LongType())]
    )
    # A larger batch has more rows for each bucket, which compress better.
    batches_of(docs.sparkSession, 10_000)
    piles = scattered.mapInArrow(packed, "bucket int, size long, pile binary")
    # Each bucket is a task of its own.
    dealt = piles.repartitionById(buckets, "bucket")
    dealt.mapInArrow(shuffled, schema).write.parquet(path)


def read_shards(
    spark: SparkSession, path: str, shards: int, columns: list[str] | None = None
) -> DataFrame:
    """The shuffled rows with ``shard`` and ``slot``, from 0."""
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"))
    # One row per bucket of the folder: its count, not its rows.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_bucket",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
        F.sum("n").over(
            Window.orderBy("_bucket").rowsBetween(
                Window.unboundedPreceding, Window.unboundedFollowing
            )
        ).alias("total"),
    )
    kept = columns or rows.schema["row"].dataType.names
    # Fields are pruned in the scan; numbers as names meet no other name.
    own = rows.select(
        "_bucket", "_place", *[F.col(f"row.{quoted(c)}").alias(f"c{i}") for i, c in enumerate(kept)]
    )
    # Shard s starts at floor(s * total / k).
    placed = own.join(offsets, "_bucket").withColumn("rank", F.col("offset") + F.col("_place"))
    placed = placed.withColumn("to", F.expr(f"(rank * {shards} + {shards - 1}) div total").cast("int"))
    return placed.select(
        *[F.col(f"c{i}").alias(name) for i, name in enumerate(free_names(kept))],
        F.col("to").alias("shard"),
        (F.col("rank") - F.expr(f"(to * total) div {shards}")).cast("long").alias("slot"),
    )


def shuffled_shards(
    docs: DataFrame, shards: int, bucket_bytes: int = BUCKET_BYTES,
    seed: int = SEED, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Shuffle ``docs`` in a new shared folder and read its shards."""
    path = work_folder(docs.sparkSession, "shards")
    shuffle_to(docs, path, bucket_bytes, seed, key, text)
    return read_shards(docs.sparkSession, path, shards)
