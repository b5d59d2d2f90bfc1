"""Token-id output: documents encoded, sorted by id and written as sorted-string-table shards, then read back.

Rows are range-partitioned on the id and, for repeated ids, a hash of the text, sorted within partitions, and each
partition streams into one shard in the shared folder through the file system that its address names. A shard becomes part of the output only when
its manifest row is committed, so a lost or repeated task leaves at most an unnamed file. Reading back lists
the blocks of all shards and deals them out, so a large shard is not one task.

Null text encodes as empty and still ends with the end id; a null id sorts first; repeated rows are all kept, those of
one id in the order of a hash of their text; very long texts are values of their own;
an empty table writes an empty manifest; further columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import sstable
from .common import materialize, pick, scratch, tidy

END_ID = 0
MANIFEST = "path string, first_key binary, last_key binary, n_docs bigint, n_ids bigint, n_bytes bigint"
ENTRIES = "shard bigint, block bigint, pos bigint, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"


def filesystem(uri: str):
    """(file system, path) of an address; local, HDFS and object stores alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def write_shards(docs: DataFrame, root: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 1 << 18) -> DataFrame:
    """Write the shards under ``root``; returns the committed manifest, a row for each shard."""
    spark = docs.sparkSession
    end = END_ID.to_bytes(4, "little")

    def write(batches):
        import pyarrow as pa

        encode, sink, writer = sstable.encoder(vocabulary), None, None
        system, folder = filesystem(root)
        path = f"{folder}/{uuid.uuid4().hex}.sst"
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for doc_id, text in zip(ids.to_pylist(), texts, strict=True):
                if writer is None:
                    system.create_dir(folder, recursive=True)
                    sink = system.open_output_stream(path)
                    writer = sstable.Writer(sink, block_bytes)
                writer.add(sstable.key_of(doc_id), encode(text.as_py() or "") + end)
        if writer is not None:
            writer.close()
            size = sink.tell()
            sink.close()
            row = [[f"{root}/{path.rsplit('/', 1)[1]}"], [writer.first], [writer.last], [writer.docs], [writer.ids], [size]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["path", "first_key", "last_key", "n_docs", "n_ids", "n_bytes"])

    rows = pick(docs, id=id_col, t=text_col).withColumn("h", F.xxhash64("t"))
    rows = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "t").select("id", "t")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "500")  # texts can be long
    try:
        return materialize(rows.mapInArrow(tidy(write), MANIFEST), "shard-manifest")
    finally:
        spark.conf.set(key, was)


def read_shards(manifest: DataFrame, blocks_per_task: int = 64) -> DataFrame:
    """One row per stored document: its id, the ids of all documents before it, its ids' count and checksum."""
    spark: SparkSession = manifest.sparkSession
    order = Window.orderBy("first_key", "last_key", "path")  # a row for each shard
    placed = manifest.withColumn("shard", F.row_number().over(order)).withColumn("start", F.coalesce(F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = materialize(placed.select("path", F.col("shard").cast("long").alias("shard"), F.col("start").cast("long").alias("start"), "n_bytes"), "shard-places")

    def list_blocks(batches):
        import pyarrow as pa

        for batch in batches:
            for x in batch.to_pylist():
                system, path = filesystem(x["path"])
                with system.open_input_file(path) as f:
                    n = len(sstable.Reader(f, x["n_bytes"]).blocks)
                lows = list(range(0, n, blocks_per_task))
                yield pa.RecordBatch.from_pylist([{**x, "low": a, "high": min(n, a + blocks_per_task)} for a in lows])

    def read(batches):
        import pyarrow as pa

        names = ["shard", "block", "pos", "doc_id", "at", "n_tokens", "ids_crc32"]
        for batch in batches:
            for x in batch.to_pylist():
                system, path = filesystem(x["path"])
                with system.open_input_file(path) as f:
                    reader = sstable.Reader(f, x["n_bytes"])
                    for b in range(x["low"], x["high"]):
                        at, cols = x["start"] + reader.blocks[b][4], [[] for _ in names]
                        for pos, (key, value) in enumerate(reader.block(b)):
                            n = len(value) // 4
                            for c, v in zip(cols, (x["shard"], b, pos, sstable.id_of(key), at, n, sstable.crc(value)), strict=True):
                                c.append(v)
                            at += n
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    tasks = placed.mapInArrow(list_blocks, "path string, shard bigint, start bigint, n_bytes bigint, low bigint, high bigint")
    tasks = tasks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return tasks.mapInArrow(tidy(read), ENTRIES)


def lookup(manifest: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_crc32) of each stored document whose id is among ``ids``, found in the shards by filter,
    sparse index and restarts. Wanted ids meet the shards whose key range holds them; no shard is read whole."""
    wanted = ids.select(ids[id_col].alias("id")).distinct()
    shards = manifest.select("path", "n_bytes", "first_key", "last_key")
    key = F.when(F.col("id").isNull(), F.unhex(F.lit("00"))).otherwise(F.unhex(F.concat(F.lit("01"), F.lpad(F.hex(F.col("id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))))
    asked = wanted.withColumn("key", key).join(F.broadcast(shards), F.col("key").between(F.col("first_key"), F.col("last_key")))  # a row a shard

    def find(batches):
        import pyarrow as pa

        path = reader = source = None
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                if x["path"] != path:
                    if source is not None:
                        source.close()
                    system, at = filesystem(x["path"])
                    path, source = x["path"], system.open_input_file(at)
                    reader = sstable.Reader(source, x["n_bytes"])
                out += [(x["id"], len(v) // 4, sstable.crc(v)) for v in reader.get(x["id"])]
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "n_tokens", "ids_crc32"])
        if source is not None:
            source.close()

    asked = asked.repartition("path").sortWithinPartitions("path", "id").select("id", "path", "n_bytes")
    return asked.mapInArrow(tidy(find), "doc_id bigint, n_tokens bigint, ids_crc32 bigint")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_table(docs: DataFrame, vocabulary: str | None = None, root: str | None = None) -> DataFrame:
    """Write, read back, and report per document: doc_id, start, n_tokens, ids_crc32."""
    root = root or scratch(docs.sparkSession, "shards")
    manifest = write_shards(docs, root, vocabulary or default_vocabulary())
    return read_shards(manifest).select("doc_id", F.col("at").alias("start"), "n_tokens", "ids_crc32")


def op1_token_shards(spark, sf_dir: str) -> DataFrame:
    """All documents through :func:`token_table`; null text is the end id alone, null ids come first, an empty table
    gives no rows."""
    return token_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
