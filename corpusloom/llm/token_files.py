"""Token-ID files: flat unsigned integers, 64-bit document offsets, memory-mapped reading.

A folder holds, for each shard, ``.bin`` (the ids, ``<u2`` where the vocabulary allows it, else ``<u4``), ``.idx``
(``n_docs + 1`` little-endian int64 offsets into it, in ids) and ``.doc`` (int64 document ids, ``NULL_ID`` for null),
and the Parquet table ``manifest`` with a row per shard. Shards follow one another in ascending doc_id order.

Defined cases: a null text counts as empty (only the end id); null doc_ids come first; rows that share a doc_id
all stay, ordered by text; an empty table gives an empty folder; other columns of the input are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.llm.common import partitions, require
from corpusloom.llm.tokens import Encoder

NULL_ID = -(1 << 63)
DOCS_AT_ONCE = 512


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, dtype: str = "<u2", words: bool = False, shards: int | None = None
) -> None:
    """Encode every whole text, append ``end_id``, and write shards in ascending doc_id order.

    Each task writes one shard under a name of its own try; only tries that Spark accepts get into the manifest, so
    a lost executor or a second try leaves at most files that nothing refers to.
    """

    def write(batches):
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        enc = Encoder(tokenizer, words)
        end = np.array([end_id], dtype=dtype).tobytes()
        offsets, ids, total, out = [0], [], 0, None
        for batch in batches:
            for k in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(k, DOCS_AT_ONCE)
                data = []
                for text in part.column("text"):
                    tokens = np.frombuffer(enc.ids(text.as_py() or ""), dtype="<u4").astype(dtype)
                    total += len(tokens) + 1
                    offsets.append(total)
                    data += [tokens.tobytes(), end]
                ids += part.column("doc_id").fill_null(NULL_ID).to_pylist()
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}.bin")
                out.write(b"".join(data))
        if out is not None:
            out.close()
            for kind, values in (("idx", offsets), ("doc", ids)):
                with store.open_output_stream(f"{base}/{name}.{kind}") as f:
                    f.write(np.array(values, dtype="<i8").tobytes())
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "name": [name], "dtype": [dtype], "n_docs": [len(ids)], "n_tokens": [total]},
                schema=pa.schema([("shard", pa.int64()), ("name", pa.string()), ("dtype", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
            )

    n = shards or partitions(docs.sparkSession)
    ordered = require(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    ordered = ordered.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    schema = "shard bigint, name string, dtype string, n_docs bigint, n_tokens bigint"
    ordered.mapInArrow(write, schema).write.parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of each document: ``start`` counts the ids of all documents before it, ``ids`` are its
    ids as little-endian unsigned 32-bit integers. Files on local or mounted disks are memory-mapped."""

    def read(batches):
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)

        def values(path: str, dtype: str):
            if isinstance(store, fs.LocalFileSystem):
                return np.memmap(path, dtype=dtype, mode="r")
            with store.open_input_file(path) as f:
                return np.frombuffer(f.read(), dtype=dtype)

        for batch in batches:
            for row in batch.to_pylist():
                ids = values(f"{base}/{row['name']}.bin", row["dtype"])
                at = np.asarray(values(f"{base}/{row['name']}.idx", "<i8"))
                doc = np.asarray(values(f"{base}/{row['name']}.doc", "<i8"))
                for k in range(0, len(doc), DOCS_AT_ONCE):
                    some = doc[k : k + DOCS_AT_ONCE]
                    each = [ids[a:b].astype("<u4").tobytes() for a, b in zip(at[k:], at[k + 1 : k + 1 + len(some)], strict=False)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some, mask=some == NULL_ID), pa.array(at[k : k + len(some)] + row["base"]), pa.array(each, pa.binary())],
                        names=["doc_id", "start", "ids"],
                    )

    manifest = spark.read.schema("shard bigint, name string, dtype string, n_docs bigint, n_tokens bigint").parquet(f"{folder}/manifest")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    bases = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return bases.repartition(partitions(spark), "shard").mapInArrow(read, "doc_id bigint, start bigint, ids binary")


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of documents read back."""
    size = (F.octet_length("ids") / 4).cast("bigint")
    return rows.select("doc_id", "start", size.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


