"""Token counts of the documents in flat, unindexed token files, found by scanning for the separator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import name, new_path, saved, text_or_empty
from .tokens import END_ID, TOKENIZERS, encoder

BLOCK_BYTES = 4 << 20


def write_token_files(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> tuple[str, DataFrame]:
    """Write the texts as flat files of little-endian 16-bit ids, a separator id after each.

    Every task writes one file under a name of its own attempt, and reports it only when it is complete: the
    returned table of contents (``file ordinal id``, itself a written table) lists just the files of tasks that
    succeeded, so lost or repeated attempts leave no trace in it. Returns the folder and that table.
    """
    path = new_path(df.sparkSession, "tokens")
    kind = dict(df.select(name(key).alias("id")).dtypes)["id"]

    def work(batches):
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyarrow import fs
        made, out, file, ordinal = encoder(folder, plain=True), None, f"{uuid.uuid4().hex}.u16", 0
        store, base = fs.FileSystem.from_uri(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{base}/{file}")
            for t in batch.column("text"):
                out.write(np.array([*made.ids(t.as_py()), END_ID], dtype="<u2").tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(np.arange(ordinal, ordinal + n)), batch.column("id")],
                                             ["file", "ordinal", "id"])
            ordinal += n
        if out is not None:
            out.close()

    rows = df.select(name(key).alias("id"), text_or_empty(text).alias("text"))
    return path, saved(rows.mapInArrow(work, f"file string, ordinal bigint, id {kind}"), "tokens-contents")


def count_tokens(spark: SparkSession, path: str, files: DataFrame, separator: int = END_ID, width: int = 2,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file ordinal n_tokens closed`` for every document of the token files named in ``files`` (column ``file``).

    Files are cut into blocks, which tasks read on their own and search for the separator with one vectorised
    comparison. A block gives the documents that end in it, counted from its start, and its open tail. A prefix scan
    over the blocks of a file (a few numbers each) gives the ordinal of a block's first document and the tokens that earlier
    blocks left open, which are added to it. Ids after the last separator make a last document that is not ``closed``.
    An empty file has no documents; a file that ends inside an id is an error.
    """
    step = block_bytes // width * width
    sizes = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))
    sizes = sizes.join(files.select("file").distinct(), "file", "left_semi").where("bytes > 0")
    blocks = sizes.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(bytes - 1) div {step}L"))).alias("block"))
    blocks = blocks.repartition("file", "block")

    def scan(batches):
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs
        store, base = fs.FileSystem.from_uri(path)
        for batch in batches:
            for file, size, block in zip(*[batch.column(c).to_pylist() for c in ("file", "bytes", "block")]):
                if size % width:
                    raise ValueError(f"{file} ends inside an id")
                with store.open_input_file(f"{base}/{file}") as f:
                    f.seek(block * step)
                    ids = np.frombuffer(f.read(min(step, size - block * step)), dtype=f"<u{width}")
                ends = np.flatnonzero(ids == separator)
                counts = np.diff(ends, prepend=-1) - 1
                tail = len(ids) - 1 - (ends[-1] if len(ends) else -1)
                # the last row is the open tail
                k, n = np.arange(len(ends) + 1), np.append(counts, tail)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(k)), pa.array([block] * len(k), pa.int64()), pa.array(k), pa.array(n.astype(np.int64)),
                                                  pa.array(k == len(ends))], ["file", "block", "k", "n", "tail"])

    found = saved(blocks.mapInArrow(scan, "file string, block bigint, k bigint, n bigint, tail boolean"), "tokens-found")
    by_block = W.partitionBy("file").orderBy("block")
    tails = found.where("tail").select("file", "block", F.col("k").alias("ends"), F.col("n").alias("open"))
    # blocks without a separator add to the run that the last block with one began
    tails = tails.withColumn("run", F.sum(F.when(F.col("ends") > 0, 1).otherwise(0)).over(by_block))
    carried = F.sum("open").over(W.partitionBy("file", "run").orderBy("block"))
    tails = tails.withColumn("carried", carried)
    tails = tails.select(F.col("file").alias("f"), F.col("block").alias("b"), (F.sum("ends").over(by_block) - F.col("ends")).alias("first"),
                         F.coalesce(F.lag("carried").over(by_block), F.lit(0)).alias("carry"),
                         (F.lead("block").over(by_block)).isNull().alias("last"), F.col("carried").alias("left_open"))
    met = found.join(tails, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    closed = met.where("not tail").select("file", (F.col("first") + F.col("k")).alias("ordinal"),
                                          (F.col("n") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("closed"))
    rest = met.where("tail and last and left_open > 0").select("file", (F.col("first") + F.col("k")).alias("ordinal"),
                                                               F.col("left_open").alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def document_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``key`` and ``n_tokens`` of every row, by writing token files and scanning them.

    A null text counts as empty (0 tokens). The end-of-text string inside a text is ordinary text, so no document
    holds the separator. Repeated rows are counted one by one; an empty table gives an empty table.
    """
    path, contents = write_token_files(df, key, text)
    if contents.limit(1).count() == 0:
        return contents.select(F.col("id").alias(key), F.lit(0).cast("bigint").alias("n_tokens"))
    counts = count_tokens(df.sparkSession, path, contents, block_bytes=block_bytes)
    return contents.join(counts, ["file", "ordinal"]).select(F.col("id").alias(key), "n_tokens")
