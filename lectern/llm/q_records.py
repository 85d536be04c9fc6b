"""The query of the token-file operator."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import records


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    for batch in batches:
        ids = batch.column(2)
        flat, at = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
        crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.diff(at), pa.int64()), pa.array(crcs, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokenizer = records.session_tokenizer(spark, "word_bpe_49k.json")
    _, back, _ = records.token_files(docs, tokenizer, end_id=1)
    return back.mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


QUERIES = {"op4_token_files": op4_token_files}
ORACLES: dict[str, str] = {}
