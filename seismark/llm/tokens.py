"""Token counts of texts under a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Session setting that names the tokenizer file (byte-level BPE) on the driver, and its default.
TOKENIZER_SETTING, TOKENIZER_FILE = "spark.seismark.tokenizer", "/opt/tokenizers/byte_bpe_50k.json"


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def token_counts(documents: DataFrame, text: str, tokenizer_file: str | None = None, name: str = "tokens") -> DataFrame:
    """``documents`` without its text, plus the number of tokens of the whole text; null text has null tokens.

    The tokenizer file is that of the argument or of the session's setting. It is sent to the executors once.
    """
    session = documents.sparkSession
    tokenizer_file = tokenizer_file or session.conf.get(TOKENIZER_SETTING, TOKENIZER_FILE)
    shipped = os.path.basename(tokenizer_file)
    session.sparkContext.addFile(tokenizer_file)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = load_tokenizer(SparkFiles.get(shipped))
        for batch in batches:
            held = batch.notna().to_numpy()
            sizes = pd.array([pd.NA] * len(batch), dtype="Int64")
            sizes[held] = [len(x.ids) for x in tokenizer.encode_batch(batch[held].tolist(), add_special_tokens=False)]
            yield pd.Series(sizes)

    return documents.withColumn(name, F.pandas_udf(count, "bigint")(F.col(text))).drop(text)
