"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe, credentials, divergence, filteraudit, lines, nearcopies, nearest, packing, quality, setjoin, substrings, tokenbin, toxicity
from tidewell.llm.workspace import documents, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.digest(documents(spark, sf_dir))


def op2_setjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.join(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(documents(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_texts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).drop("abuse")


def op11_filteraudit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op12_nearcopies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.dedup(documents(spark, sf_dir))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {"op1_secrets": op1_secrets, "op2_setjoin": op2_setjoin, "op3_quality": op3_quality, "op4_lines": op4_lines, "op5_bpe": op5_bpe, "op6_nearest": op6_nearest, "op7_substrings": op7_substrings, "op8_token_files": op8_token_files, "op9_packing": op9_packing, "op10_toxicity": op10_toxicity, "op11_filteraudit": op11_filteraudit, "op12_nearcopies": op12_nearcopies, "op13_divergence": op13_divergence}


def oracle_sql() -> dict[str, str]:
    return {"op1_secrets": credentials.ORACLE_SQL, "op2_setjoin": setjoin.ORACLE_SQL, "op7_substrings": substrings.ORACLE_SQL, "op9_packing": packing.ORACLE_SQL, "op11_filteraudit": filteraudit.ORACLE_SQL, "op12_nearcopies": nearcopies.ORACLE_SQL, "op13_divergence": divergence.ORACLE_SQL}
