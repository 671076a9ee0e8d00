"""From raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from factweave.llm.common import shared_dir
from factweave.llm.jaccard_join import one_of_each_stage
from factweave.llm.language_crf import known_language_stage
from factweave.llm.packing import pack_stage
from factweave.llm.pseudonyms import pseudonym_stage
from factweave.llm.suffix_dedup import strip_stage

STAGES = [
    ("language", known_language_stage),
    ("near_duplicates", one_of_each_stage),
    ("repeats", strip_stage),
    ("pseudonyms", pseudonym_stage),
    ("packing", pack_stage),
]

#: The field of the first stage is fitted by gradient steps, which SQL can't express.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
