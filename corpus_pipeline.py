"""A corpus pipeline over ``documents``: toxic documents go, one document of each
group of near copies stays, documents that hold benchmark passages go, personal
data is replaced in the texts, and the rest gets mixing rates.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that the
stage before it kept; its result is written as Parquet and read again, so a
lost executor costs one stage at most.  All but the last return the columns of
``documents``.  Rows of null id are kept by the stages that decide by id; rows that
are equal in id and text count once after the second stage, rows of one id with
different texts are all kept or all dropped.  Further columns of any name pass through
unchanged (of equal rows, those of one of them); empty tables stay empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, ngram_join, pii_crf, soft_mix, toxicity_fm
from tessera.llm.common import read
from tessera.session import ensure_checkpoint_dir


def _unused(docs: DataFrame) -> str:
    """A column name that docs does not have."""
    return "_" + max(docs.columns, key=len)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents scored at or above its threshold go; all stay where
    the labels are not of both classes."""
    machine = toxicity_fm.train(docs, read(spark, sf_dir, "labels"))
    own = _unused(docs)
    scored = toxicity_fm.score(docs, machine, out=own)
    return scored.filter(~toxicity_fm.toxic(machine, own)).drop(own)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each component of linked texts the document of the smallest
    id stays (rows of equal id and text once)."""
    found = ngram_join.classes(docs)
    stay = found.filter("doc_id = component_id").select(F.col("doc_id").alias(_unused(docs))).distinct()
    kept = docs.join(stay, docs["doc_id"] == stay[stay.columns[0]], "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.union(docs.filter("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents with a verified overlap with a benchmark item go."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: spans are replaced by their kind; n_chars counts the new text."""
    # columns by place, so that none is taken for one of the operator's own
    places = {c: "text" if c == "text" else f"column_{i}" for i, c in enumerate(docs.columns)}
    found = pii_crf.detect(docs.toDF(*places.values()), pii_crf.train(docs.select("text")), redact=True)
    new = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}
    return found.select(*[new.get(c, F.col(places[c])).alias(c) for c in docs.columns])


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: all documents, with the rate at which each is to be drawn."""
    table = soft_mix.domain_table(docs, read(spark, sf_dir, "labels"))
    return soft_mix.mix(docs, table, soft_mix.TARGETS)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal),
    ("mixing", mix_domains),
]

#: the stages learn models; tests compare them with brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4()}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
