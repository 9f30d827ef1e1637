"""From raw documents to packed training sequences: quality, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on everything the stage before has kept; what it returns is written as
Parquet in the shared folder and read again as the next one's ``docs``.  All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hindcast.llm.common import stored, table
from hindcast.llm.jaccard_join import near_duplicates
from hindcast.llm.mixing import mix_documents
from hindcast.llm.packing import cut_documents, pack
from hindcast.llm.perplexity import quality
from hindcast.llm.pii import redact
from hindcast.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose perplexity lies outside what trusted text of their language and length shows.

    Null and empty texts go; a null language is one of its own, a null id is judged like any other.  Very long texts are
    judged by all their bytes.  Repeated rows are judged alike, a value at a limit stays.  Empty table: no rows.  Columns
    beyond those of ``documents`` are not returned, whatever their names.
    """
    judged = quality(docs, table(spark, sf_dir, "labels"))
    return judged.filter("keep").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 on five-word shingles, the smallest id stays.

    Null, empty and wordless texts link with nothing and stay, and so do rows with a null id.  Of rows that repeat an id the
    one with the smallest text stays.  Very long texts are compared whole.  Empty table: no rows.  Columns beyond those of
    ``documents`` are not returned.
    """
    return near_duplicates(docs, shingle=5, percent=80).filter("keep").select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts <kind> in the place of every span of personal data; n_chars is that of the new text.

    Null texts stay null (n_chars null), empty ones empty.  Very long texts are read whole, in windows.  Ids don't matter;
    repeated rows are masked alike.  Empty table: no rows.  Columns beyond those of ``documents`` are not returned.
    """
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes copies of it.

    Rows without a word (null and empty texts too) are not in it.  A null source is a source of its own, a null id a key like
    any other; of rows alike in id and size all or none get the drawn copy.  A very long text counts with all its words.
    Empty table: no rows.  Columns beyond those of ``documents`` are not returned.
    """
    return mix_documents(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes.

    Null and empty texts are one piece of one token, the end.  Texts beyond 2048 tokens are cut into pieces.  Repeated rows are
    pieces of their own, null ids are ids like any other; ties inside a length go by a hash.  Empty table: no rows.  Columns
    beyond those of ``documents`` are ignored.
    """
    return pack(cut_documents(docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Perplexities, token ids and network spans have no SQL form.  tests/llm compare the stages' operators with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
