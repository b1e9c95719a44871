"""A corpus pipeline of five stages; each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import round_trip
from .common import WORD, Scratch, table
from .minhash import one_of_each
from .mixing import mix_sources, training_order
from .quality import drop_low_quality
from .suffixes import repeated_spans

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Repeated passages that are cut have so many words; they are searched as strings of so many bytes, fewer than
#: 51 words with the blanks between them take (words of 3.4 letters on average; shorter ones escape).
PASSAGE_WORDS, PASSAGE_BYTES = 51, 224


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the document of the smallest (id, content hash) stays."""
    return one_of_each(docs, words=5, percent=80).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that repeat are cut out of the texts; halves of a character at a cut go too."""
    cut = repeated_spans(docs, length=PASSAGE_BYTES, words=PASSAGE_WORDS, as_text=True)
    return cut.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, in training order; others go."""
    words = F.regexp_count("text", F.lit(WORD))
    return training_order(mix_sources(docs, words)).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids, and of what they decode to."""
    return round_trip(docs.select("doc_id", "text", "source")).select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", keep_one_of_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("source mixing", mix),
    ("byte-level BPE", tokenise),
]

#: The stages of learned scores, sketches and tokens are beyond SQL; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage gives is written to the shared folder and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, f"stage-{k}")
    return docs
