"""Cleaning a corpus, stage by stage: each stage reads what the one before wrote and works on all of it.

All stages but the last return the columns of ``documents``; they use doc_id, text, lang, source and (where it is) n_chars, and
carry any further columns along. Empty tables pass through.
"""

import public_tokenizers
from pyspark.sql import functions as F

from lendgauge.llm import byte_bpe, dart_minhash, language, mixing, super_kmers
from lendgauge.session import checkpointed, through_parquet


def language_stage(spark, docs, sf_dir):
    """Reject documents without a letter and those that have nothing in common with any learned language.

    Languages are learned from the documents that have one and aren't held out; if none has, only letters count.
    """
    learned = docs.where(~language.held_out(F.col("doc_id")))
    prototypes = language.learn(learned)
    if not prototypes:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*docs.columns)
    told = language.with_known_share(language.identify(docs, prototypes, into=("__lang", "__score")), language.known_trigrams(learned), into="__known")
    return told.where((F.col("__lang") != language.UNKNOWN) & (F.col("__known") >= language.KNOWN_SHARE)).select(*docs.columns)


def near_duplicate_stage(spark, docs, sf_dir):
    """Keep one document, that of the smallest id, of each class of near-duplicates."""
    return dart_minhash.group(docs, into=("__class", "__stays")).where("__stays").select(*docs.columns)


def repeated_words_stage(spark, docs, sf_dir):
    """Cut the words out that repeat elsewhere in runs of 35 or more; every document stays."""
    cut = super_kmers.strip(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def mixing_stage(spark, docs, sf_dir):
    """Documents as often as the mix takes them: not at all, once or repeated, up to three times."""
    size = mixing.word_count(F.col("text"))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", size.alias("size")).withColumn("grade", mixing.grade(F.col("size")))
    slim = checkpointed(rows.select("doc_id", "source", "size", "grade"))
    mixed = mixing.mix(rows, slim)
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("row.*")


def encoding_stage(spark, docs, sf_dir):
    """Token ids of every document, their number, and the digest of the bytes they decode to."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = byte_bpe.encode(docs, path, pattern, keep=("doc_id", "lang", "source"))
    return byte_bpe.decode(ids, path, pattern).select(
        "doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_words", repeated_words_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]
#: SQL has neither the language profiles nor MinHash classes; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = through_parquet(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
