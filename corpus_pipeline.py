"""Corpus pipeline: documents to a training mix in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame,
which ``run`` writes as Parquet below spark.checkpoint.dir and reads again, so a lost executor costs
one stage at most.  All stages but the last return the columns of ``documents``.

No SQL expresses the stages (boosted trees, fingerprint components, byte windows, word windows and the
mix of what they leave), so ORACLE_SQL is None and tests compare the run with brute force.
"""

from rankloom.llm import decontamination, mixing, quality, simhash, suffixes
from rankloom.llm.shared import materialize, short_batches, table


def good_quality(spark, docs, sf_dir):
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(short_batches(docs), table(spark, sf_dir, "labels"))


def without_near_copies(spark, docs, sf_dir):
    """One document of each group of near copies: the one with the smallest doc_id."""
    return simhash.keep_one(short_batches(docs))


def without_repeats(spark, docs, sf_dir):
    """Texts without the passages of 50 bytes or more that a smaller doc_id holds too."""
    return suffixes.cut_repeats(short_batches(docs))


def without_benchmark(spark, docs, sf_dir):
    """Texts without the passages of 10 words or more that the benchmark holds too."""
    return decontamination.cut_benchmark(short_batches(docs), table(spark, sf_dir, "benchmark"))


def mixed(spark, docs, sf_dir):
    """Documents that the mix takes, with their numbers of copies."""
    return mixing.take(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", without_near_copies),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("mixing", mixed),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
