"""The stages that make a training corpus out of documents.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. run() writes what a stage returns to the shared
folder and reads it again, so a lost executor costs part of one stage.
"""

from __future__ import annotations

from edgeloom.llm import decontamination, language, pieces, simhash, toxicity
from edgeloom.llm.common import forget, scratch, stored, table


def by_language(spark, docs, sf_dir):
    """Documents without a letter, and those whose language is a toss-up (a score below 0.5), go."""
    return language.recognised(docs, language.fit(docs), least_score=0.5)


def by_toxicity(spark, docs, sf_dir):
    """Documents that score 0.7 or more go."""
    return toxicity.civil(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark, docs, sf_dir):
    """Of documents linked by five-word shingles with a similarity of 0.8 or more, or by fingerprints of three-word shingles that differ in
    three bits or fewer, the one with the least id stays."""
    return simhash.deduplicated(docs, n_words=3, by_shingles=True)


def benchmark_free(spark, docs, sf_dir):
    """Documents that hold half of a benchmark item or more, in whatever order, go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark, docs, sf_dir):
    """Per document its piece ids, their score, the next best segmentations, and whether all of them decode to its text."""
    found = pieces.encode(docs, n_best=4, keep=("lang", "source", "n_chars"))
    return found.select("doc_id", "lang", "source", "n_chars", "ids", "score", "others", "exact")


STAGES = [
    ("language", by_language),
    ("toxicity", by_toxicity),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark_free),
    ("pieces", encoded),
]

#: Models and searches aren't SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        # A stage's own tables, and the result of the stage before it, go when its result is written.
        with scratch() as keep:
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
            keep(docs)
        if before is not None:
            forget(before)
        before = docs
    return docs
