"""A training corpus from documents: toxicity, near duplicates, secrets, source mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents (the last: tokens of each row). run() applies them
one after another, each result written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.bpe import token_digests
from canopy.llm.common import small_batches, stored, table
from canopy.llm.jaccard import classes_and_roots, with_root
from canopy.llm.mixing import mixed
from canopy.llm.secret_scan import redacted
from canopy.llm.toxicity import THRESHOLD, train, with_score


#: Rows that go to Python at once: the stages read whole texts, and a batch is held on both sides.
BATCH_ROWS = 512


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold. The scorer is fitted on labelled documents that are not held out.

    Null texts are scored as empty ones; repeated rows are rows each; an empty table stays empty; further columns pass through.
    """
    net = train(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return with_score(docs, net, score=score).filter(F.col(score) < THRESHOLD).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the smallest id.

    Documents without shingles (null, empty or blank texts) are nobody's copies and stay, one of each id and text. Where rows
    repeat an id, each is judged by its own component. Rows without an id: one of each component, and of equal texts without
    shingles; where any component has no id, a component with one keeps such a row beside it. An empty table stays empty; further
    columns pass through.
    """
    classes, root, least = classes_and_roots(docs)
    kept = classes.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("least")).filter("least")
    out = docs.join(kept.filter("n = 1").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    repeated = kept.filter("n > 1").select("doc_id")
    if repeated.limit(1).count():
        top, own = free_name(docs, "root"), free_name(docs, "own")
        rows = with_root(docs.join(repeated, "doc_id", "left_semi").select(docs.columns), root, name=top)
        judged = rows.join(least.select(F.col("root").alias(top), F.col("component_id").alias(own)), top, "left").filter(F.col(top).isNull() | (F.col(own) == F.col("doc_id")))
        first = judged.filter(F.col(top).isNotNull()).dropDuplicates([top])
        blank = judged.filter(F.col(top).isNull()).dropDuplicates(["doc_id", "text"])
        out = out.unionByName(first.unionByName(blank).select(docs.columns))
    if not classes.filter("doc_id is null and component_id is null").limit(1).count():
        return out
    top, key, row = (free_name(docs, c) for c in ("root", "key", "row"))
    without = with_root(docs.filter("doc_id is null").dropDuplicates(["text"]), root, name=top)
    one = without.groupBy(top, F.when(F.col(top).isNull(), F.col("text")).alias(key)).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.coalesce("text", F.lit(""))).alias(row))
    return out.unionByName(one.select(*[F.col(row).getField(c).alias(c) for c in docs.columns]))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark for every secret; n_chars follows the text. Null texts stay null; rows and columns stay as they are."""
    clean = redacted(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and those of small sources again as the tempered weights say (at most 1.25 times on average).

    A null source is a source of its own; texts without words count no tokens; an empty table stays empty.
    """
    return mixed(docs).select(docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text, one row a document of the mixture; null texts have no tokens."""
    return token_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scans", hide_secrets),
    ("mixing_sources", mix_sources),
    ("bpe_encoding", tokenise),
]

#: A trained scorer, hashes and a tokenizer are no SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with small_batches(spark, BATCH_ROWS):
            docs = stored(stage(spark, docs, sf_dir), name)
    return docs
