"""From raw documents to token ids: rules, near-duplicates, personal data, mixture, encoding."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, hostrules, mixing, ngram_join, surrogates
from millrace.llm.common import dropped, join_small, recorded, small_batches, stored, table

_LEFT: list[str] = []
#: Columns of documents; others are carried through all stages as they are, whatever their names.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _stage(function):
    """A stage's result is written before the next stage begins, so what the stage kept in the shared folder is deleted
    then, but for tables that the next one's input still reads. Further columns have names of their own meanwhile, so
    that they can't clash with those of an operator; they come back unless a result of the last stage is named so."""

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        read = docs.inputFiles() if _LEFT else []
        for path in [p for p in _LEFT if not any(f"{p.rpartition('/')[2]}/" in f for f in read)]:
            dropped(spark, path)
            _LEFT.remove(path)
        others = {c: f"__other_{i}" for i, c in enumerate(docs.columns) if c not in COLUMNS}
        with recorded() as made:
            out = function(spark, docs.withColumnsRenamed(others), sf_dir)
        _LEFT.extend(made)
        taken = set(out.columns)
        return out.drop(*[o for c, o in others.items() if c in taken]).withColumnsRenamed({o: c for c, o in others.items() if c not in taken})

    return run


def _replaced(name: str) -> Column:
    """A column of documents after its text has become __text: the text, its length, or as it was."""
    made = {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return made.get(name, F.col(name)).alias(name)


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host does. A null or empty text fails; a null source is a host; a null
    doc_id stays; repeated rows are judged each."""
    return hostrules.judged(docs).filter("kept").select(*docs.columns)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group that shingles of five words link at a similarity of 0.8 or more.
    Documents without words stay. Rows without doc_id, or that share one, are documents each; of equal rows one stays,
    and a row with a doc_id before one without."""
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    plain = ids.filter("n > 1 or doc_id is null").isEmpty()
    if not plain:
        docs = mixing.numbered(docs)
    with recorded() as made:
        nodes = docs if plain else docs.select(F.col("__row").alias("doc_id"), "text")
        found = ngram_join.groups(nodes, size=5, percent=80)
        if not plain:  # the row that stays is the first by doc_id, which row numbers don't follow
            order = F.struct(F.col("doc_id").isNull(), "doc_id", "__row")
            first = found.withColumnRenamed("doc_id", "__row").join(docs.select("__row", "doc_id"), "__row")
            least = first.groupBy("component_id").agg(F.min(order).alias("__least"))
            found = first.select("__row", "component_id").join(least, "component_id").select(F.col("__row").alias("doc_id"), F.col("__least.__row").alias("component_id"))
        others = stored(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__loser")).distinct(), "others")
    for path in made[:-1]:  # all but the last, which is the result
        dropped(spark, path)
    return join_small(docs, others, F.col("doc_id" if plain else "__row") == F.col("__loser"), "left_anti", others.count(), 1_000_000).drop("__row")


@_stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars follows the text. A null text stays null, and so does
    its n_chars become; repeated rows are replaced alike."""
    made = surrogates.with_surrogates(docs).withColumnRenamed("text", "__text")
    return made.select(*[_replaced(c) for c in docs.columns])


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass in which the mixture takes words of a document, with the words that it takes, in order.
    Documents without words (null or empty texts) are never taken; repeated rows are documents each."""
    texts = mixing.numbered(mixing.sized(docs))
    rows = stored(mixing.places(texts), "placed")
    plan = mixing.plan_of(rows)
    pieces = mixing.mixture(rows, plan).groupBy("number", "first", "turn").agg(F.array_sort(F.collect_list(F.struct("from_word", "n_words"))).alias("parts"), F.sum("n_words").alias("taken"))
    # Only documents with words have pieces, and of those the first word is their own.
    own = mixing.with_plan(rows.filter("size > 0"), "source", plan, ("number",)).select("row", "number", "first", "size")
    found = own.join(pieces, ["number", "first"]).select(F.col("row").alias("__row"), F.col("parts").alias("__parts"), (F.col("taken") == F.col("size")).alias("__whole"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.transform(F.array(words), lambda w: F.flatten(F.transform("__parts", lambda p: F.slice(w, (p["from_word"] + 1).cast("int"), p["n_words"].cast("int")))))[0]
    text = F.when(F.col("__whole"), F.col("text")).otherwise(F.array_join(cut, ""))
    taken = texts.join(found, "__row").withColumn("__text", text)
    return taken.select(*[_replaced(c) for c in docs.columns])


@_stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row in place of its text: n_tokens, ids (little-endian unsigned 32-bit integers), ids_sha256. A
    null text is empty and has no tokens; a null doc_id stays; repeated rows are encoded alike."""
    ranks, pattern = bpe.production_ranks()
    return bpe.encode_documents(docs, ranks, pattern, ("n_tokens", "ids", "ids_sha256"), carry=tuple(c for c in docs.columns if c not in ("text", "n_chars")))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("mixing to target weights", mixture),
    ("byte-level BPE", encoding),
]

#: Keyed permutations and a token vocabulary are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for _, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        with recorded() as made:
            docs = stored(out, "stage")
        for path in before:  # what has been read to make the next table
            dropped(spark, path)
        before = made
    return STAGES[-1][1](spark, docs, sf_dir)
