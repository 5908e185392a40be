"""A training corpus from ``documents``, in five stages.

Each stage takes what its predecessor kept; all but the last return the columns of
``documents``. Between stages the rows are written as Parquet to the shared folder and read
again. Stages never swallow errors. All of them give no row for an empty table, take texts
of any length whole, and keep further columns whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import minhash, mixing, packing, pii, toxicity
from quillmill.llm.common import materialize, unused
from quillmill.llm.queries import END_ID, SEED, TOP, WEIGHTS, levels, table, tokenizer_path
from quillmill.session import placed

SHARE = 0.9  # of all tokens, once each


@placed
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field scores below 1/2.

    Null and empty texts hold no evidence and stay; rows with a null id are scored like
    others; repeated rows stay or go together; a score of exactly 1/2 goes.
    """
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    level, spans = unused(docs, "toxicity", "toxic_spans")
    scored = toxicity.score(docs, chain, keep=tuple(docs.columns), names=(level, spans))
    return scored.where(F.col(level) < 0.5).select(*docs.columns)


@placed
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near duplicates.

    Null, empty and blank texts are like no other and stay, as do rows with a null id; of
    repeated rows of an id one stays, whichever.
    """
    return minhash.keep_one(docs)


@placed
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in them replaced by its kind, ``n_chars`` counted anew.

    A null text stays null; of spans that overlap the one that starts first names the kind,
    among equal starts the shorter one; repeated rows are treated alike.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@placed
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their leaf's share of the token budget, each at most once.

    A null language or source is a leaf of its own; null and empty texts cost no token;
    copies of one text under one id stay or go together, and ties of order do not arise.
    """
    hidden = dict(zip(mine := [c for c in docs.columns if c.startswith("mix_")], unused(docs, *(f"kept_{c}" for c in mine)), strict=True))  # names that the operator uses itself
    chosen = mixing.select_documents(docs.withColumnsRenamed(hidden), levels(), WEIGHTS, share=SHARE, epochs=1, seed=SEED)
    return chosen.select(*[hidden.get(c, c) for c in docs.columns]).withColumnsRenamed({v: k for k, v in hidden.items()})


@placed
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens.

    Null and empty texts are the closing id alone; repeated rows and rows with a null id are
    packed as often as they come; of equally long pieces the one that came first goes first.
    """
    # workers keep this cache while other stages need their memory
    return packing.pack(docs, tokenizer_path(), end_id=END_ID, top=TOP, cache=150_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# the first stage trains a model, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
