"""Keyword joins: texts against phrase banks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import banks
from ..functions.text import bound, literal_rows, phrases_in
from ..session import materialise, ship

ship(__name__)

# A bank up to this size is used as a literal array, which costs a walk through the text for each phrase; a larger one becomes an
# automaton, or several of this many phrases, which costs one walk.
LITERAL_BANK_ROWS = 32
SHARD_ROWS = 100_000


def keyword_hits(df: DataFrame, id_col: str, text: str = "text", bank: dict = banks.KEYWORDS) -> DataFrame:
    """One row for each (text, phrase) where the lower-cased text contains the phrase.

    The bank is part of the expression, so the join needs neither a broadcast nor a shuffle.
    """
    rows = literal_rows(
        [
            {"category": category, "cat_ord": cat_ord, "phrase": phrase, "kw_ord": kw_ord}
            for _, category, cat_ord, phrase, kw_ord in banks.bank_rows(bank)
        ],
        "array<struct<category:string,cat_ord:int,phrase:string,kw_ord:int>>",
    )
    hits = bound(F.lower(F.col(text)), lambda low: F.filter(rows, lambda r: F.contains(low, r["phrase"])))
    return df.select(id_col, F.explode(hits).alias("h")).select(id_col, "h.*")


def phrase_hits(df: DataFrame, bank: DataFrame, id_col: str, text: str = "text", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The same join with a bank table (phrase) of any size, such as learned phrases.

    Blank and null phrases hit nothing. A small bank becomes a literal array. Beyond that, an automaton over the phrases,
    built once a task, walks each text once, whatever the number of phrases; no piece of a text leaves its row. A bank of more than
    `shard_rows` phrases is cut into shards by a hash, each with its own automaton and walk, so what is broadcast at
    once is bounded.
    """
    phrases = bank.select("phrase").where(F.trim("phrase") != "").distinct()
    rows = phrases.limit(LITERAL_BANK_ROWS + 1).collect()
    if len(rows) <= LITERAL_BANK_ROWS:
        return df.select(id_col, F.explode(phrases_in(F.col(text), [r.phrase for r in rows])).alias("phrase"))
    stored = materialise(phrases, "phrases")
    shards = -(-stored.count() // shard_rows)
    lowered = df.select(id_col, F.lower(text).alias("_low")).where("_low is not null")
    found = None
    for number in range(shards):
        shard = stored.where(F.pmod(F.xxhash64("phrase"), F.lit(shards)) == number)
        hits = _walked(lowered, id_col, [r.phrase for r in shard.collect()])
        found = hits if found is None else found.unionByName(hits)
    return found


def _walked(lowered: DataFrame, id_col: str, phrases: list[str]) -> DataFrame:
    """(id, phrase) for every phrase that the text _low contains."""
    shared = lowered.sparkSession.sparkContext.broadcast(phrases)
    schema = T.StructType([lowered.schema[id_col], T.StructField("phrase", T.StringType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for number, phrase in enumerate(shared.value):
            automaton.add_word(phrase, number)
        automaton.make_automaton()
        for batch in batches:
            texts = batch.column("_low").to_pylist()
            met = [{number for _, number in automaton.iter(t)} if len(automaton) else set() for t in texts]
            rows = np.repeat(np.arange(len(met)), [len(m) for m in met])
            names = [shared.value[n] for m in met for n in sorted(m)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(rows)), pa.array(names, pa.string())], names=[id_col, "phrase"])

    return lowered.mapInArrow(walk, schema)


def new_phrases(learned: DataFrame, bank: dict = banks.KEYWORDS) -> DataFrame:
    """Learned phrases that the bank does not hold yet; the bank is a fixed list, so its broadcast is bounded."""
    spark = learned.sparkSession
    known = spark.createDataFrame([(p,) for p in banks.phrase_list(bank)], "phrase string")
    return learned.join(F.broadcast(known), "phrase", "left_anti")
