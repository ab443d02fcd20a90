"""Queries of the training-data problems, with their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.ids import clean_match_id
from quern.functions.oracle_text import bundle_sql, match_id_sql, player_sql
from quern.llm.encodings import restore_texts
from quern.llm.leaks import leaks
from quern.llm.splits import ComponentStore, match_links, workspace
from quern.llm.survivors import survive_fields, surviving_bundle
from quern.llm.tokens import encode_corpus
from quern.sources.tables import table

VOCABULARY = os.environ.get("QUERN_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return surviving_bundle(table(spark, d, "occurrences"), table(spark, d, "matches")).select("match_id", "bundle")


def p2_fields(spark: SparkSession, d: str) -> DataFrame:
    """One header for each match, field by field: valid copies first, then the later fetch, then the larger value."""
    rows = table(spark, d, "matches").withColumn("match_id", clean_match_id(F.col("match_id"))).where(F.col("match_id").isNotNull())
    fields = ["game_version", "game_creation_utc_ms", "participant_count", "reason"]
    return survive_fields(rows, ["match_id"], fields, [F.coalesce((F.col("valid_for_pipeline") == 1).cast("int"), F.lit(0))], F.col("fetched_at_utc"))


def _store(spark: SparkSession, d: str) -> ComponentStore:
    """The component store, grown by all links of the table: in a new folder, or in the one that the session names in
    spark.quern.components, where it keeps growing from run to run and holds all matches it was ever given."""
    store = ComponentStore(spark, spark.conf.get("spark.quern.components", None) or workspace(spark).root)
    store.update(match_links(table(spark, d, "match_participants")))
    return store


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).table("members").select(F.col("node").alias("match_id"), F.col("component").alias("group_key"))


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    """match_id, group_key, split of all matches, 80/10/10."""
    return _store(spark, d).table().select(F.col("node").alias("match_id"), F.col("component").alias("group_key"), "split")


def p5_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The components of p5_found, from two batches of bundles added to a component store one after the other."""
    store, p = ComponentStore(spark, workspace(spark).root), table(spark, d, "match_participants")
    first = F.pmod(F.xxhash64("bundle"), F.lit(2)) == 0
    store.update(match_links(p.where(first)))
    s = store.update(match_links(p.where(~first)))
    return s.select(F.col("node").alias("match_id"), F.col("component").alias("group_key"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), VOCABULARY)


def p6_offsets(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), VOCABULARY, offsets=True)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where("kind = 'passage'").select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """For each leaked item: documents with passages and with re-parameterised templates, and the longest of each."""
    x = _leaks(spark, d).groupBy("item_id", "kind").agg(F.count("*").alias("documents"), F.max("words").alias("longest"))
    return x.select("item_id", "kind", "documents", "longest")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return restore_texts(table(spark, d, "documents")).where("found").select("doc_id")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return restore_texts(table(spark, d, "documents")).where("found").select("doc_id", "restored", "path")


QUERIES = {f.__name__: f for f in (p2_found, p2_fields, p5_found, p5_splits, p5_incremental, p6_ids, p6_offsets, p7_found, p7_items, p8_found, p8_restored)}

_M = match_id_sql("match_id")
_FIELD = "arg_max({0}, ({0} is not null, valid_for_pipeline is not distinct from 1, fetched_at_utc is not null, coalesce(fetched_at_utc, 0), {0})) filter ({0} is not null) {0}"

ORACLES = {
    "p2_found": f"""
with o as (select distinct {_M} m, {bundle_sql('bundle')} b from occurrences where match_id is not null and bundle is not null),
l as (select * from o where m is not null and b is not null),
many as (select m from l group by m having count(*) >= 2),
h as (select {_M} m, {bundle_sql('bundle')} b, valid_for_pipeline is not distinct from 1 v, least(coalesce(participant_count, 0), 10) c, coalesce(fetched_at_utc, -1) t from matches),
x as (select l.m, l.b, h.m is not null has, h.v, h.c, h.t from l join many on l.m = many.m left join h on h.m = l.m and h.b = l.b)
select m match_id, b bundle from x qualify row_number() over (partition by m order by has desc, v desc, c desc, t desc, b) = 1""",
    "p2_fields": f"""
select {_M} match_id, {", ".join(_FIELD.format(f) for f in ("game_version", "game_creation_utc_ms", "participant_count", "reason"))}
from matches where match_id is not null group by 1""",
    "p5_found": f"""
with recursive rows as (select distinct {_M} m, {player_sql('puuid')} p from match_participants where match_id is not null),
nodes as (select distinct m from rows),
low as (select p, min(m) m from rows where p is not null group by p),
e as (select distinct rows.m a, low.m b from rows join low using (p) where rows.m <> low.m union select distinct low.m, rows.m from rows join low using (p) where rows.m <> low.m),
cc(m, c) using key (m) as (
  select m, m from nodes
  union
  select e.b, min(cc.c) from cc join e on cc.m = e.a join recurring.cc as r on r.m = e.b where cc.c < r.c group by e.b)
select m match_id, c group_key from cc""",
}
ORACLES["p5_incremental"] = ORACLES["p5_found"]
