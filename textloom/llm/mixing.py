"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

A source's target is its weight's share of all tokens, no more than ``max_repeat`` times its own size; what that cuts
off is shared again by weight.  The targets are apportioned into whole blocks of ``block_tokens`` tokens by highest
quotients ``target / (2k + 1)``; a source's blocks go to its shards in the same way, by shard size.  Each shard is a
stream of documents in a seeded order, and its quota is the first so many blocks of that stream, read again from its
start where the quota is longer.  Shards hold a bounded number of tokens and documents, so a source with a third of
all rows is many tasks.

Only quotients near the cut are listed: a seat count differs from the exact share by at most the share of half the
parties plus one, so each party lists that many seats around its share (in total a few for each party).

Edge cases: null text has size 0 and is never taken; a null source is a source, ordered last; an empty table gives
an empty result; repeated ids are separate documents; input columns outside the named ones don't take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_TOKENS = 64
SHARD_TOKENS, SHARD_DOCS = 2_000_000, 20_000
MAX_REPEAT = 3
SEED = "mix-1"


def _apportion(parties: DataFrame, by: list[str], name: list[str], votes: str, seats: str) -> DataFrame:
    """Adds ``tl_won``: Sainte-Lague seats of each party among those with equal ``by``; ``seats`` is their number."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    share = F.when(F.col("tl_votes") > 0, F.col(votes).cast("double") / F.col("tl_votes")).otherwise(0.0)
    near = (
        parties.withColumn("tl_votes", F.sum(votes).over(group))
        .withColumn("tl_many", F.count(F.lit(1)).over(group))
        .withColumn("tl_share", share)
        .withColumn("tl_exact", F.floor(F.col("tl_share") * F.col(seats)))
        .withColumn("tl_margin", F.ceil(F.col("tl_share") * F.col("tl_many") / 2) + 1)
        .withColumn("tl_sure", F.greatest(F.lit(0), F.col("tl_exact") - F.col("tl_margin")))
    )
    near = near.withColumn("tl_open", F.col(seats) - F.sum("tl_sure").over(group))
    order = [F.desc("tl_quotient"), *[F.col(c).asc_nulls_last() for c in name], F.col("tl_seat")]
    listed = (
        near.filter(F.col(votes) > 0)
        .select("*", F.explode(F.sequence(F.col("tl_sure"), F.col("tl_exact") + F.col("tl_margin"))).alias("tl_seat"))
        .withColumn("tl_quotient", F.col(votes).cast("double") / (2 * F.col("tl_seat") + 1))
        .withColumn("tl_place", F.row_number().over(group.orderBy(*order)))
        .filter(F.col("tl_place") <= F.col("tl_open"))
    )
    keys = [*by, *name]
    extra = listed.groupBy(*keys).agg(F.count(F.lit(1)).alias("tl_extra"))
    r = extra.select(*[F.col(c).alias(f"{c}_r") for c in keys], "tl_extra")
    match = [near[c].eqNullSafe(r[f"{c}_r"]) for c in keys]
    kept = [near[c] for c in parties.columns]
    return near.join(r, match, "left").select(*kept, (F.col("tl_sure") + F.coalesce("tl_extra", F.lit(0))).alias("tl_won"))


def targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``tl_source, tl_source_size, tl_docs`` with ``tl_weight`` (1, 2, 3, repeating) and ``tl_target``."""
    one = Window.partitionBy(F.lit(0))
    cap = F.col("tl_source_size").cast("double") * max_repeat
    ranked = (
        sizes.withColumn("tl_weight", (F.row_number().over(one.orderBy(F.col("tl_source").asc_nulls_last())) - 1) % 3 + 1)
        .withColumn("tl_cap", cap)
        .withColumn("tl_total", F.sum("tl_source_size").over(one).cast("double"))
    )
    by_cap = one.orderBy(F.col("tl_cap") / F.col("tl_weight"), F.col("tl_source").asc_nulls_last())
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("tl_total") - F.coalesce(F.sum("tl_cap").over(before), F.lit(0.0))) / F.sum("tl_weight").over(after)
    full = F.col("tl_level") * F.col("tl_weight") > F.col("tl_cap")
    return (
        ranked.withColumn("tl_level", level)
        .withColumn("tl_full", full)
        .withColumn("tl_level", F.max(F.when(~F.col("tl_full"), F.col("tl_level"))).over(one))
        .withColumn("tl_target", F.when(F.col("tl_full"), F.col("tl_cap")).otherwise(F.col("tl_level") * F.col("tl_weight")))
        .drop("tl_level", "tl_full", "tl_cap")
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: list[str] | None = None,
    block_tokens: int = BLOCK_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
    shard_docs: int = SHARD_DOCS,
    max_repeat: int = MAX_REPEAT,
    seed: str = SEED,
) -> DataFrame:
    """One row a document: ``id_col, size, source_size, target, taken`` (and ``tl_carry``, a struct of ``carry``)."""
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(docs[id_col].cast("string"), F.lit(""))).cast("binary"))
    fields: list[Column] = [
        docs[id_col].alias("tl_id"),
        docs[source_col].alias("tl_source"),
        F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("tl_size"),
        digest.alias("tl_digest"),
    ]
    light = docs.select(*fields)
    if carry:
        sized = docs.select(*fields, F.struct(*[docs[c] for c in carry]).alias("tl_carry"))
    else:
        light = sized = checkpointed(light)
    sizes = light.groupBy("tl_source").agg(F.sum("tl_size").alias("tl_source_size"), F.count(F.lit(1)).alias("tl_docs"))
    blocks = targets(sizes, max_repeat).withColumn("tl_seats", F.round(F.col("tl_total") / block_tokens).cast("long"))
    sources = _apportion(blocks, [], ["tl_source"], "tl_target", "tl_seats").withColumn(
        "tl_shards",
        F.greatest(F.lit(1), F.ceil(F.col("tl_source_size") / shard_tokens), F.ceil(F.col("tl_docs") / shard_docs)),
    )
    sources = checkpointed(
        sources.select("tl_source", "tl_source_size", "tl_target", "tl_shards", F.col("tl_won").alias("tl_source_won"))
    )

    def sharded(rows: DataFrame) -> DataFrame:
        s = sources.withColumnRenamed("tl_source", "tl_of")
        shard = F.conv(F.substring("tl_digest", 1, 8), 16, 10).cast("long") % F.col("tl_shards")
        return rows.join(s, rows["tl_source"].eqNullSafe(s["tl_of"])).drop("tl_of").withColumn("tl_shard", shard)

    shards = (
        sharded(light)
        .groupBy("tl_source", "tl_shard", "tl_source_won")
        .agg(F.sum("tl_size").alias("tl_shard_size"))
    )
    quotas = _apportion(shards, ["tl_source"], ["tl_shard"], "tl_shard_size", "tl_source_won").select(
        F.col("tl_source").alias("tl_of"),
        F.col("tl_shard").alias("tl_at"),
        "tl_shard_size",
        F.least(F.col("tl_won") * block_tokens, F.col("tl_shard_size") * max_repeat).alias("tl_quota"),
    )
    rows = sharded(sized)
    rows = rows.join(quotas, rows["tl_source"].eqNullSafe(quotas["tl_of"]) & (rows["tl_shard"] == quotas["tl_at"]))
    stream = Window.partitionBy("tl_source", "tl_shard").orderBy(F.substring("tl_digest", 9, 24), "tl_size")
    before = F.sum("tl_size").over(stream.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tl_size")
    passes = F.when(F.col("tl_shard_size") > 0, F.floor(F.col("tl_quota") / F.col("tl_shard_size"))).otherwise(F.lit(0))
    rows = rows.withColumn("tl_before", before).withColumn("tl_passes", passes)
    rest = F.col("tl_quota") - F.col("tl_passes") * F.col("tl_shard_size") - F.col("tl_before")
    taken = F.col("tl_passes") * F.col("tl_size") + F.greatest(F.lit(0), F.least(F.col("tl_size"), rest))
    return rows.select(
        F.col("tl_id").alias(id_col),
        F.col("tl_size").alias("size"),
        F.col("tl_source_size").cast("long").alias("source_size"),
        F.col("tl_target").alias("target"),
        taken.cast("long").alias("taken"),
        *(["tl_carry"] if carry else []),
    )


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as it is taken, the last time cut to the words taken."""
    mixed = mix_sources(docs, id_col, text_col, source_col, carry=docs.columns, **options).filter(F.col("taken") > 0)
    copies = mixed.withColumn("tl_copy", F.explode(F.sequence(F.lit(0), F.floor((F.col("taken") - 1) / F.col("size")))))
    left = F.least(F.col("size"), F.col("taken") - F.col("tl_copy") * F.col("size"))
    text = F.col(f"tl_carry.`{text_col}`")
    words = F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), left.cast("int"))
    cut = F.when(left == F.col("size"), text).otherwise(F.array_join(words, " "))
    return copies.select(*[(cut if c == text_col else F.col(f"tl_carry.`{c}`")).alias(c) for c in docs.columns])
