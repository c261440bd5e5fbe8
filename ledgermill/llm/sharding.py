"""Sharding by balanced label propagation.

Linked documents start in shards dealt by a hash and move, in rounds, to the shard where most of their neighbours are, as far as its capacity allows.
Documents without links fill what is left. The law is ``rows``: counts of shards are at most one apart, so a shard's capacity is fixed from the start.

Links are given by groups: the documents of a group are linked with each other (for the query: equal texts), which needs a row a document and not one a
pair; a document may be in several groups, and a plain link is a group of two. All steps are joins, groupings and ranks over DataFrames; the driver sees a few numbers a shard. A group larger than a shard's room is cut: its
members fill one shard after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, forget, save
from .ranks import position, ranked

SHARDS, ROUNDS = 16, 40


def quotas(rows: int, shards: int) -> list[int]:
    """Rows of each shard: at most one apart."""
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def _loads(linked: DataFrame, shards: int) -> list[int]:
    found = {r["label"]: r["n"] for r in linked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a shard
    return [found.get(k, 0) for k in range(shards)]


def _pick(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x).cast("long") for x in values]), at + 1)


def _admitted(wishes: DataFrame, n: int, room: list[int]) -> DataFrame:
    """The wishes ``id, grp, to`` that fit in the room of their shard, members of a group one after the other."""
    order = ranked(wishes, ["to"], ["grp", "id"], n)
    return order.filter(F.col("rank") < _pick(room, F.col("to"))).select("id", "to")


def members_of_links(links: DataFrame) -> DataFrame:
    """``id, grp`` of plain links (two columns of ids): each link is a group of two."""
    a, b = links.columns[:2]
    pair = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a != b").distinct().withColumn("grp", F.xxhash64("a", "b"))
    return pair.select(F.explode(F.array("a", "b")).alias("id"), "grp")


def propagate(members: DataFrame, room: list[int], rounds: int = ROUNDS) -> DataFrame:
    """``id, first, label`` of stored memberships ``id, grp`` in groups of two or more, an id in any number of groups (``first``: its least); label -1 where
    no shard had room in any round.

    First each document asks for one shard by the hash of its first group. Then, in each round, every document counts its neighbours (members of its
    groups, itself included once, which keeps pairs from swapping for ever) in each shard, and asks for the one with most of those with room if it has more
    there than in its own; a shard admits what fits. In every other round documents may ask for full shards too, and as many move between two shards one
    way as the other. It ends after two rounds without a move.
    """
    spark, shards = members.sparkSession, len(room)
    ids = members.groupBy("id").agg(F.min("grp").alias("grp"), F.count(F.lit(1)).alias("groups"))
    start, path = save(ids.withColumn("to", F.pmod(F.xxhash64("grp"), F.lit(shards)).cast("int")), "wishes")
    n = start.count()
    label = start.select("id", F.col("grp").alias("first"), "groups").join(_admitted(start, n, room).withColumnRenamed("id", "m"), F.col("id") == F.col("m"), "left")
    now, now_path = save(label.select("id", "first", "groups", F.coalesce("to", F.lit(-1)).alias("label")), "labels")
    forget(spark, path)
    still = 0
    for step in range(rounds):
        swap = step % 2 == 1
        free = [max(0, q - x) for q, x in zip(room, _loads(now, shards), strict=True)]
        # unplaced documents without a neighbour in a shard with room go to the roomiest shards in turn
        roomy = sorted((k for k in range(shards) if free[k]), key=lambda k: -free[k]) or [0]
        placed = now.filter("label >= 0").select(F.col("id").alias("p"), "label")
        held = members.join(placed, F.col("id") == F.col("p")).groupBy(F.col("grp").alias("g"), "label").agg(F.count(F.lit(1)).alias("n"))  # a row a group and shard
        votes = members.join(held, F.col("grp") == F.col("g")).groupBy(F.col("id").alias("v"), F.col("label").alias("there")).agg(F.sum("n").alias("n"))
        seen = now.join(votes, F.col("id") == F.col("v"), "left")
        seen = seen.withColumn("n", F.when(F.col("there") == F.col("label"), F.col("n") - F.col("groups") + 1).otherwise(F.col("n")))  # itself once, not in each group
        seen = seen.groupBy("id", "first", "label")
        usable = F.col("there").isNotNull() if swap else _pick(free, F.col("there")) > 0
        best = seen.agg(F.max(F.when(usable, F.struct("n", (-F.col("there")).alias("l")))).alias("open"), F.coalesce(F.max(F.when(F.col("there") == F.col("label"), F.col("n"))), F.lit(0)).alias("own"))
        target = -F.col("open.l")
        gain = F.col("open").isNotNull() & (target != F.col("label")) & ((F.col("open.n") > F.col("own")) | ((F.col("open.n") == F.col("own")) & (target < F.col("label"))))
        if swap:  # every other document, so that neighbours don't just change places
            to = F.when(gain & (F.col("label") >= 0) & (F.pmod(F.xxhash64("id", F.lit(step)), F.lit(2)) == 0), target)
        else:
            to = F.when(gain, target).when((F.col("label") < 0) & F.lit(any(free)), _pick(roomy, F.pmod(F.xxhash64("first", F.lit(step)), F.lit(len(roomy))).cast("int")))
        wishes = best.select("id", F.col("first").alias("grp"), F.col("label").alias("own_label"), to.cast("int").alias("to")).filter(F.col("to").isNotNull())
        asked, asked_path = save(wishes, "wishes")
        if swap:
            ways = {(r["own_label"], r["to"]): r["n"] for r in asked.groupBy("own_label", "to").agg(F.count(F.lit(1)).alias("n")).collect()}  # two shards a row
            both_ways = [min(ways.get((a, b), 0), ways.get((b, a), 0)) for a in range(shards) for b in range(shards)]
            n_moved, n_asked = sum(both_ways), sum(ways.values())
        else:
            n_moved = n_asked = asked.count()
        still = 0 if n_moved else still + 1
        if n_moved:
            if swap:
                order = ranked(asked, ["own_label", "to"], ["grp", "id"], n_asked)
                moved = order.filter(F.col("rank") < _pick(both_ways, F.col("own_label") * shards + F.col("to"))).select(F.col("id").alias("m"), "to")
            else:
                moved = _admitted(asked, n_asked, free).withColumnRenamed("id", "m")
            new, new_path = save(now.join(moved, F.col("id") == F.col("m"), "left").select("id", "first", "groups", F.coalesce("to", "label").alias("label")), "labels")
            forget(spark, now_path)
            now, now_path = new, new_path
        forget(spark, asked_path)
        if still == 2:
            break
    return now


def shard(rows: DataFrame, members: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Add ``shard`` and ``slot`` to stored rows with a unique ``id``, linked by ``members`` (``id, grp``; groups of one and rows with a null link nothing):
    counts of shards are at most one apart and slots are gapless from 0. An empty table gives none."""
    n = rows.count()
    room = quotas(n, shards)
    members = members.filter(F.col("grp").isNotNull() & F.col("id").isNotNull())
    sizes = members.groupBy(F.col("grp").alias("g")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g")
    linked, _ = save(members.join(sizes, F.col("grp") == F.col("g")).select("id", "grp"), "linked")
    placed = propagate(linked, room, rounds).filter("label >= 0")
    loads = _loads(placed, shards)
    both, _ = save(rows.join(placed.select(F.col("id").alias("p"), F.col("first").alias("__first"), F.col("label").alias("__label")), F.col("id") == F.col("p"), "left").drop("p"), "placed")
    own = ranked(both.filter(F.col("__label").isNotNull()), ["__label"], ["__first", "id"], max(1, sum(loads)))
    own = own.select(*rows.columns, F.col("__label").cast("int").alias("shard"), F.col("rank").alias("slot"))
    free = [q - x for q, x in zip(room, loads, strict=True)]
    ends = [sum(free[: k + 1]) for k in range(shards)]
    rest = ranked(both.filter(F.col("__label").isNull()), [], ["id"], max(1, n - sum(loads))).withColumn("shard", position(F.col("rank"), ends).cast("int"))
    starts = [e - f for e, f in zip(ends, free, strict=True)]
    rest = rest.withColumn("slot", F.col("rank") - _pick(starts, F.col("shard")) + _pick(loads, F.col("shard")))
    return own.union(rest.select(*rows.columns, "shard", "slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row: equal texts are linked. Rows are told apart by id and text alone, so however the
    table is cut into files, its shards are the same; of repeated rows, which takes which place makes no difference.

    Null texts have no bytes and are linked with each other and with empty ones; null and repeated ids are kept, each row apart.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    digest = F.sha2(text, 256)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("grp"))
    stored, path = save(rows, "rows")
    numbered, _ = save(ranked(stored, [], ["doc_id", "grp", "size"], stored.count(), "id"), "numbered")
    forget(docs.sparkSession, path)
    found = shard(numbered, numbered.select("id", "grp"), shards)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of all documents in 16 shards by the law ``rows``. A null text has size 1; null and repeated ids and
    repeated rows take a place each; with fewer rows than shards some shards are empty; an empty table gives no row."""
    return shard_documents(documents(spark, sf_dir))
