"""Merging a run's snapshots into the archive, set by set.

The snapshots of a conversation are folded in order, because whether one replaces another depends on the one
that stands: it is not transitive where times are missing. The fold sees narrow structs only. Its result says
which snapshot stands (w) and which others were looked at after it; then

* conversations: the row of w;
* nodes, messages, edges: per key the earliest snapshot from w on (later losers only add what is missing);
* links, attachments, tool rows: per key the latest from w on;
* message_runs: a pair stays while every later winner has the message.

The archive's own state takes part as snapshot -1. A snapshot equal to the one that stands adds provenance only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import normalize

KEYS = {
    "nodes": ["conversation_id", "id"],
    "node_children": ["conversation_id", "parent_node_id", "child_index"],
    "messages": ["conversation_id", "id"],
    "links": ["conversation_id", "id"],
    "attachments": ["conversation_id", "id"],
    "tool_calls": ["conversation_id", "id"],
    "tool_results": ["conversation_id", "id"],
}
FIRST_COME = ("nodes", "node_children", "messages")
_STATE = "struct<w:long,ts:string,n:int,fp:string,winners:array<long>,seen:array<long>>"


def replaces(ts: Column, n: Column, old_ts: Column, old_n: Column) -> Column:
    """The later time wins; without two times, or with equal ones, at least as many messages win."""
    timed = (ts != "") & (old_ts != "")
    return F.when(timed & (ts > old_ts), True).when(timed & (ts < old_ts), False).otherwise(n >= old_n)


def recency() -> Column:
    blank = F.lit("")
    return F.coalesce(F.when(F.col("updated_at") != "", F.col("updated_at")), F.col("latest_message_at"), blank)


def fold(states: DataFrame) -> DataFrame:
    """(id, w, before, winners, seen, fast) from (id, seq, ts, n, fp); before: what stood before w, null if nothing did."""
    empty = F.lit(None).cast(_STATE)

    def step(acc: Column, x: Column) -> Column:
        won = F.struct(x["seq"].alias("w"), x["ts"].alias("ts"), x["n"].alias("n"), x["fp"].alias("fp"), F.concat(F.coalesce(acc["winners"], F.array().cast("array<long>")), F.array(x["seq"])).alias("winners"), F.concat(F.coalesce(acc["seen"], F.array().cast("array<long>")), F.array(x["seq"])).alias("seen"))
        lost = F.struct(acc["w"].alias("w"), acc["ts"].alias("ts"), acc["n"].alias("n"), acc["fp"].alias("fp"), acc["winners"].alias("winners"), F.concat(acc["seen"], F.array(x["seq"])).alias("seen"))
        return F.when(acc.isNull(), won).when(x["fp"] == acc["fp"], acc).when(replaces(x["ts"], x["n"], acc["ts"], acc["n"]), won).otherwise(lost)

    rows = states.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "ts", "n", "fp"))).alias("s"))
    out = rows.select("id", F.transform("s", lambda x: x["seq"]).alias("all"), F.aggregate("s", empty, step).alias("f"))
    return out.select("id", "all", "f.w", F.when(F.size("f.winners") > 1, F.element_at("f.winners", -2)).alias("before"), "f.winners", "f.seen")


def _empty_like(df: DataFrame, drop: tuple[str, ...]) -> DataFrame:
    return df.drop(*drop).where("false")


def merge(archive: dict[str, DataFrame], new: dict[str, DataFrame], run_id: str, imported_at: str, staged: str | None = None) -> dict[str, DataFrame]:
    """The new tables of the conversations in the run and the archive; new: the run's entities; archive: as merge gave it, or empty.

    staged: where the fold's narrow result is written, as every table is made from it.
    """
    convs = new["conversations"]
    old_convs = archive.get("conversations", convs.drop("seq").where("false"))
    state = lambda df, seq: df.select("id", seq.alias("seq"), recency().alias("ts"), F.col("message_count").alias("n"), F.col("source_fingerprint").alias("fp"))
    folded = fold(state(convs, F.col("seq")).union(state(old_convs, F.lit(-1).cast("long"))))
    stands = folded.select(F.col("id").alias("conversation_id"), "w", "before", "winners", "seen")
    if staged:
        stands.write.parquet(staged)
        stands = convs.sparkSession.read.schema(stands.schema).parquet(staged)
    out: dict[str, DataFrame] = {}

    def candidates(name: str) -> DataFrame:
        """Rows of the snapshots that were looked at, with their seq and w."""
        now = new[name]
        if "ord" not in now.columns:
            now = now.withColumn("ord", F.col("time_index") if name == "messages" else F.lit(0))
        old = archive.get(name, _empty_like(now, ("seq", "ord"))).withColumn("seq", F.lit(-1).cast("long")).withColumn("ord", F.lit(0))
        both = now.unionByName(old, allowMissingColumns=True)
        return both.join(stands.select("conversation_id", "w", "before", "seen"), "conversation_id").where(F.array_contains("seen", F.col("seq")))

    for name, keys in KEYS.items():
        rows = candidates(name).where("seq >= w")
        if name in FIRST_COME:  # of equal ids in one snapshot the winner's last, a loser's first
            order = [F.asc("seq"), F.when(F.col("seq") == F.col("w"), -F.col("ord")).otherwise(F.col("ord"))]
        else:
            order = [F.desc("seq"), F.desc("ord")]
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1")
        if name in ("nodes", "node_children"):  # a loser's rows have no run of their own
            rows = rows.withColumn("run_id", F.when((F.col("seq") == F.col("w")) | (F.col("seq") == -1), F.col("run_id")))
        out[name] = rows.drop("seq", "w", "before", "seen", "ord", "_r")

    ids = candidates("messages")
    standing = ids.where("seq >= before and seq < w").select("conversation_id", "id").distinct()
    kept = ids.where("seq = w").select("conversation_id", "id").distinct()
    removed = standing.join(kept, ["conversation_id", "id"], "left_anti").groupBy("conversation_id").agg(F.array_sort(F.collect_set("id")).alias("removed"))
    rows = convs.unionByName(old_convs.withColumn("seq", F.lit(-1).cast("long")), allowMissingColumns=True)
    rows = rows.join(stands.select(F.col("conversation_id").alias("id"), "w"), "id").where("seq = w").join(removed.withColumnRenamed("conversation_id", "id"), "id", "left")
    rows = rows.withColumn("metadata", F.when(F.col("seq") >= 0, normalize.metadata_json(F.coalesce("removed", F.array().cast("array<string>")))).otherwise(F.col("metadata")))
    out["conversations"] = rows.select("notes", *normalize.CONVERSATION)

    # provenance: one row for the run, that of w if the run has it, else the last
    mine = convs.join(stands.select(F.col("conversation_id").alias("id"), "w"), "id")
    last = mine.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.col("seq") == F.col("w")), F.desc("seq")))).where("_r = 1")
    last = last.withColumn("is_canonical_snapshot", F.col("seq") == F.col("w")).withColumn("imported_at", F.lit(imported_at)).withColumn("conversation_id", F.col("id"))
    runs = ["conversation_id", *(c for c in normalize.CONVERSATION if c != "id"), "imported_at", "is_canonical_snapshot"]
    now = last.select(*runs)
    if "conversation_runs" in archive:
        won = stands.where("w >= 0").select("conversation_id", F.lit(True).alias("_won"))
        old = archive["conversation_runs"].join(won, "conversation_id", "left").withColumn("is_canonical_snapshot", F.col("is_canonical_snapshot") & F.col("_won").isNull()).select(*runs)
        now = old.unionByName(now)
    out["conversation_runs"] = now

    every = new["messages"].select("seq", "run_id", "conversation_id", F.col("id").alias("message_id"))
    pairs = every
    if "message_runs" in archive:
        pairs = pairs.unionByName(archive["message_runs"].select(F.lit(-1).cast("long").alias("seq"), "run_id", "conversation_id", "message_id"))
    winners = stands.select("conversation_id", F.explode("winners").alias("winner")).where("winner >= 0")
    has = every.select("conversation_id", "message_id", F.col("seq").alias("winner")).distinct()
    missed = pairs.select("conversation_id", "message_id").distinct().join(winners, "conversation_id").join(has, ["conversation_id", "message_id", "winner"], "left_anti")
    missed = missed.groupBy("conversation_id", "message_id").agg(F.max("winner").alias("missed"))
    alive = pairs.join(missed, ["conversation_id", "message_id"], "left").where("missed is null or seq >= missed")
    out["message_runs"] = alive.select("run_id", "conversation_id", "message_id").distinct()
    out["message_index"] = index(out["messages"])
    return out


def index(messages: DataFrame) -> DataFrame:
    """The search index: tokens of each message that has text."""
    from .search import token_column

    said = messages.where("text is not null and text <> ''")
    return said.select("conversation_id", F.col("id").alias("message_id"), "run_id", token_column(F.col("role")).alias("role"), token_column(F.col("text")).alias("text"))


def counts(new: dict[str, DataFrame]) -> dict[str, int]:
    """What the run has brought, whether it changed anything or not."""
    names = ("conversations", "messages", "links", "attachments", "tool_calls", "tool_results")
    rows = reduce(DataFrame.union, (new[n].select(F.lit(n).alias("name")) for n in names)).groupBy("name").count().collect()
    return {n: 0 for n in names} | {r["name"]: r["count"] for r in rows}
