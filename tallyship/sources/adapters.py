"""The star-schema tables of the test folders, seen as tables of an artifact store.

None of the tables is a store; each adapter states a fixed mapping, and ``SQL`` has the
same mapping for the SQL twins of the queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyship.functions import grammar as G
from tallyship.functions import keys as K
from tallyship.functions.scalars import epoch_millis

#: The time at which queries run: the end of the events' month, in milliseconds and seconds.
NOW_MS = 1_706_659_200_000
NOW = NOW_MS // 1000
DAY_MS = 86_400_000


class Tables:
    """The tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def tag_events(self) -> DataFrame:
        """events: user -> namespace, type -> tag, id -> digest; every fifth is a delete."""
        e = self.events
        ns = F.concat(F.lit("org"), (F.col("user_id") % 5).cast("string"), F.lit("/u"), F.col("user_id").cast("string"))
        return e.select(
            ns.alias("ns"), F.col("event_type").alias("tag"), epoch_millis(F.col("ts")).alias("ms"), (F.col("event_id") % 5 == 0).alias("is_del"),
            G.digest_of(F.col("event_id").cast("string")).alias("digest"), "event_id", "user_id", "value",
        )

    def day_events(self) -> DataFrame:
        """Tag events with times cut to days, so that many are tied."""
        return self.tag_events().withColumn("ms", F.col("ms") - F.col("ms") % DAY_MS)

    def pulls(self) -> DataFrame:
        """Pulls of tags: events of type view pull the tags of their user, by a client."""
        e = self.tag_events().where("tag = 'view'")
        target = F.element_at(F.array(*(F.lit(t) for t in ("click", "purchase", "signup"))), (F.col("event_id") % 3 + 1).cast("int"))
        return e.select("ns", target.alias("tag"), "ms", F.concat(F.lit("client"), (F.col("event_id") % 7).cast("string")).alias("client"))

    def objects(self) -> DataFrame:
        """The store's keys: one per tag event."""
        e = self.tag_events()
        key = F.concat(F.lit("v2/ns/"), "ns", F.lit("!tag/"), "tag", F.lit("!/"), K.tag_entry_name(F.col("ms"), F.col("is_del"), F.col("digest")))
        return e.select(key.alias("key"), F.floor(F.col("value") * 100).cast("bigint").alias("size"), "ms")

    def order_parts(self) -> DataFrame:
        """lineitem: pairs of order and part, each once; two numbers are told apart faster than the names made of them."""
        return self.lineitem.select("l_orderkey", "l_partkey").distinct()

    def edges(self) -> DataFrame:
        """lineitem: order -> manifest, part -> layer; a part named twice is one edge."""
        ns = F.concat(F.lit("org"), (F.col("l_orderkey") % 5).cast("string"))
        return self.order_parts().select(ns.alias("ns"), F.col("l_orderkey").alias("digest"), F.lit("layer").alias("kind"), F.col("l_partkey").alias("target"))

    def revisions(self) -> DataFrame:
        """orders: every order is a revision."""
        ns = F.concat(F.lit("org"), (F.col("o_orderkey") % 5).cast("string"))
        return self.orders.select(ns.alias("ns"), F.col("o_orderkey").alias("digest"), epoch_millis(F.col("o_orderdate")).alias("ms"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))

    def jobs(self) -> DataFrame:
        """orders as jobs: customer -> lock, date -> earliest start, priority -> attempts and state."""
        attempts = F.substring("o_orderpriority", 1, 1).cast("int") - 1
        state = F.when(F.col("o_orderstatus") == "F", "failed").otherwise("pending")
        return self.orders.select(
            F.format_string("j%08d", "o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "cache").otherwise("replication").alias("queue"), F.format_string("lock%d", "o_custkey").alias("lock_key"),
            F.col("o_orderkey").alias("seq"), epoch_millis(F.col("o_orderdate")).alias("not_before_ms"), attempts.alias("attempts"), F.lit(None).cast("int").alias("max_attempts"), state.alias("state"), (F.col("o_orderkey") % 97 == 0).alias("poison"),
        )

    def mirrors(self) -> tuple[DataFrame, DataFrame]:
        """labels as tags of two stores that overlap and differ in part."""
        doc = F.col("doc_id")
        local = self.labels.where(doc % 3 != 0).select(doc.alias("tag"), F.col("quality").alias("digest"))
        flipped = F.when(doc % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
        remote = self.labels.where(doc % 4 != 0).select(doc.alias("tag"), flipped.alias("digest"), (doc % 11 == 0).alias("failed"))
        return local, remote

    def turns(self) -> DataFrame:
        """conversations as chains: each turn is a manifest whose child is the turn before it."""
        name = lambda t: F.format_string("c%05d-%03d", "conv_id", t)
        ns = F.concat(F.lit("chat"), (F.col("conv_id") % 3).cast("string"))
        return self.conversations.select(ns.alias("ns"), name(F.col("turn")).alias("digest"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("target"), "turn", "role", "conv_id")

    def repositories(self) -> DataFrame:
        """regions as repositories over the organisations; org4 is in none."""
        r = self.region.where("r_regionkey < 4")
        return r.select(F.concat(F.lit("org"), F.col("r_regionkey").cast("string")).alias("name"), (F.col("r_regionkey") == 2).alias("pull_through"), (F.col("r_regionkey") % 2 == 0).alias("immutable_tags"))


def event_endpoints(t: Tables) -> DataFrame:
    """Endpoints over types of events."""
    rows = [("audit", "required", ["view", "click", "view"], []), ("builds", "async", ["purchase"], ["^org[12]/"]), ("alerts", "optional", ["error"], ["u1", "zzz"])]
    return t.spark.createDataFrame(rows, "endpoint string, policy string, kinds array<string>, filters array<string>")


#: The same mappings for DuckDB, as the bodies of common table expressions.
SQL = {
    "tag_events": """SELECT concat('org', user_id % 5, '/u', user_id) AS ns, event_type AS tag, epoch_us(ts) // 1000 AS ms, event_id % 5 = 0 AS is_del,
        concat('sha256:', sha256(event_id::VARCHAR)) AS digest, event_id, user_id, value FROM events""",
    "day_events": """SELECT concat('org', user_id % 5, '/u', user_id) AS ns, event_type AS tag, (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % 86400000 AS ms, event_id % 5 = 0 AS is_del,
        concat('sha256:', sha256(event_id::VARCHAR)) AS digest, event_id, user_id, value FROM events""",
    "pulls": """SELECT concat('org', user_id % 5, '/u', user_id) AS ns, (['click', 'purchase', 'signup'])[(event_id % 3 + 1)::INT] AS tag, epoch_us(ts) // 1000 AS ms, concat('client', event_id % 7) AS client
        FROM events WHERE event_type = 'view'""",
    "objects": """SELECT concat('v2/ns/org', user_id % 5, '/u', user_id, '!tag/', event_type, '!/', lower(to_hex(18446744073709551614::UBIGINT - (epoch_us(ts) // 1000)::UBIGINT)), '.',
        CASE WHEN event_id % 5 = 0 THEN 'del' ELSE 'set' END, '.sha256.', sha256(event_id::VARCHAR)) AS key, floor(value * 100)::BIGINT AS size, epoch_us(ts) // 1000 AS ms FROM events""",
    "edges": "SELECT DISTINCT concat('org', l_orderkey % 5) AS ns, l_orderkey AS digest, 'layer' AS kind, l_partkey AS target FROM lineitem",
    "revisions": "SELECT concat('org', o_orderkey % 5) AS ns, o_orderkey AS digest, epoch_us(o_orderdate) // 1000 AS ms, o_orderstatus AS status, o_orderpriority AS priority FROM orders",
    "jobs": """SELECT format('j{:08d}', o_orderkey) AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'cache' ELSE 'replication' END AS queue, concat('lock', o_custkey) AS lock_key, o_orderkey AS seq,
        epoch_us(o_orderdate) // 1000 AS not_before_ms, left(o_orderpriority, 1)::INT - 1 AS attempts, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'pending' END AS state, o_orderkey % 97 = 0 AS poison FROM orders""",
    "local": "SELECT doc_id AS tag, quality AS digest FROM labels WHERE doc_id % 3 <> 0",
    "remote": "SELECT doc_id AS tag, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS digest, doc_id % 11 = 0 AS failed FROM labels WHERE doc_id % 4 <> 0",
    "turns": """SELECT concat('chat', conv_id % 3) AS ns, format('c{:05d}-{:03d}', conv_id, turn) AS digest, CASE WHEN turn > 0 THEN format('c{:05d}-{:03d}', conv_id, turn - 1) END AS target,
        turn, role, conv_id FROM conversations""",
    "repositories": "SELECT concat('org', r_regionkey) AS name, r_regionkey = 2 AS pull_through, r_regionkey % 2 = 0 AS immutable_tags FROM region WHERE r_regionkey < 4",
    "winners": """SELECT * FROM tag_events QUALIFY row_number() OVER (PARTITION BY ns, tag ORDER BY ms DESC NULLS LAST, digest DESC, is_del) = 1""",
    "live": "SELECT * FROM winners WHERE NOT is_del",
}


def with_sql(names: str, body: str, more: str = "") -> str:
    """A query over some of the mapped tables, in the order given, and over ``more`` table expressions."""
    return "WITH " + ", ".join([*(f"{n} AS ({SQL[n]})" for n in names.split()), *filter(None, [more])]) + "\n" + body
