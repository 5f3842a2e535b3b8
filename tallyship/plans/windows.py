"""Queries over last-writer-wins folds, ranks and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyship.functions.rules import compile_rule
from tallyship.operators import resolve as R
from tallyship.operators import retention as P
from tallyship.plans.registry import query
from tallyship.sources.adapters import DAY_MS, NOW, NOW_MS, Tables, with_sql


@query(with_sql("tag_events winners", "SELECT ns, tag, ms, is_del, digest FROM winners"))
def w1_winner_fold(t: Tables) -> DataFrame:
    return R.winners(t.tag_events()).select("ns", "tag", "ms", "is_del", "digest")


@query(with_sql("day_events", "SELECT ns, ms, is_del, digest, event_id FROM day_events QUALIFY row_number() OVER (PARTITION BY ns ORDER BY ms DESC NULLS LAST, digest DESC, is_del) = 1"))
def w1_winner_fold_with_ties(t: Tables) -> DataFrame:
    return R.winners(t.day_events(), ("ns",)).select("ns", "ms", "is_del", "digest", "event_id")


@query(with_sql("tag_events winners live", "SELECT ns, tag, digest FROM live"))
def w1_live_tags(t: Tables) -> DataFrame:
    return R.live_tags(t.tag_events()).select("ns", "tag", "digest")


@query(with_sql("day_events", "SELECT ns, tag, event_id, row_number() OVER (PARTITION BY ns ORDER BY ms DESC, tag, event_id) AS rank FROM (SELECT ns, tag, max(ms) AS ms, max(event_id) AS event_id FROM day_events GROUP BY ns, tag)"))
def w2_rank_by_time(t: Tables) -> DataFrame:
    newest = t.day_events().groupBy("ns", "tag").agg(F.max("ms").alias("ms"), F.max("event_id").alias("event_id"))
    return P.ranked(newest, "ms", "rank").select("ns", "tag", "event_id", "rank")


_RULES = ["image.tag == 'purchase'", "top_pushed(3)", "top_pulled(1)", "image.pushed_at > now() - days(2)"]

_RANKED = with_sql(
    "tag_events winners live pulls",
    f"""SELECT *, coalesce(floor(pushed_ms / 1000)::BIGINT, {NOW}) AS pushed_at, coalesce(floor(pulled_ms / 1000)::BIGINT, 0) AS pulled_at,
  CASE WHEN pushed_ms IS NOT NULL THEN row_number() OVER (PARTITION BY ns ORDER BY pushed_ms DESC NULLS LAST, tag) END AS pushed_rank,
  CASE WHEN pulled_ms IS NOT NULL THEN row_number() OVER (PARTITION BY ns ORDER BY pulled_ms DESC NULLS LAST, tag) END AS pulled_rank
FROM (SELECT l.ns, l.tag, l.digest, l.ms AS pushed_ms, p.ms AS pulled_ms FROM live l LEFT JOIN (SELECT ns, tag, max(ms) AS ms FROM pulls GROUP BY ns, tag) p USING (ns, tag))""",
)


def _tags(t: Tables) -> DataFrame:
    live = R.live_tags(t.tag_events()).select("ns", "tag", "digest", F.col("ms").alias("pushed_ms"))
    return P.with_last_pull(live, t.pulls())


@query(f"""SELECT ns, tag, digest, rule IS NOT NULL AS retain, rule AS matched_rule FROM (SELECT *, CASE WHEN tag = 'purchase' THEN 1 WHEN pushed_rank <= 3 THEN 2
  WHEN pulled_rank <= 1 THEN 3 WHEN pushed_at > {NOW} - 2 * 86400 THEN 4 END AS rule FROM ({_RANKED}))""")
def retention_verdict(t: Tables) -> DataFrame:
    """The flagship: which tags a policy keeps, by which rule."""
    return P.verdicts(_tags(t), _RULES, NOW).select("ns", "tag", "digest", "retain", "matched_rule")


@query(f"SELECT ns, tag, pushed_rank, pulled_rank, coalesce(pushed_rank <= 2, false) AS top_pushed, coalesce(pulled_rank <= 1, false) AS top_pulled, false AS top_none FROM ({_RANKED})")
def w3_top_n(t: Tables) -> DataFrame:
    v = P.ranked(P.ranked(_tags(t), "pushed_ms", "pushed_rank"), "pulled_ms", "pulled_rank")
    scope = P.image_scope(NOW)
    columns = {"top_pushed": "top_pushed(2)", "top_pulled": "top_pulled(1)", "top_none": "top_pushed(-1)"}
    return v.select("ns", "tag", "pushed_rank", "pulled_rank", *(compile_rule(r, scope).value.alias(n) for n, r in columns.items()))


@query(f"""SELECT ns, tag, CASE WHEN tag = 'click' THEN 'matched' WHEN tag = 'view' THEN 'matched' ELSE 'no_match' END AS outcome,
  tag IN ('click', 'view') OR coalesce(pulled_rank <= 1, false) AS retain FROM ({_RANKED})""")
def p6_combined_policies(t: Tables) -> DataFrame:
    v = P.verdicts(_tags(t), ["image.tag in ['click', 'view']"], NOW, ["top_pulled(1)"])
    return v.select("ns", "tag", "outcome", F.coalesce("retain", F.lit(False)).alias("retain"))


@query(with_sql("pulls", f"""SELECT ns, tag, client, ms FROM (SELECT ns, tag, client, ms, row_number() OVER (PARTITION BY ns, tag ORDER BY ms DESC, client) AS place FROM pulls)
WHERE place > 1 AND {NOW_MS} - ms >= {10 * DAY_MS}"""))
def w4_retired_access_entries(t: Tables) -> DataFrame:
    return R.retired_entries(t.pulls().withColumnRenamed("client", "entry"), ["ns", "tag"], NOW_MS, 10 * DAY_MS).select("ns", "tag", F.col("entry").alias("client"), "ms")


@query(with_sql("day_events", f"""SELECT ns, tag, digest, ms FROM (SELECT *, rank() OVER (PARTITION BY ns, tag ORDER BY ms DESC) AS place FROM day_events) WHERE place > 1 AND {NOW_MS} - ms >= {5 * DAY_MS}"""))
def w5_demoted_entries(t: Tables) -> DataFrame:
    return R.demoted_entries(t.day_events(), NOW_MS, 5 * DAY_MS).select("ns", "tag", "digest", "ms")


@query(with_sql("day_events", """SELECT w.event_id, CASE WHEN stored_ms > w.ms OR (stored_ms = w.ms AND NOT w.is_del AND stored_digest > w.digest) THEN 'superseded' ELSE 'applied' END AS outcome
FROM day_events w LEFT JOIN (SELECT ns, tag, ms AS stored_ms, digest AS stored_digest FROM day_events WHERE event_id % 2 = 0
  QUALIFY row_number() OVER (PARTITION BY ns, tag ORDER BY ms DESC, digest DESC, is_del) = 1) USING (ns, tag) WHERE w.event_id % 2 = 1"""))
def w6_write_gate(t: Tables) -> DataFrame:
    e = t.day_events()
    state = R.winners(e.where("event_id % 2 = 0"))
    writes = e.where("event_id % 2 = 1").withColumn("digest", F.when(~F.col("is_del"), F.col("digest")))
    return R.gate_writes(writes, state).select("event_id", "outcome")


@query(with_sql("tag_events", "SELECT event_id, coalesce(lag(user_id % 3 + event_id % 2) OVER w <> user_id % 3 + event_id % 2, true) AS changed FROM tag_events WINDOW w AS (PARTITION BY ns, tag ORDER BY ms)"))
def w7_change_detection(t: Tables) -> DataFrame:
    few = t.tag_events().withColumn("digest", F.col("user_id") % 3 + F.col("event_id") % 2)
    return R.changes(few).select("event_id", "changed")


@query(with_sql("pulls", "SELECT ns, tag, client, ms, place FROM (SELECT *, row_number() OVER (PARTITION BY ns, tag ORDER BY ms DESC, client) AS place FROM pulls) WHERE place <= 3"))
def w8_pull_history(t: Tables) -> DataFrame:
    return R.newest_per_key(t.pulls(), ["ns", "tag"], [F.col("ms").desc(), F.col("client")], 3)


@query(with_sql("tag_events", """SELECT ns, tag, digest FROM (SELECT * FROM tag_events WHERE event_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY ns, tag ORDER BY ms DESC, digest DESC, is_del) = 1) WHERE NOT is_del
UNION ALL SELECT ns, tag, digest FROM (SELECT ns, concat('old-', tag) AS tag, max(digest) AS digest FROM tag_events WHERE event_id % 3 = 0 GROUP BY ALL)
UNION ALL SELECT ns, tag, max(digest) FROM tag_events e WHERE event_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM tag_events x WHERE x.ns = e.ns AND x.tag = e.tag AND x.event_id % 3 <> 0) GROUP BY ns, tag"""))
def u1_shadowed_union(t: Tables) -> DataFrame:
    e = t.tag_events()
    old = e.where("event_id % 3 = 0")
    legacy = old.groupBy("ns", "tag").agg(F.max("digest").alias("digest"))
    renamed = legacy.withColumn("tag", F.concat(F.lit("old-"), "tag"))
    return R.shadowed_union(e.where("event_id % 3 <> 0"), legacy.unionByName(renamed)).select("ns", "tag", "digest")


@query("SELECT doc_id, lang FROM (SELECT doc_id, 'local' AS lang FROM labels WHERE quality = 1 UNION ALL SELECT d.doc_id, d.lang FROM documents d WHERE d.n_chars < 2000 AND d.doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1))")
def u4_priority_union(t: Tables) -> DataFrame:
    local = t.labels.where("quality = 1").select("doc_id", F.lit("local").alias("lang"))
    upstream = t.documents.where("n_chars < 2000").select("doc_id", "lang")
    return R.first_by_priority([local, upstream], ["doc_id"])


@query(with_sql("tag_events", "SELECT ns, tag, arg_max(CASE WHEN is_del THEN 'remove' ELSE 'insert' END, event_id) AS op FROM tag_events GROUP BY ns, tag"))
def a8_last_operation(t: Tables) -> DataFrame:
    ops = t.tag_events().withColumn("op", F.when(F.col("is_del"), "remove").otherwise("insert"))
    return R.last_ops(ops, ["ns", "tag"], "op", "event_id")


@query(with_sql("tag_events winners live", "SELECT ns, tag FROM live WHERE digest = (SELECT min(digest) FROM live)"))
def j15_tags_of_digest(t: Tables) -> DataFrame:
    live = R.live_tags(t.tag_events())
    smallest = live.agg(F.min("digest").alias("digest"))
    return live.join(F.broadcast(smallest), "digest", "left_semi").select("ns", "tag")  # one row
