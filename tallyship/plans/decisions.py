"""Queries over policies, routing and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyship.functions import rules as R
from tallyship.operators import events as E
from tallyship.operators import retention as P
from tallyship.operators import routing as T
from tallyship.operators.queue import ready
from tallyship.plans.registry import query
from tallyship.sources.adapters import NOW_MS, Tables, event_endpoints, with_sql

#: Requests out of events: the type is the action, and fields are left out where a policy has to test for them.
_ACTIONS = {"view": "get-manifest", "click": "get-blob", "purchase": "put-manifest", "signup": "list-tags", "error": "delete-manifest"}


def _requests(t: Tables) -> DataFrame:
    e = t.tag_events()
    action = F.element_at(F.create_map(*(F.lit(x) for kv in _ACTIONS.items() for x in kv)), F.col("tag"))
    claims = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("repository"), F.concat(F.lit("org"), (F.col("event_id") % 2).cast("string"), F.lit("/app"))))
    return e.select(
        "event_id", "ns", action.alias("action"), F.when(F.col("event_id") % 2 == 0, "bob").alias("username"), F.when(F.col("event_id") % 7 < 3, "other/x").alias("source"),
        F.coalesce(claims, F.create_map().cast("map<string,string>")).alias("claims"),
    )


def _scope(has_policy: bool = False) -> R.Scope:
    return R.access_scope(
        optional={"request.from": F.col("source"), "request.namespace": F.col("ns"), "request.action": F.col("action")},
        nullable={"identity.username": F.col("username")}, maps={"identity.oidc.claims": F.col("claims")}, has_own_policy=F.lit(has_policy),
    )


_SQL_REQUESTS = with_sql(
    "tag_events",
    """SELECT event_id, ns, CASE tag WHEN 'view' THEN 'get-manifest' WHEN 'click' THEN 'get-blob' WHEN 'purchase' THEN 'put-manifest' WHEN 'signup' THEN 'list-tags' ELSE 'delete-manifest' END AS action,
  event_id % 2 = 0 AS bob, event_id % 7 < 3 AS sourced, event_id % 3 = 0 AS claimed, event_id % 2 = 1 AS org1 FROM tag_events""",
)


@query(f"""SELECT event_id, CASE WHEN action LIKE 'get-%' THEN 'matched' WHEN bob AND action = 'put-manifest' THEN 'matched' WHEN NOT claimed THEN 'indeterminate' WHEN org1 THEN 'matched' ELSE 'no_match' END AS outcome,
  CASE WHEN action LIKE 'get-%' THEN 1 WHEN bob AND action = 'put-manifest' THEN 2 WHEN NOT claimed OR org1 THEN 3 END AS index FROM ({_SQL_REQUESTS})""")
def p2_ordered_rules(t: Tables) -> DataFrame:
    rules = ["request.action.startsWith('get-')", "identity.username == 'bob' && request.action == 'put-manifest'", "identity.oidc.claims['repository'].startsWith('org1/')"]
    return _requests(t).withColumn("v", R.evaluate(rules, _scope())).select("event_id", "v.outcome", "v.index")


@query(f"SELECT event_id, action LIKE 'get-%' OR (bob AND sourced) AS allowed, NOT (action = 'delete-manifest' AND NOT bob) AND sourced AS open_allowed FROM ({_SQL_REQUESTS})")
def p3_access_decision(t: Tables) -> DataFrame:
    closed = R.allows(["request.action in ['get-manifest', 'get-blob']", "has(request.from) && identity.username != null"], _scope(), False)
    opened = R.allows(["request.action == 'delete-manifest' && identity.username == null", "request.from == 'none'"], _scope(), True)
    return _requests(t).select("event_id", closed.alias("allowed"), opened.alias("open_allowed"))


@query(f"""SELECT event_id, r.name AS repository, (action LIKE 'get-%' OR bob) AND (r.name IS NULL OR action <> 'delete-manifest') AND NOT (action = 'put-manifest' AND coalesce(r.pull_through, false)) AS allowed
FROM ({_SQL_REQUESTS}) q LEFT JOIN (SELECT concat('org', r_regionkey) AS name, r_regionkey = 2 AS pull_through FROM region WHERE r_regionkey < 4) r ON q.ns = r.name OR starts_with(q.ns, r.name || '/')""")
def p4_two_level_access(t: Tables) -> DataFrame:
    repos = t.repositories()
    r = T.with_repository(_requests(t), repos).join(repos.withColumnRenamed("name", "repository"), "repository", "left")
    everyone = R.allows(["request.action.startsWith('get-') || identity.username != null"], _scope(), False)
    own = R.allows(["request.action == 'delete-manifest'"], _scope(True), True)
    allowed = T.request_allowed(everyone, own, F.col("repository").isNotNull(), F.col("action") == "put-manifest", F.col("pull_through"))
    return r.select("event_id", "repository", allowed.alias("allowed"))


@query("SELECT doc_id, source, CASE WHEN source = 'src1' THEN 'src1' END AS repository FROM documents")
def p7_segment_prefix(t: Tables) -> DataFrame:
    repos = t.spark.createDataFrame([("src1",), ("other",)], "name string")
    return T.with_repository(t.documents.select("doc_id", "source"), repos, "source")


@query(with_sql("tag_events repositories", """SELECT e.event_id, (coalesce(r.immutable_tags, false) OR e.user_id % 10 = 0) AND NOT (CASE WHEN r.name = 'org2' THEN contains(e.tag, 'view') ELSE regexp_matches(e.tag, '^(click|err)') END) AS immutable
FROM tag_events e LEFT JOIN repositories r ON starts_with(e.ns, r.name || '/')"""))
def p8_tag_immutability(t: Tables) -> DataFrame:
    repos = t.repositories()
    r = T.with_repository(t.tag_events(), repos).join(repos.withColumnRenamed("name", "repository"), "repository", "left")
    own = F.when(F.col("repository") == "org2", F.array(F.lit("view"))).otherwise(F.array().cast("array<string>"))
    return r.select("event_id", T.immutable(F.col("tag"), F.col("user_id") % 10 == 0, F.col("immutable_tags"), F.array(F.lit("^click"), F.lit("^err")), own).alias("immutable"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN coalesce(CASE WHEN p_size > 25 THEN p_type ELSE p_brand END = 'ECONOMY', false) ELSE false END AS matches FROM part")
def p9_artifact_filter(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 3
    wanted = F.when(k == 1, "ECONOMY").when(k == 2, "absent")
    return t.part.select("p_partkey", T.matches_artifact(wanted, F.when(F.col("p_size") > 25, F.col("p_type")), F.col("p_brand")).alias("matches"))


@query(with_sql("tag_events", """SELECT event_id, 'audit' AS endpoint, 'required' AS policy FROM tag_events WHERE tag IN ('view', 'click') UNION ALL
SELECT event_id, 'builds', 'async' FROM tag_events WHERE tag = 'purchase' AND regexp_matches(ns, '^org[12]/') UNION ALL SELECT event_id, 'alerts', 'optional' FROM tag_events WHERE tag = 'error' AND contains(ns, 'u1')"""))
def p10_event_fan_out(t: Tables) -> DataFrame:
    events = t.tag_events().select("event_id", F.col("tag").alias("kind"), F.col("ns").alias("repository"))
    return T.deliveries(events, event_endpoints(t)).select("event_id", "endpoint", "policy")


@query(with_sql("tag_events", "SELECT event_id, tag IN ('view', 'click') AND regexp_matches(ns, '^org3') AS replicated FROM tag_events"))
def p11_downstream_routing(t: Tables) -> DataFrame:
    return t.tag_events().select("event_id", T.replicates(F.col("ns"), F.col("tag"), ["view", "click"], F.array(F.lit("^org3"))).alias("replicated"))


@query("""SELECT o_orderkey, age < 1000 OR age IS NULL AS young, CASE WHEN o_orderstatus = 'P' THEN 'keep' WHEN o_orderkey % 5 = 0 THEN 'delete' WHEN age > 1000 THEN 'delete' ELSE 'keep' END AS upload, coalesce(age >= 1000, false) AS abandoned
FROM (SELECT *, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 3) - 1 + 1000 END AS age FROM orders)""")
def p13_age_gates(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    o = t.orders.withColumn("age", F.when(k % 7 > 0, k % 3 - 1 + 1000))
    state = F.when(F.col("o_orderstatus") == "P", "error").when(k % 5 == 0, "corrupt").otherwise("ok")
    age = F.col("age")
    return o.select("o_orderkey", P.young(age, 1000).alias("young"), P.upload_verdict(age, 1000, state).alias("upload"), F.coalesce(P.abandoned(age, 1000), F.lit(False)).alias("abandoned"))


@query(with_sql("jobs", "SELECT id FROM jobs WHERE state = 'pending' AND not_before_ms <= 900000000000"))
def p17_ready_jobs(t: Tables) -> DataFrame:
    return ready(t.jobs(), 900_000_000_000).where("state = 'pending'").select("id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS note FROM part")
def p20_reserved_annotations(t: Tables) -> DataFrame:
    a = F.create_map(F.when(F.col("p_partkey") % 3 == 0, "own.note").otherwise("else.note"), F.col("p_brand"))
    return t.part.select("p_partkey", F.try_element_at(T.own_annotations(a, "own."), F.lit("own.note")).alias("note"))


@query(with_sql("tag_events", "SELECT tag, min(ns) AS ns FROM tag_events WHERE user_id % 4 = 1 GROUP BY tag"))
def p21_mount_source(t: Tables) -> DataFrame:
    return T.first_authorized(t.tag_events(), ["tag"], "ns", F.col("user_id") % 4 == 1).select("tag", "ns")


@query(f"SELECT event_id, action, CASE WHEN sourced THEN 'other/x' END AS source, 2 + sourced::INT AS fields FROM ({_SQL_REQUESTS})")
def p22_policy_input(t: Tables) -> DataFrame:
    r = _requests(t)
    i = E.policy_input({"namespace": F.col("ns"), "from": F.col("source")}, F.col("action"))
    return r.withColumn("i", i).select("event_id", F.element_at("i", "action").alias("action"), F.try_element_at("i", F.lit("from")).alias("source"), F.size("i").alias("fields"))


@query(with_sql("tag_events", """SELECT event_id, 0 AS seq, 'manifest.push' AS kind, NULL AS tag FROM tag_events UNION ALL SELECT event_id, 1, 'tag.create', tag FROM tag_events UNION ALL SELECT event_id, 2, 'tag.create', 'latest' FROM tag_events WHERE event_id % 2 = 0"""))
def t1_put_events(t: Tables) -> DataFrame:
    e = t.tag_events()
    tags = F.when(F.col("event_id") % 2 == 0, F.array("tag", F.lit("latest"))).otherwise(F.array("tag"))
    return E.put_events(e.select("event_id", "ns", tags.alias("tags"))).select("event_id", "seq", "kind", "tag")


@query(with_sql("tag_events", """SELECT event_id, 0 AS seq, 'manifest.delete' AS kind, CASE WHEN event_id % 2 = 0 THEN digest END AS digest, NULL AS tag FROM tag_events WHERE is_del
UNION ALL SELECT event_id, 1, 'tag.delete', NULL, tag FROM tag_events WHERE is_del AND event_id % 2 = 1"""))
def t1_delete_events(t: Tables) -> DataFrame:
    e = t.tag_events().where("is_del").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("digest")).otherwise(F.col("tag")).alias("reference"))
    return E.delete_events(e).select("event_id", "seq", "kind", "digest", "tag")


@query("SELECT o_custkey, arg_min(o_orderkey, o_orderkey) FILTER (o_orderstatus = 'F') AS first_error, count(*) FILTER (o_orderstatus = 'F') AS failures FROM orders GROUP BY o_custkey")
def a13_first_failure(t: Tables) -> DataFrame:
    o = t.orders.select("o_custkey", F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).alias("error"))
    return E.first_error(o, ["o_custkey"])


@query(f"SELECT event_id, {NOW_MS} - ms <= 3600000 * 24 AS valid FROM ({with_sql('tag_events', 'SELECT * FROM tag_events')})")
def t8_cache_validity(t: Tables) -> DataFrame:
    return t.tag_events().select("event_id", (F.lit(NOW_MS) - F.col("ms") <= 86_400_000).alias("valid"))


@query(with_sql("tag_events", """SELECT event_id, (event_id % 4 <> 3)::INT + (event_id % 3 > 0)::INT AS delivered, (event_id % 4 = 3)::INT + (event_id % 3 = 0)::INT AS gave_up, CASE WHEN event_id % 4 = 3 THEN 'audit' END AS failed_endpoint,
CASE WHEN event_id % 4 = 3 THEN 'try 2' END AS first_error FROM tag_events"""))
def t2_delivery_outcomes(t: Tables) -> DataFrame:
    """Two endpoints get every event; the required one answers at the third attempt, or never, the other now and then not at all."""
    tries = t.tag_events().select("event_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("attempt"))
    said = F.concat(F.lit("try "), F.col("attempt").cast("string"))
    audit = tries.select("event_id", "attempt", F.lit("audit").alias("endpoint"), F.lit("required").alias("policy"), F.when((F.col("attempt") < 2) | (F.col("event_id") % 4 == 3), said).alias("error"))
    alerts = tries.select("event_id", "attempt", F.lit("alerts").alias("endpoint"), F.lit("optional").alias("policy"), F.when(F.col("event_id") % 3 == 0, said).alias("error"))
    return E.delivery_outcomes(audit.unionByName(alerts))


@query("""SELECT p_partkey, p_partkey % 7 = 3 AS remainder, CASE WHEN p_size > 25 THEN p_brand ELSE p_type END = 'ECONOMY' AS chosen, p_partkey % 3 > 0 AS has_key, CASE WHEN p_size % 5 = 0 THEN 'indeterminate' WHEN 100 % (p_size % 5) = 0 THEN 'matched' ELSE 'no_match' END AS guarded FROM part""")
def f4_rule_language(t: Tables) -> DataFrame:
    """Remainders, conditionals inside brackets, and keys of maps, in rules."""
    claims = F.when(F.col("p_partkey") % 3 > 0, F.create_map(F.lit("brand"), "p_brand"))
    scope = R.Scope(nullable={"part.key": F.col("p_partkey"), "part.size": F.col("p_size").cast("bigint"), "part.brand": F.col("p_brand"), "part.type": F.col("p_type")}, maps={"part.claims": claims}, kinds={"part.key": "int", "part.size": "int"})
    rules = {"remainder": "part.key % 7 == 3", "chosen": "(part.size > 25 ? part.brand : part.type) == 'ECONOMY'", "has_key": "'brand' in part.claims"}
    return t.part.select("p_partkey", *(R.compile_rule(r, scope).value.alias(n) for n, r in rules.items()), R.evaluate(["100 % (part.size % 5) == 0"], scope)["outcome"].alias("guarded"))


_RULES = {"image.tag == 'v1'": "compiles", "": "refused", "   ": "refused", "image.tag ==": "refused", "image.nothing == 1": "refused", "top_pushed(3) || image.tag in ['a']": "compiles", "what()": "refused", "(true ? 1 : 2) == 1": "compiles"}


@query("SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(rule.replace("'", "''"), status) for rule, status in _RULES.items()) + ") t(rule, status)")
def p1_rule_compilation(t: Tables) -> DataFrame:
    """Which rules compile; what is blank, unreadable or unknown is refused before anything runs."""

    def status(rule: str) -> str:
        try:
            R.compile_rule(rule, P.image_scope(0))
        except R.RuleError:
            return "refused"
        return "compiles"

    return t.spark.createDataFrame([(rule, status(rule)) for rule in _RULES], "rule string, status string")


@query("SELECT * FROM (VALUES ('top_pulled(1)', true, 'accepted'), ('top_pulled(1)', false, 'refused'), ('image.last_pulled_at > 5', false, 'refused'), ('top_pushed(1)', false, 'accepted')) t(rule, recorded, status)")
def p18_pull_times_recorded(t: Tables) -> DataFrame:
    """Rules over pull times need them recorded."""

    def status(rule: str, recorded: bool) -> str:
        try:
            P.check_pull_times([rule], recorded)
        except R.RuleError:
            return "refused"
        return "accepted"

    asked = [("top_pulled(1)", True), ("top_pulled(1)", False), ("image.last_pulled_at > 5", False), ("top_pushed(1)", False)]
    return t.spark.createDataFrame([(rule, recorded, status(rule, recorded)) for rule, recorded in asked], "rule string, recorded boolean, status string")
