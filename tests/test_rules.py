"""Rules: outcomes, safe readings, saturation, and errors at compile time."""

import pytest
from pyspark.sql import functions as F

from tallyship.functions import rules as R
from tallyship.functions import scalars as C
from tallyship.operators.retention import check_pull_times, image_scope, verdicts

NOW = 1_000_000


def _one(spark, rules, tag="v1", pushed=NOW - 10, pulled=0, push_rank=1, pull_rank=None):
    schema = "tag string, pushed bigint, pulled bigint, pushed_rank int, pulled_rank int"
    df = spark.createDataFrame([(tag, pushed, pulled, push_rank, pull_rank)], schema)
    scope = R.retention_scope(F.col("tag"), F.col("pushed"), F.col("pulled"), F.col("pushed_rank"), F.col("pulled_rank"), NOW)
    v = df.select(R.evaluate(rules, scope).alias("v"), R.retains(rules, scope).alias("r")).first()
    return v.v.outcome, v.v["index"], v.r


@pytest.mark.parametrize(
    ("rules", "want"),
    [
        ([], ("no_match", None, True)),
        (["image.tag == 'v1'"], ("matched", 1, True)),
        (["image.tag == 'x'", "image.tag != null"], ("matched", 2, True)),
        (["image.tag == 'x'"], ("no_match", None, False)),
        (["image.tag"], ("indeterminate", 1, True)),
        (["image.pushed_at > now() - days(1)"], ("matched", 1, True)),
        (["image.pushed_at > now() - minutes(0)"], ("no_match", None, False)),
        (["image.tag.matches('^v[0-9]+$') && top_pushed(1)"], ("matched", 1, True)),
        (["top_pushed(0)", "top_pushed(-3)", "top_pulled(5)"], ("no_match", None, False)),
        (["image.tag in ['a', 'v1']"], ("matched", 1, True)),
        (["!(image.tag == 'v1') || image.pushed_at == 3"], ("no_match", None, False)),
        (["image.pushed_at > 5 ? image.tag == 'v1' : false"], ("matched", 1, True)),
        (["(image.pushed_at > 5 ? image.tag : 'none') == 'v1'"], ("matched", 1, True)),
        (["image.tag in [true ? 'v1' : 'a', 'b']"], ("matched", 1, True)),
        (["image.tag.startsWith(image.pushed_at > 5 ? 'v' : 'x')"], ("matched", 1, True)),
        (["top_pushed(image.tag == 'v1' ? (false ? 7 : 1) : 0)"], ("matched", 1, True)),
        (["image.tag == 'a ? b : c' ? true : image.tag == 'x' ? false : image.tag.matches('^v(?:1)$')"], ("matched", 1, True)),
        (["7 % 4 == 3 && -7 % 4 == -3"], ("matched", 1, True)),
        (["image.pushed_at % 0 == 1"], ("indeterminate", 1, True)),
        (["image.pushed_at / 0 == 1"], ("indeterminate", 1, True)),
        (["image.pushed_at < 'x'", "true"], ("indeterminate", 1, True)),
        (["image.tag == 3", "image.tag.startsWith('v')"], ("matched", 2, True)),
        (["false && image.pushed_at / 0 == 1", "true || image.pushed_at / 0 == 1"], ("matched", 2, True)),
        (["image.pushed_at > now() - days(9223372036854775807)"], ("matched", 1, True)),
    ],
)
def test_retention_rules(spark, rules, want):
    assert _one(spark, rules) == want


def test_untagged_is_null_and_never_ranked(spark):
    assert _one(spark, ["image.tag.matches('.')"], tag=None)[0] == "indeterminate"
    assert _one(spark, ["image.tag != null && image.tag.matches('.')", "top_pushed(9)"], tag=None, push_rank=None) == ("no_match", None, False)


@pytest.mark.parametrize("rule", ["", "  ", "image.tag ==", "image.nothing == 1", "what()", "image.tag = 'x'", "import os", "image.tag.lower('x')", "[x for x in y]", "(a ? b", "f(a ? 1)", "true ? 1", "lambda: 1", "{'a': 1}"])
def test_unreadable_rules_fail_when_compiled(rule):
    with pytest.raises(R.RuleError):
        R.compile_rule(rule, image_scope(NOW))


def test_access_modes_and_missing_keys(spark):
    df = spark.createDataFrame([("get", None, None, {"a": "x"}), ("put", "bob", "other", {})], "action string, user string, source string, claims map<string,string>")
    scope = R.access_scope({"request.action": F.col("action"), "request.from": F.col("source")}, {"identity.username": F.col("user")}, {"identity.oidc.claims": F.col("claims")}, F.lit(False))
    col = lambda rules, default: R.allows(rules, scope, default)
    got = df.select(
        col([], True).alias("a"), col([], False).alias("b"), col(["request.from == 'other'"], True).alias("c"), col(["has(request.from) && request.from == 'other'"], True).alias("d"),
        col(["identity.oidc.claims['a'] == 'x'"], False).alias("e"), col(["has_repository_policy()"], False).alias("f"), col(["has(identity.oidc.claims.a)"], False).alias("g"),
    ).collect()
    assert [tuple(r) for r in got] == [(True, False, False, True, True, False, True), (True, False, False, False, False, False, False)]


def test_clamps(spark):
    df = spark.range(1)
    r = df.select(C.days(F.lit(2**62)).alias("a"), C.hours(F.lit(-(2**62))).alias("b"), C.rule_seconds(F.lit(-5), 0).alias("c"), C.rule_seconds(F.lit(None).cast("bigint"), 9).alias("d"), C.backoff_ms(F.lit(100)).alias("e"), C.backoff_ms(F.lit(0)).alias("f")).first()
    assert tuple(r) == (2**63 - 1, -(2**63), 0, 9, 10_000, 100)


def test_unknown_times_in_verdicts(spark):
    tags = spark.createDataFrame([("n", "a", "d", None, None), ("n", "b", "d", -5000, None)], "ns string, tag string, digest string, pushed_ms bigint, pulled_ms bigint")
    got = {r.tag: r for r in verdicts(tags, ["image.pushed_at == now()"], NOW).collect()}
    assert got["a"].retain and got["a"].pushed_rank is None and not got["b"].retain and got["b"].pushed_rank == 1


def test_ranks_are_whole_where_they_are_read_and_not_planned_elsewhere(spark):
    tags = spark.createDataFrame([("n", f"t{i}", "d", i * 1000, None) for i in range(5)], "ns string, tag string, digest string, pushed_ms bigint, pulled_ms bigint")
    found = verdicts(tags, ["top_pushed(2)"], NOW)
    assert {r.tag: (r.pushed_rank, r.retain) for r in found.collect()} == {f"t{i}": (5 - i, i > 2) for i in range(5)}
    plan = found.select("tag", "retain")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "WindowGroupLimit" in plan


def test_pull_times_have_to_be_recorded():
    check_pull_times(["top_pushed(1)"], False)
    for rule in ("top_pulled(1)", "image.last_pulled_at > 0"):
        with pytest.raises(R.RuleError):
            check_pull_times([rule], False)


def test_signatures(spark):
    import hashlib
    import hmac

    got = spark.createDataFrame([("body",), (None,)], "b string").select(C.hmac_sha256("key")("b").alias("s")).collect()
    assert [r.s for r in got] == [hmac.new(b"key", b"body", hashlib.sha256).hexdigest(), None]


def test_keys_in_maps(spark):
    df = spark.createDataFrame([(1, {"a": "x", "n": None}), (2, {}), (3, None)], "id long, claims map<string,string>")
    scope = R.access_scope({}, {"request.key": F.lit("a")}, {"identity.oidc.claims": F.col("claims")}, F.lit(False))
    rules = ["'a' in identity.oidc.claims", "!('n' in identity.oidc.claims)", "request.key in identity.oidc.claims && identity.oidc.claims['a'] == 'x'"]
    got = df.select("id", *(R.evaluate([r], scope)["outcome"].alias(f"r{k}") for k, r in enumerate(rules))).collect()
    assert [tuple(r)[1:] for r in sorted(got)] == [("matched", "no_match", "matched"), ("no_match", "matched", "no_match"), ("no_match", "matched", "no_match")]
