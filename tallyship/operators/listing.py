"""Listings: keyset pages, counts and children of a prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_PAGE = 100


def page(rows: DataFrame, key: str, n: int = DEFAULT_PAGE, last: str | int | None = None) -> DataFrame:
    """The first ``n`` rows after ``last`` by key, with ``token`` on every row: the page's last key if more follow.

    ``last`` need not exist. A page of none is empty and has no token. The plan takes
    n + 1 ordered rows, so nothing but the page's rows is sorted in one place.
    """
    after = rows if last is None else rows.where(F.col(key) > F.lit(last))
    some = after.orderBy(key).limit(n + 1 if n > 0 else 0)
    counted = some.agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("_key"), F.struct(*some.columns).alias("_row")))).alias("_rows"))  # n + 1 rows at most
    more = F.size("_rows") > n
    cut = counted.select(F.slice("_rows", 1, max(n, 1)).alias("_page"), F.when(more, F.element_at("_rows", n)["_key"]).alias("token")) if n > 0 else counted.select(F.col("_rows").alias("_page"), F.lit(None).cast(rows.schema[key].dataType).alias("token"))
    return cut.select(F.explode("_page").alias("_one"), "token").select("_one._row.*", "token")


def children(objects: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """One level below a prefix: name and whether it is a directory, each once."""
    rest = F.substring(F.col(key), F.lit(len(prefix) + 1), F.length(key))
    name = F.split_part(rest, F.lit("/"), F.lit(1))
    below = objects.where(F.startswith(F.col(key), F.lit(prefix)) & (F.col(key) != prefix))
    return below.select(name.alias("name"), F.contains(rest, F.lit("/")).alias("is_dir")).distinct()


def listed(objects: DataFrame, prefix: str, n: int, after: str | None = None, token: str | None = None, key: str = "key") -> DataFrame:
    """Keys below a prefix in order, strictly after a key; a token goes before ``after``."""
    last = token if token is not None else after
    below = objects.where(F.startswith(F.col(key), F.lit(prefix)))
    return (below if last is None else below.where(F.col(key) > last)).orderBy(key).limit(n)


def counted(names: DataFrame, key: str, **tables: DataFrame) -> DataFrame:
    """Names with the number of rows that each table has for them, 0 included; tables are aggregated before they are joined."""
    out = names
    for name, table in tables.items():
        out = out.join(table.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").fillna(0, [name])
    return out


def capped(n: Column, most: int = 10_000) -> Column:
    """A count that stops at ``most``."""
    return F.least(n, F.lit(most))


def referrers_page(candidates: DataFrame, n: int, artifact_type: str | None, last: str | None = None) -> DataFrame:
    """A page of referrers, cut before the filter by artifact type, so that it may be short."""
    cut = page(candidates, "digest", n, last)
    return cut if artifact_type is None else cut.where(F.col("artifact_type") == artifact_type)


def known_empty(tags: DataFrame, revisions: DataFrame, names: DataFrame, key: str = "ns") -> DataFrame:
    """Namespaces with ``known``: whether they have a tag or at least a revision; without either they count as unknown, not as empty."""
    t = tags.select(key).distinct().withColumn("_t", F.lit(True))
    r = revisions.select(key).distinct().withColumn("_r", F.lit(True))
    return names.join(t, key, "left").join(r, key, "left").select(key, (F.col("_t").isNotNull() | F.col("_r").isNotNull()).alias("known"))


def display_order(roots: DataFrame) -> DataFrame:
    """Roots with ``position``: tagged ones first by their first tag, then the others by digest; the order is that of bytes."""
    first = F.array_min("tags")
    order = Window.partitionBy("ns").orderBy(F.when(first.isNull(), 1).otherwise(0), first, "digest")
    return roots.withColumn("position", F.row_number().over(order))


def followed_pages(pages: DataFrame, most: int = 10_000) -> DataFrame:
    """Pages (listing, location, next, first) in the order in which their links lead from the first on: listing, location, position.

    A link to a page that has been seen ends a listing with what there is; so does one
    to no page. Paths are doubled in each round, so ``most`` pages take log2(most) of
    them; a listing that leads on and on has ``most`` at least and is cut there.
    """
    step = pages.where("next IS NOT NULL").select("listing", "location", F.col("next").alias("to"))
    seen = pages.where("first").select("listing", "location", F.lit(0).cast("bigint").alias("position"))
    reach, rows = 1, -1
    while reach < 2 * most:
        ahead = seen.join(step, ["listing", "location"]).select("listing", F.col("to").alias("location"), (F.col("position") + reach).alias("position"))
        seen = seen.unionByName(ahead).groupBy("listing", "location").agg(F.min("position").alias("position")).checkpoint()
        if (now := seen.count()) == rows:
            break
        twice = step.select("listing", F.col("to").alias("location"), F.col("location").alias("_from"))
        step = twice.join(step, ["listing", "location"]).select("listing", F.col("_from").alias("location"), "to").checkpoint()
        reach, rows = 2 * reach, now
    return seen.join(pages.select("listing", "location"), ["listing", "location"], "left_semi").where(F.col("position") < most)


def remote_items(pages: DataFrame, valid: Column, most: int = 10_000) -> DataFrame:
    """The items of followed pages (which have ``items``), page after page and not deduplicated; those that are not ``valid`` (a test of the column item) are dropped."""
    order = followed_pages(pages, most)
    return order.join(pages.select("listing", "location", F.posexplode("items").alias("place", "item")), ["listing", "location"]).where(valid).select("listing", "position", "place", "item")
