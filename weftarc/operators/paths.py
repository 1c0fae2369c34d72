"""Collision-free archive paths of resources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftarc.functions.names import directory, nfc, query_hash, with_leaf_name, with_suffix
from weftarc.functions.tables import written
from weftarc.functions.urls import with_url

FIRST_DIGITS, MORE_DIGITS, ALL_DIGITS = 12, 4, 64


def path_mappings(resources: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """``scope`` columns, url, resource_type, n_aliases, directory, base_name, query_hash, collision_hash, file_name, path.

    ``resources`` has url and resource_type (and the scope, within which paths differ; none: one archive). URLs are
    brought to their normal form, and those with equal type and URL are one resource; what is not a public-form
    network URL without credentials is left out. Every member of a group whose paths agree in normal form C and
    small letters gets digits of the hash of its type and URL, more in each round until no two agree.
    """
    scope = scope or []
    known = with_url(resources.select(*scope, F.col("url").alias("given"), "resource_type"), "given", "u").filter(F.col("u.scheme").isin("http", "https") & (F.col("u.userinfo") == ""))
    once = known.groupBy(*scope, F.col("u.href").alias("url"), "resource_type").agg(F.countDistinct("given").alias("n_aliases"), F.first("u").alias("u"))
    named = with_leaf_name(once.withColumn("directory", directory(F.col("u"), F.col("resource_type"))).withColumn("query_hash", query_hash(F.col("u"))), "u", "resource_type", "base_name")
    queried = F.when(F.col("query_hash").isNull(), F.col("base_name")).otherwise(with_suffix(F.col("base_name"), F.concat(F.lit("q-"), F.col("query_hash"))))
    identity = F.sha2(F.concat(F.col("resource_type"), F.lit("\0"), F.col("url")), 256)
    # written before names are made of names, else Spark would put the whole expression of one into the other, many times over
    named = written(named.drop("u"), "path-names").withColumn("queried", queried).withColumn("identity", identity)
    named = written(named, "path-queried").withColumn("key", _key(F.col("queried")))
    named = written(named, "path-keys")
    renamed = _renamed(named, scope)
    if renamed is None:
        renamed = named.limit(0).select(*scope, "identity", F.lit(0).alias("digits"), F.col("queried").alias("file_name"))
    new = renamed.select(*[F.col(c).alias(f"of_{c}") for c in (*scope, "identity")], "digits", F.col("file_name").alias("new_name"))
    rows = named.join(new, _same(scope, "identity"), "left").withColumn("file_name", F.coalesce("new_name", "queried"))
    collision = F.expr("substring(identity, 1, digits)")
    return rows.select(*scope, "url", "resource_type", "n_aliases", "directory", "base_name", "query_hash", collision.alias("collision_hash"), "file_name", F.concat_ws("/", "directory", "file_name").alias("path"))


def _key(file_name: Column) -> Column:
    """What must be the only one in an archive."""
    return F.lower(nfc(F.concat_ws("/", F.col("directory"), file_name)))


def _same(scope: list[str], name: str) -> Column:
    """A row against the columns of the same names that begin with of_."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*scope, name)])


def _renamed(named: DataFrame, scope: list[str]) -> DataFrame | None:
    """identity, digits, file_name of the rows that have no name of their own yet; None if all have.

    A round takes only the rows whose names are new, and those that these names meet: rows that never collided stay where they are and are
    read, not written again.
    """
    kept = (*scope, "identity", "directory", "queried", "digits", "file_name", "key")
    pool = named.withColumn("digits", F.lit(0)).withColumn("file_name", F.col("queried"))
    deltas: list[DataFrame] = []
    while True:
        twice = pool.groupBy(*scope, "key").count().filter("count > 1").select(*[F.col(c).alias(f"of_{c}") for c in (*scope, "key")])
        clash = pool.join(twice, _same(scope, "key")).select(*kept)
        clash = clash.withColumn("digits", F.when(F.col("digits") == 0, FIRST_DIGITS).otherwise(F.col("digits") + MORE_DIGITS))
        clash = clash.withColumn("file_name", with_suffix(F.col("queried"), F.concat(F.lit("c-"), F.expr("substring(identity, 1, digits)"))))
        delta = written(clash.withColumn("key", _key(F.col("file_name"))), "path-round")
        if delta.isEmpty():
            return _latest(deltas, scope) if deltas else None
        if delta.filter(F.col("digits") > ALL_DIGITS).first():
            raise ValueError("two resources have the same hash")
        deltas.append(delta)
        latest = _latest(deltas, scope)
        met = delta.select(*[F.col(c).alias(f"of_{c}") for c in (*scope, "key")]).distinct()
        moved = latest.select(*[F.col(c).alias(f"of_{c}") for c in (*scope, "identity")])
        first = named.withColumn("digits", F.lit(0)).withColumn("file_name", F.col("queried")).join(met, _same(scope, "key"), "left_semi").join(moved, _same(scope, "identity"), "left_anti")
        pool = first.select(*kept).unionByName(latest.join(met, _same(scope, "key"), "left_semi").select(*kept))


def _latest(deltas: list[DataFrame], scope: list[str]) -> DataFrame:
    """Of rows that were renamed several times the last names."""
    every = reduce(DataFrame.unionByName, deltas)
    of = [c for c in every.columns if c not in (*scope, "identity")]
    return every.groupBy(*scope, "identity").agg(F.max_by(F.struct(*of), "digits").alias("row")).select(*scope, "identity", "row.*")
