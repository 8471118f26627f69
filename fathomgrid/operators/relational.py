"""Look-ups, upserts and coverage over keyed tables.

Column names are arguments, so the same operators serve any schema. Every top-n ends
its order with a unique key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomgrid.session import written


def lookup(rows: DataFrame, key: str, value: object, *, owner: DataFrame | None = None, on: tuple[str, str] | None = None, order: str | None = None) -> DataFrame:
    """The row of one key, with its owner's columns if ``owner`` is given."""
    found = rows.filter(F.col(key) == value)
    if owner is not None and on is not None:
        found = found.join(owner, F.col(on[0]) == F.col(on[1]))
    return found.orderBy(order or key).limit(1)


def current(rows: DataFrame, status: str = "extraction_status", approved: str = "approved", until: str = "valid_to") -> DataFrame:
    """Rows of the approved status whose validity is open."""
    return rows.filter((F.col(status) == approved) & F.col(until).isNull())


def with_children(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, order: str, name: str = "children") -> DataFrame:
    """Each parent with the ordered array of its children; an empty array without any."""
    fields = [F.col(c) for c in children.columns if c not in (child_key, order)]
    nested = children.groupBy(F.col(child_key).alias("_k")).agg(F.array_sort(F.collect_list(F.struct(F.col(order), *fields))).alias(name))
    out = parents.join(nested, F.col(parent_key) == F.col("_k"), "left").drop("_k")
    return out.withColumn(name, F.coalesce(F.col(name), F.array().cast(out.schema[name].dataType)))


def last_wins(rows: DataFrame, keys: Sequence[str], version: Sequence[Column]) -> DataFrame:
    """One row a key: the last by ``version``, which must order the rows of a key totally."""
    order = Window.partitionBy(*keys).orderBy(*[v.desc() for v in version])
    return rows.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], version: str, update: Sequence[str] | None = None) -> DataFrame:
    """``base`` with ``changes`` merged in by key; the last change of a key wins.

    New keys are inserted whole. Of known keys only the columns in ``update`` change, all
    but the keys by default.
    """
    newest = last_wins(changes, keys, [F.col(version)])
    columns = base.columns
    update = [c for c in (update or columns) if c not in keys]
    side = newest.select(*(F.col(c).alias(f"_n_{c}") for c in columns), F.lit(True).alias("_new"))
    same = [F.col(k) == F.col(f"_n_{k}") for k in keys]
    joined = base.withColumn("_old", F.lit(True)).join(side, same, "full_outer")
    pick = lambda c: F.when(F.col("_old").isNull() | (F.col("_new") & F.lit(c in update)), F.col(f"_n_{c}")).otherwise(F.col(c))
    return joined.select(*(pick(c).alias(c) for c in columns))


def status_of(rows: DataFrame, cache: DataFrame, key: str, status: str = "status", default: str = "unknown") -> DataFrame:
    """``rows`` with the cached status of their key, ``default`` where there is none."""
    return rows.join(cache.select(key, status), key, "left").withColumn(status, F.coalesce(F.col(status), F.lit(default)))


def first_found(rows: DataFrame, key: str, sources: Sequence[DataFrame], value: str, default: object = None) -> DataFrame:
    """The value of the first source that knows the key, and the number of that source (from 1)."""
    out = rows
    for i, source in enumerate(sources):
        out = out.join(source.select(F.col(key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}")), F.col(key) == F.col(f"_k{i}"), "left")
    values = [F.col(f"_v{i}") for i in range(len(sources))]
    number = F.coalesce(*(F.when(v.isNotNull(), F.lit(i + 1)) for i, v in enumerate(values)))
    return out.select(*rows.columns, F.coalesce(*values, F.lit(default)).alias(value), number.alias("source_rank"))


def store_new(incoming: DataFrame, stored: DataFrame, body: str, hash_col: str = "content_hash") -> DataFrame:
    """Rows whose content isn't stored yet, one a content, with the SHA-256 of the body."""
    hashed = incoming.withColumn(hash_col, F.sha2(F.col(body), 256))
    return hashed.join(stored.select(hash_col), hash_col, "left_anti").dropDuplicates([hash_col])


def freshness(observed: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Whether a source changed: by etag, else by length, else by the hash of its head; unknown counts as changed."""
    old = stored.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in ("etag", "content_length", "head_hash")))
    changed = F.coalesce(*(F.when(F.col(c).isNotNull() & F.col(f"_{c}").isNotNull(), F.col(c) != F.col(f"_{c}")) for c in ("etag", "content_length", "head_hash")), F.lit(True))
    return observed.join(old, F.col(key) == F.col("_k"), "left").select(*observed.columns, changed.alias("changed"))


def discover(sources: Sequence[DataFrame], name: str) -> DataFrame:
    """Union of name lists, case-insensitively distinct; the first source and smallest spelling win."""
    every = None
    for i, source in enumerate(sources):
        part = source.select(F.col(name), F.lit(i).alias("source"))
        every = part if every is None else every.unionByName(part)
    order = Window.partitionBy(F.lower(F.col(name))).orderBy("source", name)
    return every.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").select(name, "source")


def coverage(entities: DataFrame, facts: DataFrame, entity_key: str, fact_key: str, kind: str, active: Column | None = None, strict: bool = False) -> DataFrame:
    """For each kind of fact the share of active entities that have it, rounded to four places.

    The numerator counts all entities with the fact; ``strict`` counts active ones only.
    """
    live = entities.filter(active) if active is not None else entities
    counted = facts.join(live, F.col(fact_key) == F.col(entity_key), "left_semi") if strict else facts
    total = live.agg(F.count("*").alias("n_active"))
    per = counted.groupBy(kind).agg(F.countDistinct(fact_key).alias("n_with"))
    return per.crossJoin(F.broadcast(total)).select(kind, "n_with", "n_active", F.round(F.col("n_with") / F.nullif("n_active", F.lit(0)), 4).alias("coverage"))


def tree_paths(nodes: DataFrame, key: str, parent: str, name: str, depth: int = 32, separator: str = "/") -> DataFrame:
    """Full path and depth of every node of a forest, by levels from the roots.

    The loop ends with the deepest level, each written once; a forest deeper than
    ``depth`` is an error. Nodes on a cycle are never reached.
    """
    level = nodes.filter(F.col(parent).isNull()).select(F.col(key).alias("id"), F.col(name).cast("string").alias("full_path"), F.lit(0).alias("depth"))
    out = level
    for d in range(1, depth + 2):
        above = level.select(F.col("id").alias("_above"), F.col("full_path").alias("_path"))
        level = nodes.join(above, F.col(parent) == F.col("_above")).select(F.col(key).alias("id"), F.concat_ws(separator, "_path", F.col(name)).alias("full_path"), F.lit(d).alias("depth"))
        level = written(level)
        if level.isEmpty():
            break
        if d > depth:
            raise ValueError(f"the forest has more than {depth} levels below its roots")
        out = out.unionByName(level)
    return out


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows that refer to no parent; a null reference isn't one."""
    return child.filter(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias("_p")), F.col(child_key) == F.col("_p"), "left_anti")


def priority_merge(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``first``, and what of ``second`` has no row with the same keys there."""
    return first.unionByName(second.join(first.select(*keys).distinct(), list(keys), "left_anti"))


def component_details(components: DataFrame, owners: DataFrame, categories: DataFrame, owner: tuple[str, str], category: tuple[str, str]) -> DataFrame:
    """Components with their owner, which must be there, and their category, which may be missing; each pair names the two key columns."""
    out = components.join(owners, F.col(owner[0]) == F.col(owner[1]))
    return out.join(categories, F.col(category[0]) == F.col(category[1]), "left")


def insert_components(base: DataFrame, parameters: DataFrame, new: DataFrame, new_parameters: DataFrame, gate: DataFrame, key: str, version: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(components, parameters, queue)`` after new components: an upsert by key, their parameters appended with their status, and the ids that failed the gate queued for review.

    ``gate(key, passed)``; a component that isn't in it passed.
    """
    failed = gate.filter(~F.col("passed")).select(key).distinct()
    status = new_parameters.join(failed.withColumn("_bad", F.lit(True)), key, "left").withColumn("status", F.when(F.col("_bad"), "pending").otherwise("approved")).drop("_bad")
    queue = new.select(key).distinct().join(failed, key, "left_semi").withColumn("reason", F.lit("quality_gate"))
    return upsert(base, new, [key], version), parameters.unionByName(status), queue
