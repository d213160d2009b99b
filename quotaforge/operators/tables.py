"""Joins, guards, splits, deduplication and run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotaforge.functions.expr import collapsed, seeded
from quotaforge.operators.order import cut, first_of_groups, rank_in_groups, running_sum

#: Names of hidden fields that a selector must not see.
HIDDEN_FIELDS = (
    "label", "groundtruth", "ground_truth", "gold_label", "oracle_label", "oracle_preference", "hidden_label", "true_label",
    "preferred_response", "preference_strength", "human_preference", "teacher_label", "parsed_answer", "answer",
    "chosen", "rejected", "preference_label", "preference_magnitude", "preference_statement", "preference_elaboration", "justification",
    "true_class", "true_label_name", "label_name", "prediction_correct", "is_correct", "test_metric",
)


def hidden_columns(frame: DataFrame) -> list[str]:
    """Hidden fields in the schema, those nested in structs, arrays and maps too; no job is run.

    The keys of a map are data: `hidden_keys` tells whether any is a hidden name.
    """
    found: list[str] = []

    def walk(kind, path):
        for f in getattr(kind, "fields", ()):
            if f.name.lower() in HIDDEN_FIELDS:
                found.append(".".join([*path, f.name]))
            walk(f.dataType, [*path, f.name])
        for part in ("elementType", "keyType", "valueType"):
            if hasattr(kind, part):
                walk(getattr(kind, part), path)

    walk(frame.schema, [])
    return found


def hidden_keys(frame: DataFrame) -> list[str]:
    """Map columns with a key that is a hidden name; one scan, where there are maps with string keys."""
    maps = [f.name for f in frame.schema if f.dataType.typeName() == "map" and f.dataType.keyType.typeName() == "string"]
    if not maps:
        return []
    bad = lambda c: F.bool_or(F.coalesce(F.exists(F.map_keys(F.col(f"`{c}`")), lambda k: F.lower(k).isin(*HIDDEN_FIELDS)), F.lit(False)))
    row = frame.agg(*[bad(c).alias(f"m{k}") for k, c in enumerate(maps)]).first()
    return [c for k, c in enumerate(maps) if row[f"m{k}"]]


def _without_hidden(column, kind):
    """`column` without hidden fields in any struct, array or map of it."""
    name = kind.typeName()
    if name == "struct" and kind.fields:
        kept = [f for f in kind.fields if f.name.lower() not in HIDDEN_FIELDS]
        made = F.struct(*[_without_hidden(column.getField(f.name), f.dataType).alias(f.name) for f in kept]) if kept else F.lit(None).cast("void")
        return F.when(column.isNotNull(), made)
    if name == "array":
        return F.transform(column, lambda x: _without_hidden(x, kind.elementType))
    if name == "map":
        kept = F.map_filter(column, lambda k, v: ~F.lower(k.cast("string")).isin(*HIDDEN_FIELDS)) if kind.keyType.typeName() == "string" else column
        return F.transform_values(kept, lambda k, v: _without_hidden(v, kind.valueType))
    return column


def safe_view(frame: DataFrame) -> DataFrame:
    """`frame` without hidden fields: columns, nested fields and map entries."""
    nested = ("struct", "array", "map")
    return frame.select(*[
        (_without_hidden(F.col(f"`{f.name}`"), f.dataType) if f.dataType.typeName() in nested else F.col(f"`{f.name}`")).alias(f.name)
        for f in frame.schema if f.name.lower() not in HIDDEN_FIELDS
    ])


def assert_safe(frame: DataFrame) -> DataFrame:
    if bad := hidden_columns(frame) or hidden_keys(frame):
        raise ValueError(f"a selector must not see {', '.join(bad)}")
    return frame


def cover_issues(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, issue) for ids that repeat or that only one side has: empty where a join covers exactly."""
    counts = left.select(F.col(key).alias("key"), F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select(F.col(key), F.lit(0), F.lit(1))).groupBy("key").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    issue = F.when(F.col("l") == 0, "extra").when(F.col("r") == 0, "missing").when((F.col("l") > 1) | (F.col("r") > 1), "duplicate")
    return counts.select("key", issue.alias("issue")).filter("issue is not null")


def exact_cover_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Equi-join whose sides must hold the same ids once each; columns of `right` win over those of `left`."""
    bad = cover_issues(left, right, key).limit(5).collect()
    if bad:
        raise ValueError(f"ids do not match: {[tuple(b) for b in bad]}")
    return left.drop(*[c for c in right.columns if c != key and c in left.columns]).join(right, key)


def reveal(pool: DataFrame, oracle: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Pool rows of the chosen ids with their hidden columns."""
    return pool.join(chosen.select(key), key, "left_semi").join(oracle, key)


def unrevealed(pool: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    return pool.join(chosen.select(key), key, "left_anti")


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that a resumed job has still to score."""
    return rows.join(done.select(key), key, "left_anti")


def restore_order(scored: DataFrame, source: DataFrame, key: str, position: str) -> DataFrame:
    """`scored` in the order of `source`, by its column `position`; ids must match exactly, once each."""
    return exact_cover_join(scored.drop(position), source.select(key, position), key).orderBy(position).drop(position)


def distinct_documents(rows: DataFrame, text: str, id_: str, label: str | None = None) -> DataFrame:
    """Least id of each white-space-normalised text by its SHA-256, its copies, and whether labels of copies disagree."""
    h = F.sha2(collapsed(F.col(text)), 256)
    marks = [F.min(id_).alias(id_), F.count(F.lit(1)).alias("copies")]
    if label:
        marks.append((F.min(label) != F.max(label)).alias("conflict"))
    return rows.groupBy(h.alias("document_sha256")).agg(*marks)


def allocation(counts: DataFrame, size: int) -> DataFrame:
    """Largest-remainder shares of `size` over (label, n): quotas are proportional, remainders go by size, then label."""
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    exact = counts.withColumn("_x", F.col("n") * F.lit(float(size)) / F.sum("n").over(every)).withColumn("_f", F.floor("_x"))
    left = F.lit(size) - F.sum("_f").over(every)
    place = F.row_number().over(Window.orderBy(F.desc(F.col("_x") - F.col("_f")), "label"))
    return exact.select("label", "n", (F.col("_f") + F.when(place <= left, 1).otherwise(0)).cast("long").alias("quota"))


def stratified_split(rows: DataFrame, id_: str, label: str, sizes: dict[str, int], seed: int) -> DataFrame:
    """Disjoint splits of given sizes, each with the pool's label mix; ids are dealt in the order of a seeded hash.

    Ranks come from one order over (label, hash), so a large label is spread over tasks.
    """
    counts = rows.groupBy(F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total, quotas = 0, None
    for name, size in sizes.items():
        total += size
        own = allocation(counts, total).select("label", F.col("quota").alias(name))
        quotas = own if quotas is None else quotas.join(own, "label")
    named = rows.select(F.col(id_), F.col(label).cast("string").alias("label"))
    placed = rank_in_groups(named, "label", [seeded(seed, F.col(id_)), F.col(id_).cast("string")], "_place").join(quotas, "label")
    split = F.coalesce(*[F.when(F.col("_place") <= F.col(name), F.lit(name)) for name in sizes])
    return placed.select(id_, "label", split.alias("split")).filter("split is not null")


def three_way_split(rows: DataFrame, keys: list[str], label: str, train: float, validation: float, seed: int, stratified: bool = True) -> DataFrame:
    """`rows` with `split` (train, validation, test); rows that repeat the `keys` stay together, so quotas hold within one such group.

    The quotas are rounded shares of the rows (of each label, if `stratified`): at least one
    row for train, and for validation where its share is not 0 and rows are left; test keeps
    one if it can. Groups come in the order of a seeded hash; train takes them until it has its
    quota, then validation. Nulls in keys count as empty; a null label is a label of its own.
    Groups whose rows differ in label are an error; a column `split` is replaced. Only keys' hashes, labels and sizes are ordered.
    """
    if not 0 < train < 1 or not 0 <= validation < 1 - train:
        raise ValueError("train must be above 0, validation not below, and both together below 1")
    whole = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys]
    key = F.sha2(F.concat(*[x for c in whole for x in (F.length(c).cast("string"), F.lit(":"), c)]), 256)
    own = F.struct(F.col(label).isNull(), F.col(label).cast("string"))
    named = rows.drop("split").select(F.struct("*").alias("_row"), key.alias("_key"), own.alias("_own"))
    groups = cut(named.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min("_own").alias("_label"), (F.min("_own") != F.max("_own")).alias("_mixed")))
    if mixed := groups.filter("_mixed").count():
        raise ValueError(f"{mixed} groups of equal keys have more than one label")
    part = F.to_json("_label") if stratified else F.lit("")
    ordered = running_sum(groups.select("_key", "_n", part.alias("_stratum")), [F.col("_stratum"), seeded(seed, F.col("_key")), F.col("_key")], "_n", "_at")
    total = F.col("_total")
    first = F.greatest(F.lit(1), F.bround(total * F.lit(train), 0).cast("long"))
    second = F.bround(total * F.lit(validation), 0).cast("long")
    if validation > 0:
        second = F.when(total > F.col("_train"), F.greatest(F.lit(1), second)).otherwise(second)
    quotas = ordered.groupBy(F.col("_stratum").alias("_s")).agg(F.sum("_n").alias("_total"), F.min("_at").alias("_zero")).withColumn("_train", first).withColumn("_second", second)
    quotas = quotas.withColumn("_second", F.when(F.col("_train") + F.col("_second") >= total, F.greatest(F.lit(0), total - F.col("_train") - 1)).otherwise(F.col("_second")))
    placed = ordered.join(quotas, F.col("_stratum") == F.col("_s")).withColumn("_at", F.col("_at") - F.col("_zero"))
    ends = placed.filter(F.col("_at") < F.col("_train")).groupBy(F.col("_s").alias("_t")).agg(F.max(F.col("_at") + F.col("_n")).alias("_end"))  # a row a label
    split = F.when(F.col("_at") < F.col("_train"), "train").when(F.col("_at") - F.col("_end") < F.col("_second"), "validation").otherwise("test")
    return named.join(placed.join(ends, F.col("_s") == F.col("_t")).select(F.col("_key").alias("_k"), split.alias("split")), F.col("_key") == F.col("_k")).select("_row.*", "split")


def reservoir(rows: DataFrame, id_: str, label: str, per_class: int, seed: int) -> DataFrame:
    """`per_class` seeded rows of each label: the ones of least hash; large labels are cut into parts first."""
    return first_of_groups(rows, label, [seeded(seed, F.col(id_)), F.col(id_).cast("string")], per_class, id_).drop("_place")


def overlapping_ids(splits: DataFrame, id_: str) -> DataFrame:
    """Ids in two splits or more."""
    return splits.groupBy(id_).agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")


def run_matrix(datasets: DataFrame, models: list[str], budgets: list[int], seeds: list[int], methods: list[str]) -> DataFrame:
    """Every planned run with its key: the product of a few short lists."""
    lists = (("model", models), ("budget", budgets), ("seed", seeds), ("method", methods))
    out = datasets.select("dataset")
    for name, values in lists:
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    slugs = [F.regexp_replace(F.replace(F.lower(F.col(c).cast("string")), F.lit("."), F.lit("_")), "[^a-z0-9-]", "_") for c in ("dataset", "model", "budget", "seed", "method")]
    return out.withColumn("run_id", F.concat_ws("__", *slugs))


def run_issues(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(run_id, issue): planned runs that are missing, unplanned ones, repeated ones and failed ones."""
    seen = observed.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != "completed").alias("bad"))
    both = expected.select("run_id", F.lit(True).alias("planned")).join(seen, "run_id", "full")
    issue = F.when(F.col("n").isNull(), "missing").when(F.col("planned").isNull(), "unexpected").when(F.col("n") > 1, "duplicate").when(F.col("bad") > 0, "failed")
    return both.select("run_id", issue.alias("issue")).filter("issue is not null")


def teacher_labels(rows: DataFrame, teacher: DataFrame, key: str, fallback: str) -> DataFrame:
    """Teacher label where there is one, else the row's own, with its provenance."""
    named = teacher.select(F.col(key).alias("_k"), F.col("label").alias("_t"))
    return rows.join(named, F.col(key) == F.col("_k"), "left").withColumn("train_label", F.coalesce("_t", fallback)).withColumn("label_source", F.when(F.col("_t").isNotNull(), "teacher").otherwise("own")).drop("_k", "_t")


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """total / (2 * count) of both classes."""
    counts = rows.groupBy(F.col(label).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("label", "n", (F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / (2.0 * F.greatest("n", F.lit(1)))).alias("weight"))


def layered_join(base: DataFrame, layers: list[DataFrame], key: str) -> DataFrame:
    """`base` with the columns of each layer, matched by key; a later layer's value wins where it has one. Layers hold a key once."""
    out = base
    for layer in layers:
        own = {c: f"_layer_{c}" for c in layer.columns if c != key}
        joined = out.join(layer.select(F.col(key).alias("_key"), *[F.col(c).alias(n) for c, n in own.items()]), F.col(key) == F.col("_key"), "left").drop("_key")
        for c, n in own.items():
            joined = joined.withColumn(c, F.coalesce(n, F.col(c)) if c in out.columns else F.col(n)).drop(n)
        out = joined
    return out
