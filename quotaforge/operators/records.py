"""Records of acquisitions and runs: labels held back, staged execution, gates, claims, preflight checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def acquisition_records(rows: DataFrame, id_: str, score: str, selected: str, label: str, run: dict[str, str | int]) -> DataFrame:
    """One record per row; the label stays null where the row was not selected."""
    marks = [F.lit(v).alias(k) for k, v in run.items()]
    return rows.select(F.col(id_).cast("string").alias("sample_id"), *marks, F.col(score).alias("score"), F.col(selected).alias("selected"), F.when(F.col(selected), F.col(label)).alias("revealed_label"))


def leaked(records: DataFrame) -> DataFrame:
    """Records that show the label of a row that was not selected."""
    return records.filter(~F.coalesce("selected", F.lit(False)) & F.col("revealed_label").isNotNull()).select("sample_id")


def execution_manifest(runs: DataFrame, stages: list[tuple[str, list[str], list[str]]]) -> DataFrame:
    """(run_id, position, stage, inputs, outputs): the stages of each run; `{run}` in a path stands for its id."""
    paths = lambda names: F.array(*[F.replace(F.lit(p), F.lit("{run}"), F.col("run_id")) for p in names]).cast("array<string>")
    rows = [F.struct(F.lit(k).alias("position"), F.lit(name).alias("stage"), paths(i).alias("inputs"), paths(o).alias("outputs")) for k, (name, i, o) in enumerate(stages)]
    return runs.select("run_id", F.inline(F.array(*rows)))


def stage_status(manifest: DataFrame, existing: DataFrame) -> DataFrame:
    """Status of each stage by the paths that exist: complete, partial, ready (all stages before it complete) or blocked."""
    out = manifest.select("run_id", "position", "stage", F.explode_outer("outputs").alias("path"))
    there = existing.select(F.col("path").alias("_p")).distinct()
    counts = out.join(there, F.col("path") == F.col("_p"), "left").groupBy("run_id", "position", "stage").agg(F.count("path").alias("needed"), F.count("_p").alias("present"))
    done = F.col("present") == F.col("needed")
    before = F.coalesce(F.min(done).over(Window.partitionBy("run_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    status = F.when(done & before, "complete").when(F.col("present") > 0, "partial").when(before, "ready").otherwise("blocked")
    return counts.select("run_id", "position", "stage", "needed", "present", status.alias("status"))


def run_status(stages: DataFrame) -> DataFrame:
    """Per run: complete, in_progress or not_started, and the first stage that is not complete."""
    open_ = F.col("status") != "complete"
    kinds = stages.groupBy("run_id").agg(F.count_if(open_).alias("open"), F.count_if(F.col("present") > 0).alias("begun"), F.min_by("stage", F.when(open_, F.col("position"))).alias("next_stage"))
    status = F.when(F.col("open") == 0, "complete").when(F.col("begun") > 0, "in_progress").otherwise("not_started")
    return kinds.select("run_id", status.alias("status"), F.when(F.col("open") > 0, F.col("next_stage")).alias("next_stage"))


def gate_readiness(gates: DataFrame, evidence: DataFrame) -> DataFrame:
    """Of (gate, required array) and (evidence): what each gate lacks, and whether it is ready."""
    need = gates.select("gate", F.explode_outer("required").alias("name"))
    have = evidence.select(F.col("evidence").alias("_e")).distinct()
    lacking = F.when(F.col("name").isNotNull() & F.col("_e").isNull(), F.col("name"))
    found = need.join(have, F.col("name") == F.col("_e"), "left").groupBy("gate").agg(F.array_sort(F.collect_set(lacking)).alias("missing"))
    return found.select("gate", F.array_join("missing", ",").alias("missing"), (F.size("missing") == 0).alias("ready"))


def claim_issues(claims: DataFrame, evidence: DataFrame, minimum_seeds: int) -> DataFrame:
    """(claim_id, evidence_id, issue): claims without evidence, with unknown evidence, of another kind, or of too few seeds."""
    each = claims.select("claim_id", "kind", F.explode_outer("evidence_ids").alias("evidence_id"))
    known = evidence.select(F.col("evidence_id").alias("_e"), F.col("kind").alias("_kind"), "n_seeds")
    issue = (
        F.when(F.col("evidence_id").isNull(), "no_evidence").when(F.col("_e").isNull(), "unknown_evidence")
        .when(F.col("kind") != F.col("_kind"), "other_kind").when(F.col("n_seeds") < minimum_seeds, "too_few_seeds")
    )
    return each.join(known, F.col("evidence_id") == F.col("_e"), "left").select("claim_id", "evidence_id", issue.alias("issue")).filter("issue is not null")


def preflight(pool: DataFrame, oracle: DataFrame, seeds: DataFrame, heldout: DataFrame, key: str) -> DataFrame:
    """(issue, key): pool rows without a hidden label, labels without a row, and rows of two of pool, seeds and held-out."""
    ids = lambda frame: frame.select(F.col(key).alias("key"))
    parts = {"pool_without_label": ids(pool).join(ids(oracle), "key", "left_anti"), "seed_in_pool": ids(seeds).join(ids(pool), "key", "left_semi"),
             "heldout_in_pool": ids(heldout).join(ids(pool), "key", "left_semi"), "seed_in_heldout": ids(seeds).join(ids(heldout), "key", "left_semi")}
    out = None
    for name, part in parts.items():
        part = part.distinct().select(F.lit(name).alias("issue"), F.col("key").cast("string").alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


def budget_report(runs: DataFrame, supervision: list[str], evaluation: list[str], tokens: str, tolerance: float) -> DataFrame:
    """Per run: all supervision and all evaluation labels, and whether all runs share one supervision total and near-equal training tokens."""
    total: Column = sum((F.col(c) for c in supervision), F.lit(0))
    other: Column = sum((F.col(c) for c in evaluation), F.lit(0))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = runs.select("run_id", total.cast("long").alias("supervision"), other.cast("long").alias("evaluation"), F.col(tokens).cast("long").alias("train_tokens"))
    spread = F.coalesce(F.try_divide((F.max("train_tokens").over(whole) - F.min("train_tokens").over(whole)).cast("double"), F.max("train_tokens").over(whole)), F.lit(0.0))
    return sums.withColumn("equal_supervision", F.min("supervision").over(whole) == F.max("supervision").over(whole)).withColumn("tokens_within", spread <= tolerance)
