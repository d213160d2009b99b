"""Further registered queries: calibration, coverage, intervals, evaluation, guards, gates, decisions and selector entries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quotaforge.functions import expr as E
from quotaforge.operators import audit, baselines, batches, choose, evaluate, influence, preference, records, sampling, selectors, soft, tables
from quotaforge.plans.registry import CLASS_SQL, ORACLE_SQL, PAIR_SQL, RUNS, _rounded, _t, class_pool, preference_pairs, query, run_rows
from quotaforge.sources import jsonl, vectors
from quotaforge.streaming import shares

# --- memberships -----------------------------------------------------------------------


def memberships(spark, d):
    """Predicted (softmax) and observed (one-hot) class memberships of the embeddings."""
    pool = class_pool(spark, d)
    labels = [r["label"] for r in pool.select("label").filter("label is not null").distinct().orderBy("label").collect()]  # a row a class
    names = F.array(*[F.lit(str(x)) for x in labels])
    predicted = pool.select("id", F.explode(F.map_from_arrays(names, "p")).alias("group", "membership"))
    observed = pool.filter("label is not null").select("id", F.col("label").cast("string").alias("group"), F.lit(1.0).alias("membership"))
    return predicted, observed


MEMBERS = f"{CLASS_SQL}, pred AS (SELECT id, own::VARCHAR AS g, p FROM prob), obs AS (SELECT id, label::VARCHAR AS g, 1.0 AS o FROM rows_ WHERE label IS NOT NULL)"


@query(
    "membership_calibration",
    f"""WITH {MEMBERS}, b AS (SELECT coalesce(pred.g, obs.g) AS g, coalesce(p, 0) AS p, coalesce(o, 0) AS o FROM pred FULL JOIN obs ON pred.id = obs.id AND pred.g = obs.g)
SELECT g AS "group", round(avg(p), 6) AS predicted, round(avg(o), 6) AS observed, round(avg(p - o), 6) + 0.0 AS error, round(avg((p - o) * (p - o)), 6) AS brier FROM b GROUP BY g""",
)
def membership_calibration(spark, d):
    return _rounded(evaluate.membership_calibration(*memberships(spark, d)))


DRAWS = "draws AS (SELECT o_orderpriority AS id, o_orderstatus AS g, o_totalprice / 1000000 AS m FROM orders)"


def price_draws(spark, d):
    return _t(spark, d, "orders").select(F.col("o_orderpriority").alias("id"), F.col("o_orderkey").alias("draw"), F.col("o_orderstatus").alias("group"), (F.col("o_totalprice") / 1000000).alias("membership"))


@query(
    "ensemble_intervals",
    f"""WITH {DRAWS} SELECT id, g AS "group", round(avg(m), 6) AS mean, round(quantile_cont(m, 0.05), 6) AS lower, round(quantile_cont(m, 0.95), 6) AS upper FROM draws GROUP BY ALL""",
)
def ensemble_intervals(spark, d):
    return _rounded(evaluate.ensemble_intervals(price_draws(spark, d), 0.9))


@query(
    "interval_coverage",
    f"""WITH {DRAWS}, i AS (SELECT id, g, quantile_cont(m, 0.25) AS lower, quantile_cont(m, 0.75) AS upper FROM draws GROUP BY ALL)
SELECT g AS "group", round(avg((m >= lower - 1e-12 AND m <= upper + 1e-12)::INT), 6) AS coverage, count(*) AS n FROM draws JOIN i USING (id, g) GROUP BY ROLLUP (g)""",
)
def interval_coverage(spark, d):
    draws = price_draws(spark, d)
    return _rounded(evaluate.interval_coverage(evaluate.ensemble_intervals(draws, 0.5), draws))


# --- evaluation ------------------------------------------------------------------------


@query(
    "preference_metrics",
    f"""WITH {PAIR_SQL}, g AS (SELECT bin, avg((words_a > words_b)::INT) AS a, count(*) AS n, avg((words_b > words_a)::INT) AS w FROM binned GROUP BY bin)
SELECT round(sum(a * n) / sum(n), 6) AS accuracy, round(min(a), 6) AS worst_group_accuracy, sum(n)::BIGINT AS n, round(sum(w * n) / sum(n), 6) AS raw_win_rate, round(avg(w), 6) AS length_controlled_win_rate,
 (SELECT round(avg(words_a - words_b), 6) FROM binned) AS capability_regression FROM g""",
)
def preference_metrics(spark, d):
    rows = preference_pairs(spark, d).withColumn("label", F.lit(True)).withColumn("said", F.col("words_a") > F.col("words_b")).withColumn("win", (F.col("words_b") > F.col("words_a")).cast("double"))
    return _rounded(evaluate.preference_metrics(rows, "label", "said", "bin", "win", "bin", "words_a", "words_b"))


@query("capability_regression", f"WITH {PAIR_SQL} SELECT round(avg(words_a - words_b), 6) AS capability_regression, count(*) AS n FROM pairs")
def capability_regression(spark, d):
    return _rounded(evaluate.capability_regression(preference_pairs(spark, d), "words_a", "words_b"))


@query(
    "metric_deltas",
    """WITH m AS (SELECT o_orderpriority AS model, avg(o_totalprice) AS price, count(*)::DOUBLE AS n FROM orders GROUP BY 1),
l AS (SELECT model, 'price' AS metric, price AS value FROM m UNION ALL SELECT model, 'n', n FROM m)
SELECT model, metric, round(value, 4) AS value, round(value - (SELECT value FROM l b WHERE b.model = '1-URGENT' AND b.metric = l.metric), 4) + 0.0 AS delta FROM l""",
)
def metric_deltas(spark, d):
    table = _t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(F.avg("o_totalprice").alias("price"), F.count(F.lit(1)).alias("n"))
    return _rounded(evaluate.metric_deltas(table, "model", "1-URGENT"), 4)


EDGES = [math.exp(-1)]
for _k in range(1, 6):
    EDGES.append(EDGES[-1] + math.exp(-1) / math.factorial(_k))
POISSON = " + ".join(f"(u >= {e!r})::INT" for e in EDGES)


def _u(seed: int, *ids: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {" || ':' || ".join(ids)}), 1, 8))::BIGINT / 4294967296.0"


ORACLE_SQL["bootstrap_mean"] = f"""WITH {RUNS}, drawn AS (SELECT method, metric, rep, {_u(3, "rep", "seed")} AS u FROM runs, range(1, 201) r(rep)),
b AS (SELECT method, rep, sum(metric * ({POISSON})) / nullif(sum({POISSON}), 0) AS m FROM drawn GROUP BY ALL),
q AS (SELECT method, quantile_cont(m, 0.025) AS lower, quantile_cont(m, 0.975) AS upper FROM b GROUP BY method)
SELECT method, round(avg(metric), 4) AS mean, count(metric) AS n, round(any_value(lower), 4) AS lower, round(any_value(upper), 4) AS upper FROM runs JOIN q USING (method) GROUP BY method"""


@query(
    "slope_intervals",
    f"""WITH c AS (SELECT c_mktsegment AS setting, c_custkey, c_nationkey::DOUBLE AS x, c_acctbal AS y FROM customer), drawn AS (SELECT *, {_u(7, "rep", "c_custkey")} AS u FROM c, range(1, 101) r(rep)),
w AS (SELECT setting, rep, x, y, ({POISSON})::DOUBLE AS w FROM drawn),
s AS (SELECT setting, rep, sum(w) AS w, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * y) AS xy, sum(w * x * x) AS xx, count(*) AS n FROM w GROUP BY ALL),
b AS (SELECT setting, n, CASE WHEN w * xx - x * x > 1e-9 * w * xx THEN (w * xy - x * y) / (w * xx - x * x) ELSE 0 END AS b FROM s)
SELECT setting, round(quantile_cont(b, 0.025), 4) AS lower, round(quantile_cont(b, 0.975), 4) AS upper, max(n) AS n FROM b GROUP BY setting""",
)
def slope_intervals(spark, d):
    return _rounded(evaluate.slope_intervals(_t(spark, d, "customer"), "c_mktsegment", "c_nationkey", "c_acctbal", "c_custkey", 100, 7), 4)


@query("paired_delta")
def paired_delta(spark, d):
    return _rounded(evaluate.paired_delta(evaluate.paired(run_rows(spark, d), "method", "seed", "metric", "1-URGENT", "2-HIGH"), 500, 200, 5), 4)


@query("random_trajectories")
def random_trajectories(spark, d):
    """The envelope of nested random selections of the labelled embeddings, with each budget's largest z."""
    return _rounded(evaluate.envelope(evaluate.random_trajectories(_t(spark, d, "embeddings"), "label", [20, 50, 100], 50, 9)))


@query("enrichment_envelope")
def enrichment_envelope(spark, d):
    return _rounded(evaluate.enrichment_envelope(evaluate.random_trajectories(_t(spark, d, "embeddings"), "label", [20, 50, 100], 50, 9)))


# --- selections ------------------------------------------------------------------------

SHARE_RULE = """o AS (SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders),
g AS (SELECT o_orderpriority AS g, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM o) AS share FROM o GROUP BY 1),
slack AS (SELECT unnest({slacks}) AS slack),
bounds AS (SELECT slack, g, greatest(0, ceil((share - slack) * 100 - 1e-9))::BIGINT AS low, least(n, floor((share + slack) * 100 + 1e-9))::BIGINT AS high FROM g, slack),
fit AS (SELECT slack, sum(low) AS low, sum(low) <= 100 AND sum(high) >= 100 AS fits FROM bounds GROUP BY slack),
placed AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey::VARCHAR) AS place FROM o),
inside AS (SELECT b.slack, p.*, place <= low AS must FROM placed p JOIN bounds b ON b.g = p.o_orderpriority AND place <= high),
kept AS (SELECT i.*, must OR row_number() OVER (PARTITION BY i.slack, must ORDER BY o_totalprice DESC, o_orderkey::VARCHAR) <= 100 - fit.low AS keep FROM inside i JOIN fit USING (slack) WHERE fits)"""

ORACLE_SQL["constrained_selection"] = f"WITH {SHARE_RULE.format(slacks='[0.02]')} SELECT o_orderkey, o_totalprice, o_orderpriority FROM kept WHERE keep"
ORACLE_SQL["utility_coverage_frontier"] = f"""WITH {SHARE_RULE.format(slacks='[0.0, 0.02, 0.05, 0.1]')},
best AS (SELECT sum(p) AS b FROM (SELECT o_totalprice AS p FROM o ORDER BY o_totalprice DESC LIMIT 100)),
u AS (SELECT slack, sum(o_totalprice) / (SELECT b FROM best) AS r FROM kept WHERE keep GROUP BY slack),
f AS (SELECT slack::DOUBLE AS slack, r, r >= 0.95 AS good, min(CASE WHEN r >= 0.95 THEN slack END) OVER () AS first FROM fit LEFT JOIN u USING (slack))
SELECT slack, round(r, 6) AS retained, CASE WHEN r IS NULL THEN 'infeasible' WHEN good AND slack = first THEN 'chosen' ELSE 'feasible' END AS status FROM f"""


@query(
    "retained_utility",
    """WITH o AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey::VARCHAR) AS k FROM orders)
SELECT round(sum(o_totalprice) FILTER (o_orderpriority = '1-URGENT') / sum(o_totalprice) FILTER (k <= (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT')), 6) AS retained FROM o""",
)
def retained_utility(spark, d):
    rows = _t(spark, d, "orders").withColumn("selected", F.col("o_orderpriority") == "1-URGENT")
    kept = choose.retained_utility(rows, "o_totalprice", "selected", "o_orderkey", rows.filter("selected").count())
    return _rounded(spark.createDataFrame([(float(kept),)], "retained double"))


@query(
    "random_by_group",
    """WITH m AS (SELECT o_custkey, arg_min(o_orderkey, md5('17:' || o_orderkey)) AS o_orderkey FROM orders GROUP BY 1)
SELECT o_custkey, o_orderkey FROM m ORDER BY ('0x' || substr(md5('17:' || o_custkey), 1, 13))::BIGINT, o_custkey::VARCHAR LIMIT 40""",
)
def random_by_group(spark, d):
    return choose.random_by_group(_t(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_orderkey", "o_custkey", 40, 17).select("o_custkey", "o_orderkey")


@query(
    "gradient_embeddings",
    f"""WITH {CLASS_SQL}, t AS (SELECT id, list(p ORDER BY own) AS p FROM prob GROUP BY id)
SELECT id, len(p) * 64 AS size, round(sqrt(list_sum(list_transform(p, lambda x: x * x)) - 2 * list_max(p) + 1), 6) AS norm FROM t""",
)
def gradient_embeddings(spark, d):
    v = E.gradient_embedding(F.col("p"), F.col("embedding"))
    return _rounded(class_pool(spark, d).select("id", v.alias("v")).select("id", F.size("v").cast("long").alias("size"), E.norm(F.col("v")).alias("norm")))


def _by_method(name):
    def run(spark, d):
        pool = class_pool(spark, d).select("id", "embedding", "p")
        return selectors.select(pool, name, 8, seed=3).select("id")

    run.__name__ = f"selector_{name}"
    return run


_SCORES = {
    "entropy": "-list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END))",
    "margin": "1 - (list_reverse_sort(p)[1] - list_reverse_sort(p)[2])",
    "entropy_gradient": "-list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) * sqrt(1 - list_sum(list_transform(p, lambda x: x * x))) * n",
}
for _name, _score in _SCORES.items():
    query(f"selector_{_name}", f"WITH {CLASS_SQL}, t AS (SELECT id, any_value(n) AS n, list(p ORDER BY own) AS p FROM prob GROUP BY id) SELECT id FROM t ORDER BY {_score} DESC, id LIMIT 8")(_by_method(_name))
query("selector_random", "SELECT vec_id::VARCHAR AS id FROM embeddings ORDER BY ('0x' || substr(md5('3:' || vec_id), 1, 13))::BIGINT, vec_id::VARCHAR LIMIT 8")(_by_method("random"))
query("selector_badge")(_by_method("badge"))


@query(
    "pair_groups",
    f"""WITH {PAIR_SQL} SELECT id, bin AS length_gap_bin, (conv_id // 10)::VARCHAR AS prompt_cluster, bin || '|' || (conv_id // 10) AS length_by_prompt_cluster FROM binned""",
)
def pair_groups(spark, d):
    pairs = preference_pairs(spark, d).select("id", "response_a", "response_b", F.floor(F.col("conv_id") / 10).cast("long").alias("prompt_cluster_id"))
    return preference.pair_groups(pairs, ("length_by_prompt_cluster",)).select("id", "length_gap_bin", "prompt_cluster", "length_by_prompt_cluster")


@query(
    "pooled_vectors",
    """WITH x AS (SELECT label, k, avg(embedding[k]::DOUBLE) AS m FROM embeddings, range(1, 65) r(k) GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM x GROUP BY label)
SELECT label, k::INT AS k, round(m / n, 6) + 0.0 AS value FROM x JOIN n USING (label)""",
)
def pooled_vectors(spark, d):
    """Unit mean vector of each class, from arrays of bounded parts of it: the parts' means, weighted by their sizes."""
    rows = _t(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("k", "x"))
    means = rows.groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("s"))
    unit = E.mean_pooled(F.array(F.transform("s", lambda s: s["m"])))
    return _rounded(means.select("label", F.posexplode(unit).alias("k", "value")).withColumn("k", F.col("k") + 1))


@query(
    "teacher_confidence",
    f"WITH {PAIR_SQL} SELECT id, round(1 / (1 + exp(-abs(words_a - words_b) / 20.0)), 6) AS confidence FROM pairs",
)
def teacher_confidence(spark, d):
    return _rounded(preference_pairs(spark, d).select("id", E.margin_confidence(F.col("words_a") - F.col("words_b"), 20.0).alias("confidence")))


@query("influence_selection")
def influence_selection(spark, d):
    """Seeds are the embeddings whose id leaves 0 to 2 of ten; all others are the pool."""
    rows = _t(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("int").alias("label"), "embedding", F.col("vec_id").alias("_n"))
    got = selectors.by_influence(rows.filter("_n % 10 > 2").select("id", "embedding"), rows.filter("_n % 10 <= 2").drop("_n"), 20, 0.1, 3, heads=2, grid=(0.1,))
    return got.ids


@query("selector_entropy_constrained")
def selector_entropy_constrained(spark, d):
    """Embeddings of most entropy with class and cluster shares near the pool's."""
    return selectors.select(class_pool(spark, d).select("id", "p", "embedding"), "entropy_constrained", 40).select("id")


@query(
    "scaled_features",
    """WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT k, avg(x) AS mean, sqrt(var_pop(x)) AS rms FROM x GROUP BY k), f AS (SELECT greatest(1e-6, median(rms) / 10) AS least FROM m WHERE rms > 1e-8),
s AS (SELECT vec_id, k, (x - mean) / greatest(rms, least) AS v FROM x JOIN m USING (k), f)
SELECT vec_id, round(max(v), 6) AS most, round(min(v), 6) AS least, round(sum(v * v), 4) AS squares FROM s GROUP BY vec_id""",
)
def scaled_features(spark, d):
    rows = _t(spark, d, "embeddings").select("vec_id", "embedding")
    v = F.col("embedding")
    made = influence.scaled(rows, "embedding", *influence.feature_scale(rows, "embedding"))
    return made.select("vec_id", F.round(F.array_max(v), 6).alias("most"), F.round(F.array_min(v), 6).alias("least"), F.round(E.dot(v, v), 4).alias("squares"))


# --- decisions, gates, guards ----------------------------------------------------------

SHIFTS = """y AS (SELECT o_orderstatus AS method, year(o_orderdate) AS budget, o_orderpriority AS class, count(*) AS n FROM orders GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY method, budget) AS own FROM y),
e AS (SELECT *, own * 5 - 1 AS enrichment_excess FROM s),
report AS (SELECT method, budget, sum(abs(own - 0.2)) / 2 AS tv_excess FROM e GROUP BY ALL)"""


def yearly_shifts(spark, d):
    """Orders by status (as method), year (as budget) and priority (as class), against equal shares."""
    counts = _t(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("method"), F.year("o_orderdate").alias("budget"), F.col("o_orderpriority").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("method", "budget").agg(F.sum("n").alias("t"))
    own = counts.join(total, ["method", "budget"]).withColumn("own", F.col("n") / F.col("t")).withColumn("enrichment_excess", F.col("own") * 5 - 1)
    return own.groupBy("method", "budget").agg((F.sum(F.abs(F.col("own") - 0.2)) / 2).alias("tv_excess")), own.select("method", "budget", "class", "enrichment_excess")


@query(
    "established_shifts",
    f"""WITH {SHIFTS}, k AS (SELECT method, class FROM e JOIN report USING (method, budget) WHERE tv_excess >= 0.02 AND enrichment_excess >= 0.02 GROUP BY ALL HAVING count(DISTINCT budget) >= 2),
m AS (SELECT method, avg(tv_excess) AS mean_tv_excess, count(*) FILTER (tv_excess >= 0.02) AS budgets_reached FROM report GROUP BY method)
SELECT method, round(mean_tv_excess, 6) AS mean_tv_excess, budgets_reached, coalesce((SELECT string_agg(class, ',' ORDER BY class) FROM k WHERE k.method = m.method), '') AS stable_classes,
 budgets_reached >= 2 AND EXISTS (SELECT 1 FROM k WHERE k.method = m.method) AS established FROM m""",
)
def established_shifts(spark, d):
    return _rounded(audit.established_shifts(*yearly_shifts(spark, d), least_enrichment=0.02).withColumn("stable_classes", F.array_join("stable_classes", ",")))


@query(
    "gate_readiness",
    """WITH need AS (SELECT r_name AS gate, n_name AS name, n_nationkey FROM region JOIN nation ON r_regionkey = n_regionkey),
have AS (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING avg(s_acctbal) > 4000)
SELECT gate, coalesce(string_agg(name, ',' ORDER BY name) FILTER (s_nationkey IS NULL), '') AS missing, count(*) FILTER (s_nationkey IS NULL) = 0 AS ready FROM need LEFT JOIN have ON n_nationkey = s_nationkey GROUP BY gate""",
)
def gate_readiness(spark, d):
    """A region is a gate that requires all its nations; a nation is evidenced by suppliers of enough balance."""
    nation, region = _t(spark, d, "nation"), _t(spark, d, "region")
    gates = region.join(nation, F.col("r_regionkey") == F.col("n_regionkey")).groupBy(F.col("r_name").alias("gate")).agg(F.collect_set("n_name").alias("required"))
    rich = _t(spark, d, "supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("b")).filter("b > 4000")
    return records.gate_readiness(gates, nation.join(rich, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("n_name").alias("evidence")))


@query(
    "claim_issues",
    """WITH c AS (SELECT c_custkey::VARCHAR AS claim_id, c_mktsegment AS kind, o_orderkey::VARCHAR AS evidence_id FROM customer LEFT JOIN orders ON c_custkey = o_custkey),
e AS (SELECT o_orderkey::VARCHAR AS evidence_id, CASE WHEN o_totalprice > 100000 THEN 'BUILDING' ELSE c_mktsegment END AS kind, count(l_orderkey) AS n_seeds
      FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY ALL),
i AS (SELECT claim_id, c.evidence_id, CASE WHEN c.evidence_id IS NULL THEN 'no_evidence' WHEN e.evidence_id IS NULL THEN 'unknown_evidence' WHEN c.kind <> e.kind THEN 'other_kind' WHEN n_seeds < 3 THEN 'too_few_seeds' END AS issue
      FROM c LEFT JOIN e ON c.evidence_id = e.evidence_id)
SELECT * FROM i WHERE issue IS NOT NULL""",
)
def claim_issues(spark, d):
    """Customers claim their orders as evidence; lines stand for seeds, partly shipped orders are unknown."""
    customer, orders = _t(spark, d, "customer").select("c_custkey", "c_mktsegment"), _t(spark, d, "orders")
    owned = customer.join(orders.select("o_custkey", F.col("o_orderkey").cast("string").alias("e")), F.col("c_custkey") == F.col("o_custkey"), "left")
    claims = owned.groupBy(F.col("c_custkey").cast("string").alias("claim_id"), F.col("c_mktsegment").alias("kind")).agg(F.collect_list("e").alias("evidence_ids"))
    seeds = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    known = orders.filter("o_orderstatus <> 'P'").join(customer, F.col("o_custkey") == F.col("c_custkey")).join(seeds, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    kind = F.when(F.col("o_totalprice") > 100000, "BUILDING").otherwise(F.col("c_mktsegment"))
    return records.claim_issues(claims, known.select(F.col("o_orderkey").cast("string").alias("evidence_id"), kind.alias("kind"), F.coalesce("n", F.lit(0)).alias("n_seeds")), 3)


@query(
    "preflight",
    """WITH pool AS (SELECT c_custkey AS k FROM customer WHERE c_mktsegment <> 'BUILDING'), oracle AS (SELECT o_custkey AS k FROM orders), seeds AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0),
held AS (SELECT c_custkey AS k FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
SELECT 'pool_without_label' AS issue, k::VARCHAR AS key FROM pool WHERE k NOT IN (SELECT k FROM oracle)
UNION SELECT 'seed_in_pool', k::VARCHAR FROM seeds WHERE k IN (SELECT k FROM pool) UNION SELECT 'heldout_in_pool', k::VARCHAR FROM held WHERE k IN (SELECT k FROM pool)
UNION SELECT 'seed_in_heldout', k::VARCHAR FROM seeds WHERE k IN (SELECT k FROM held)""",
)
def preflight(spark, d):
    customer = _t(spark, d, "customer").withColumnRenamed("c_custkey", "k")
    oracle = _t(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return records.preflight(customer.filter("c_mktsegment <> 'BUILDING'"), oracle, customer.filter("c_acctbal < 0"), customer.filter("c_mktsegment in ('BUILDING', 'MACHINERY')"), "k")


@query("preference_effects")
def preference_effects(spark, d):
    """Shift of the longer half of the preference pairs."""
    pairs = preference_pairs(spark, d).withColumn("preferred_response", F.when(F.col("words_a") > F.col("words_b"), 1).otherwise(2)).withColumn("words", F.col("words_a") + F.col("words_b"))
    marked = choose.marked_top(pairs, "words", "id", max(1, pairs.count() // 2))
    report = preference.preference_shift(marked, {"words_a": "length", "words_b": "length", "gap": "attributes"}, "response_a")
    return _rounded(preference.preference_effects(report))


ORACLE_SQL["key_components"] = """WITH RECURSIVE d AS (SELECT doc_id, sha256(text) AS copy, source || ':' || n_chars AS shape FROM documents),
e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM d a JOIN d b ON a.copy = b.copy UNION SELECT a.doc_id, b.doc_id FROM d a JOIN d b ON a.shape = b.shape),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS component FROM d LEFT JOIN r ON r.x = d.doc_id GROUP BY d.doc_id"""


# --- batches ---------------------------------------------------------------------------


@query(
    "token_batches",
    """
WITH RECURSIVE o AS MATERIALIZED (
  SELECT doc_id, greatest(coalesce(n_chars, 1), 1)::BIGINT AS n, row_number() OVER (ORDER BY greatest(coalesce(n_chars, 1), 1), doc_id::VARCHAR) AS r FROM documents),
f AS (
  SELECT doc_id, r, 0::BIGINT AS batch, 0::BIGINT AS place FROM o WHERE r = 1
  UNION ALL
  SELECT o.doc_id, o.r, CASE WHEN f.place + 2 > 16 OR o.n * (f.place + 2) > 20000 THEN f.batch + 1 ELSE f.batch END,
         CASE WHEN f.place + 2 > 16 OR o.n * (f.place + 2) > 20000 THEN 0 ELSE f.place + 1 END
  FROM f JOIN o ON o.r = f.r + 1)
SELECT doc_id, batch, place FROM f""",
)
def token_batches(spark, d):
    """Padded batches of documents by their lengths: at most 16 rows and 20,000 characters."""
    return batches.token_batches(_t(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 16, 20_000).drop("n_chars")


# --- random selections of known law, and vector files ------------------------------------


@query(
    "matched_random_orders",
    """SELECT o_orderkey::VARCHAR AS id FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('11:' || o_orderkey), o_orderkey::VARCHAR) <= 20""",
)
def matched_random_orders(spark, d):
    """Twenty orders of each priority: equal targets and no tolerance leave the draw inside the groups alone."""
    rows = _t(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.create_map("o_orderpriority", F.lit(1.0)).alias("m"))
    names = [r["p"] for r in rows.select(F.col("o_orderpriority").alias("p")).distinct().collect()]  # a row a priority
    return soft.matched_random(rows, "o_orderkey", "m", {n: 1 / len(names) for n in names}, 20 * len(names), 0.0, 11)


@query(
    "systematic_orders",
    """WITH w AS (SELECT o_orderkey, sum(o_totalprice) OVER (ORDER BY o_orderkey::VARCHAR) * 100 / sum(o_totalprice) OVER () AS t, o_totalprice * 100 / sum(o_totalprice) OVER () AS p FROM orders)
SELECT o_orderkey FROM w WHERE ceil(t - 0.5) > ceil(t - p - 0.5)""",
)
def systematic_orders(spark, d):
    """A hundred orders with probabilities in proportion to their price."""
    return sampling.systematic(_t(spark, d, "orders"), "o_totalprice", "o_orderkey", 100).select("o_orderkey")


@query(
    "numpy_vectors",
    """SELECT vec_id::VARCHAR AS id, len(embedding)::INT AS size, list_min(embedding)::DOUBLE AS least, list_max(embedding)::DOUBLE AS most, embedding[1]::DOUBLE AS first, embedding[-1]::DOUBLE AS last
FROM embeddings WHERE embedding IS NOT NULL""",
)
def numpy_vectors(spark, d):
    """The embeddings, written as numpy files with sidecar ids and read back."""
    path = shares.fresh_folder(spark)
    vectors.write_vectors(_t(spark, d, "embeddings").filter("embedding is not null"), "vec_id", "embedding", path)
    v = F.col("embedding")
    found = vectors.load_vectors(spark, path)
    return found.select("id", F.size(v).alias("size"), *[c.cast("double").alias(n) for n, c in (("least", F.array_min(v)), ("most", F.array_max(v)), ("first", F.element_at(v, 1)), ("last", F.element_at(v, -1)))])


@query(
    "three_way_split",
    """WITH d AS (SELECT doc_id, coalesce(lang, '') AS q, coalesce(text, '') AS t, (length(coalesce(text, '')) % 3)::VARCHAR AS label FROM documents),
k AS (SELECT *, sha256(length(q) || ':' || q || length(t) || ':' || t) AS k FROM d),
g AS (SELECT k, min(label) AS label, count(*) AS n FROM k GROUP BY k),
o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY label ORDER BY md5('5:' || k), k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY label) AS total FROM g),
s AS (SELECT *, greatest(1, round_even(total * 0.1, 0)) AS a, greatest(1, round_even(total * 0.2, 0)) AS b FROM o),
e AS (SELECT *, max(CASE WHEN before < a THEN before + n END) OVER (PARTITION BY label) AS stop, CASE WHEN a + b >= total THEN greatest(0, total - a - 1) ELSE b END AS v FROM s)
SELECT doc_id, CASE WHEN before < a THEN 'train' WHEN before - stop < v THEN 'validation' ELSE 'test' END AS split FROM k JOIN e USING (k)""",
)
def three_way_split(spark, d):
    """Documents of one language and text stay together; the label is their length modulo 3."""
    text = F.coalesce("text", F.lit(""))
    docs = _t(spark, d, "documents").select("doc_id", "lang", "text", (F.length(text) % 3).alias("label"))
    return tables.three_way_split(docs, ["lang", "text"], "label", 0.1, 0.2, 5).select("doc_id", "split")


@query("label_store", """SELECT doc_id::VARCHAR AS id, quality, toxic FROM labels""")
def label_store(spark, d):
    """The labels as JSON objects keyed by id, a thousand ids each, written and read back."""
    path = shares.fresh_folder(spark)
    value = F.struct(F.col("doc_id").cast("string").alias("key"), F.struct("quality", "toxic").alias("value"))
    stores = _t(spark, d, "labels").groupBy(F.floor(F.col("doc_id") / 1000).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(value))).alias("value"))
    stores.write.partitionBy("part").text(path)
    return jsonl.label_store(spark, path, "quality int, toxic int")


EFFECTS = """e AS (SELECT o_orderpriority AS method, ['length', 'attributes', 'preference_direction', 'prompt_distribution', 'order_disagreement'][(o_custkey % 5) + 1] AS domain,
 avg(o_totalprice) / 1e6 AS effect, avg(o_totalprice) / 1e6 - 0.12 AS excess FROM orders GROUP BY ALL)"""


@query(
    "preference_gate",
    f"""WITH {EFFECTS}, b AS (SELECT *, map {{'length': 0.1, 'attributes': 0.25, 'preference_direction': 0.05, 'prompt_distribution': 0.01}}[domain] AS bar FROM e),
m AS (SELECT *, coalesce(effect >= bar AND excess > 0, false) AS yes FROM b)
SELECT method, coalesce(string_agg(CASE WHEN yes THEN domain END, ',' ORDER BY domain), '') AS material_domains, round(coalesce(sum(CASE WHEN yes THEN effect / bar END), 0), 6) AS gate_score,
 count(*) FILTER (yes) >= 2 AS established FROM m GROUP BY method""",
)
def preference_gate(spark, d):
    domain = F.get(F.array(*[F.lit(x) for x in ("length", "attributes", "preference_direction", "prompt_distribution", "order_disagreement")]), (F.col("o_custkey") % 5).cast("int"))
    mean = _t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("method"), domain.alias("domain")).agg((F.avg("o_totalprice") / 1e6).alias("effect"))
    return _rounded(audit.preference_gate(mean.withColumn("excess", F.col("effect") - 0.12)).withColumn("material_domains", F.array_join("material_domains", ",")))


@query(
    "recommended_action",
    """WITH c AS (SELECT c_custkey AS k, c_custkey % 2 = 0 AS ce, c_custkey % 3 = 0 AS pe, c_custkey % 5 = 0 AS bias, CASE WHEN c_custkey % 7 > 2 THEN -(c_custkey % 7) / 50.0 END AS od,
 CASE WHEN c_custkey % 4 <> 1 THEN c_acctbal / 1e5 END AS acc, CASE WHEN c_custkey % 11 > 2 THEN -(c_custkey % 11) / 400.0 END AS f1, CASE WHEN c_custkey % 13 > 3 THEN (c_custkey % 13 - 9) / 200.0 END AS pd FROM customer),
w AS (SELECT *, ce AND (coalesce(acc, 0) <= -0.01 OR coalesce(f1, 0) <= -0.01) AS wc, pe AND coalesce(pd, 0) <= -0.01 AS wp FROM c)
SELECT k AS c_custkey, CASE WHEN bias AND (od IS NULL OR od > -0.05) THEN 'repair_pairwise_scoring_first' WHEN NOT ce AND NOT pe THEN 'keep_current_algorithm'
 WHEN (ce AND acc IS NULL AND f1 IS NULL) OR (pe AND pd IS NULL) THEN 'defer_algorithm_change_until_training' WHEN wc AND wp THEN 'restructure_algorithm'
 WHEN wp THEN 'introduce_wsr' WHEN wc THEN 'refine_dcms_constraints' ELSE 'keep_current_algorithm_with_monitoring' END AS recommendation FROM w""",
)
def recommended_action(spark, d):
    """Customers as cases: what is established, biased and lost follows from their numbers and balances."""
    k = F.col("c_custkey")
    cases = _t(spark, d, "customer").select(
        k, (k % 2 == 0).alias("classification_established"), (k % 3 == 0).alias("preference_established"), (k % 5 == 0).alias("position_bias"),
        F.when(k % 7 > 2, -(k % 7) / 50.0).alias("order_delta"), F.when(k % 4 != 1, F.col("c_acctbal") / 1e5).alias("accuracy_delta"),
        F.when(k % 11 > 2, -(k % 11) / 400.0).alias("macro_f1_delta"), F.when(k % 13 > 3, (k % 13 - 9) / 200.0).alias("preference_delta"),
    )
    return audit.recommended_action(cases).select("c_custkey", "recommendation")


@query("preference_baseline")
def preference_baseline(spark, d):
    """Effects of 50 random halves of the preference pairs on lengths, gaps, directions and prompts."""
    pairs = preference_pairs(spark, d).withColumn("preferred_response", F.when(F.col("words_a") > F.col("words_b"), 1).otherwise(2))
    effects = baselines.random_effects(pairs, "id", {"words_a": "length", "words_b": "length", "gap": "attributes"}, "response_a", max(1, pairs.count() // 2), 50, 17)
    return _rounded(baselines.random_baseline(effects))
