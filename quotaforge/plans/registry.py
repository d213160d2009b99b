"""Registered queries over the driver's tables, each with its oracle SQL where SQL has a form for it.

Pools: lineitem is the large pool (score: price), documents with labels the labelled one,
embeddings the one with representations (probabilities: softmax of ten times the cosine to
the class centroids), assistant turns of conversations the preference
pairs, orders the run records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotaforge.functions import expr as E
from quotaforge.functions import templates
from quotaforge.operators import audit, choose, cluster, components, evaluate, influence, order, preference, records, response, soft, tables
from quotaforge.streaming import shares

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    return frame.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes])


# --- pools -----------------------------------------------------------------------------

LINE_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint))"


def line_pool(spark, d):
    return _t(spark, d, "lineitem").select(F.expr(LINE_ID).alias("id"), F.col("l_extendedprice").alias("score"), "l_returnflag", "l_linestatus")


LINE_SQL = """
pool AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT) AS id,
                l_extendedprice AS score, l_returnflag, l_linestatus FROM lineitem),
marked AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) <= (SELECT count(*) // 10 FROM pool) AS selected FROM pool)"""


def line_marked(spark, d):
    pool = line_pool(spark, d)
    return choose.marked_top(pool, "score", "id", pool.count() // 10)


def labelled(spark, d):
    return _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id")


def class_pool(spark, d):
    """id, label, embedding, p: probabilities by the centroids of all labelled rows; a centroid is a few hundred bytes a class."""
    rows = _t(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "vec_id", "label", "embedding")
    each = rows.filter("label is not null").select("label", F.posexplode("embedding").alias("k", "x"))
    means = each.groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("c"))
    table = centres.agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("centres"))  # one row
    z = F.transform("centres", lambda s: F.lit(10.0) * E.dot(s["c"], F.col("embedding")) / (E.norm(s["c"]) * E.norm(F.col("embedding"))))
    scored = rows.crossJoin(F.broadcast(table)).withColumn("p", E.softmax(z))
    return scored.withColumn("prediction", F.col("centres")[F.array_position("p", F.array_max("p")).cast("int") - 1]["label"]).drop("centres")


CLASS_SQL = """
rows_ AS (SELECT vec_id::VARCHAR AS id, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
dims AS (SELECT label, k, avg(e[k]) AS m FROM rows_, range(1, 65) r(k) WHERE label IS NOT NULL GROUP BY label, k),
centres AS (SELECT label, list(m ORDER BY k) AS c FROM dims GROUP BY label),
z AS (SELECT r.id, r.label, c.label AS own, 10 * list_dot_product(c.c, r.e) / (sqrt(list_dot_product(c.c, c.c)) * sqrt(list_dot_product(r.e, r.e))) AS z,
             sqrt(list_dot_product(r.e, r.e)) AS n FROM rows_ r CROSS JOIN centres c),
q AS (SELECT *, exp(z - max(z) OVER (PARTITION BY id)) AS e FROM z),
prob AS (SELECT id, label, own, n, e / sum(e) OVER (PARTITION BY id) AS p FROM q)"""


def preference_pairs(spark, d):
    """Consecutive assistant turns of a conversation as responses A and B; A is preferred if it is longer."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    said = _t(spark, d, "conversations").filter("role = 'assistant'").withColumn("_a", F.lag("text").over(w)).filter("_a is not null")
    a, b = E.word_count(F.col("_a")), E.word_count(F.col("text"))
    pairs = said.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "conv_id", F.col("_a").alias("response_a"), F.col("text").alias("response_b"), a.alias("words_a"), b.alias("words_b"))
    return pairs.withColumn("gap", E.length_gap(F.col("words_a"), F.col("words_b"))).withColumn("bin", E.length_bin(F.col("gap")))


PAIR_SQL = """
said AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations WHERE role = 'assistant'),
words AS (SELECT concat_ws('-', conv_id, turn) AS id, conv_id, len(regexp_extract_all(a, '[^\\s]+')) AS words_a, len(regexp_extract_all(text, '[^\\s]+')) AS words_b FROM said WHERE a IS NOT NULL),
pairs AS (SELECT *, CASE WHEN words_a + words_b = 0 THEN 0 ELSE (words_a - words_b) / (words_a + words_b)::DOUBLE END AS gap FROM words),
binned AS (SELECT *, CASE WHEN gap < -0.2 THEN 'b_longer' WHEN gap > 0.2 THEN 'a_longer' ELSE 'balanced' END AS bin FROM pairs)"""

AUDIT = """SELECT field, grp AS "group", pool_count, selected_count, round(pool_share, 6) AS pool_share, round(selected_count / pool_count, 6) AS propensity,
 round(selected_share, 6) AS selected_share, round(pool_share * (selected_count / pool_count) / rate, 6) AS predicted_share,
 round(abs(pool_share * (selected_count / pool_count) / rate - selected_share), 6) + 0.0 AS share_error FROM shares"""
SHARES = """
counts AS (SELECT field, grp, count(*) AS pool_count, count(*) FILTER (selected) AS selected_count
           FROM (SELECT 'l_returnflag' AS field, l_returnflag AS grp, selected FROM marked UNION ALL SELECT 'l_linestatus', l_linestatus, selected FROM marked) GROUP BY ALL),
shares AS (SELECT *, pool_count::DOUBLE / sum(pool_count) OVER (PARTITION BY field) AS pool_share,
  selected_count::DOUBLE / sum(selected_count) OVER (PARTITION BY field) AS selected_share,
  sum(selected_count) OVER (PARTITION BY field)::DOUBLE / sum(pool_count) OVER (PARTITION BY field) AS rate FROM counts)"""


# --- audits ----------------------------------------------------------------------------


@query("audit_lineitem_topk", f"WITH {LINE_SQL}, {SHARES} {AUDIT}")
def audit_lineitem(spark, d):
    return _rounded(audit.group_audit(line_marked(spark, d), ["l_returnflag", "l_linestatus"]))


@query(
    "shift_summary",
    f"""WITH {LINE_SQL}, {SHARES}, s AS (SELECT *, (pool_share + selected_share) / 2 AS m, selected_count / pool_count AS pr FROM shares)
SELECT field, round(sum(abs(pool_share - selected_share)) / 2, 6) AS tv,
 round((sum(CASE WHEN pool_share > 0 THEN pool_share * ln(pool_share / m) ELSE 0 END) + sum(CASE WHEN selected_share > 0 THEN selected_share * ln(selected_share / m) ELSE 0 END)) / 2, 6) AS js,
 round(coalesce(max(pr) FILTER (pr > 0) / min(pr) FILTER (pr > 0), 0), 6) AS max_propensity_ratio, round(min(selected_share / pool_share), 6) AS worst_coverage,
 round(sum(abs(pool_share * pr / rate - selected_share)), 6) + 0.0 AS identity_error FROM s GROUP BY field""",
)
def shift_summary(spark, d):
    return _rounded(audit.shift_summary(audit.group_audit(line_marked(spark, d), ["l_returnflag", "l_linestatus"])))


@query(
    "class_shift_documents",
    """WITH r AS (SELECT lang, quality = 1 AND toxic = 0 AS selected FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang AS label, count(*) AS pool_count, count(*) FILTER (selected) AS selected_count FROM r GROUP BY 1),
s AS (SELECT *, pool_count::DOUBLE / sum(pool_count) OVER () AS p, selected_count::DOUBLE / sum(selected_count) OVER () AS q FROM c)
SELECT label, pool_count, selected_count, round(p, 6) AS pool_share, round(q, 6) AS selected_share, round(q - p, 6) AS shift, round(q / p, 6) AS enrichment FROM s""",
)
def class_shift_documents(spark, d):
    rows = labelled(spark, d).withColumn("selected", (F.col("quality") == 1) & (F.col("toxic") == 0))
    return _rounded(audit.class_shift(rows, "lang"))


@query(
    "numeric_shift",
    """WITH m AS (SELECT l_quantity, l_discount, l_shipdate >= TIMESTAMP '1997-01-01' AS selected FROM lineitem),
e AS (SELECT 'l_quantity' AS field, l_quantity AS v, selected FROM m UNION ALL SELECT 'l_discount', l_discount, selected FROM m)
SELECT field, count(v) AS pool_count, count(v) FILTER (selected) AS selected_count, round(avg(v), 6) AS pool_mean, round(avg(v) FILTER (selected), 6) AS selected_mean,
 round(median(v), 6) AS pool_median, round(median(v) FILTER (selected), 6) AS selected_median, round(avg(v) FILTER (selected) - avg(v), 6) AS mean_delta FROM e GROUP BY field""",
)
def numeric_shift(spark, d):
    rows = _t(spark, d, "lineitem").withColumn("selected", F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    return _rounded(audit.numeric_shift(rows, ["l_quantity", "l_discount"]))


TOKEN_SQL = """WITH r AS (SELECT text, quality = 1 AS selected FROM documents JOIN labels USING (doc_id)),
w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token, selected FROM r),
c AS (SELECT token, count(*) AS a, count(*) FILTER (selected) AS b FROM w GROUP BY token)"""


@query(
    "token_divergence",
    TOKEN_SQL + """, s AS (SELECT a::DOUBLE / sum(a) OVER () AS p, b::DOUBLE / sum(b) OVER () AS q, count(*) OVER () AS vocabulary FROM c)
SELECT vocabulary, round((sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END)) / 2, 6) AS js FROM s GROUP BY vocabulary""",
)
def token_divergence(spark, d):
    return _rounded(audit.token_divergence(labelled(spark, d).withColumn("selected", F.col("quality") == 1), "text"))


@query(
    "token_shift",
    TOKEN_SQL + """, s AS (SELECT token, a AS pool_count, b AS selected_count, ln((b::DOUBLE / sum(b) OVER () + 1e-12) / (a::DOUBLE / sum(a) OVER () + 1e-12)) AS x FROM c)
SELECT token, pool_count, selected_count, round(x, 6) AS log_ratio, 'enriched' AS direction FROM (FROM s ORDER BY x DESC, token LIMIT 20)
UNION ALL SELECT token, pool_count, selected_count, round(x, 6), 'depleted' FROM (FROM s ORDER BY x, token LIMIT 20)""",
)
def token_shift(spark, d):
    return _rounded(audit.token_shift(labelled(spark, d).withColumn("selected", F.col("quality") == 1), "text"))


@query(
    "mutual_information",
    """WITH j AS (SELECT l_returnflag AS l, l_linestatus AS r, count(*) AS n FROM lineitem GROUP BY ALL),
s AS (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY l) / sum(n) OVER () AS pl, sum(n) OVER (PARTITION BY r) / sum(n) OVER () AS pr FROM j)
SELECT round(sum(p * ln(p / (pl * pr))), 6) AS mutual_information, round(-sum(p * ln(pl)), 6) AS left_entropy, round(-sum(p * ln(pr)), 6) AS right_entropy FROM s""",
)
def mutual_information(spark, d):
    return _rounded(audit.mutual_information(_t(spark, d, "lineitem"), "l_returnflag", "l_linestatus"))


@query(
    "score_audit",
    """SELECT count(l_extendedprice) AS n, min(l_extendedprice) AS least, max(l_extendedprice) AS most, round(avg(l_extendedprice), 4) AS mean,
 round(var_pop(l_extendedprice) / 1e6, 4) AS variance, min(l_extendedprice) = max(l_extendedprice) AS degenerate, round(corr(l_extendedprice, l_quantity), 6) AS length_correlation FROM lineitem""",
)
def score_audit(spark, d):
    found = audit.score_audit(_t(spark, d, "lineitem"), "l_extendedprice", "l_quantity")
    return found.select("n", "least", "most", F.round("mean", 4).alias("mean"), F.round(F.col("variance") / 1e6, 4).alias("variance"), "degenerate", F.round("length_correlation", 6).alias("length_correlation"))


# --- scores ----------------------------------------------------------------------------


@query(
    "uncertainty_scores",
    f"""WITH {CLASS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC) AS k FROM prob)
SELECT id, round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END), 6) AS entropy, round(sum(CASE k WHEN 1 THEN p WHEN 2 THEN -p END), 6) AS margin,
 round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) * sqrt(greatest(0, 1 - sum(p * p))) * max(n), 6) AS gradient_utility FROM o GROUP BY id""",
)
def uncertainty_scores(spark, d):
    p = F.col("p")
    return _rounded(class_pool(spark, d).select("id", E.entropy(p).alias("entropy"), E.margin(p).alias("margin"), E.gradient_utility(p, F.col("embedding")).alias("gradient_utility")))


@query(
    "class_metrics",
    f"""WITH {CLASS_SQL}, pr AS (SELECT id, any_value(label) AS y, arg_max(own, p) AS s FROM prob GROUP BY id),
l AS (SELECT y AS label FROM pr UNION SELECT s FROM pr),
m AS (SELECT label, (SELECT count(*) FROM pr WHERE y = label) AS support, (SELECT count(*) FROM pr WHERE s = label) AS said, (SELECT count(*) FROM pr WHERE s = label AND y = label) AS hits FROM l)
SELECT label::VARCHAR AS label, support::BIGINT AS support, round(CASE WHEN said > 0 THEN hits / said ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN hits / support ELSE 0 END, 6) AS recall,
 round(2 * hits / (support + said), 6) AS f1, round(sum(hits) OVER () / sum(support) OVER (), 6) AS accuracy, round(avg(2 * hits / (support + said)) OVER (), 6) AS macro_f1 FROM m""",
)
def class_metrics(spark, d):
    return _rounded(evaluate.class_metrics(class_pool(spark, d), "label", "prediction"))


@query("preference_length_gaps", f"WITH {PAIR_SQL} SELECT id, words_a::BIGINT AS words_a, words_b::BIGINT AS words_b, round(gap, 6) AS gap, bin FROM binned")
def preference_length_gaps(spark, d):
    return _rounded(preference_pairs(spark, d).select("id", "words_a", "words_b", "gap", "bin"))


@query(
    "length_controlled_win",
    f"""WITH {PAIR_SQL}, w AS (SELECT bin, CASE WHEN conv_id % 3 = 0 OR gap > 0 THEN 1.0 ELSE 0.0 END AS win FROM binned), b AS (SELECT bin, avg(win) AS m, sum(win) AS s, count(*) AS n FROM w GROUP BY bin)
SELECT round(sum(s) / sum(n), 6)::DOUBLE AS raw_win_rate, round(avg(m), 6) AS length_controlled_win_rate FROM b""",
)
def length_controlled_win(spark, d):
    rows = preference_pairs(spark, d).withColumn("win", F.when((F.col("conv_id") % 3 == 0) | (F.col("gap") > 0), 1.0).otherwise(0.0))
    return _rounded(evaluate.length_controlled_win(rows, "win", "bin"))


# --- selections ------------------------------------------------------------------------


@query("select_top_budget", f"WITH {LINE_SQL} SELECT id, score FROM marked WHERE selected")
def select_top_budget(spark, d):
    pool = line_pool(spark, d)
    return choose.top_budget(pool, "score", "id", pool.count() // 10).select("id", "score")


@query(
    "select_top_budget_by_group",
    """WITH b AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey::VARCHAR) AS k FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice FROM b WHERE k = 1 ORDER BY o_totalprice DESC, o_orderkey::VARCHAR LIMIT 50""",
)
def select_top_budget_by_group(spark, d):
    return choose.top_budget_by_group(_t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", "o_custkey", 50)


@query("select_random", "SELECT o_orderkey FROM orders ORDER BY ('0x' || substr(md5('17:' || o_orderkey), 1, 13))::BIGINT, o_orderkey::VARCHAR LIMIT 200")
def select_random(spark, d):
    return choose.random_budget(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 200, 17)


@query(
    "rank_normalised",
    "SELECT o_orderkey, round((row_number() OVER (ORDER BY o_totalprice, o_orderkey::VARCHAR) - 1) / (count(*) OVER () - 1), 6) AS utility FROM orders",
)
def rank_normalised(spark, d):
    return _rounded(choose.rank_normalised(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("o_orderkey", "utility"))


@query("constrained_selection")
def constrained_selection(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return choose.constrained(rows, "o_totalprice", "o_orderkey", "o_orderpriority", 100, 0.02)


@query("utility_coverage_frontier")
def utility_coverage_frontier(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return _rounded(choose.frontier(rows, "o_totalprice", "o_orderkey", "o_orderpriority", 100, [0.0, 0.02, 0.05, 0.1]))


@query("farthest_points")
def farthest_points(spark, d):
    return choose.farthest_points(_t(spark, d, "embeddings"), "embedding", "vec_id", 8)


# --- evaluation ------------------------------------------------------------------------


@query(
    "binary_metrics",
    """WITH r AS (SELECT source, quality = 1 AS y, n_chars > 1000 AS p FROM documents JOIN labels USING (doc_id)),
c AS (SELECT source, count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn FROM r GROUP BY source)
SELECT source, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy,
 round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
 round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) AS macro_f1 FROM c""",
)
def binary_metrics(spark, d):
    return _rounded(evaluate.binary_metrics(labelled(spark, d), "quality", "n_chars", 1000, ["source"]))


@query(
    "group_accuracy",
    """WITH g AS (SELECT lang AS "group", avg((quality = CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END)::INT) AS accuracy, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT "group", round(accuracy, 6) AS accuracy, n, round(min(accuracy) OVER (), 6) AS worst FROM g""",
)
def group_accuracy(spark, d):
    rows = labelled(spark, d).withColumn("prediction", F.when(F.col("n_chars") > 1000, 1).otherwise(0))
    return _rounded(evaluate.group_accuracy(rows, "lang", "quality", "prediction"))


RUNS = "runs AS (SELECT o_orderpriority AS method, o_custkey % 10 AS seed, avg(o_totalprice) AS metric FROM orders GROUP BY ALL)"


def run_rows(spark, d):
    return _t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("method"), (F.col("o_custkey") % 10).alias("seed")).agg(F.avg("o_totalprice").alias("metric"))


@query(
    "learning_curve_area",
    f"""WITH {RUNS}, s AS (SELECT method, seed::DOUBLE AS x, metric AS y, lag(seed) OVER w AS px, lag(metric) OVER w AS py FROM runs WINDOW w AS (PARTITION BY method ORDER BY seed))
SELECT method AS series, round(sum((x - px) * (y + py) / 2) / (max(x) - min(x)), 4) AS aulc FROM s GROUP BY method""",
)
def learning_curve_area(spark, d):
    return _rounded(evaluate.learning_curve_area(run_rows(spark, d), "seed", "metric", "method"), 4)


@query(
    "paired_deltas",
    f"""WITH {RUNS} SELECT a.seed::VARCHAR AS seed, round(a.metric, 4) AS base, round(b.metric, 4) AS treat FROM runs a JOIN runs b ON a.seed = b.seed AND a.method = '1-URGENT' AND b.method = '2-HIGH'""",
)
def paired_deltas(spark, d):
    return _rounded(evaluate.paired(run_rows(spark, d), "method", "seed", "metric", "1-URGENT", "2-HIGH"), 4)


@query(
    "sign_flip_test",
    f"""WITH {RUNS}, d AS (SELECT a.seed::VARCHAR AS seed, b.metric - a.metric AS d FROM runs a JOIN runs b ON a.seed = b.seed AND a.method = '1-URGENT' AND b.method = '2-HIGH'),
m AS (SELECT rep, avg(d * CASE WHEN ('0x' || substr(md5('5:' || rep || ':' || seed), 1, 8))::BIGINT / 4294967296.0 < 0.5 THEN -1 ELSE 1 END) AS m, avg(d) AS o FROM d, range(1, 501) r(rep) GROUP BY rep)
SELECT round(first(o), 4) AS mean_delta, round((count(*) FILTER (abs(m) >= abs(o) - 1e-12) + 1) / (count(*) + 1), 6) AS p_value FROM m""",
)
def sign_flip_test(spark, d):
    found = evaluate.sign_flip_test(evaluate.paired(run_rows(spark, d), "method", "seed", "metric", "1-URGENT", "2-HIGH"), 500, 5)
    return found.select(F.round("mean_delta", 4).alias("mean_delta"), F.round("p_value", 6).alias("p_value"))


@query("bootstrap_mean")
def bootstrap_mean(spark, d):
    return _rounded(evaluate.bootstrap_mean(run_rows(spark, d), "metric", "seed", ["method"], 200, 3), 4)


@query(
    "response_statistics",
    """WITH x AS (SELECT c_mktsegment AS setting, c_nationkey::DOUBLE AS x, c_acctbal AS y FROM customer),
r AS (SELECT *, rank() OVER (PARTITION BY setting ORDER BY x) + (count(*) OVER (PARTITION BY setting, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY setting ORDER BY y) + (count(*) OVER (PARTITION BY setting, y) - 1) / 2 AS ry FROM x)
SELECT setting, count(*) AS n, round(corr(rx, ry), 6) AS spearman, round(regr_slope(y, x), 4) AS slope FROM r GROUP BY setting""",
)
def response_statistics(spark, d):
    found = evaluate.response_statistics(_t(spark, d, "customer"), "c_mktsegment", "c_nationkey", "c_acctbal")
    return found.select("setting", "n", F.round("spearman", 6).alias("spearman"), F.round("slope", 4).alias("slope"))


@query("random_envelope")
def random_envelope(spark, d):
    return _rounded(evaluate.random_envelope(_t(spark, d, "embeddings"), "vec_id", "label", 100, 50, 9))


# --- tables ----------------------------------------------------------------------------


@query(
    "distinct_documents",
    """SELECT sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS document_sha256, min(doc_id) AS doc_id, count(*) AS copies, min(lang) <> max(lang) AS conflict FROM documents GROUP BY 1""",
)
def distinct_documents(spark, d):
    return tables.distinct_documents(_t(spark, d, "documents"), "text", "doc_id", "lang")


@query(
    "stratified_split",
    """WITH c AS (SELECT label::VARCHAR AS label, count(*) AS n FROM embeddings GROUP BY 1), s AS (SELECT unnest(['seed', 'active', 'test']) AS split, unnest([50, 150, 250]) AS upto),
x AS (SELECT label, split, upto, n * upto::DOUBLE / sum(n) OVER (PARTITION BY split) AS x FROM c, s),
q AS (SELECT label, split, upto, floor(x) + (row_number() OVER (PARTITION BY split ORDER BY x - floor(x) DESC, label) <= upto - sum(floor(x)) OVER (PARTITION BY split))::INT AS quota FROM x),
p AS (SELECT vec_id, label::VARCHAR AS label, row_number() OVER (PARTITION BY label ORDER BY md5('23:' || vec_id), vec_id::VARCHAR) AS k FROM embeddings)
SELECT vec_id, label, arg_min(split, upto) AS split FROM p JOIN q USING (label) WHERE k <= quota GROUP BY vec_id, label""",
)
def stratified_split(spark, d):
    return tables.stratified_split(_t(spark, d, "embeddings"), "vec_id", "label", {"seed": 50, "active": 100, "test": 100}, 23)


@query(
    "reveal_selected",
    """WITH c AS (SELECT doc_id FROM documents WHERE n_chars > 2000) SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d SEMI JOIN c USING (doc_id) JOIN labels l USING (doc_id)""",
)
def reveal_selected(spark, d):
    docs = _t(spark, d, "documents")
    return tables.reveal(docs.select("doc_id", "lang"), _t(spark, d, "labels"), docs.filter("n_chars > 2000"), "doc_id").select("doc_id", "lang", "quality", "toxic")


@query("unrevealed_ids", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unrevealed_ids(spark, d):
    return tables.unrevealed(_t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels"), "doc_id")


@query(
    "cover_issues",
    "SELECT coalesce(d.doc_id, l.doc_id) AS key, CASE WHEN d.doc_id IS NULL THEN 'extra' ELSE 'missing' END AS issue FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL",
)
def cover_issues(spark, d):
    return tables.cover_issues(_t(spark, d, "documents"), _t(spark, d, "labels"), "doc_id")


@query(
    "teacher_labels",
    """SELECT d.doc_id, coalesce(t.quality, 0)::INT AS train_label, CASE WHEN t.doc_id IS NULL THEN 'own' ELSE 'teacher' END AS label_source FROM documents d LEFT JOIN labels t ON d.doc_id = t.doc_id""",
)
def teacher_labels(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.lit(0).alias("own"))
    teacher = _t(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    return tables.teacher_labels(rows, teacher, "doc_id", "own").select("doc_id", "train_label", "label_source")


@query("class_weights", "SELECT quality::INT AS label, count(*) AS n, round(sum(count(*)) OVER () / (2.0 * count(*)), 6)::DOUBLE AS weight FROM labels GROUP BY quality")
def class_weights(spark, d):
    return _rounded(tables.class_weights(_t(spark, d, "labels"), "quality"))


@query(
    "run_matrix_issues",
    """WITH e AS (SELECT lower(replace(r_name, ' ', '_')) || '__m1__' || b || '__' || s || '__' || m AS run_id FROM region, (SELECT unnest([100, 200]) AS b), (SELECT unnest([1, 2]) AS s), (SELECT unnest(['random', 'entropy']) AS m)),
o AS (SELECT lower(replace(r_name, ' ', '_')) || '__m1__100__' || s || '__random' AS run_id, CASE WHEN r_regionkey = 0 THEN 'failed' ELSE 'completed' END AS status FROM region, (SELECT unnest([1, 2, 3]) AS s))
SELECT coalesce(e.run_id, o.run_id) AS run_id, CASE WHEN o.run_id IS NULL THEN 'missing' WHEN e.run_id IS NULL THEN 'unexpected' ELSE 'failed' END AS issue
FROM e FULL JOIN o ON e.run_id = o.run_id WHERE o.run_id IS NULL OR e.run_id IS NULL OR o.status <> 'completed'""",
)
def run_matrix_issues(spark, d):
    region = _t(spark, d, "region")
    expected = tables.run_matrix(region.select(F.col("r_name").alias("dataset")), ["m1"], [100, 200], [1, 2], ["random", "entropy"])
    seen = region.select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("seed"), "r_name", "r_regionkey")
    observed = seen.select(
        F.concat_ws("__", E.slug(F.col("r_name")), F.lit("m1"), F.lit("100"), F.col("seed").cast("string"), F.lit("random")).alias("run_id"),
        F.when(F.col("r_regionkey") == 0, "failed").otherwise("completed").alias("status"),
    )
    return tables.run_issues(expected, observed)


@query(
    "text_estimates",
    """SELECT doc_id, len(regexp_extract_all(text, '[^\\s]+'))::BIGINT AS words, (CASE WHEN trim(text) = '' THEN 0 ELSE greatest(1, ceil(length(text) / 4)) END)::BIGINT AS tokens FROM documents""",
)
def text_estimates(spark, d):
    return _t(spark, d, "documents").select("doc_id", E.word_count(F.col("text")).alias("words"), E.text_tokens(F.col("text")).alias("tokens"))


@query(
    "reservoir",
    """SELECT c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('11:' || c_custkey), c_custkey::VARCHAR) <= 20""",
)
def reservoir(spark, d):
    return tables.reservoir(_t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", 20, 11)


# --- interventions ---------------------------------------------------------------------

BASE_MARGIN = "(conv_id % 7) / 7.0D"
GAMMAS = [0.0, 0.5, 1.0, 2.0]


@query(
    "length_response_curve",
    f"""WITH {PAIR_SQL}, s AS (SELECT id, bin, g AS setting, (conv_id % 7) / 7.0::DOUBLE + g * gap AS score FROM binned, (SELECT unnest([0.0, 0.5, 1.0, 2.0]::DOUBLE[]) AS g)),
k AS (SELECT *, row_number() OVER (PARTITION BY setting ORDER BY score DESC, id) <= 40 AS sel FROM s)
SELECT setting, bin AS "group", count(*) AS pool_count, count(*) FILTER (sel) AS selected_count, round(count(*) FILTER (sel) / count(*), 6) AS propensity,
 round(count(*) FILTER (sel) / sum(count(*) FILTER (sel)) OVER (PARTITION BY setting), 6)::DOUBLE AS selected_share FROM k GROUP BY setting, bin""",
)
def length_response_curve(spark, d):
    rows = preference_pairs(spark, d).withColumn("margin", F.expr(BASE_MARGIN))
    curve = response.response_curve(rows, "id", "bin", GAMMAS, lambda g: F.col("margin") + F.lit(g) * F.col("gap"), 40)
    return _rounded(curve.withColumn("selected_count", F.col("selected_count").cast("long")))


@query(
    "selector_replacement",
    """WITH r AS (SELECT c_custkey AS id, c_mktsegment AS g, c_acctbal AS a, (c_custkey * 7919 % 1009)::DOUBLE AS b FROM customer),
k AS (SELECT *, row_number() OVER (ORDER BY a DESC, id::VARCHAR) <= 50 AS ina, row_number() OVER (ORDER BY b DESC, id::VARCHAR) <= 50 AS inb,
 rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM r),
t AS (SELECT g, count(*) FILTER (ina) / 50 - count(*) FILTER (inb) / 50 AS d FROM k GROUP BY g)
SELECT count(*) FILTER (ina AND inb) AS overlap, round(count(*) FILTER (ina AND inb) / count(*) FILTER (ina OR inb), 6) AS jaccard,
 (SELECT round(sum(abs(d)) / 2, 6) FROM t) AS tv, round(corr(ra, rb), 6) AS spearman FROM k""",
)
def selector_replacement(spark, d):
    rows = _t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", (F.col("c_custkey") * 7919 % 1009).cast("double").alias("b"))
    return _rounded(response.replacement(rows, "c_custkey", "c_acctbal", "b", "c_mktsegment", 50))


@query(
    "position_swap_summary",
    """WITH p AS (SELECT o_custkey, avg(o_totalprice) FILTER (o_orderkey % 2 = 0) AS o, avg(o_totalprice) FILTER (o_orderkey % 2 = 1) AS s FROM orders GROUP BY o_custkey)
SELECT count(*) AS pairs, round(avg(abs(o - s)), 4) AS mean_delta, round(max(abs(o - s)), 4) AS max_delta, round(corr(o, s), 4) AS correlation FROM p WHERE o IS NOT NULL AND s IS NOT NULL""",
)
def position_swap_summary(spark, d):
    side = F.when(F.col("o_orderkey") % 2 == 0, "original").otherwise("swapped").alias("position")
    rows = _t(spark, d, "orders").groupBy("o_custkey", side).agg(F.avg("o_totalprice").alias("score"))
    return _rounded(response.swap_summary(rows, "o_custkey", "position", "score"), 4)


@query("group_dependence")
def group_dependence(spark, d):
    return _rounded(response.group_dependence(_t(spark, d, "customer"), "c_custkey", "c_acctbal", "c_mktsegment", 10, 500, 7))


# --- components, clusters, records, streams --------------------------------------------


@query("key_components")
def key_components(spark, d):
    """Documents that share their text or their source's exact length belong together."""
    docs = _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("copy"), F.concat_ws(":", "source", "n_chars").alias("shape"))
    return components.key_components(docs, "doc_id", ["copy", "shape"])


@query("component_split")
def component_split(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey", "o_custkey")
    n = rows.count()
    return components.component_split(rows, "o_orderkey", ["o_custkey"], {"seed": n // 10, "active": n // 2, "test": n // 5}, 13)


@query("prompt_clusters")
def prompt_clusters(spark, d):
    rows = _t(spark, d, "embeddings")
    centres = cluster.fit_clusters(rows, "embedding", "vec_id", 8)
    return cluster.assign_clusters(rows, "embedding", "vec_id", centres, 0.5).select("id", "cluster", F.round("distance", 4).alias("distance"))


@query("facility_location")
def facility_location(spark, d):
    pool = class_pool(spark, d).select("id", "embedding", E.entropy(F.col("p")).alias("entropy"))
    return _rounded(cluster.facility_location(pool, pool, "embedding", "id", "entropy", 16), 4)


@query("expected_influence")
def expected_influence(spark, d):
    """Labelled seeds are the ids of remainder 0 (fit), 1 (temperature) and 2 (validation) of ten; the others are candidates."""
    rows = _t(spark, d, "embeddings").select("vec_id", "embedding", "label")
    fold = F.col("vec_id") % 10
    head = influence.calibrated(influence.fit_head(rows.filter(fold == 0), "embedding", "label", 0.01), rows.filter(fold == 1), "embedding", "label")
    gradient = influence.mean_gradient(head, rows.filter(fold == 2), "embedding", "label")
    return influence.expected_influence(head, gradient, rows.filter(fold > 2).drop("label"), "vec_id", "embedding").select("id", F.round("utility", 8).alias("utility"))


@query(
    "stage_status",
    """WITH r AS (SELECT r_regionkey AS k, lower(replace(r_name, ' ', '_')) AS run_id FROM region),
s AS (SELECT run_id, p AS position, ['select', 'train', 'judge'][p + 1] AS stage, 1::BIGINT AS needed, (k > p)::BIGINT AS present, k FROM r, range(3) t(p))
SELECT run_id, position::INT AS position, stage, needed, present, CASE WHEN k > position THEN 'complete' WHEN k = position THEN 'ready' ELSE 'blocked' END AS status FROM s""",
)
def stage_status(spark, d):
    runs = _t(spark, d, "region").select("r_regionkey", E.slug(F.col("r_name")).alias("run_id"))
    plan = records.execution_manifest(runs, [("select", [], ["{run}/ids"]), ("train", ["{run}/ids"], ["{run}/model"]), ("judge", ["{run}/model"], ["{run}/wins"])])
    made = F.slice(F.array(F.lit("ids"), F.lit("model"), F.lit("wins")), F.lit(1), F.least("r_regionkey", F.lit(3)).cast("int"))
    existing = runs.select("run_id", F.explode(made).alias("name")).select(F.concat_ws("/", "run_id", "name").alias("path"))
    return records.stage_status(plan, existing)


@query(
    "acquisition_records",
    """WITH k AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id::VARCHAR) <= 100 AS selected, l.quality FROM documents JOIN labels l USING (doc_id))
SELECT doc_id::VARCHAR AS sample_id, 'longest' AS method, 1 AS seed, n_chars AS score, selected, CASE WHEN selected THEN quality END AS revealed_label FROM k""",
)
def acquisition_records(spark, d):
    rows = labelled(spark, d)
    done = choose.marked(rows, choose.top_budget(rows, "n_chars", "doc_id", 100), "doc_id")
    return records.acquisition_records(done, "doc_id", "n_chars", "selected", "quality", {"method": "longest", "seed": 1})


@query("stream_event_counts", """SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type AS "group", count(*) AS n FROM events GROUP BY ALL""")
def stream_event_counts(spark, d):
    schema = _t(spark, d, "events").schema
    counts = shares.windowed_counts(shares.arriving(spark, d, "events.parquet", schema), "ts", "event_type", "1 hour", "3650 days")
    return shares.run_to_table(counts, shares.fresh_folder(spark)).withColumn("start", F.col("start").cast("timestamp_ntz"))


# --- overlapping groups and preference pairs ---------------------------------------------


def soft_pool(spark, d):
    """The class pool with its entropy, memberships by class and bounds of 0.05 about them, written once: selections scan it many times."""
    pool = class_pool(spark, d).select("id", E.entropy(F.col("p")).alias("entropy"), F.map_from_arrays(F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda k: k.cast("string")), "p").alias("m"))
    return order.cut(pool.withColumn("low", F.transform_values("m", lambda _, v: F.greatest(v - 0.05, F.lit(0.0)))).withColumn("high", F.transform_values("m", lambda _, v: F.least(v + 0.05, F.lit(1.0)))))


def soft_targets(pool):
    return {r["group"]: r["target"] for r in soft.target_moments(pool, "m").collect()}  # a number a class


@query("soft_selection")
def soft_selection(spark, d):
    pool = soft_pool(spark, d)
    return soft.select(pool, "entropy", "id", "m", "m", soft_targets(pool), 100, 0.01).ids


@query("soft_error_audit")
def soft_error_audit(spark, d):
    """Observed memberships are those of the prediction alone."""
    pool = soft_pool(spark, d)
    top = F.array_max(F.map_values("m"))
    seen = pool.withColumn("seen", F.transform_values("m", lambda _, v: F.when(v == top, 1.0).otherwise(0.0)))
    return _rounded(soft.error_audit(seen, "entropy", "id", "m", "low", "high", "seen", soft_targets(pool), 100, 0.08), 4)


def log_pairs(spark, d):
    """Preference pairs with log probabilities that fall with the words, differently for policy and reference."""
    value = lambda c, k: F.round(-F.col(f"words_{c}") * k - F.pmod(F.col("conv_id"), F.lit(7)) * (k if c == "a" else 0.01), 6)
    pairs = preference_pairs(spark, d).select("id", "conv_id", "bin", "words_a", "words_b", value("a", 0.05).alias("pa"), value("b", 0.05).alias("pb"), value("a", 0.03).alias("ra"), value("b", 0.03).alias("rb"))
    return preference.log_gaps(pairs, ("pa", "pb"), ("ra", "rb"))


LOG_SQL = PAIR_SQL + """,
logs AS (SELECT *, round(-words_a * 0.05 - (conv_id % 7) * 0.05, 6) AS pa, round(-words_b * 0.05 - (conv_id % 7) * 0.01, 6) AS pb,
                   round(-words_a * 0.03 - (conv_id % 7) * 0.03, 6) AS ra, round(-words_b * 0.03 - (conv_id % 7) * 0.01, 6) AS rb FROM binned),
gaps AS (SELECT *, pa - pb AS policy_gap, ra - rb AS reference_gap, (pa - pb) - (ra - rb) AS implicit_gap FROM logs),
scored AS (SELECT *, 1 - abs(2 / (1 + exp(-greatest(-60, least(60, implicit_gap)))) - 1) AS reward_margin, abs(implicit_gap) / greatest(words_a + words_b, 1) AS update_size FROM gaps)"""


@query(
    "log_gap_audit",
    f"""WITH {LOG_SQL}, long AS (SELECT unnest(['policy_gap', 'reference_gap', 'implicit_gap']) AS gap, unnest([policy_gap, reference_gap, implicit_gap]) AS v FROM gaps)
SELECT gap, count(*) AS n, round(avg(v), 6) + 0.0 AS mean, round(var_pop(v), 6) + 0.0 AS variance, count(*) FILTER (v > 1e-12) AS positive,
 count(*) FILTER (v < -1e-12) AS negative, count(*) FILTER (abs(v) <= 1e-12) AS zero FROM long GROUP BY gap""",
)
def log_gap_audit(spark, d):
    return _rounded(preference.log_gap_audit(log_pairs(spark, d)))


@query(
    "pair_scores",
    f"""WITH {LOG_SQL} SELECT id, round(reward_margin, 6) + 0.0 AS reward_margin, round(update_size, 6) + 0.0 AS update_size,
 round(reward_margin / (1 + abs(implicit_gap)), 6) + 0.0 AS cheap_gradient FROM scored""",
)
def pair_scores(spark, d):
    scored = preference.pair_scores(log_pairs(spark, d), F.col("words_a") + F.col("words_b"), by_length=True)
    return _rounded(scored.select("id", "reward_margin", "update_size", "cheap_gradient"))


@query(
    "covering_candidates",
    f"""WITH {LOG_SQL}, best AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY round(update_size, 6) DESC, id) = 1 AS covers FROM scored)
SELECT id, bin, covers FROM best QUALIFY row_number() OVER (ORDER BY covers DESC, round(update_size, 6) DESC, id) <= 40""",
)
def covering_candidates(spark, d):
    scored = preference.pair_scores(log_pairs(spark, d), F.col("words_a") + F.col("words_b"), by_length=True).withColumn("size", F.round("update_size", 6))
    return preference.covering_candidates(scored, "size", "id", 10, 4, ["bin"]).select("id", "bin", "covers")


def _utilities(spark, d):
    rows = _t(spark, d, "orders").select("o_orderpriority", (F.col("o_totalprice") / 1e6).alias("u"))
    return rows.filter("o_orderpriority = '1-URGENT'"), rows.filter("o_orderpriority = '2-HIGH'")


PROFILE_SQL = """
r AS (SELECT o_orderpriority AS p, o_totalprice / 1e6 AS u, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n
      FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
b AS (SELECT p, u, ((k > round_even(n / 4.0, 0))::INT + (k > round_even(2 * n / 4.0, 0))::INT + (k > round_even(3 * n / 4.0, 0))::INT)::INT AS bin FROM r),
profile AS (SELECT p, bin, count(*) AS n, avg(u) AS mean FROM b GROUP BY p, bin)"""


@query("utility_profile", f"WITH {PROFILE_SQL} SELECT bin, n, round(mean, 6) + 0.0 AS mean, (bin + 0.5) / 4::DOUBLE AS midpoint FROM profile WHERE p = '1-URGENT'")
def utility_profile(spark, d):
    return _rounded(preference.utility_profile(_utilities(spark, d)[0], "u", 4))


@query(
    "matched_utility",
    f"""WITH {PROFILE_SQL}, m AS (SELECT (SELECT avg(u) FROM b WHERE p = '2-HIGH') - (SELECT avg(u) FROM b WHERE p = '1-URGENT') AS d,
 (SELECT max(abs(t.mean - s.mean)) FROM profile s JOIN profile t USING (bin) WHERE s.p = '1-URGENT' AND t.p = '2-HIGH') AS x)
SELECT round(d, 6) + 0.0 AS mean_delta, round(x, 6) + 0.0 AS largest_bin_delta, abs(d) <= 0.02 AND x <= 0.05 AS matched FROM m""",
)
def matched_utility(spark, d):
    return _rounded(preference.matched_utility(*_utilities(spark, d), "u"))


@query(
    "coverage_deviation",
    """WITH s AS (SELECT source AS g, count(*) / sum(count(*)) OVER ()::DOUBLE AS v FROM documents WHERE n_chars > 1000 GROUP BY 1),
t AS (SELECT source AS g, count(*) / sum(count(*)) OVER ()::DOUBLE AS v FROM documents GROUP BY 1)
SELECT round(sum(abs(coalesce(s.v, 0) - coalesce(t.v, 0))) / 2, 6) + 0.0 AS deviation FROM s FULL JOIN t ON s.g IS NOT DISTINCT FROM t.g""",
)
def coverage_deviation(spark, d):
    docs = _t(spark, d, "documents")

    def shares_of(rows):
        each = rows.groupBy(F.col("source").alias("group")).agg(F.count(F.lit(1)).alias("n"))  # a row a source
        return each.crossJoin(F.broadcast(each.agg(F.sum("n").alias("all")))).select("group", (F.col("n") / F.col("all")).alias("value"))

    return _rounded(preference.coverage_deviation(shares_of(docs.filter("n_chars > 1000")), shares_of(docs)))


@query("influence_posterior")
def influence_posterior(spark, d):
    """Probabilities with bounds from ten resampled heads; l2 by the calibration fold."""
    rows = _t(spark, d, "embeddings").select("vec_id", "embedding", "label")
    fold = F.col("vec_id") % 10
    fit, side = rows.filter(fold == 0), rows.filter(fold == 1)
    head, l2 = influence.choose_l2(fit, side, "embedding", "label", [0.001, 0.01, 0.1])
    heads = influence.bootstrap_heads(fit, side, "vec_id", "embedding", "label", l2, 10, 7)
    found = influence.posterior(influence.calibrated(head, side, "embedding", "label"), heads, rows.filter(fold > 1).drop("label"), "vec_id", "embedding")
    three = lambda c: F.transform(c, lambda v: F.round(v, 4))
    return found.select("id", three("p").alias("p"), three("lower").alias("lower"), three("upper").alias("upper"))


@query(
    "positioned_pairs",
    f"""WITH {PAIR_SQL}, c AS (SELECT *, ('0x' || substr(md5('42:' || id), 1, 8))::BIGINT / 4294967296.0 < 0.5 AS swapped FROM binned)
SELECT id, CASE WHEN swapped THEN 'swapped' ELSE 'original' END AS ab_position, CASE WHEN swapped THEN words_b ELSE words_a END AS words_shown_first,
 CASE WHEN words_a = words_b THEN 'tie' WHEN (words_a > words_b) <> swapped THEN 'A' ELSE 'B' END AS label FROM c""",
)
def positioned_pairs(spark, d):
    """The longer response is preferred."""
    longer = F.when(F.col("words_a") > F.col("words_b"), 1).when(F.col("words_a") < F.col("words_b"), 2).otherwise(0)
    pairs = preference_pairs(spark, d).withColumnRenamed("response_a", "response_1").withColumnRenamed("response_b", "response_2").withColumn("preferred_response", longer)
    placed = templates.positioned_pairs(pairs, "id", 42)
    first = F.when(F.col("ab_position") == "swapped", F.col("words_b")).otherwise(F.col("words_a"))
    return placed.select("id", "ab_position", first.alias("words_shown_first"), "label")


@query(
    "classification_records",
    """SELECT doc_id AS id, sha256(concat('Text:', chr(10), text, chr(10), chr(10), 'Categories:', chr(10), 'A: low', chr(10), 'B: high', chr(10), chr(10),
 'Classify the text and answer with exactly one letter from A to B.')) AS said_sha256, CASE WHEN quality = 1 THEN 'B' ELSE 'A' END AS answer FROM documents JOIN labels USING (doc_id)""",
)
def classification_records(spark, d):
    made = templates.classification_records(labelled(spark, d), "doc_id", "text", "quality", ["low", "high"])
    return made.select("id", F.sha2(F.col("messages")[1]["content"], 256).alias("said_sha256"), "answer")

from quotaforge.plans import extra  # noqa: E402, F401 (registers its queries here)
