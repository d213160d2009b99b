"""Column functions: probabilities, vectors, texts and labels. All are Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


# --- probabilities and vectors ---------------------------------------------------------


def normalised(p: Column) -> Column:
    """Probabilities that sum to 1."""
    return let(p, lambda p: let(_sum(p), lambda total: F.transform(p, lambda x: F.try_divide(x, total))))


def checked_probabilities(p: Column) -> Column:
    """`normalised(p)`; fewer than two classes, a null, negative or infinite part, or a sum of zero is an error (null stays null)."""
    bad = F.exists(p, lambda x: F.coalesce(F.isnan(x) | (x < 0) | (x == float("inf")), F.lit(True)))
    fail = lambda text: F.raise_error(F.lit(text)).cast("array<double>")
    return (
        F.when(F.size(p) < 2, fail("probabilities must contain at least two classes"))
        .when(bad | (_sum(p) <= 0), fail("probabilities must be non-negative and sum to a positive value"))
        .otherwise(normalised(p))
    )


def softmax(z: Column) -> Column:
    return let(z, lambda z: let(F.array_max(z), lambda top: normalised(F.transform(z, lambda x: F.exp(x - top)))))


def entropy(p: Column) -> Column:
    """In nats, with 0 ln 0 = 0."""
    return -F.aggregate(p, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.ln(x)).otherwise(0.0))


def margin(p: Column) -> Column:
    """Largest minus second largest probability."""
    return let(F.sort_array(p, asc=False), lambda q: q[0] - F.coalesce(F.get(q, F.lit(1)), F.lit(0.0)))


def margin_uncertainty(p: Column) -> Column:
    return F.lit(1.0) - margin(p)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column, floor: float = 1e-12) -> Column:
    return let(v, lambda v: let(F.greatest(norm(v), F.lit(floor)), lambda n: F.transform(v, lambda x: x.cast("double") / n)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def gradient_utility(p: Column, v: Column) -> Column:
    """Entropy times the norm of the loss gradient's bound."""
    return let(p, lambda p: entropy(p) * F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - _sum(F.transform(p, lambda x: x * x))))) * norm(v)


def gradient_embedding(p: Column, v: Column) -> Column:
    """(onehot(argmax) - p) outer the unit representation, flattened."""
    left = let(F.array_position(p, F.array_max(p)), lambda top: F.transform(p, lambda x, k: F.when(k + 1 == top, 1.0).otherwise(0.0) - x))
    return let(unit(v), lambda u: F.flatten(F.transform(left, lambda x: F.transform(u, lambda y: x * y))))


def add_intercept(z: Column, target: int, alpha: float) -> Column:
    return F.transform(z, lambda x, k: F.when(k == target, x + alpha).otherwise(x))


def soft_clusters(distances: Column, temperature: float) -> Column:
    """Softmax of -d^2 / T; one-hot of the nearest for T <= 0."""
    if temperature <= 0:
        nearest = F.array_position(distances, F.array_min(distances))
        return F.transform(distances, lambda _, k: F.when(k + 1 == nearest, 1.0).otherwise(0.0))
    return softmax(F.transform(distances, lambda d: -d * d / temperature))


def dual_order(p12: Column, p21: Column) -> Column:
    return (p12 + 1 - p21) / 2


def margin_confidence(margin: Column, temperature: float) -> Column:
    """sigma(|margin| / T): the confidence of a judge with that logit margin."""
    if not 0 < temperature < float("inf"):
        raise ValueError("the temperature is positive and finite")
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.abs(margin.cast("double")) / temperature))


def mean_pooled(vectors: Column) -> Column:
    """Unit mean of an array of vectors of one length; the plain mean where its norm is at most 1e-12, empty for none."""
    def pooled(vs):
        zero = F.transform(vs[0], lambda _: F.lit(0.0))
        total = F.aggregate(vs, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
        mean = F.transform(total, lambda x: x / F.size(vs))
        return let(mean, lambda m: let(norm(m), lambda n: F.when(n > 1e-12, F.transform(m, lambda x: x / n)).otherwise(m)))

    return F.when(F.size(vectors) > 0, pooled(vectors)).otherwise(F.array().cast("array<double>"))


def reward_margin(gap: Column) -> Column:
    """1 - |2 sigma(gap) - 1|: largest where two responses are judged alike."""
    return F.lit(1.0) - F.abs(F.lit(2.0) / (F.lit(1.0) + F.exp(-gap)) - 1)


def dpo_loss(policy_gap: Column, reference_gap: Column, beta: float) -> Column:
    """-ln sigma(beta * (policy gap - reference gap)), stable on both sides."""
    z = (policy_gap - reference_gap) * beta
    return F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def gradient_preference(cheap: Column, gradient_norm: Column, tokens: Column) -> Column:
    return cheap * gradient_norm / F.sqrt(F.greatest(tokens, F.lit(1)))


# --- texts -----------------------------------------------------------------------------


def word_count(text: Column) -> Column:
    """Words between any Unicode white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+")).cast("long")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def length_gap(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), 0 if both are empty."""
    return F.coalesce(F.try_divide((a - b).cast("double"), (a + b).cast("double")), F.lit(0.0))


def length_bin(gap: Column, edge: float = 0.2) -> Column:
    return F.when(gap < -edge, "b_longer").when(gap > edge, "a_longer").otherwise("balanced")


def text_tokens(text: Column) -> Column:
    """Estimate: a token for four characters, at least one, none for blank texts."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.trim(t) == "", 0).otherwise(F.greatest(F.lit(1), F.ceil(F.length(t) / 4))).cast("long")


def lower_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"))


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?。！？])\s+"), lambda s: F.trim(s) != "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(text), F.lit("."), F.lit("_")), "[^a-z0-9-]", "_")


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("|", a, b)


def query_document_prompt(query: Column, document: Column) -> Column:
    return F.concat(F.lit("Query: "), query, F.lit("\nDocument: "), document, F.lit("\nRelevant (1/0): "))


# --- labels ----------------------------------------------------------------------------


def binary_label(value: Column) -> Column:
    v = F.lower(F.trim(value.cast("string"))).try_cast("int")
    return F.when(v.isin(0, 1), v)


def preference_label(value: Column) -> Column:
    """A, B or tie from the usual spellings; null for anything else."""
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin("a", "1", "response_a", "response_1"), "A").when(v.isin("b", "2", "response_b", "response_2"), "B").when(v.isin("0", "tie", "none", ""), "tie")


def flipped(label: Column) -> Column:
    return F.when(label == "A", "B").when(label == "B", "A").otherwise(label)


# --- seeded order ----------------------------------------------------------------------


def seeded(seed: int, *ids: Column) -> Column:
    """Hex digits that order ids at random, alike in any engine with md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def coin(seed: int, *ids: Column) -> Column:
    """Uniform in [0, 1) from the first eight digits of `seeded`."""
    return F.conv(F.substring(seeded(seed, *ids), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
