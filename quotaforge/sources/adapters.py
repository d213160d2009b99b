"""Raw rows of public benchmarks as one shape: id, dataset, split, text (or query and document), label, label_name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The label names of the public datasets, in the order of their numbers.
AG_NEWS = ("World", "Sports", "Business", "Sci/Tech")
TREC_CODES = ("ABBR", "ENTY", "DESC", "HUM", "LOC", "NUM")
TREC = ("ABBREVIATION", "ENTITY", "DESCRIPTION", "HUMAN_BEING", "LOCATION", "NUMERIC_VALUE")
DBPEDIA = (
    "Company", "EducationalInstitution", "Artist", "Athlete", "OfficeHolder", "MeanOfTransportation", "Building",
    "NaturalPlace", "Village", "Animal", "Plant", "Album", "Film", "WrittenWork",
)


def named_label(raw: Column, names: tuple[str, ...], codes: tuple[str, ...] = ()) -> Column:
    """Number of a label given as a number, a name or a code, in any case; anything else fails."""
    text = F.upper(F.trim(raw.cast("string")))
    number = text.try_cast("int")
    at = lambda values: F.nullif(F.array_position(F.array(*[F.lit(v.upper()) for v in values]), text), F.lit(0)) - 1
    found = F.coalesce(F.when((number >= 0) & (number < len(names)), number), at(names), at(codes) if codes else F.lit(None)).cast("int")
    return F.when(raw.isNotNull() & found.isNull(), F.raise_error(F.concat(F.lit("unknown label "), text)).cast("int")).otherwise(found)


def classification_rows(raw: DataFrame, dataset: str, split: str, line: str, texts: list[str], label: str, names: tuple[str, ...], codes: tuple[str, ...] = ()) -> DataFrame:
    """Rows with the id dataset:split:line; the non-empty trimmed `texts` are joined by a blank line; a null label stays null."""
    parts = F.filter(F.array(*[F.trim(F.col(c)) for c in texts]), lambda t: t.isNotNull() & (t != ""))
    number = named_label(F.col(label), names, codes)
    return raw.select(
        F.concat_ws(":", F.lit(dataset), F.lit(split), F.col(line)).alias("id"), F.lit(dataset).alias("dataset"), F.lit(split).alias("split"),
        F.array_join(parts, "\n\n").alias("text"), number.alias("label"),
    ).withColumn("label_name", F.get(F.array(*[F.lit(n) for n in names]), F.col("label")))


def binary_rows(raw: DataFrame, dataset: str, split: str, line: str, query: str, document: str, label: str) -> DataFrame:
    """id, query (a column of `raw`, else a fixed text), document, groundtruth in {0, 1}; other labels and empty documents fail."""
    y = F.col(label).cast("string").try_cast("int")
    text = F.trim(F.col(document))
    bad = ~F.coalesce(y.isin(0, 1), F.lit(False)) | ~F.coalesce(text != "", F.lit(False))
    return raw.select(
        F.concat_ws(":", F.lit(dataset), F.lit(split), F.col(line)).alias("id"), (F.trim(query) if query in raw.columns else F.lit(query)).alias("query"),
        text.alias("document"), F.when(bad, F.raise_error(F.lit(f"bad {dataset} row")).cast("int")).otherwise(y).alias("groundtruth"),
    )


def remapped(raw: DataFrame, id_: str | None, query: str, document: str, label: str | None, prefix: str, line: str) -> DataFrame:
    """Columns under their common names; a missing id becomes prefix_line; `query` may be a fixed text."""
    own = F.col(id_).cast("string") if id_ else F.lit(None).cast("string")
    return raw.select(
        F.coalesce(own, F.concat_ws("_", F.lit(prefix), F.col(line))).alias("id"), (F.col(query) if query in raw.columns else F.lit(query)).alias("query"),
        F.col(document).alias("document"), (F.col(label) if label else F.lit(None)).cast("string").alias("label"),
    )


def repeated_ids(rows: DataFrame, id_: str = "id") -> DataFrame:
    """(id, n) of the ids that stand in more than one row."""
    return rows.groupBy(F.col(id_).alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def embedding_issues(rows: DataFrame, embeddings: DataFrame, id_: str, vector: str, size: int) -> DataFrame:
    """(id, issue) of rows without a vector, and of vectors of another size, with a null or with a number that is not finite."""
    has = embeddings.select(F.col(id_).alias("_id"), F.col(vector).alias("_v"))
    odd = F.exists("_v", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    issue = F.when(F.col("_v").isNull(), "missing").when(F.size("_v") != size, "size").when(odd, "not finite")
    return rows.select(F.col(id_).alias("id")).join(has, F.col("id") == F.col("_id"), "left").select("id", issue.alias("issue")).filter("issue is not null")
