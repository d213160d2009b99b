"""Prompts, messages and training records as column expressions; texts of templates are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaforge.functions.expr import coin, sentences


def label_codes(count: int) -> list[str]:
    if not 2 <= count <= 26:
        raise ValueError("between 2 and 26 labels have letters")
    return [chr(65 + k) for k in range(count)]


def _messages(*said: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in said])


def classification_messages(text: Column, names: list[str]) -> Column:
    codes = label_codes(len(names))
    listed = "\n".join(f"{c}: {n}" for c, n in zip(codes, names, strict=True))
    end = F.lit(f"\n\nCategories:\n{listed}\n\nClassify the text and answer with exactly one letter from {codes[0]} to {codes[-1]}.")
    return _messages(("system", F.lit("You are a precise text classifier. Do not explain your answer.")), ("user", F.concat(F.lit("Text:\n"), F.coalesce(text, F.lit("")), end)))


def pairwise_messages(prompt: Column, first: Column, second: Column) -> Column:
    parts = [F.lit("User prompt:\n"), prompt, F.lit("\n\nResponse A:\n"), first, F.lit("\n\nResponse B:\n"), second, F.lit("\n\nChoose the better response. Answer with exactly one letter: A or B.")]
    said = F.concat(*[F.coalesce(p, F.lit("")) for p in parts])
    return _messages(("system", F.lit("You compare two assistant responses for overall human preference. Do not explain your answer.")), ("user", said))


def classification_records(rows: DataFrame, id_: str, text: str, label: str, names: list[str]) -> DataFrame:
    """(id, messages, answer) of supervised training; rows without a label of the list go."""
    answer = F.get(F.array(*[F.lit(c) for c in label_codes(len(names))]), F.col(label).cast("int"))
    return rows.select(F.col(id_).alias("id"), classification_messages(F.col(text), names).alias("messages"), answer.alias("answer")).filter("answer is not null")


def preference_records(rows: DataFrame, id_: str, prompt: str, first: str, second: str, preferred: str) -> DataFrame:
    """(id, messages, chosen, rejected) of preference training; ties and unlabelled rows go."""
    one = F.col(preferred) == 1
    return rows.filter(F.col(preferred).isin(1, 2)).select(
        F.col(id_).alias("id"), _messages(("user", F.col(prompt))).alias("messages"), F.when(one, F.col(first)).otherwise(F.col(second)).alias("chosen"), F.when(one, F.col(second)).otherwise(F.col(first)).alias("rejected")
    )


def embedding_prompt(text: Column, query: Column, task: str = "Query", evidence: str = "Document", instruction: str = "") -> Column:
    head = f"Instruction:\n{instruction.strip()}\n\n" if instruction.strip() else ""
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return F.concat(F.lit(f"{head}{task}:\n"), clean(query), F.lit(f"\n\n{evidence}:\n"), clean(text))


def chunks(text: Column, size: int = 3000, overlap: int = 300) -> Column:
    """Whole sentences packed to about `size` characters; each chunk after the first begins with the end of the one before it.

    A sentence longer than `size` is a chunk of its own; blank texts give one empty chunk.
    """
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, s: Column) -> Column:
        s = F.trim(s)
        full = (acc["open"] != "") & (F.length(acc["open"]) + F.length(s) > size)
        tail = F.trim(F.right(acc["open"], F.lit(overlap))) if overlap else F.lit("")
        start = F.when(full, tail).otherwise(acc["open"])
        return F.struct(F.when(full, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"), F.when(start == "", s).otherwise(F.concat(start, F.lit(" "), s)).alias("open"))

    return F.aggregate(sentences(text), empty, add, lambda acc: F.array_append(acc["done"], acc["open"]))


def positioned_pairs(rows: DataFrame, id_: str, seed: int, both: bool = False) -> DataFrame:
    """Pairs with responses a and b in a seeded order (`both`: in both orders, the id then naming it); `ab_position` says which.

    The label A or B follows the order; a tie stays a tie. The order hangs on the id alone.
    """
    names = ["original", "swapped"]
    order = F.explode(F.array(*map(F.lit, names))) if both else F.when(coin(seed, F.col(id_)) < 0.5, names[1]).otherwise(names[0])
    placed = rows.withColumn("swap_pair", F.col(id_).cast("string")).withColumn("ab_position", order)
    swapped = F.col("ab_position") == names[1]
    label = F.when(F.col("preferred_response") == 0, "tie").when((F.col("preferred_response") == 1) != swapped, "A").when(F.col("preferred_response").isNotNull(), "B")
    out = placed.withColumn("response_a", F.when(swapped, F.col("response_2")).otherwise(F.col("response_1"))).withColumn("response_b", F.when(swapped, F.col("response_1")).otherwise(F.col("response_2")))
    return out.withColumn("label", label).withColumn(id_, F.concat_ws(":", "swap_pair", "ab_position") if both else F.col(id_))
