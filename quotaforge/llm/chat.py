"""Chat formatting with Spark expressions only.

A conversation's turn structs are collected and sorted, adjacent turns of one
role are merged by array functions, and the text is concatenated:

    <|im_start|>ROLE<|message|>TEXT[<|part|>TEXT...]<|im_end|>\\n

Control strings inside roles and texts are escaped reversibly: backslashes are
doubled and a single one is put after the first character of each control
string, so that no text can forge a marker. `parse` gives the turns back.

Defined cases: null texts and roles count as empty; turns are sorted by (turn,
role, text) with null turns first, so ties and repeated rows keep a fixed order
and all count; a null conv_id is a conversation of its own; empty tables give no
rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaforge.llm.common import table

START, MESSAGE, PART, END = "<|im_start|>", "<|message|>", "<|part|>", "<|im_end|>\n"
#: Control strings of common chat templates: the first character of each is followed by a backslash once escaped.
CONTROL = r"(<(?=\||/?s>|<SYS>>|</SYS>>)|\[(?=/?INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _literal(marker: str) -> str:
    return marker.replace("|", r"\|")


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted text and `loss_spans`: code-point spans of the loss role's texts in it, in order."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    turn = F.struct(F.col("turn"), empty("role").alias("role"), empty("text").alias("text"))
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_t"))
    # positions at which the role changes, then the slices between them: linear in the number of turns
    changes = F.filter(
        F.sequence(F.lit(1), F.size("_t")),
        lambda i: (i == 1) | (F.col("_t")[i - 1]["role"] != F.get(F.col("_t"), i - 2)["role"]),
    )
    merged = F.transform(
        F.col("_from"),
        lambda at, k: F.struct(
            F.col("_t")[at - 1]["role"].alias("role"),
            F.transform(
                F.slice(F.col("_t"), at, F.coalesce(F.get(F.col("_from"), k + 1), F.size("_t") + 1) - at),
                lambda x: escape(x["text"]),
            ).alias("parts"),
        ),
    )
    # what is written, piece by piece: markers (no loss) and texts
    pieces = F.flatten(
        F.transform(
            F.col("_m"),
            lambda m: F.concat(
                F.array(F.struct(F.concat(F.lit(START), escape(m["role"]), F.lit(MESSAGE)).alias("s"), F.lit(False).alias("loss"))),
                F.flatten(
                    F.transform(
                        m["parts"],
                        lambda p, k: F.array(
                            F.struct(F.when(k > 0, F.lit(PART)).otherwise(F.lit("")).alias("s"), F.lit(False).alias("loss")),
                            F.struct(p.alias("s"), (m["role"] == loss_role).alias("loss")),
                        ),
                    )
                ),
                F.array(F.struct(F.lit(END).alias("s"), F.lit(False).alias("loss"))),
            ),
        )
    )
    spans = F.aggregate(
        F.col("_p"),
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["s"])).alias("at"),
            F.when(p["loss"], F.array_append(a["spans"], F.struct(a["at"].alias("start"), (a["at"] + F.length(p["s"])).alias("end"))))
            .otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return (
        sorted_turns.withColumn("_from", changes)
        .withColumn("_m", merged)
        .withColumn("_p", pieces)
        .select("conv_id", F.array_join(F.transform("_p", lambda p: p["s"]), "").alias("formatted"), spans.alias("loss_spans"))
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), merged turns apart again."""
    blocks = F.filter(F.split(formatted, _literal(START)), lambda b: b != "")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring_index(F.substring_index(b, MESSAGE, -1), END, 1), _literal(PART)),
                lambda p: F.struct(unescape(F.substring_index(b, MESSAGE, 1)).alias("role"), unescape(p).alias("text")),
            ),
        )
    )


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for k, r in enumerate(("user", "assistant"))])).alias("_t"),
    ).select("conv_id", "_t.turn", "_t.role", "_t.text")
    done = format_conversations(turns.unionByName(extra))
    loss = F.array_join(
        F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), ""
    )
    lines = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.withColumn("_turns", parse(F.col("formatted"))).withColumn("_loss", loss).select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def chat_sql() -> str:
    added = "(length({0}) - length(replace({0}, '\\', ''))) + len(regexp_extract_all({0}, '<\\||<s>|</s>|<<SYS>>|<</SYS>>|\\[INST\\]|\\[/INST\\]'))"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), p AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(text) + {added.format('text')}
           + CASE WHEN before IS NOT DISTINCT FROM role THEN {len(PART)}
                  ELSE {len(START) + len(MESSAGE) + len(END)} + length(role) + {added.format('role')} END)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""
