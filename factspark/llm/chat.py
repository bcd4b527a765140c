"""Chat formatting in budgeted windows.

DataFrame functions only.  Prefix sums of turn tokens choose spans of whole turns; every window repeats
the system turn and a limited history, and only new assistant turns are training targets.  No
conversation is held as a whole: windows are the largest groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factspark.llm.common import WORD, table, text_of
from factspark.llm.registry import query

#: The template: a turn is ``<|turn|>role\n`` text ``<|end|>\n``.
TURN, END = "<|turn|>", "<|end|>"
#: Stands for a line feed within a role.
LINE = "<|line|>"
#: Tokens that a turn's marks count for.
MARKS = 4


def escaped(text: Column) -> Column:
    """``text`` with a backslash after every ``<`` and ``[`` and every backslash doubled.

    No control string that begins with these (``<|end|>``, ``</s>``, ``[INST]``, ``<<SYS>>`` and the like) is left.
    """
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def windows(turns: DataFrame, budget: int = 1024, history: int = 128, conv_id: str = "conv_id", turn: str = "turn",
            role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation and window: conv_id, window, formatted, loss, n_repeated, n_tokens.

    ``formatted`` is the training text: the system turn if the conversation begins with one, turns of the
    window before of at most ``history`` tokens, then the window's own turns.  ``n_repeated`` counts the turns
    at its start that an earlier window has as its own.  ``loss`` lists the spans (start, end; code points of
    ``formatted``, end exclusive) of the own assistant turns' texts: each assistant text is a target once.
    Tokens are words, plus 4 a turn.  A window exceeds ``budget`` only if the system turn, ``history`` and the
    longest turn together do.

    Order: turn (null first), then role and text for equal turns.  Null text and null role count as empty,
    null conv_id as one conversation.  Repeated rows are turns of their own.
    """
    t = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), text_of(F.col(role)).alias("role"), text_of(F.col(text)).alias("text"))
    t = t.withColumn("tokens", (F.regexp_count("text", F.lit(WORD)) + MARKS).cast("long"))
    conv = Window.partitionBy("conv_id")
    order = conv.orderBy("turn", "role", "text")
    t = t.withColumn("pos", F.row_number().over(order))
    lead = (F.col("pos") == 1) & (F.col("role") == "system")
    t = t.withColumn("system", lead).withColumn("own", F.when(lead, 0).otherwise(F.col("tokens")))
    by_place = conv.orderBy("pos")
    t = t.withColumn("start", F.coalesce(F.sum("own").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("most", F.max("own").over(conv)).withColumn("fixed", F.max(F.when(lead, F.col("tokens")).otherwise(0)).over(conv))
    stride = F.greatest(F.lit(1), budget - history - F.col("fixed") - F.col("most"))
    # A system turn lies where the first own turn starts: it must not count as a place of its own.
    t = t.withColumn("span", F.when(F.col("system"), F.lit(-1)).otherwise(F.floor(F.col("start") / stride)))
    t = t.withColumn("window", F.dense_rank().over(conv.orderBy("span")) - F.when(F.col("fixed") > 0, 2).otherwise(1))
    # A turn is history of the windows that begin within ``history`` tokens of its start.
    reach = conv.orderBy(F.when(F.col("system"), F.lit(-1)).otherwise(F.col("start"))).rangeBetween(0, history)
    last = F.when(F.col("system"), F.max("window").over(conv)).otherwise(F.max("window").over(reach))
    t = t.withColumn("last", F.greatest(last, F.lit(0))).withColumn("window", F.greatest("window", F.lit(0)))
    t = t.select("conv_id", "pos", "role", "text", "tokens", "window", "last")
    rows = t.withColumn("at", F.explode(F.sequence("window", "last")))
    head = F.concat(F.lit(TURN), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit(LINE)), F.lit("\n"))
    body = escaped(F.col("text"))
    rows = rows.select("conv_id", F.col("at").alias("window"), F.struct(
        "pos", (F.col("window") < F.col("at")).alias("repeated"), head.alias("head"), body.alias("body"),
        (F.col("role") == "assistant").alias("target"), "tokens").alias("t"))
    grouped = rows.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("t")).alias("ts"), F.sum("t.tokens").alias("n_tokens"))
    size = lambda x: F.char_length(x["head"]) + F.char_length(x["body"]) + len(END) + 1

    def spans(ts: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + F.char_length(x["head"])
            own = F.array(F.struct(begin.alias("start"), (begin + F.char_length(x["body"])).alias("end")))
            return F.struct((acc["at"] + size(x)).alias("at"), F.when(x["target"] & ~x["repeated"], F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(ts, start, step, lambda acc: acc["spans"])

    formatted = F.array_join(F.transform("ts", lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))), "")
    return grouped.select("conv_id", F.col("window").cast("int").alias("window"), formatted.alias("formatted"), spans(F.col("ts")).alias("loss"),
                          F.size(F.filter("ts", lambda x: x["repeated"])).alias("n_repeated"), "n_tokens")


def read_back(formatted: DataFrame) -> DataFrame:
    """Rows of ``windows`` with what their text says: turns (own ones; role, text) and targets (texts under the mask)."""
    parts = F.split("formatted", r"<\|end\|>\n", -1)
    turns = F.transform(F.slice(parts, F.col("n_repeated") + 1, F.size(parts) - 1 - F.col("n_repeated")), lambda p: F.struct(
        unescaped(F.replace(F.substring(F.substring_index(p, "\n", 1), len(TURN) + 1, 1 << 30), F.lit(LINE), F.lit("\n"))).alias("role"),
        unescaped(F.substring(p, F.char_length(F.substring_index(p, "\n", 1)) + 2, F.char_length(p))).alias("text")))
    targets = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.withColumn("turns", turns).withColumn("targets", targets)


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted windows alone."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read_back(formatted).select("conv_id", F.struct("window", said.alias("said"), F.array_join("targets", "").alias("loss"), F.size("turns").alias("n"),
                                                           F.char_length("formatted").alias("chars")).alias("w"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("ws"))
    whole = lambda c: F.array_join(F.transform("ws", lambda w: w[c]), "")
    total = lambda c: F.aggregate("ws", F.lit(0).cast("long"), lambda n, w: n + w[c])
    loss = whole("loss")
    return rows.select("conv_id", total("n").alias("n_turns"), F.sha2(whole("said").cast("binary"), 256).alias("turns_sha256"),
                       F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), total("chars").alias("formatted_chars"))


_SQL = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
              UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
             len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS tokens,
             length(regexp_replace(text, '([<\[\\])', '\1\\', 'g')) + 17 + length(regexp_replace(regexp_replace(role, '([<\[\\])', '\1\\', 'g'), chr(10), '<|line|>', 'g')) AS chars FROM rows),
s AS (SELECT *, pos = 1 AND role = 'system' AS system FROM t),
p AS (SELECT *, coalesce(sum(CASE WHEN system THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
             max(CASE WHEN system THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id) AS most,
             max(CASE WHEN system THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS fixed FROM s),
w AS (SELECT *, CASE WHEN system THEN -1 ELSE start // greatest(1, 1024 - 128 - fixed - most) END AS span FROM p),
d AS (SELECT *, greatest(dense_rank() OVER (PARTITION BY conv_id ORDER BY span) - CASE WHEN fixed > 0 THEN 2 ELSE 1 END, 0) AS win FROM w),
l AS (SELECT *, CASE WHEN system THEN max(win) OVER (PARTITION BY conv_id)
                     ELSE max(win) OVER (PARTITION BY conv_id ORDER BY CASE WHEN system THEN -1 ELSE start END RANGE BETWEEN CURRENT ROW AND 128 FOLLOWING) END AS last FROM d)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars * (last - win + 1)) AS BIGINT) AS formatted_chars
FROM l GROUP BY conv_id
"""


@query("op5_budgeted_windows", _SQL)
def op5_budgeted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and targets of every conversation, and of one that quotes control strings, read back from the windows."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoted = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(quoted).alias("text"))
    return digests(windows(turns.unionByName(extra)))
