"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation's turns are rendered as ``### role: text</turn>`` and a line feed.  Prefix sums of the turns' tokens choose
turn-aligned spans: a window holds as many new turns as its budget allows besides the system turn, which every
window repeats, and a limited history of the turns just before.  The loss mask covers the assistant texts among a
window's new turns, so each is a target once however often it is repeated.

Escaping: a backslash, "#" and the slash of "</" get a backslash before them (in roles ":" too), so that no text
holds a marker; dropping each backslash before its character restores the text exactly.

A turn longer than the budget gets a window of its own and is kept whole.  Nulls: a null text or role is empty; rows
with a null conv_id form one conversation; a null turn comes first.  Rows of equal turn follow by role, then text;
repeated rows are turns of their own.  An empty table gives an empty result; other columns are ignored.  One
conversation is held in one row, since its digest needs all its text in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of

#: Tokens of a window, and of the history that it repeats.
BUDGET = 512
HISTORY = 128
#: What counts as one token: up to six letters, up to three digits, or one other character but white space.
TOKEN = r"\p{L}{1,6}|\p{N}{1,3}|[^\s\p{L}\p{N}]"
END = "</turn>\n"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("#"), F.lit("\\#")), F.lit("</"), F.lit("<\\/"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\:"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def count_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def _windows(turns: Column, sums: Column, system: Column, budget: int, history: int) -> Column:
    """Array of struct<first, last, back>: the new turns [first, last) of each window and the turn its history
    starts at.  sums[i]: tokens of the turns before i.  system: 1 if turn 0 is the system turn."""
    kind = "struct<first:int,back:int,done:array<struct<first:int,last:int,back:int>>>"
    fixed = F.when(system == 1, F.element_at(sums, 2)).otherwise(0)  # tokens of the system turn
    at = lambda i: F.element_at(sums, i + 1)

    def back(first: Column) -> Column:
        """The earliest turn whose tokens up to first fit the history; the prefix sums don't fall."""
        return F.size(F.filter(sums, lambda s: s < at(first) - history)).cast("int")

    def step(state: Column, i: Column) -> Column:
        full = (i > state.first) & (fixed + at(i + 1) - at(state.back) > budget)
        closed = F.struct(state.first.alias("first"), i.alias("last"), state.back.alias("back"))
        b = F.greatest(system, F.least(back(i), i))
        # history gives way when it and the next turn don't fit together
        b = F.when(fixed + at(i + 1) - at(b) > budget, i).otherwise(b)
        new = F.struct(i.alias("first"), b.cast("int").alias("back"), F.concat(state.done, F.array(closed)).alias("done"))
        return F.when(full, new).otherwise(state)

    n = F.size(turns)
    start = F.struct(system.alias("first"), system.alias("back"), F.array().cast("array<struct<first:int,last:int,back:int>>").alias("done")).cast(kind)
    rest = F.when(n > system, F.sequence(system, n - 1)).otherwise(F.array().cast("array<int>"))
    end = lambda s: F.concat(s.done, F.array(F.struct(s.first.alias("first"), n.cast("int").alias("last"), s.back.alias("back"))))
    return F.aggregate(rest, start, lambda s, i: step(s, i).cast(kind), end)


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window (from 0), text, n_repeated (leading turns that an earlier window has as
    its own), tokens, and spans: the loss mask as an array of struct<start, chars> in code points of text."""
    rows = columns_of(conversations, "conv_id", "turn", "role", "text")
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = rows.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    head = lambda t: F.concat(F.lit("### "), escape_role(t["role"]), F.lit(": "))
    convs = convs.select("conv_id", F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("goal"), (t["role"] == "system").alias("sys"))).alias("turns"))
    convs = convs.withColumn("tokens", F.transform("turns", lambda t: count_tokens(F.concat(t["head"], t["body"])) + 2))
    convs = convs.withColumn("sums", F.aggregate("tokens", F.array(F.lit(0)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n))))
    convs = convs.withColumn("system", F.element_at("turns", 1)["sys"].cast("int"))
    spans = _windows(F.col("turns"), F.col("sums"), F.col("system"), budget, history)
    wins = convs.select("conv_id", "turns", "sums", "system", F.posexplode(spans).alias("window", "w"))

    first, last, back = F.col("w.first"), F.col("w.last"), F.col("w.back")
    kept = F.concat(F.slice("turns", 1, F.col("system")), F.slice("turns", back + 1, last - back))
    n_repeated = F.when(F.col("window") == 0, F.lit(0)).otherwise(F.col("system") + first - back)
    used = F.element_at("sums", last + 1) - F.element_at("sums", back + 1) + F.when(F.col("system") == 1, F.element_at("sums", 2)).otherwise(0)
    wins = wins.select("conv_id", "window", kept.alias("kept"), n_repeated.alias("n_repeated"), used.alias("tokens"))
    lengths = F.transform("kept", lambda t: F.struct((F.length(t["head"]) + F.length(t["body"]) + len(END)).alias("all"), F.length(t["head"]).alias("head"), F.length(t["body"]).alias("body"), t["goal"].alias("goal")))
    wins = wins.withColumn("lengths", lengths)
    none = F.array().cast("array<struct<start:int,chars:int>>")
    mask = F.aggregate(
        F.transform("lengths", lambda x, i: F.struct(x["all"].alias("all"), x["head"].alias("head"), x["body"].alias("body"), (x["goal"] & (i >= F.col("n_repeated"))).alias("goal"))),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda s, x: F.struct((s["at"] + x["all"]).alias("at"), F.when(x["goal"], F.concat(s["out"], F.array(F.struct((s["at"] + x["head"]).alias("start"), x["body"].alias("chars"))))).otherwise(s["out"]).alias("out")),
        lambda s: s["out"],
    )
    body = F.array_join(F.transform("kept", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    return wins.select("conv_id", "window", body.alias("text"), "n_repeated", "tokens", mask.alias("spans"))


def read_turns(text: Column, skip: Column) -> Column:
    """The turns of a formatted text behind its first ``skip``, as array<struct<role, text>>, unescaped."""
    # what stands behind the last end marker is empty
    parts = F.slice(F.split(text, END), skip + 1, F.greatest(F.lit(0), F.size(F.split(text, END)) - 1 - skip))
    role = lambda p: F.regexp_extract(p, r"(?s)^### ([^:\\]*+(?:\\.[^:\\]*+)*+): ", 1)
    return F.transform(parts, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(F.substring(p, F.length(role(p)) + 7, F.length(p))).alias("text")))


def read_loss(text: Column, spans: Column) -> Column:
    """The masked text of a formatted text, unescaped, its spans one after the other."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(text, s["start"] + 1, s["chars"]))), "")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each conversation, read back from its windows."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    wins = format_windows(rows.unionByName(planted))
    wins = wins.select("conv_id", "window", F.length("text").cast("long").alias("chars"), read_turns(F.col("text"), F.col("n_repeated")).alias("turns"), read_loss(F.col("text"), F.col("spans")).alias("loss"))
    convs = wins.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    turns = F.flatten(F.transform("w", lambda x: x["turns"]))
    loss = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    convs = convs.select("conv_id", turns.alias("turns"), loss.alias("loss"), "formatted_chars")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return convs.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


#: Windows are closed one turn after the other.  The columns of read(): i, the next turn; a, the window's first new turn;
#: b, the turn its history starts at; done, the text of the windows closed so far.
OP2_SQL = rf"""
WITH RECURSIVE rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS k,
    '### ' || replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</', '<\/'), ':', '\:') || ': '
    || replace(replace(replace(text, '\', '\\'), '#', '\#'), '</', '<\/') AS body
  FROM rows
), lists AS (
  SELECT conv_id, count(*) AS n, list(length(body) + {len(END)} ORDER BY k) AS chars,
    list_prepend(0, list(len(regexp_extract_all(body, '\p{{L}}{{1,6}}|\p{{N}}{{1,3}}|[^\x09-\x0D \p{{L}}\p{{N}}]')) + 2 ORDER BY k)) AS tokens,
    CAST(first(role = 'system' ORDER BY k) AS INTEGER) AS sys
  FROM turns GROUP BY conv_id
), sums AS (
  SELECT conv_id, n, sys, list_transform(tokens, lambda t, i: list_sum(tokens[1:i])) AS s, list_transform(list_prepend(0, chars), lambda t, i: list_sum(list_prepend(0, chars)[1:i])) AS c FROM lists
), states AS (
  SELECT conv_id, sys AS i, sys AS a, sys AS b, CAST(0 AS HUGEINT) AS done FROM sums
  UNION ALL
  SELECT conv_id, i + 1, CASE WHEN is_full THEN i ELSE a END, CASE WHEN NOT is_full THEN b WHEN fixed + s[i + 2] - s[back + 1] > {BUDGET} THEN i ELSE back END,
    CASE WHEN is_full THEN done + c[i + 1] - c[b + 1] + c[sys + 1] ELSE done END
  FROM (
    SELECT t.*, s, c, n, sys, sys * s[2] AS fixed, i > a AND sys * s[2] + s[i + 2] - s[b + 1] > {BUDGET} AS is_full,
      greatest(sys, least(len(list_filter(s, lambda x: x < s[i + 1] - {HISTORY})), i)) AS back
    FROM states t JOIN sums USING (conv_id) WHERE i < n
  )
), formatted AS (
  SELECT conv_id, CAST(done + c[n + 1] - c[b + 1] + c[sys + 1] AS BIGINT) AS formatted_chars FROM states JOIN sums USING (conv_id) WHERE i = n
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  any_value(formatted_chars) AS formatted_chars
FROM rows JOIN formatted USING (conv_id) GROUP BY conv_id
"""
