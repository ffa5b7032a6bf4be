"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums over a conversation's turns choose its windows: each takes all turns up to
the one whose sum passes the capacity counted from the window's first turn, so spans are
turn-aligned and as full as their turns allow.  A turn finds its window by binary search
among the first turns.  Every window begins with
the system turn, repeats the last turns of the window before it up to a limit, and has
its own assistant turns under the loss mask; repeated ones are masked out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenloom.llm.common import EMPTY_SHA256, table

START, END = "<|im_start|>", "<|im_end|>"

# Control strings of public chat templates, as first character and rest.
CONTROLS = (
    "<|im_start|>",
    "<|im_end|>",
    "<|im_sep|>",
    "<|endoftext|>",
    "<|startoftext|>",
    "<|begin_of_text|>",
    "<|end_of_text|>",
    "<|start_header_id|>",
    "<|end_header_id|>",
    "<|eot_id|>",
    "<|eom_id|>",
    "<|system|>",
    "<|user|>",
    "<|assistant|>",
    "<|end|>",
    "<s>",
    "</s>",
    "<unk>",
    "<pad>",
    "<bos>",
    "<eos>",
    "<start_of_turn>",
    "<end_of_turn>",
    "<<SYS>>",
    "<</SYS>>",
    "[INST]",
    "[/INST]",
)

# The regex metacharacters among the controls' characters are quoted one by one.
_RESTS = "|".join("".join(f"\\{c}" if c in "|[]()/<>" else c for c in x[1:]) for x in sorted(CONTROLS, reverse=True))
_ESCAPE = rf"([<\[])(\\*)(?={_RESTS})"
_UNESCAPE = rf"([<\[])\\(\\*)(?={_RESTS})"


def escaped(text: Column) -> Column:
    """Text in which no control string occurs: one more backslash after each one's first character.

    Control strings that already have backslashes there get one more as well, so that
    unescaped() gives the text back whatever it holds.
    """
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2")


def escaped_role(role: Column) -> Column:
    """A role on one line: backslashes as \\b, line ends as \\n, then as any text."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def tokens(text: Column) -> Column:
    """Estimated tokens of a turn: its UTF-8 bytes by four, rounded up, and four for the template."""
    return F.floor((F.octet_length(text) + 3) / 4) + 4


def _firsts(sums: Column, cap: Column) -> Column:
    """Places of the turns that begin a window after the first, from (place, own, end) in order."""

    def step(a: Column, x: Column) -> Column:
        begin = x["end"] - x["own"]
        new = (x["end"] - a["base"] > cap) & (begin > a["base"])
        return F.struct(F.when(new, begin).otherwise(a["base"]).alias("base"), F.when(new, F.concat(a["out"], F.array(x["place"]))).otherwise(a["out"]).alias("out"))

    return F.aggregate(sums, F.struct(F.lit(0).cast("bigint").alias("base"), F.array().cast("array<int>").alias("out")), step, lambda a: a["out"])


def _rank(sorted_: Column, value: Column) -> Column:
    """How many numbers of a sorted array are at most the value, by binary search."""

    def step(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        right = F.coalesce(F.get(sorted_, mid) <= value, F.lit(False))
        open_ = a["lo"] < a["hi"]
        return F.struct(F.when(open_ & right, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(open_ & ~right, mid).otherwise(a["hi"]).alias("hi"))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(sorted_) + 1)).cast("int"))
    return F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), F.size(sorted_).alias("hi")), step, lambda a: a["lo"].cast("bigint"))


def windows(turns: DataFrame, budget: int = 512, history: int = 96, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns dealt out to windows: conv_col, window, place, role, text (escaped), n_tokens, target.

    budget: tokens of a window; history: tokens of turns repeated from the window
    before.  The capacity for a window's own turns is the budget less the system turn
    and the history, a quarter of the budget at least.  A turn above the capacity is a
    window of its own.  Windows go over the budget where there is such a turn, or where the
    system turn and the history leave less than a quarter.
    """
    whole = W.partitionBy("conv").orderBy("turn", "role", "text")
    every = W.partitionBy("conv")
    # As a struct the key is never null, so that one dealing by it serves the join and all windows.
    t = turns.select(F.struct(F.col(conv_col).alias("c")).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    t = t.withColumn("place", F.row_number().over(whole))
    t = t.withColumn("sys", (F.col("place") == 1) & (F.col("role") == "system")).withColumn("n", tokens(F.col("text")))
    # The system turn is no turn of a span; its size lessens the capacity of all.
    t = t.withColumn("cap", F.greatest(F.lit(budget - history) - F.max(F.when(F.col("sys"), F.col("n")).otherwise(0)).over(every), F.lit(budget // 4)))
    t = t.withColumn("own", F.when(F.col("sys"), 0).otherwise(F.col("n")))
    t = t.withColumn("end", F.sum("own").over(whole.rowsBetween(W.unboundedPreceding, 0)))
    # Numbers only, one row per conversation: the places at which windows after the first begin.
    sums = F.sort_array(F.collect_list(F.struct("place", "own", "end")))
    per = t.groupBy("conv").agg(sums.alias("sums"), F.max("cap").alias("cap"))
    firsts = per.select("conv", _firsts(F.col("sums"), F.col("cap")).alias("firsts"))
    t = t.join(firsts, "conv").withColumn("window", _rank(F.col("firsts"), F.col("place"))).drop("firsts")
    own = W.partitionBy("conv", "window")
    t = t.withColumn("window_end", F.max("end").over(own)).withColumn("last", F.max("window").over(every))
    again = ~F.col("sys") & (F.col("window") < F.col("last")) & (F.col("window_end") - F.col("end") + F.col("own") <= history)
    # One row per window that shows the turn; the first is the one that owns it.
    shown = F.when(F.col("sys"), F.sequence(F.lit(0).cast("bigint"), F.col("last"))).when(again, F.array("window", F.col("window") + 1)).otherwise(F.array("window"))
    t = t.select("conv", "place", escaped_role(F.col("role")).alias("role"), escaped(F.col("text")).alias("text"), "n", F.posexplode(shown).alias("k", "window"))
    return t.select(F.col("conv.c").alias(conv_col), "window", "place", "role", "text", F.col("n").alias("n_tokens"), (F.col("k") == 0).alias("target"))


def format_chats(turns: DataFrame, budget: int = 512, history: int = 96, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Training windows: conv_col, window, formatted, repeated, loss.

    formatted: `<|im_start|>role\\ntext<|im_end|>\\n` per turn, roles and texts escaped;
    repeated: how many turns at its beginning other windows own (the system turn, which
    the first window owns, and the history); loss: (start, end) in code points of
    formatted, ends exclusive, for each assistant text that this window owns.

    Turns are in the order of turn, then role, then text; null turns come first; null
    roles and texts count as empty; repeated rows are turns of their own; null
    conversations are one conversation; an empty table has no windows.  Only a first
    turn with the role system is a system turn.  Other columns are ignored.
    """
    w = windows(turns, budget, history, conv_col, turn_col, role_col, text_col)
    turn = F.struct("place", "role", "text", "target")
    g = w.groupBy(conv_col, "window").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    pieces = F.transform("t", lambda x: F.concat(F.lit(START), x["role"], F.lit("\n"), x["text"], F.lit(END + "\n")))
    # Starts by prefix sums of the pieces' lengths, within a window, which the budget bounds.
    sizes = F.transform("t", lambda x: F.length(x["role"]) + F.length(x["text"]))
    fixed = len(START) + len(END) + 2
    starts = F.aggregate(
        F.zip_with("t", "sizes", lambda x, n: F.struct(x["role"].alias("role"), x["target"].alias("target"), F.length(x["role"]).alias("r"), n.alias("n"))),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("loss")),
        lambda a, x: F.struct(
            (a["at"] + x["n"] + fixed).alias("at"),
            F.when((x["role"] == "assistant") & x["target"], F.concat(a["loss"], F.array(F.struct((a["at"] + len(START) + x["r"] + 1).alias("start"), (a["at"] + len(START) + 1 + x["n"]).alias("end"))))).otherwise(a["loss"]).alias("loss"),
        ),
        lambda a: a["loss"],
    )
    return g.withColumn("sizes", sizes).select(conv_col, "window", F.array_join(pieces, "").alias("formatted"), F.size(F.filter("t", lambda x: ~x["target"])).alias("repeated"), starts.alias("loss"))


def read_back(formatted: Column, repeated: Column) -> Column:
    """The turns that a window owns, as (role, text), from its formatted text."""
    parts = F.slice(F.split(formatted, START.replace("|", r"\|"), -1), F.lit(2), F.lit(2**30))
    # The system turn stands before the history: in the first window it is owned, and nothing is repeated.
    own = F.slice(parts, repeated + 1, F.lit(2**30))
    body = F.transform(own, lambda p: F.substring(p, F.lit(1), F.length(p) - len(END) - 1))
    role = lambda p: F.substring_index(p, "\n", 1)
    return F.transform(body, lambda p: F.struct(unescaped_role(role(p)).alias("role"), unescaped(F.substring(p, F.length(role(p)) + 2, F.length(p))).alias("text")))


def with_probe(turns: DataFrame) -> DataFrame:
    """Conversation -1 beside the others: control strings from either side."""
    probe = turns.sparkSession.sql("SELECT -1L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS x(t, r)")
    return turns.select("conv_id", "turn", "role", "text").union(probe)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_chats(with_probe(table(spark, sf_dir, "conversations")))
    own = out.select(
        "conv_id",
        "window",
        F.length("formatted").cast("bigint").alias("chars"),
        read_back(F.col("formatted"), F.col("repeated")).alias("turns"),
        F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))).alias("loss"),
    )
    each = own.select(
        "conv_id",
        "window",
        "chars",
        F.size("turns").cast("bigint").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("t"),
        F.array_join("loss", "").alias("l"),
    )
    g = each.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("window", "t", "l"))).alias("w"))
    text, loss = F.array_join("w.t", ""), F.array_join("w.l", "")
    return g.select("conv_id", "n_turns", F.sha2(text, 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


# The backslash rule without lookahead: RE2 takes the rest into the match, and only the number of matches counts.
_RE2 = r"[<\[]\\*(?:" + _RESTS.replace("\\<", "<").replace("\\>", ">").replace("\\/", "/") + ")"

ORACLE = rf"""
WITH RECURSIVE src AS (
  SELECT CAST(conv_id AS BIGINT) AS conv, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
a AS (SELECT *, row_number() OVER w AS place, (strlen(text) + 3) // 4 + 4 AS n FROM src WINDOW w AS (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text)),
b AS (SELECT *, place = 1 AND role = 'system' AS sys FROM a),
c AS (SELECT *, greatest(512 - 96 - max(CASE WHEN sys THEN n ELSE 0 END) OVER (PARTITION BY conv), 128) AS cap, CASE WHEN sys THEN 0 ELSE n END AS own FROM b),
d AS MATERIALIZED (SELECT *, CAST(sum(own) OVER (PARTITION BY conv ORDER BY place) AS BIGINT) AS stop FROM c),
f AS (SELECT conv, place, CAST(0 AS BIGINT) AS base, CAST(0 AS BIGINT) AS win FROM d WHERE place = 1
  UNION ALL SELECT d.conv, d.place, CASE WHEN d.stop - f.base > d.cap AND d.stop - d.own > f.base THEN d.stop - d.own ELSE f.base END,
    f.win + CAST(d.stop - f.base > d.cap AND d.stop - d.own > f.base AS INTEGER) FROM f JOIN d ON d.conv = f.conv AND d.place = f.place + 1),
g AS (SELECT d.*, f.win FROM d JOIN f ON f.conv = d.conv AND f.place = d.place),
h AS (SELECT *, max(stop) OVER (PARTITION BY conv, win) AS win_end, max(win) OVER (PARTITION BY conv) AS last FROM g),
k AS (SELECT *, CASE WHEN sys THEN last + 1 WHEN win < last AND win_end - stop + own <= 96 THEN 2 ELSE 1 END AS times,
  length(role) + length(text) + len(regexp_extract_all(text, '{_RE2}')) + {len(START) + len(END) + 2} AS chars FROM h)
SELECT conv AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  coalesce(sha256(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant')), '{EMPTY_SHA256}') AS loss_sha256,
  CAST(sum(chars * times) AS BIGINT) AS formatted_chars
FROM k GROUP BY conv
"""
