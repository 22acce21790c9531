"""Operator 1: quotation linking, with DataFrame functions only.

Lines are read with their quote level; runs of one level are passages. A quoted passage, and each of its lines, is
normalised and hashed and looked up among the passages and lines that messages of the same conversation wrote themselves:
the first message that wrote it is its origin, so a hash has one origin and no group of equal lines is multiplied. The
passages of the outermost level name a message's parent; from the parents each message gets its thread and level.

Defined results: null text counts as empty; rows equal in ``conv_id, turn, role, text`` count once; a message whose quotes
are found nowhere, or without quotes, starts a thread; among parents the one with most quoted characters, then the latest,
wins; null ``conv_id`` or ``turn`` links with nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

_MARK = r"^(?:[ \t]*>)+ ?"
_WROTE = r"(?i)^\s*(on\s.{0,300})?\S.{0,120}wrote:\s*$"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def quoted_replies(turns: DataFrame) -> DataFrame:
    """Mails out of chat turns: each turn quotes the one before, and at a second level the one before that."""
    own = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).distinct()
    one = own.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    back = lambda k: one.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("said").alias(f"said_{k}"))
    quote = lambda c, mark: F.regexp_replace(c, r"(?m)^", mark)
    mail = own.join(back(1), ["conv_id", "turn"], "left").join(back(2), ["conv_id", "turn"], "left")
    text = F.concat_ws("\n", F.when(F.col("said_1").isNotNull(), F.lit("They wrote:")), F.when(F.col("said_1").isNotNull() & F.col("said_2").isNotNull(), quote(F.col("said_2"), ">> ")), quote(F.col("said_1"), "> "), F.col("text"))
    return mail.select("conv_id", "turn", "role", text.alias("text"))


def passages(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, msg, run, level, body``: the passages of each message in order, attribution lines left out."""
    lines = messages.select("conv_id", "turn", "msg", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line"))
    lines = lines.select("conv_id", "turn", "msg", "pos", F.length(F.regexp_replace(F.regexp_extract("line", _MARK, 0), r"[^>]", "")).alias("level"), F.regexp_replace("line", _MARK, "").alias("body"))
    one = Window.partitionBy("conv_id", "turn", "msg").orderBy("pos")  # a message's own lines
    lines = (lines.withColumn("next", F.lead("level").over(one)).where(~(F.col("body").rlike(_WROTE) & (F.col("next") > F.col("level"))))
             .withColumn("run", F.sum(F.when(F.col("level") != F.lag("level").over(one), 1).otherwise(0)).over(one)))
    return (lines.groupBy("conv_id", "turn", "msg", "run", "level").agg(F.sort_array(F.collect_list(F.struct("pos", "body"))).alias("l"))
            .select("conv_id", "turn", "msg", "run", "level", F.array_join(F.transform("l", lambda x: x["body"]), "\n").alias("body")).where(F.length(F.trim(F.regexp_replace("body", r"\s+", " "))) > 0))


def _units(parts: DataFrame) -> DataFrame:
    """A passage as a whole and line by line, each with the hash of its normal form."""
    pieces = F.array_union(F.array(F.struct(F.lit(True).alias("whole"), _normal(F.col("body")).alias("t"))),
                           F.transform(F.split("body", "\n"), lambda x: F.struct(F.lit(False).alias("whole"), _normal(x).alias("t"))))
    return (parts.select("conv_id", "turn", "msg", "run", "level", F.explode(pieces).alias("u")).where(F.length("u.t") > 0)
            .select("conv_id", "turn", "msg", "run", "level", F.col("u.whole").alias("whole"), F.length("u.t").alias("chars"), F.md5(F.col("u.t")).alias("hash")))


def link(messages: DataFrame) -> DataFrame:
    """One row per message: text without quotes, its quotes and origins, parent, thread (its first turn) and level."""
    messages = messages.select("conv_id", "turn", "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct().withColumn("msg", F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in ("conv_id", "turn", "role", "text")])))
    parts = stored(passages(messages), "passages")
    units = _units(parts)
    origin = units.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    met = units.where("level > 0").join(origin, ["conv_id", "hash"]).where("origin < turn")
    of_run = met.groupBy("conv_id", "turn", "msg", "run", "level").agg(F.max(F.struct("whole", "chars", "origin")).alias("m"), F.sum(F.when(~F.col("whole"), F.col("chars"))).alias("line_chars"))
    of_run = of_run.select("conv_id", "turn", "msg", "run", "level", F.col("m.origin").alias("origin"), F.greatest("m.chars", F.coalesce("line_chars", F.lit(0))).alias("chars"))
    linked = (of_run.groupBy("msg").agg(F.count(F.lit(1)).alias("n_linked"), F.min("level").alias("outer"), F.max(F.struct((-F.col("level")).alias("l"), "chars", "origin")).alias("best"), F.sort_array(F.collect_set("origin")).alias("origins")))
    own = (parts.groupBy("msg").agg(F.sort_array(F.collect_list(F.when(F.col("level") == 0, F.struct("run", "body")))).alias("l"), F.count(F.when(F.col("level") > 0, 1)).alias("n_quotes"), F.max("level").alias("max_level"))
           .select("msg", F.regexp_replace(F.array_join(F.transform("l", lambda x: x["body"]), "\n"), r"^\s+|\s+$", "").alias("reply"), "n_quotes", "max_level"))
    rows = stored(messages.select("conv_id", "turn", "role", "msg").join(own, "msg", "left").join(linked, "msg", "left")
                  .select("conv_id", "turn", "role", "msg", F.coalesce("reply", F.lit("")).alias("text"), F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
                          F.coalesce("max_level", F.lit(0)).alias("quote_level"), F.coalesce("origins", F.array().cast("array<bigint>")).alias("origins"), F.col("best.origin").alias("parent_turn")), "linked")
    threads = _threads(rows.groupBy("conv_id", "turn").agg(F.max("parent_turn").alias("parent")))
    return (rows.join(threads, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", "text", "n_quotes", "n_linked", "quote_level", "origins", "parent_turn", F.coalesce("thread", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).alias("thread_level"))
            .orderBy("conv_id", "thread_turn", "thread_level", "turn"))


def _threads(parents: DataFrame) -> DataFrame:
    """First turn and depth of each message, by doubling the steps up the parents until all stand at a first turn."""
    now = stored(parents.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.coalesce("parent", "turn").alias("thread"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth")), "threads")
    while True:
        up = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("above"), F.col("depth").alias("more"))
        after = stored(now.join(up, ["conv_id", "thread"]).select("conv_id", "turn", F.col("above").alias("thread"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")), "threads")
        if after.where("moved").isEmpty():
            return after.drop("moved")
        now = after.drop("moved")
