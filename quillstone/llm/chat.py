"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A turn is written ``### role: text </turn>`` and a newline. Control strings inside roles and texts are replaced by codes of a backslash and
a letter (CODES), each backslash too, so no text can end or begin a turn, and what was written is read back unchanged.

Every trained turn becomes an example of its own: all turns before it as context, and the mask over its own text only, neither its
header nor its end. What follows the last trained turn is an example without a mask, so that no turn is lost. The
places of masks are running sums of a window over the conversation; the conversation is put together once, and its examples are beginnings
of that text, made by ``explode`` in the same stage: one shuffle, of the turns alone.

Defined results: turns are ordered by number, null first, ties by role and text; equal rows are turns of their own; a null text or role is
empty; null keys are one conversation; an empty table gives no example; texts may be as long as a row may; further columns, whatever their names,
are left aside. All examples of a conversation are together as long as the square of its turns: that is the method; a conversation is one row
when it is expanded, so it has to fit in one (2 GB).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, BETWEEN, END = "### ", ": ", " </turn>\n"
#: What is replaced, and by what; the backslash first, and last on the way back.
CODES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"))
#: Roles end at the first colon.
ROLE_CODES = (*CODES, (":", "\\c"))


def escaped(column: Column, codes: tuple[tuple[str, str], ...] = CODES) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), codes, column)


def unescaped(column: Column, codes: tuple[tuple[str, str], ...] = CODES) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[1]), F.lit(pair[0])), reversed(codes), column)


def examples(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """``key``, ``example`` (from 1), ``last`` (whether the conversation has no further one), ``text``, and the code points [mask_begin, mask_end) of
    it that are trained, null in an example without a target."""
    rows = turns.select(F.col(key).alias("k"), F.col(turn).alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))))
    rows = rows.withColumns({"head": F.concat(F.lit(BEGIN), escaped(F.col("role"), ROLE_CODES), F.lit(BETWEEN)), "body": escaped(F.col("text"))})
    size = F.length("head") + F.length("body") + F.lit(len(END))
    so_far = F.sum(size.cast("long")).over(Window.partitionBy("k").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("stop", so_far)
    piece = F.struct("stop", (F.col("stop") - F.lit(len(END))).alias("end"), F.length("body").alias("n"), (F.col("role") == trained).alias("is_target"), F.concat("head", "body", F.lit(END)).alias("piece"))
    whole = rows.groupBy("k").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))  # no piece is empty, so ``stop`` orders them
    whole = whole.select("k", F.array_join(F.col("pieces.piece"), "").alias("all"), F.transform("pieces", lambda p: p.dropFields("piece")).alias("pieces"))
    final = F.element_at("pieces", -1)["stop"]
    targets = F.filter("pieces", lambda p: p["is_target"] | (p["stop"] == final))
    each = whole.select("k", "all", F.size(targets).alias("count"), F.posexplode(targets).alias("at", "p"))
    return each.select(
        F.col("k").alias(key),
        (F.col("at") + 1).alias("example"),
        (F.col("at") + 1 == F.col("count")).alias("last"),
        F.substring("all", F.lit(1), F.col("p.stop").cast("int")).alias("text"),
        F.when(F.col("p.is_target"), F.col("p.end") - F.col("p.n")).alias("mask_begin"),
        F.when(F.col("p.is_target"), F.col("p.end")).alias("mask_end"),
    )


def turns_of(text: Column) -> Column:
    """array<struct<role,text>> of an example, read back from its text."""
    written = F.slice(F.split(text, "</turn>\n", -1), 1, F.greatest(F.size(F.split(text, "</turn>\n", -1)) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        colon = F.instr(piece, ":")
        role = F.substring(piece, F.lit(len(BEGIN) + 1), colon - len(BEGIN) - 1)
        said = F.substring(piece, colon + len(BETWEEN), F.length(piece) - colon - len(BETWEEN))
        return F.struct(unescaped(role, ROLE_CODES).alias("role"), unescaped(said).alias("text"))

    return F.transform(written, turn)


def masked(text: Column, begin: Column, end: Column) -> Column:
    """The trained text of an example, unescaped; null where there is none."""
    return unescaped(F.substring(text, (begin + 1).cast("int"), (end - begin).cast("int")))


def digest(found: DataFrame, key: str = "conv_id") -> DataFrame:
    """What ``examples`` gives, read back: turns from the last example of each conversation, trained texts from all its examples. The examples of
    a conversation are where it was expanded, so nothing is shuffled, and of the texts only the last and the trained parts are held."""
    trained = F.struct("example", masked(F.col("text"), F.col("mask_begin"), F.col("mask_end")).alias("said"))
    slim = found.select(key, F.when(F.col("last"), F.col("text")).alias("whole"), trained.alias("trained"), F.length("text").cast("long").alias("n"))
    per = slim.groupBy(key).agg(F.max("whole").alias("whole"), F.sort_array(F.collect_list("trained")).alias("trained"), F.sum("n").alias("formatted_chars"))
    per = per.select(key, turns_of(F.col("whole")).alias("turns"), F.array_join(F.col("trained.said"), "").alias("loss"), "formatted_chars")
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select(
        key,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
