"""Chat transcripts as training examples by prefix-target expansion.

A turn is written as ``### role``, a line break, the text, ``</turn>`` and a
line break. Inside roles and texts the control strings are replaced by codes:
a backslash by ``\\s``, ``###`` by ``\\h``, ``</turn>`` by ``\\e`` and, in roles
only, a line break by ``\\n``. Every backslash of the output starts a code, so
the codes are taken back one after the other, the backslash last.

Every assistant turn becomes an example of its own: all turns before it are the
context and only the reply's text is trainable. Turns after the last assistant
turn are in one more example without a trainable part, so that no turn of a
conversation is missing from the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HEAD, TAIL = "### ", "</turn>\n"
CODES = (("###", "\\h"), ("</turn>", "\\e"))


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\s"))
    for plain, code in CODES + ((("\n", "\\n"),) if role else ()):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescaped(text: Column) -> Column:
    out = text
    for plain, code in CODES + (("\n", "\\n"), ("\\", "\\s")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def formatted(role: Column, text: Column) -> Column:
    return F.concat(
        F.lit(HEAD), escaped(role, True), F.lit("\n"), escaped(text), F.lit(TAIL)
    )


def examples(df: DataFrame, trainable: str = "assistant") -> DataFrame:
    """One row per example of each conversation.

    ``df`` has conv_id, turn, role and text; other columns are not used. Nulls
    in role and text count as empty, a null conv_id is a conversation of its
    own, null turns come first; rows of one turn are ordered by role and text
    and stay separate turns. An empty table has no examples.

    Returns conv_id, example (from 0), last (it holds the whole conversation),
    text, and the trainable characters of text as loss_start and loss_end
    (code points, end excluded; equal where nothing is trainable).
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    turns = df.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            role.alias("role"),
            text.alias("text"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    parts = whole.select(
        "conv_id",
        F.transform(
            "ts",
            lambda t: F.struct(
                (t["role"] == trainable).alias("train"),
                formatted(t["role"], t["text"]).alias("part"),
                F.length(escaped(t["text"])).alias("chars"),
            ),
        ).alias("ps"),
    )
    # cumulative characters, and where each example ends; one pass over the turns
    zero = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.array().cast("array<struct<end:bigint,chars:int>>").alias("ends"),
    )

    def step(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p["part"])
        cut = F.array(F.struct(end.alias("end"), p["chars"].alias("chars")))
        return F.struct(
            end.alias("at"),
            F.when(p["train"], F.concat(acc["ends"], cut)).otherwise(acc["ends"]).alias("ends"),
        )

    told = parts.select(
        "conv_id",
        F.array_join(F.transform("ps", lambda p: p["part"]), "").alias("full"),
        F.aggregate("ps", zero, step).alias("a"),
    )
    rest = F.array(F.struct(F.col("a.at").alias("end"), F.lit(-1).alias("chars")))
    has_rest = (F.size("a.ends") == 0) | (F.element_at("a.ends", -1)["end"] < F.col("a.at"))
    cuts = told.select(
        "conv_id",
        "full",
        F.col("a.at").alias("at"),
        F.when(has_rest, F.concat("a.ends", rest)).otherwise(F.col("a.ends")).alias("cuts"),
    )
    each = cuts.select("conv_id", "full", "at", F.posexplode("cuts").alias("example", "cut"))
    end, chars = F.col("cut.end"), F.col("cut.chars")
    loss_end = F.when(chars < 0, end).otherwise(end - len(TAIL))
    return each.select(
        "conv_id",
        "example",
        (end == F.col("at")).alias("last"),
        F.substring("full", F.lit(1), end.cast("int")).alias("text"),
        F.when(chars < 0, end).otherwise(loss_end - chars).alias("loss_start"),
        loss_end.alias("loss_end"),
    )


def read_back(text: Column) -> Column:
    """The (role, text) turns of a formatted text."""
    parts = F.split(text, F.lit(TAIL))
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def one(p: Column) -> Column:
        line = F.locate("\n", p)
        return F.struct(
            unescaped(F.substr(p, F.lit(len(HEAD) + 1), line - len(HEAD) - 1)).alias("role"),
            unescaped(F.substr(p, line + 1)).alias("text"),
        )

    return F.transform(turns, one)


def digest(found: DataFrame) -> DataFrame:
    """Per conversation, what its examples say when they are read back."""
    loss = F.when(
        F.col("loss_end") > F.col("loss_start"),
        unescaped(
            F.substring(
                "text",
                (F.col("loss_start") + 1).cast("int"),
                (F.col("loss_end") - F.col("loss_start")).cast("int"),
            )
        ),
    ).otherwise(F.lit(""))
    rows = found.select(
        "conv_id",
        F.length("text").alias("chars"),
        F.struct("example", loss.alias("loss")).alias("l"),
        F.when(F.col("last"), F.col("text")).alias("whole"),
    )
    conv = rows.groupBy("conv_id").agg(
        F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list("l")).alias("ls"),
        F.max("whole").alias("whole"),
    )
    told = conv.select(
        "conv_id",
        "formatted_chars",
        F.array_join(F.transform("ls", lambda x: x["loss"]), "").alias("loss"),
        read_back(F.col("whole")).alias("turns"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return told.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
