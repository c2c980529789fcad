"""Chat formatting by prefix-target expansion, in built-in SQL functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text bears loss. A
conversation that does not end with an assistant turn also gives one example without a target, so that no turn is
lost.

Template: ``[INST] user [/INST]``, ``[SYS] system [/SYS]``, ``[REPLY] assistant</s>``, and for any other role
``[TURN role] text [/TURN]``. Control strings begin with ``[`` or ``<``; inside texts and role names these and the
escape sign are written ``\\l``, ``\\a`` and ``\\b``, in role names also ``]`` as ``\\r``, so neither holds a control string
and both read back unchanged.

Turns are ordered by turn, then role, then text; null turns first. A null role or text is empty, a null conv_id is a
conversation. Rows that repeat are turns each. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's marks by role.
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("[REPLY] ", "</s>")}
OTHER = ("[TURN ", "] ", " [/TURN]")


def escape(text: Column) -> Column:
    for raw, written in (("\\", "\\b"), ("[", "\\l"), ("<", "\\a")):
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for raw, written in (("[", "\\l"), ("<", "\\a"), ("]", "\\r"), ("\\", "\\b")):
        text = F.replace(text, F.lit(written), F.lit(raw))
    return text


def render(role: Column, text: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), F.replace(escape(role), F.lit("]"), F.lit("\\r")), F.lit(OTHER[1]), escape(text), F.lit(OTHER[2]))
    for name, (before, after) in MARKS.items():
        out = F.when(role == name, F.concat(F.lit(before), escape(text), F.lit(after))).otherwise(out)
    return out


def prefix_target_examples(talks: DataFrame) -> DataFrame:
    """conv_id, example (from 0), text, loss_start and loss_length (code points of the reply in text; null if none),
    last (the example that holds all turns)."""
    turns = talks.select(
        "conv_id",
        F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    whole = whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), render(t["role"], t["text"]).alias("seg"))).alias("s"))
    whole = whole.withColumn("segs", F.transform("s", lambda t: t["seg"])).withColumn("target", F.transform("s", lambda t: t["role"] == "assistant")).drop("s")
    n = F.size("segs")
    at = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("target", i) | (i == n))
    each = whole.select("conv_id", "segs", "target", F.posexplode(at).alias("example", "upto"))
    seg, is_target = F.element_at("segs", F.col("upto")), F.element_at("target", F.col("upto"))
    before, after = MARKS["assistant"]
    made = each.select(
        "conv_id", "example", F.array_join(F.slice("segs", F.lit(1), F.col("upto")), "").alias("text"), F.length(seg).alias("tail"), is_target.alias("is_target"), (F.col("upto") == n).alias("last")
    )
    return made.select(
        "conv_id", "example", "text",
        F.when(F.col("is_target"), F.length("text") - F.col("tail") + len(before)).alias("loss_start"),
        F.when(F.col("is_target"), F.col("tail") - len(before) - len(after)).alias("loss_length"),
        "last",
    )


def parsed(text: Column) -> Column:
    """Formatted text back to an array of (role, text)."""
    segs = F.split(text, "(?<=\\[/INST\\])|(?<=\\[/SYS\\])|(?<=\\[/TURN\\])|(?<=</s>)")
    segs = F.filter(segs, lambda s: s != "")

    def read(s: Column) -> Column:
        rest = F.substr(s, F.lit(len(OTHER[0]) + 1), F.length(s) - len(OTHER[0]) - len(OTHER[2]))
        end = F.instr(rest, OTHER[1])
        role = F.substr(rest, F.lit(1), end - 1)
        body = F.substr(rest, end + len(OTHER[1]), F.length(rest))
        out = F.struct(unescape(role).alias("role"), unescape(body).alias("text"))
        for name, (before, after) in MARKS.items():
            own = F.substr(s, F.lit(len(before) + 1), F.length(s) - len(before) - len(after))
            out = F.when(F.startswith(s, F.lit(before)), F.struct(F.lit(name).alias("role"), unescape(own).alias("text"))).otherwise(out)
        return out

    return F.transform(segs, read)


def digests(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation say, read back from their text: one row a conversation."""
    loss = unescape(F.expr("substring(text, loss_start + 1, loss_length)"))
    # Only the last example's text and every example's reply go on, so the long contexts are not gathered.
    small = examples.select("conv_id", "example", loss.alias("loss"), F.when(F.col("last"), F.col("text")).alias("whole"), F.length("text").cast("long").alias("chars"))
    per = small.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("example", F.coalesce("loss", F.lit("")).alias("loss")))).alias("replies"), F.max("whole").alias("whole"), F.sum("chars").alias("formatted_chars")
    )
    turns = per.select("conv_id", parsed(F.col("whole")).alias("turns"), F.array_join(F.transform("replies", lambda r: r["loss"]), "").alias("loss"), "formatted_chars")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
