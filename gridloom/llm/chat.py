"""Chat formatting by perspective rotation, in DataFrame functions only.

For every participant (role) of a conversation, the whole dialogue is rendered with that participant as the
assistant and all others as named users. What the participant says, with its end mark, is to be learned
(the loss spans); headers and others' turns are masked.

Turns are sorted, escaped and rendered in runs of RUN turn numbers, so a conversation that holds any share of
the rows is many groups of bounded size; only the finished runs are put together, into the one value that a rendering is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Turn numbers whose turns one group sorts and renders.
RUN = 64
END = "<|end|>\n"
UNKNOWN = "unknown"


def escaped(text: Column) -> Column:
    """``<|`` becomes ``<\\|`` (and ``<\\`` becomes ``<\\\\``), so no text can hold a mark of the format and the way back is unique."""
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))


def escaped_name(role: Column) -> Column:
    """As ``escaped``, and ``|>`` becomes ``|\\>`` likewise, so a name cannot end its header."""
    return F.replace(F.replace(escaped(role), F.lit("|\\"), F.lit("|\\\\")), F.lit("|>"), F.lit("|\\>"))


def rotate(turns: DataFrame, run: int = RUN) -> DataFrame:
    """conv_id, speaker, n_turns, rendered and loss_spans (start and length in characters of ``rendered``): one row per participant.

    Turns go by number (null first), then role and text. Rows alike in all four columns are one turn. A
    null text is empty; turns of a null role are a user named "unknown", who has no perspective of their
    own. A null conv_id is a conversation like others. An empty table gives no row. Other columns are ignored. A rendering
    is one value, as long as its dialogue, and must fit a task. ``run`` does not change the result.
    """
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(UNKNOWN)).alias("role"), F.col("role").isNull().alias("nameless"), F.coalesce("text", F.lit("")).alias("text"))
    parts = rows.groupBy("conv_id", F.floor(F.col("turn") / run).cast("long").alias("run")).agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text", "nameless"))).alias("turns"))
    parts = parts.select("conv_id", "run", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["nameless"].alias("nameless"), escaped_name(t["role"]).alias("name"), F.concat(escaped(t["text"]), F.lit(END)).alias("body"))).alias("turns"))
    who = rows.where("NOT nameless").select(F.col("conv_id").alias("who_conv"), F.col("role").alias("speaker")).distinct()
    each = parts.join(who, F.col("conv_id").eqNullSafe(F.col("who_conv"))).drop("who_conv")
    own = lambda t: ~t["nameless"] & (t["role"] == F.col("speaker"))
    header = lambda t: F.when(own(t), F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), t["name"], F.lit("|>\n")))
    pieces = F.transform("turns", lambda t: F.struct(own(t).alias("own"), header(t).alias("head"), t["body"].alias("body")))
    none = F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)")

    def step(state: Column, piece: Column) -> Column:
        at = state["at"] + F.length(piece["head"])
        length = F.length(piece["body"]).cast("long")
        span = F.array(F.struct(at.alias("start"), length.alias("length")))
        return F.struct((at + length).alias("at"), F.when(piece["own"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))
    done = each.withColumn("pieces", pieces).select(
        "conv_id", "speaker", "run", F.size("turns").alias("n"), F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
        F.aggregate("pieces", begin, step, lambda s: s["spans"]).alias("spans"),
    )
    whole = done.groupBy("conv_id", "speaker").agg(F.array_sort(F.collect_list(F.struct("run", "n", "text", "spans"))).alias("runs"))
    lengths = F.transform("runs", lambda r: F.length(r["text"]).cast("long"))
    starts = F.aggregate(lengths, F.array(F.lit(0).cast("long")), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
    moved = F.transform("runs", lambda r, k: F.transform(r["spans"], lambda s: F.struct((s["start"] + F.get("starts", k)).alias("start"), s["length"].alias("length"))))
    return whole.withColumn("starts", starts).select(
        "conv_id", "speaker", F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["n"]).alias("n_turns"), F.array_join(F.transform("runs", lambda r: r["text"]), "").alias("rendered"),
        F.flatten(moved).alias("loss_spans"),
    )
