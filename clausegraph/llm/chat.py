"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns get their place and the running sum of tokens before them.  The sums cut
a conversation into strides of what the history and the system turn leave of
the budget: a turn is new in the window of the stride in which it begins, one
that overhangs its stride in a window of its own, so windows hold whole turns.
Later windows repeat the system turn and the last turns that fit into `history`
tokens.  Loss falls on assistant turns where they are new, nowhere else.

A turn is written `<|im_start|>role`, a line feed, the text, `<|im_end|>`, a
line feed.  A backslash goes before each backslash and between `<` and `|`, in
roles also before a line feed; so no control string stands inside a text, and
dropping the backslashes gives it back.

A window's turns have no more tokens than the budget, however long their
conversation, unless its only new turn is longer than its room.  Sums and
windows are worked out on rows without texts, range partitioned by conversation
and turn; a text joins its windows once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegraph.llm.ordered import running_totals
from clausegraph.plans.lineage import cut

BUDGET, HISTORY = 1024, 256
#: Tokens that the template adds to a turn.
OVERHEAD = 4
#: What counts as one token of a text: a rough measure, the same everywhere.
TOKEN = r"\p{L}{1,6}|\p{N}{1,3}|[^\p{L}\p{N}\x00-\x20]"
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, formatted, loss, n_context) of all windows.

    `loss` are the code point ranges [first, last) of the new assistant texts,
    escaped as they stand; `n_context` counts the turns at the front that are
    repeated from earlier windows.  Turns are ordered by turn (null first),
    then role and text; a null role or text is empty; rows with a null conv_id
    make up one conversation; repeated rows are turns of their own.

    A window has no more than `budget` tokens, the system turn and the history
    included, unless its only new turn is longer than the room that these leave.
    """
    if not 0 <= history <= budget // 2:
        raise ValueError("the history must fit into half of the budget")
    base = turns.select(
        F.concat(F.when(F.col("conv_id").isNull(), "null").otherwise("id"), F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).alias("key"),
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("tokens", F.lit(OVERHEAD) + F.regexp_count("text", F.lit(TOKEN)))
    summed = running_totals(base, ["key", "turn", "role", "text"], {"before": F.col("tokens"), "row": F.lit(1)})
    slim = cut(summed.select("row", "key", (F.col("role") == "system").alias("_system"), "tokens", "before"))
    first_row = F.min_by(F.struct("before", F.when(F.col("_system"), F.col("tokens")).otherwise(0).alias("system")), "row").alias("_first")
    whole = slim.groupBy("key").agg(F.min("row").alias("_row"), first_row)
    first = F.col("before") - F.col("_first.before")
    placed = slim.join(whole, "key").select(
        "key", "row", (F.col("row") - F.col("_row")).alias("place"), first.alias("first"), (first + F.col("tokens")).alias("last"),
        F.col("_first.system").alias("system"), ((F.col("row") == F.col("_row")) & F.col("_system")).alias("is_system"),
    )
    # the system turn stands before the first stride
    room = F.greatest(F.lit(budget - history) - F.col("system"), F.lit(1))
    begins, ends = (F.greatest(F.col(c) - F.col("system"), F.lit(0)) for c in ("first", "last"))
    overhangs = (ends > (F.floor(begins / room) + 1) * room).cast("int")
    placed = cut(placed.withColumn("window", 2 * F.floor(begins / room) + overhangs))
    opens = placed.groupBy("key", "window").agg(F.min("first").alias("opens"))
    columns = ["row", "key", "place", "window"]
    new = placed.select(*columns, F.lit(False).alias("repeated"))
    recent = _before_windows(placed.filter("not is_system"), opens, history).select(*columns, F.lit(True).alias("repeated"))
    system = placed.filter("is_system").drop("window").join(opens.filter("window > 0"), "key").select(*columns, F.lit(True).alias("repeated"))
    said = summed.select("row", "conv_id", "role", "text").join(new.unionByName(recent).unionByName(system), "row")
    whole_turns = F.array_sort(F.collect_list(F.struct("place", "repeated", "role", "text")))
    parts = said.groupBy("key", "window").agg(
        F.first("conv_id").alias("conv_id"), whole_turns.alias("turns")
    )
    written = parts.select(
        "key", "conv_id", "window",
        F.transform(
            "turns",
            lambda t: F.struct(
                F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"),
                escape(t["text"]).alias("body"),
                ((t["role"] == "assistant") & ~t["repeated"]).alias("learn"),
                t["repeated"].alias("repeated"),
            ),
        ).alias("turns"),
    )
    tail = F.lit(END + "\n")
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<first:int,last:int>>)").alias("loss")),
        lambda a, t: F.struct(
            (a["at"] + F.char_length(t["head"]) + F.char_length(t["body"]) + len(END) + 1).alias("at"),
            F.when(
                t["learn"],
                F.array_append(
                    a["loss"],
                    F.struct(
                        (a["at"] + F.char_length(t["head"])).alias("first"),
                        (a["at"] + F.char_length(t["head"]) + F.char_length(t["body"])).alias("last"),
                    ),
                ),
            ).otherwise(a["loss"]).alias("loss"),
        ),
    )
    return written.select(
        "conv_id", "key", "window",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], tail)), "").alias("formatted"),
        spans["loss"].alias("loss"),
        F.size(F.filter("turns", lambda t: t["repeated"])).alias("n_context"),
    )


def _before_windows(turns: DataFrame, opens: DataFrame, history: int) -> DataFrame:
    """The turns that lie within `history` tokens before a window opens, with its number as `window`.

    Both sides meet in buckets of `history` tokens, so a turn meets the windows near it only.
    """
    size = max(history, 1)
    bucket = F.floor(F.col("first") / size)
    near = turns.drop("window").withColumn("_bucket", F.explode(F.array(bucket, bucket + 1)))
    return near.join(opens.withColumn("_bucket", F.floor(F.col("opens") / size)), ["key", "_bucket"]).filter(
        (F.col("first") < F.col("opens")) & (F.col("opens") - F.col("first") <= history)
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """What formatted windows say: per conversation its turns and the text under the loss mask.

    Gives (conv_id, n_turns, turns, learned, formatted_chars): `turns` is role,
    line feed, text, line feed of every turn in order, `learned` all text under
    the mask, both unescaped.  Turns are parsed from the formatted text.
    """
    pieces = F.slice(F.split("formatted", r"\Q" + END + "\n" + r"\E", -1), F.col("n_context") + 1, F.lit(1 << 30))
    fresh = F.filter(pieces, lambda p: p != "")
    header = r"(?s)^\Q" + START + r"\E((?:[^\\\n]|\\.)*+)\n(.*)$"
    said = F.transform(
        fresh,
        lambda p: F.concat(
            unescape(F.regexp_extract(p, header, 1)), F.lit("\n"), unescape(F.regexp_extract(p, header, 2)), F.lit("\n")
        ),
    )
    learned = F.transform(
        "loss", lambda s: unescape(F.substring(F.col("formatted"), s["first"] + 1, s["last"] - s["first"]))
    )
    each = windows.select(
        "key", "conv_id", "window", F.size(fresh).alias("n"), F.array_join(said, "").alias("said"),
        F.array_join(learned, "").alias("learned"), F.char_length("formatted").alias("chars"),
    )
    # a digest of a whole conversation needs its text in one row
    return (
        each.groupBy("key")
        .agg(
            F.first("conv_id").alias("conv_id"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
            F.array_sort(F.collect_list(F.struct("window", "said", "learned"))).alias("parts"),
        )
        .select(
            "conv_id", "n_turns",
            F.array_join(F.col("parts.said"), "").alias("turns"),
            F.array_join(F.col("parts.learned"), "").alias("learned"),
            "formatted_chars",
        )
    )
