"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template. ``open`` marks a turn by role; other roles are written between ``other``'s two strings.
#: ``loss`` names the roles whose texts are learned. ``next`` gives, for each state, the roles that may
#: follow and the state each leads to; ``ends`` the states a whole conversation may end in.
TEMPLATE = {
    "begin": "<s>",
    "open": {"system": "[SYS]", "user": "[INST]", "assistant": "[/INST]"},
    "other": ("[ROLE]", "[/ROLE]"),
    "close": "</s>",
    "loss": ["assistant"],
    "escape": "\\",
    "start": "start",
    "next": {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}},
    "ends": ["assistant"],
}


def controls(template: dict) -> list[str]:
    """The strings that must not occur inside a text; at most nine, as each gets a one-digit code."""
    found = list(dict.fromkeys([template["begin"], template["close"], *template["open"].values(), *template["other"]]))
    assert len(found) < 10 and not any(template["escape"] in x or x.isdigit() for x in found)
    return found


def escaped(text: Column, template: dict = TEMPLATE) -> Column:
    """``text`` with the escape character as its code 0 and each control string as its own code."""
    e = template["escape"]
    out = F.replace(text, F.lit(e), F.lit(f"{e}0"))
    for k, x in enumerate(controls(template), 1):
        out = F.replace(out, F.lit(x), F.lit(f"{e}{k}"))
    return out


def unescaped(text: Column, template: dict = TEMPLATE) -> Column:
    """The inverse of ``escaped``: every escape character is followed by its code, and 0 goes last."""
    e = template["escape"]
    out = text
    for k, x in enumerate(controls(template), 1):
        out = F.replace(out, F.lit(f"{e}{k}"), F.lit(x))
    return F.replace(out, F.lit(f"{e}0"), F.lit(e))


def _marker(role: Column, template: dict) -> Column:
    out = F.concat(F.lit(template["other"][0]), escaped(role, template), F.lit(template["other"][1]))
    for name, mark in template["open"].items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def _run_machine(turns: Column, template: dict) -> Column:
    """struct(state, bad): the state after all turns, and the index of the first turn out of order or null."""
    moves = {f"{s}>{r}": t for s, to in template["next"].items() for r, t in to.items()}
    table = F.create_map(*(F.lit(x) for pair in moves.items() for x in pair))

    def step(acc: Column, t: Column) -> Column:
        to = F.try_element_at(table, F.concat(acc["state"], F.lit(">"), t["role"]))
        # A turn out of order is noted once; the machine then goes on from that turn's role.
        return F.struct(
            F.coalesce(to, t["role"]).alias("state"),
            F.coalesce(acc["bad"], F.when(to.isNull(), acc["at"])).alias("bad"),
            (acc["at"] + 1).alias("at"),
        )

    zero = F.struct(F.lit(template["start"]).alias("state"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("at"))
    return F.aggregate(turns, zero, step)


def format_chats(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: dict = TEMPLATE
) -> DataFrame:
    """One row a conversation: (conv_col, segments array<struct<text, loss>>, valid, first_bad_turn).

    Turns go by (turn, role, text), nulls first, so repeated rows and ties have a fixed order and all stay.
    Null texts and roles are empty; a null conv_id is a conversation of its own. Each turn gives three
    segments: marker, escaped text, close; only texts of ``loss`` roles carry the flag. ``valid`` is
    whether the machine accepts the order of roles; every conversation is formatted either way. Roles
    unknown to the template are written out and are out of order. Extra columns are not read.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    grouped = rows.select(F.col(conv_col).alias("_conv"), turn.alias("_t")).groupBy("_conv").agg(F.sort_array(F.collect_list("_t")).alias("_turns"))
    segments = F.flatten(
        F.transform(
            "_turns",
            lambda t: F.array(
                F.struct(_marker(t["role"], template).alias("text"), F.lit(False).alias("loss")),
                F.struct(escaped(t["text"], template).alias("text"), t["role"].isin(template["loss"]).alias("loss")),
                F.struct(F.lit(template["close"]).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    first = F.array(F.struct(F.lit(template["begin"]).alias("text"), F.lit(False).alias("loss")))
    ran = grouped.withColumn("_end", _run_machine(F.col("_turns"), template))
    return ran.select(
        F.col("_conv").alias(conv_col),
        F.concat(first, segments).alias("segments"),
        (F.col("_end.bad").isNull() & F.col("_end.state").isin(template["ends"])).alias("valid"),
        F.col("_end.bad").alias("first_bad_turn"),
    )


def formatted_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def parse_chats(text: Column, template: dict = TEMPLATE) -> Column:
    """array<struct<role, text>> read back from one formatted conversation."""
    body = F.substring(text, len(template["begin"]) + 1, 2**31 - 1)
    close = template["close"]
    pieces = F.split(body, "\\Q" + close + "\\E")
    pieces = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))  # what follows the last close is empty
    left, right = template["other"]

    def turn(p: Column) -> Column:
        cut = F.instr(p, right)
        role = unescaped(F.substring(p, F.lit(len(left) + 1), cut - len(left) - 1), template)
        rest = F.substring(p, cut + len(right), F.length(p))
        for name, mark in template["open"].items():
            hit = F.startswith(p, F.lit(mark))
            role = F.when(hit, F.lit(name)).otherwise(role)
            rest = F.when(hit, F.substring(p, F.lit(len(mark) + 1), F.length(p))).otherwise(rest)
        return F.struct(role.alias("role"), unescaped(rest, template).alias("text"))

    return F.transform(pieces, turn)


def chat_digests(formatted: DataFrame, conv_col: str = "conv_id", template: dict = TEMPLATE) -> DataFrame:
    """What a reader of ``format_chats``'s output finds: turns by parsing the text, learned text by its flags."""
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")
    read = formatted.select(conv_col, "valid", formatted_text(F.col("segments")).alias("_f"), learned.alias("_l")).withColumn("_t", parse_chats(F.col("_f"), template))
    told = F.array_join(F.transform("_t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        conv_col,
        F.size("_t").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("_l").cast("long").alias("loss_chars"),
        F.sha2("_l", 256).alias("loss_sha256"),
        F.length("_f").cast("long").alias("formatted_chars"),
        F.col("valid").alias("in_order"),
    )
