"""Chat formatting: tool calls linked to their results, ordered, validated, as canonical JSON.

Results find their call by a hash join on (conversation, call id).  A message has at most one
message it must follow: a result its call, any other the one named in ``after``.  Depth and
readiness come from pointer doubling over these links, about log2 of the longest chain rounds,
each a written table, so no task ever holds a conversation.  Sorting by (``ready_turn``,
``level``) is a topological order that leaves a transcript as it is wherever it already is one.
Arguments are parsed as variants, whose objects keep their keys sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echosieve.llm.common import same
from echosieve.workspace import Workspace

#: Type names of a schema and how the type of a parsed value starts.
TYPES = {
    "string": ("STRING",), "integer": ("BIGINT",), "boolean": ("BOOLEAN",),
    "number": ("BIGINT", "DECIMAL", "DOUBLE"), "array": ("ARRAY",), "object": ("OBJECT",),
}


def validity(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """``valid``, or the first thing wrong with a call's arguments.

    ``schemas``: for each tool, argument name -> (type name of ``TYPES``, required).
    """
    parsed = F.try_parse_json(arguments)
    shape = F.schema_of_variant(parsed)
    result = F.lit("unknown tool")
    for tool, fields in schemas.items():
        extra = F.array_except(
            F.json_object_keys(arguments), F.array(*[F.lit(f) for f in fields]).cast("array<string>")
        )
        check = F.when(F.size(extra) > 0, F.concat(F.lit("unexpected "), F.array_min(extra)))
        for field, (kind, required) in sorted(fields.items()):
            value = F.try_variant_get(parsed, f"$['{field}']", "variant")
            there = F.schema_of_variant(value)
            wrong = ~F.greatest(*[F.startswith(there, F.lit(t)) for t in TYPES[kind]] * 2)
            if required:
                check = check.when(value.isNull(), F.lit(f"missing {field}"))
            check = check.when(value.isNotNull() & wrong, F.lit(f"{field} is not {kind}"))
        result = F.when(name == tool, check.otherwise("valid")).otherwise(result)
    return (
        F.when(parsed.isNull(), "not JSON")
        .when(~F.startswith(shape, F.lit("OBJECT")), "not an object")
        .otherwise(result)
    )


def _ordered(links: DataFrame, work: Workspace) -> DataFrame:
    """``(id, ready_turn, level)`` from ``links(id, turn, parent)``; in a cycle level is -1."""
    nodes = work.table(
        links.groupBy("id").agg(F.min("turn").alias("ready_turn"), F.min("parent").alias("parent")),
        "messages",
    )
    known = nodes.select(F.col("id").alias("parent")).withColumn("there", F.lit(True))
    state = work.table(nodes.join(known, "parent", "left").select(
        "id", "ready_turn", F.when(F.col("there"), F.col("parent")).alias("parent"),
        F.when(F.col("there"), 1).otherwise(0).alias("level"),
    ), "ordered")
    for _ in range(max(nodes.count(), 1).bit_length() + 1):  # beyond it only cycles are left
        if state.filter("parent is not null").isEmpty():
            break
        above = state.select(
            F.col("id").alias("parent"), F.col("ready_turn").alias("up_turn"),
            F.col("level").alias("up_level"), F.col("parent").alias("next"),
        )
        state = work.table(
            state.filter("parent is not null").join(above, "parent").select(
                "id", F.greatest("ready_turn", "up_turn").alias("ready_turn"),
                F.col("next").alias("parent"),
                F.least(F.col("level") + F.col("up_level"), F.lit(1 << 29)).alias("level"),
            ).unionByName(state.filter("parent is null")),
            "ordered",
        )
    return state.select(
        "id", "ready_turn",
        F.when(F.col("parent").isNull(), F.col("level")).otherwise(-1).alias("level"),
    )


def link_tools(messages: DataFrame, schemas: dict[str, dict], work: Workspace) -> DataFrame:
    """``(conv_id, id, ready_turn, level, link, arguments, json)``, one row per message.

    ``messages``: ``id`` (of the whole table), ``conv_id``, ``turn``, ``role``, ``kind``
    (``call``, ``result`` or other), ``call_id``, ``after`` (an id), ``name``, ``arguments``
    (JSON text), ``content``; other columns are ignored.

    * ``link``: ``answered`` or ``unanswered`` for a call, ``linked`` or ``orphan`` for a result,
      null for others.  Of calls with one id in a conversation the one of the lowest (turn, id)
      counts, later ones are ``repeated``.  Null call ids link to nothing.
    * ``arguments``: the validity of a call's arguments, else null.
    * ``json``: sorted keys, no blanks, nulls left out; arguments that are not JSON are left out.
    * Messages in a cycle of links have level -1 and the readiness of their own cycle.  A link to
      an unknown id does not count.  Rows that repeat an id share one place; null ids have none.
    """
    calls = messages.filter("kind = 'call' and call_id is not null").groupBy(
        F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call")
    ).agg(F.min(F.struct("turn", "id")).alias("first")).select(
        "_conv", "_call", F.col("first.id").alias("call_message")
    )
    answers = messages.filter("kind = 'result' and call_id is not null").select(
        F.col("conv_id").alias("_conv2"), F.col("call_id").alias("_call2")
    ).distinct().withColumn("answered", F.lit(True))
    linked = messages.join(
        calls, same(F.col("conv_id"), F.col("_conv")) & (F.col("call_id") == F.col("_call")), "left"
    ).join(
        answers,
        same(F.col("conv_id"), F.col("_conv2")) & (F.col("call_id") == F.col("_call2")), "left",
    )
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    link = (
        F.when(is_result, F.when(F.col("call_message").isNull(), "orphan").otherwise("linked"))
        .when(is_call & (F.col("call_message") != F.col("id")), "repeated")
        .when(is_call, F.when(F.col("answered"), "answered").otherwise("unanswered"))
    )
    parent = F.when(is_result, F.col("call_message")).otherwise(F.col("after"))
    table = work.table(linked.select(
        *[c for c in ("id", "conv_id", "turn", "role", "kind", "call_id", "name", "arguments",
                      "content")],
        link.alias("link"), parent.alias("parent"),
    ), "linked")
    order = _ordered(table.filter("id is not null").select("id", "turn", "parent"), work)
    fields = F.struct(
        F.try_parse_json(F.when(is_call, F.col("arguments"))).alias("arguments"),
        *[F.col(c) for c in ("call_id", "content", "kind", "name", "role", "turn")],
    )
    return table.join(order, "id", "left").select(
        "conv_id", "id", "ready_turn", "level", "link",
        F.when(is_call, validity(F.col("name"), F.col("arguments"), schemas)).alias("arguments"),
        F.to_json(fields).alias("json"),
    )


def exchanges(conversations: DataFrame) -> DataFrame:
    """Messages for ``link_tools`` out of plain conversations.

    A user turn is a call of the tool ``reply``, an assistant turn the result of the turn before
    it, and every turn follows the one before.
    """
    place = lambda turn: F.concat_ws(":", F.col("conv_id"), turn)
    before = place(F.col("turn") - 1)
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return conversations.select(
        place(F.col("turn")).alias("id"), "conv_id", F.col("turn").cast("long").alias("turn"),
        "role",
        F.when(user, "call").when(assistant, "result").otherwise("message").alias("kind"),
        F.when(user, place(F.col("turn"))).when(assistant, before).alias("call_id"),
        before.alias("after"),
        F.when(user, F.lit("reply")).alias("name"),
        F.when(user, F.to_json(F.struct(
            words.alias("words"), text.alias("prompt")
        ))).alias("arguments"),
        F.when(~user | user.isNull(), F.col("text")).alias("content"),
    )
