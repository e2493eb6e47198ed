"""Chat formatting with linked tool calls, in DataFrame functions only.

``conversations(conv_id, turn, role, text)`` gives one record per message, tool definition, tool call and tool result. A turn
whose text is a JSON object with an array ``tools`` (definitions: name, parameters as JSON schema) or ``tool_calls`` (id, name,
arguments) is an envelope, as is one of the role ``tool`` with a ``tool_call_id``. All other texts, JSON or not, are messages
as they stand, character by character.

- Results meet calls in a hash join on (conversation, identifier); both sides are unique or aggregated first, so one
  identifier used often gives no more rows than it has.
- Topological order: ``(at_turn, at_call, step, turn)`` puts definitions before the message of their turn, calls after it, and each
  result behind its call, also where the result was logged before the call. It is a sort key of each record, so a conversation is never gathered in one task.
- Each distinct call is validated once, one job per level of nesting: a level holds (rule, value) pairs, gives the errors of
  these pairs, and its children are the next level. Checked: type (one or a list), enum, const, required, properties,
  additionalProperties (false or a schema), items, minimum, maximum, exclusiveMinimum, exclusiveMaximum, minLength, maxLength, minItems,
  maxItems, uniqueItems. Other keywords (references, combinations, patterns, formats) are not. Errors read ``keyword path``, sorted.
- ``json`` is canonical: keys sorted, no blanks; records of a conversation in the order of the key are the formatted chat. Keys of an
  envelope without a meaning here are kept under ``extra``.

Cases: a null text is a message with null content; an empty text one with empty content. Repeated turns stay, with equal keys. A
repeated call identifier links to its first call (``repeated`` marks the others); a result without a call has the status ``orphan`` and stays
at its own turn; a call without a result is ``open``; a call of an undefined tool is valid with ``undefined tool`` noted. A tool defined twice
counts as its last definition (``replaced`` marks the others). An entry of ``tools`` or ``tool_calls`` that is no object has neither name nor
identifier. Numbers are compared as doubles, and 1.0 is an integer. Null conversations link with nothing. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import stage


def _get(value: Column | str, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


#: Keys of an envelope that have a meaning of their own.
MEANT = ("content", "tool_call_id", "tool_calls", "tools")

RECORD = ("conv_id", "at_turn", "at_call", "step", "turn", "kind", "call_id", "status", "errors", "json")


def _entries(value: Column | str, path: str) -> Column:
    return _get(value, path, "array<variant>")


def _fields(value: Column | str, path: str = "$") -> Column:
    return _get(value, path, "map<string,variant>")


def _turns(conversations: DataFrame) -> DataFrame:
    """The turns with their envelope, null where the text is a message as it stands."""
    text = F.col("text").cast("string")
    parsed = F.when(text.rlike(r"^\s*\{"), F.try_parse_json(text))
    turns = conversations.select(
        F.col("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), text.alias("text"), parsed.alias("parsed")
    )
    result_id = F.when(F.col("role") == "tool", _get("parsed", "$.tool_call_id", "string"))
    envelope = _entries("parsed", "$.tools").isNotNull() | _entries("parsed", "$.tool_calls").isNotNull() | result_id.isNotNull()
    return turns.select("conv_id", "turn", "role", "text", result_id.alias("result_id"), F.when(envelope, F.col("parsed")).alias("payload"))


# -- validation ------------------------------------------------------------------------------


def _number(value: Column) -> Column:
    """The value of a number, null for any other variant."""
    return F.when(F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "double"))


def _kind(value: Column) -> Column:
    """The JSON schema type of a variant."""
    shape, number = F.schema_of_variant(value), _number(value)
    return (
        F.when(shape.startswith("OBJECT"), "object")
        .when(shape.startswith("ARRAY"), "array")
        .when(shape == "STRING", "string")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape == "VOID", "null")
        .when(number == F.floor(number), "integer")
        .otherwise("number")
    )


def _same(a: Column, b: Column) -> Column:
    return F.to_json(a).eqNullSafe(F.to_json(b)) | F.coalesce(_number(a) == _number(b), F.lit(False))


def _below(path: Column, key: Column) -> Column:
    return F.when(path == "", key).otherwise(F.concat(path, F.lit("."), key))


def _broken() -> Column:
    """The errors of a (path, rule, value), without those of its children."""
    path, rule, value = F.col("path"), F.col("rule"), F.col("value")
    no_names = F.array().cast("array<string>")
    kind, number = F.col("kind"), _number(value)
    text = F.when(kind == "string", F.try_variant_get(value, "$", "string"))
    items = F.when(kind == "array", _entries(value, "$"))
    keys = F.when(kind == "object", F.map_keys(_fields(value)))
    types = F.coalesce(_get(rule, "$.type", "array<string>"), F.array(_get(rule, "$.type", "string")))
    fits = F.exists(types, lambda t: (t == kind) | ((t == "number") & (kind == "integer")))
    known = F.map_keys(F.coalesce(_fields(rule, "$.properties"), F.create_map().cast("map<string,variant>")))
    closed = F.coalesce(~_get(rule, "$.additionalProperties", "boolean"), F.lit(False))
    tests = {
        "type": _get(rule, "$.type", "variant").isNotNull() & ~F.coalesce(fits, F.lit(False)),
        "enum": ~F.exists(_entries(rule, "$.enum"), lambda e: _same(e, value)),
        "const": ~_same(_get(rule, "$.const", "variant"), value) & _get(rule, "$.const", "variant").isNotNull(),
        "minimum": number < _get(rule, "$.minimum", "double"),
        "maximum": number > _get(rule, "$.maximum", "double"),
        "exclusiveMinimum": number <= _get(rule, "$.exclusiveMinimum", "double"),
        "exclusiveMaximum": number >= _get(rule, "$.exclusiveMaximum", "double"),
        "minLength": F.length(text) < _get(rule, "$.minLength", "double"),
        "maxLength": F.length(text) > _get(rule, "$.maxLength", "double"),
        "minItems": F.size(items) < _get(rule, "$.minItems", "double"),
        "maxItems": F.size(items) > _get(rule, "$.maxItems", "double"),
        "uniqueItems": _get(rule, "$.uniqueItems", "boolean")
        & (F.size(F.array_distinct(F.transform(items, lambda i: F.coalesce(_number(i).cast("string"), F.to_json(i))))) < F.size(items)),
    }
    own = F.array_compact(F.array(*[F.when(failed & ((kind == "array") if "Items" in name else F.lit(True)), F.concat(F.lit(f"{name} "), path)) for name, failed in tests.items()]))
    missing = F.filter(_get(rule, "$.required", "array<string>"), lambda k: ~F.array_contains(keys, k))
    unknown = F.filter(keys, lambda k: closed & ~F.array_contains(known, k))
    return F.concat(
        own,
        F.coalesce(F.transform(missing, lambda k: F.concat(F.lit("missing "), _below(path, k))), no_names),
        F.coalesce(F.transform(unknown, lambda k: F.concat(F.lit("unknown "), _below(path, k))), no_names),
    )


def _children() -> Column:
    """The (path, rule, value) of what lies directly under a value and has a rule."""
    path, rule, value = F.col("path"), F.col("rule"), F.col("value")
    known, other = _fields(rule, "$.properties"), _get(rule, "$.additionalProperties", "variant")
    item = _get(rule, "$.items", "variant")

    def child(at: Column, its: Column, v: Column) -> Column:
        return F.struct(at.alias("path"), its.alias("rule"), v.alias("value"))

    under = F.transform(
        F.map_entries(F.when(F.col("kind") == "object", _fields(value))),
        lambda e: child(_below(path, e["key"]), F.coalesce(F.try_element_at(known, e["key"]), F.when(~F.coalesce(F.map_contains_key(known, e["key"]), F.lit(False)), other)), e["value"]),
    )
    inside = F.transform(
        F.when(F.col("kind") == "array", _entries(value, "$")), lambda v, i: child(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), item, v)
    )
    none = F.array().cast("array<struct<path:string,rule:variant,value:variant>>")
    ruled = F.concat(F.coalesce(under, none), F.coalesce(inside, none))
    return F.filter(ruled, lambda c: F.coalesce(_fields(c["rule"]).isNotNull(), F.lit(False)))


CALL = ("conv_id", "name", "arguments")


def call_errors(checks: DataFrame) -> DataFrame:
    """(conv_id, name, arguments, found): the broken rules of each distinct call with a schema.

    ``checks(conv_id, name, arguments, rule, value)``. One job per level of nesting, until no value is left that has a rule.
    """
    level = checks.where(_fields("rule").isNotNull()).dropDuplicates(CALL).withColumn("path", F.lit(""))
    found = None
    while True:
        level = stage(level.withColumn("kind", _kind(F.col("value"))).select(*CALL, "path", "rule", "value", "kind"), "arguments")
        errors = level.select(*CALL, F.explode(_broken()).alias("error"))
        found = errors if found is None else found.unionByName(errors)
        if level.isEmpty():
            return found.groupBy(*CALL).agg(F.array_sort(F.collect_set(F.rtrim("error"))).alias("found"))
        level = level.select(*CALL, F.inline(_children()))


# -- records ---------------------------------------------------------------------------------


def _quoted(column: Column) -> Column:
    """A string as JSON text."""
    inside = F.to_json(F.struct(column.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(inside, F.lit(6), F.length(inside) - 6)


def _text(column: Column) -> Column:
    """A variant as canonical JSON text, null written."""
    return F.coalesce(F.to_json(column), F.lit("null"))


def _extra(payload: str, meant: tuple[str, ...]) -> Column:
    """The member ``,"extra":{...}`` with the keys of an envelope that have no meaning, or nothing."""
    rest = F.map_filter(_fields(payload), lambda k, _: ~k.isin(*meant))
    members = F.transform(F.array_sort(F.map_keys(rest)), lambda k: F.concat(_quoted(k), F.lit(":"), _text(F.try_element_at(rest, k))))
    return F.when(F.size(rest) > 0, F.concat(F.lit(',"extra":{'), F.array_join(members, ","), F.lit("}"))).otherwise("")


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per record: conv_id, at_turn, at_call, step, turn, kind, call_id, status, errors, json."""
    turns = _turns(conversations)
    envelopes = stage(turns.where("payload IS NOT NULL").select("conv_id", "turn", "role", "result_id", "payload"), "envelopes")
    none, no_errors = F.lit(None).cast("string"), F.array().cast("array<string>")

    content = F.when(F.col("payload").isNull(), _quoted(F.col("text"))).otherwise(_text(_get("payload", "$.content", "variant")))
    extra = F.when(F.col("payload").isNull(), "").otherwise(_extra("payload", MEANT))
    messages = turns.where("result_id IS NULL").select(
        "conv_id", F.col("turn").alias("at_turn"), F.lit(-1).alias("at_call"), F.lit(0).alias("step"), "turn", F.lit("message").alias("kind"),
        none.alias("call_id"), none.alias("status"), no_errors.alias("errors"),
        F.concat(F.lit('{"content":'), content, extra, F.lit(',"role":'), _quoted(F.col("role")), F.lit("}")).alias("json"),
    )

    place = F.struct("turn", "at")
    tools = envelopes.select("conv_id", "turn", F.size(_entries("payload", "$.tools")).alias("n"), F.posexplode(_entries("payload", "$.tools")).alias("at", "tool"))
    tools = tools.select("conv_id", "turn", "n", "at", "tool", _get("tool", "$.name", "string").alias("name"), _get("tool", "$.parameters", "variant").alias("rule"))
    last = (
        tools.where("name IS NOT NULL AND conv_id IS NOT NULL")
        .groupBy("conv_id", "name")
        .agg(F.max(place).alias("last"), F.max_by("rule", place).alias("rule"))
    )
    definitions = tools.join(last.select("conv_id", "name", "last"), ["conv_id", "name"], "left").select(
        "conv_id", F.col("turn").alias("at_turn"), (F.col("at") - F.col("n") - 1).alias("at_call"), F.lit(0).alias("step"), "turn",
        F.lit("tool_definition").alias("kind"), none.alias("call_id"), F.when(F.col("last") != place, "replaced").otherwise("defined").alias("status"),
        F.array_compact(F.array(F.when(F.col("name").isNull(), "no name"), F.when(F.col("rule").isNotNull() & _fields("rule").isNull(), "parameters are no object"))).alias("errors"),
        F.concat(F.lit('{"definition":'), _text(F.col("tool")), F.lit(',"type":"tool_definition"}')).alias("json"),
    )

    calls = envelopes.select("conv_id", "turn", F.posexplode(_entries("payload", "$.tool_calls")).alias("at", "call")).select(
        "conv_id", "turn", "at",
        _get("call", "$.id", "string").alias("call_id"),
        _get("call", "$.name", "string").alias("name"),
        _get("call", "$.arguments", "variant").alias("value"),
        F.to_json(_get("call", "$.arguments", "variant")).alias("arguments"),
    )
    calls = calls.join(last.select("conv_id", "name", "rule", F.lit(True).alias("defined")), ["conv_id", "name"], "left")
    objects = F.coalesce(_fields("value").isNotNull(), F.lit(False))
    found = call_errors(calls.where(objects).select(*CALL, "rule", "value"))
    results = envelopes.where("result_id IS NOT NULL").select(
        "conv_id", "turn", F.col("result_id").alias("call_id"), _get("payload", "$.content", "variant").alias("content"), _extra("payload", MEANT).alias("extra")
    )
    known = F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()
    first = calls.where(known).groupBy("conv_id", "call_id").agg(F.min(place).alias("first"))
    answered = results.where(known).groupBy("conv_id", "call_id").agg(F.count("*").alias("answers"))
    errors = (
        F.when(F.col("name").isNull(), F.array(F.lit("no name")))
        .when(~objects, F.array(F.lit("arguments are no object")))
        .when(F.col("defined").isNull(), F.array(F.lit("undefined tool")))
        .otherwise(F.coalesce("found", no_errors))
    )
    linked = (
        calls.join(found, list(CALL), "left")
        .join(first, ["conv_id", "call_id"], "left")
        .join(answered, ["conv_id", "call_id"], "left")
        .select(
            "conv_id", F.col("turn").alias("at_turn"), F.col("at").alias("at_call"), F.lit(1).alias("step"), "turn", F.lit("tool_call").alias("kind"), "call_id",
            F.when(F.col("first") != place, "repeated").when(F.col("answers") > 0, "linked").otherwise("open").alias("status"),
            errors.alias("errors"),
            F.concat(
                F.lit('{"arguments":'), F.coalesce("arguments", F.lit("null")), F.lit(',"id":'), _quoted(F.col("call_id")),
                F.lit(',"name":'), _quoted(F.col("name")), F.lit(',"type":"tool_call"}'),
            ).alias("json"),
        )
    )
    placed = results.join(first, ["conv_id", "call_id"], "left").select(
        "conv_id", F.coalesce("first.turn", "turn").alias("at_turn"), F.coalesce("first.at", F.lit(-1)).alias("at_call"), F.lit(2).alias("step"), "turn",
        F.lit("tool_result").alias("kind"), "call_id", F.when(F.col("first").isNull(), "orphan").otherwise("linked").alias("status"), no_errors.alias("errors"),
        F.concat(F.lit('{"content":'), _text(F.col("content")), F.col("extra"), F.lit(',"tool_call_id":'), _quoted(F.col("call_id")), F.lit(',"type":"tool_result"}')).alias("json"),
    )
    return messages.unionByName(definitions).unionByName(linked).unionByName(placed).select(*RECORD)


# -- tool dialogues --------------------------------------------------------------------------

#: The tool that ``tool_dialogues`` defines in every conversation.
MEASURE = (
    '{"tools":[{"name":"measure","parameters":{"additionalProperties":false,"properties":{"chars":{"maximum":400,"type":["integer","null"]},'
    '"size":{"enum":["short","long"]},"words":{"items":{"properties":{"n":{"minimum":20,"type":"integer"}}},"type":"array"}},"required":["chars","size"]}}]}'
)


def tool_dialogues(conversations: DataFrame) -> DataFrame:
    """Plain conversations as dialogues with a tool, turn t at 3 t + 1: every assistant turn also calls ``measure`` with its own length,
    every user turn is followed by the result of the call before it, and turn 0 is preceded by the definition.

    A null text counts as an empty one. Roles other than user and assistant stay as they are.
    """
    text, turn = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("turn").cast("bigint")
    chars, words = F.length(text), F.size(F.split(text, " ")).alias("n")
    size = F.when(chars < 100, "short").when(chars < 600, "long").otherwise("huge")
    arguments = F.struct(chars.alias("chars"), size.alias("size"), F.array(F.struct(words)).alias("words"))
    call = F.struct(arguments.alias("arguments"), F.concat(F.lit("c"), turn).alias("id"), F.lit("measure").alias("name"))
    result = F.struct(F.struct(chars.alias("chars")).alias("content"), F.concat(F.lit("c"), turn - 1).alias("tool_call_id"))

    def at(shift: int, role: Column | str, said: Column) -> Column:
        return F.struct((turn * 3 + shift).alias("turn"), (F.lit(role) if isinstance(role, str) else role).alias("role"), said.alias("text"))

    said = F.when(F.col("role") == "assistant", F.to_json(F.struct(text.alias("content"), F.array(call).alias("tool_calls")))).otherwise(text)
    spoken = F.array(
        F.when(turn == 0, at(0, "system", F.lit(MEASURE))), at(1, F.col("role").cast("string"), said), F.when(F.col("role") == "user", at(2, "tool", F.to_json(result)))
    )
    return conversations.select("conv_id", F.inline(F.array_compact(spoken)))
