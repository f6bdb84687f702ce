"""Requests and responses of two wire dialects as tables of hops and leaves."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.operators import rewrite


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """``exchange_id``, ``payload``: one JSON request per line; lines that are no JSON are left out."""
    lines = spark.read.text(path).select(F.xxhash64("value").alias("exchange_id"), F.col("value").alias("payload"))
    return lines.where(F.try_parse_json("payload").isNotNull())


def _is_text(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def dialect(payload: Column) -> Column:
    """``messages`` or ``chat`` by shape: a top-level system field, a system message or wrapped tools."""
    v = F.try_parse_json(payload)
    has_system = F.variant_get(v, "$.system", "variant").isNotNull()
    turns = F.coalesce(F.try_variant_get(v, "$.messages", "array<variant>"), F.expr("cast(array() as array<variant>)"))
    tools = F.coalesce(F.try_variant_get(v, "$.tools", "array<variant>"), F.expr("cast(array() as array<variant>)"))
    system_turn = F.exists(turns, lambda t: F.try_variant_get(t, "$.role", "string") == "system")
    wrapped = F.exists(tools, lambda t: F.try_variant_get(t, "$.function", "variant").isNotNull())
    return F.when(has_system, "messages").when(system_turn | wrapped, "chat").otherwise("messages")


def hops(requests: DataFrame) -> DataFrame:
    """``exchange_id``, ``hop_index``, ``role``, ``hop_kind``, ``text`` of every message.

    Content is a text or a list of blocks; the texts of text blocks are joined by a blank. A
    message of the role ``tool``, or with a block of type ``tool_result``, is a tool result.
    """
    v = F.try_parse_json("payload")
    turns = requests.select("exchange_id", F.posexplode(F.try_variant_get(v, "$.messages", "array<variant>")).alias("hop_index", "m"))
    content = F.try_variant_get("m", "$.content", "variant")
    blocks = F.when(~_is_text(content), F.try_variant_get("m", "$.content", "array<variant>"))
    kinds = F.transform(blocks, lambda b: F.try_variant_get(b, "$.type", "string"))
    text_blocks = F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == "text")
    joined = F.array_join(F.transform(text_blocks, lambda b: F.try_variant_get(b, "$.text", "string")), " ")
    role = F.try_variant_get("m", "$.role", "string")
    tool = (role == "tool") | F.coalesce(F.array_contains(kinds, "tool_result"), F.lit(False))
    return turns.select(
        "exchange_id",
        "hop_index",
        role.alias("role"),
        F.when(tool, "tool_result").otherwise(F.coalesce(role, F.lit("user"))).alias("hop_kind"),
        F.coalesce(F.when(_is_text(content), F.try_variant_get("m", "$.content", "string")), joined, F.lit("")).alias("text"),
    )


Leaf = tuple[str, str | None, str, dict | list, str | int]
#: Levels of nesting that are read; path of the only leaf of a payload that cannot be read.
DEPTH, UNREADABLE = 200, "$!"


def _read(payload: str) -> list | None:
    """The parsed payload in a list of one; null for what is no JSON or nested more than ``DEPTH`` levels deep."""
    try:
        box = [json.loads(payload)]
    except (ValueError, RecursionError):
        return None
    # No level without a bracket of its own: most payloads have too few of them to be that deep.
    if payload.count("{") + payload.count("[") <= DEPTH:
        return box
    level = [x for x in box if isinstance(x, dict | list)]
    for _ in range(DEPTH + 1):
        inner = (x.values() if isinstance(x, dict) else x for x in level)
        level = [v for values in inner for v in values if isinstance(v, dict | list)]
        if not level:
            return box
    return None


def _clean(text: str) -> str:
    """Halves of surrogate pairs, which JSON may escape but UTF-8 cannot hold, become U+FFFD."""
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _walk(box: list, mode: str) -> list[Leaf]:
    """(path, part, text, container, place) of each string below the payload in ``box``, in document order.

    ``part`` names what a rewrite may touch: ``system``, ``content``, ``tool`` and ``schema`` of
    a request, ``answer`` of a response; null for the rest. ``mode`` tells how to read on:
    blocks of a message, free JSON, a schema, or a named level of the envelope. What is still to
    be read lies on a list of its own, the next value last, so that a string costs the same at any depth.
    """
    out: list[Leaf] = []
    ahead: list[tuple] = [(box[0], "$", None, mode, box, 0)]
    while ahead:
        value, path, part, mode, container, place = ahead.pop()
        if isinstance(value, str):
            out.append((path, part, value, container, place))
        elif isinstance(value, list):
            # A bare string in a list of blocks is no block, a list of free JSON passes on.
            bare = None if mode in ("blocks", "schema") else part
            for k in range(len(value) - 1, -1, -1):
                v = value[k]
                if isinstance(v, str | dict | list):
                    ahead.append((v, f"{path}[{k}]", bare if isinstance(v, str) else part, mode, value, k))
        elif isinstance(value, dict):
            kind = value.get("type") if mode == "blocks" else None
            for k in reversed(value):
                v = value[k]
                if isinstance(v, str | dict | list):
                    ahead.append((v, f"{path}.{k}", *_below(v, k, part, mode, kind), value, k))
    return out


def _below(value: object, k: str, part: str | None, mode: str, kind: object) -> tuple[str | None, str]:
    """Part and mode of the value under the name ``k`` of an object; ``kind`` is the type of a block."""
    if mode == "json":
        return part, "json"
    if mode == "schema":
        return "schema" if k == "description" and isinstance(value, str) else None, "schema"
    if mode == "blocks":
        return (part, _BLOCKS[kind, k]) if isinstance(kind, str) and (kind, k) in _BLOCKS else (None, "other")
    inner = _ENVELOPE.get((mode, k), (None, "other"))
    return (None, "other") if inner == ("tool", "other") and not isinstance(value, str) else inner


_BLOCKS = {("text", "text"): "other", ("tool_result", "content"): "blocks", ("tool_use", "input"): "json"}
_ENVELOPE: dict[tuple[str, str], tuple[str | None, str]] = {
    ("request", "system"): ("system", "blocks"),
    ("request", "messages"): (None, "message"),
    ("request", "tools"): (None, "tool"),
    ("message", "content"): ("content", "blocks"),
    ("tool", "description"): ("tool", "other"),
    ("tool", "input_schema"): (None, "schema"),
    ("tool", "function"): (None, "tool"),
    ("tool", "parameters"): (None, "schema"),
    ("response", "content"): ("answer", "blocks"),
    ("response", "choices"): (None, "choice"),
    ("choice", "message"): (None, "answer"),
    ("answer", "content"): ("answer", "blocks"),
}


def leaves(payloads: DataFrame, envelope: str = "request", parts: Sequence[str] | None = None) -> DataFrame:
    """``exchange_id``, ``leaf_no``, ``path``, ``part``, ``text``: string values at any depth, in document order.

    ``envelope`` is ``request`` or ``response``. ``part`` is null for strings that a rewrite
    leaves alone: roles, names, types, ids. A payload that is no JSON, or nested more than
    ``DEPTH`` levels deep, is one leaf of the path ``$!`` without a part: gates see its text,
    rewriting leaves it alone. Null payloads have no leaves. With ``parts`` only leaves of these
    parts leave the workers; their numbers stay the same. Payloads are dealt to all tasks
    first: a small file, or one with a single row group, would be read by a task or two.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, payload in zip(batch["exchange_id"], batch["payload"], strict=True):
                box = _read(payload)
                found = [(UNREADABLE, None, payload, [], 0)] if box is None else _walk(box, envelope)
                rows += [(key, k, _clean(path), part, _clean(text)) for k, (path, part, text, _, _) in enumerate(found) if parts is None or part in parts]
            yield pd.DataFrame(rows, columns=["exchange_id", "leaf_no", "path", "part", "text"])

    rows = payloads.select(F.col("exchange_id").cast("long").alias("exchange_id"), "payload").where("payload is not null").repartition("exchange_id")
    return rows.mapInPandas(walk, "exchange_id long, leaf_no long, path string, part string, text string")


def rebuild(payloads: DataFrame, rewritten: DataFrame, envelope: str = "request") -> DataFrame:
    """``exchange_id``, ``payload`` with the leaves of ``rewritten`` (``exchange_id``, ``leaf_no``, ``text``) in place.

    Leaves that are not named, payloads of which none is, and those that cannot be read stay
    as they are.
    """
    per = rewritten.groupBy("exchange_id").agg(F.collect_list(F.struct("leaf_no", "text")).alias("l"))

    @F.pandas_udf("string")
    def put(payload: pd.Series, numbers: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for body, which, new in zip(payload, numbers, texts, strict=True):
            # The envelope's own box lets a payload that is one string be set as well.
            box = _read(body) if body is not None else None
            if box is None:
                out.append(body)
                continue
            found = _walk(box, envelope)
            for k, text in zip(which, new, strict=True):
                _, _, _, container, place = found[k]
                container[place] = text
            text = json.dumps(box[0], ensure_ascii=False, separators=(",", ":"))
            out.append(text if text.isascii() or _clean(text) == text else json.dumps(box[0], separators=(",", ":")))
        return pd.Series(out)

    joined = payloads.select("exchange_id", "payload").join(per, "exchange_id", "left")
    changed = put("payload", F.coalesce("l.leaf_no", F.array().cast("array<long>")), F.coalesce("l.text", F.array().cast("array<string>")))
    return joined.select("exchange_id", F.when(F.col("l").isNull(), F.col("payload")).otherwise(changed).alias("payload"))


def restore_payloads(answers: DataFrame, session: DataFrame) -> DataFrame:
    """Responses of either dialect with surrogates of their own exchange made real.

    Text blocks, tool inputs and message contents are restored. ``session`` has ``exchange_id``,
    ``surrogate``, ``real``, ``seq``.
    """
    parts = leaves(answers, "response").where("part is not null")
    restored = rewrite.restore(parts, "exchange_id", session).where("text <> restored")
    return rebuild(answers, restored.select("exchange_id", "leaf_no", F.col("restored").alias("text")), "response")


def tool_names(requests: DataFrame) -> DataFrame:
    """``exchange_id``, ``name`` of every tool that a request declares, in either dialect."""
    tools = F.try_variant_get(F.try_parse_json("payload"), "$.tools", "array<variant>")
    name = F.coalesce(F.try_variant_get("t", "$.name", "string"), F.try_variant_get("t", "$.function.name", "string"))
    return requests.select("exchange_id", F.explode(tools).alias("t")).select("exchange_id", name.alias("name")).where("name <> ''").distinct()


def joined_text(found: DataFrame) -> DataFrame:
    """All leaves of an exchange in one text, parted by NUL so that no match spans two of them."""
    per = found.groupBy("exchange_id").agg(F.sort_array(F.collect_list(F.struct("leaf_no", "text"))).alias("t"))
    return per.select("exchange_id", F.array_join(F.col("t.text"), "\0").alias("text"))


def checked_leaves(found: DataFrame) -> DataFrame:
    """Leaves with ``forbidden``: names of tools and structural words of schemas, which no gate may block."""
    structural = r"\.(type|required|enum)(\[[0-9]+\])?$"
    named = F.col("path").rlike(r"^\$\.tools\[[0-9]+\](\.function)?\.name$")
    schema = F.col("path").rlike(r"\.(input_schema|parameters)\b") & F.col("path").rlike(structural)
    # A property that is called "type" is none: its own definition lies below "properties".
    return found.withColumn("forbidden", named | (schema & ~F.col("path").rlike(r"\.properties\.(type|required|enum)$")))


def first_user_excerpt(found: DataFrame, length: int = 80) -> DataFrame:
    """First user text of an exchange, cut to 80 characters and an ellipsis."""
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    users = found.where((F.col("role") == "user") & (F.length(text) > 0))
    first = users.groupBy("exchange_id").agg(F.min_by(text, "hop_index").alias("t"))
    cut = F.when(F.length("t") > length, F.concat(F.substring("t", 1, length), F.lit("…"))).otherwise(F.col("t"))
    return first.select("exchange_id", cut.alias("excerpt"))


def kept_headers(headers: Column, names: list[str]) -> Column:
    """A header map with the named headers only, in any case."""
    return F.map_filter(headers, lambda k, v: F.lower(k).isin([n.lower() for n in names]))
