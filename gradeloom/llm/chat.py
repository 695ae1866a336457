"""Chat formatting by schema fingerprints.

A record's nested field paths are hashed; the hash selects a declarative mapping that
turns the record's layout into canonical turns. Turns are then written with a template
whose control strings are escaped inside texts, and can be read back exactly.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from itertools import chain, combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"
START, END = "<|im_start|>", "<|im_end|>\n"

#: Control strings of public chat templates, without their first character.
_ANGLE = [r"\|im_start\|>", r"\|im_end\|>", r"\|endoftext\|>", "s>", "/s>", "<SYS>>", "</SYS>>"]
_SQUARE = [r"INST\]", r"/INST\]"]
_HEADS = f"(<)(\\\\*)({'|'.join(_ANGLE)})|(\\[)(\\\\*)({'|'.join(_SQUARE)})"
_CONTROL = re.compile(_HEADS)

#: Names that other layouts give to the same speakers.
ROLES = {
    "human": "user", "prompter": "user", "customer": "user", "instruction": "user",
    "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant", "agent": "assistant",
}


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    A list layout names the list and, in it, the fields of role and text. A flat layout
    names (role, fields); fields that are present and not empty are joined by a blank line,
    and a turn without any is left out, unless its field is required. ``renamed`` layouts call
    the speakers by other names, which become user and assistant.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    items: tuple[str, str, str] | None = None
    parts: bool = False
    renamed: bool = False
    flat: tuple[tuple[str, tuple[str, ...]], ...] = ()


MAPPINGS = (
    Mapping("messages", ("messages[].content", "messages[].role"), ("system",), items=("messages", "role", "content"), flat=(("system", ("system",)),)),
    Mapping("message_parts", ("messages[].content[].text", "messages[].content[].type", "messages[].role"), items=("messages", "role", "content"), parts=True),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), ("system",), items=("conversations", "from", "value"), renamed=True, flat=(("system", ("system",)),)),
    Mapping("turns", ("turns[].speaker", "turns[].text"), items=("turns", "speaker", "text"), renamed=True),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), flat=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("prompt_completion", ("completion", "prompt"), ("system",), flat=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt_response", ("prompt", "response"), ("system",), flat=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question_answer", ("answer", "question"), ("context",), flat=(("user", ("context", "question")), ("assistant", ("answer",)))),
)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def registry(mappings=MAPPINGS) -> dict[str, str]:
    """Fingerprint to mapping name: one for each choice of a mapping's optional fields."""
    out: dict[str, str] = {}
    for m in mappings:
        for extra in chain.from_iterable(combinations(m.optional, k) for k in range(len(m.optional) + 1)):
            out.setdefault(fingerprint((*m.required, *extra)), m.name)
    return out


def field_paths(value, at: str = "") -> set[str]:
    """Paths of all leaves that are not null; elements of one list share a path."""
    found: set[str] = set()
    stack = [(value, at)]
    while stack:
        value, at = stack.pop()
        if isinstance(value, dict):
            stack += [(v, f"{at}.{k}" if at else str(k)) for k, v in value.items()]
        elif isinstance(value, list):
            stack += [(v, f"{at}[]") for v in value]
        elif value is not None:
            found.add(at)
    return found


def with_fingerprint(records: DataFrame, column: str = "record", mappings=MAPPINGS) -> DataFrame:
    """Add schema_fingerprint and layout (null if no mapping has that fingerprint).

    Only paths that some mapping names count, so other fields do not hide a layout.
    """
    known = frozenset(p for m in mappings for p in (*m.required, *m.optional))
    names = registry(mappings)

    @F.pandas_udf("string")
    def of(batch: pd.Series) -> pd.Series:
        def one(text):
            try:
                return fingerprint(field_paths(json.loads(text)) & known)
            except (TypeError, ValueError, RecursionError):
                return None

        return batch.map(one)

    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return records.withColumn("schema_fingerprint", of(F.col(column))).withColumn("layout", F.try_element_at(table, F.col("schema_fingerprint")))


def _role(role: Column) -> Column:
    role = F.coalesce(role, F.lit(""))
    table = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(role)), role)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _apply(m: Mapping, record: Column) -> Column:
    parts = [F.lit(None).cast(TURNS)]
    for role, fields in m.flat:
        found = F.from_json(record, ", ".join(f"`{f}` string" for f in fields))
        values = F.filter(F.array(*[found[f] for f in fields]), lambda v: v.isNotNull() & (v != ""))
        turn = F.array(_turn(F.lit(role), F.array_join(values, "\n\n"))).cast(TURNS)
        parts.append(turn if set(fields) & set(m.required) else F.when(F.size(values) > 0, turn))
    if m.items:
        at, role, text = m.items
        kind = "array<struct<type:string,text:string>>" if m.parts else "string"
        found = F.from_json(record, f"`{at}` array<struct<`{role}`:string,`{text}`:{kind}>>")[at]
        says = (lambda x: F.array_join(F.transform(x[text], lambda p: F.coalesce(p["text"], F.lit(""))), "")) if m.parts else (lambda x: x[text])
        parts.append(F.transform(found, lambda x: _turn(_role(x[role]) if m.renamed else F.coalesce(x[role], F.lit("")), says(x))).cast(TURNS))
    return F.concat(*[F.coalesce(p, F.array().cast(TURNS)) for p in parts])


def canonical_turns(records: DataFrame, column: str = "record", mappings=MAPPINGS) -> DataFrame:
    """Add layout, schema_fingerprint and turns to a table of JSON records.

    turns is null where no mapping fits, where the record is null or not JSON; a null or
    missing text is an empty one, a null role an empty string. Nothing is dropped. Columns of
    ``records`` with the added names are replaced.
    """
    records = with_fingerprint(records.drop("turns", "layout", "schema_fingerprint"), column, mappings)
    turns = F.lit(None).cast(TURNS)
    for m in mappings:
        turns = F.when(F.col("layout") == m.name, _apply(m, F.col(column))).otherwise(turns)
    return records.withColumn("turns", turns)


def records_from_rows(rows: DataFrame) -> DataFrame:
    """One JSON record of the messages layout for each conv_id of a table with a row a turn.

    Turns are in the order of turn (null first), then role and text, so ties and reruns agree;
    repeated turns stay. Null roles and texts are empty. A conversation is one record.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    messages = F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return grouped.select("conv_id", F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def escape(text: str) -> str:
    """Put one more backslash after the first character of what looks like a control string."""
    return _CONTROL.sub(lambda m: f"{m[1] or m[4]}\\{m[2] or m[5] or ''}{m[3] or m[6]}", text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[1] or m[4]}{(m[2] or m[5] or '')[1:]}{m[3] or m[6]}", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def _unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def write_chat(turns) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text and the spans (code points) of the assistant's words in it."""
    out, loss, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_escape_role(role)}\n", escape(text)
        if role == "assistant":
            loss.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), loss


def read_chat(formatted: str) -> list[tuple[str, str]]:
    turns = []
    for part in formatted.split(END)[:-1]:
        role, _, body = part.removeprefix(START).partition("\n")
        turns.append((_unescape_role(role), unescape(body)))
    return turns


def format_chat(records: DataFrame) -> DataFrame:
    """Add formatted and loss_spans (start, end) to rows with turns; both null where turns is.

    No turns give an empty text. A conversation is one text, so one row holds it whole.
    """

    @F.pandas_udf("struct<formatted:string,loss_spans:array<struct<start:long,end:long>>>")
    def of(batch: pd.Series) -> pd.DataFrame:
        texts, spans = [], []
        for turns in batch:
            text, loss = (None, None) if turns is None else write_chat((t["role"], t["text"]) for t in turns)
            texts.append(text)
            spans.append(loss and [{"start": a, "end": b} for a, b in loss] if loss is not None else None)
        return pd.DataFrame({"formatted": texts, "loss_spans": spans})

    records = records.drop("formatted", "loss_spans")
    return records.withColumn("_chat", of("turns")).select("*", "_chat.formatted", "_chat.loss_spans").drop("_chat")


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of formatted and loss_spans finds, as counts and digests; nulls where formatted is null."""

    @F.pandas_udf("struct<n_turns:long,turns_sha256:string,loss_chars:long,loss_sha256:string,formatted_chars:long>")
    def of(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, loss in zip(texts, spans, strict=True):
            if text is None:
                rows.append((None,) * 5)
                continue
            turns = read_chat(text)
            said = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
            whole = hashlib.sha256()
            for role, words in turns:
                whole.update(f"{role}\n{words}\n".encode())
            rows.append((len(turns), whole.hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(text)))
        names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pd.DataFrame(rows, columns=names).astype({n: "Int64" for n in names[::2]})

    return formatted.withColumn("_read", of("formatted", "loss_spans")).select("conv_id", "_read.*")


def op2_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    quoted = spark.sql("select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    return digests(format_chat(canonical_turns(records_from_rows(rows.unionByName(quoted)))))


_SQL_ESCAPE = r"""length(regexp_replace({0}, '(<)(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>)|(\[)(\\*)(INST\]|/INST\])', '\1\4\\\2\5\3\6', 'g'))"""
OP2_SQL = f"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(length(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as bigint) as loss_chars,
       sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
       cast(sum(12 + {_SQL_ESCAPE.format("replace(replace(role, '%', '%25'), chr(10), '%0A')")} + 1 + {_SQL_ESCAPE.format("text")} + 11) as bigint) as formatted_chars
from r group by conv_id
"""
