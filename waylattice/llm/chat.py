"""Chat formatting: the fingerprint of a record's field paths selects the mapping that makes it canonical turns."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import in_runs, small_batches, table


@dataclass(frozen=True)
class Mapping:
    """How records with exactly these field paths become turns. turns: role and the fields that make its text, joined by an empty
    line if not empty; or each: a list whose elements are turns, or "" for the record itself, with the fields of role and text."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: str | None = None
    role: str = "role"
    text: str = "content"


MAPPINGS = (
    Mapping("turn", ("conv_id", "role", "text", "turn"), each="", text="text"),
    Mapping("messages", ("messages[].content", "messages[].role"), each="messages"),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), each="conversations", role="from", text="value"),
    Mapping("prompt_completion", ("completion", "prompt"), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt_response", ("prompt", "response"), turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("system_prompt_response", ("prompt", "response", "system"), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("instruction", ("instruction", "output"), turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction_input", ("input", "instruction", "output"), turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("question_answer", ("answer", "question"), turns=(("user", ("question",)), ("assistant", ("answer",)))),
)
#: Names that layouts with `from` give to roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(record: object, at: str = "") -> set[str]:
    """Paths of the leaves of a record; elements of a list share the path of the list and []. An empty list or object is a leaf."""
    if isinstance(record, dict) and record:
        return set().union(*[field_paths(v, f"{at}.{k}" if at else k) for k, v in record.items()])
    if isinstance(record, list) and record:
        return set().union(*[field_paths(v, f"{at}[]") for v in record])
    return {at}


def fingerprint(paths: set[str] | tuple[str, ...]) -> int:
    return xxhash.xxh3_64_intdigest("\n".join(sorted(paths)))


class Mapper:
    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS):
        self.by_fingerprint: dict[int, Mapping | None] = {fingerprint(m.paths): m for m in mappings}
        self.mappings = mappings

    def select(self, record: object) -> Mapping | None:
        """By fingerprint; a layout seen for the first time gets the mapping of most paths that it has all of, or none."""
        paths = field_paths(record)
        key = fingerprint(paths)
        if key not in self.by_fingerprint:
            fit = [m for m in self.mappings if paths >= set(m.paths)]
            self.by_fingerprint[key] = max(fit, key=lambda m: (len(m.paths), m.name)) if fit else None
        return self.by_fingerprint[key]

    def turns(self, text: str | None) -> tuple[str | None, list[tuple[str, str]]]:
        """The name of the mapping, and role and text of each turn; without a mapping, None and no turns."""
        try:
            record = json.loads(text) if text is not None else None
        except ValueError:
            return None, []
        if (m := self.select(record)) is None:
            return None, []
        as_text = lambda v: v if isinstance(v, str) else "" if v is None else json.dumps(v, ensure_ascii=False, sort_keys=True)
        if m.each is None:
            return m.name, [(role, "\n\n".join(x for f in fields if (x := as_text(record[f])))) for role, fields in m.turns]
        rows = [record] if m.each == "" else record[m.each]
        names = ROLES if m.role == "from" else {}
        return m.name, [(names.get(r := as_text(x.get(m.role)), r), as_text(x.get(m.text))) for x in rows]


TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Beginnings of control strings of this template and of other usual ones; an escaped text has none of them.
CONTROL = re.compile(r"\\|<(?=\||s>|/s>)|\[(?=INST\]|/INST\])")
ESCAPED = re.compile(r"\\(.)", re.S)
MARKED = re.compile(re.escape(TURN) + "(.*?)" + re.escape(SAYS) + "(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    """A backslash after every backslash and after the first character of every control string, so that none is left."""
    return CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of code points to learn from: the texts of the assistant's turns."""
    out, spans, n = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{SAYS}", escape(text)
        if role == "assistant":
            spans.append((n + len(head), n + len(head) + len(body)))
        out += [head, body, END]
        n += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in MARKED.finditer(formatted)]


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def canonical_turns(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """records: id, seq (the place of a record in its conversation, null if it has all of it) and record (JSON).

    Returns id, seq, pos, role, text, layout: a row for each turn. Records of no known layout, and text that isn't JSON,
    give one row with a null layout, role and text. Null roles and texts of known layouts are empty.
    """
    small_batches(records.sparkSession)
    source = records.select("id", F.col("seq").cast("long").alias("seq"), "record")
    schema = StructType([source.schema["id"], StructField("seq", LongType()), StructField("pos", LongType())] + [StructField(c, StringType()) for c in ("role", "text", "layout")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapper = Mapper(mappings)
        for b in batches:
            at, pos, role, text, layout = [], [], [], [], []
            for i, x in enumerate(b.column("record").to_pylist()):
                name, turns = mapper.turns(x)
                for j, (r, t) in enumerate(turns if name else [(None, None)]):
                    at.append(i)
                    pos.append(j)
                    role.append(r)
                    text.append(t)
                    layout.append(name)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("seq").take(at), pa.array(pos, pa.int64()), *(pa.array(c, pa.string()) for c in (role, text, layout))], names=schema.names)

    return source.mapInArrow(run, schema)


def format_conversations(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Format conversations for training: id, formatted, loss_spans (code points, end excluded), one row for each id.

    Turns of an id go by seq, nulls first, then by their place in the record; ties by role and text, so reruns agree.
    They meet in a sorted stream, and only one conversation is in memory. Records without a known layout are left out,
    but an id that has only such ones still has a row, of no turns. A null id is a conversation of its own. Rows that
    repeat are turns that repeat. An empty table gives an empty result.
    """
    turns = canonical_turns(records, mappings)
    schema = StructType([turns.schema["id"], StructField("formatted", StringType()), StructField("loss_spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in in_runs(batches, "id"):
            own = [(r, x) for r, x, known in zip(*[t.column(c).to_pylist() for c in ("role", "text", "layout")], strict=True) if known is not None]
            formatted, spans = render(own)
            yield pa.RecordBatch.from_arrays(
                [t.column("id").slice(0, 1).combine_chunks(), pa.array([formatted]), pa.array([[{"start": s, "end": e} for s, e in spans]], pa.list_(SPAN))], names=schema.names
            )

    return turns.repartition("id").sortWithinPartitions("id", F.col("seq").asc_nulls_first(), "pos", "role", "text").mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted text."""
    schema = StructType([formatted.schema["id"], StructField("n_turns", LongType()), StructField("turns_sha256", StringType()), StructField("loss_chars", LongType()), StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            rows = []
            for text, spans in zip(b.column("formatted").to_pylist(), b.column("loss_spans").to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())))], names=schema.names)

    return formatted.mapInArrow(run, schema)


#: A conversation of the registered query whose texts hold control strings.
HARD = {"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    records = rows.select(F.col("conv_id").alias("id"), F.col("turn").alias("seq"), F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    hard = spark.range(1).select(F.lit(-1).cast(rows.schema["conv_id"].dataType).alias("id"), F.lit(None).cast("long").alias("seq"), F.lit(json.dumps(HARD)).alias("record"))
    return digests(format_conversations(records.unionByName(hard))).withColumnRenamed("id", "conv_id")


OP2_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, x.turn, x.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) x(turn, role)),
e AS (SELECT *, len(text) + len(regexp_extract_all(text, '\\|<\||<s>|</s>|\[INST\]|\[/INST\]')) + len(role) + len(regexp_extract_all(role, '\\|<\||<s>|</s>|\[INST\]|\[/INST\]')) + 23 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
