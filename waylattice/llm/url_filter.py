"""URL filters by a bit-parallel wildcard automaton: all glob rules run at once over each canonical URL."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import small_batches, table

#: Longer URLs are run one by one, in Python's long integers.
LONG = 4096


@dataclass(frozen=True)
class Rule:
    """What a glob over `.` + host + path does. `*` is any run without a slash, `**` any run, `?` a character but a slash;
    a character after a backslash is itself."""

    name: str
    glob: str
    verdict: str

    @staticmethod
    def of(host: str, path: str, verdict: str) -> Rule:
        """A host with all its subdomains, and all paths that begin with path. No character of them is a wildcard."""
        plain = "".join("\\" + c if c in "*?\\" else c for c in host + path)
        return Rule(host + path, f"*.{plain}**", verdict)


def parts_of(glob: str) -> list[tuple[str, str]]:
    """Kind and text of each part of a glob: stars, a question mark, or a character that stands for itself."""
    out, i = [], 0
    while i < len(glob):
        if glob[i] == "*":
            run = len(glob[i:]) - len(glob[i:].lstrip("*"))
            out.append(("stars", glob[i : i + run]))
            i += run
        elif glob[i] == "?":
            out.append(("one", "?"))
            i += 1
        else:
            i += glob[i] == "\\" and i + 1 < len(glob)
            out.append(("itself", glob[i]))
            i += 1
    return out


class Automaton:
    """Shift-And over words of 64 states. Every rule has a state for its start and one for each character; a wildcard is a state
    that may stay. Rules are in order of precedence, and their states in the same order, so the first rule that fits is the
    lowest final state that is reached."""

    def __init__(self, globs: list[str]):
        parts = [parts_of(g) for g in globs]
        letters = sorted({c for g in parts for kind, c in g if kind == "itself"} | {"/"})
        self.letters = np.array([ord(c) for c in letters], np.uint32)
        number = {c: i + 1 for i, c in enumerate(letters)}  # 0: any other character
        slash, classes = number["/"], len(letters) + 1
        step: list[set[int]] = []  # the classes that lead to a state
        stay: list[set[int]] = []
        starts, finals = [], []
        anything = set(range(classes))
        for g in parts:
            starts.append(len(step))
            step.append(set())
            stay.append(set())
            for kind, text in g:
                if kind == "stars":
                    stay[-1] |= anything if len(text) > 1 else anything - {slash}
                    continue
                step.append(anything - {slash} if kind == "one" else {number[text]})
                stay.append(set())
            finals.append(len(step) - 1)
        self.words = max(1, -(-len(step) // 64))
        pack = lambda states: sum(1 << s for s in states)
        self.step_int = [pack(s for s, x in enumerate(step) if c in x) for c in range(classes)]
        self.stay_int = [pack(s for s, x in enumerate(stay) if c in x) for c in range(classes)]
        self.start_int, self.final_int = pack(starts), pack(finals)
        self.rule = {f: i for i, f in enumerate(finals)}
        self.step, self.stay = self._split(self.step_int), self._split(self.stay_int)
        self.start, self.final = self._split([self.start_int])[0], self._split([self.final_int])[0]

    def _split(self, masks: list[int]) -> np.ndarray:
        return np.array([[m >> (64 * w) & ((1 << 64) - 1) for w in range(self.words)] for m in masks], np.uint64).reshape(-1, self.words)

    def classes(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        return np.where(self.letters[at] == codes, at + 1, 0)

    def match(self, texts: list[str]) -> np.ndarray:
        """The number of the first rule that fits each text, or -1."""
        out = np.full(len(texts), -1, np.int32)
        length = np.array([len(t) for t in texts], np.int64)
        for i in np.flatnonzero(length > LONG).tolist():
            s = self.start_int
            for c in self.classes(texts[i]).tolist():
                s = ((s << 1) & self.step_int[c]) | (s & self.stay_int[c])
            if s := s & self.final_int:
                out[i] = self.rule[(s & -s).bit_length() - 1]
        order = np.flatnonzero(length <= LONG)
        order = order[np.argsort(-length[order], kind="stable")]
        if not len(order):
            return out
        length = length[order]
        symbols = self.classes("".join(texts[i] for i in order.tolist()))
        at = np.r_[0, np.cumsum(length)[:-1]]
        state = np.repeat(self.start[None, :], len(order), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        for t, k in enumerate(np.searchsorted(-length, -np.arange(length[0]), "left").tolist()):  # texts longer than t
            c, s = symbols[at[:k] + t], state[:k]
            shifted = s << one
            shifted[:, 1:] |= s[:, :-1] >> top
            state[:k] = (shifted & self.step[c]) | (s & self.stay[c])
        state &= self.final
        for w in range(self.words):
            low = state[:, w] & (~state[:, w] + one)
            hit = np.flatnonzero((low != 0) & (out[order] < 0))
            out[order[hit]] = [self.rule[64 * w + x.bit_length() - 1] for x in low[hit].tolist()]
        return out


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to a question mark, hash or the end."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", url_col: str = "url") -> DataFrame:
    """Judge the URL of each row by the rule with the longest name that fits, or by default.

    Returns all columns of the input that are not named like the new ones, with host, path, rule (its name, or null) and
    verdict. Of rules with equally long names the one whose verdict, then name, sorts last goes first: block before allow.

    The globs are compiled once, into masks of 64-bit words; each batch of URLs takes one step a character, for all its
    URLs and all rules at once. Nothing is shuffled. Rows may repeat; a null URL, and one without ://, has an empty
    host and path, which only a glob of stars fits. URLs of any length are read to their end.
    """
    small_batches(pages.sparkSession, 4096)
    ordered = sorted(sorted(rules, key=lambda r: (r.verdict, r.name), reverse=True), key=lambda r: -len(r.name))
    globs = [r.glob for r in ordered]
    other = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    url = F.coalesce(F.col(url_col), F.lit(""))
    parts = pages.select(*other, url_host(url).alias("host"), url_path(url).alias("path"))
    schema = StructType([*parts.schema.fields, StructField("rule", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(globs)
        for b in batches:
            texts = [f".{h}{p}" if h or p else "" for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(automaton.match(texts), pa.int32())], names=schema.names)

    found = parts.mapInArrow(run, schema)
    names = F.array(*[F.lit(r.name) for r in ordered]) if ordered else F.array(F.lit(""))
    verdicts = F.array(*[F.lit(r.verdict) for r in ordered]) if ordered else F.array(F.lit(""))
    pick = lambda a: F.when(F.col("rule") >= 0, F.element_at(a, F.col("rule") + 1))
    return found.select(*other, "host", "path", pick(names).alias("rule"), F.coalesce(pick(verdicts), F.lit(default)).alias("verdict"))


#: Rules of the registered query: host, path, verdict.
RULES = [Rule.of("org", "/", "allow"), Rule.of("example.org", "/es/", "block"), Rule.of("example.org", "/en/1", "block"), Rule.of("com", "/fr/", "allow"), Rule.of("com", "/de/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


OP1_SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3 :] ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
m AS (SELECT *, CASE
    WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM m
"""
