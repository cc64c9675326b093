"""Secrets in texts: fixed patterns, and parts of credentials that are weak alone but tell together.

Base spans (an assigned secret, an access identifier, a long hexadecimal run) are always reported. Weak candidates are parts: identifiers
(``user=``), secrets (``pwd:``, or an assigned value that the base leaves out or cuts short) and endpoints (a URL, ``host=``, an address with a port). Parts
are joined by interval: two of them co-occur if they lie in one scope, the lines between two blank lines, however far apart. An identifier is
reported beside a secret, a secret beside an identifier or an endpoint, an endpoint beside both; base spans count as complements too. The join
places spans among the ends of the scopes and looks at the parts that a scope has, so many parts in one text do not make pairs.

Every pattern takes time in proportion to the text: what may repeat is tried from the beginning of a run only.

Positions are code points, the end exclusive. Null and empty texts have no spans; rows are neither dropped nor joined.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.textbatch import filled, over_batches, per_batch, pieces

MIN_ASSIGNED, MIN_ACCESS, MIN_HEX, MIN_WEAK = 12, 18, 16, 4
#: Kinds in the order in which spans with one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")

_ASSIGNED = r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN = re.compile(_ASSIGNED + "([A-Za-z0-9+/_.=-]+)")
#: The same names with values of any characters, such as P@ssw0rd!; what ASSIGN finds is the beginning of it.
WIDE = re.compile(rf"""{_ASSIGNED}[^\s"',;<>]{{{MIN_WEAK},}}""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: A name may follow a prefix, as in DB_USER.
_NAME = r"(?<![A-Za-z0-9])(?ai:{})[\"']?\x20*[:=]\x20*[\"']?([^\s\"',;<>]{{{},}})"
IDENTIFIER = re.compile(_NAME.format(r"user(?:_?name|_?id)?|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?", 3))
SECRET = re.compile(_NAME.format(r"pass(?:phrase)?|pwd|credentials?|auth|private_?key", MIN_WEAK))
ENDPOINT = re.compile(
    rf"""(?<![A-Za-z0-9])(?ai:https?|ftp|jdbc:[a-z0-9]+|[a-z]+sql|mongodb|redis|amqp)://[^\s"'<>]+|{_NAME.format("host(?:_?name)?|endpoint|server|url", 3)}|(?<![0-9.])[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}:[0-9]{{2,5}}"""
)
SCOPE_END = re.compile(r"\n[ \t\r]*\n")

#: What a text must match for one of the patterns to be tried on it; each is wider than its pattern.
_ANY = {
    "assign": r"(?i)passw|secret|token|api_?key", "access": "AKIA", "hex": r"[0-9a-f]{16}",
    "id": r"(?i)(user|login|client|account|access).{0,8}[\"']?\x20*[:=]", "secret": r"(?i)(pass|pwd|credential|auth|key).{0,8}[\"']?\x20*[:=]",
    "endpoint": r"://|(?i:host|endpoint|server|url).{0,5}[\"']?\x20*[:=]|[0-9]\.[0-9]+:[0-9]",
}

Span = tuple[int, int, str]


def base_spans(text: str, tried: set[str] = frozenset(KINDS)) -> tuple[list[Span], list[Span]]:
    """The base spans, by kind, and the assigned secrets that are too short for the base or go on after it."""
    found, short = [], []
    if "assign" in tried:
        wide = {m.start(): m.end() for m in WIDE.finditer(text)}
        for m in ASSIGN.finditer(text):
            length = m.end(1) - m.start(1)
            if length >= MIN_ASSIGNED:
                found.append((m.start(), m.end(), "assign"))
                if wide.get(m.start()) == m.end():
                    del wide[m.start()]
            elif length >= MIN_WEAK:
                wide.setdefault(m.start(), m.end())
        short = [(start, end, "secret") for start, end in wide.items()]
    if "access" in tried:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if "hex" in tried:
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found, short


#: What makes a part known in a scope.
_PART = {"access": "id", "id": "id", "assign": "secret", "hex": "secret", "secret": "secret", "endpoint": "endpoint"}
#: Parts of which one must be in the scope of a weak span, by its kind; all of the groups must be met.
_BESIDE = {"id": [{"secret"}], "secret": [{"id", "endpoint"}], "endpoint": [{"id"}, {"secret"}]}


def linked(base: list[Span], weak: list[Span], scope_ends: list[int]) -> list[Span]:
    """The weak spans whose complements co-occur in their scope; a span lies in the scope that it begins in."""
    scope = lambda span: bisect_right(scope_ends, span[0])
    parts: dict[int, set[str]] = {}
    for span in [*base, *weak]:
        parts.setdefault(scope(span), set()).add(_PART[span[2]])
    return [span for span in weak if all(parts[scope(span)] & group for group in _BESIDE[span[2]])]


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def all_spans(text: str, tried: set[str] = frozenset(KINDS)) -> tuple[list[Span], list[Span]]:
    """(base spans, base spans and linked weak ones), both by start and kind."""
    base, weak = base_spans(text, tried)
    if tried & {"id", "secret", "endpoint"} or weak:
        for kind, pattern in (("id", IDENTIFIER), ("secret", SECRET), ("endpoint", ENDPOINT)):
            if kind in tried:
                weak += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    if not weak:
        return _ordered(base), _ordered(base)
    found = linked(base, weak, [m.end() for m in SCOPE_END.finditer(text)])
    return _ordered(base), _ordered(base + found)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    parts, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _scan(column: pa.Array) -> Iterator[tuple[str | None, list[Span], list[Span]]]:
    """(text or None where nothing was found, base spans, all spans) of each row."""
    column = filled(column)
    for piece in pieces(column):
        texts = column.slice(piece.first, piece.n)
        hits = {kind: pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False) for kind, pattern in _ANY.items()}
        for row in range(piece.n):
            tried = {kind for kind, hit in hits.items() if hit[row]}
            if not tried:
                yield None, [], []
                continue
            text = texts[row].as_py()
            base, spans = all_spans(text, tried)
            yield (text, base, spans) if spans else (None, [], [])


def _digest(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns to keep, ``base`` and ``spans`` (arrays of kind, start, end) of each row."""
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"base {span}, spans {span}"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def step(batch: pa.RecordBatch):
        rows = [[[{"kind": k, "start": s, "end": e} for s, e, k in spans] for spans in (base, every)] for _, base, every in _scan(batch.column(len(keep)))]
        columns = [pa.array(list(x), kind) for x in zip(*rows)]
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=[*keep, "base", "spans"])

    return per_batch(docs.select(*keep, docs[text].alias("_text")), [*keep, "_text"], schema, step)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by its kind; null texts stay null. ``n_chars``, if there is one, follows."""
    at = docs.columns.index("text")

    def step(batch: pa.RecordBatch):
        column = batch.column(at)
        cleaned = [redacted(t, spans) if t is not None else None for t, _, spans in _scan(column)]
        yield batch.set_column(at, batch.schema.field(at), pc.coalesce(pa.array(cleaned, column.type), column))

    found = over_batches(docs, step, docs.schema)
    if "n_chars" not in docs.columns:
        return found
    kind = docs.schema["n_chars"].dataType
    return found.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def digests(docs: DataFrame) -> DataFrame:
    """Per document the number of base spans of each kind, SHA-256 of their list, and the list of all spans."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"

    def step(batch: pa.RecordBatch):
        counts, base_digest, listed = [[], [], []], [], []
        for _, base, spans in _scan(batch.column(1)):
            for count, kind in zip(counts, KINDS):
                count.append(sum(k == kind for _, _, k in base))
            base_digest.append(hashlib.sha256(_digest(base).encode()).hexdigest())
            listed.append(_digest(spans))
        columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base_digest), pa.array(listed)]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return per_batch(docs, ["doc_id", "text"], schema, step)
