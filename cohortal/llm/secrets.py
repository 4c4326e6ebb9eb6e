"""Secret scans: fixed patterns, and Shannon entropy in a sliding window over candidate strings.

A candidate is a longest run of one character class (hex digits of either case,
or the base64 alphabets). A window slides over it; counts of its characters and
the sum of c*log2(c) are kept up to date as one character enters and one leaves,
so each step costs the same whatever the window. Windows at or above the class's
threshold are joined to spans. An allow-list takes away what only looks random:
candidates and spans of a harmless form, and marks such as ``example``, at which a
candidate is cut while what stands beside them is still looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortal.llm.shared import table

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "entropy")
# Fixed patterns of the base kinds, and the least length of what each must hold.
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Character classes of candidates: pattern, window, and bits a character at or above which a window is random.
CLASSES = {
    "hex": (re.compile(r"[0-9A-Fa-f]{24,}"), 24, 2.9),
    "base64": (re.compile(r"[A-Za-z0-9+/_=-]{24,}"), 24, 3.75),
}
#: Forms of which a whole candidate has nothing random: one kind of letters or digits, a repeated unit, words with a number, UUIDs.
FORMS = (
    re.compile(r"[a-z_/=-]+|[A-Z_/=-]+|[A-Z]?[a-z/_=-]+|[0-9+/_=-]+"),
    re.compile(r"(.{1,8})\1{2,}.{0,8}", re.DOTALL),
    re.compile(r"[A-Za-z]+(?:[-_/][A-Za-z]+)*[-_/]?[0-9]{0,4}"),
    re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
)
#: Marks of what is no secret: a candidate is cut at them, and what lies on either side is looked at by itself.
MARKS = re.compile(r"example|placeholder|changeme|lorem|test_?key|x{4,}|1234567[0-9]*", re.IGNORECASE)
#: A published example key.
PUBLISHED = ("wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY",)
#: RE2 forms that hold whenever the patterns above do: texts without a match are not looked at again.
_MAY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]|[0-9a-f]{16}|[A-Za-z0-9+/_=-]{24}"""


def window_spans(text: str, window: int, least: float) -> list[tuple[int, int]]:
    """Joined spans of the windows of ``text`` whose entropy is at least ``least`` bits a character."""
    if len(text) < window:
        return []
    log = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    count: dict[str, int] = {}
    total, spans = 0.0, []
    for end, new in enumerate(text, 1):
        if end > window:
            old = text[end - window - 1]
            total += log[count[old] - 1] - log[count[old]]
            count[old] -= 1
        count[new] = count.get(new, 0) + 1
        total += log[count[new]] - log[count[new] - 1]
        if end >= window and math.log2(window) - total / window >= least - 1e-9:
            if spans and spans[-1][1] >= end - window:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((end - window, end))
    return spans


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds: leftmost matches that don't overlap within a kind, without those too short."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= _LEAST["access"]]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text) if m.end() - m.start() >= _LEAST["hex"]]


def candidates(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    """Runs of a class without published keys and marks, each in its pieces; a run that has one of FORMS is left out whole, and so is such a piece."""
    for m in pattern.finditer(text):
        if any(form.fullmatch(m[0]) for form in FORMS) or any(key in m[0] for key in PUBLISHED):
            continue
        at = m.start()
        for mark in MARKS.finditer(text, *m.span()):
            yield at, mark.start()
            at = mark.end()
        yield at, m.end()


def entropy_spans(text: str, known: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of random strings that the allow-list leaves and that no known span, and no other of them, covers."""
    found = []
    for pattern, window, least in CLASSES.values():
        for begin, end in candidates(text, pattern):
            for a, b in window_spans(text[begin:end], window, least):
                if not any(form.fullmatch(text, begin + a, begin + b) for form in FORMS):
                    found.append((begin + a, begin + b, False))
    out, reach = [], -1
    # By start, the longest first, known ones before others: what ends within the reach of those before it is covered.
    for a, b, base in sorted([*((a, b, True) for _, a, b in known), *found], key=lambda x: (x[0], -x[1], not x[2])):
        if not base and b > reach:
            out.append(("entropy", a, b))
        reach = max(reach, b)
    return out


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a whole text, by start, then kind; code points, end exclusive."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + entropy_spans(text, base), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of spans that overlap, replaced by ``[SECRET]``."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _scanned(texts: pa.Array) -> Iterator[list[tuple[str, int, int]]]:
    """Spans of each text of a batch; only texts in which a pattern may match are read in Python."""
    may = pc.fill_null(pc.match_substring_regex(texts, _MAY), False).to_pylist()
    for i, m in enumerate(may):
        yield find_secrets(texts[i].as_py()) if m else []


def scan(docs: DataFrame) -> DataFrame:
    """Secrets of each document.

    ``docs``: doc_id, text; other columns are not read. Returns doc_id, n_assign,
    n_access, n_hex, n_entropy, base_sha256 (of the base spans, as listed), spans
    (all, as listed) and found (array of kind, start, end). Null or empty texts
    have no spans; each row stands for itself, so repeated rows and null ids keep
    their rows; an empty table gives none. Whole texts are read, however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_scanned(batch.column(1)))
            base = [[s for s in spans if s[0] != "entropy"] for spans in rows]
            counts = [pa.array([sum(s[0] == k for s in spans) for spans in rows], pa.int64()) for k in KINDS]
            found = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in rows], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            hashes = pa.array([hashlib.sha256(shown(spans).encode()).hexdigest() for spans in base], pa.string())
            columns = [batch.column(0), *counts, hashes, pa.array([shown(s) for s in rows], pa.string()), found]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string, found array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every secret in ``text`` replaced; all rows and columns stay, n_chars (if there) follows the text.

    Null and empty texts stay as they are; whole texts are read, however long;
    repeated rows and null ids stay and are changed alike; an empty table gives none.
    Other columns, whatever their names, are handed on.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            changed = {i: redacted(texts[i].as_py(), spans) for i, spans in enumerate(_scanned(texts)) if spans}
            if changed:
                clean = pa.array([changed[i] if i in changed else texts[i].as_py() for i in range(len(texts))], texts.type)
                batch = batch.set_column(at, batch.schema.field(at), clean)
            yield batch

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op2_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of the documents."""
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy")
