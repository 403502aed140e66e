"""Secret scans: a keyword automaton, anchored patterns near its hits, checksums inside the matches.

One pass of an Aho-Corasick automaton over the lower-cased text finds the keywords; patterns are then
tried only at the hits. Hex runs have no keyword and are found by one pattern of their own. Tokens that
carry a check of their own count only if it holds: a CRC-32 in base 62, JSON objects under base 64, the
length that a DER frame states.

Nulls: a null text is empty and has no spans. Repeated rows each get a row; an empty table gives none.
Very long texts and hostile ones (nested JSON, endless runs of keywords) take time in proportion to
their length. Only the id and the text are read. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointmill.llm import common

#: Kinds in the order that breaks ties of the start.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm", "jwt", "pem")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_GITHUB = re.compile(r"(gh[pousr]_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_NPM = re.compile(r"(npm_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_JWT = re.compile(r"(eyJ[A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]{16,}+)")
#: Where a header fails to match, so does every later one inside the same run of letters.
_JWT_RUN = re.compile(r"[A-Za-z0-9_-]+")
_PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]++)-----END \1-----")
#: Digits of base 62 in order of value.
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: keyword in lower case -> kind
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "eyj": "jwt", "-----begin ": "pem",
}


def base62_crc(body: str) -> str:
    """CRC-32 of the body in six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _DIGITS[d] + out
    return out


def _checksum_holds(m: re.Match) -> bool:
    return base62_crc(m[2]) == m[3]


def _json_object(part: str) -> dict | None:
    """The object under URL-safe base 64, None where it is something else or nested too deep to be one."""
    try:
        found = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _parts_are_json(m: re.Match) -> bool:
    return "alg" in (_json_object(m[1]) or ()) and _json_object(m[2]) is not None


def _frame_is_whole(m: re.Match) -> bool:
    """Whether the body is base 64 of one DER sequence that is as long as it says."""
    try:
        data = base64.b64decode("".join(m[2].split()), validate=True)
    except ValueError:
        return False
    if len(data) < 2 or data[0] != 0x30:
        return False
    if data[1] < 0x80:
        return len(data) == 2 + data[1]
    n = data[1] & 0x7F
    return 0 < n <= 8 and len(data) == 2 + n + int.from_bytes(data[2 : 2 + n], "big")


#: kind -> (pattern, what a match must pass)
RULES = {
    "assign": (_ASSIGN, lambda m: len(m[2]) >= 6),
    "access": (_ACCESS, lambda m: m.end() - m.start() >= 20),
    "github": (_GITHUB, _checksum_holds),
    "npm": (_NPM, _checksum_holds),
    "jwt": (_JWT, _parts_are_json),
    "pem": (_PEM, _frame_is_whole),
}


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def lowered(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def scan(text: str, words) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets, by start and kind; leftmost and without overlap within a kind."""
    spans = [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    hits: dict[str, list[int]] = {}
    for end, (n, kind) in words.iter(lowered(text)):
        hits.setdefault(kind, []).append(end - n + 1)
    for kind, starts in hits.items():
        pattern, passes = RULES[kind]
        free = 0
        for start in sorted(starts):
            if start < free:
                continue
            if m := pattern.match(text, start):
                free = m.end()
                if passes(m):
                    spans.append((kind, m.start(), m.end()))
            elif kind == "jwt":
                free = run.end() if (run := _JWT_RUN.match(text, start)) else free
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return spans


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans: array of (kind, start, end)) of every document."""
    common.small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in batches:
            spans = [scan(t, words) for t in batch.column("text").to_pylist()]
            flat = [s for x in spans for s in x]
            values = pa.StructArray.from_arrays([pa.array([s[0] for s in flat], pa.string()), pa.array([s[1] for s in flat], pa.int64()), pa.array([s[2] for s in flat], pa.int64())], names=["kind", "start", "end"])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "spans": common.list_array([len(x) for x in spans], values)})

    return source.mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", T.ArrayType(SPAN))]))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every secret's characters replaced by a mark (overlapping spans by one); n_chars follows.

    All rows and columns stay; texts without a secret, null ones among them, are left as they are.
    """
    common.small_batches(docs.sparkSession)

    def clean(text: str | None, words) -> str | None:
        if text is None or not (spans := scan(text, words)):
            return text
        out, at = [], 0
        end = -1
        for _, s, e in spans:
            if s >= end:
                if end >= 0:
                    at = end
                out += [text[at:s], mark]
            end = max(end, e)
        return "".join([*out, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in batches:
            texts = [clean(t, words) for t in batch.column("text").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    out = docs.mapInArrow(common.tidy(run), docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
