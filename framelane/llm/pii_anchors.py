"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, ``://``, plus signs and digits that open a
number, and identifier cues. A small deterministic parser per kind then walks from the anchor to the boundaries and validates.
Spans are code points, end exclusive. The base kinds (email, ip, card, phone) give exactly the leftmost non-overlapping
matches of their patterns, of which those that fail their check are dropped; the other kinds come on top.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framelane.llm.shared import give_back, remembered

BASE = ("email", "ip", "card", "phone")
EXTRA = ("url", "secret", "iban")
KINDS = BASE + EXTRA
DIGITS = frozenset("0123456789")
ALNUM = DIGITS | frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
DIAL = DIGITS | frozenset(" ().-")
VALUE = ALNUM | frozenset("_-+/=")
BLANK, QUOTE = frozenset(" "), frozenset(" \"'")
#: Words that announce a secret or an account; their value follows. Fixed values.
CUES = ("password", "passwd", "token", "secret", "api_key", "apikey", "access_key")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def parse_email(text: str, at: int, floor: int):
    """The match around the at-sign; it starts no earlier than ``floor``."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == "." and (after := _run(text, end + 1, LABEL)) > end + 1:
        end, labels = after, labels + 1
    return (start, end) if labels else None


def _run(text: str, i: int, chars: frozenset) -> int:
    n = len(text)
    while i < n and text[i] in chars:
        i += 1
    return i


def parse_dotted(text: str, start: int) -> tuple[list[tuple[int, int]], int]:
    """From the first digit of a dotted run of numbers: matches of four numbers each, and the run's end."""
    parts, i = [], start
    while True:
        end = _run(text, i, DIGITS)
        parts.append((i, end))
        if end + 1 < len(text) and text[end] == "." and text[end + 1] in DIGITS:
            i = end + 1
        else:
            break
    quads = [parts[k : k + 4] for k in range(0, len(parts) - 3, 4)]
    return [(q[0][0], q[3][1]) for q in quads if all(_octet(text[a:b]) for a, b in q)], parts[-1][1]


def _octet(number: str) -> bool:
    bare = number.lstrip("0")
    return len(bare) <= 3 and int(bare or "0") <= 255


def parse_card(text: str, start: int) -> tuple[tuple[int, int] | None, int]:
    """From the first digit of a chain of digits with single spaces or hyphens: the match if it is valid, and the chain's end."""
    i = start
    while True:
        end = _run(text, i, DIGITS)
        if end + 1 < len(text) and text[end] in " -" and text[end + 1] in DIGITS:
            i = end + 1
        else:
            break
    digits = [c for c in text[start:end] if c in DIGITS] if end - start >= 13 else ()
    return ((start, end) if 13 <= len(digits) <= 19 and luhn("".join(digits)) else None), end


def parse_phone(text: str, plus: int) -> tuple[bool, int, int]:
    """From a plus sign before a digit: is it valid, start, end (end of the match even where it is invalid; plus if none)."""
    last = _run(text, plus + 2, DIAL) - 1
    while last > plus + 2 and text[last] not in DIGITS:
        last -= 1
    if last <= plus + 2 or text[last] not in DIGITS:
        return False, plus, plus
    n = sum(c in DIGITS for c in text[plus : last + 1])
    return 9 <= n <= 15, plus, last + 1


def parse_url(text: str, colon: int):
    """Scheme to the next white space, quote or bracket, around ``://``."""
    start = colon
    while start > 0 and text[start - 1] in ALNUM:
        start -= 1
    if start == colon:
        return None
    end = colon + 3
    while end < len(text) and not text[end].isspace() and text[end] not in "\"'<>()[]{}":
        end += 1
    while end > colon + 3 and text[end - 1] in ".,;:!?":
        end -= 1
    return (start, end) if end > colon + 3 else None


def parse_secret(text: str, after: int, walked: dict):
    """The value after a cue: a ``=`` or ``:``, perhaps quoted, of eight letters, digits or marks at least, a digit among them.

    ``walked`` keeps the end and the last digit of the run of such characters that was walked last, as many cues may lie in one run.
    """
    i = _run(text, after, BLANK)
    if i >= len(text) or text[i] not in "=:":
        return None
    i = _run(text, i + 1, QUOTE)
    if i >= walked.get("end", 0):
        end = _run(text, i, VALUE)
        walked |= {"end": end, "digit": next((k for k in range(end - 1, i - 1, -1) if text[k] in DIGITS), -1)}
    return (i, walked["end"]) if walked["end"] - i >= 8 and walked["digit"] >= i else None


def parse_access_key(text: str, start: int):
    """AKIA and sixteen capitals or digits, standing alone."""
    if start > 0 and text[start - 1] in ALNUM:
        return None
    end = _run(text, start, ALNUM)
    own = text[start:end]
    return (start, end) if len(own) == 20 and own.upper() == own else None


def parse_iban(text: str, cue_end: int):
    """Country, check digits and account after the cue; the remainder by 97 must be 1."""
    i = _run(text, cue_end, frozenset(" :"))
    end, kept = i, []
    while end < len(text) and len(kept) < 34 and (text[end] in ALNUM or text[end] == " " and end + 1 < len(text) and text[end + 1] in ALNUM):
        if text[end] != " ":
            kept.append(text[end].upper())
        end += 1
        if len(kept) == 4 and not ("".join(kept[:2]).isalpha() and "".join(kept[2:]).isdigit()):
            return None
        if len(kept) >= 15 and (end == len(text) or text[end] not in ALNUM):
            own = "".join(kept)
            if int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1:
                return i, end
    return None


def _automaton() -> ahocorasick.Automaton:
    """Anchors. Single digits are among them: base cards and addresses need no cue."""
    a = ahocorasick.Automaton()
    a.add_word("@", ("at", 1))
    a.add_word("://", ("scheme", 3))
    a.add_word("AKIA", ("key", 4))
    for d in sorted(DIGITS):
        a.add_word(d, ("digit", 1))
        a.add_word("+" + d, ("plus", 2))
    for word in (*CUES, *(w.upper() for w in CUES), *(w.title() for w in CUES)):
        a.add_word(word, ("cue", len(word)))
    for word in ("IBAN", "Iban", "iban"):
        a.add_word(word, ("iban", 4))
    a.make_automaton()
    return a


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of every kind, each kind's in order of start and without overlaps; takes time in proportion to the text."""
    automaton = remembered("anchors", _automaton)
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    floor = dict.fromkeys((*KINDS, "dotted"), 0)
    walked: dict[str, int] = {}
    for last, (what, n) in automaton.iter(text):
        start = last - n + 1
        if what == "digit":
            if start >= floor["dotted"]:
                found, floor["dotted"] = parse_dotted(text, start)
                out["ip"] += found
            if start >= floor["card"]:
                span, floor["card"] = parse_card(text, start)
                out["card"] += [span] if span else []
        elif what == "plus":
            if start >= floor["phone"]:
                valid, begin, end = parse_phone(text, start)
                floor["phone"] = end
                out["phone"] += [(begin, end)] if valid else []
        else:
            kind, span = {
                "at": lambda: ("email", parse_email(text, start, floor["email"])),
                "scheme": lambda: ("url", parse_url(text, start) if start >= floor["url"] else None),
                "cue": lambda: ("secret", parse_secret(text, last + 1, walked)),
                "key": lambda: ("secret", parse_access_key(text, start)),
                "iban": lambda: ("iban", parse_iban(text, last + 1)),
            }[what]()
            if span and span[0] >= floor[kind]:
                out[kind].append(span)
                floor[kind] = span[1]
    return out


def mask(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each span, overlapping ones together, replaced by its first kind in angle brackets."""
    merged: list[list] = []
    for start, end, kind in sorted((s, e, k) for k in KINDS for s, e in spans[k]):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end, kind])
    parts, at = [], 0
    for start, end, kind in merged:
        parts += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join(parts) + text[at:]


def _listed(spans, kinds) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in spans[k])


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the counts of the base kinds, the digest of the base spans and all spans, for every row of ``docs``.

    Null and empty texts have no spans; texts of any length are scanned whole, in linear time; repeated rows are scanned alike; an empty
    table gives an empty table; other columns are not read. One pass, no shuffle.
    """
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in BASE], ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            found = [find_spans(t or "") for at in range(0, len(texts), 256) for t in texts.slice(at, 256).to_pylist()]
            columns = [batch.column("doc_id"), *[[len(f[k]) for f in found] for k in BASE]]
            columns += [[hashlib.sha256(_listed(f, BASE).encode()).hexdigest() for f in found], [_listed(f, KINDS) for f in found]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema[i].type) for i, c in enumerate(columns)], schema=schema)

    return given.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, " + FOUND)


def mask_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with their columns, spans in ``text_col`` masked; null stays null. A column ``n_chars`` follows the new text."""

    at_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # so that the strings of few texts exist at once
                part = batch.slice(at, 256)
                new = [None if t is None else mask(t, find_spans(t)) for t in part.column(at_text).to_pylist()]
                columns = [pa.array(new, pa.string()) if i == at_text else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)
            give_back()

    out = docs.mapInArrow(run, docs.schema)
    if dict(docs.dtypes).get("n_chars") == "bigint":
        out = out.withColumn("n_chars", F.when(F.col(text_col).isNull(), F.col("n_chars")).otherwise(F.length(text_col).cast("long")))
    return out
