"""Secret scans: an Aho-Corasick automaton finds keywords, anchored expressions run only at its hits.

Each rule has keywords that every one of its matches begins with; its expression is tried at the hits
alone, from left to right, never inside an earlier match of the same rule. Rules whose secrets embed a
checksum (rules 'github', 'npm': the CRC-32 of the body in base 62) or a structure ('jwt': a JSON
header) keep only what validates. Runs of hex digits have no keyword: a byte table finds texts with a
run of the least length, and those alone are searched.

A hit inside a run of characters in which an earlier hit of the same rule has failed would fail as well, so
it is passed over; the time is linear in the text whatever it repeats.

Spans are code points, end exclusive. Defined cases: a null text is empty and without spans (its cleaned form
stays null); texts of any length are read whole; repeated rows are scanned each; an empty table gives an empty
result; other columns pass through, but those named like the results are replaced by them.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import extended, slices

HEX_LEAST = 32
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc_ok(body: str, check: str) -> bool:
    """Whether six base-62 digits are the CRC-32 of the body."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(6, "0") == check


def jwt_ok(m: re.Match) -> bool:
    head = m[1]
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))).get("alg"), str)
    except (binascii.Error, ValueError, AttributeError):
        return False


class Rule(NamedTuple):
    kind: str
    keywords: tuple[str, ...]  # lower case
    pattern: re.Pattern
    valid: Callable[[re.Match], bool]
    run: re.Pattern | None = None  # from a failed hit on, the characters within which the others fail too


#: A private key: header lines and base64 to the END line, or without one to the last base64 line; else the BEGIN line.
PEM = re.compile(
    r"-----BEGIN (?:[A-Z]{2,12} ){0,3}PRIVATE KEY(?: BLOCK)?-----"
    r"(?:(?:[ \t]{0,8}\r?\n[ \t]{0,16}[A-Za-z][A-Za-z0-9-]{0,40}:[^\n]*){0,16}"
    r"(?:[A-Za-z0-9+/=\s]{64,}-----END (?:[A-Z]{2,12} ){0,3}PRIVATE KEY(?: BLOCK)?-----"
    r"|(?:(?:[ \t]{0,8}\r?\n){1,2}[ \t]{0,16}[A-Za-z0-9+/]{40,}={0,2}(?=\s|\Z))+(?:[ \t]{0,8}\r?\n[ \t]{0,16}[A-Za-z0-9+/=]{1,39}(?=[ \t\r]*(?:\n|\Z))){0,2}))?"
)


def _rules() -> list[Rule]:
    """In the order that breaks ties of start: the three base kinds first, 'hex' (which has no keyword) included."""
    yes = lambda m: True
    return [
        Rule("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), lambda m: len(m[2]) >= 8),
        Rule("access", ("akia",), re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        Rule("hex", (), re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST), yes),
        Rule("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), lambda m: base62_crc_ok(m[1], m[2])),
        Rule("npm", ("npm_",), re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), lambda m: base62_crc_ok(m[1], m[2])),
        Rule("jwt", ("eyj",), re.compile(r"(eyJ[A-Za-z0-9_-]{8,})\.(eyJ[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{16,})"), jwt_ok, re.compile("[A-Za-z0-9_-]+")),
        Rule("pem", ("-----begin ",), PEM, yes),
        Rule("slack", ("xox",), re.compile(r"xox[abeoprs]-[0-9A-Za-z]{8,}(?:-[0-9A-Za-z]{4,})+"), yes, re.compile("[0-9A-Za-z]+")),
        Rule("stripe", ("sk_live_", "rk_live_"), re.compile(r"[sr]k_live_[0-9A-Za-z]{24,}"), yes),
        Rule("google", ("aiza",), re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"), yes),
        Rule("url", ("://",), re.compile(r"://[^\s/:@\x22']{1,64}:([^\s/:@\x22']{4,128})@[a-z0-9.-]+", re.A | re.I), yes),
    ]


class Scanner:
    def __init__(self) -> None:
        self.rules = _rules()
        self.rank = {r.kind: i for i, r in enumerate(self.rules)}
        self.near = ahocorasick.Automaton()
        by_word: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            for k in r.keywords:
                by_word.setdefault(k, []).append(i)
        for k, which in by_word.items():
            self.near.add_word(k, (len(k), which))
        self.near.make_automaton()
        self.table = bytes(104 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
        self.run = b"h" * HEX_LEAST
        self.hex = self.rules[self.rank["hex"]].pattern

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) by start, then rule."""
        raw = text.encode()
        out = [(*m.span(), "hex") for m in self.hex.finditer(text)] if self.run in raw.translate(self.table) else []
        at: dict[int, list[int]] = {}
        low = raw.lower().decode()  # ASCII letters only, so offsets stay
        for last, (n, which) in self.near.iter(low):
            for i in which:
                at.setdefault(i, []).append(last - n + 1)
        for i, starts in at.items():
            rule, free = self.rules[i], 0
            for p in sorted(starts):
                if p < free:
                    continue
                if m := rule.pattern.match(text, p):
                    free = m.end()
                    if rule.valid(m):
                        out.append((p, free, rule.kind))
                elif rule.run:
                    free = rule.run.match(text, p).end()
        return sorted(out, key=lambda s: (s[0], self.rank[s[2]], s[1]))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, overlapping ones as one, replaced by a mark that names the first's kind."""
    out, done = [], 0
    held: tuple[int, int, str] | None = None
    for s in [*spans, (len(text) + 1, len(text) + 1, "")]:
        if held and s[0] < held[1]:
            held = (held[0], max(held[1], s[1]), held[2])
            continue
        if held:
            out += [text[done : held[0]], f"<{held[2]}-secret>"]
            done = held[1]
        held = s
    return "".join(out) + text[done:]


SPANS = "array<struct<start:int,end:int,kind:string>>"


def scan(docs: DataFrame, text: str = "text", spans: str = "spans", redacted: str | None = None) -> DataFrame:
    """docs -> their columns and spans; with redacted, also a column of that name with the text cleaned."""
    docs, schema = extended(docs, **{spans: SPANS} | ({redacted: "string"} if redacted else {}))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            for part in slices(b):
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                found = [scanner.spans(t) if t else [] for t in texts]
                more = [pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in x] for x in found], kind)]
                if redacted:
                    more.append(pa.array([redact(t, x) if x else t for t, x in zip(texts, found, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *more], schema.names)

    return docs.mapInArrow(run, schema)
