"""Secret scans: a keyword automaton first, anchored patterns only at its hits, then embedded checksums."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procgraph.llm.common import doc_text
from procgraph.llm.token_ids import text_batches, texts_of

# Keywords, patterns (tried where a keyword begins) and least lengths.
BASE = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"), re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (("AKIA",), re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
}
HEX = re.compile(r"[0-9a-f]{24,}")
#: A run of letters that a part of a web token has.
RUN = re.compile(r"[0-9A-Za-z_-]+")
#: Kinds that the method adds: keyword, pattern, and the check of its embedded sum.
GITHUB = tuple(f"gh{c}_" for c in "pousr")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem", "card", "iban")


def base62_crc(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, k = divmod(n, 62)
        out = BASE62[k] + out
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0 and len(set(digits)) > 1


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def json_head(found: re.Match) -> bool:
    import base64
    import json

    try:
        part = found[0].split(".")[0]
        return "alg" in json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, TypeError):
        return False


def pem_body(body: str) -> bool:
    """Whether it is base64 of one DER sequence of just the length it states, of an OpenSSH key, or encrypted."""
    import base64

    lines = [x.strip() for x in body.strip().splitlines()]
    coded = "".join(x for x in lines if ":" not in x)
    try:
        data = base64.b64decode(coded, validate=True)
    except ValueError:
        return False
    if len(coded) < len("".join(lines)):  # headers name a cipher: the length is hidden
        return len(data) > 0
    if data[:15] == b"openssh-key-v1\0":
        return True
    if len(data) < 2 or data[0] != 0x30:
        return False
    size, more = data[1], data[1] & 0x7F if data[1] > 0x80 else 0
    return len(data) == 2 + more + (int.from_bytes(data[2 : 2 + more]) if more else size)


#: kind: (keywords, pattern anchored at the keyword, check of the whole match)
CHECKED = {
    "github": (GITHUB, re.compile(r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])"), lambda m: base62_crc(m[0][4:-6]) == m[0][-6:]),
    "npm": (("npm_",), re.compile(r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])"), lambda m: base62_crc(m[0][4:-6]) == m[0][-6:]),
    "jwt": (("eyJ",), re.compile(r"eyJ[0-9A-Za-z_-]+\.eyJ[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+"), json_head),
    "pem": (("-----BEGIN",), re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----((?:[\s0-9A-Za-z+/=:,]|-(?!----))*+)-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----"), lambda m: pem_body(m[1])),
    "card": (("card",), re.compile(r"(?i:card)(?i:[ _-]?(?:number|no))?[\"']?\x20*[:=#]?\x20*[\"']?(?<![0-9])([0-9](?:[ -]?[0-9]){12,18})(?![0-9])"), lambda m: luhn(re.sub("[ -]", "", m[1]))),
    "iban": (("iban",), re.compile(r"(?i:iban)[\"']?\x20*[:=]?\x20*[\"']?([A-Z]{2}[0-9]{2}[0-9A-Z]{11,30})(?![0-9A-Z])"), lambda m: mod97(m[1])),
}


class Scanner:
    """One automaton over the keywords of all kinds, on text with A-Z in lower case; patterns run only where it hits."""

    def __init__(self):
        import ahocorasick

        self.automaton, kinds = ahocorasick.Automaton(), {}
        for kind, (keywords, *_) in (BASE | CHECKED).items():
            for k in keywords:
                kinds.setdefault(k.lower(), []).append(kind)
        for k, of in kinds.items():
            self.automaton.add_word(k, (len(k), of))
        self.automaton.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, str, int]]:
        """(start, kind, end) of all spans in code points, ordered by start, then by kind as listed."""
        if not text:
            return []
        lower = text.encode().lower().decode()  # of bytes: A-Z only, so positions stay
        spans, ends = [], {}
        for last, (length, kinds) in self.automaton.iter(lower):
            start = last - length + 1
            for kind in kinds:
                if start < ends.get(kind, 0):
                    continue
                if kind in BASE:
                    _, pattern, group, least = BASE[kind]
                    if m := pattern.match(text, start):
                        ends[kind] = m.end()
                        if len(m[group]) >= least:
                            spans.append((start, kind, m.end()))
                else:
                    _, pattern, holds = CHECKED[kind]
                    m = pattern.match(text, start)
                    if m is None and kind == "jwt":  # what follows the run decides, so no other hit in it can match
                        ends[kind] = RUN.match(text, start).end()
                    if m and holds(m):
                        ends[kind] = m.end()
                        spans.append((m.start(m.re.groups), kind, m.end(m.re.groups)))
        spans += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
        order = {k: i for i, k in enumerate(KINDS)}
        return sorted(spans, key=lambda s: (s[0], order[s[1]], s[2]))


SPANS = "doc_id long, spans array<struct<kind string, start long, end long>>"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row of docs: all spans of its whole text by start, then kind.

    Spans count code points, the end excluded; spans of different kinds may
    overlap. A null or empty text has none; rows that repeat a doc_id and null
    doc_ids are scanned as they are; an empty table gives no rows; other columns
    aren't read. Nothing moves between tasks.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for table in text_batches(batches):
            found = [[{"kind": k, "start": a, "end": b} for a, k, b in scanner(t)] for t in texts_of(table).to_pylist()]
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array(found, kind)], names=["doc_id", "spans"])

    return doc_text(docs).mapInArrow(run, SPANS)


def joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """(doc_id, text) with every span, overlapping ones as one, replaced by the mask; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for table in text_batches(batches):
            out = []
            for text in table["text"].to_pylist():
                parts, at = [], 0
                for start, _, end in scanner(text) if text else []:
                    if start >= at:
                        parts += [text[at:start], mask]
                    at = max(at, end)
                out.append(text and "".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array(out, pa.string())], names=["doc_id", "text"])

    return doc_text(docs).mapInArrow(run, "doc_id long, text string")

