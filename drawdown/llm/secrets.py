"""Secret scans with structural confirmation.

Patterns find candidates. Long base64 and hex runs are reported only after they decode to something built like a key: nested DER lengths that
add up, the length-prefixed fields of an OpenSSH key, or a signed token whose header names its algorithm.
"""
from __future__ import annotations

import base64
import binascii
import json
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import map_texts, schema, table, text_of

#: The base patterns, in the order in which kinds are listed, the group that is measured, and its least length.
BASE: list[tuple[str, re.Pattern, int, int]] = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
]
#: Kinds that structural confirmation adds, listed after the base kinds.
ADDED = ("der", "ssh", "jwt")
KINDS = [*(k for k, *_ in BASE), *ADDED]
#: The same as the base pattern for hex with its least length: runs are maximal in both.
LONG_HEX = re.compile(r"[0-9a-f]{32,}")
HEX = re.compile(r"(?<![0-9A-Za-z])(?:0[xX])?((?:[0-9A-Fa-f]{2}){24,})(?![0-9A-Za-z])")
#: Whole base64 runs of at least 32 characters in either alphabet, in the usual one also over lines, indented or not, as in PEM bodies; and where in a run
#: of that alphabet a key can begin: after any other character (for the second one also after its - and _), with the first bits of a DER sequence or an OpenSSH key.
BEGIN = "(?:M[A-P]|AAAA|b3Bl)"
BASE64 = [
    (re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/]+)*={0,2}"), re.compile(r"(?<![A-Za-z0-9+/])" + BEGIN)),
    (re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{32,}={0,2}"), re.compile(r"(?<![A-Za-z0-9])" + BEGIN)),
]
JWT = re.compile(r"(?<![A-Za-z0-9_.-])(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
#: Tags of universal DER types that occur in keys and certificates: integer, bit string, octet string, null, object id, boolean, UTF-8 and
#: printable strings, times, sequence and set.
PRIMITIVE, NESTED = {0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x0C, 0x13, 0x16, 0x17, 0x18}, {0x30, 0x31}
DEPTH = 16


def der_items(data: bytes, start: int, end: int, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """The (tag, content) pairs that fill ``data[start:end]`` exactly, nested ones checked too; None if lengths do not add up."""
    out = []
    while start < end:
        if end - start < 2 or depth > DEPTH:
            return None
        tag, size = data[start], data[start + 1]
        at = start + 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size = int.from_bytes(data[at:at + n], "big")
            at += n
            if size < 0x80:
                return None  # DER takes the shortest form
        if at + size > end:
            return None
        if tag in NESTED or 0xA0 <= tag <= 0xA3:
            if der_items(data, at, at + size, depth + 1) is None:
                return None
        elif tag not in PRIMITIVE and not 0x80 <= tag <= 0x83:
            return None
        out.append((tag, data[at:at + size]))
        start = at + size
    return out


def is_der_key(data: bytes) -> bool:
    """One outer sequence of exactly this length whose members are those of a key or certificate: at least two, of which one is an integer, a
    nested sequence or a bit string."""
    if len(data) < 16 or data[0] != 0x30:
        return False
    outer = der_items(data, 0, len(data))
    if not outer or len(outer) != 1:
        return False
    inner = der_items(outer[0][1], 0, len(outer[0][1]))
    return bool(inner) and len(inner) >= 2 and inner[0][0] in (0x02, 0x30) and any(t in (0x02, 0x03, 0x04) for t, _ in inner)


MAGIC = b"openssh-key-v1\x00"
SSH_NAME = re.compile(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+")


def ssh_ends(data: bytes) -> list[int]:
    """Where an OpenSSH key that starts ``data`` can end, first place first: a private key where its fields say, a public key after any field from the second on."""
    at, out = 0, []

    def field() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n:at]

    if data.startswith(MAGIC):
        at = len(MAGIC)
        if any(field() is None for _ in range(3)):  # cipher, key derivation and its options
            return []
        keys = int.from_bytes(data[at:at + 4], "big")
        at += 4
        whole = keys < 1024 and all(field() is not None for _ in range(keys + 1))
        return [at if whole else len(data)]
    name = field()
    if name is None or not SSH_NAME.fullmatch(name):
        return []
    while at < len(data) and field() is not None:
        out.append(at)
    return out


def unbase64(text: str) -> bytes | None:
    text = re.sub(r"\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    text = text[:len(text) - (len(text) % 4 == 1)]  # prose after the last line may leave a lone character
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def first_of(text: str, start: int, end: int, n: int) -> str:
    """The first ``n`` characters of ``text[start:end]`` but for blanks and line ends, or all if they are fewer."""
    width = 2 * n + 64
    while True:
        got = re.sub(r"\s", "", text[start:min(end, start + width)])
        if len(got) >= n or start + width >= end:
            return got[:n]
        width *= 2


def place_after(text: str, start: int, end: int, n: int) -> int:
    """The place after the first ``n`` characters that are no blanks or line ends, and after padding there."""
    for at in range(start, end):
        n -= not text[at].isspace()
        if not n:
            return min(end, at + 1 + len(re.match("={0,2}", text[at + 1:at + 3])[0]))
    return end


def key_in(text: str, start: int, end: int) -> tuple[int, int, int] | None:
    """The (start, kind, end) of a key that begins the rest ``text[start:end]`` of a base64 run. Lines of prose may follow a key's own: a DER length and
    the fields of an OpenSSH private key say where it ends, a public key ends with a field and a line."""
    data = unbase64(first_of(text, start, end, 16)) or b""
    if len(data) > 4 and data[0] == 0x30:
        wide = data[1] & 0x7F if data[1] & 0x80 else 0
        size = 2 + wide + (int.from_bytes(data[2:2 + wide], "big") if wide else data[1])
        left = -(-size * 8 // 6)
        if wide > 4 or left > end - start:
            return None
        data = unbase64(first_of(text, start, end, left)) or b""
        return (start, KINDS.index("der"), place_after(text, start, end, left)) if len(data) == size and is_der_key(data) else None
    head = unbase64(first_of(text, start, end, 120)) or b""
    if not (head.startswith(MAGIC) or SSH_NAME.match(head, 4)):
        return None
    data = unbase64(text[start:end])
    ends = ssh_ends(data) if data else []
    if not ends:
        return None
    if data.startswith(MAGIC):
        return start, KINDS.index("ssh"), place_after(text, start, end, -(-ends[0] * 8 // 6))
    lines, n = set(), 0
    for line in text[start:end].rstrip("=").splitlines():
        n += len(line.strip())
        lines.add(n)
    fits = [left for at in ends if (left := -(-at * 8 // 6)) in lines]
    return (start, KINDS.index("ssh"), place_after(text, start, end, fits[-1])) if fits else None


def is_signed_token(header: str, payload: str) -> bool:
    """Both parts decode to JSON objects and the header names its algorithm."""
    try:
        first, second = (json.loads(unbase64(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(first, dict) and isinstance(second, dict) and isinstance(first.get("alg"), str)


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the base matches and of the confirmed ones, each sorted; places count code points."""
    base = []
    for k, (_, pattern, group, least) in enumerate(BASE):
        pattern = LONG_HEX if KINDS[k] == "hex" else pattern
        base += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    more = []
    for runs, begin in BASE64:
        for run in runs.finditer(text):
            behind = 0
            for m in begin.finditer(text, run.start(), run.end()):
                if m.start() >= behind and (k := key_in(text, m.start(), run.end())):
                    more.append(k)
                    behind = k[2]
    for m in HEX.finditer(text):
        data = bytes.fromhex(m[1])
        if is_der_key(data):
            more.append((m.start(1), KINDS.index("der"), m.end(1)))
    for m in JWT.finditer(text):
        if is_signed_token(m[1], m[2]):
            more.append((m.start(), KINDS.index("jwt"), m.end()))
    return sorted(base), sorted(set(more))


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row ``id_col``, n_assign, n_access, n_hex, base_spans and spans (``kind:start:end``, comma-joined, by start and then kind).

    Base matches are always reported; confirmed ones are added. A null or empty text has none; a null id stays null; repeated rows repeat;
    an empty table gives an empty result; texts are scanned whole, other columns are not looked at.
    """

    def make():
        def work(values: list[str]) -> dict[str, list]:
            got = [spans(v) for v in values]
            count = {f"n_{kind}": [sum(x[1] == k for x in base) for base, _ in got] for k, (kind, *_) in enumerate(BASE)}
            return count | {"base_spans": [joined(b) for b, _ in got], "spans": [joined(sorted(b + m)) for b, m in got]}

        return work

    return map_texts(df, [id_col], text_of(text_col), schema("n_assign bigint, n_access bigint, n_hex bigint, base_spans string, spans string"), make)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
