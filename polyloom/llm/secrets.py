"""Secret scan: Aho-Corasick keywords, regular expressions anchored at the hits, checksums inside the matches."""

from __future__ import annotations

import base64
import binascii
import functools
import json
import re
import zlib
from collections.abc import Callable
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyloom.llm.groups import row_ids

_BASE62 = {c: i for i, c in enumerate("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")}


def crc_token(match: re.Match) -> bool:
    """The last six characters are the CRC-32, in base 62, of the thirty before them."""
    body = match["body"]
    value = 0
    for c in body[30:]:
        value = value * 62 + _BASE62[c]
    return value == zlib.crc32(body[:30].encode())


def account_in_key(match: re.Match) -> bool:
    """A cloud access key id encodes the twelve-digit account in its first forty-eight bits of base 32."""
    try:
        head = base64.b32decode(match["body"])[:6]
    except binascii.Error:
        return False
    return (int.from_bytes(head) & 0x7FFFFFFFFF80) >> 7 < 10**12


def json_header(match: re.Match) -> bool:
    part = match["head"]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, UnicodeDecodeError):
        return False


def pem_body(match: re.Match) -> bool:
    try:
        return len(base64.b64decode("".join(match["body"].split()), validate=True)) > 16
    except binascii.Error:
        return False


class Rule(NamedTuple):
    name: str
    keywords: tuple[str, ...]
    pattern: str
    check: Callable[[re.Match], bool] | None = None
    fold: bool = False


#: ``secret`` names the part that is reported; keywords of a rule with ``fold`` match in any case.
RULES = (
    Rule("cloud_access_key", ("AKIA", "ASIA", "ABIA", "ACCA"), r"(?<![A-Za-z0-9])(?P<secret>(?:AKIA|ASIA|ABIA|ACCA)(?P<body>[A-Z0-9]{16}))(?![A-Za-z0-9])", account_in_key),
    Rule("forge_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"(?<![A-Za-z0-9])(?P<secret>gh[pousr]_(?P<body>[A-Za-z0-9]{36}))(?![A-Za-z0-9])", crc_token),
    Rule("registry_token", ("npm_",), r"(?<![A-Za-z0-9])(?P<secret>npm_(?P<body>[A-Za-z0-9]{36}))(?![A-Za-z0-9])", crc_token),
    Rule("chat_token", ("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), r"(?<![A-Za-z0-9])(?P<secret>xox[baprs]-[0-9A-Za-z-]{10,})"),
    Rule("payment_key", ("sk_live_", "rk_live_"), r"(?<![A-Za-z0-9])(?P<secret>[sr]k_live_[0-9A-Za-z]{16,})"),
    Rule("maps_key", ("AIza",), r"(?<![A-Za-z0-9])(?P<secret>AIza[0-9A-Za-z_-]{35})(?![0-9A-Za-z_-])"),
    Rule("signed_token", ("eyJ",), r"(?<![A-Za-z0-9])(?P<secret>(?P<head>eyJ[A-Za-z0-9_-]{8,})\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{8,})", json_header),
    Rule("private_key", ("-----BEGIN",), r"(?P<secret>-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?P<body>[A-Za-z0-9+/=\s]+)-----END (?:[A-Z]+ )*PRIVATE KEY-----)", pem_body),
    Rule("password", ("password", "passwd", "pwd"), r"(?:password|passwd|pwd)[\"']?\s{0,3}(?:=>|:=|=|:)\s{0,3}[\"']?(?P<secret>(?=[^\s\"']*\d)[^\s\"']{8,})", None, True),
    Rule("assigned_token", ("token", "secret", "api_key", "apikey", "api-key", "access_key"), r"(?:token|secret|api[_-]?key|access_key)[\"']?\s{0,3}(?:=>|:=|=|:)\s{0,3}[\"']?(?P<secret>(?=[A-Za-z_+/=.-]*\d)[A-Za-z0-9_+/=.-]{20,})", None, True),
)


@functools.cache
def _machine() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton, list[re.Pattern]]:
    exact, folded = ahocorasick.Automaton(), ahocorasick.Automaton()
    for i, rule in enumerate(RULES):
        for word in rule.keywords:
            (folded if rule.fold else exact).add_word(word, (i, len(word)))
    exact.make_automaton()
    folded.make_automaton()
    return exact, folded, [re.compile(rule.pattern, re.IGNORECASE if rule.fold else 0) for rule in RULES]


def _lower(text: str) -> str:
    """In lower case, position for position."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def scan(text: str) -> list[dict]:
    """All findings of a text, by place; of one rule none begins within another."""
    exact, folded, patterns = _machine()
    hits = [(end + 1 - n, i) for end, (i, n) in exact.iter(text)] + [(end + 1 - n, i) for end, (i, n) in folded.iter(_lower(text))]
    out, ends = [], {}
    for start, i in sorted(hits):
        if start < ends.get(i, 0) or not (m := patterns[i].match(text, start)):
            continue
        ends[i] = m.end()
        a, b = m.span("secret")
        check = RULES[i].check
        out.append({"rule": RULES[i].name, "start": a, "end": b, "secret": m["secret"], "checksum": "none" if check is None else "ok" if check(m) else "failed"})
    return out


def mask(secret: str) -> str:
    return secret[:4] + "*" * min(8, len(secret) - 4)


def _findings():
    @F.arrow_udf("array<struct<rule:string,start:int,end:int,masked:string,sha:string,checksum:string>>")
    def findings(texts: pa.Array) -> pa.Array:
        import hashlib

        rows = [[] if t is None else [{"rule": x["rule"], "start": x["start"], "end": x["end"], "masked": mask(x["secret"]), "sha": hashlib.sha256(x["secret"].encode("utf-8", "surrogatepass")).hexdigest()[:16], "checksum": x["checksum"]} for x in scan(t)] for t in texts.to_pylist()]
        kind = pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("masked", pa.string()), ("sha", pa.string()), ("checksum", pa.string())])
        return pa.array(rows, pa.list_(kind))

    return findings


def secret_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each finding: doc_id, rule, start, end (characters), masked, sha (of the secret), checksum.

    checksum: ok or failed where the kind of secret carries one, else none; a failed one is
    reported, as many keys in circulation are damaged copies. The secret itself isn't returned.
    A null, empty or clean text gives no row; repeated rows give their findings again; a null doc_id is
    kept. Overlapping findings of different rules are all reported. Other columns are ignored. No shuffle.
    """
    found = row_ids(docs, id_col, text_col).select("doc_id", _findings()("text").alias("x"))
    return found.select("doc_id", F.inline("x"))
