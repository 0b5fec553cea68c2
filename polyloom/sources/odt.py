"""Text documents in OpenDocument packages: blocks out, translated blocks back in."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MIMETYPE = "application/vnd.oasis.opendocument.text"
#: Inline elements that a block may have and still be translated.
_INLINE = ("text:span", "text:s", "text:tab", "text:line-break")
_TOKEN = re.compile(r"<!--.*?-->|<\?.*?\?>|<!\[CDATA\[.*?\]\]>|<(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+", re.S)
_NAME = re.compile(r"</?([^\s/>]+)")


def is_translatable_entry(name: str) -> bool:
    return name.rsplit("/", 1)[-1] in ("content.xml", "styles.xml")


def _attr(tag: str, name: str) -> str | None:
    m = re.search(rf"\s{re.escape(name)}\s*=\s*(\"([^\"]*)\"|'([^']*)')", tag)
    return m and html.unescape(m[2] if m[2] is not None else m[3])


def _blocks(tokens: list[str]) -> Iterator[tuple[int, int, str, list]]:
    """(first token inside, end token, text, styles as (start, end, name)) of each block that has only text and known inline elements."""
    i = 0
    while i < len(tokens):
        m = _NAME.match(tokens[i])
        if not (m and m[1] in ("text:p", "text:h") and tokens[i][1] != "/" and not tokens[i].endswith("/>")):
            i += 1
            continue
        text, spans, stack, j, good, depth = "", [], [], i + 1, True, 1
        while j < len(tokens):
            t = tokens[j]
            n = _NAME.match(t)
            if n and n[1] == m[1]:
                depth += -1 if t[1] == "/" else not t.endswith("/>")
                if not depth:
                    break
                good = False
            elif not t.startswith("<"):
                text += html.unescape(t)
            elif not n or n[1] not in _INLINE:
                good = False
            elif n[1] == "text:s":
                text += " " * int(_attr(t, "text:c") or 1)
            elif n[1] == "text:tab":
                text += "\t"
            elif n[1] == "text:line-break":
                text += "\n"
            elif t[1] == "/":
                start, name = stack.pop()
                spans.append((start, len(text), name))
            elif not t.endswith("/>"):
                stack.append((len(text), _attr(t, "text:style-name")))
            j += 1
        if good and text.strip():
            yield i + 1, j, text, sorted(s for s in spans if s[0] < s[1] and s[2])
        i = j + 1 if good else i + 1


def blocks(xml: str) -> list[tuple[str, list]]:
    return [(text, spans) for _, _, text, spans in _blocks(_TOKEN.findall(xml))]


def _inline(text: str) -> str:
    out = html.escape(text, quote=False).replace("\t", "<text:tab/>").replace("\n", "<text:line-break/>")
    return re.sub("  +", lambda m: f' <text:s text:c="{len(m[0]) - 1}"/>', out)


def project(text: str, spans: list, translated: str, alignments: list[tuple[int, int, int, int]]) -> list:
    """Styles of ``translated``: an alignment takes the style around its source's midpoint, and its target grows to whole words. One style over all of the text stays one."""
    if len(spans) == 1 and spans[0][:2] == (0, len(text)):
        return [(0, len(translated), spans[0][2])]
    out = []
    for sb, se, tb, te in alignments:
        style = next((name for a, b, name in spans if a <= (sb + se) // 2 < b), None)
        word = style and next((m for m in re.finditer(r"\w+", translated) if m.start() < te and m.end() > tb), None)
        if word:
            out.append((*word.span(), style))
    return out


def settled(text: str, spans: list) -> list:
    """In order; blanks between two spans belong to the first; neighbours of one style are one; what overlaps an earlier span goes."""
    out: list[list] = []
    for start, end, style in sorted(spans):
        if end <= start:
            continue
        if out and start < out[-1][1]:
            if style == out[-1][2]:
                out[-1][1] = max(end, out[-1][1])
            continue
        if out and start > out[-1][1] and text[out[-1][1] : start].isspace():
            out[-1][1] = start
        if out and out[-1][1] == start and out[-1][2] == style:
            out[-1][1] = end
        else:
            out.append([start, end, style])
    return [tuple(s) for s in out]


def emit(text: str, spans: list) -> str:
    """The text as inline markup."""
    out, at = "", 0
    for start, end, style in settled(text, spans):
        out += _inline(text[at:start]) + f'<text:span text:style-name="{html.escape(style)}">{_inline(text[start:end])}</text:span>'
        at = end
    return out + _inline(text[at:])


def rewrite(xml: str, translate: Callable[[list[str]], list[tuple[str, list]]]) -> str:
    """``translate`` gets the texts of all blocks and gives (text, alignments) of each."""
    tokens = _TOKEN.findall(xml)
    found = list(_blocks(tokens))
    if not found:
        return xml
    for (a, b, text, spans), (translated, alignments) in reversed(list(zip(found, translate([t for _, _, t, _ in found])))):
        tokens[a:b] = [emit(translated, project(text, spans, translated, alignments))]
    return "".join(tokens)


def package_blocks(data: bytes) -> list[tuple[str, int, str]]:
    """(entry, ordinal, text) of a package."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if z.read("mimetype").decode("ascii", "replace") != MIMETYPE:
            raise ValueError("not a text document")
        return [(name, i, text) for name in z.namelist() if is_translatable_entry(name) for i, (text, _) in enumerate(blocks(z.read(name).decode()))]


def rewrite_package(data: bytes, translate: Callable) -> bytes:
    """The type comes first and isn't compressed, as the format asks; other entries are as they were."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if z.read("mimetype").decode("ascii", "replace") != MIMETYPE:
            raise ValueError("not a text document")
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
            w.writestr("mimetype", MIMETYPE, zipfile.ZIP_STORED)
            for item in z.infolist():
                if item.filename != "mimetype":
                    body = z.read(item.filename)
                    w.writestr(item, rewrite(body.decode(), translate) if is_translatable_entry(item.filename) else body)
        return out.getvalue()


def read_odt(spark: SparkSession, path: str) -> DataFrame:
    """path, entry, ord, text, error: one package for a task's turn; a broken one gives a row with its error."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, data in zip(batch["path"], batch["content"]):
                try:
                    rows += [(p, *x, None) for x in package_blocks(bytes(data))]
                except (ValueError, KeyError, zipfile.BadZipFile, UnicodeDecodeError) as e:
                    rows.append((p, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "entry", "ord", "text", "error"]).astype({"ord": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, entry string, ord int, text string, error string")
