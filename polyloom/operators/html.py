"""Translatable scopes of HTML: runs of text between block boundaries, taken out, translated, and put back leaf by leaf."""

from __future__ import annotations

import html as entities
from collections.abc import Callable
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKIPPED = frozenset("canvas code embed iframe kbd math noscript object pre samp script style svg template textarea var".split())
INLINE = frozenset("a b i q s u br em rb rp rt tt bdi bdo del dfn img ins kbd sub sup var wbr abbr cite code data font mark math ruby samp span time label small output strong".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FRAME = frozenset("html head body".split())


def skips(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether an element says that it isn't to be translated."""
    a = {k: v or "" for k, v in attrs}
    return a.get("translate", "").lower() == "no" or "contenteditable" in a or "notranslate" in a.get("class", "").split()


@dataclass
class Scope:
    """leaves: token numbers; ends: where each ends in ``text``, an injected space belonging to the leaf after it."""

    text: str = ""
    leaves: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)

    def add(self, token: int, text: str) -> None:
        if self.text and text and not self.text[-1].isspace() and not text[0].isspace():
            text = " " + text
        self.text += text
        self.leaves.append(token)
        self.ends.append(len(self.text))


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.tokens: list[tuple[str, str, str]] = []  # ("text", decoded, as written) or ("raw", markup, markup)
        self.scopes: list[Scope] = []
        self._scope, self._skip, self._fresh, self._reference = Scope(), [], True, False

    def _flush(self) -> None:
        if self._scope.leaves:
            self.scopes.append(self._scope)
        self._scope = Scope()

    def _raw(self, text: str) -> None:
        self.tokens.append(("raw", text, text))
        self._fresh = True

    def _text(self, text: str, source: str) -> None:
        if self._skip:
            self._raw(source)
        elif not self._fresh and self.tokens and self.tokens[-1][0] == "text":
            self.tokens[-1] = ("text", self.tokens[-1][1] + text, self.tokens[-1][2] + source)
        else:
            self.tokens.append(("text", text, source))
            self._fresh = False

    def _settle(self) -> None:
        """The text token that has just ended becomes a leaf."""
        if self.tokens and self.tokens[-1][0] == "text" and not self._fresh:
            self._scope.add(len(self.tokens) - 1, self.tokens[-1][1])
        self._fresh = True

    def handle_starttag(self, tag, attrs):
        self._settle()
        if tag not in INLINE and tag not in FRAME:
            self._flush()
        if tag not in VOID and (self._skip or tag in SKIPPED or skips(attrs)):
            self._skip.append(tag)
        self._raw(self.get_starttag_text())

    def handle_startendtag(self, tag, attrs):
        self._settle()
        if tag not in INLINE and tag not in FRAME:
            self._flush()
        self._raw(self.get_starttag_text())

    def handle_endtag(self, tag):
        self._settle()
        if tag not in INLINE and tag not in FRAME:
            self._flush()
        if tag in self._skip:
            while self._skip.pop() != tag:
                pass
        self._raw(f"</{tag}>")

    def handle_data(self, data):
        self._text(data, data)

    def handle_entityref(self, name):
        self._reference = True

    handle_charref = handle_entityref

    def updatepos(self, i, j):
        """Called with where a reference is once it has been handled; its name doesn't tell whether it ends with a semicolon."""
        if self._reference:
            self._reference = False
            self._text(entities.unescape(self.rawdata[i:j]), self.rawdata[i:j])
        return super().updatepos(i, j)

    def handle_comment(self, data):
        self._settle()
        self._raw(f"<!--{data}-->")

    def handle_decl(self, decl):
        self._settle()
        self._raw(f"<!{decl}>")

    def handle_pi(self, data):
        self._settle()
        self._raw(f"<?{data}>")

    def unknown_decl(self, data):
        self._settle()
        self._raw(f"<![{data}]>")


def parse(html: str) -> tuple[list[tuple[str, str, str]], list[Scope]]:
    """(tokens, scopes that aren't blank)."""
    r = _Reader()
    r.feed(html)
    r.close()
    r._settle()
    r._flush()
    return r.tokens, [s for s in r.scopes if s.text.strip()]


def serialize(tokens: list[tuple[str, str, str]]) -> str:
    return "".join(source for _, _, source in tokens)


def rewritten(token: tuple[str, str, str], text: str) -> tuple[str, str, str]:
    """A text token with another text; where nothing but a space before it is new, it stays as it was written, whatever its references."""
    _, old, source = token
    same = old and text in (old, " " + old)
    return "text", text, text[: len(text) - len(old)] + source if same else entities.escape(text, quote=False)


def leaf_of(ends: list[int], at: int) -> int:
    """The first leaf that ends after a source position, else the last."""
    return next((i for i, e in enumerate(ends) if e > at), len(ends) - 1)


def apply_alignments(ends: list[int], translated: str, alignments: list[tuple[int, int, int, int]]) -> list[str]:
    """The translated text of each leaf. alignments: source and target spans; a target character follows its source's midpoint, a gap is filled in proportion."""
    n = len(translated)
    owner = [-1] * n
    done_src = done_tgt = 0

    def fill(upto_src: int, upto_tgt: int) -> None:
        length = upto_src - done_src
        for k, t in enumerate(range(done_tgt, upto_tgt)):
            at = done_src + int(length * ((k + 0.5) / (upto_tgt - done_tgt))) if length > 0 else max(0, done_src - 1)
            owner[t] = leaf_of(ends, at)

    for sb, se, tb, te in sorted(alignments, key=lambda a: (a[2], a[3])):
        tb, te = max(tb, done_tgt), min(te, n)
        if te <= tb:
            continue
        fill(sb, tb)
        for t in range(tb, te):
            owner[t] = leaf_of(ends, (sb + se) // 2)
        done_src, done_tgt = se, te
    fill(ends[-1] if ends else 0, n)
    out = [""] * len(ends)
    for c, o in zip(translated, owner):
        out[max(o, 0)] += c
    return out


def translate_fragment(html: str, translate: Callable[[list[str]], list[tuple[str, list]]]) -> str:
    """``translate`` gets all scope texts at once, and isn't called if there are none; it gives (text, alignments) of each."""
    tokens, scopes = parse(html)
    if not scopes:
        return serialize(tokens)
    for scope, (text, alignments) in zip(scopes, translate([s.text for s in scopes])):
        for token, part in zip(scope.leaves, apply_alignments(scope.ends, text, alignments)):
            tokens[token] = rewritten(tokens[token], part)
    return serialize(tokens)


def identity_kernel(texts: list[str]) -> list[tuple[str, list]]:
    return [(t, [(i, i + 1, i, i + 1) for i in range(len(t))]) for t in texts]


def html_scopes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, scope, text, ends: a general reader, in Arrow batches. Null HTML has no scopes."""

    @F.pandas_udf("array<struct<text:string,ends:array<int>>>")
    def read(column: pd.Series) -> pd.Series:
        return column.map(lambda h: [] if h is None else [{"text": s.text, "ends": s.ends} for s in parse(h)[1]])

    return pages.select(key, F.posexplode(read(F.col(html))).alias("scope", "s")).select(key, "scope", "s.text", "s.ends")


def rebuilt(translate: Callable = identity_kernel):
    @F.pandas_udf("string")
    def rebuild(column: pd.Series) -> pd.Series:
        return column.map(lambda h: None if h is None else translate_fragment(h, translate))

    return rebuild


def plain_scopes(html: Column) -> Column:
    """The scope texts as expressions alone, for pages without skip attributes and nested skipped elements: no Python in the plan."""
    block, gap = "\x01", "\x02"
    x = F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>", block)
    x = F.regexp_replace(x, r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>|</?(html|head|body)( [^>]*)?>", "")
    x = F.regexp_replace(F.regexp_replace(x, r"</?(a|b|br)( [^>]*)?>", gap), r"<[^>]*>", block)
    for _ in range(2):
        x = F.regexp_replace(x, r"([^\s\x01\x02])\x02+([^\s\x01\x02])", "$1 $2")
    x = F.replace(x, F.lit(gap), F.lit(""))
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
        x = F.replace(x, F.lit(f"&{name};"), F.lit(char))
    return F.filter(F.split(x, block), lambda s: ~s.rlike(r"\A\p{IsWhite_Space}*\z"))
