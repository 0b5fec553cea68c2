"""Personal data by a linear-chain conditional random field over word shapes.

Trained here on a small labelled table, by the exact gradient of the likelihood. Texts are decoded by
Viterbi in numpy: words that no labelling of their neighbours could move from ``O`` are
set aside first, by a bound on the transitions, so only short runs are left, and runs of one length are decoded together.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyloom.llm.groups import row_ids
from polyloom.llm.tokens import portions

LABELS = ("O", "B-EMAIL", "B-PHONE", "I-PHONE", "B-IP", "B-CARD", "I-CARD", "B-SSN", "B-IBAN", "I-IBAN")
SENTENCES, STEPS, RATE, RIDGE = 600, 100, 0.15, 1e-3
START, END = "<", ">"

# bytes of a shape: x a letter, X a capital, d a digit, others as they are; any non-ASCII byte is a letter
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 120, 88, 100, 120
_CLASS[[9, 10, 11, 12, 13]] = 32
_LETTER = np.isin(np.arange(256), (120, 88))


def shape_of(word: str) -> str:
    """Runs of equal letter classes as one, digits each: ``Ab12.c`` is ``Xxdd.x``."""
    data = _CLASS[np.frombuffer(word.encode("utf-8", "surrogatepass"), np.uint8)]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != data[:-1]) | ~_LETTER[data[1:]]
    return data[keep].tobytes().decode()


_OPEN, _CLOSE = "\"'<[{", "\"'>]},;:!?."
#: Marks that may stick to an entity's end; they aren't part of it.
_JUNK = _CLOSE + "#%&*$|"


@functools.cache
def own_features(shape: str) -> tuple[str, ...]:
    """What a word's shape says of itself."""
    if shape in (START, END):
        return ("edge" + shape,)
    core = shape.lstrip(_OPEN).rstrip(_CLOSE) or shape
    short = re.sub("d+", "d", core)
    digits = core.count("d")
    runs = "-".join(str(min(len(r), 5)) for r in re.findall("d+", core))
    size = next(k for k, most in enumerate((0, 1, 3, 5, 9, 12, 15, 19, 10**9)) if digits <= most)
    at = "mail" if re.fullmatch(r"[xXd._%+-]+@[xXd-]+(\.[xXd-]+)+", core) else "at" if "@" in core else "none"
    quad = "quad" if re.fullmatch(r"(d{1,3}\.){3}d{1,3}", core) else "no"
    plain = "word" if not digits and "@" not in core else "num"
    return ("bias", "short=" + short[:24], "runs=" + runs[:24], f"digits={size}", "at=" + at, "quad=" + quad, "kind=" + plain, "kind+digits=" + plain + str(size), "first=" + core[:1], "last=" + core[-1:], "lone=" + str(core == short and core != "d"), f"exact={core if digits and len(core) < 24 else ''}")


@functools.cache
def near_features(shape: str) -> tuple[str, ...]:
    """What a word's shape says of its neighbour."""
    if shape in (START, END):
        return ("edge",)
    core = shape.lstrip(_OPEN).rstrip(_CLOSE) or shape
    return ("short=" + re.sub("d+", "d", core)[:24], "runs=" + "-".join(str(min(len(r), 5)) for r in re.findall("d+", core))[:24], "end=" + str(shape[-1:] in ".,;:!?"))


def _features(shapes: list[str]) -> list[list[str]]:
    padded = [START, *shapes, END]
    return [[*("0" + f for f in own_features(padded[i])), *("-" + f for f in near_features(padded[i - 1])), *("+" + f for f in near_features(padded[i + 1]))] for i in range(1, len(padded) - 1)]


_SYLLABLES = "ba be da den er ge ha in ka la le lo ma mi na ne no o pa ra re ri sa se ta ti to tu un va ver zi é ü ñ ço".split()


def labelled_sentences(seed: int = 5, n: int = SENTENCES) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: sentences of invented words, personal data among them, and look-alikes that aren't."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    caps = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(k))

    def email():
        name = r.choice([word(), word() + "." + word(), word() + digits(2), word() + "." + digits(2), word() + "_" + word(), word().title() + "." + word().title(), word() + "+" + word()])
        host = r.choice([word(), "mail" + digits(1), word() + "-" + word(), word() + digits(2)])
        return [name + "@" + host + r.choice(["", "." + word()]) + "." + r.choice(["com", "org", "net", "example.com", "co.uk", "de"])]

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([["+1", f"({a})", f"{b}-{c}"], ["+" + digits(2), a, b, c], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"+1-{a}-{b}-{c}"], [f"{a}.{b}.{c}"], ["+" + digits(2), digits(3), digits(7)], ["+" + digits(11)], ["+" + digits(2), digits(2), digits(4), digits(4)], [f"({a}){b}-{c}"], ["0" + digits(3), digits(6)]])

    def ip():
        return [".".join(str(r.randint(0, 255)) for _ in range(4))]

    def card():
        return r.choice([[digits(16)], [digits(16)], [digits(4) for _ in range(4)], ["-".join(digits(4) for _ in range(4))], [digits(15)], [digits(4), digits(6), digits(5)]])

    def ssn():
        return [f"{digits(3)}-{digits(2)}-{digits(4)}"]

    def iban():
        c = r.choice(["DE", "FR", "ES", "GB", "IT", "NL"]) + digits(2)
        return r.choice([[c + digits(18)], [c, *[digits(4) for _ in range(4)], digits(2)]])

    def other():
        return r.choice(
            [
                lambda: [digits(r.choice([1, 2, 3, 4, 5, 6]))], lambda: [digits(4) + "."], lambda: [str(r.randint(1900, 2030))], lambda: [f"{digits(1)}.{digits(1)}"], lambda: ["version", f"{digits(1)}.{digits(1)}.{digits(1)}"],
                lambda: [f"v{digits(1)}.{digits(2)}"], lambda: [f"20{digits(2)}-{digits(2)}-{digits(2)}"], lambda: [f"{digits(2)}/{digits(2)}/20{digits(2)}"], lambda: [f"{digits(2)}:{digits(2)}"], lambda: [f"${digits(2)},{digits(3)}.{digits(2)}"], lambda: [digits(2) + "%"],
                lambda: ["password=" + hexes(18)], lambda: ["token", "=", '"' + hexes(40) + '"'], lambda: ["AKIA" + caps(16)], lambda: ["https://" + word() + ".com/" + word() + "/" + digits(3)], lambda: [hexes(32)], lambda: [digits(8)], lambda: [digits(20)], lambda: ["#" + digits(4)], lambda: ["@" + word()], lambda: [word() + "@"], lambda: [word(), "@", word()],
                lambda: [f"{digits(1)},{digits(3)},{digits(3)}"], lambda: ["Licensed", "under", "CC", "BY-NC", "4.0."], lambda: ["License,", "version", "3."], lambda: ["pp.", f"{digits(2)}-{digits(2)}"], lambda: [word().upper() + "!!"], lambda: [word() + "###", word() + "&&&", word() + "%%%"], lambda: ["|", word(), "|", word()], lambda: [f"({digits(1)})"], lambda: [digits(3), digits(2)], lambda: ["ISBN", "978-" + digits(1) + "-" + digits(4) + "-" + digits(4) + "-" + digits(1)], lambda: [f"{digits(2)}.{digits(2)}.20{digits(2)}"], lambda: [f"-{digits(2)}.{digits(4)}"], lambda: [f"{digits(1)}.{digits(1)}.{digits(1)}.{digits(1)}.{digits(1)}"],
            ]
        )()

    makers = {"EMAIL": email, "PHONE": phone, "IP": ip, "CARD": card, "SSN": ssn, "IBAN": iban}
    out = []
    for _ in range(n):
        words, tags = [], []
        for _ in range(r.randint(1, 5)):
            for _ in range(r.randint(0, 4)):
                words.append(r.choice([word, word, word, lambda: word().title(), lambda: word() + ",", lambda: word() + "."])())
                tags.append("O")
            kind = r.choice([*makers, "PHONE", "CARD", "EMAIL", None, None, None, None, None])
            part = makers[kind]() if kind else other()
            if kind and r.random() < 0.3:
                part = [*part[:-1], part[-1] + r.choice([",", ".", ";", ")", '"'])]
            words += part
            tags += ["O"] * len(part) if not kind else ["B-" + kind, *["I-" + kind] * (len(part) - 1)]
        out.append((words, tags))
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    """The same as a DataFrame: sentence, words, tags."""
    return spark.createDataFrame([(i, w, t) for i, (w, t) in enumerate(labelled_sentences())], "sentence int, words array<string>, tags array<string>")


@dataclass
class Model:
    """Weights by feature, and the scores of moving between labels. ``first`` and ``last`` are of the first and the last word."""

    features: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray
    last: np.ndarray
    _own: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"_own": {}}

    def part(self, mark: str, shape: str) -> np.ndarray:
        """A shape's share in the scores of its own word (mark 0) or of the next (-) or the previous one (+)."""
        names = own_features(shape) if mark == "0" else near_features(shape)
        ids = [i for f in names if (i := self.features.get(mark + f)) is not None]
        return self.weights[ids].sum(0) if ids else np.zeros(len(LABELS))

    def slack(self) -> float:
        """The most that any two neighbours can favour another label over O at one word."""
        into = np.vstack([self.moves, self.first[None]])
        out = np.hstack([self.moves, self.last[:, None]])
        gain = (into - into[:, :1])[:, None, :] + (out - out[:1]).T[None]
        return float(gain[:, :, 1:].max())


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def fit(sentences: Iterable[tuple[list[str], list[str]]]) -> Model:
    """Maximum likelihood with a ridge, by Adam on the exact gradient (forward and backward sums in log space over a padded batch)."""
    sentences = [s for s in sentences if s[0]]
    names: dict[str, int] = {}
    rows = [[[names.setdefault(f, len(names)) for f in fs] for fs in _features([shape_of(w) for w in ws])] for ws, _ in sentences]
    n, longest, k = len(rows), max(map(len, rows)), len(LABELS)
    y = np.zeros((n, longest), int)
    live = np.zeros((n, longest), bool)
    where, which = [], []
    for i, (fs, (_, tags)) in enumerate(zip(rows, sentences)):
        live[i, : len(fs)] = True
        y[i, : len(fs)] = [LABELS.index(t) for t in tags]
        for t, ids in enumerate(fs):
            where += [i * longest + t] * len(ids)
            which += ids
    where, which = np.array(where), np.array(which)
    order = np.argsort(where, kind="stable")
    by_word, word_cut = which[order], np.searchsorted(where[order], np.unique(where))
    words_at = np.unique(where)
    order = np.argsort(which, kind="stable")
    by_feature, feature_cut = where[order], np.searchsorted(which[order], np.arange(len(names)))
    lengths = live.sum(1)
    ends = lengths - 1
    params = [np.zeros((len(names), k)), np.zeros((k, k)), np.zeros(k), np.zeros(k)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    gold = np.zeros((n, longest, k))
    gold[np.arange(n)[:, None], np.arange(longest), y] = live
    pairs = np.zeros((k, k))
    both = live[:, 1:]
    np.add.at(pairs, (y[:, :-1][both], y[:, 1:][both]), 1)
    at = np.arange(n)
    for step in range(1, STEPS + 1):
        w, moves, first, last = params
        e = np.zeros((n * longest, k))
        e[words_at] = np.add.reduceat(w[by_word], word_cut, axis=0)
        e = e.reshape(n, longest, k)
        alpha, beta = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        alpha[:, 0] = e[:, 0] + first
        for t in range(1, longest):
            alpha[:, t] = e[:, t] + _log_sum(alpha[:, t - 1, :, None] + moves, 1)
        beta[at, ends] = last
        for t in range(longest - 2, -1, -1):
            new = _log_sum(moves + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where((t < ends)[:, None], new, beta[:, t])
        z = _log_sum(alpha[at, ends] + last, 1)
        prob = np.exp(np.minimum(0, alpha + beta - z[:, None, None])) * live[..., None]
        move = np.exp(np.minimum(0, alpha[:, :-1, :, None] + moves + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])) * both[..., None, None]
        residual = (prob - gold).reshape(-1, k)
        grads = [np.add.reduceat(residual[by_feature], feature_cut, axis=0), move.sum((0, 1)) - pairs, (prob[:, 0] - gold[:, 0]).sum(0), (prob[at, ends] - gold[at, ends]).sum(0)]
        for i, (p, g) in enumerate(zip(params, grads)):
            g = g / n + RIDGE * p
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            params[i] = p - RATE * (1 - 0.5 * step / STEPS) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return Model(names, *params)


def viterbi(scores: np.ndarray, model: Model, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The best labels of runs of one length: ``scores`` (runs, words, labels). A run that doesn't begin or end its text has O beside it."""
    n, length, k = scores.shape
    best = scores[:, 0] + np.where(begins[:, None], model.first, model.moves[0])
    back = np.zeros((n, length, k), np.int8)
    for t in range(1, length):
        through = best[:, :, None] + model.moves
        back[:, t] = through.argmax(1)
        best = through.max(1) + scores[:, t]
    best = best + np.where(ends[:, None], model.last, model.moves[:, 0])
    out = np.zeros((n, length), np.int8)
    out[:, -1] = best.argmax(1)
    for t in range(length - 1, 0, -1):
        out[:, t - 1] = back[np.arange(n), t, out[:, t]]
    return out


class Decoder:
    """Finds the labelled words of many texts. Scores are kept by shape, of which there are few."""

    def __init__(self, model: Model):
        self.model = model
        self.number = {START.encode(): 0, END.encode(): 1}
        parts = [[model.part(mark, s) for mark in "0-+"] for s in (START, END)]
        self.parts = np.array(parts)
        self.slack = model.slack()

    def _learn(self, shapes: list[bytes]) -> None:
        fresh = [s for s in dict.fromkeys(shapes) if s not in self.number]
        if not fresh:
            return
        for s in fresh:
            self.number[s] = len(self.number)
        new = np.array([[self.model.part(mark, s.decode()) for mark in "0-+"] for s in fresh])
        self.parts = np.concatenate([self.parts, new])

    def decode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, word, first byte, end byte, label) of each word that isn't O; words count through all texts, bytes from 0 in ``data``."""
        spaced = np.insert(data, offsets[1:-1], 32) if len(offsets) > 2 else data
        kinds = _CLASS[spaced]
        blank = kinds == 32
        lead, trail = np.ones(len(blank), bool), np.ones(len(blank), bool)
        lead[1:], trail[:-1] = blank[:-1], blank[1:]
        starts, ends = np.flatnonzero(~blank & lead), np.flatnonzero(~blank & trail) + 1
        none = np.zeros(0, np.int64)
        if not len(starts):
            return none, none, none, none, none
        keep = np.ones(len(kinds), bool)
        keep[1:] = (kinds[1:] != kinds[:-1]) | ~_LETTER[kinds[1:]]
        shapes = kinds[keep].tobytes().split()
        self._learn(shapes)
        number = self.number
        ids = np.fromiter((number[s] for s in shapes), np.int32, len(shapes))
        spaced_offsets = offsets + np.arange(len(offsets))
        texts = np.searchsorted(spaced_offsets, starts, "right") - 1
        before, after = np.zeros_like(ids), np.ones_like(ids)
        same = texts[1:] == texts[:-1]
        before[1:][same], after[:-1][same] = ids[:-1][same], ids[1:][same]
        # a cheap bound by shape first: what a neighbour of the least favourable kind could take from the lead of O
        own = self.parts[:, 0, :1] - self.parts[:, 0]
        worst = sum((self.parts[:, m, :1] - self.parts[:, m]).min(0) for m in (1, 2))
        sure = (own + worst)[:, 1:].min(1) > self.slack
        open_ = np.flatnonzero(~sure[ids])
        if not len(open_):
            return none, none, none, none, none
        scores = self.parts[ids[open_], 0] + self.parts[before[open_], 1] + self.parts[after[open_], 2]
        bound = scores[:, 0] - scores[:, 1:].max(1) > self.slack
        open_, scores = open_[~bound], scores[~bound]
        if not len(open_):
            return none, none, none, none, none
        cut = np.flatnonzero((np.diff(open_) > 1) | (texts[open_][1:] != texts[open_][:-1])) + 1
        first, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(open_)]])
        labels = np.zeros(len(open_), np.int8)
        for length in np.unique(end - first):
            runs = first[end - first == length]
            at = runs[:, None] + np.arange(length)
            head, tail = open_[runs], open_[runs + length - 1]
            begins = (head == 0) | (texts[head] != texts[head - 1])
            finish = (tail == len(ids) - 1) | (texts[tail] != texts[np.minimum(tail + 1, len(ids) - 1)])
            labels[at] = viterbi(scores[at], self.model, begins, finish)
        hit = labels > 0
        w = open_[hit]
        return texts[w], w, starts[w] - texts[w], ends[w] - texts[w], labels[hit]


def entities(texts: pa.Array, decoder: Decoder) -> list[list[dict]]:
    """Of each text, its entities in order: kind, start and end in characters, without quotes and punctuation around."""
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    for a, _b, data, offsets in portions(texts):
        text = word_before = -1
        chars = at = 0
        for t, word, s, e, label in zip(*(x.tolist() for x in decoder.decode(data, offsets))):
            if t != text:
                text, word_before, chars, at = t, -1, 0, int(offsets[t])
            chars += int(((data[at:s] & 0xC0) != 0x80).sum())
            at = s
            surface = data[s:e].tobytes().decode("utf-8", "surrogatepass")
            row, name = out[a + t], LABELS[label]
            end = chars + len(surface.rstrip(_JUNK if "(" in surface else _JUNK + ")"))
            if name[0] == "I" and word == word_before + 1 and row[-1]["kind"] == name[2:]:
                row[-1]["end"] = end
            else:
                row.append({"kind": name[2:], "start": chars + len(surface) - len(surface.lstrip(_OPEN)), "end": end})
            word_before = word
    return out


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row for each entity: doc_id, kind (EMAIL, PHONE, IP, CARD, SSN, IBAN), start, end (characters), value.

    ``model``: by default, one fitted on ``labelled_sentences``. A null, empty or clean text has no rows. Repeated
    rows give theirs again; a null doc_id is kept. Other columns are ignored. Texts are read whole, without a shuffle.
    """
    model = model or trained()

    @F.arrow_udf("array<struct<kind:string,start:int,end:int>>")
    def find(texts: pa.Array) -> pa.Array:
        decoder = _decoder(model)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        return pa.array([[{k: x[k] for k in ("kind", "start", "end")} for x in row] for row in entities(texts, decoder)], pa.list_(kind))

    found = row_ids(docs, id_col, text_col).where("text is not null").select("doc_id", "text", find("text").alias("x")).where(F.size("x") > 0)
    values = F.transform("x", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.substring("text", x["start"] + 1, x["end"] - x["start"]).alias("value")))
    return found.select("doc_id", F.inline(values))


_last: list[tuple[Model, Decoder]] = []


def _decoder(model: Model) -> Decoder:
    """The decoder of a task's model: what it learns of shapes serves the next batches."""
    if not _last or _last[0][0] is not model:
        _last[:] = [(model, Decoder(model))]
    return _last[0][1]


@functools.cache
def trained() -> Model:
    return fit(labelled_sentences())
