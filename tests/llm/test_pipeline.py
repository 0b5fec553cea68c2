"""The pipeline's stages, one after the other over a whole table, each beside a plain computation of what it keeps."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from test_brute_force import decision, slow_lines

import corpus_pipeline
from polyloom.llm import lines, mixing, packing, simhash, toxicity

SF = "/root/testdata/sf0.01"


def draw(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52


def slow_toxicity(spark, rows, sf):
    model = toxicity.train(spark.createDataFrame(rows, SCHEMA), spark.read.parquet(f"{sf}/labels.parquet"))
    terms = toxicity.document_terms(pa.array([r["text"].lower() for r in rows]))
    return [r for r, t in zip(rows, terms) if 1 / (1 + np.exp(-np.clip(decision(model, t), -30, 30))) < toxicity.THRESHOLD]


def slow_line_dedup(spark, rows, sf):
    changed = slow_lines([(r["doc_id"], r["source"], r["text"]) for r in rows], lines.MIN_SITES, lines.MIN_CHARS)
    out = [r | {"text": changed[r["doc_id"]][2]} if r["doc_id"] in changed else r for r in rows]
    return [r for r in out if r["doc_id"] not in changed or r["text"].strip()]


def slow_near_dedup(spark, rows, sf):
    lanes, some = simhash.signatures(pa.array([r["text"].lower() for r in rows]))
    ids = [r["doc_id"] for r in rows]
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        if some[i]:
            far = np.bitwise_count(lanes[i + 1 :] ^ lanes[i]).sum(1, dtype=int)
            for j in np.flatnonzero((far <= simhash.MAX_DISTANCE) & some[i + 1 :]) + i + 1:
                a, b = find(ids[i]), find(ids[j])
                root[max(a, b)] = min(a, b)
    return [r for r in rows if find(r["doc_id"]) == r["doc_id"]]


def slow_topic(t):
    if any(w in t.lower() for w in mixing.LEGAL):
        return "legal"
    if re.search("[A-Z]", t) and not re.search("[a-z]", t):
        return "shouted"
    if t.count("|") + t.count("\t") >= 3:
        return "tabular"
    if t and len(re.findall("[0-9]", t)) * 5 >= len(t):
        return "numeric"
    return "marked" if t and len(re.findall(mixing.MARK, t)) * 16 >= len(t) else "prose"


def slow_mixing(spark, rows, sf):
    cell = [(r["source"], r["lang"], slow_topic(r["text"])) for r in rows]
    have = Counter()
    for c, r in zip(cell, rows):
        have[c] += len(re.findall("[^ \t\n\f\r]+", r["text"]))
    total, goal = sum(have.values()), []
    for i, name in enumerate(mixing.MARGINALS):
        mine = Counter()
        for c, n in have.items():
            mine[c[i]] += n
        want = {k: mixing.TARGETS[name].get(k, n / total) if name in mixing.TARGETS else (n / total) ** mixing.TEMPERATURES[name] for k, n in mine.items() if n}
        full = set()
        while True:  # what is asked above what there is goes to the others
            level = (corpus_pipeline.KEEP * total - sum(mine[k] for k in full)) / sum(w for k, w in want.items() if k not in full)
            more = {k for k, w in want.items() if k not in full and level * w > mine[k]}
            if not more:
                break
            full |= more
        goal.append({k: mine[k] if k in full else level * w for k, w in want.items()})
    m = {c: float(n) for c, n in have.items()}
    for _ in range(3000):
        for i in range(3):
            now = defaultdict(float)
            for c, n in m.items():
                now[c[i]] += n
            m = {c: n * goal[i].get(c[i], 0) / now[c[i]] if now[c[i]] else n for c, n in m.items()}
        m = {c: min(n, have[c]) for c, n in m.items()}
    return [r for c, r in zip(cell, rows) if draw(f"{r['doc_id']}:{mixing.SEED}") < (min(1.0, m[c] / have[c]) if have[c] else 1.0)]


def slow_packing(rows):
    out = []
    for r in rows:
        tokens = re.findall(r"[ \t\n\f\r]*[^ \t\n\f\r]+|[ \t\n\f\r]+\Z", r["text"])
        at = piece = 0
        while at < len(tokens):
            n = packing.MAX_LENGTH
            while n > len(tokens) - at:
                n //= 2
            out.append((r["doc_id"], piece, at, n, "".join(tokens[at : at + n])))
            at, piece = at + n, piece + 1
    sizes = Counter(x[3] for x in out)
    many = {n: max(1, -(-k * n // packing.BATCH_TOKENS)) for n, k in sizes.items()}
    return sorted((*x, sizes[x[3]], int(draw(f"{x[0]}:{x[1]}") * many[x[3]])) for x in out)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
SLOW = {"toxicity": slow_toxicity, "line_dedup": slow_line_dedup, "near_dedup": slow_near_dedup, "mixing": slow_mixing}


def test_each_stage_and_the_whole_equal_plain_computations(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.asDict() for r in docs.collect()), key=lambda r: r["doc_id"])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, spark.createDataFrame([tuple(r.values()) for r in rows], docs.schema), SF)
        want = SLOW[name](spark, rows, SF)
        rows = sorted((r.asDict() for r in got.collect()), key=lambda r: r["doc_id"])
        assert rows == want, name
        assert name in ("toxicity", "line_dedup") or len(want) < 1000
    pieces = [tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "piece", "start", "length", "text", "bucket_pieces", "batch").collect()]
    assert sorted(pieces) == slow_packing(rows)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_nulls_and_repeated_rows(spark, name):
    """A null in each column, rows repeated, empty and blank texts, and columns with clashing names, through every stage."""
    from pyspark.sql import functions as F

    base = [(i, f"text number {i} with some words of its own {i * 7} {i * 11} {i * 13}", "en", f"s{i % 3}", 40) for i in range(30)]
    odd = [(None, "a text without an id", "en", "s1", 1), (1000, None, "en", "s1", 1), (1001, "a text without a language", None, "s1", 1), (1002, "a text without a source", "en", None, 1), (1003, "", "en", "s1", 0), (1004, " \n ", "en", "s1", 3), (None, None, None, None, None)]
    twice = [(2000, "a row that is there two times and more words", "en", "s1", 5)] * 2
    docs = spark.createDataFrame(base + odd + twice, SCHEMA)
    for c in ("row", "content", "keep", "batch", "length", "u", "topic", "probability", "drop", "score"):
        docs = docs.withColumn(c, F.lit(c))
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    got = out.collect()
    ids = Counter(r["doc_id"] for r in got)
    if name == "packing":
        assert set(ids) == {*range(30), None, 1001, 1002, 1004, 2000} and ids[2000] % 2 == 0
        return
    assert out.columns == docs.columns and all(r["row"] == "row" for r in got)
    if name in ("toxicity", "line_dedup"):
        assert ids == Counter(r[0] for r in base + odd + twice)
    elif name == "near_dedup":
        assert ids[2000] == 1 and {None, 1000, 1003, 1004} <= set(ids) and ids[None] == 2
    else:
        assert ids[2000] in (0, 2) and set(ids) <= {r[0] for r in base + odd + twice}
