"""Toxicity by a factorization machine over hashed terms.

``score = sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>)`` over the distinct terms of a document: words and
their prefixes of four and five bytes. The pairwise part weighs terms that are harmful only together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyloom.llm.groups import row_ids
from polyloom.llm.tokens import Words, portions

#: Labelled documents that the model is fitted on, at most so many of each class, chosen by a hash of their ids.
MAX_PER_CLASS = 4000
LOG_TERMS = 22
#: Factors of a term; steps of the linear part alone, of both parts, and of the terms that are left with less shrinkage.
FACTORS, STEPS = 4, (25, 30, 60)
#: A weight moves from zero if its gradient is more than so many standard errors of what chance gives a term of its frequency (and more than
#: one document alone can give); a vector of factors likewise. All terms are trained; none is chosen by its own share in the classes.
ERRORS, PAIR_ERRORS, RELAXED = 4.0, 4.5, 0.05
RATE, PAIR_RATE, START = 0.2, 0.05, 0.01
THRESHOLD = 0.5


@dataclass(frozen=True)
class Model:
    """``terms``: sorted hashes below 2**LOG_TERMS; ``w``, ``v``: their weights and factors."""

    terms: np.ndarray
    w: np.ndarray
    v: np.ndarray
    b: float


def _terms(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(rows, hashed terms), with repetitions."""
    mask = np.uint64((1 << LOG_TERMS) - 1)
    parts = [words.hashes(None, 1) & mask, words.hashes(4, 2) & mask, words.hashes(5, 3) & mask]
    return np.concatenate([words.rows] * 3), np.concatenate(parts).astype(np.int64)


def document_terms(texts: pa.Array) -> list[np.ndarray]:
    """The distinct hashed terms of each text."""
    out: list[np.ndarray] = []
    for a, b, data, offsets in portions(texts):
        rows, terms = _terms(Words(data, offsets))
        keys = np.unique((rows << LOG_TERMS) | terms)
        cuts = np.searchsorted(keys, np.arange(b - a + 1) << LOG_TERMS)
        out += [(keys[s:e] & ((1 << LOG_TERMS) - 1)).astype(np.int32) for s, e in zip(cuts[:-1], cuts[1:])]
    return out


def _by_term(term: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents ordered by term, where each term begins)."""
    counts = np.bincount(term, minlength=n)
    return doc[np.argsort(term, kind="stable")], np.cumsum(counts) - counts


def fit(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, seed: int = 7, factors: int = FACTORS) -> Model | None:
    """On ``rows`` of distinct terms, by proximal AdaGrad on the whole gradient; None unless both classes occur.

    The loss has an L1 penalty on each weight and one on the length of each vector of factors, both in proportion to the standard
    error of the term's gradient where the term means nothing, so that a term without part in any pattern stays at zero exactly. The linear part is
    fitted first, then factors join it on what it leaves over; at the end, the terms that moved are fitted again with little shrinkage.
    ``factors`` = 0: the linear part alone.
    """
    y, n = labels.astype(np.float64), len(rows)
    if not n or y.min() == y.max():
        return None
    wt = weights / weights.mean()
    doc = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    names, term = np.unique(np.concatenate(rows), return_inverse=True)
    term, m, k = term.astype(np.int32), len(names), max(1, factors)
    rng = np.random.default_rng(seed)
    base = float(wt @ y) / n
    bias, gb = np.log(base / (1 - base)), 1e-12
    w, v, gw, gv = np.zeros(m), np.zeros((m, k)), np.full(m, 1e-12), np.full(m, 1e-12)
    docs, cut = _by_term(term, doc, m)
    often = np.bincount(term, minlength=m).astype(np.float64)
    least, shrink = None, 1.0
    for step in range(sum(STEPS)):
        if step == STEPS[0] and factors:
            v = rng.normal(0, START, (m, k))
        if step == STEPS[0] + STEPS[1]:
            kept = (w != 0) | (v != 0).any(1)
            if not kept.any():
                break
            at, on = (np.cumsum(kept) - 1).astype(np.int32), kept[term]
            term, doc, names, w, v, often, m = at[term[on]], doc[on], names[kept], w[kept], v[kept], often[kept], int(kept.sum())
            docs, cut = _by_term(term, doc, m)
            gw, gv, gb, shrink = np.full(m, 1e-12), np.full(m, 1e-12), 1e-12, RELAXED
        on = (w != 0)[term]
        z = bias + np.bincount(doc[on], w[term[on]], n)
        paired = (v != 0).any(1)
        if paired.any():
            on = paired[term]
            d, t = doc[on], term[on]
            s = np.stack([np.bincount(d, v[t, i], n) for i in range(k)], 1)
            z += 0.5 * ((s * s).sum(1) - np.bincount(d, (v * v).sum(1)[t], n))
        r = wt * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        spread = (r * r).mean()
        least = least or spread / 4
        spread = max(spread, least)
        dw = np.add.reduceat((r / n)[docs], cut)
        gw += dw * dw
        gb += r.mean() ** 2
        rate = RATE / np.sqrt(gw)
        w = w - rate * dw
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * shrink * (ERRORS * np.sqrt(often * spread) + np.abs(r).max()) / n)
        bias -= RATE / np.sqrt(gb) * r.mean()
        if paired.any():
            own, at = np.flatnonzero(paired), np.cumsum(paired) - 1
            dv = np.stack([np.bincount(at[t], (r * s[:, i])[d], len(own)) for i in range(k)], 1) / n - dw[own, None] * v[own]
            noise = np.sqrt(spread * np.bincount(at[t], (s * s).sum(1)[d], len(own))) / n
            gv[own] += (dv * dv).sum(1)
            rate = PAIR_RATE / np.sqrt(gv[own])
            new = v[own] - rate[:, None] * dv
            v[own] = new * np.maximum(0, 1 - rate * shrink * PAIR_ERRORS * noise / np.maximum(1e-12, np.sqrt((new * new).sum(1))))[:, None]
    kept = (w != 0) | (v != 0).any(1)
    return Model(names[kept].astype(np.int64), w[kept], v[kept], float(bias))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", factors: int = FACTORS) -> Model | None:
    """Fits on at most ``MAX_PER_CLASS`` labelled documents of each class; the classes' shares in ``labels`` are restored by weights.

    What comes to the driver is the distinct hashed terms of those documents: at most 2**LOG_TERMS numbers each, however long the text.

    labels: doc_id, toxic (0 or 1; nulls are ignored; of several labels the greatest counts). None if a class is missing.
    """
    clean = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    shares = {int(r["toxic"]): r["n"] for r in clean.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not (shares.get(0) and shares.get(1)):
        return None
    order = F.xxhash64(F.col("doc_id"), F.lit(11))
    picked = [clean.where(F.col("toxic") == k).orderBy(order).limit(MAX_PER_CLASS) for k in (0, 1)]
    # two numbers for each of at most 2 * MAX_PER_CLASS documents: this side's size is bounded
    sample = F.broadcast(picked[0].unionByName(picked[1]).select(F.col("doc_id").alias("label_id"), "toxic"))

    @F.arrow_udf("array<int>")
    def terms_of(texts: pa.Array) -> pa.Array:
        return pa.array(document_terms(texts), pa.list_(pa.int32()))

    base = row_ids(docs, id_col, text_col).where("text is not null")
    got = base.join(sample, F.col("doc_id") == F.col("label_id")).select("doc_id", "toxic", terms_of(F.lower("text")).alias("terms")).toArrow().sort_by("doc_id")
    y = got["toxic"].to_numpy()
    if not len(y) or y.min() == y.max():
        return None
    terms = got["terms"].combine_chunks()
    cuts = terms.offsets.to_numpy()
    flat = terms.values.to_numpy()
    rows = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    each = np.array([shares[0] / max(1, (y == 0).sum()), shares[1] / max(1, (y == 1).sum())])
    weights = each[y]
    return fit(rows, y, weights / weights.mean(), factors=factors)


def score_texts(texts: pa.Array, model: Model) -> np.ndarray:
    """The probability of each text, from all of its words."""
    used = np.zeros(1 << LOG_TERMS, bool)
    used[model.terms] = True
    scores = np.full(len(texts), model.b)
    for a, b, data, offsets in portions(texts):
        rows, terms = _terms(Words(data, offsets))
        hit = used[terms]
        keys = np.unique((rows[hit] << LOG_TERMS) | terms[hit])
        d, t = keys >> LOG_TERMS, np.searchsorted(model.terms, keys & ((1 << LOG_TERMS) - 1))
        v = model.v[t]
        s = np.stack([np.bincount(d, v[:, k], b - a) for k in range(v.shape[1])], 1)
        scores[a:b] += np.bincount(d, model.w[t], b - a) + 0.5 * ((s * s).sum(1) - np.bincount(d, (v * v).sum(1), b - a))
    return 1 / (1 + np.exp(-np.clip(scores, -30, 30)))


def toxicity_score(model: Model | None, text: Column) -> Column:
    """Null for a null text, or if there is no model. An empty text has the score of no terms."""
    if model is None:
        return F.lit(None).cast("double")

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(score_texts(texts, model), mask=np.asarray(texts.is_null()))

    return score(F.lower(text))


def toxic_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``THRESHOLD``: doc_id, score.

    A null text is never toxic. Repeated rows are scored each; a null doc_id is kept. Other columns are ignored.
    Empty docs, or labels without both classes: no rows. Fitting is bounded, scoring reads every text whole, without a shuffle.
    """
    model = train(docs, labels, id_col, text_col)
    return row_ids(docs, id_col, text_col).select("doc_id", toxicity_score(model, F.col("text")).alias("score")).where(F.col("score") >= THRESHOLD)


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its toxic rows, all columns kept; a null text stays."""
    model = train(docs, labels, id_col, text_col)
    if model is None:
        return docs
    return docs.where(F.coalesce(toxicity_score(model, F.col(f"`{text_col}`")) < THRESHOLD, F.lit(True)))
