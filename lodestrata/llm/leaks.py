"""Evaluation texts leaking into a corpus, by latent semantic retrieval and common subsequences.

Passages are windows of words, weighted by TF-IDF over the words of the evaluation items (the item set is
small and fixed, the document frequencies are counted over the whole corpus). A randomised SVD of the
passage matrix, sketched in one pass and added up as a tree, gives a latent space; passages of a document
that lie close to one of an item there are aligned with it, and the longest common subsequence, with a
price for what is left out, decides.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import Workspace, spread


# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(dict(zip("аеорсхуіјѕһԁԛԝкмтвнοαενρτυικАВЕКМНОРСТХУІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcxyijshdqwkmtbhoaevptuikABEKMHOPCTXYIJSABEZHIKMNOPTYX")))
WORD = re.compile(r"[\p{L}\p{M}\p{Nd}]+")
ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})")
MARKUP = re.compile(r"</?[A-Za-z][^<>\n]*>|&[a-z]{2,6};|\\[nrt]")
#: Passages weighted at a time, which bounds the memory of a task.
SLICE = 2048
INVISIBLE = re.compile("[​-‏­⁠﻿]")


def words(text: str | None) -> list[str]:
    """The words of a text without case, formatting, look-alike letters and invisible characters."""
    if not text:
        return []
    if "\\u" in text:
        text = ESCAPED.sub(lambda m: chr(int(m.group(1), 16)), text)
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).translate(LOOKALIKES)
    if "<" in text or "&" in text or "\\" in text:
        text = MARKUP.sub(" ", text)
    return WORD.findall(text.casefold())


@dataclass(frozen=True)
class Settings:
    """window, doc_stride, item_stride: passages in words; least_terms: item words a passage needs; rank, extra: of the
    SVD and its oversampling; other: weight of words the items do not have; known: share of its weight that the items' words must have; close: cosine in the latent space from which a passage is a candidate; shared: length in words of a
    wording that makes it stock if two items have it; gap: price of a word left out, put in or changed; least: score of a leak;
    most_items: items that go to every task at most."""

    window: int = 14
    doc_stride: int = 3
    item_stride: int = 5
    least_terms: int = 4
    rank: int = 160
    extra: int = 32
    other: float = 2.5
    known: float = 0.5
    close: float = 0.65
    shared: int = 6
    gap: float = 1.0
    least: float = 9.5
    most_items: int = 20_000
    seed: int = 7


@dataclass
class Items:
    """What is known of the evaluation items; a few hundred, so it goes to every task."""

    ids: list[int]
    tokens: list[np.ndarray]
    own: list[np.ndarray]
    vocabulary: dict[str, int]
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    basis: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    latent: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    passage_item: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    steps: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    any_step: np.ndarray = field(default_factory=lambda: np.zeros((1, 0), np.float32))


def prepare(items: DataFrame, s: Settings) -> Items:
    """Items by id, their words as numbers and which words count: those outside wording that two items share."""
    held = items.select("item_id", "text").where("item_id is not null and text is not null").distinct().limit(s.most_items + 1).collect()
    if len(held) > s.most_items:
        raise ValueError(f"more than {s.most_items} evaluation items; search them in parts")
    rows = sorted((r[0], r[1]) for r in held)
    texts = [words(t) for _, t in rows]
    seen: dict[tuple[str, ...], set[int]] = {}
    for k, w in enumerate(texts):
        for j in range(len(w) - s.shared + 1):
            seen.setdefault(tuple(w[j : j + s.shared]), set()).add(k)
    own = []
    for k, w in enumerate(texts):
        mask = np.ones(len(w), bool)
        for j in range(len(w) - s.shared + 1):
            if len(seen[tuple(w[j : j + s.shared])]) > 1:
                mask[j : j + s.shared] = False
        own.append(mask)
    vocabulary = {w: n for n, w in enumerate(sorted({w for t, m in zip(texts, own) for w, o in zip(t, m) if o}))}
    return Items([i for i, _ in rows], [np.array([vocabulary.get(w, -1) for w in t], dtype=np.int64) for t in texts], own, vocabulary)


def _coded(text: str | None, vocabulary: dict[str, int]) -> np.ndarray:
    return np.array([vocabulary.get(w, -1) for w in words(text)], dtype=np.int32)


def _passages(t: np.ndarray, stride: int, s: Settings, weigh: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(starts, matrix of word numbers) of the windows of a text that have enough words of the items; -1 stands for others."""
    n = len(t)
    if n == 0:
        return np.zeros(0, int), np.zeros((0, s.window), np.int64)
    padded = np.r_[t, np.full(s.window, -1)]
    known = np.r_[0, np.cumsum(padded >= 0)]
    starts = np.arange(0, max(1, n - s.window + stride), stride)
    starts = starts[known[np.minimum(starts + s.window, n)] - known[starts] >= s.least_terms]
    return starts, padded[starts[:, None] + np.arange(s.window)]


def _weights(p: np.ndarray, idf: np.ndarray, other: float) -> tuple[np.ndarray, np.ndarray]:
    """(weights by place, share of the length that the items' words have) of passages as vectors of length one.

    Words outside the items' vocabulary have the weight other and stand at right angles to everything; the share
    is thus the most a passage's cosine with any item can be.
    """
    w = np.where(p >= 0, idf[p], 0.0)
    known = np.sqrt((w**2).sum(axis=1))
    whole = np.sqrt(known**2 + other**2 * (p < 0).sum(axis=1))
    whole = np.where(whole > 0, whole, 1.0)
    return w / whole[:, None], known / whole


def _dense(p: np.ndarray, w: np.ndarray, terms: int) -> np.ndarray:
    a = np.zeros((len(p), terms + 1), np.float32)
    for j in range(p.shape[1]):
        a[np.arange(len(p)), p[:, j]] += w[:, j]
    return a[:, :-1]


def _latent(p: np.ndarray, w: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The passages in the latent space, as vectors of length one."""
    x = np.einsum("nw,nwk->nk", w.astype(np.float32), basis[p], optimize=True)
    return x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-9)


def coded_documents(docs: DataFrame, items: Items, s: Settings, text: str = "text") -> DataFrame:
    """(doc_id, words, term, n) in one pass over the texts: the words of each document as numbers, where a passage has enough
    of the items' words; and, with a null doc_id, numbers of documents by word, of all documents at -1, counted per partition."""
    vocabulary, names = items.vocabulary, ["doc_id", "words", "term", "n"]
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, df = 0, np.zeros(len(vocabulary), np.int64)
        for b in batches:
            n += len(b)
            rows = []
            for i, t in zip(b["doc_id"], b["t"]):
                c = _coded(t, vocabulary)
                df[np.unique(c[c >= 0])] += 1
                if len(_passages(c, s.doc_stride, s)[0]):
                    rows.append((i, c.tobytes(), None, None))
            yield pd.DataFrame(rows, columns=names)
        some = np.flatnonzero(df)
        yield pd.DataFrame({"doc_id": None, "words": None, "term": np.r_[-1, some], "n": np.r_[n, df[some]]}, columns=names)

    d = docs.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col(text)).alias("t"))
    return spread(d).mapInPandas(run, f"doc_id {kind}, words binary, term int, n long")


def document_frequency(coded: DataFrame, items: Items) -> tuple[int, np.ndarray]:
    """The number of documents and, for each word of the items, of documents that have it."""
    counts = coded.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(items.vocabulary))
    for term, n in ((r[0], r[1]) for r in counts):
        if term >= 0:
            df[term] = n
    return sum(r[1] for r in counts if r[0] == -1), df


def latent_space(coded: DataFrame, items: Items, s: Settings, fan_in: int = 32) -> np.ndarray:
    """The leading right singular vectors of the passage matrix A (words x rank), from one pass.

    Each partition sketches A'A times a random matrix; the sketches, of fixed size, are added up in two steps, and the
    Nystroem form of A'A gives the vectors. The items' own passages are part of A, so their words span it too.
    """
    v, k = len(items.vocabulary), min(len(items.vocabulary), s.rank + s.extra)
    omega = np.random.default_rng(s.seed).standard_normal((v, k)).astype(np.float32)
    idf = items.idf

    def add_to(z: np.ndarray, p: np.ndarray) -> None:
        for at in range(0, len(p), SLICE):
            q = p[at : at + SLICE]
            w, share = _weights(q, idf, s.other)
            a = _dense(q[share >= s.known], w[share >= s.known], v)
            z += a.T @ (a @ omega)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z, held, rows = np.zeros((v, k)), [], 0
        for b in batches:
            for t in b["words"]:
                held.append(_passages(np.frombuffer(t, np.int32), s.window, s)[1])
                if (rows := rows + len(held[-1])) >= SLICE:
                    add_to(z, np.concatenate(held))
                    held, rows = [], 0
        if rows:
            add_to(z, np.concatenate(held))
        yield pd.DataFrame({"z": [z.tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = np.zeros(v * k)
        for b in batches:
            for x in b["z"]:
                z += np.frombuffer(x)
        yield pd.DataFrame({"z": [z.tobytes()]})

    parts = spread(coded.where("words is not null").select("words")).mapInPandas(sketch, "z binary").repartition(fan_in).mapInPandas(add, "z binary").coalesce(4).mapInPandas(add, "z binary")
    z = sum((np.frombuffer(r[0]).reshape(v, k) for r in parts.collect()), np.zeros((v, k)))
    p = np.concatenate([_passages(np.where(o, t, -1), s.item_stride, s)[1] for t, o in zip(items.tokens, items.own)])
    own = _dense(p, _weights(p, items.idf, s.other)[0], v)
    z = z + own.T @ (own @ omega)
    c = omega.T @ z
    val, vec = np.linalg.eigh((c + c.T) / 2)
    good = val > val.max() * 1e-10
    u, _, _ = np.linalg.svd(z @ (vec[:, good] / np.sqrt(val[good])), full_matrices=False)
    return u[:, : s.rank]


def align(d: np.ndarray, t: np.ndarray, own: np.ndarray, gap: float) -> tuple[float, int, int]:
    """(score, first, last) of the best common subsequence of an item and a stretch of a document, places in the document.

    A word of the item's own wording in common counts one, stock wording nothing; a word left out, put in or
    changed costs gap. Words outside the items' vocabulary match nothing.
    """
    m = len(t)
    places, step = np.arange(m + 1), np.arange(m + 1) * gap
    row, start, full, o = np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1), np.zeros(m + 1, int)
    best, gains = (0.0, 0, 0), {}
    for i, w in enumerate(d.tolist()):
        diag = row[:-1] - gap
        if w >= 0:
            if w not in gains:
                gains[w] = np.where(own & (t == w), 1.0 + gap, np.where(t == w, gap, 0.0))
            diag += gains[w]
        up = row[1:] - gap
        use = diag >= up
        np.maximum(diag, up, out=full[1:])
        o[1:] = np.where(use, start[:-1], start[1:])
        dead = full <= 0.0
        full[dead], o[dead] = 0.0, i + 1
        height = full + step  # leaving out words of the item
        run = np.maximum.accumulate(height)
        src = np.maximum.accumulate(np.where(height >= run, places, 0))
        row, start = run - step, o[src]
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (float(row[j]), int(start[j]), i)
    return best


def _reach(d: np.ndarray, steps: np.ndarray, block: int = 4096) -> np.ndarray:
    """For each row of steps (items by words), the most that an alignment with a stretch of d can score: each word the item has counts one, any other costs gap."""
    best, held = np.zeros(len(steps), np.float32), np.zeros((len(steps), 1), np.float32)
    for at in range(0, len(d), block):
        run = held + np.cumsum(steps[:, d[at : at + block]], axis=1)
        low = np.minimum(np.minimum.accumulate(np.concatenate([held, run[:, :-1]], axis=1), axis=1), 0)
        now = run - low
        best, held = np.maximum(best, now.max(axis=1)), np.maximum(now[:, -1:], 0)
    return best


def _near(t: np.ndarray, items: Items, s: Settings) -> list[tuple[int, float, int, int]]:
    if _reach(t, items.any_step)[0] < s.least:
        return []
    able = _reach(t, items.steps) >= s.least
    if not able.any():  # no item can be aligned with the text up to the score
        return []
    starts, p = _passages(t, s.doc_stride, s)
    mine = np.flatnonzero(able[items.passage_item])
    latent, passage_item = items.latent[mine], items.passage_item[mine]
    found: dict[int, list[int]] = {}
    for part in range(0, len(starts), SLICE // 4):
        q = p[part : part + SLICE // 4]
        w, share = _weights(q, items.idf, s.other)
        some = np.flatnonzero(share >= s.known)
        if not len(some):
            continue
        row, col = np.nonzero(_latent(q[some], w[some], items.basis) @ latent.T >= s.close)
        pairs = np.unique(passage_item[col] * len(starts) + part + some[row])
        for k, at in zip((pairs // len(starts)).tolist(), starts[pairs % len(starts)].tolist()):
            found.setdefault(k, []).append(at)
    out = []
    for k, places in found.items():
        best, lo = (0.0, 0, 0), 0
        while lo < len(places):  # stretches of the document around the candidates, each aligned once
            hi = lo
            while hi + 1 < len(places) and places[hi + 1] - places[hi] <= 2 * s.window:
                hi += 1
            a, b = max(0, places[lo] - s.window), places[hi] + 2 * s.window
            lo = hi + 1
            if _reach(t[a:b], items.steps[k : k + 1])[0] < max(s.least, best[0]):
                continue
            got = align(t[a:b], items.tokens[k], items.own[k], s.gap)
            if got[0] > best[0]:
                best = (got[0], got[1] + a, got[2] + a)
        if best[0] >= s.least:
            out.append((items.ids[k], best[0], best[1], best[2]))
    return out


def find_leaks(docs: DataFrame, eval_items: DataFrame, settings: Settings = Settings(), text: str = "text", ws: Workspace | None = None) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word): every document that carries a passage of an item.

    One pass over whole texts turns them into numbers of words; the sketch of the SVD and the candidates with their
    alignment read those. Only counts and sketches of fixed size move. Null and empty texts carry nothing; copies of a
    document are cases each; no items or no words of their own give an empty result. The items are a bounded held-out
    set: more than settings.most_items are refused.
    """
    s = settings
    items = prepare(eval_items, s)
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, item_id {dict(eval_items.dtypes)['item_id']}, score double, first_word int, last_word int"
    if not items.vocabulary:
        return spark.createDataFrame([], schema)
    coded = (ws or Workspace(spark)).save(coded_documents(docs, items, s, text), "coded")
    n, df = document_frequency(coded, items)
    items.idf = np.log((n + 1.0) / (df + 1.0)) + 1e-3
    items.basis = latent_space(coded, items, s)
    own = [_passages(np.where(o, t, -1), s.item_stride, s)[1] for t, o in zip(items.tokens, items.own)]
    items.passage_item = np.repeat(np.arange(len(own)), [len(p) for p in own])
    # the row after the last word is that of all other words
    items.basis = np.vstack([items.basis, np.zeros((1, items.basis.shape[1]))]).astype(np.float32)
    items.steps = np.full((len(own), len(items.vocabulary) + 1), -s.gap, np.float32)
    for k, (t, o) in enumerate(zip(items.tokens, items.own)):
        items.steps[k, t[o]] = 1.0
    items.any_step = items.steps.max(axis=0, keepdims=True)
    p = np.concatenate(own)
    items.latent = _latent(p, _weights(p, items.idf, s.other)[0], items.basis)
    held = spark.sparkContext.broadcast(items)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *hit) for i, t in zip(b["doc_id"], b["words"]) for hit in _near(np.frombuffer(t, np.int32), held.value, s)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "first_word", "last_word"])

    return spread(coded.where("words is not null").select("doc_id", "words")).mapInPandas(run, schema)
