"""Operator 2, language identification: mixtures of languages by expectation maximisation over n-gram likelihoods."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, workers_import
from .quality import held_out

#: Hashed character trigrams, smoothing of their counts, EM steps, penalty per added language as a multiple of
#: half the log of the number of words; a word's log-likelihoods are tempered, as its trigrams overlap.
BITS, SMOOTH, STEPS, PENALTY, TEMPER = 15, 0.5, 12, 2.0, 0.5
_letters: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0][codes]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed trigram of each letter with the two characters before it in its word, first letters of words, word
    limits of the texts). Words are runs of letters, lower-cased, with a boundary before and after: the trigram that
    ends a word is the boundary's, counted at the last letter."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])])
    letter = _is_letter(codes) if len(codes) else np.zeros(0, bool)
    c = np.where(letter, codes, 0).astype(np.uint64)
    c1, c2 = np.concatenate([[0], c[:-1]]).astype(np.uint64), np.concatenate([[0, 0], c[:-2]])[: len(c)].astype(np.uint64)
    c2 = np.where(c1 == 0, 0, c2)
    gram = mix(((c2 * np.uint64(0x110000) + c1) * np.uint64(0x110000) + c)) & np.uint64((1 << BITS) - 1)
    use = letter | (c1 != 0)  # letters, and the boundary after a word
    index = np.flatnonzero(use)
    first = np.flatnonzero((letter & (c1 == 0))[index]) if len(index) else np.zeros(0, np.int64)
    limits = np.searchsorted(index[first], np.minimum(at, len(codes)))
    return gram[index].astype(np.int64), first, limits


def _groups(texts: list[str], most: int = 1 << 20):
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= most):
            n += len(texts[j])
            j += 1
        yield i, texts[i:j]
        i = j


def _count(batches):
    """Per partition and language: how often each hashed trigram occurs."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        for lang in set(langs):
            own = counts.setdefault(lang, np.zeros(1 << BITS, np.int64))
            for _, some in _groups([t for t, x in zip(texts, langs, strict=True) if x == lang]):
                own += np.bincount(trigrams(some)[0], minlength=1 << BITS)
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], ["lang", "gram", "n"])


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities [2**BITS, languages]) from all rows of ``docs`` with a lang."""
    workers_import(docs.sparkSession)
    counted = docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(_count, "lang string, gram int, n long")
    got = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # 2**BITS rows a language at most
    names = sorted(set(got["lang"].to_pylist()))
    table = np.full((1 << BITS, len(names)), SMOOTH)
    if names:
        place = {x: i for i, x in enumerate(names)}
        table[got["gram"].to_numpy(), [place[x] for x in got["lang"].to_pylist()]] += got["n"].to_numpy()
    return names, np.log(table / table.sum(0, keepdims=True)).astype(np.float32)


def _em(like: np.ndarray, top: np.ndarray, doc: np.ndarray, start: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document; like: of each word under each language, over exp(top)."""
    n = np.diff(np.append(start, len(like)))[:, None]
    for _ in range(STEPS):
        part = like * share[doc]
        part /= part.sum(1, keepdims=True)
        share = np.add.reduceat(part, start) / n
    return share, np.add.reduceat(np.log((like * share[doc]).sum(1)) + top, start)


def infer(texts: list[str], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions [texts, languages], has letters). A first fit of all languages ranks them; the sets of the best one,
    two, ... are fitted in turn, as long as the log-likelihood gains more than the penalty."""
    gram, first, limits = trigrams(texts)
    out, n = np.zeros((len(texts), logp.shape[1])), np.diff(limits)
    has = np.flatnonzero(n)
    if not len(has) or not logp.shape[1]:
        return out, n > 0
    ll = np.add.reduceat(logp[gram], first).astype(np.float64) * TEMPER
    top = ll.max(1)
    like = np.maximum(np.exp(ll - top[:, None]), 1e-30)
    start, doc = limits[has], np.repeat(np.arange(len(has)), n[has])
    size = logp.shape[1]
    share, _ = _em(like, top, doc, start, np.full((len(has), size), 1 / size))
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
    sums = np.add.reduceat(ll, start)
    best = sums.argmax(1)
    lead = rank[np.arange(len(has)), best]
    swap = rank == 0
    rank[np.arange(len(has)), best] = 0
    rank = np.where(swap & (np.arange(size) != best[:, None]), lead[:, None], rank)  # the best single language leads
    chosen, value = (rank == 0).astype(float), sums.max(1)
    active = np.arange(len(has))
    for k in range(2, size + 1):
        word = np.isin(doc, active)
        own = np.searchsorted(active, doc[word])
        begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        guess = (rank[active] < k) / k
        fit, new = _em(like[word], top[word], own, begin, guess)
        better = new - value[active] > 0.5 * PENALTY * np.log(n[has][active] + 1) + 1
        if not better.any():
            break
        active = active[better]
        chosen[active], value[active] = fit[better], new[better]
    out[has] = chosen
    return out, n > 0


def predict(docs: DataFrame, names: list[str], logp: np.ndarray) -> DataFrame:
    """``docs`` (doc_id, text) with lang_pred, score (its proportion) and n_langs. ``und``, 0 and 0 if the text is null
    or has no letter, or nothing was learned."""
    held = docs.sparkSession.sparkContext.broadcast((names, logp))

    def run(batches):
        names, logp = held.value
        for batch in batches:
            lang, score, count = [], [], []
            for _, some in _groups([t or "" for t in batch.column(1).to_pylist()]):
                share, has = infer(some, logp)
                for row, ok in zip(share, has & bool(names), strict=True):
                    best = int(row.argmax()) if ok else 0
                    lang.append(names[best] if ok else "und")
                    score.append(min(1.0, float(row[best])) if ok else 0.0)
                    count.append(int((row > 0.01).sum()) if ok else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(count, pa.int32())], ["doc_id", "lang_pred", "score", "n_langs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, n_langs int")


def op2_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, logp = train(docs.where(~held_out(4, 2)))
    return predict(docs, names, logp).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "n_langs")
