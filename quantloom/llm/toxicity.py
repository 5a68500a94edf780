"""Operator 9, toxicity: bidirectional gated recurrent network with attention pooling over character and word inputs,
trained in numpy, scoring all overlapping windows."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOW, _WS, chunks, mix, powers, words, workers_import
from .quality import held_out, labelled

#: Words in a window and between the starts of two.
WIDTH, STRIDE = 32, 16
#: Hashed words and their dimensions; hashed character grams and theirs, the first of which are pooled by the largest
#: value of a word's grams, the others by the mean; hidden units each way, attention units.
WORDS, WORD_DIM, GRAMS, GRAM_DIM, LARGEST, HIDDEN, ATTEND = 1 << 16, 8, 1 << 16, 6, 2, 8, 8
#: A word's grams: its beginnings of 4 to 8 bytes, and all runs of 6 bytes; all of it where it is shorter.
BEGIN, RUN = (4, 8), 6
#: Labelled documents to learn from at most; rounds, for each of which windows are chosen, and updates in a round; windows in
#: a batch, step.
MOST_LABELS, ROUNDS, UPDATES, BATCH, STEP = 4000, 2, 96, 128, 0.01
#: Words and grams in fewer labelled documents have no embedding of their own.
LEAST_DOCS = 5
_INPUT = WORD_DIM + GRAM_DIM


def tokens(data: np.ndarray, at: np.ndarray):
    """(word ids, gram ids of all words in order, first gram of each word, document limits)."""
    h, start, limits = words(data, at)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), limits
    up, back = powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LOW[data] * up[: len(data)], dtype=np.uint64)])
    solid = ~_WS[data]
    word = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(data))))[: len(data) - start[0]]
    byte = np.flatnonzero(solid)
    word = word[byte - start[0]]
    place = byte - start[word]
    last = np.empty(len(byte), bool)
    last[:-1], last[-1] = word[1:] != word[:-1], True
    run = (place >= RUN - 1) | last  # runs of RUN bytes, or the whole of a shorter word
    begin = (place >= BEGIN[0] - 1) & (place < BEGIN[1])
    length = np.minimum(RUN, place + 1)
    from_ = byte + 1 - length
    runs = mix((total[byte + 1] - total[from_]) * back[from_]) | np.uint64(1)
    begins = mix((total[byte + 1] - total[start[word]]) * back[start[word]]) & ~np.uint64(1)
    grams = np.stack([runs, begins], 1)
    use = np.stack([run, begin], 1)
    first = np.searchsorted(np.repeat(word, use.sum(1)), np.arange(len(start)))
    return (h % np.uint64(WORDS)).astype(np.int32), (grams[use] % np.uint64(GRAMS)).astype(np.int32), first, limits


def window_starts(limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, document) of all windows: every STRIDE words until the text's end is covered."""
    n = np.diff(limits)
    count = np.where(n > 0, np.maximum(0, -(-(n - WIDTH) // STRIDE)) + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return limits[doc] + k * STRIDE, limits[doc + 1], doc


def new_model(rng) -> dict[str, np.ndarray]:
    f = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    m = {"words": (rng.standard_normal((WORDS, WORD_DIM)) * 0.05).astype(np.float32), "grams": (rng.standard_normal((GRAMS, GRAM_DIM)) * 0.05).astype(np.float32)}
    for d in "fb":
        m |= {f"x{d}": f(_INPUT, 3 * HIDDEN), f"h{d}": f(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return m | {"att": f(2 * HIDDEN, ATTEND), "pick": f(ATTEND), "out": f(2 * HIDDEN), "bias": np.full(1, -1.5, np.float32)}


def inputs(m, ids, grams, first):
    """Word vectors: embedding of the hashed word beside the pooled embeddings of its grams; and the grams of each word."""
    n = np.diff(np.append(first, len(grams)))
    if not len(first):
        return np.zeros((0, _INPUT), np.float32), n
    own = m["grams"][grams]
    pooled = [np.maximum.reduceat(own[:, :LARGEST], first), np.add.reduceat(own[:, LARGEST:], first) / n[:, None]]
    return np.concatenate([m["words"][ids], *pooled], 1).astype(np.float32), n


def windows_logits(m, ids, grams, first, start, end, chosen, at_once: int = 2048):
    """Logits of the windows chosen, some at a time: only the words between the first and the last are made vectors."""
    out = np.empty(len(chosen), np.float32)
    for i in range(0, len(chosen), at_once):
        w = chosen[i : i + at_once]
        lo, hi = start[w].min(), min(end[w].max(), start[w].max() + WIDTH)
        a, b = first[lo], first[hi] if hi < len(first) else len(grams)
        x, _ = inputs(m, ids[lo:hi], grams[a:b], first[lo:hi] - a)
        out[i : i + at_once] = forward(m, x, start[w] - lo, end[w] - lo)
    return out


def _sig(x):
    return 1 / (1 + np.exp(-x))


def _gru(proj, u, mask, keep):
    """States of one direction. proj: [steps, windows, 3 * HIDDEN]; keep: what the way back needs."""
    h = np.zeros((proj.shape[1], HIDDEN), np.float32)
    out = []
    for t in range(len(proj)):
        hu = h @ u
        zr = _sig(proj[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r, hn = zr[:, :HIDDEN], zr[:, HIDDEN:], hu[:, 2 * HIDDEN :]
        n = np.tanh(proj[t, :, 2 * HIDDEN :] + r * hn)
        new = n + z * (h - n)
        if mask is not None:
            new = np.where(mask[t][:, None], new, h)
        if keep is not None:
            keep.append((h, z, r, n, hn))
        h = new
        out.append(h)
    return np.stack(out)


def _gru_back(g, u, mask, keep):
    """Gradients of proj and u from those of the states."""
    dp, du, dh = np.zeros((*g.shape[:2], 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros(g.shape[1:], np.float32)
    for t in range(len(g) - 1, -1, -1):
        h, z, r, n, hn = keep[t]
        dh = dh + g[t]
        on = mask[t][:, None]
        d = np.where(on, dh, 0)
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h - n) * z * (1 - z)
        dr = dn * hn * r * (1 - r)
        dhu = np.concatenate([dz, dr, dn * r], 1)
        dp[t] = np.concatenate([dz, dr, dn], 1)
        du += h.T @ dhu
        dh = np.where(on, d * z, dh) + dhu @ u.T
    return dp, du


def forward(m, x, start, end, keep=None):
    """Logits of windows over the word vectors x."""
    at = start[None, :] + np.arange(WIDTH)[:, None]
    mask = at < end[None, :]
    whole = mask.all()
    index = np.minimum(at, len(x) - 1)
    pf, pb = x @ m["xf"] + m["cf"], x @ m["xb"] + m["cb"]
    kf, kb = ([], []) if keep is not None else (None, None)
    use = None if whole and keep is None else mask
    hf = _gru(pf[index], m["hf"], use, kf)
    hb = _gru(pb[index][::-1], m["hb"], None if use is None else mask[::-1], kb)[::-1]
    h = np.concatenate([hf, hb], 2)
    a = np.tanh(h @ m["att"])
    s = np.where(mask, a @ m["pick"], -1e9)
    s = np.exp(s - s.max(0))
    s /= s.sum(0)
    c = (h * s[:, :, None]).sum(0)
    if keep is not None:
        keep.update(index=index, mask=mask, kf=kf, kb=kb, h=h, a=a, s=s, c=c)
    return c @ m["out"] + m["bias"][0]


def backward(m, x, k, g, grads):
    """Adds the parameters' gradients to grads; returns those of x. g: gradients of the logits."""
    grads["out"] += k["c"].T @ g
    grads["bias"] += g.sum()
    dc = g[:, None] * m["out"]
    h, s, a = k["h"], k["s"], k["a"]
    ds = (h * dc[None]).sum(2)
    ds = s * (ds - (ds * s).sum(0))
    grads["pick"] += np.einsum("tb,tba->a", ds, a)
    da = ds[:, :, None] * m["pick"] * (1 - a * a)
    grads["att"] += np.einsum("tbh,tba->ha", h, da)
    dh = s[:, :, None] * dc[None] + da @ m["att"].T
    dx = np.zeros_like(x)
    for d, turn in (("f", 1), ("b", -1)):
        part = dh[:, :, :HIDDEN] if d == "f" else dh[:, :, HIDDEN:][::-1]
        dp, du = _gru_back(part, m["h" + d], k["mask"][::turn], k["k" + d])
        dp = np.where(k["mask"][:, :, None], dp[::turn], 0).reshape(-1, 3 * HIDDEN)
        rows = x[k["index"].ravel()]
        grads["h" + d] += du
        grads["x" + d] += rows.T @ dp
        grads["c" + d] += dp.sum(0)
        back, flat = dp @ m["x" + d].T, k["index"].ravel()
        for j in range(_INPUT):
            dx[:, j] += np.bincount(flat, back[:, j], len(x)).astype(np.float32)
    return dx


def _ragged(first, n, pick):
    """Positions of the grams of the words picked, and where each word's begin."""
    begin = np.cumsum(n[pick]) - n[pick]
    return np.repeat(first[pick] - begin, n[pick]) + np.arange(n[pick].sum()), begin


def _associate(labels, of, found, size):
    """(association with label 1, in enough documents) of each hashed word or gram, by documents that hold it."""
    seen = np.unique(of.astype(np.int64) * size + found)
    n, n1, p = np.bincount(seen % size, minlength=size), np.bincount(seen % size, labels[seen // size], size), labels.mean()
    return np.clip((n1 - n * p) / np.sqrt(n * p * (1 - p) + 4), -3, 8) / 2, n >= LEAST_DOCS


def _adam(m, moment, second, step, k, g, rows=slice(None)):
    moment[k][rows] += 0.1 * (g - moment[k][rows])
    second[k][rows] += 0.001 * (g**2 - second[k][rows])
    m[k][rows] -= STEP * (moment[k][rows] / (1 - 0.9**step)) / (np.sqrt(second[k][rows] / (1 - 0.999**step)) + 1e-6)


def fit(labels: np.ndarray, ids, grams, first, limits, seed: int = 3):
    """The network from documents (word ids ... limits) with 0/1 labels.

    A first network learns from two thirds of the documents; the window scores that it gives the others fit how they
    make a document's own. The network returned learns from all."""
    n_docs = np.diff(limits)
    if not len(ids) or labels.min() == labels.max():
        return new_model(np.random.default_rng(seed))
    apart = np.random.default_rng(seed).permutation(len(labels)) % 3 == 0
    if len(set(labels[~apart])) < 2 or len(set(labels[apart])) < 2:
        apart[:] = False
    start, end, doc = window_starts(limits)
    begin_of = np.searchsorted(doc, np.arange(len(labels) + 1))
    m = _fit_network(labels, ids, grams, first, limits, ~apart, seed)
    held = np.flatnonzero((apart if apart.any() else ~apart) & (n_docs > 0))
    w = np.concatenate([np.arange(begin_of[d], begin_of[d + 1]) for d in held])
    logits = windows_logits(m, ids, grams, first, start, end, w)
    pool = _fit_pool(_pooled(logits, np.concatenate([[0], np.cumsum(np.diff(begin_of)[held])])), labels[held])
    if apart.any():
        del m
        m = _fit_network(labels, ids, grams, first, limits, np.ones(len(labels), bool), seed)
    return m | {"pool": pool}


def _fit_network(labels, ids, grams, first, limits, use, seed):
    """A network from the documents marked in ``use``, by ROUNDS times UPDATES steps whatever their number. A document is toxic if
    some window is: each round takes, of a toxic document, the window that now scores highest and the next one, of others
    some at random, and the highest too of a third of them, and goes through all these in random order, again when they
    are used up. The first round goes by the association of words and grams with the labels, which also starts one dimension
    of each embedding."""
    rng = np.random.default_rng(seed)
    m = new_model(rng)
    n_docs = np.diff(limits)
    doc_of, count = np.repeat(np.arange(len(labels), dtype=np.int32), n_docs), np.diff(np.append(first, len(grams)))
    for name, size, found, of in (("words", WORDS, ids, doc_of), ("grams", GRAMS, grams, np.repeat(doc_of, count))):
        own = use[of]
        start_value, enough = _associate(labels, of[own], found[own], size)
        m[name][:, 0] = start_value
        m[name][~enough] = 0
        m[f"{name}_own"] = enough
    fixed = {k: m.pop(k) for k in ("words_own", "grams_own")}
    p = labels[use].mean()
    start, end, doc = window_starts(limits)
    begin_of = np.searchsorted(doc, np.arange(len(labels) + 1))
    mark = m["words"][ids, 0] + np.maximum.reduceat(m["grams"][grams, 0], first)
    level = np.maximum.reduceat(mark, start)  # up to the next start: enough to rank
    learn = np.flatnonzero(use & (n_docs > 0))
    moment, second, step = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    weight = np.where(labels == 1, min(5.0, 0.5 / max(p, 1e-3)), 1.0)
    for go in range(ROUNDS):
        hard = learn[(labels[learn] == 1) | (rng.random(len(learn)) < 1 / 3)]
        if go:
            w = np.concatenate([np.arange(begin_of[d], begin_of[d + 1]) for d in hard])
            level[w] = windows_logits(m, ids, grams, first, start, end, w)
        chosen, hard = [], set(hard.tolist())
        for d in learn:
            own = np.arange(begin_of[d], begin_of[d + 1])
            if labels[d]:
                top = own[level[own].argmax()]
                others = own[np.abs(own - top) > 1]
                chosen += [top] + ([others[level[others].argmax()]] if go and len(others) and level[others].max() > 0 else [])
            else:
                chosen += list(rng.choice(own, min(2, len(own)), replace=False)) + ([own[level[own].argmax()]] if d in hard else [])
        chosen = np.unique(chosen)
        drawn = np.concatenate([rng.permutation(chosen) for _ in range(-(-UPDATES * BATCH // len(chosen)))])
        for i in range(0, UPDATES * BATCH, BATCH):
            w = drawn[i : i + BATCH]
            at = start[w][:, None] + np.arange(WIDTH)
            pick = np.unique(at[at < end[w][:, None]])
            local = np.searchsorted(pick, start[w])
            where, begin = _ragged(first, count, pick)
            x, lens = inputs(m, ids[pick], grams[where], begin)
            stop = np.searchsorted(pick, np.minimum(end[w], start[w] + WIDTH))
            keep: dict = {}
            g = ((_sig(forward(m, x, local, stop, keep)) - labels[doc[w]]) * weight[doc[w]] / len(w)).astype(np.float32)
            grads = {k: np.zeros_like(v) for k, v in m.items() if k not in ("words", "grams")}
            dx = backward(m, x, keep, g, grads)
            back = np.repeat(dx[:, WORD_DIM:], lens, 0)
            back[:, :LARGEST] *= m["grams"][grams[where], :LARGEST] >= np.repeat(x[:, WORD_DIM : WORD_DIM + LARGEST], lens, 0)
            back[:, LARGEST:] /= np.repeat(lens, lens)[:, None]
            step += 1
            for k, found, d in (("words", ids[pick], dx[:, :WORD_DIM]), ("grams", grams[where], back)):
                rows, place = np.unique(found, return_inverse=True)
                total = np.stack([np.bincount(place, d[:, j], len(rows)) for j in range(d.shape[1])], 1).astype(np.float32)
                own = fixed[f"{k}_own"][rows]
                _adam(m, moment, second, step, k, total[own], rows[own])
            for k, v in grads.items():
                _adam(m, moment, second, step, k, v)
    return m


def _pooled(logits, at):
    """What a document's score is made from: its highest window, the expected number of toxic windows, their share, and
    the number of windows."""
    p = _sig(logits)
    n, total = np.diff(at), np.add.reduceat(p, at[:-1])
    return np.stack([np.ones(len(n)), np.clip(np.maximum.reduceat(logits, at[:-1]), -8, 8), np.log1p(total), total / n, np.log(n)], 1)


def _fit_pool(f, y, ridge: float = 1.0):
    """Logistic regression by Newton steps."""
    b = np.zeros(f.shape[1])
    for _ in range(30):
        p = _sig(np.clip(f @ b, -30, 30))
        h = (f * (p * (1 - p))[:, None]).T @ f + ridge * np.eye(len(b))
        b += np.linalg.solve(h, f.T @ (y - p) - ridge * b)
    return b


def _fit_task(batches):
    labels, parts, base = [], [], 0
    for batch in batches:
        labels += batch.column(0).to_pylist()
        parts += [tokens(data, at) for _, data, at in chunks(batch.column(1))]
    ids, grams = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1))
    first, limits, byte = [], [np.zeros(1, np.int64)], 0
    for a, b, c, d in parts:
        first.append(c + byte)
        limits.append(d[1:] + base)
        base, byte = base + len(a), byte + len(b)
    model = fit(np.array(labels, float), ids, grams, np.concatenate(first) if first else np.zeros(0, np.int64), np.concatenate(limits))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def train(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    """The network from at most MOST_LABELS labelled documents, in one task: the sample is bounded."""
    workers_import(docs.sparkSession)
    sample = labelled(docs, labels, "toxic", 5, 0, MOST_LABELS).repartition(1).sortWithinPartitions("doc_id", "text")
    found = sample.select("label", "text").mapInArrow(_fit_task, "model binary").first()
    return pickle.loads(found[0]) if found else new_model(np.random.default_rng(3))


def document_scores(m, column: pa.Array, windows: int = 2048) -> np.ndarray:
    """The score of each text from those of all its windows; texts without words get that of the bias."""
    best = np.full(len(column), m["bias"][0], np.float64)
    for row, data, at in chunks(column, 1 << 19):
        ids, grams, first, limits = tokens(data, at)
        start, end, doc = window_starts(limits)
        if not len(start):
            continue
        logits = windows_logits(m, ids, grams, first, start, end, np.arange(len(start)), windows)
        has = np.flatnonzero(np.diff(limits))
        of = np.append(np.searchsorted(doc, has), len(doc))
        best[row + has] = _pooled(logits, of) @ m["pool"] if "pool" in m else np.maximum.reduceat(logits, of[:-1])
    return _sig(np.clip(best, -30, 30))


def toxicity_scores(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score) of each row of ``docs`` (doc_id, text, ...) from all windows of its whole text, whatever its length; a
    null text is an empty one and gets the bias's score; repeated rows each give a row, rows alike in text score alike;
    extra columns are ignored; an empty table gives an empty one."""
    workers_import(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(document_scores(held.value, batch.column(1)), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op9_toxicity(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity_scores(docs, train(docs, labels))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
