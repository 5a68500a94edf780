"""Operator 13, cross-tokenizer alignment: tokens of two vocabularies coalesced to groups of equal bytes, links counted."""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, slices, text_bytes, workers_import

#: Files of the tokenizers; they must lie there on every machine.
BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text whose tokens go on as one row.
BLOCK = 8 << 20
#: Fixed pattern of this vocabulary's words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Vocabulary:
    """Bytes of each id, end to end, and their limits."""

    def __init__(self, tokens: list[bytes]):
        self.size = len(tokens)
        self.length = np.array([len(x) for x in tokens], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids."""
        n = self.length[ids]
        return self.bytes[np.arange(n.sum()) + np.repeat(self.at[ids] - (np.cumsum(n) - n), n)]


class ByteBpe(Vocabulary):
    """Byte-level merges from a tokenizers file, by ranks: an id is a rank, as the file's merges stand in the order of their ids.
    The few texts that the fast encoder refuses go to the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = dict(zip([*map(chr, plain), *(chr(256 + i) for i in range(256 - len(plain)))], [*plain, *(b for b in range(256) if b not in set(plain))], strict=True))
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
        if [vocab[x] for x in joined] != list(range(256, 256 + len(joined))):
            raise ValueError("ids do not follow the order of merges")
        ranks = {bytes(letter[c] for c in x): i for x, i in vocab.items() if i < 256 + len(joined)}
        tokens = [b""] * (1 + max([*vocab.values(), *(x["id"] for x in model["added_tokens"])]))
        for x, i in ranks.items():
            tokens[i] = x
        super().__init__(tokens)
        self.path, self.fast = path, tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def slow(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = True
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            try:
                out.append(self.fast.encode_to_numpy(" " + t, disallowed_special=()))
            except Exception:  # its patterns give up on very long white space
                out.append(np.array(self.slow.encode(" " + t, add_special_tokens=False).ids, np.int64))
        return out


class PieceBpe(Vocabulary):
    """Pieces of a sentencepiece model, which puts the space in front itself."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        piece = self.model.id_to_piece
        super().__init__([bytes([int(piece(i)[3:5], 16)]) if self.model.is_byte(i) else piece(i).replace("▁", " ").encode() for i in ids])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def vocabularies(a_path: str, b_path: str) -> tuple[ByteBpe, PieceBpe]:
    return ByteBpe(a_path), PieceBpe(b_path)


def coalesce(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each A token, group of each B token) of two tilings of the same bytes: all tokens by start, the ends' running
    maximum; a group breaks where a start reaches it."""
    end = np.concatenate([np.cumsum(a_len), np.cumsum(b_len)])
    start = end - np.concatenate([a_len, b_len])
    order = np.lexsort((start,))
    reach = np.maximum.accumulate(end[order])
    group = np.empty(len(end), np.int64)
    group[order] = np.cumsum(np.concatenate([[True], start[order][1:] >= reach[:-1]])[: len(end)]) - 1
    return group[: len(a_len)], group[len(a_len) :]


def overlaps(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of each A token, A token of each link, B token of each link): pairs whose bytes overlap."""
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    first = np.searchsorted(b_end, a_end - a_len, "right")
    n = np.searchsorted(b_end - b_len, a_end, "left") - first
    a = np.repeat(np.arange(len(n)), n)
    return n, a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n - first, n)


@lru_cache(maxsize=2)
def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    text = [str(i) for i in range(size)]
    wide = max(map(len, text))
    return np.frombuffer("".join(x.ljust(wide) for x in text).encode(), np.uint8).reshape(size, wide), np.array([*map(len, text)])


def group_text(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, place of each A token) of ``a1,a2|b1;a3|b2,b3;``: decimal ids group by group, each with a mark behind it."""
    groups = int(ga[-1]) + 1 if len(ga) else 0
    before = [np.concatenate([[0], np.cumsum(np.bincount(g, minlength=groups))]) for g in (ga, gb)]
    place = np.concatenate([np.arange(len(a)) + before[1][ga], np.arange(len(b)) + before[0][gb + 1]])
    ids, mark = np.empty(len(place), np.int64), np.empty(len(place), np.uint8)
    ids[place] = np.concatenate([a, b])
    mark[place] = np.concatenate([np.where(np.append(g[1:] != g[:-1], True), ord(m), ord(",")) for g, m in ((ga, "|"), (gb, ";"))]) if len(place) else mark
    digit, width = _digits(1 << 16 if not len(ids) or ids.max() < 1 << 16 else int(ids.max()) + 1)
    n = width[ids]
    at = np.cumsum(n + 1) - n - 1
    out = np.empty(int((n + 1).sum()), np.uint8)
    out[at + n] = mark
    for k in range(int(n.max(initial=0))):
        some = n > k
        out[at[some] + k] = digit[ids[some], k]
    return out, at[place[: len(a)]]


def _encoded(batch: pa.RecordBatch, column: int, va: Vocabulary, vb: Vocabulary):
    """(A ids, B ids, A limits, B limits) of the texts of a batch, none where they are null, empty, or the bytes differ."""
    data, at = text_bytes(batch.column(column))
    texts = pc.fill_null(batch.column(column), "").to_pylist()
    both, limits = [], []
    for v in (va, vb):
        ids = v.encode(texts)
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        both.append(np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64) if ids and isinstance(ids[0], np.ndarray) else np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())))
        limits.append(np.concatenate([[0], np.cumsum(n)]))
    want = np.insert(data, at[:-1], 32)
    starts = at + np.arange(len(at))
    good = np.diff(at) > 0
    for v, ids, lim in zip((va, vb), both, limits, strict=True):
        spelt = np.concatenate([[0], np.cumsum(v.length[ids])])[lim]
        good &= np.diff(spelt) == np.diff(starts)
        if spelt[-1] == starts[-1] and (np.diff(spelt) == np.diff(starts)).all():
            wrong = np.searchsorted(starts, np.flatnonzero(v.spell(ids) != want), "right") - 1
            good[wrong] = False
        else:  # some text's bytes differ in number
            for i in np.flatnonzero(good):
                good[i] = np.array_equal(v.spell(ids[lim[i] : lim[i + 1]]), want[starts[i] : starts[i + 1]])
    out = [ids[np.repeat(good, np.diff(lim))] for ids, lim in zip(both, limits, strict=True)]
    return *out, *(np.concatenate([[0], np.cumsum(np.where(good, np.diff(lim), 0))]) for lim in limits)


def _counted(codes, counts=None):
    """Distinct codes and how often each is there."""
    found, at = np.unique(codes, return_inverse=True)
    return found, np.bincount(at, weights=counts, minlength=len(found)).astype(np.int64)


_DOC = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
_DOC_DDL = "doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string"


def _documents(ids, a, b, la, lb, va, vb):
    """(struct array of _DOC, codes of all links) of encoded texts."""
    na, nb = va.length[a], vb.length[b]
    ga, gb = coalesce(na, nb)
    n, x, y = overlaps(na, nb)
    links = np.diff(np.concatenate([[0], np.cumsum(n)])[la])
    groups = np.array([ga[j - 1] - ga[i] + 1 if j > i else 0 for i, j in zip(la[:-1].tolist(), la[1:].tolist(), strict=True)], np.int64)
    text, at = group_text(a, b, ga, gb)
    edge = np.append(at, len(text))[la]
    raw = text.tobytes()
    sha = [hashlib.sha256(raw[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    columns = [ids, *(pa.array(v, pa.int64()) for v in (np.diff(la), np.diff(lb), groups, links)), pa.array(sha, pa.string())]
    return pa.StructArray.from_arrays(columns, fields=[pa.field(*f) for f in _DOC]), a[x] * vb.size + b[y]


def _blocks(a_path: str, b_path: str):
    """(block, docs, tokens, pairs): documents of about BLOCK bytes of text, their tokens, and the id pairs of their links, counted."""

    def blocks(batches):
        va, vb = vocabularies(a_path, b_path)
        number, size, docs, tokens, pairs = TaskContext.get().partitionId() << 32, 0, [], [], []

        def block():
            row = pa.concat_arrays(docs)
            codes, counts = _counted(np.concatenate([c for c, _ in pairs]), np.concatenate([n for _, n in pairs]))
            packed = zstandard.ZstdCompressor(3).compress(b"".join(t[i].tobytes() for i in (0, 1) for t in tokens))
            pair = pa.StructArray.from_arrays([pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], ["code", "n"])
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (row, pair)]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), lists[0], pa.array([packed], pa.binary()), lists[1]], ["block", "docs", "tokens", "pairs"])

        for part in (x for batch in batches for x in slices(batch, 1)):
            a, b, la, lb = _encoded(part, 1, va, vb)
            found, codes = _documents(part.column(0), a, b, la, lb, va, vb)
            docs.append(found)
            tokens.append((a.astype(va.kind), b.astype(vb.kind)))
            pairs.append(_counted(codes))
            size += int(pc.sum(pc.binary_length(part.column(1))).as_py() or 0)
            if size >= BLOCK:
                yield block()
                number, size, docs, tokens, pairs = number + 1, 0, [], [], []
        if docs:
            yield block()

    return blocks


def _scored(a_path: str, b_path: str):
    """For a block and the corpus-wide counts of its id pairs: each document's links that are their B id's best, and the sum."""

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        va, vb = vocabularies(a_path, b_path)
        order = np.argsort(codes := right["code"].to_numpy())
        codes, count, best = codes[order], right["n"].to_numpy()[order], right["best"].to_numpy()[order].astype(np.int64)
        out = []
        for docs, packed in zip(left["docs"].combine_chunks(), left["tokens"].combine_chunks(), strict=True):
            docs = docs.values
            raw = zstandard.ZstdDecompressor().decompress(packed.as_buffer())
            la, lb = (np.concatenate([[0], np.cumsum(docs.field(f).to_numpy())]).astype(np.int64) for f in ("n_a", "n_b"))
            cut = int(la[-1]) * va.kind.itemsize
            a, b = np.frombuffer(raw[:cut], va.kind), np.frombuffer(raw[cut:], vb.kind)
            sums = []
            for i, j in _stretches(la):
                x, y = a[la[i] : la[j]].astype(np.int64), b[lb[i] : lb[j]].astype(np.int64)
                n, p, q = overlaps(va.length[x], vb.length[y])
                at = np.searchsorted(codes, x[p] * vb.size + y[q])
                edge = np.concatenate([[0], np.cumsum(n)])[la[i : j + 1] - la[i]]
                sums.append([np.diff(np.concatenate([[0], np.cumsum(v[at])])[edge]) for v in (best, count)])
            columns = [docs.field(name) for name, _ in _DOC] + [pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64), pa.int64()) for x in (zip(*sums, strict=True) if sums else ((), ()))]
            out.append(pa.table(columns, names=[*(name for name, _ in _DOC), "n_best", "count_sum"]))
        return pa.concat_tables(out)

    return scored


def _stretches(limits: np.ndarray, most: int = 1 << 19):
    """(first, end) runs of rows with about ``most`` tokens."""
    row = 0
    while row < len(limits) - 1:
        end = max(row + 1, int(np.searchsorted(limits, limits[row] + most, "right")) - 1)
        yield row, end
        row = end


def aligned_tokens(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE) -> DataFrame:
    """(doc_id, a, b, a_groups, b_groups) of each row of ``docs``: ids by either tokenizer and the number of each token's group,
    from 0. Rows as alignment_statistics says."""
    workers_import(docs.sparkSession)

    def aligned(batches):
        va, vb = vocabularies(a_path, b_path)
        for part in (x for batch in batches for x in slices(batch, 1)):
            a, b, la, lb = _encoded(part, 1, va, vb)
            ga, gb = coalesce(va.length[a], vb.length[b])
            first = np.concatenate([ga, [0]])[la[:-1]] if len(la) > 1 else ga
            columns = [(a, la), (b, lb), (ga - np.repeat(first, np.diff(la)), la), (gb - np.repeat(first, np.diff(lb)), lb)]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.ListArray.from_arrays(pa.array(lim, pa.int32()), pa.array(x, pa.int32())) for x, lim in columns)], ["doc_id", "a", "b", "a_groups", "b_groups"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(aligned, "doc_id long, a array<int>, b array<int>, a_groups array<int>, b_groups array<int>")


def alignment_statistics(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of each row of ``docs`` (doc_id, text, ...).

    Space and text are encoded by a byte-level vocabulary (A) and by pieces (B) without special tokens. Where tokens of
    both end, groups end; links are pairs of an A and a B token whose bytes overlap. A pair of ids counts its links over
    all rows, repeated rows and copies with each repeat; n_best are the links whose count is the highest of their B id, ties
    included, count_sum the sum of their counts; groups_sha256 is of ``a1,a2|b1;a3|b2`` and so on. Texts that are null, empty or
    whose bytes either tokenizer changes have no tokens: zeros and ''. Null ids stay, extra columns are ignored, texts are
    read whole; an empty table gives an empty one.

    Tokens are kept packed in blocks of texts; of a block, only its distinct pairs are counted, joined with the counts of
    the corpus and brought back, so a pair that is in every text costs a row a block and nothing is broadcast."""
    spark = docs.sparkSession
    workers_import(spark)
    size = vocabularies(a_path, b_path)[1].size
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    blocks = durable(rows.mapInArrow(_blocks(a_path, b_path), f"block long, docs array<struct<{_DOC_DDL}>>, tokens binary, pairs array<struct<code:bigint,n:bigint>>"))
    pairs = blocks.select(F.col("block").alias("at"), F.inline("pairs"))
    counts = durable(pairs.groupBy("code").agg(F.sum("n").alias("n")))
    top = counts.groupBy((F.col("code") % size).alias("b")).agg(F.max("n").alias("top"))
    counts = counts.withColumn("b", F.col("code") % size).join(top, "b").select("code", "n", (F.col("n") == F.col("top")).alias("best"))
    known = pairs.select("at", "code").join(counts, "code")
    out = blocks.select("block", "docs", "tokens").groupBy("block").cogroup(known.select("at", "code", "n", "best").groupBy("at"))
    return out.applyInArrow(_scored(a_path, b_path), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")


def op13_token_alignment(spark, sf_dir):
    return alignment_statistics(spark.read.parquet(f"{sf_dir}/documents.parquet"))
