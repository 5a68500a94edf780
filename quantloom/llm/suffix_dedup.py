"""Operator 11, suffix-array dedup: suffixes at chosen bytes, dealt by sampled splitters, sorted and compared in buckets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, durable, mix, slices, small_side, text_bytes, workers_import

_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Kinds of anchors whose gram is found twice: the context is too; the context stands alone; as the first, and strings in it
#: are compared with those round anchors that stand alone. To the last two a mask of sides is added.
REPEATED, ALONE, SAMPLE = 0, 8, 16
#: Bits of a hash of a side of an anchor.
SIDE_BITS = 21
#: Bytes that are named at once: longer texts go in pieces that overlap.
PIECE = 1 << 22


def gram_length(length: int) -> int:
    """Bytes of the leading token of an anchor's suffix: 96 for strings of 200."""
    return length * 12 // 25 // 8 * 8


def _joined(a: np.ndarray, b: np.ndarray, gap: int) -> np.ndarray:
    n = max(0, min(len(a), len(b) - gap))
    x = b[gap : gap + n]
    return mix(a[:n] * _LEFT + (x ^ (x >> np.uint64(29))) * _RIGHT)


def _thirds(length: int) -> list[tuple[int, int]]:
    """Bytes of a string before its gram, in three ranges [lo, hi): a string of the first has most of its other bytes behind
    the gram, one of the second some on either side, one of the third most before it."""
    side = length - gram_length(length)
    t = side // 3
    return [(0, t + 1), (t + 1, side - t), (side - t, side + 1)]


def _power(n: int) -> int:
    return 1 << (n.bit_length() - 1)


def _named(data: np.ndarray, k: int, keep=None) -> np.ndarray:
    """A hash of each k-byte string of ``data`` (k a multiple of 8) by prefix doubling: strings are named after their halves.
    ``keep`` gets the names of shorter strings of 8, 16, ... bytes."""
    name, size, out, done = np.lib.stride_tricks.sliding_window_view(data, 8).copy().view(np.uint64)[:, 0], 8, None, 0
    name = mix(name * _LEFT)
    while size <= k:
        if keep is not None:
            keep[size] = name
        if k & size:
            out = name if out is None else _joined(out, name, done)
            done += size
        if 2 * size <= k:
            name = _joined(name, name, size)
        size *= 2
    return out[: len(data) - k + 1]


def _sliding(x: np.ndarray, w: int, least) -> np.ndarray:
    """The least (or greatest) of each w neighbours, by doubling."""
    k = 1
    while 2 * k <= w:
        x, k = least(x[:-k], x[k:]), 2 * k
    return least(x[: len(x) - (w - k)], x[w - k :]) if w > k else x


def _pieces(data: np.ndarray, at: np.ndarray, length: int):
    """(first byte of the core, of the stretch, end of the core, names of the grams, least name in each string of ``length`` bytes that lies in one text, else
    0, names of shorter strings) of stretches of texts that lie end to end. Cores follow each other; round each there is as
    much of the texts as the strings need that hold one of its bytes."""
    for x in range(0, len(data) - length + 1, PIECE):
        lo, end = max(0, x - length), x + PIECE if x + PIECE <= len(data) - length else len(data)
        part = data[lo : end + 2 * length]
        short: dict[int, np.ndarray] = {}
        name = np.maximum(_named(part, gram_length(length), short), np.uint64(1))
        least = _sliding(name, length - gram_length(length) + 1, np.minimum)
        ends = np.repeat(at[1:], np.diff(np.clip(at, lo, lo + len(part))))[: len(least)]
        yield x, lo, end, name, np.where(np.arange(lo + length, lo + length + len(least)) <= ends, least, np.uint64(0)), short


def _sides(byte, short, length) -> np.ndarray:
    """Hashes of what every string of a third has round the gram, packed: bytes behind it, bytes on either side, bytes before it.
    Where a text ends too soon for such strings they are of anything."""
    k, (a, b, _) = gram_length(length), _thirds(length)
    far, near = short[_power(b[1])], short[_power(a[1])]
    at = lambda names, i: names[np.clip(i, 0, len(names) - 1)]
    behind, before = at(far, byte + k), at(far, byte - _power(b[1]))
    both = mix(at(near, byte - _power(a[1])) * _LEFT + at(near, byte + k) * _RIGHT)
    cut = np.uint64(64 - SIDE_BITS)
    return ((behind >> cut) << np.uint64(2 * SIDE_BITS)) | ((both >> cut) << np.uint64(SIDE_BITS)) | (before >> cut)


def anchors(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte, name of the gram there, hashes of its sides) of the anchors of texts that lie end to end: in each string of ``length``
    bytes the gram with the least name (all of them if several tie). The choice needs no byte outside the string, so equal
    strings have it at the same place."""
    edge = np.zeros(length - gram_length(length), np.uint64)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    for x, lo, end, name, least, short in _pieces(data, at, length):
        byte = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), len(edge) + 1, np.maximum)[: len(name)] == name)
        byte = byte[(byte + lo >= x) & (byte + lo < end)]
        found.append((byte + lo, name[byte], _sides(byte, short, length)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def _anchor_rows(length: int):
    """(gram, context, row, pos, sides): an anchor's leading token, a hash of all strings of ``length`` bytes that hold it (cut at
    the text's ends), where it is, and _sides."""
    side = length - gram_length(length)

    def rows(batches):
        for batch in batches:
            for first, data, at in chunks(batch.column(1)):
                byte, name, sides = anchors(data, at, length)
                row = np.searchsorted(at, byte, "right") - 1
                lo, hi = np.maximum(byte - side, at[row]), np.minimum(byte + length, at[row + 1])
                raw = data.tobytes()
                context = np.array([xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], np.uint64)
                yield pa.RecordBatch.from_arrays([_signed(name), _signed(context), batch.column(0).take(pa.array(row + first)), pa.array(byte - at[row], pa.int32()), _signed(sides)], ["gram", "context", "row", "pos", "sides"])

    return rows


def _streamed(batches, columns: int, most: int = 1 << 16):
    """(arrays, first?, last?) of a bucket that is sorted by its first column, in blocks that end where that changes."""
    held, first = None, True
    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        if len(held[0]) >= most:
            cut = int(np.searchsorted(held[0], held[0][-1], "left"))
            if cut:
                yield [x[:cut] for x in held], first, False
                held, first = [x[cut:] for x in held], False
    if held is not None and len(held[0]):
        yield held, first, True


def _runs(*columns):
    """(number of its run of equal neighbours, length of that run, whether it begins one) of each row."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    no = np.cumsum(new) - 1
    return no, np.bincount(no)[no], new


def _border(no, first, last):
    return ((no == 0) & first) | ((no == no[-1]) & last)


def _judged(batches):
    """Anchors sorted by (gram, context): the kinds of those whose gram is found twice, with a mask of the thirds of strings
    that may repeat, as another anchor of that gram has the same bytes on that side. What lies beyond the border of a bucket is
    unknown here, so grams at a border report every context and side; what is reported too much costs time only."""
    for (gram, context, row, pos, sides), first, last in _streamed(batches, 5):
        g, n, _ = _runs(gram)
        border = _border(g, first, last)
        told = np.flatnonzero(border | (n > 1))
        g, row, pos, sides, border = g[told], row[told], pos[told], sides[told], border[told]
        _, same, new = _runs(g, context[told])
        alone = same == 1
        mask = np.zeros(len(told), np.int64)
        for i in range(3):
            code = (g << SIDE_BITS) | ((sides >> (SIDE_BITS * (2 - i))) & ((1 << SIDE_BITS) - 1))
            _, at, count = np.unique(code, return_inverse=True, return_counts=True)
            lone = np.bincount(at, weights=alone)
            mask |= np.where(border | np.where(alone, count[at] > 1, lone[at] > 0), 1 << i, 0)
        kind = np.where(alone, ALONE + mask, np.where(new & (mask > 0), SAMPLE + mask, REPEATED))
        keep = kind != ALONE
        yield pa.RecordBatch.from_arrays([pa.array(row[keep]), pa.array(pos[keep], pa.int32()), pa.array(kind[keep], pa.int8())], ["row", "pos", "kind"])


def _lists(lists, counts):
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *lists]), pa.int32()))


def _cover(lo, hi) -> tuple[np.ndarray, np.ndarray]:
    """The union of stretches [lo, hi), those that touch joined."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], hi[order]
    if not len(lo):
        return lo, hi
    reach = np.maximum.accumulate(hi)
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > reach[:-1]]))
    return lo[new], reach[np.concatenate([new[1:] - 1, [len(lo) - 1]])]


def _values(column, i) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False).astype(np.int64) if column[i].is_valid else np.zeros(0, np.int64)


def _stretches(length: int):
    """Settled anchors of a row as stretches of starts, the others as they are (eight times their place, and the mask)."""
    side = length - gram_length(length)

    def stretch(batches):
        for batch in batches:
            both = [_cover(p - side, p + 1) for p in (_values(batch.column(1), i) for i in range(len(batch)))]
            counts = [len(lo) for lo, _ in both]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(_lists([x[i] for x in both], counts) for i in (0, 1)), batch.column(2)], ["row", "lo", "hi", "marked"])

    return stretch


def _open_starts(data, marked, length):
    """Starts of strings whose least gram is one of these anchors, given as eight times the place and a mask of thirds. Those that
    another anchor settles are among them: they may be the equals of strings that none settles."""
    ranges, out = _thirds(length), [np.zeros(0, np.int64)]
    for x, base, end, name, least, _ in _pieces(data, np.array([0, len(data)]), length):
        for i, (a, b) in enumerate(ranges):
            byte = marked[(marked >> i) & 1 == 1] >> 3
            byte = byte[(byte >= x) & (byte < end)] - base
            start = (byte[:, None] - np.arange(a, b)).ravel()
            gram = np.repeat(name[byte], b - a)
            ok = (start >= 0) & (start < len(least))
            ok[ok] = least[start[ok]] == gram[ok]
            out.append(start[ok] + base)
    return np.unique(np.concatenate(out))


def _suffix_rows(length: int):
    """(lead, rest, row, pos) of the suffixes that are left to compare: their first eight bytes as a number of that order, and
    a hash of their first ``length`` bytes."""

    def rows(batches):
        for batch in (x for b in batches for x in slices(b, 1)):
            data, at = text_bytes(batch.column(1))
            starts = [_open_starts(data[at[i] : at[i + 1]], _values(batch.column(2), i), length) + at[i] for i in range(len(batch))]
            row = np.repeat(np.arange(len(batch)), [len(x) for x in starts])
            start, raw = np.concatenate([np.zeros(0, np.int64), *starts]), data.tobytes()
            if len(start):
                lead = np.lib.stride_tricks.sliding_window_view(data, 8)[start].view(">u8")[:, 0].astype(np.uint64) ^ np.uint64(1 << 63)
                rest = np.array([xxhash.xxh3_64_intdigest(raw[s : s + length]) for s in start.tolist()], np.uint64)
                yield pa.RecordBatch.from_arrays([_signed(lead), _signed(rest), batch.column(0).take(pa.array(row)), pa.array(start - at[row], pa.int32())], ["lead", "rest", "row", "pos"])

    return rows


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by several tokens: by the first, then runs of equal ones by the next, and so on."""
    order = np.argsort(columns[0], kind="stable")
    run = _runs(columns[0][order])[0]
    for token in columns[1:]:
        tie = np.flatnonzero(np.bincount(run)[run] > 1)
        if not len(tie):
            break
        part = order[tie]
        order[tie] = part[np.lexsort((token[part], run[tie]))]
        run = _runs(run, token[order])[0]
    return order


def _bucket(batches):
    """A bucket of suffixes: (row, pos, lead, rest, kind) of those that equal a neighbour (kind 0), and of those at the border of
    the bucket: one alone (1), or the first of several (2)."""
    for (lead, rest, row, pos), first, last in _streamed(batches, 4):
        order = multikey_order([lead, rest])
        lead, rest, row, pos = (x[order] for x in (lead, rest, row, pos))
        no, n, new = _runs(lead, rest)
        border = _border(no, first, last)
        kind = np.where(n == 1, 1, np.where(border & new, 2, 0))
        told = border | (n > 1)
        yield pa.RecordBatch.from_arrays([pa.array(row[told]), pa.array(pos[told], pa.int32()), pa.array(lead[told]), pa.array(rest[told]), pa.array(kind[told], pa.int8())], ["row", "pos", "lead", "rest", "kind"])


def text_key():
    """Tells rows apart by id and text (rows alike share it)."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.col("text"))


def repeated_starts(docs: DataFrame, length: int = 200) -> tuple[DataFrame, DataFrame]:
    """Where strings of ``length`` bytes start that also start anywhere else: two durable tables of rows of ``docs``, (row, lo,
    hi, ...) with stretches of starts [lo, hi) and (row, starts) with single ones. ``row`` is text_key().

    Each such string holds an anchor, and its equals hold theirs at the same place. Anchors' suffixes are dealt by sampled
    splitters of their leading token (a gram, as a hash), with context and row behind it, and sorted. Equal contexts settle
    all strings in them. Strings whose anchor shares its gram but not its context are left, where some other anchor of that gram
    shares bytes on the side where they stick out (hashes of 21 bits, which rule out but settle nothing): their suffixes are dealt by
    sampled splitters of their leading eight bytes (with hash and row behind), sorted in buckets and compared with their
    neighbours; those at a border of a bucket meet in one more grouping. As rows are part of both keys, a string that many
    documents hold fills several buckets. Suffixes are compared by eight bytes and 64 bits of a hash of ``length`` bytes, contexts
    by two hashes of 64 bits: two that differ agree by chance once in 2**64 pairs."""
    spark = docs.sparkSession
    workers_import(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(text_key().alias("row"), "text").where(F.octet_length("text") >= length)
    found = base.mapInArrow(_anchor_rows(length), "gram long, context long, row long, pos int, sides long")
    found = found.repartitionByRange(n, "gram", "context", "row").sortWithinPartitions("gram", "context")
    found = durable(found.mapInArrow(_judged, "row long, pos int, kind byte"))
    kind, masked = F.col("kind"), F.col("pos").cast("long") * 8 + F.col("kind").bitwiseAND(7)
    sets = {"settled": F.when((kind < ALONE) | (kind >= SAMPLE), F.col("pos")), "marked": F.when(kind >= ALONE, masked)}
    settled = found.groupBy("row").agg(*(F.collect_set(x).alias(name) for name, x in sets.items()))
    settled = settled.mapInArrow(_stretches(length), "row long, lo array<int>, hi array<int>, marked array<long>")
    settled = durable(settled)
    some = settled.where(F.size("marked") > 0).select("row", "marked")
    left = base.join(small_side(some, row_bytes(some)), "row").select("row", "text", "marked")
    left = left.mapInArrow(_suffix_rows(length), "lead long, rest long, row long, pos int")
    left = left.repartitionByRange(n, "lead", "rest", "row").sortWithinPartitions("lead")
    told = durable(left.mapInArrow(_bucket, "row long, pos int, lead long, rest long, kind byte"))
    met = told.where("kind > 0").groupBy("lead", "rest").agg(F.count("*").alias("n")).where("n > 1").select("lead", "rest")
    over = told.where("kind = 1").join(met, ["lead", "rest"]).select("row", "pos")
    starts = told.where("kind <> 1").select("row", "pos").union(over)
    return settled, durable(starts.groupBy("row").agg(F.collect_set("pos").alias("starts")))


def row_bytes(table: DataFrame) -> int:
    """Bytes of a row with arrays of numbers at the mean, for small_side."""
    arrays = [F.size(c) * 8 for c, t in table.dtypes if t.startswith("array")]
    return 96 + int(table.agg(F.avg(sum(arrays, F.lit(0)))).first()[0] or 0)


def _cut(length: int):
    def cut(batches):
        for batch in (x for b in batches for x in slices(b, 1)):
            data, at = text_bytes(batch.column(1))
            los, his, texts = [], [], []
            for i in range(len(batch)):
                raw = data[at[i] : at[i + 1]]
                a, b, s = (_values(batch.column(c), i) for c in (2, 3, 4))
                lo, hi = _cover(np.concatenate([np.maximum(a, 0), s]), np.concatenate([np.minimum(b, len(raw) - length + 1), s + 1]) + length - 1)
                los.append(lo)
                his.append(hi)
                keep = np.concatenate([[0], np.stack([lo, hi], 1).ravel(), [len(raw)]]).astype(np.int64).reshape(-1, 2)
                texts.append(b"".join(raw[x:y].tobytes() for x, y in keep.tolist()))
            counts = [len(x) for x in los]
            lo, hi = _lists(los, counts), _lists(his, counts)
            pair = pa.ListArray.from_arrays(lo.offsets, pa.StructArray.from_arrays([lo.values, hi.values], ["start", "end"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int64()), pair, pa.array(texts, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return cut


def cut_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of each row of ``docs`` (doc_id, text, ...): the stretches of bytes, ends exclusive, that
    lie in a string of ``length`` bytes which also starts anywhere else, in this text or another, and the other bytes.

    Texts are whole UTF-8 byte strings, null as empty; strings do not cross texts, and are judged on the input, not on what
    is left. Of copies none is spared: rows alike remove each other's bytes. Shorter texts lose nothing; extra columns are
    ignored; an empty table gives an empty one. Rows are told apart by 64 bits of id and text. ``length`` is 40 at least."""
    if length < 40:
        raise ValueError("strings of 40 bytes at least")
    settled, starts = repeated_starts(docs, length)
    base = docs.select(text_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    settled = settled.where(F.size("lo") > 0).select("row", "lo", "hi")
    base = base.join(small_side(settled, row_bytes(settled)), "row", "left").join(small_side(starts, row_bytes(starts)), "row", "left")
    return base.select("doc_id", "text", "lo", "hi", "starts").mapInArrow(_cut(length), "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


def op11_suffix_dedup(spark, sf_dir):
    cut = cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x.end - x.start)
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = {
    "op11_suffix_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS MATERIALIZED (SELECT rid, s, md5(x[2 * s + 1 : 2 * s + 400]) AS k FROM (SELECT rid, x, unnest(range(0, len(x) // 2 - 199)) AS s FROM d WHERE len(x) >= 400)),
r AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1),
b AS (SELECT rid, s, CASE WHEN s <= lag(s) OVER (PARTITION BY rid ORDER BY s) + 200 THEN 0 ELSE 1 END AS fresh FROM r),
i AS (SELECT rid, run, min(s) AS lo, max(s) + 200 AS hi FROM (SELECT rid, s, sum(fresh) OVER (PARTITION BY rid ORDER BY s) AS run FROM b) GROUP BY rid, run),
g AS (SELECT rid, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY rid ORDER BY lo) AS before FROM i),
k AS (SELECT rid, count(*) AS n_spans, sum(hi - lo)::BIGINT AS n_removed, max(hi) AS last, string_agg(d.x[2 * before + 1 : 2 * lo], '' ORDER BY lo) AS head FROM g JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head || x[2 * last + 1 :], x))) AS kept_sha256
FROM d LEFT JOIN k USING (rid)"""
}
