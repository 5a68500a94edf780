r"""Operator 5, secret scans: patterns, and character Markov models of random strings and identifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, row_key

#: Fixed patterns of the base kinds, in the order in which they are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
#: Tokens that the models judge. The threshold is where this share of random strings, kept apart, falls below it.
TOKEN, LOST = r"[A-Za-z0-9+/_=-]{16,}", 0.004
#: What the models learn from at most: found secrets, made random strings, and documents without secrets, whose tokens
#: and words are the ordinary identifiers.
MOST_SECRETS, RANDOMS, MOST_DOCS = 20_000, 4_000, 2_000
#: Characters told apart, and the class of each; others share the last place.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABET = LOWER + UPPER + DIGITS + "+/_=-"
CLASSES = [0] * 26 + [1] * 26 + [2] * 10 + [3] * 5 + [4]
#: Alphabets of random strings: alphanumeric, base 64, its URL form, hexadecimal, base 32, base 36 of both cases.
RANDOM_ALPHABETS = (UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_", DIGITS + "ABCDEF", DIGITS + "abcdef", UPPER + "234567", LOWER + DIGITS, UPPER + DIGITS)
#: A pair's own count has up to this weight against its back-off, half of that when its first character was seen SEEN
#: times; counts that the back-off of pairs of classes weighs as much as.
OWN, SEEN, SMOOTH_CLASS, SMOOTH_ONE = 0.5, 50.0, 8.0, 0.5
#: Ordinary identifiers, in the characters of TOKEN; a model of each fold is learned from the samples of the others.
PLAIN, WORD, FOLDS = r"[A-Za-z0-9+/_=-]{6,}", r"[A-Za-z]{2,}", 2
#: Matches whose places are summed up at once.
RUN = 256


def _with_before(df: DataFrame, lengths: str, name: str) -> DataFrame:
    """``df`` with the running sums of the array ``lengths``, each without its own entry, in column ``name``: within runs of
    RUN entries, and of the runs, so that the work grows with RUN times the entries, not with their square."""
    add = lambda x, y: x + y
    n, zero = F.size(lengths), F.lit(0)
    runs = F.when(n > 0, F.sequence(zero, F.ceil(n / RUN).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_own", F.transform(runs, lambda b: F.aggregate(F.slice(lengths, b * RUN + 1, F.lit(RUN)), zero, add)))
    df = df.withColumn("_start", F.transform("_own", lambda x, b: F.aggregate(F.slice("_own", F.lit(1), b), zero, add)))

    def inside(start, b):
        last = F.least(F.lit(RUN), n - b * RUN) - 1
        return F.transform(F.sequence(zero, last), lambda i: start + F.aggregate(F.slice(lengths, b * RUN + 1, i), zero, add))

    return df.withColumn(name, F.flatten(F.transform("_start", inside))).drop("_own", "_start")


def spans(df: DataFrame, text: str, pattern: str, name: str, maybe=None) -> DataFrame:
    """``df`` with the leftmost non-overlapping matches, array<struct<s, e, m>> in code points, in column ``name``: the
    pieces between the matches and the matches alternate. Texts for which ``maybe`` is false hold none for sure."""
    none = F.array().cast("array<string>")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    df = df.withColumn("_matches", matches if maybe is None else F.when(maybe, matches).otherwise(none))
    df = df.withColumn("_pieces", F.when(F.size("_matches") > 0, F.split(text, pattern, -1)).otherwise(none))
    df = df.withColumn("_gaps", F.transform("_matches", lambda m, i: F.char_length(F.get("_pieces", i))))
    df = df.withColumn("_lens", F.zip_with("_gaps", "_matches", lambda g, m: g + F.char_length(m)))
    df = _with_before(df, "_lens", "_at").withColumn("_at", F.zip_with("_at", "_gaps", lambda a, g: a + g))
    found = F.zip_with("_at", "_matches", lambda s, m: F.struct(s.alias("s"), (s + F.char_length(m)).alias("e"), m.alias("m")))
    return df.withColumn(name, found).drop("_matches", "_pieces", "_gaps", "_lens", "_at")


def base_spans(docs: DataFrame) -> DataFrame:
    """(row, doc_id, assign, access, hex, tokens): spans of the base kinds, and the tokens that the models may judge:
    those that hold a letter and meet no base span."""
    df = docs.select(row_key().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    low = F.lower("text")
    named = low.contains("password") | low.contains("passwd") | low.contains("secret") | low.contains("token") | (low.contains("api") & low.contains("key"))
    df = spans(df, "text", ASSIGN, "assign", named)
    df = df.withColumn("assign", F.filter("assign", lambda x: F.char_length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6))
    df = spans(df, "text", ACCESS, "access", F.col("text").contains("AKIA"))
    df = spans(df, "text", HEX, "hex")
    df = spans(df, "text", TOKEN, "tokens").drop("text")
    df = df.withColumn("tokens", F.filter("tokens", lambda t: t["m"].rlike("[A-Za-z]")))
    base = F.concat("assign", "access", "hex")
    free = F.filter("tokens", lambda t: ~F.exists(base, lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))
    return df.withColumn("tokens", F.when(F.size(base) > 0, free).otherwise(F.col("tokens")))


def fold(sample):
    """The fold of a string: all its occurrences fall in one."""
    return F.pmod(F.xxhash64(sample), F.lit(FOLDS)).cast("int")


def _pairs(samples: DataFrame) -> DataFrame:
    """(fold, label, pair, n): how often each pair of following characters occurs in the samples (label, sample)."""
    pairs = F.transform(F.sequence(F.lit(1), F.char_length("sample") - 1), lambda i: F.substring("sample", i, F.lit(2)))
    rows = samples.where(F.char_length("sample") > 1).select(fold("sample").alias("fold"), "label", F.explode(pairs).alias("pair"))
    return rows.groupBy("fold", "label", "pair").agg(F.count("*").alias("n"))


def _place(c):
    """0-based place of a character in ALPHABET, or one past its end."""
    at = F.instr(F.lit(ALPHABET), c)
    return F.when((at == 0) | (c == ""), F.lit(len(ALPHABET))).otherwise(at - 1)


def _likelihoods(counts: np.ndarray) -> np.ndarray:
    """Log-likelihood of each second character after each first, from counts of pairs, as a mean of the pair's own share
    and a back-off: the share of its characters' classes, which backs off to the second class alone, times the second
    character's share of its class, half of that by counts and half equal. An unseen pair so keeps half its back-off:
    identifiers of words that no sample holds are not called random for that."""
    of = np.eye(max(CLASSES) + 1)[CLASSES]
    single, held, n = counts.sum(0), of.sum(0), counts.sum(1, keepdims=True)
    share = 0.5 * single / np.maximum(single @ of, 1)[CLASSES] + 0.5 / held[CLASSES]
    one = single @ of + SMOOTH_ONE * held
    pair = of.T @ counts @ of + SMOOTH_CLASS * one / one.sum()
    back = (pair / pair.sum(1, keepdims=True))[CLASSES][:, CLASSES] * share
    own = OWN * n / (n + SEEN)
    return np.log(own * counts / np.maximum(n, 1) + (1 - own) * back)


def train_markov(samples: DataFrame) -> list[list[float]]:
    """For each fold the log-likelihood ratios of the pairs of characters, random strings (label 1) against identifiers
    (label 0), from the labelled samples of the other folds; all 0 if one kind is missing."""
    size = len(ALPHABET) + 1
    counts = np.zeros((FOLDS, 2, size * size))
    place = {c: i for i, c in enumerate(ALPHABET)}
    for r in _pairs(samples).collect():  # a row for each pair of ASCII characters at most, label and fold
        i, j = (place.get(c, size - 1) for c in r.pair)
        counts[r.fold, r.label, i * size + j] += r.n
    rest = (counts.sum(0) - counts).reshape(FOLDS, 2, size, size)
    return [(_likelihoods(x[1]) - _likelihoods(x[0])).ravel().tolist() if x.sum((1, 2)).all() else [0.0] * size**2 for x in rest]


def ratio(token, tables: list[list[float]]):
    """The mean log-likelihood ratio of a token's pairs of characters, by the model of its fold."""
    size = len(ALPHABET) + 1
    held = F.get(F.array(*[F.split(F.lit(" ".join(map(repr, x))), " ").cast("array<double>") for x in tables]), fold(token))
    c = F.transform(F.split(token, ""), _place)
    score = F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), F.lit(0.0), lambda acc, i: acc + F.get(held, F.get(c, i - 1) * size + F.get(c, i)))
    return score / (F.size(c) - 1)


def random_strings(spark, n: int = RANDOMS) -> DataFrame:
    """(sample) of n random strings of 16 to 47 characters over each of RANDOM_ALPHABETS in turn, always the same."""
    ids = spark.range(n).withColumn("a", F.element_at(F.array(*map(F.lit, RANDOM_ALPHABETS)), (F.col("id") % len(RANDOM_ALPHABETS) + 1).cast("int")))
    size = (16 + F.floor(F.col("id") / len(RANDOM_ALPHABETS)) % 32).cast("int")
    char = lambda k: F.substring("a", F.pmod(F.xxhash64("id", k), F.char_length("a").cast("long")).cast("int") + 1, F.lit(1))
    return ids.select(F.array_join(F.transform(F.sequence(F.lit(1), size), char), "").alias("sample"))


def _identifier(words):
    """Two to four words joined as programs do: with marks, by capitals, in paths, with numbers."""
    w, number = F.transform(words, F.lower), F.pmod(F.hash(words), F.lit(97)).cast("string")
    first, rest = F.get(w, F.lit(0)), F.slice(w, F.lit(2), F.size(w) - 1)
    caps = lambda x: F.array_join(F.transform(x, F.initcap), "")
    snake = F.array_join(w, "_")
    kinds = [
        snake,
        F.upper(snake),
        F.concat(first, caps(rest)),
        caps(w),
        F.concat(F.array_join(w, "-"), F.lit("-"), number),
        F.array_join(w, "/"),
        F.concat(snake, F.lit("_"), number),
        F.concat(F.lit("/"), first, F.lit("/"), F.array_join(rest, "_"), number),
        F.concat(first, number, caps(rest)),
        F.concat(F.upper(first), number, F.lit("_"), F.upper(F.array_join(rest, "_"))),
    ]
    kind = F.pmod(F.xxhash64(words), F.lit(len(kinds)))
    out = F.when(kind == 0, kinds[0])
    for k, x in enumerate(kinds[1:], 1):
        out = out.when(kind == k, x)
    return out


def identifiers(docs: DataFrame) -> DataFrame:
    """(sample): the identifiers that each text's words make, taken three on at a time, and its runs of six token characters
    and more."""
    none = F.array().cast("array<string>")
    both = docs.select(*(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(c) for p, c in ((PLAIN, "runs"), (WORD, "words"))))
    starts = F.sequence(F.lit(0), F.floor((F.size("words") - 4) / 3).cast("int"))
    made = F.when(F.size("words") >= 4, F.transform(starts, lambda j: F.slice("words", j * 3 + 1, 2 + j % 3)))
    made = both.select(F.explode(made).alias("w")).select(_identifier(F.col("w")).alias("sample"))
    return both.select(F.explode(F.coalesce("runs", none)).alias("sample")).union(made)


def samples(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(label, sample): values of base spans and made random strings are random (1); what the texts of documents without
    base spans make is ordinary (0). All are bounded: the secrets and documents with the smallest hashes."""
    value = F.transform("assign", lambda x: F.regexp_extract(x["m"], ASSIGN, 2))
    values = F.concat(value, F.transform("access", lambda x: x["m"]), F.transform("hex", lambda x: x["m"]))
    secrets = found.select(F.explode(F.filter(values, lambda x: F.char_length(x) >= 12)).alias("sample")).distinct()
    secrets = secrets.orderBy(F.xxhash64("sample"), "sample").limit(MOST_SECRETS)
    clean = found.where("size(assign) + size(access) + size(hex) = 0").select("row").orderBy("row").limit(MOST_DOCS)
    clean = F.broadcast(durable(clean.distinct()))  # MOST_DOCS rows of 16 bytes at most
    plain = identifiers(durable(docs.select(row_key().alias("row"), "text").where("text is not null").join(clean, "row").select("text")))
    return secrets.union(random_strings(found.sparkSession)).select(F.lit(1).alias("label"), "sample").union(plain.select(F.lit(0).alias("label"), "sample"))


def chosen_threshold(spark, tables: list[list[float]]) -> float:
    """The ratio that all but the share LOST of the random strings reach, each judged by the models that have not learned
    from it. Above zero: without samples of one kind, when all ratios are zero, nothing reaches it."""
    found = random_strings(spark).select(ratio(F.col("sample"), tables).alias("r")).agg(F.percentile("r", LOST)).first()[0]
    return max(found, 1e-6)


def secret_spans(docs: DataFrame, threshold: float | None = None) -> DataFrame:
    """(doc_id, spans array<struct<s, k, e>>) of each row of ``docs`` (doc_id, text, ...): base spans by kind, and the tokens
    of 16 characters and more outside them whose mean log-likelihood ratio, by models that have not learned from the
    token, is at least ``threshold`` (None: chosen_threshold). Ordered by start, then kind as listed.

    Null texts are empty and have none; texts are read whole, whatever their length; rows alike in text have the same
    spans, repeated rows each give a row; extra columns are ignored; an empty table gives an empty one."""
    found = durable(base_spans(docs))
    tables = train_markov(samples(found, docs))
    if threshold is None:
        threshold = chosen_threshold(docs.sparkSession, tables)

    def tag(spans, k):
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))

    tagged = [tag(name, k) for k, name in enumerate(KINDS[:3])]
    extra = F.when(F.size("tokens") > 0, tag(F.filter("tokens", lambda x: ratio(x["m"], tables) >= threshold), 3))
    extra = F.coalesce(extra, F.array().cast("array<struct<s:int,k:int,e:int>>"))
    return found.select("doc_id", F.array_sort(F.concat(*tagged, extra)).alias("spans"))


def _said(array):
    return F.array_join(F.transform(array, lambda x: F.concat(F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def op5_secrets(spark, sf_dir):
    out = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["k"] < 3)
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_said(base), 256).alias("base_sha256"), _said("spans").alias("spans"))
