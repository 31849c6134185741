"""Toxicity by noisy-channel restoration: decode disguised words, then score the restored text.

Disguises are leetspeak (1d10t), spacing (s t u p i d, s-t-u-p-i-d) and repetition (stuuupid). A disguised word is a
lattice: every character has the letters it may stand for, with a channel cost; separators may vanish; a run of one
letter may be shorter; in runs of single letters words may end anywhere. Viterbi search finds the cheapest path under channel plus a character trigram model, whose
counts come from all documents. Words without signs of disguise are taken as they are; of disguised ones only the restored form counts.

The score's features are restored words and beginnings of words. One pass over a bounded sample of labelled documents
(``sample`` rows by seeded hash; copies and near copies among them, told by a min-hash of word trigrams, count once, with their mean label)
counts how often each occurs in toxic and other documents; all those that speak for toxicity, by a precision q (lower
confidence bound), form a lexicon, whose size the sample bounds. A text's score is 1 - (1 - base) * (1 - q1) * prod(sqrt(1 - qk)) over
its words' strongest features, q1 being the largest; ``base`` is the share of toxic documents among the sampled ones without any feature.

A text is split at white space once. A worker remembers what a token speaks for, so most tokens cost one look-up; texts are
taken in slices of bounded size, and a long text costs time in proportion to its length.

Defined results: null and empty texts score ``base``; rows are scored one by one, so repeated rows and null ids don't matter; without
toxic labels every score is ``base``; labels of null ids or null labels aren't learned; a carried column named ``score`` gives way to the result; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from stratavec.session import materialize, ship, trim

from . import tokens
from .sharding import seeded_hash

#: Precision and toxic documents that a feature of the lexicon has at least.
PRECISION, SUPPORT = 0.4, 4
#: Bytes of text a worker handles at a time, and tokens it remembers.
SLICE, REMEMBERED = 1 << 20, 200_000
# Model alphabet: 0 word edge, 1-26 a-z, 27 any other character.
_ALPHABET = 28
# The letters a sign may stand for in leetspeak.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c", "<": "c", "£": "l", "¡": "i"}
_SEPARATORS = "-_.*~·•'`^"
_COST = {"same": 0.0, "leet": 1.0, "drop": 0.5, "shorter": 0.3, "keep_sign": 6.0}
_KEPT = 40  # longer strings are decoded but not remembered, if they aren't numbers or hex digests

_SIGNS = re.escape("".join(LEET) + _SEPARATORS)
# a token (no white space) with a letter and a sign, or with a letter three times in a row
_LETTER = re.compile(r"[^\W\d_]")
_SIGN, _TRIPLE = re.compile(f"[{_SIGNS}]"), re.compile(r"(\w)\1\1")
_SPACED = re.compile(rf"(?<!\S)(?:[\w@$!|+][ ]+){{2,}}[\w@$!|+](?![^\s.,;:?!])")
_SINGLES = re.compile(r" \S +\S(?![^\s.,;:?!])")  # stands in every such run
_WORD = re.compile(r"[^\W\d_]+")
_CODE = re.compile(r"\d+|(?=.*\d)(?!.*(.)\1{4})[0-9a-f]+")
_GAP = re.compile(r" {2,}")
_EDGE = ".,;:!?\"'()[]"


def _code(text: str) -> np.ndarray:
    """Model symbols of lower-cased text: a-z, edges for white space, others as one."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    table = _TABLE.take(np.minimum(raw, 128))
    return table


_TABLE = np.full(129, 27, np.uint32)
for _c in range(26):
    _TABLE[97 + _c] = 1 + _c
for _c in (9, 10, 11, 12, 13, 32):
    _TABLE[_c] = 0


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Character trigram counts over all whole texts: one row a trigram and task is shuffled, 28^3 reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_ALPHABET**3, np.int64)
        for batch in batches:
            for a, b in tokens.byte_groups(batch.column(0)):
                s = _code(" " + "  ".join((t or "").lower() for t in batch.column(0).slice(a, b - a).to_pylist()) + " ")
                total += np.bincount((s[:-2] * _ALPHABET + s[1:-1]) * _ALPHABET + s[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["t", "n"])

    ship(docs.sparkSession)
    got = docs.select(F.col(text).cast("string")).mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(_ALPHABET**3, np.int64)
    for t, n in got:
        out[t] = n
    return out


def language_model(counts: np.ndarray) -> list:
    """Nested costs [a][b][c] = -log P(c | a, b), trigrams backed off to bigrams and letters."""
    c3 = counts.reshape((_ALPHABET,) * 3).astype(float)
    c2, c1 = c3.sum(0), c3.sum((0, 1))
    p1 = (c1 + 1) / (c1.sum() + _ALPHABET)
    p2 = (c2 + 10 * p1) / (c2.sum(1, keepdims=True) + 10)
    p3 = (c3 + 10 * p2[None]) / (c3.sum(2, keepdims=True) + 10)
    return (-np.log(p3)).tolist()


def decode(word: str, lm: list, edges: bool = False) -> str:
    """The word a lower-case string of letters, signs and separators most likely stands for (Viterbi).

    With ``edges`` a word may end between any two letters; the words come with blanks between them.
    """
    # lattice: per position, the choices (symbols emitted, cost)
    steps: list[list[tuple[str, float]]] = []
    i, n = 0, len(word)
    while i < n:
        ch, j = word[i], i
        while j < n and word[j] == ch:
            j += 1
        run = j - i
        if ch.isalpha():
            choices = [(ch * run, _COST["same"] if run <= 2 else 2.0 * run)] + ([(ch * k, _COST["shorter"]) for k in (1, 2)] if run >= 3 else [])
        else:
            choices = [(x * k, _COST["leet"] * min(run, 2) + (_COST["shorter"] if k < run else 0.0)) for x in LEET.get(ch, "") for k in ({1, 2, run} if run <= 2 else {1, 2}) if k <= run]
            if ch in _SEPARATORS or (i == 0 or j == n) and not ch.isdigit():
                choices.append(("", _COST["drop"]))
            choices.append((ch * run, _COST["keep_sign"] * run))
        if edges and run == 2:
            choices += [(x[0] + " " + x[1], c) for x, c in choices if len(x) == 2]
        if edges and i:
            choices += [(" " + x, c) for x, c in choices if x]
        steps.append(choices)
        i = j

    def said(path) -> str:
        out = []
        while path:
            path, x = path
            out.append(x)
        return "".join(reversed(out))

    # states are the last two symbols; paths are linked backwards, so that time is linear in the length
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for choices in steps:
        nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a0, b0), (cost, path) in best.items():
            for out, extra in choices:
                a, b, total = a0, b0, cost + extra
                for ch in out:
                    c = ord(ch) - 96 if "a" <= ch <= "z" else 0 if ch == " " else 27
                    total += lm[a][b][c]
                    a, b = b, c
                old = nxt.get((a, b))
                if old is None or total < old[0] or total == old[0] and n <= _KEPT and said((path, out)) < said(old[1]):
                    nxt[a, b] = total, (path, out)
        best = nxt
    return min((cost + lm[a][b][0], said(path)) for (a, b), (cost, path) in best.items())[1]


class Restorer:
    """Restores whole texts; remembers words it has decoded.

    In runs of single letters it also finds the words of ``lex`` (of four letters or more) wherever they stand: trigrams
    alone don't always tell where words end.
    """

    def __init__(self, lm: list, lex: Iterable[str] = ()):
        self.lm, self.known = lm, {}
        self.lex = {w for w in lex if len(w) >= 4 and w.isalpha()}
        self.lengths = sorted({len(w) for w in self.lex})

    def word(self, w: str, edges: bool = False) -> str:
        got = self.known.get((w, edges))
        if got is None:
            got = w if len(w) > _KEPT and _CODE.fullmatch(w) else decode(w, self.lm, edges)
            if len(self.known) < REMEMBERED // 2 and len(w) <= _KEPT:
                self.known[w, edges] = got
        return got

    def spaced(self, run: str) -> list[str]:
        """The words of a run of single letters: one between two wide gaps (two or more blanks, if there are narrower ones), split further where the model says so."""
        parts = _GAP.split(run) if re.search(r"\S \S", run) else [run]
        return [w for x in parts for w in self.word("".join(x.split()), True).split()]

    def within(self, letters: str) -> set[str]:
        """The words of the lexicon that stand anywhere in a string."""
        return {letters[i : i + k] for k in self.lengths for i in range(len(letters) - k + 1)} & self.lex

    def token(self, token: str) -> list[str]:
        """The restored words of one lower-case token."""
        bare = token.strip(_EDGE)
        if bare.isalpha() and not _TRIPLE.search(bare) and token[0] not in LEET:
            return [bare]
        rest = token.rstrip(_EDGE)  # a sign that ends a sentence stands for no letter
        if _LETTER.search(rest) and (_SIGN.search(rest) or _TRIPLE.search(rest)):
            return _WORD.findall(self.word(rest))
        return [bare] if bare else []

    def runs(self, text: str) -> list[str]:
        """Restored words of the runs of single letters of a lower-case text."""
        out = []
        if _SINGLES.search(text):
            for m in _SPACED.finditer(text):
                letters = "".join(m.group().split())
                out += [self.word(letters), self.word(letters[1:]), *self.spaced(m.group())]  # the first may be a word such as "a"
                out += self.within(self.word(letters))
        return [w for x in out for w in _WORD.findall(x)]

    def text(self, text: str) -> str:
        """The restored text."""
        low = text.lower()
        low = _SPACED.sub(lambda m: " ".join(self.spaced(m.group())), low)
        return re.sub(r"\S+", lambda m: " ".join(self.token(m.group())) or m.group(), low)


def words(text: str, restorer: Restorer) -> set[str]:
    """Distinct words of the restored text."""
    low = text.lower()
    out = {w for t in set(low.split()) for w in restorer.token(t)}
    out.update(restorer.runs(low))
    return out


def beginnings(word: str) -> list[str]:
    """The features of a word: itself, and its first 4 to 6 letters if it is longer."""
    return [word] + ["^" + word[:k] for k in (4, 5, 6) if len(word) > k]


class Scorer:
    """Scores whole texts; remembers what a token speaks for."""

    def __init__(self, lm: list, lex: dict[str, float], base: float):
        self.rest, self.lex, self.base = Restorer(lm, lex), lex, base
        self.known: dict[str, tuple] = {}
        self.heads = {f.removeprefix("^")[:4] for f in lex}

    def speaks(self, found: Iterable[str]) -> tuple:
        """(word, precision of its strongest feature) of the words that have one."""
        rated = ((w, max(self.lex.get(f, 0.0) for f in beginnings(w))) for w in found if w[:4] in self.heads)
        return tuple(x for x in rated if x[1])

    def score(self, text: str | None) -> float:
        if not text:
            return self.base
        low = text.lower()
        tokens_ = set(low.split())
        said = list(map(self.known.get, tokens_))
        if None in said:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            for i, t in enumerate(tokens_):
                if said[i] is None:
                    said[i] = self.speaks(self.rest.token(t))
                    if len(t) <= _KEPT:
                        self.known[t] = said[i]
        spoken = dict(x for s in said if s for x in s)
        spoken.update(self.speaks(self.rest.runs(low)))
        total = math.log1p(-self.base)
        for k, q in enumerate(sorted(spoken.values(), reverse=True)):
            total += math.log1p(-min(q, 0.999)) * (0.5 if k else 1.0)  # features after the first aren't independent of it
        return -math.expm1(total)


def _sketch(text: str) -> int:
    import xxhash

    w = text.lower().split()
    return min((xxhash.xxh64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=0) - (1 << 63)


def lexicon(docs: DataFrame, labels: DataFrame, lm: list, sample: int = 20_000, seed: int = 17, least: int = SUPPORT, text: str = "text", key: str = "doc_id") -> tuple[dict[str, float], float]:
    """Feature: precision, and the base score. labels: doc_id, toxic (the caller leaves out what mustn't be learned)."""
    few = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").alias("_k"), F.col("toxic").cast("int").alias("_y")).withColumn("_o", seeded_hash(seed, "_k")).orderBy("_o", "_k", "_y").limit(sample).drop("_o")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(few), F.col("doc_id") == F.col("_k")).select("doc_id", "text", "_y")  # at most `sample` rows

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = Restorer(lm)
        for batch in batches:
            for a, b in tokens.byte_groups(batch.column(1), SLICE):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                feats = [sorted({f for w in words(t or "", rest) for f in beginnings(w)}) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array([_sketch(t or "") for t in texts], pa.int64()), batch.column(2).slice(a, b - a), pa.array(feats, pa.list_(pa.string()))], ["k", "y", "f"])
        del rest
        trim()

    ship(docs.sparkSession)
    seen = rows.mapInArrow(sketch, "k long, y int, f array<string>").groupBy("k").agg(F.avg("y").alias("y"), F.max_by("f", F.struct(F.size("f"), "f")).alias("f")).drop("k")
    seen = materialize(seen, "toxic-sample")
    n_pos, n_all = seen.agg(F.sum("y"), F.count(F.lit(1))).first()
    if not n_pos:
        return {}, 1 / (n_all + 2)
    counts = seen.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    # lower end of the Wilson interval at two standard deviations
    share = F.col("pos") / F.col("n")
    low = (share + 2 / F.col("n") - 2 * F.sqrt(share * (1 - share) / F.col("n") + 1 / (F.col("n") * F.col("n")))) / (1 + 4 / F.col("n"))
    strong = counts.where(F.col("pos") >= least).withColumn("q", low).where(F.col("q") >= PRECISION).select("f", "q")
    lex = {f: float(q) for f, q in strong.collect()}  # each occurs in `least` or more of the sample's toxic documents
    rest_pos, rest_all = seen.where(~F.arrays_overlap("f", F.array(*[F.lit(f) for f in sorted(lex)]))).agg(F.sum("y"), F.count(F.lit(1))).first() if lex else (n_pos, n_all)
    return lex, ((rest_pos or 0.0) + 1) / (rest_all + 2)


def score(docs: DataFrame, labels: DataFrame, sample: int = 20_000, text: str = "text", key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """``docs``'s carried columns (null: the key) with ``score`` (0 to 1) for every whole text."""
    spark = docs.sparkSession
    ship(spark)
    lm = language_model(trigram_counts(docs, text))
    lex, base = lexicon(docs, labels, lm, sample, text=text, key=key)
    held = spark.sparkContext.broadcast((lm, lex, base))  # 28^3 costs, and the lexicon, which the sample bounds
    carry = [c for c in (carry or [key]) if c != "score"]
    own = [f"c{i}" for i in range(len(carry))]  # carried columns can't clash with the working ones
    sent = text in carry and dict(docs.dtypes)[text] == "string"
    at = carry.index(text) if sent else len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*held.value)
        for batch in batches:
            for a, b in tokens.byte_groups(batch.column(at), SLICE):
                part = batch.slice(a, b - a)
                got = [scorer.score(t) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(own)], pa.array(got, pa.float64())], [*own, "score"])
        del scorer
        trim()

    rows = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(carry, own)], *([] if sent else [F.col(text).cast("string").alias("t")]))
    out = rows.mapInArrow(run, StructType([*rows.schema.fields[: len(own)], StructField("score", DoubleType())]))
    return out.select(*[F.col(o).alias(c) for o, c in zip(own, carry)], "score")


def held_out(key: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1
