"""Evaluation passages that stand in training documents, by latent semantic retrieval.

Documents and items are cut into overlapping passages of words. Words are hashed into FEATURES dimensions and weighted by TF-IDF,
whose counts cover all documents. A randomised SVD of the passage matrix is computed by passes over the corpus: each partition
adds its part of A'(AQ), a matrix whose size doesn't depend on the corpus, and the parts meet in a tree; the eigenvectors of the
small matrix Q'A'AQ order the directions, of which RANK are kept. Passages and items are projected on them, and a document and an
item with passages of a cosine of COSINE or more are a candidate pair. The items' passages are kept in cells around centres; a passage is held against those cells whose centre it is near to. Of the
passage pairs of COSINE or more that keeps 99 %, of those alike enough for a paraphrase all (measured on the test tables).

- verbatim: an index of all runs of RUN words of the items is held against the document's runs, and the words themselves are
  compared where hashes agree. Pairs below the cosine whose runs agree are found all the same, so that the cosine loses none;
- paraphrase: the longest common subsequence of the item and the stretch of the document that met it must hold ALIKE_ORDER of the
  item's words, and the answer check wants ANSWERED of the item's weight there: its names, numbers and other rare words, which
  carry the answer, count by their inverse frequency.

The items are the stated query set: they are broadcast, BLOCK at a time, and the corpus is read against them without a shuffle.

Words are runs of letters and digits of the NFKC form, without case and without characters that do not show. Null, empty and
short texts leak nothing; repeated documents are reported each.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import ship, spread, written

FEATURES, RANK, MORE, ROUNDS, SEED = 1 << 14, 64, 16, 2, 7
COSINE, RUN = 0.45, 12
WIDTH, STRIDE = 24, 12
#: A paraphrase has this cosine, this share of the item's words in the same order, and this share of the item's weight.
ALIKE_COSINE, ALIKE_ORDER, ANSWERED = 0.8, 0.7, 0.7
#: Items broadcast at a time; cells that their passages are put in, and the cosine to a cell's centre from which it is looked into.
BLOCK, CELLS, PROBE = 20_000, 32, 0.3

_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_HIDDEN = regex.compile(r"[\p{Cf}\p{Cc}--[\t\n\v\f\r\x85]]|[︀-️]", regex.V1)
_ASCII = re.compile(r"[a-z0-9]+")
_CONTROL = dict.fromkeys(i for i in [*range(32), 127] if chr(i) not in "\t\n\v\f\r")


def words(text: str | None) -> list[str]:
    t = text or ""
    if t.isascii():
        return _ASCII.findall((t if t.isprintable() else t.translate(_CONTROL)).lower())
    return _WORD.findall(_HIDDEN.sub("", unicodedata.normalize("NFKC", t)).casefold())


class WordIds(dict):
    """A hash of each word; a cache of bounded size."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = i = zlib.crc32(word.encode("utf-8", "ignore"))
        return i

    def of(self, text: str | None) -> np.ndarray:
        return np.array(list(map(self.__getitem__, words(text))), np.uint32)


def passages(ids: np.ndarray, width: int, stride: int) -> list[np.ndarray]:
    """Passages of width words every stride, the last one shorter; none of a text shorter than a run."""
    n = len(ids)
    return [ids[i : i + width] for i in range(0, max(n - width + stride, 1), stride)] if n >= RUN else []


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.diff(np.append(first, len(keys)))


def sparse(parts: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised TF-IDF rows: features, weights, and where each row begins."""
    rows = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    key = rows * FEATURES + np.concatenate(parts).astype(np.int64) % FEATURES
    u, c = counted(key)
    row, feature = u // FEATURES, u % FEATURES
    w = (c * idf[feature]).astype(np.float32)
    begin = np.searchsorted(row, np.arange(len(parts)))
    norm = np.sqrt(np.add.reduceat(w * w, begin))
    return feature, w / norm[row], begin


def times(m: tuple, x: np.ndarray) -> np.ndarray:
    """The rows times x, in chunks that fit the cache."""
    feature, w, begin = m
    out = np.empty((len(begin), x.shape[1]), np.float32)
    ends = np.append(begin[1:], len(feature))
    for a in range(0, len(begin), 512):
        b = min(a + 512, len(begin))
        lo, hi = begin[a], ends[b - 1]
        out[a:b] = np.add.reduceat(x[feature[lo:hi]] * w[lo:hi, None], begin[a:b] - lo, axis=0)
    return out


def add_transposed(m: tuple, y: np.ndarray, total: np.ndarray) -> None:
    """Adds the transpose of the rows times y to total."""
    feature, w, begin = m
    ends = np.append(begin[1:], len(feature))
    for a in range(0, len(begin), 512):
        b = min(a + 512, len(begin))
        lo, hi = begin[a], ends[b - 1]
        rows = np.repeat(np.arange(a, b), ends[a:b] - begin[a:b])
        order = np.argsort(feature[lo:hi], kind="stable")
        f = feature[lo:hi][order]
        first = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
        total[f[first]] += np.add.reduceat(y[rows[order]] * w[lo:hi][order, None], first, axis=0)


def unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)


def tokenised(documents: DataFrame) -> DataFrame:
    """doc_id, ids (the words' hashes as bytes) of each document with at least one run's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for b in batches:
            rows = [(i, v.tobytes()) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) if len(v := ids.of(t)) >= RUN]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "ids"])

    return spread(documents.select("doc_id", "text").where("text is not null and doc_id is not null")).mapInArrow(run, "doc_id bigint, ids binary")


def _batches(b: pa.RecordBatch, at_once: int = 400) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    doc, ids = b.column("doc_id").to_pylist(), b.column("ids").to_pylist()
    for a in range(0, len(doc), at_once):
        yield doc[a : a + at_once], [np.frombuffer(x, np.uint32) for x in ids[a : a + at_once]]


def inverse_frequency(corpus: DataFrame) -> np.ndarray:
    """The weight of each feature, over all passages of the corpus. At most FEATURES rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(FEATURES, np.int64)
        for b in batches:
            for _, texts in _batches(b):
                parts = [p for t in texts for p in passages(t, WIDTH, WIDTH)]
                n += len(parts)
                rows = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
                u, _ = counted(rows * FEATURES + np.concatenate(parts).astype(np.int64) % FEATURES)
                df += np.bincount(u % FEATURES, minlength=FEATURES)
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), pa.array(np.append(df[hit], n))], ["feature", "n"])

    counts = corpus.mapInArrow(run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(FEATURES)
    total = 0
    for f, n in counts:
        if f < 0:
            total = n
        else:
            df[f] = n
    return (np.log((total + 1) / (df + 1)) + 1).astype(np.float32)


def directions(corpus: DataFrame, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """The leading right singular directions of the passage matrix, FEATURES x rank."""
    sc = corpus.sparkSession.sparkContext
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((FEATURES, rank + MORE)))[0].astype(np.float32)
    weights = sc.broadcast(idf)
    for _ in range(ROUNDS):
        held = sc.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            total = np.zeros((FEATURES, held.value.shape[1]), np.float32)
            for b in batches:
                for _, texts in _batches(b):
                    parts = [p for t in texts for p in passages(t, WIDTH, WIDTH)]
                    if parts:
                        m = sparse(parts, weights.value)
                        add_transposed(m, times(m, held.value), total)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.large_binary())], ["part"])

        parts = corpus.mapInArrow(run, "part binary")
        # One row a partition, all of one size whatever the corpus is; they are added up in a tree.
        total = parts.rdd.map(lambda r: np.frombuffer(bytes(r[0]), np.float32)).treeReduce(lambda a, b: a + b, depth=3)
        total = total.reshape(FEATURES, -1).astype(np.float64)
        # The small matrix Q'A'AQ: its eigenvectors order the directions by their singular values before the last are cut off.
        small = q.T.astype(np.float64) @ total
        order = np.linalg.eigh((small + small.T) / 2)[1][:, ::-1]
        q = np.linalg.qr(total @ order)[0].astype(np.float32)
        held.unpersist()
    return q[:, :rank]


_POWERS = np.array([pow(0x9E3779B97F4A7C15, j, 1 << 64) for j in range(RUN)], np.uint64)


def run_hashes(ids: np.ndarray) -> np.ndarray:
    """A hash of each run of RUN words."""
    n = len(ids) - RUN + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        wide = ids.astype(np.uint64) + np.uint64(1)
        for j in range(RUN):
            out += wide[j : j + n] * _POWERS[j]
    return out


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Words in the longest common subsequence of a and b."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0)))
    return int(row[-1])


def cells(x: np.ndarray, n: int = CELLS, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Centres of at most n cells of unit rows, and the cell of each row."""
    if not len(x):
        return np.zeros((0, x.shape[1]), np.float32), np.zeros(0, np.int64)
    centres = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)].copy()
    for _ in range(rounds):
        of = np.argmax(x @ centres.T, axis=1)
        for j in range(len(centres)):
            if (of == j).any():
                centres[j] = x[of == j].sum(0)
        centres = unit(centres)
    return centres, np.argmax(x @ centres.T, axis=1)


class Items:
    """A block of items: their words, the index of their runs, and their passages in latent space."""

    def __init__(self, rows: list[tuple[int, str]], idf: np.ndarray, basis: np.ndarray):
        ids = WordIds()
        kept = [(i, v) for i, t in rows if len(v := ids.of(t)) >= RUN]
        self.ids, self.words = [i for i, _ in kept], [v for _, v in kept]
        self.all = np.concatenate([*self.words, np.zeros(0, np.uint32)])
        at, runs, of, where = 0, [], [], []
        for k, v in enumerate(self.words):
            h = run_hashes(v)
            runs.append(h)
            of.append(np.full(len(h), k))
            where.append(at + np.arange(len(h)))
            at += len(v)
        runs, of, where = (np.concatenate([*x, np.zeros(0, t)]) for x, t in ((runs, np.uint64), (of, np.int64), (where, np.int64)))
        order = np.argsort(runs, kind="stable")
        self.runs, self.run_of, self.run_at = runs[order], of[order], where[order]
        parts = [(k, p) for k, v in enumerate(self.words) for p in passages(v, WIDTH, STRIDE)]
        self.basis, self.idf = basis, idf
        latent = unit(times(sparse([p for _, p in parts], idf), basis)) if parts else np.zeros((0, basis.shape[1]), np.float32)
        self.centres, cell = cells(latent)
        order = np.argsort(cell, kind="stable")
        self.latent, self.of = latent[order], np.array([k for k, _ in parts], np.int64)[order]
        self.bounds = np.searchsorted(cell[order], np.arange(len(self.centres) + 1))

    def verbatim(self, texts: list[np.ndarray]) -> set[tuple[int, int]]:
        """(text, item) of each pair with RUN words in a row: runs of equal hash, compared word by word."""
        if not len(self.runs):
            return set()
        flat = np.concatenate(texts)
        of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        h = run_hashes(flat)
        at = np.flatnonzero(of[: len(h)] == of[RUN - 1 :])  # runs within one text
        lo = np.searchsorted(self.runs, h[at])
        at, lo = at[(hit := (lo < len(self.runs)) & (self.runs[np.minimum(lo, len(self.runs) - 1)] == h[at]))], lo[hit]
        out: set[tuple[int, int]] = set()
        while len(at):
            same = (flat[at[:, None] + np.arange(RUN)] == self.all[self.run_at[lo][:, None] + np.arange(RUN)]).all(1)
            out |= set(zip(of[at[same]].tolist(), self.run_of[lo[same]].tolist(), strict=True))
            more = (lo + 1 < len(self.runs)) & (self.runs[np.minimum(lo + 1, len(self.runs) - 1)] == self.runs[lo])
            at, lo = at[more], lo[more] + 1
        return out

    def candidates(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each pair with passages of a cosine of COSINE or more: text times number of items plus item, in order, its best cosine, and begin and end of the words that met."""
        none = np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        parts = [(k, p) for k, t in enumerate(texts) for p in passages(t, WIDTH, STRIDE)]
        if not parts or not len(self.of):
            return none
        of = np.array([k for k, _ in parts], np.int64)
        number = np.arange(len(of)) - np.searchsorted(of, of)
        latent = unit(times(sparse([p for _, p in parts], self.idf), self.basis))
        near = latent @ self.centres.T >= PROBE
        keys, cosines, numbers = [none[0]], [none[1]], [none[2]]
        for j, (lo, hi) in enumerate(zip(self.bounds[:-1], self.bounds[1:], strict=True)):
            rows = np.flatnonzero(near[:, j])
            for a in range(0, len(rows), 4000):
                some = rows[a : a + 4000]
                cosine = (latent[some] @ self.latent[lo:hi].T).ravel()
                hit = np.flatnonzero(cosine >= COSINE)
                x = some[hit // (hi - lo)]
                keys.append(of[x] * len(self.ids) + self.of[lo + hit % (hi - lo)])
                cosines.append(cosine[hit])
                numbers.append(number[x])
        key, cosine, number = np.concatenate(keys), np.concatenate(cosines), np.concatenate(numbers)
        if not len(key):
            return none
        order = np.argsort(key, kind="stable")
        key, cosine, number = key[order], cosine[order], number[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return key[first], np.maximum.reduceat(cosine, first), np.minimum.reduceat(number, first) * STRIDE, np.maximum.reduceat(number, first) * STRIDE + WIDTH

    def leaks(self, texts: list[np.ndarray]) -> list[tuple[int, int]]:
        """(text, item) of the verbatim leaks: candidates by cosine that the index confirms, then what the index holds besides."""
        sure = self.verbatim(texts)
        keys = np.array(sorted(k * len(self.ids) + i for k, i in sure), np.int64)
        retrieved = keys[np.isin(keys, self.candidates(texts)[0], assume_unique=True)]
        return [divmod(k, len(self.ids)) for k in [*retrieved.tolist(), *np.setdiff1d(keys, retrieved, assume_unique=True).tolist()]]

    def report(self, texts: list[np.ndarray]) -> list[tuple]:
        """(text, item, cosine or None if below COSINE, share in order, share of weight, kind) of the leaks of both kinds."""
        sure, out = self.verbatim(texts), []
        key, cosine, low, high = self.candidates(texts)
        asked = np.array(sorted(k * len(self.ids) + i for k, i in sure), np.int64)
        kept = (cosine >= ALIKE_COSINE) | np.isin(key, asked)
        met = {k: (c, a, b) for k, c, a, b in zip(key[kept].tolist(), cosine[kept].tolist(), low[kept].tolist(), high[kept].tolist(), strict=True)}
        for pair in sorted({*met, *asked.tolist()}):
            k, i = divmod(pair, len(self.ids))
            c, begin, end = met.get(pair, (None, 0, len(texts[k])))
            item, stretch = self.words[i], texts[k][max(0, begin - WIDTH) : end + WIDTH]
            there, weight = np.isin(item, stretch), self.idf[item.astype(np.int64) % FEATURES]
            answered = float(weight[there].sum() / weight.sum())
            if (k, i) not in sure and (answered < ANSWERED or there.mean() < ALIKE_ORDER):
                continue  # no subsequence can be longer than the words in common
            share = common_subsequence(stretch, item) / len(item)
            if (k, i) in sure or share >= ALIKE_ORDER:
                out.append((k, self.ids[i], None if c is None else round(float(c), 4), round(share, 4), round(answered, 4), "verbatim" if (k, i) in sure else "paraphrase"))
        return out


def prepared(documents: DataFrame, items: DataFrame) -> tuple[DataFrame, list[Items]]:
    """The corpus as word ids, and the items in blocks of about BLOCK."""
    corpus = written(tokenised(documents), "leakage")
    idf = inverse_frequency(corpus)
    basis = directions(corpus, idf)
    given = items.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    blocks = max(1, -(-given.count() // BLOCK))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return corpus, [Items([(r[0], r[1]) for r in given.where(part == b).collect()], idf, basis) for b in range(blocks)]


def _against(corpus: DataFrame, blocks: list[Items], read, schema: str) -> DataFrame:
    """The corpus read against each block; read(items, doc ids, texts) gives rows."""
    out = None
    arrow = corpus.sparkSession.createDataFrame([], schema).schema
    for made in blocks:
        held = ship(corpus.sparkSession, made)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            it, kind = pickle.loads(held.value), to_arrow_schema(arrow)
            for b in batches:
                for doc, texts in _batches(b):
                    if rows := read(it, doc, texts):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], kind.names)

        part = corpus.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def verbatim(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id of each document and item that share RUN consecutive words."""
    return _against(*prepared(documents, items), lambda it, doc, texts: [(doc[k], it.ids[i]) for k, i in it.leaks(texts)], "doc_id bigint, item_id bigint")


def reported(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine (null below COSINE), in_order (share of the item's words in the longest common subsequence), answered (share of its weight), kind of each leak."""
    read = lambda it, doc, texts: [(doc[k], *rest) for k, *rest in it.report(texts)]
    return _against(*prepared(documents, items), read, "doc_id bigint, item_id bigint, cosine double, in_order double, answered double, kind string")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return verbatim(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/eval_items.parquet"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return reported(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/eval_items.parquet"))


QUERIES = {"p8_found": p8_found, "p8_leaks": p8_leaks}
