"""Language ID of code-switched text by a linear-chain conditional random field.

Words (runs of letters, lower-cased) carry labels; a word's score for a label is the sum of the weights of
its features: hashed character n-grams, prefixes and suffixes, and the words of a lexicon learned from the
training rows. Learned transitions tie neighbouring words, and forward-backward gives each word's label
probabilities. A text's language is the one with the largest mean probability over its words.

The model is fitted on the driver to a bounded sample (`per_lang` whole documents of each language, by hash
order), spliced into code-switched sequences so that transitions have something to learn. Labelling runs in
Spark tasks: a batch's words form one chain that restarts at each text, cut into blocks of equal length whose
transfer products give the exact messages at the block ends, so that all blocks advance together.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, broadcast_if_small, crc32_of_id, give_back, smaller_batches, stored

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 17
BLOCK = 256
MIX = np.uint64(0x9E3779B97F4A7C15)


def has_letter(words: list[str]) -> bool:
    """Some word has a letter (the pattern also matches numerals such as a superscript two)."""
    return any(c.isalpha() for w in words for c in w)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


def features(words: list[str], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each feature, first feature of each word), for non-empty words.

    Every word gets the 1-, 2- and 3-grams of ^word$, its prefixes and suffixes of 2 to 4 characters, and
    itself if the lexicon (sorted hashes) has it.
    """
    text = "".join(f"^{w}$" for w in words)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    start = np.r_[0, np.cumsum(size)[:-1]]
    left = np.repeat(start + size, size) - np.arange(len(code))  # characters from here to the word's end
    owner = np.repeat(np.arange(len(words)), size)
    found, owners = [], []
    gram = np.zeros(len(code), dtype=np.uint64)
    for n in (1, 2, 3, 4):
        gram = gram[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :]
        h = mixed(gram + np.uint64(n << 60))
        inside = left[: len(h)] >= n
        if n < 4:
            found.append(h[inside])
            owners.append(owner[: len(h)][inside])
        if n > 1:
            has = np.flatnonzero(size - 1 >= n)  # ^ and n - 1 letters; n - 1 letters and $
            found += [mixed(h[start[has]] + np.uint64(1)), mixed(h[start[has] + size[has] - n] + np.uint64(2))]
            owners += [has, has]
    whole = word_hashes(code, size, start)
    known = np.flatnonzero(lexicon[np.minimum(np.searchsorted(lexicon, whole), len(lexicon) - 1)] == whole) if len(lexicon) else np.empty(0, np.int64)
    found.append(mixed(whole[known] + np.uint64(3)))
    owners.append(known)
    owners, found = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owners, kind="stable")
    return (found[order] % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(owners[order], np.arange(len(words)))


def word_hashes(code: np.ndarray, size: np.ndarray, start: np.ndarray) -> np.ndarray:
    place = np.arange(len(code)) - np.repeat(start, size)
    return np.add.reduceat(mixed(code * MIX + place.astype(np.uint64)), start) if len(start) else np.empty(0, np.uint64)


def lexicon_of(words: list[str], least: int = 3) -> np.ndarray:
    """Sorted hashes of the words that occur at least `least` times."""
    count: dict[str, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    often = [w for w, n in count.items() if n >= least]
    if not often:
        return np.empty(0, np.uint64)
    code = np.frombuffer("".join(f"^{w}$" for w in often).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    size = np.fromiter(map(len, often), dtype=np.int64) + 2
    return np.unique(word_hashes(code, size, np.r_[0, np.cumsum(size)[:-1]]))


@dataclass
class Model:
    labels: list[str]
    weight: np.ndarray  # BUCKETS x labels
    move: np.ndarray  # log-weights of label to next label
    lexicon: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.empty((0, len(self.labels)), np.float32)
        buckets, first = features(words, self.lexicon)
        return np.add.reduceat(self.weight[buckets], first, axis=0)


def forward_backward(score: np.ndarray, move: np.ndarray, fresh: np.ndarray, pairs: bool = False, enter: np.ndarray | None = None, leave: np.ndarray | None = None):
    """Label probabilities of every word of a chain; `fresh` marks words that start a text.

    With pairs also the expected number of each (label, next label) within texts. enter and leave are the messages
    from the chain before and after, if this is a piece of one. Arrays are laid out label by label, so that each
    operation runs along all blocks.
    """
    n, k = score.shape
    blocks = -(-n // BLOCK)
    psi = np.ones((blocks * BLOCK, k), dtype=score.dtype)
    np.exp(score - score.max(axis=1, keepdims=True), out=psi[:n])
    psi = np.ascontiguousarray(psi.reshape(blocks, BLOCK, k).transpose(1, 2, 0))  # step, label, block
    new = np.ones(blocks * BLOCK, dtype=bool)  # what is past the end is cut off too
    new[:n] = fresh
    new = new.reshape(blocks, BLOCK)
    cut = [np.flatnonzero(new[:, t]) for t in range(BLOCK)]
    step = np.exp(move - move.max()).astype(score.dtype)
    onward = np.ascontiguousarray(step.T)

    product = np.repeat(np.eye(k, dtype=score.dtype)[:, :, None], blocks, axis=2)  # label, label at entry, block
    for t in range(BLOCK):
        y = (onward @ product.reshape(k, -1)).reshape(k, k, blocks)
        if len(cut[t]):  # a fresh word forgets the label before it
            y[:, :, cut[t]] = product[:, :, cut[t]].sum(axis=0) / k
        product = y * psi[t][:, None, :]
        if t % 4 == 3:
            product /= product.sum(axis=(0, 1))
    first, last = enter, leave
    enter, leave = np.empty((k, blocks), dtype=score.dtype), np.empty((k, blocks), dtype=score.dtype)
    v = np.full(k, 1 / k) if first is None else first
    for b in range(blocks):
        enter[:, b] = v
        v = product[:, :, b] @ v
        v /= v.sum()
    v = np.ones(k) if last is None else last
    for b in range(blocks - 1, -1, -1):
        leave[:, b] = v
        v = v @ product[:, :, b]
        v /= v.sum()
    alpha = np.empty((BLOCK, k, blocks), dtype=score.dtype)
    a = enter
    for t in range(BLOCK):
        y = onward @ a
        if len(cut[t]):
            y[:, cut[t]] = a[:, cut[t]].sum(axis=0) / k
        y *= psi[t]
        y /= y.sum(axis=0)
        a = alpha[t] = y
    out, expected = np.empty((BLOCK, k, blocks), dtype=score.dtype), np.zeros((k, k))
    beta = leave
    for t in range(BLOCK - 1, -1, -1):
        np.multiply(alpha[t], beta, out=out[t])
        ahead = psi[t] * beta
        if pairs:
            before = alpha[t - 1] if t else enter
            joint = before[:, None, :] * step[:, :, None] * ahead[None, :, :]
            expected += (joint / joint.sum(axis=(0, 1)))[:, :, ~new[:, t]].sum(axis=2)
        beta = step @ ahead
        if len(cut[t]):
            beta[:, cut[t]] = ahead[:, cut[t]].sum(axis=0) / k
        beta /= beta.sum(axis=0)
    out /= out.sum(axis=1, keepdims=True)
    prob = out.transpose(2, 0, 1).reshape(-1, k)[:n]
    return (prob, expected) if pairs else prob


def fit(rows: list[tuple[str, str]], rounds: int = 30, rate: float = 0.5, seed: int = 7, l2: float = 1e-6) -> Model:
    """Maximum conditional likelihood by AdaGrad over (language, text) rows, spliced into code-switched sequences.

    Each text's words are cut into stretches of 5 to 60; most stretches of a sequence keep its language.
    """
    labels = sorted({lang for lang, _ in rows})
    rng = random.Random(seed)
    stretches: dict[str, list[list[str]]] = {lang: [] for lang in labels}
    for lang, text in rows:
        w, at = WORD.findall(text.lower()), 0
        while at < len(w):
            n = rng.randint(5, 60)
            stretches[lang].append(w[at : at + n])
            at += n
    for s in stretches.values():
        rng.shuffle(s)
    words, gold, fresh = [], [], []
    while any(stretches.values()):
        lang, first = rng.choice([x for x in labels if stretches[x]]), True
        for _ in range(rng.randint(1, 6)):
            if rng.random() < 0.3 or not stretches[lang]:
                lang = rng.choice([x for x in labels if stretches[x]] or labels)
            if not stretches[lang]:
                break
            s = stretches[lang].pop()
            words += s
            gold += [labels.index(lang)] * len(s)
            fresh += [first] + [False] * (len(s) - 1)
            first = False
    lexicon = lexicon_of(words)
    k = len(labels)
    model = Model(labels, np.zeros((BUCKETS, k)), np.zeros((k, k)), lexicon)
    if not words:
        return model
    distinct: dict[str, int] = {}
    ids = np.array([distinct.setdefault(w, len(distinct)) for w in words])
    gold, fresh = np.array(gold), np.array(fresh)
    buckets, first = features(list(distinct), lexicon)
    owner = np.repeat(np.arange(len(distinct)), np.diff(np.r_[first, len(buckets)]))
    used, inverse = np.unique(buckets, return_inverse=True)
    weight, move = np.zeros((len(used), k)), np.zeros((k, k))
    sum_w, sum_m = np.full_like(weight, 1e-8), np.full_like(move, 1e-8)
    onehot = np.eye(k)[gold]
    inside = ~fresh[1:]
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[:-1][inside], gold[1:][inside]), 1)
    for _ in range(rounds):
        score = np.add.reduceat(weight[inverse], first, axis=0)[ids]
        prob, expected = forward_backward(score, move, fresh, pairs=True)
        per_word = np.stack([np.bincount(ids, (onehot - prob)[:, c], len(distinct)) for c in range(k)], axis=1) / len(words)
        grad = np.stack([np.bincount(inverse, per_word[owner, c], len(used)) for c in range(k)], axis=1) - l2 * weight
        grad_m = (seen - expected) / len(words)
        sum_w += grad**2
        sum_m += grad_m**2
        weight += rate * grad / np.sqrt(sum_w)
        move += rate * grad_m / np.sqrt(sum_m)
    model.weight[used] = weight
    model.weight = model.weight.astype(np.float32)
    model.move = move
    return model


def transfer(score: np.ndarray, move: np.ndarray, fresh: bool) -> np.ndarray:
    """What a piece of one text does to the message that enters it: label at its end by label before it, scaled."""
    n, k = score.shape
    onward, out, at_once = np.exp(move - move.max()).T, np.eye(k), max(2, (1 << 20) // (k * k))
    for at in range(0, n, at_once):
        part = score[at : at + at_once]
        psi = np.exp(part - part.max(axis=1, keepdims=True)).astype(np.float64)
        step = psi[:, :, None] * onward[None]  # word, its label, label before
        if fresh and not at:
            step[0] = psi[0][:, None] / k
        while len(step) > 1:  # products of neighbours, until one is left
            if len(step) % 2:
                step = np.concatenate([step, np.eye(k)[None]])
            step = step[1::2] @ step[::2]
            step /= step.sum(axis=(1, 2), keepdims=True)
        out = step[0] @ out
        out /= out.sum()
    return out


class Labeller:
    """Labels the words of texts; keeps the scores of words that it has met, up to a bound."""

    def __init__(self, model: Model):
        self.model, self.number = model, {}
        self.table = np.empty((0, len(model.labels)), np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        if len(self.number) > MET:
            self.number.clear()
            self.table = self.table[:0]
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.table = np.concatenate([self.table, *(self.model.emissions(new[at : at + 50_000]) for at in range(0, len(new), 50_000))])
        return self.table[np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))]

    def texts(self, texts: list[str | None]) -> Iterator[tuple[int, list[str], np.ndarray]]:
        """(number of a text, words, their label probabilities), texts of up to TOGETHER characters together, one of over LONG in
        pieces of PIECE words whose messages carry over, so that the probabilities are those of the whole chain."""
        held, size = [], 0
        for i, text in enumerate(texts):
            text = plain(text)
            if len(text) > LONG:
                yield from self._long(i, text)
                continue
            if held and size + len(text) > TOGETHER:
                yield from self._short(held)
                held, size = [], 0
            held.append((i, text))
            size += len(text)
        yield from self._short(held)

    def _short(self, texts: list[tuple[int, str]]) -> Iterator[tuple[int, list[str], np.ndarray]]:
        cut = [WORD.findall(t) for _, t in texts]
        flat = [w for ws in cut for w in ws]
        ends = np.cumsum([0, *map(len, cut)])
        prob = np.empty((0, len(self.model.labels)))
        if flat and self.model.labels:
            fresh = np.zeros(len(flat), dtype=bool)
            fresh[ends[:-1][np.diff(ends) > 0]] = True
            prob = forward_backward(self.scores(flat), self.model.move, fresh)
        for (i, _), ws, a, b in zip(texts, cut, ends[:-1], ends[1:], strict=True):
            yield i, ws, prob[a:b]

    def _long(self, i: int, text: str) -> Iterator[tuple[int, list[str], np.ndarray]]:
        """Two walks along the text: the first finds what each piece does to a message, the second labels it."""
        k = len(self.model.labels)
        if not k:
            yield i, WORD.findall(text), np.empty((0, 0))
            return
        through = [transfer(self.scores(ws), self.model.move, at == 0) for at, ws in enumerate(in_pieces(text))]
        leaves, v = [], np.ones(k)
        for t in reversed(through):
            leaves.append(v)
            v = v @ t
            v = v / v.sum()
        enter = np.full(k, 1 / k)
        for at, (ws, t, leave) in enumerate(zip(in_pieces(text), through, reversed(leaves), strict=True)):
            fresh = np.zeros(len(ws), dtype=bool)
            fresh[0] = at == 0
            yield i, ws, forward_backward(self.scores(ws), self.model.move, fresh, enter=enter, leave=leave)
            enter = t @ enter
            enter = enter / enter.sum()


LONG = 1 << 20  # characters
TOGETHER = 1 << 18  # characters of texts that are labelled at once
MET = 100_000  # words whose scores are kept
PIECE = 256 * BLOCK  # words; whole blocks, so that messages pass between them


def plain(text: str | None) -> str:
    """Lower case of the same length: the one letter whose lower case is two characters loses its dot first."""
    return (text or "").replace("\u0130", "I").lower()


def in_pieces(text: str) -> Iterator[list[str]]:
    words = (m[0] for m in WORD.finditer(text))
    while piece := list(islice(words, PIECE)):
        yield piece


def judge(labeller: Labeller, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """(label, its mean probability) of each text; und and 0 where no word has a letter."""
    labels = labeller.model.labels
    sums, count, known = np.zeros((len(texts), len(labels))), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
    for i, words, prob in labeller.texts(texts):
        sums[i] += prob.sum(axis=0, dtype=np.float64) if len(prob) else 0
        count[i] += len(words)
        known[i] = known[i] or has_letter(words)
    if not labels:
        return ["und"] * len(texts), np.zeros(len(texts))
    mean = sums / np.maximum(1, count)[:, None]
    best = mean.argmax(axis=1)
    names = [labels[b] if k else "und" for b, k in zip(best, known, strict=True)]
    return names, np.clip(np.where(known, mean[np.arange(len(best)), best], 0.0), 0, 1)


def segments(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, segment, start, end, lang, score): the runs of words of one most likely label, in every text.

    start and end are code points of the text, end exclusive; score is the run's mean probability. A text without words, or
    null, has no row. Repeated rows have theirs each. Runs are those of whole texts, however long.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        labeller = Labeller(held.value)
        names = ["doc_id", "segment", "start", "end", "lang", "score"]
        for b in bounded(batches, 1, LONG):
            texts, ids = b.column(1).to_pylist(), b.column(0)
            spots = {}  # where the words of each text are, as far as they were labelled
            found: dict[int, list] = {}
            for i, words, prob in labeller.texts(texts):
                if i not in spots:
                    spots[i], found[i] = WORD.finditer(plain(texts[i])), []
                best = prob.argmax(axis=1) if len(prob) else ()
                for m, label, p in zip(islice(spots[i], len(words)), best, prob, strict=False):
                    last = found[i][-1] if found[i] else None
                    if last and last[2] == label:
                        last[1], last[3], last[4] = m.end(), last[3] + float(p[label]), last[4] + 1
                    else:
                        found[i].append([m.start(), m.end(), int(label), float(p[label]), 1])
            rows = [(i, k, *r) for i, rs in found.items() for k, r in enumerate(rs)]
            at = pa.array([r[0] for r in rows], pa.int64())
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3)]
            lang = pa.array([held.value.labels[r[4]] for r in rows], pa.string())
            score = pa.array([min(1.0, r[5] / r[6]) for r in rows], pa.float64())
            yield pa.RecordBatch.from_arrays([ids.take(at), *cols, lang, score], names=names)

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, segment long, start long, end long, lang string, score double")


def train(docs: DataFrame, per_lang: int = 120, most_docs: int = 24_000, most_chars: int = 60_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit to at most `per_lang` documents of each language, from rows whose crc32 of the id isn't 0 mod 5.

    The driver holds the sample: with over most_docs / per_lang languages each has fewer documents, one at least, and
    texts of over `most_chars` are left out. A language that has longer ones alone is learned from its shortest text.
    """
    text = F.col(text_col).cast("string")
    may = docs.where(F.col(lang_col).isNotNull() & text.isNotNull() & (crc32_of_id(id_col) % 5 != 0))
    may = may.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text).alias("hash"), text.alias("text"))
    rows = may.select("id", "lang", "hash", F.when(F.length("text") > most_chars, F.length("text")).otherwise(0).alias("over"))
    langs = rows.select("lang").distinct().count()
    if not langs:
        return fit([])
    each = max(1, min(per_lang, most_docs // langs))
    order = Window.partitionBy("lang").orderBy("over", F.xxhash64("id", F.lit("sample")), "id", "hash")
    chosen = rows.withColumn("nth", F.row_number().over(order)).where((F.col("nth") <= each) & ((F.col("over") == 0) | (F.col("nth") == 1)))
    sample = may.join(F.broadcast(chosen.select("id", "lang", "hash").distinct()), ["id", "lang", "hash"]).dropDuplicates(["id", "lang", "hash"])
    return fit([(r.lang, r.text) for r in sample.orderBy("id", "lang", "hash").select("lang", "text").collect()])


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score added to each row. Only the text decides.

    A null text, or one without a letter, is `und` with score 0. Very long texts are labelled whole.
    Columns of docs that bear these names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by BUCKETS, the lexicon and the labels

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(held.value)
        for texts in parts:
            names, score = judge(labeller, texts.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": score})
        labeller = texts = None
        give_back()

    out = docs.withColumn("__lang", judged(F.col(text_col).cast("string")))
    return out.withColumn("lang_pred", F.col("__lang.lang_pred")).withColumn("score", F.col("__lang.score")).drop("__lang")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row, by a model trained on the rows that aren't held out.

    held_out: crc32 of the id's text is 0 mod 5; false for a null id. Repeated rows get a row each. Without a
    usable training row every text is `und`. An empty table gives an empty result.
    """
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(crc32_of_id(id_col) % 5 == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return predict(rows, model).drop("text")


def keep_identified(docs: DataFrame, least: float = 0.4, text_col: str = "text") -> DataFrame:
    """docs whose language is found, with a mean probability of `least` or more; columns as they were.

    Only texts pass through Python, and two 64-bit hashes of those that go come back; null texts go too.
    """
    text = F.col(text_col).cast("string")
    hashes = [F.xxhash64(text, F.lit(k)).alias(f"__h{k}") for k in (1, 2)]
    some = docs.where(text.isNotNull())
    judged = predict(some.select(*hashes, text.alias("__text")), train(docs, text_col=text_col), "__text")
    with smaller_batches(docs.sparkSession):
        gone = stored(judged.where((F.col("lang_pred") == "und") | (F.col("score") < least)).select("__h1", "__h2").distinct(), "rejected")
    rows = some.select(F.struct("*").alias("__row"), *hashes)
    return rows.join(broadcast_if_small(gone), ["__h1", "__h2"], "left_anti").select("__row.*")
