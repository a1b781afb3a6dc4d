"""Language of texts by interpolated Kneser-Ney character models, one per language."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decisionlab.llm.labelled import sigmoid
from decisionlab.llm.text import Slices, chunks, mix
from decisionlab.session import cut_lineage

CHUNK = 2 << 20
# Characters of a gram, and bits of one: letters are folded into 4,095 symbols, 0 is a word's edge.
ORDER, BITS = 5, 12
SYMBOLS = (1 << BITS) - 1
# Distinct grams that a counting task holds before it hands them on.
HELD = 1 << 20
# Grams are stored by hash: all languages together have this many places per order.
PLACES = 22
UNKNOWN = "und"
# Lengths of the beginnings of texts that are judged in calibration, too, and the share of them to reject.
BEGINNINGS = (20, 60, 200)
REJECTED = 0.01
# Parts of a nat that entropies are counted in, for the limits.
FINE = 10_000
# What holds the weights of a score: the constant hardly, so that it stays finite where every text is right.
RIDGE = np.array([1e-6, 1e-3, 1e-3])


@cache
def alphabet() -> tuple[np.ndarray, np.ndarray]:
    """Symbol of every code point (0 outside of words), and whether it is a letter."""
    symbols, letters = np.zeros(0x110000, np.uint16), np.zeros(0x110000, bool)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind in "LM":
            symbols[code] = 1 + ord(chr(code).lower()[0]) % SYMBOLS
            letters[code] = kind == "L"
    return symbols, letters


@dataclass
class Words:
    """The distinct words of some texts: where each word of the texts is found among them."""

    word: np.ndarray
    doc: np.ndarray
    grams: np.ndarray
    starts: np.ndarray
    lettered: np.ndarray


def words_of(texts: list[bytes | None], groups: np.ndarray | None = None) -> Words:
    """Words are runs of letters and marks, lower-cased; distinct ones per group of texts.

    `grams` holds, for all distinct words one after the other (they begin at `starts`), the five symbols
    that end at each letter and at the edge behind the word, as one number.
    """
    table, letters = alphabet()
    decoded = [(t or b"").decode("utf-8", "replace") for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in decoded])]).astype(np.int64)
    points = np.frombuffer("".join(decoded).encode("utf-32-le", "replace"), np.uint32)
    symbols = table[points]
    lettered = np.concatenate([[0], np.cumsum(letters[points])])
    inside = np.zeros(len(points) + 2, bool)
    inside[1:-1] = symbols > 0
    begins, finishes = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    cuts = ends[1:-1]
    cuts = cuts[inside[cuts] & inside[cuts + 1]]
    begins[cuts] = finishes[cuts] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(finishes)
    doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, ends)))
    hashes = Slices(symbols).hash(start, end)
    if groups is not None:
        hashes = mix(hashes + groups[doc].astype(np.uint64))
    _, first, word = np.unique(hashes, return_index=True, return_inverse=True)
    size = end[first] - start[first]
    # Every word stands behind four edges and before one.
    room = size + ORDER
    at = np.cumsum(room) - room
    line = np.zeros(int(room.sum()), np.uint64)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    line[np.repeat(at + ORDER - 1, size) + inner] = symbols[np.repeat(start[first], size) + inner]
    keys = np.zeros(len(line), np.uint64)
    for back in range(ORDER):
        keys[back:] |= line[: len(line) - back] << np.uint64(BITS * back)
    real = np.ones(len(line), bool)
    real[(at[:, None] + np.arange(ORDER - 1)).ravel()] = False
    starts = np.cumsum(size + 1) - (size + 1)
    return Words(word, doc, keys[real], starts, np.diff(lettered[ends]) > 0)


def count_grams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """How often every gram occurs in the texts of every language: `lang`, `gram`, `n`.

    Tasks count distinct words first and hand on distinct grams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def folded(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            grams, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return grams, np.bincount(place, np.concatenate([p[1] for p in parts])).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                grams, n = folded(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)],
                    ["lang", "gram", "n"],
                )
            held.clear()

        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                names, group = np.unique(np.array(part.column("lang").to_pylist(), object), return_inverse=True)
                found = words_of(part.column("text").to_pylist(), group)
                n = np.bincount(found.word, minlength=len(found.starts))
                owner = np.zeros(len(n), np.int64)
                owner[found.word] = group[found.doc]
                sizes = np.diff(np.append(found.starts, len(found.grams)))
                times, owner = np.repeat(n, sizes), np.repeat(owner, sizes)
                for i, name in enumerate(names.tolist()):
                    mine = owner == i
                    held.setdefault(name, []).append(folded([(found.grams[mine], times[mine])]))
                    if len(held[name]) > 8:
                        held[name] = [folded(held[name])]
            if sum(len(p[0]) for parts in held.values() for p in parts) > HELD:
                yield from flush()
        yield from flush()

    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("binary").alias("text"))
    counted = rows.mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def gram_tail(gram: str, size: int):
    """The last `size` symbols of a gram."""
    return F.col(gram).bitwiseAND(F.lit((1 << BITS * size) - 1))


def estimates(grams: DataFrame) -> DataFrame:
    """`lang`, `size`, `gram`, `value`: log-probabilities, and log-weights (`size` < 0) of what follows.

    Grams of full size count as often as they occur, shorter ones by the different symbols in front of
    them. Each order takes a discount off its counts, n1 / (n1 + 2 n2) of those seen once and twice in
    the language, and gives what it took to the next shorter order.
    """
    levels = {ORDER: grams.withColumnRenamed("n", "c")}
    for size in range(ORDER - 1, 0, -1):
        tail = gram_tail("gram", size).alias("gram")
        levels[size] = levels[size + 1].select("lang", tail).groupBy("lang", "gram").agg(F.count("*").alias("c"))
    shorter, out = None, None
    for size in range(1, ORDER + 1):
        level = levels[size].withColumn("context", F.shiftright("gram", BITS))
        once, twice = F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
        share = F.when((once > 0) & (twice > 0), once / (once + 2 * twice)).otherwise(0.5)
        discounts = level.groupBy("lang").agg(share.alias("discount"), F.count("*").alias("kinds"))
        # A context is followed by at most 4,096 symbols.
        sums = level.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.count("*").alias("follow"))
        level = level.join(sums, ["lang", "context"]).join(discounts, "lang")
        rest = F.col("discount") * F.col("follow") / F.col("total")
        if size == 1:
            level = level.withColumn("low", 1 / (F.col("kinds") + 1))
        else:
            below = shorter.select("lang", F.col("gram").alias("tail"), F.col("p").alias("low"))
            level = level.withColumn("tail", gram_tail("gram", size - 1)).join(below, ["lang", "tail"])
        level = level.withColumn("p", (F.col("c") - F.col("discount")) / F.col("total") + rest * F.col("low"))
        shorter = cut_lineage(level.select("lang", "gram", "p", "context", rest.alias("rest")))
        rows = shorter.select("lang", F.lit(size).alias("size"), "gram", F.log("p").cast("float").alias("value"))
        weights = shorter.select("lang", F.lit(-size).alias("size"), F.col("context").alias("gram"), F.log("rest").cast("float").alias("value"))
        rows = rows.unionByName(weights.dropDuplicates(["lang", "gram"]))
        out = rows if out is None else out.unionByName(rows)
    return out


def places(grams: np.ndarray, size: int, bits: int) -> np.ndarray:
    apart = mix(np.array([size + 16], np.uint64))
    return (mix(grams + apart) >> np.uint64(64 - bits)).astype(np.uint32)


@dataclass
class Model:
    """Per language and order, the sorted hashes of its grams with their values."""

    languages: list[str]
    bits: int
    arrays: list[dict[int, tuple[np.ndarray, np.ndarray]]]
    floors: list[float]
    score: np.ndarray
    limits: np.ndarray

    def values(self, language: int, size: int, grams: np.ndarray) -> np.ndarray:
        """Values of grams (`size` < 0: of contexts); NaN where there is none."""
        known, values = self.arrays[language].get(size, (np.zeros(0, np.uint32), np.zeros(0, np.float32)))
        if not len(known):
            return np.full(len(grams), np.nan)
        at = places(grams, size, self.bits)
        i = np.minimum(np.searchsorted(known, at), len(known) - 1)
        return np.where(known[i] == at, values[i], np.nan).astype(np.float64)

    def log_probability(self, language: int, grams: np.ndarray) -> np.ndarray:
        """Of the last symbol of each gram after the others: from the longest known one down."""
        out, open_ = np.zeros(len(grams)), np.arange(len(grams))
        for size in range(ORDER, 0, -1):
            some = grams[open_] & np.uint64((1 << BITS * size) - 1)
            found = self.values(language, size, some)
            known = ~np.isnan(found)
            out[open_[known]] += found[known]
            open_, some = open_[~known], some[~known]
            out[open_] += np.nan_to_num(self.values(language, -size, some >> np.uint64(BITS)))
        out[open_] += self.floors[language]
        return out

    def entropies(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per symbol of every text in every language, symbols, whether it has a letter."""
        found = words_of(texts)
        grams, place = np.unique(found.grams, return_inverse=True)
        sizes = np.diff(np.append(found.starts, len(found.grams)))
        n = np.bincount(found.doc, sizes[found.word], minlength=len(texts))
        out = np.zeros((len(texts), len(self.languages)))
        for i in range(len(self.languages)):
            if len(grams):
                word = np.add.reduceat(self.log_probability(i, grams)[place], found.starts)
                out[:, i] = -np.bincount(found.doc, word[found.word], minlength=len(texts)) / np.maximum(n, 1)
        return out, n, found.lettered

    def judge(self, texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
        """Language (-1: none), score, whether it is accepted, and entropy, for every text."""
        if not self.languages:
            none = np.zeros(len(texts))
            return none.astype(int) - 1, none, none > 0, none
        entropy, n, lettered = self.entropies(texts)
        best = entropy.argmin(axis=1)
        least = entropy.min(axis=1)
        score = sigmoid(evidence(entropy, n) @ self.score)
        accepted = lettered & (score >= 0.5) & (least <= self.limits[best])
        return np.where(lettered, best, -1), np.where(lettered, score, 0.0), accepted, least


def evidence(entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One, lead of the best language per symbol, and log of its lead in all."""
    lead = np.ones(len(n))
    if entropy.shape[1] > 1:
        two = np.partition(entropy, 1, axis=1)
        lead = two[:, 1] - two[:, 0]
    return np.stack([np.ones(len(n)), np.minimum(lead, 2.0), np.log1p(np.minimum(lead * n, 1e4))], 1)


def store(grams: DataFrame) -> Model:
    """The estimates as sorted hash arrays.

    Every gram gets one of 2^22 / languages places of its order and kind, the larger value counting where two meet,
    so all arrays together take at most 2 * 5 * 2^22 * 8 bytes, however much was counted.
    """
    found = estimates(grams)
    languages = [r[0] for r in grams.select("lang").distinct().orderBy("lang").collect()]
    bits = PLACES - max(0, len(languages) - 1).bit_length()
    index = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("size").to_numpy()
            gram = batch.column("gram").to_numpy().view(np.uint64)
            place = np.zeros(len(gram), np.int64)
            for s in np.unique(size).tolist():
                place[size == s] = places(gram[size == s], s, bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("size"), pa.array(place), batch.column("value")],
                ["lang", "size", "place", "value"],
            )

    kept = found.mapInArrow(run, "lang string, size int, place long, value float")
    rows = kept.groupBy("lang", "size", "place").agg(F.max("value").alias("value")).toArrow()
    lang = np.array([index[x] for x in rows.column("lang").to_pylist()], np.int64)
    size, place = rows.column("size").to_numpy(), rows.column("place").to_numpy()
    value = rows.column("value").to_numpy()
    order = np.lexsort((place, size, lang))
    lang, size, place, value = lang[order], size[order], place[order].astype(np.uint32), value[order]
    arrays: list[dict] = [{} for _ in languages]
    edges = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (size[1:] != size[:-1])])) if len(lang) else []
    for a, b in zip(edges, [*edges[1:], len(lang)]):
        arrays[lang[a]][int(size[a])] = place[a:b], value[a:b]
    # A symbol the language has never used gets what the shortest grams leave over.
    floors = [-float(np.log(len(a[1][0]) + 1)) if 1 in a else 0.0 for a in arrays]
    return Model(languages, bits, arrays, floors, np.zeros(3), np.full(len(languages), np.inf))


def judged(named: DataFrame, model: Model) -> DataFrame:
    """Every text (`lang`, `text`) with a letter and its beginnings, as the model sees them.

    `lang` is the language's number, `right` whether it has the least entropy, `own` its entropy; `x1` and `x2` are
    the evidence.
    """
    shared = named.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        index = {name: i for i, name in enumerate(model.languages)}
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                texts, told = [], []
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    decoded = text.decode("utf-8", "replace")
                    for some in (text, *[decoded[:n].encode("utf-8", "replace") for n in BEGINNINGS if n < len(decoded)]):
                        texts.append(some)
                        told.append(index[lang])
                entropy, n, use = model.entropies(texts)
                if not texts:
                    continue
                told = np.array(told, np.int32)
                x = evidence(entropy, n)
                right, own = entropy.argmin(axis=1) == told, entropy[np.arange(len(told)), told]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[use]) for c in (told, right, own, x[:, 1], x[:, 2])], ["lang", "right", "own", "x1", "x2"]
                )

    return named.mapInArrow(run, "lang int, right boolean, own double, x1 double, x2 double")


def fit_score(rows: DataFrame) -> np.ndarray:
    """Weights of the logistic regression of `right` on the evidence, over all rows, by Newton's method.

    A step sums up gradient and curvature in one pass. Weights are rounded, so that the order of sums does not matter.
    """
    x: list[Column] = [F.lit(1.0), F.col("x1"), F.col("x2")]
    weights = np.zeros(3)

    def sums(weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        odds = sum(F.lit(float(w)) * c for w, c in zip(weights, x))
        p = 1 / (1 + F.exp(-odds))
        # log(1 + exp(z)) without overflow, for z the odds against what was seen.
        z = F.when(F.col("right"), -odds).otherwise(odds)
        loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        gap = p - F.col("right").cast("double")
        pairs = [(i, j) for i in range(3) for j in range(i, 3)]
        n, total, *rest = rows.agg(
            F.count("*"), F.sum(loss), *[F.sum(gap * c) for c in x], *[F.sum(p * (1 - p) * x[i] * x[j]) for i, j in pairs]
        ).first()
        if not n:
            return 0.0, np.zeros(3), np.eye(3)
        curve = np.zeros((3, 3))
        for (i, j), value in zip(pairs, rest[3:]):
            curve[i, j] = curve[j, i] = value / n
        cost = total / n + float(RIDGE @ weights**2) / 2
        return cost, np.array(rest[:3]) / n + RIDGE * weights, curve + np.diag(RIDGE)

    cost, slope, curve = sums(weights)
    for _ in range(30):
        step = np.linalg.solve(curve, slope)
        # A step that goes too far is halved.
        for _ in range(10):
            tried = sums(weights - step)
            if tried[0] <= cost + 1e-12:
                break
            step = step / 2
        weights = weights - step
        cost, slope, curve = tried
        if np.abs(step).max() < 1e-7:
            break
    return np.round(weights, 6)


def fit_limits(rows: DataFrame, languages: int) -> np.ndarray:
    """Per language the entropy that all but `REJECTED` of its rows stay under, rounded up to 1 / `FINE`.

    Rows are counted by the entropy in these units, so what a language's counts are added up over does not grow with it.
    """
    counts = rows.groupBy("lang", F.floor(F.col("own") * FINE).alias("unit")).agg(F.count("*").alias("n"))
    up_to = Window.partitionBy("lang").orderBy("unit")
    added = counts.withColumn("under", F.sum("n").over(up_to)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    ends = added.filter(F.col("under") >= (1 - REJECTED) * F.col("all")).groupBy("lang").agg(F.min("unit").alias("unit"))
    limits = np.full(languages, np.inf)
    for lang, unit in ends.collect():
        limits[lang] = (unit + 1) / FINE
    return limits


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Models of all languages named in `lang`, from all rows that have one and a text.

    Counts, estimates, scores and limits cover every text; `key` is not read.
    """
    model = store(cut_lineage(count_grams(docs, text, lang)))
    if model.languages:
        named = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
        named = named.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("binary").alias("text"))
        rows = cut_lineage(judged(named, model))
        model.score, model.limits = fit_score(rows), fit_limits(rows, len(model.languages))
    return model


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The language of every whole text: one row per row of `docs`.

    Returns `key`, `lang` (the one with the least cross-entropy per symbol; of equals the first by name;
    `und` for null texts, texts without a letter, and where no language was learned), `score` (0 to 1: how
    likely it is right; 0 for `und`), `accepted` (false where the score is under one half, or the entropy above what
    99 % of the language's texts and their beginnings have: such texts are likely in none of the languages) and `entropy`.
    Other columns are not read; repeated rows and null keys are judged row by row; an empty table gives
    an empty result.
    """
    # Sorted hash arrays of fixed size, see `store`.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                found, score, accepted, least = model.judge(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(names[found], pa.string()), pa.array(score), pa.array(accepted),
                     pa.array(least)], ["key", "lang", "score", "accepted", "entropy"],
                )

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(run, f"key {kind}, lang string, score double, accepted boolean, entropy double")
    return found.select(F.col("key").alias(key), *[F.col(c).alias(c) for c in ("lang", "score", "accepted", "entropy")])
