"""Toxic spans and document scores by a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisionlab.llm.bitmap import BITS, bitmap, holds, marked, places_of
from decisionlab.llm.labelled import Adam, Sample, known_labels, sigmoid
from decisionlab.llm.text import Slices, chunks, lower_ascii, mix, utf8, words
from decisionlab.session import cut_lineage, drop_folder, new_dir, small_batches

CHUNK = 1 << 20
# Characters of the sample that one step of the fit holds at once.
FIT_PART = 1 << 20
FEATURE_BITS = 20
# Bounds of the training sample: documents of each label, and their longest text.
PER_CLASS, LONGEST = 2_000, 20_000
STEPS = 30
DECAY = 0.05
# Log-odds of the likeliest token beyond which a document counts as certain.
CERTAIN = 4.0
# Bytes of a word's beginnings that are features of their own; the ending has four.
BEGINNINGS = (4, 5, 6, 7, 8)
LINK = 64
# Words and beginnings of words are evidence of their own, counted over all labelled documents: one is
# toxic if the lower bound (so many deviations) of the share of toxic documents among those that
# hold it is over one half, and enough toxic documents hold it. What passes TAGGED tags the tokens that the field
# learns from; what passes SURE is an input of the field, too, and tells it of words that its sample lacks.
TAGGED, SURE = (2.0, 5), (3.0, 25)
LEAST = TAGGED[1]
KINDS = 1 + len(BEGINNINGS)
CELLS = KINDS << FEATURE_BITS
# Weights: one a bucket, and two a kind for whether the token's bucket of that kind is toxic.
SIZE = (1 << FEATURE_BITS) + 2 * KINDS
# Bits in a block of a collected bitmap.
BITMAP = 32768
# Words of a shingle by which copies of a document are told, and the marks they are told by.
SHINGLE = 5
MARKS = ["mark0", "mark1", "mark2"]


@dataclass
class Model:
    """Weights of hashed token features, transitions from tag to tag, the document score, and a bitmap of the
    words and beginnings that are surely toxic by all labelled documents."""

    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray
    document: np.ndarray
    usable: bool = True
    sure: np.ndarray | None = None


def features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Hashes of a token's features: word, its beginnings, its ending, both neighbours."""
    data = lower_ascii(data)
    start, end, before = words(data, ends)
    slices = Slices(data)
    word = slices.hash(start, end)
    first = np.zeros(len(start) + 1, bool)
    first[before[:-1]] = True
    first = first[: len(start)]
    last = np.append(first[1:], True) if len(first) else first
    left, right = np.roll(word, 1), np.roll(word, -1)
    left[first], right[last] = 0, 0
    kinds = [
        word,
        *[slices.hash(start, np.minimum(end, start + n)) for n in BEGINNINGS],
        slices.hash(np.maximum(start, end - 4), end),
        left,
        right,
    ]
    return np.stack([mix(h + np.uint64(i + 1)) for i, h in enumerate(kinds)]), before, (start, end, first)


def buckets_of(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)


def chain(model: Model, scores: np.ndarray, first: np.ndarray, expected: bool = False):
    """Marginal probability of tag 1 for every token, by the forward-backward algorithm.

    `scores` are the tokens' log-odds; `first` marks where documents begin. All documents form
    one chain whose links at beginnings forget what came before. Links are multiplied in
    blocks of 64 side by side, so the loops are as long as a block and the number of blocks.
    With `expected`, also the expected counts of moves and of first tags.
    """
    n = len(scores)
    count = -(-n // LINK)
    one = sigmoid(scores)
    emit = np.stack([1 - one, one], 1)
    moves = np.exp(model.moves)
    link = moves[None] * emit[:, None, :]
    link[first] = (np.exp(model.start) * emit[first])[:, None, :]
    link /= link.sum(axis=(1, 2), keepdims=True)
    link = np.concatenate([link, np.broadcast_to(np.eye(2), (count * LINK - n, 2, 2))])
    link = link.reshape(count, LINK, 2, 2)

    product = link[:, 0].copy()
    for i in range(1, LINK):
        product = product @ link[:, i]
        product /= product.sum(axis=(1, 2), keepdims=True)
    enter, leave = np.empty((count, 2)), np.empty((count, 2))
    a, b = 0.5, 0.5
    flat = product.reshape(count, 4).tolist()
    for i, (p, q, r, s) in enumerate(flat):
        enter[i] = a, b
        a, b = a * p + b * r, a * q + b * s
        a, b = a / (a + b), b / (a + b)
    a, b = 0.5, 0.5
    for i in range(count - 1, -1, -1):
        p, q, r, s = flat[i]
        leave[i] = a, b
        a, b = p * a + q * b, r * a + s * b
        a, b = a / (a + b), b / (a + b)

    ahead = np.empty((count, LINK, 2))
    state = enter
    for i in range(LINK):
        state = np.einsum("bi,bij->bj", state, link[:, i])
        state /= state.sum(axis=1, keepdims=True)
        ahead[:, i] = state
    back = np.empty((count, LINK, 2))
    state = leave
    for i in range(LINK - 1, -1, -1):
        back[:, i] = state
        state = np.einsum("bij,bj->bi", link[:, i], state)
        state /= state.sum(axis=1, keepdims=True)
    both = (ahead * back).reshape(-1, 2)[:n]
    marginal = both[:, 1] / both.sum(axis=1)
    if not expected:
        return marginal
    came = np.concatenate([enter[:, None], ahead[:, :-1]], 1).reshape(-1, 2)[:n]
    pair = came[:, :, None] * link.reshape(-1, 2, 2)[:n] * back.reshape(-1, 2)[:n][:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    starts = np.array([(1 - marginal[first]).sum(), marginal[first].sum()])
    return marginal, pair[~first].sum(axis=0), starts


def document_features(marginal: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Per document: one, log-odds of the likeliest token, log of the expected toxic tokens."""
    full = before[1:] > before[:-1]
    total, most = np.zeros(len(full)), np.full(len(full), 1e-6)
    if full.any():
        sums = np.concatenate([[0.0], np.cumsum(marginal)])
        total = np.maximum(sums[before[1:]] - sums[before[:-1]], 0)
        most[full] = np.maximum.reduceat(marginal, before[:-1][full])
    most = np.clip(most, 1e-9, 1 - 1e-9)
    odds = np.clip(np.log(most / (1 - most)), -CERTAIN, CERTAIN)
    return np.stack([np.ones(len(full)), odds, np.log1p(total)], 1)


def cells(hashed: np.ndarray) -> np.ndarray:
    """Places of the words and beginnings of tokens in a table of fixed size: a row a kind."""
    return buckets_of(hashed[:KINDS]) + (np.arange(KINDS, dtype=np.int32) << FEATURE_BITS)[:, None]


def held(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 > 0


def inputs(places: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Weights that each token adds up: of its buckets, and for whether its word or a beginning is sure.

    `places` are those of its hashed features in a bitmap; buckets are their leading bits.
    """
    known = marked(sure, places[:KINDS])
    rows = (1 << FEATURE_BITS) + 2 * np.arange(KINDS, dtype=np.int32)[:, None] + known
    return np.concatenate([places >> (BITS - FEATURE_BITS), rows.astype(np.int32)])


@dataclass
class Part:
    """Some documents of the sample: small enough that every step of the fit is.

    Of a token only the places of its features are held, four bytes each; a step makes its inputs from them.
    """

    places: np.ndarray
    before: np.ndarray
    first: np.ndarray
    toxic: np.ndarray
    apart: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.toxic)), np.diff(self.before))


def parts_of(sample: Sample) -> list[Part]:
    """The sample's documents in parts."""
    out, start, size = [], 0, 0
    for i, row in enumerate(sample.rows):
        size += len(row["text"] or "")
        if size >= FIT_PART or i + 1 == len(sample.rows):
            texts = pa.array([r["text"] or "" for r in sample.rows[start : i + 1]])
            hashed, before, (_, _, first) = features(*utf8(texts))
            apart = np.array([r["apart"] for r in sample.rows[start : i + 1]], bool)
            out.append(Part(places_of(hashed), before, first, sample.labels[start : i + 1], apart))
            start, size = i + 1, 0
    return out


def with_marks(docs: DataFrame, sieve) -> DataFrame:
    """Documents (`key`, `text`) with their marks: the least hashes of their shingles, by three hashes.

    Those whose key (hashed in `seen`) a broadcast bitmap does not hold are left out before their texts are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if sieve is not None:
                batch = batch.filter(pa.array(holds(sieve.value, batch.column("seen").to_numpy().view(np.uint64))))
            for part in chunks(batch.select(["key", "text"]), "text", CHUNK):
                data, ends = utf8(part.column("text"))
                data = lower_ascii(data)
                start, end, before = words(data, ends)
                hashed = Slices(Slices(data).hash(start, end))
                size = np.diff(before)
                # Of fewer words than a shingle, all of them.
                n = np.maximum(size - SHINGLE + 1, (size > 0).astype(np.int64))
                doc = np.repeat(np.arange(len(size)), n)
                first = before[:-1][doc] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                shingles = hashed.hash(first, np.minimum(first + SHINGLE, before[1:][doc]))
                marks = np.zeros((len(MARKS), len(size)), np.uint64)
                full = n > 0
                for i in range(len(MARKS) if full.any() else 0):
                    shingles = mix(shingles + np.uint64(2 * i + 1))
                    marks[i, full] = np.minimum.reduceat(shingles, (np.cumsum(n) - n)[full])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *[pa.array(m.view(np.int64)) for m in marks]], [*part.schema.names, *MARKS]
                )

    kind = docs.schema["key"].dataType.simpleString()
    marks = ", ".join(f"{m} long" for m in MARKS)
    return docs.withColumn("seen", F.xxhash64("key")).mapInArrow(run, f"key {kind}, text string, {marks}")


def evidence_documents(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """The labelled documents that count as evidence: `key`, `label`, `text`, `apart` and their marks.

    Copies of a toxic document are one piece of evidence, however many there are: of those that share a mark
    one stays, by each mark in turn, so that a copy that misses one mark is likely met by the next. Other
    documents all speak for their words, but for exact copies. `apart` cuts them into halves, each to judge
    what the other teaches. Which documents stay is told by keys and marks alone: a text is shuffled once, when it does.
    """
    known = known_labels(labels, label, key).select(F.col("_key").alias("key"), F.col("_label").cast("int").alias("label"))
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.length("text") > 0)
    # Equal keys of different types have different hashes.
    alike = named.schema["key"].dataType == known.schema["key"].dataType
    texts = with_marks(named, bitmap(known.select(F.xxhash64("key").alias("seen")), "seen") if alike else None)
    names = ["key", "label", *MARKS]
    rows = cut_lineage(texts.drop("text").join(known, "key").select(names))

    def one_each(kept: DataFrame, *marks: str) -> DataFrame:
        rest = [c for c in names if c not in (*marks, "label")]
        one = kept.groupBy(*marks, "label").agg(F.min(F.struct(*rest)).alias("_one"))
        return one.select(*marks, "label", "_one.*").select(names)

    toxic = rows.select(names).filter("label = 1")
    for mark in MARKS:
        toxic = one_each(toxic, mark)
    kept = cut_lineage(toxic.unionByName(one_each(rows.select(names).filter("label = 0"), *MARKS)))
    # Rows that are repeated as a whole are one document.
    left = texts.join(kept, ["key", *MARKS]).dropDuplicates(["key", *MARKS])
    return left.select("key", "label", "text", (F.pmod(MARKS[0], F.lit(2)) == 0).alias("apart"), *MARKS)


def add_documents(n: np.ndarray, places: np.ndarray, doc: np.ndarray) -> None:
    """Add to `n` in how many documents each place occurs, without another table of all places."""
    for row in places:
        met, times = np.unique(np.unique(doc * CELLS + row) % CELLS, return_counts=True)
        n[met] += times.astype(n.dtype)


def often_toxic(rows: DataFrame) -> np.ndarray:
    """A bitmap (768 KB) of the places that enough toxic documents have; a task holds one number a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, np.int32)
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                hashed, before, _ = features(*utf8(part.column("text")))
                add_documents(n, cells(hashed), np.repeat(np.arange(part.num_rows), np.diff(before)))
        met = np.flatnonzero(n)
        for s in range(0, len(met), 1 << 16):
            some = met[s : s + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some], pa.int64())], ["place", "n"])

    met = rows.filter("label = 1").select("text").mapInArrow(run, "place long, n long")
    often = met.groupBy("place").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)
    blocks = often.groupBy(F.floor(F.col("place") / BITMAP).alias("block")).agg(
        F.bitmap_construct_agg(F.col("place") % BITMAP).alias("bits")
    )
    out = np.zeros(CELLS // 8, np.uint8)
    with small_batches(rows.sparkSession):
        found = blocks.collect()
    for block, bits in found:
        out[block * BITMAP // 8 : block * BITMAP // 8 + len(bits)] = np.frombuffer(bits, np.uint8)
    return out


COUNTS = ["toxic", "others", "seen_toxic", "seen_others"]


def counted(rows: DataFrame, wanted: np.ndarray) -> DataFrame:
    """In how many documents each word and beginning occurs whose place is `wanted`: `hash` and `COUNTS`.

    Toxic documents and others, of all and of the half not set apart. Tasks add up their own first.
    """

    def folded(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        if not parts:
            return []
        names, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.concatenate([p[1] for p in parts])
        return [(names, np.stack([np.bincount(where, column) for column in n.T], 1).astype(np.int64))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                hashed, before, _ = features(*utf8(part.column("text")))
                doc = np.repeat(np.arange(part.num_rows), np.diff(before))
                toxic = part.column("label").to_numpy() > 0
                seen = ~part.column("apart").to_numpy(zero_copy_only=False)
                kinds = np.stack([toxic, ~toxic, toxic & seen, ~toxic & seen], 1).astype(np.int64)
                for row, places in zip(hashed[:KINDS], cells(hashed)):
                    use = held(wanted, places)
                    names, where = np.unique(row[use], return_inverse=True)
                    pairs = np.unique(where * part.num_rows + doc[use])
                    whose, n = kinds[pairs % part.num_rows], pairs // part.num_rows
                    parts.append((names, np.stack([np.bincount(n, c, len(names)) for c in whose.T], 1)))
                if len(parts) > 32:
                    parts = folded(parts)
        for names, n in folded(parts):
            for s in range(0, len(names), 1 << 16):
                columns = [pa.array(c[s : s + (1 << 16)]) for c in (names.view(np.int64), *n.T)]
                yield pa.RecordBatch.from_arrays(columns, ["hash", *COUNTS])

    schema = ", ".join(f"{c} long" for c in ("hash", *COUNTS))
    found = rows.select("text", "label", "apart").mapInArrow(run, schema)
    return found.groupBy("hash").agg(*[F.sum(c).alias(c) for c in COUNTS])


@dataclass
class Evidence:
    """Bitmaps (8 MB each) of the words and beginnings that tag tokens, and of those that are sure."""

    tagged: np.ndarray
    sure: np.ndarray


def toxic_words(labelled: DataFrame) -> tuple[Evidence, Evidence, Evidence]:
    """What is toxic by all labelled documents, by the half not set apart, and by the half set apart."""
    found = cut_lineage(counted(labelled, often_toxic(labelled)).filter(F.col("toxic") >= LEAST))
    halves = found.withColumns({f"apart_{c}": F.col(c) - F.col(f"seen_{c}") for c in ("toxic", "others")})

    def passing(kind: str, deviations: float, least: int) -> np.ndarray:
        hits, n = F.col(f"{kind}toxic"), F.col(f"{kind}toxic") + F.col(f"{kind}others")
        p, z = hits / n, deviations**2 / n
        low = (p + z / 2 - F.sqrt(z * (p * (1 - p) + z / 4))) / (1 + z)
        return bitmap(halves.filter((hits >= least) & (low > 0.5)), "hash").value

    return tuple(Evidence(passing(kind, *TAGGED), passing(kind, *SURE)) for kind in ("", "seen_", "apart_"))


def tagged_parts(parts: list[Part], known: Evidence, half: bool | None) -> list[tuple]:
    """Parts, which tokens the field learns from, their tags and beginnings: of the documents of one half, or all."""
    out = []
    for part in parts:
        doc = part.doc
        hit = marked(known.tagged, part.places[:KINDS]).any(axis=0) & (part.toxic[doc] > 0)
        # Toxic documents in which nothing could be tagged say nothing about their tokens.
        told = (part.toxic == 0) | (np.bincount(doc, hit, minlength=len(part.toxic)) > 0)
        if half is not None:
            told &= part.apart == half
        use = told[doc]
        if use.any():
            out.append((part, use, hit[use], part.first[use]))
    return out


def fit_field(model: Model, parts: list[Part], known: Evidence, half: bool | None = None) -> bool:
    """Fit weights and moves to the tagged tokens; False if there is nothing to learn."""
    data = tagged_parts(parts, known, half)
    if not any(y.any() for _, _, y, _ in data):
        return False
    moved, started = np.zeros((2, 2)), np.zeros(2)
    for _, _, y, begins in data:
        pairs = 2 * y[:-1].astype(int) + y[1:].astype(int)
        moved += np.bincount(pairs[~begins[1:]], minlength=4).reshape(2, 2)
        started += np.bincount(y[begins].astype(int), minlength=2)
    values = {"weights": model.weights, "moves": model.moves, "start": model.start}
    adam = Adam(0.3)
    for _ in range(STEPS):
        slope = {
            "weights": DECAY * model.weights,
            "moves": DECAY * model.moves - moved,
            "start": DECAY * model.start - started,
        }
        for part, use, y, begins in data:
            x = inputs(part.places[:, use], known.sure)
            marginal, moves, starts = chain(model, model.weights[x].sum(axis=0), begins, True)
            gap = np.broadcast_to(marginal - y, x.shape)
            slope["weights"] += np.bincount(x.ravel(), gap.ravel(), minlength=SIZE)
            slope["moves"] += moves
            slope["start"] += starts
        adam.step(values, slope)
    return True


def fit(sample: Sample, known: Evidence, halves: tuple[Evidence, Evidence]) -> Model:
    """Fit the field to all documents of the sample, and the document score to all by halves.

    Each half is judged by a field that learned from the other half alone, words included: its marginals are such as
    unseen documents will get.
    """

    def blank(evidence: Evidence) -> Model:
        return Model(np.zeros(SIZE), np.zeros((2, 2)), np.zeros(2), np.zeros(3), sure=evidence.sure)

    model, unusable = blank(known), blank(known)
    unusable.usable = False
    if not sample.usable:
        return unusable
    parts = parts_of(sample)
    if not fit_field(model, parts, known):
        return unusable
    rows, labels = [], []
    for half, evidence in zip((False, True), halves):
        trial = blank(evidence)
        if not fit_field(trial, parts, evidence, half):
            # Too few documents for halves.
            trial = model
        for part in parts:
            scores = trial.weights[inputs(part.places, trial.sure)].sum(axis=0)
            marginal = chain(trial, scores, part.first) if len(scores) else scores
            other = part.apart != half
            rows.append(document_features(marginal, part.before)[other])
            labels.append(part.toxic[other])
    z, y = np.concatenate(rows), np.concatenate(labels)
    adam = Adam(0.1)
    for _ in range(600):
        gap = sigmoid(z @ model.document) - y
        slope = z.T @ gap / len(gap) + 1e-3 * model.document * np.array([0, 1, 1])
        adam.step({"document": model.document}, {"document": slope})
    model.document[0] += sample.prior_shift()
    model.weights = model.weights.astype(np.float32)
    return model


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    *,
    per_class: int = PER_CLASS,
    longest: int = LONGEST,
) -> Model:
    """Learn which words are toxic from all labelled documents, and the field from a sample of them.

    The sample has at most `per_class` documents of each label with up to `longest` characters.
    """
    path = new_dir(docs.sparkSession, "labelled")
    labelled = cut_lineage(evidence_documents(docs, labels, key, text, label), path)
    known, *halves = toxic_words(labelled)
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    short = labelled.filter(F.length("text") <= longest)
    order = [F.xxhash64("key"), F.col("key"), *MARKS]
    # Chosen by keys and marks, so that no task sends the driver texts that another's replace.
    places = short.select("key", "label", *MARKS)
    first, last = (places.filter(F.col("label") == value).orderBy(*order).limit(per_class) for value in (0, 1))
    picked = F.broadcast(first.unionByName(last).drop("label"))
    rows = short.join(picked, ["key", *MARKS]).select("label", "text", "apart", "key", *MARKS).orderBy("label", *order).collect()
    # Their texts are not read again.
    drop_folder(docs.sparkSession, path)
    told = np.array([r["label"] for r in rows], np.float64)
    return fit(Sample(rows, told, (counts.get(0, 0), counts.get(1, 0))), known, tuple(halves))


SPANS = "array<struct<start:bigint,end:bigint,marginal:double>>"


def tag(model: Model, column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Scores of the texts of a column, and their toxic spans in code points."""
    data, ends = utf8(column)
    hashed, before, (start, end, first) = features(data, ends)
    if model.usable and len(first):
        x = inputs(places_of(hashed), model.sure)
        marginal = chain(model, model.weights[x].sum(axis=0, dtype=np.float64), first)
    else:
        marginal = np.zeros(len(first))
    found = sigmoid(document_features(marginal, before) @ model.document)
    tagged = marginal >= 0.5
    runs = np.flatnonzero(tagged & (first | ~np.concatenate([[False], tagged[:-1]])))
    stops = np.flatnonzero(tagged & np.concatenate([first[1:] | ~tagged[1:], [True]]))
    most = np.zeros(0)
    if len(runs):
        bounds = np.stack([runs, stops + 1], 1).ravel()[: 2 * len(runs) - 1]
        most = np.maximum.reduceat(marginal, bounds)[::2]
    # Code points before a byte, counted from the beginning of its text.
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    text = np.searchsorted(before, runs, side="right") - 1
    origin = points[ends[text]]
    spans = pa.StructArray.from_arrays(
        [pa.array(points[start[runs]] - origin, pa.int64()),
         pa.array(points[end[stops]] - origin, pa.int64()), pa.array(most)],
        ["start", "end", "marginal"],
    )
    places = pa.array(np.searchsorted(text, np.arange(len(ends))), pa.int32())
    return found, pa.ListArray.from_arrays(places, spans)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tag every word of every whole text: one row per row of `docs`.

    Returns `key`, `score` (0 to 1) and `spans`: runs of words that are toxic rather than not, as
    (start, end, marginal) in code points with the end exclusive, `marginal` being the largest in
    the run. Null and empty texts, and texts without words, have no spans and the score of a
    document without toxic words. Where the sample had no labels of both kinds, every score
    is one half. Repeated rows and null keys are scored row by row. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                found, spans = tag(model, part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(found), spans], ["key", "score", "spans"]
                )

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, score double, spans {SPANS}").withColumnRenamed("key", key)


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of `docs`, all columns, whose text scores below `threshold`; see `score`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text, CHUNK):
                found, _ = tag(model, part.column(text))
                yield part.filter(pa.array(found < threshold))

    return docs.mapInArrow(run, docs.schema)
