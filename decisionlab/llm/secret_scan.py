"""Secrets in texts, by patterns and by randomness tests, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decisionlab.session import cut_lineage

# The base patterns. Runs of hex digits and of key characters are matched at once
# with the least length of a hit, which finds the same runs as matching first and dropping
# short ones; an assignment uses up its text even if its value is too short.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
# ASCII letters in either case, the same for every regex engine.
EITHER_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in k) for k in KEYWORDS)
ASSIGN = rf"""({EITHER_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

# Runs that are tested for randomness, and the alphabets their encoding may have.
SYMBOLS = "A-Za-z0-9+/_-"
LEAST = 24
DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {
    "hex": DIGITS + "abcdef",
    "base32": LOWER.upper() + "234567",
    "base36": DIGITS + LOWER,
    "base64": LOWER.upper() + LOWER + DIGITS + "+/",
}
# What counts as ordinary: symbols that coincide this share more often than uniform ones, runs
# this share more or fewer than expected, neighbours correlated this much.
EXCESS, RUNS, CORRELATION = 1.0, 0.6, 0.6
# Steps of the p values, so that their counts are a small table at any size of the corpus.
LEVELS = 10_000
BLOCK = 512

SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"
CANDIDATES = "array<struct<start:bigint,end:bigint,stratum:string,level:int>>"


def running(parts: Column) -> Column:
    """Start and end of each of an array's (gap, length) parts, laid one after the other."""

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + part["gap"]
        end = start + part["length"]
        place = F.struct(start.alias("start"), end.alias("end"), part["match"].alias("match"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(place)).alias("out"))

    def places(block: Column, at: Column) -> Column:
        empty = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
        first = F.struct(at.cast("long").alias("at"), empty.alias("out"))
        return F.aggregate(block, first, step, lambda s: s["out"])

    # In blocks, so that the growing arrays stay short.
    count = F.ceil(F.size(parts) / BLOCK).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), count - 1), lambda b: F.slice(parts, b * BLOCK + 1, F.lit(BLOCK))
    )
    sizes = F.transform(blocks, lambda block: F.aggregate(
        block, F.lit(0).cast("long"), lambda n, x: n + x["gap"] + x["length"]
    ))
    starts = F.aggregate(
        sizes,
        F.array(F.lit(0).cast("long")),
        lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)),
    )
    return F.flatten(F.transform(
        F.arrays_zip(blocks.alias("block"), F.slice(starts, F.lit(1), F.size(blocks)).alias("at")),
        lambda x: places(x["block"], x["at"]),
    ))


def matches(text: Column, found: Column, pattern: str) -> Column:
    """Places (code points, end exclusive) of the pattern's matches; `found` holds their texts."""
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    parts = F.zip_with(gaps, found, lambda gap, match: F.struct(
        F.length(gap).cast("long").alias("gap"), F.length(match).cast("long").alias("length"),
        match.alias("match"),
    ))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    return F.when(F.size(found) > 0, running(parts)).otherwise(empty)


def spans_of(text: Column, found: Column, pattern: str, kind: str) -> Column:
    places = matches(text, found, pattern)
    if kind == "assign":
        value = lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2))
        places = F.filter(places, lambda x: value(x) >= ASSIGN_VALUE)
    return F.transform(places, lambda x: F.struct(
        x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"),
        x["end"].alias("end"), F.lit(kind).alias("kind"),
    ))


def normal(z: Column) -> Column:
    """The normal distribution function, to about 1e-4."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * F.pow(z, 3))))


def encoding(run: Column) -> Column:
    """Which alphabet a run is written in; null for words, numbers and paths of one case."""
    has = lambda chars: run.rlike(f"[{chars}]")
    only = lambda chars: run.rlike(f"^[{chars}]+$")
    return (
        F.when((only("0-9a-f") | only("0-9A-F")) & has("0-9") & has("A-Fa-f"), "hex")
        .when(only("A-Z2-7") & has("2-7") & has("A-Z"), "base32")
        .when(only("0-9a-z") & has("0-9") & has("a-z"), "base36")
        .when(has("A-Z") & has("a-z") & has("0-9"), "base64")
    )


def not_random(run: Column, alphabet: str) -> Column:
    """p value of the claim that a run is ordinary: the largest of three, so all must fall.

    Each test asks how far the run stays below a stated departure from randomness, in standard
    deviations that shrink with its length: coincidences of symbols (chi-squared against
    the uniform alphabet), runs above and below the middle of the alphabet, and the correlation
    of neighbours.
    """
    n = F.length(run).cast("double")
    size = len(alphabet)
    chars = F.array(*[F.lit(c) for c in alphabet])
    counts = F.transform(chars, lambda c: n - F.length(F.replace(run, c, F.lit(""))))
    squares = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c)
    chi = squares * size / n - n
    p_chi = normal((chi - (size - 1) - n * EXCESS) / F.sqrt(2 * (size - 1) + 4 * n * EXCESS))

    middle = size // 2
    sides = F.translate(run, alphabet, "0" * middle + "1" * (size - middle))
    low = n - F.length(F.replace(sides, F.lit("0"), F.lit("")))
    high = n - low
    seen = F.length(F.regexp_replace(F.regexp_replace(sides, "0+", "0"), "1+", "1"))
    mean = 2 * low * high / n + 1
    spread = F.sqrt((mean - 1) * (mean - 2) / (n - 1))
    p_runs = F.when(spread > 0, normal((F.abs(seen - mean) - RUNS * mean) / spread)).otherwise(1.0)

    values = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    middle_value = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / n
    off = F.transform(values, lambda v: v - middle_value)
    steps = F.zip_with(
        F.slice(off, F.lit(1), F.size(off) - 1), F.slice(off, F.lit(2), F.size(off) - 1), lambda a, b: a * b
    )
    var = F.aggregate(off, F.lit(0.0), lambda s, v: s + v * v)
    r = F.aggregate(steps, F.lit(0.0), lambda s, v: s + v) / var
    p_serial = F.when(var > 0, normal((F.abs(r) - CORRELATION) * F.sqrt(n))).otherwise(1.0)
    return F.greatest(p_chi, p_runs, p_serial)


def candidates_of(text: Column, found: Column, pattern: str) -> Column:
    """Runs in some encoding with their place, stratum (encoding and length) and p level."""

    def test(x: Column) -> Column:
        run, kind = x["match"], encoding(x["match"])
        plain = {
            "hex": F.lower(run), "base32": run, "base36": run, "base64": F.translate(run, "-_", "+/")
        }
        p = F.lit(1.0)
        for name, alphabet in ALPHABETS.items():
            p = F.when(kind == name, not_random(plain[name], alphabet)).otherwise(p)
        octave = F.floor(F.log2(F.length(run).cast("double"))).cast("string")
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"),
            F.concat(kind, F.lit(":"), octave).alias("stratum"),
            F.ceil(p * LEVELS).cast("int").alias("level"),
        )

    tested = F.transform(matches(text, found, pattern), test)
    return F.filter(tested, lambda x: x["stratum"].isNotNull())


def cutoffs(scanned: DataFrame, rate: float) -> dict[str, int]:
    """The largest level of each stratum that keeps its expected share of false finds at `rate`.

    Benjamini and Hochberg's rule within each encoding and doubling of the length, over the runs
    of all documents. Levels are counted map-side; what comes back is a row per stratum.
    """
    runs = scanned.select(F.explode("candidates").alias("run")).select("run.*")
    counts = runs.groupBy("stratum", "level").agg(F.count("*").alias("n"))
    up_to = Window.partitionBy("stratum").orderBy("level")
    ranks = counts.withColumn("rank", F.sum("n").over(up_to)).withColumn(
        "total", F.sum("n").over(Window.partitionBy("stratum"))
    )
    kept = ranks.filter(F.col("level") / LEVELS <= rate * F.col("rank") / F.col("total"))
    best = kept.groupBy("stratum").agg(F.max("level").alias("level"))
    return {r["stratum"]: r["level"] for r in best.collect()}


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", *, rate: float = 0.01,
    keep: tuple[str, ...] = (), name: str = "spans",
) -> DataFrame:
    """Spans of secrets in every whole text: one row per row of `docs`.

    Returns `key`, the columns named in `keep`, and `name`, an array of (start, rank, end, kind)
    sorted by start and then kind, in code points with the end exclusive. Kinds `assign`,
    `access` and `hex` are the base patterns. Kind `random` is a run of at least 24 letters,
    digits and +/_- in the alphabet of some encoding that the randomness tests tell
    from ordinary text, at a false-discovery rate of `rate` among runs of its encoding and
    length; runs that overlap a base span are left out. A null text is an empty one, without spans.
    Null keys, repeated keys and repeated rows are scanned row by row. No documents: no rows.
    The texts are scanned once; what was found is written, and the second pass reads that.
    """
    long_run = rf"(?<![{SYMBOLS}])[{SYMBOLS}]{{{LEAST},}}"
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": long_run}
    rows = docs.select(
        F.struct(F.col(key).alias("key"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]).alias("row"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    found = rows.select("row", "text", *[
        F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(kind) for kind, p in patterns.items()
    ])
    words = F.col("text")
    base = F.concat(*[spans_of(words, F.col(k), patterns[k], k) for k in KINDS[:3]])
    scanned = cut_lineage(found.select(
        "row",
        base.cast(SPANS).alias("base"),
        candidates_of(words, F.col("random"), long_run).cast(CANDIDATES).alias("candidates"),
    ))
    limits = cutoffs(scanned, rate)
    if limits:
        limit = F.create_map(*[F.lit(x) for item in limits.items() for x in item])
        hits = F.filter("candidates", lambda x: x["level"] <= F.try_element_at(limit, x["stratum"]))
    else:
        hits = F.filter("candidates", lambda x: F.lit(False))
    clear = F.filter(hits, lambda x: ~F.exists(
        "base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])
    ))
    random = F.transform(clear, lambda x: F.struct(
        x["start"].alias("start"), F.lit(KINDS.index("random")).alias("rank"),
        x["end"].alias("end"), F.lit("random").alias("kind"),
    ))
    spans = F.array_sort(F.concat("base", random.cast(SPANS)))
    # A step of its own: names that the caller chose must not stand beside those used above.
    return scanned.withColumn("all_spans", spans).select(
        F.col("row.key").alias(key),
        *[F.col(f"row.k{i}").alias(c) for i, c in enumerate(keep)],
        F.col("all_spans").alias(name),
    )


def listed(spans: Column) -> Column:
    """`kind:start:end` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string")
    )), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover replaced by one `mark`."""
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        before = F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        more = F.when(x["start"] < s["at"], F.array().cast("array<string>")).otherwise(
            F.array(before, F.lit(mark))
        )
        end = F.greatest(s["at"], x["end"])
        return F.struct(end.alias("at"), F.concat(s["out"], more).alias("out"))

    def finish(s: Column) -> Column:
        rest = F.substring(text, (s["at"] + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(s["out"], ""), rest)

    return F.when(F.size(spans) > 0, F.aggregate(spans, state, step, finish)).otherwise(text)
