"""Token ids, packing and training order against the tokenizer itself and round trips."""

import glob
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from decisionlab.llm import packing, queries, training_order
from decisionlab.llm.tokens import TokenIds, default_path

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "It's WE'LL they'd 12 345 a_b -- é"), (4, "twice"), (4, "twice"),
    (None, "no key"), (6, "<|endoftext|> inside <|startoftext|>x"), (7, "ΟΔΟΣ é ﬁ Å x y 🙂 中文"),
    (8, "a\x1cb\x85c"), (9, "don't ßÿÀ×÷ª²"), (10, "word " * 30_000), (11, "x" * 20_000), (12, "İstanbul"),
]


@pytest.fixture(scope="module")
def plain():
    return tokenizers.Tokenizer.from_file(default_path())


def ids_of(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in rows]


def test_cached_ids_are_those_of_the_tokenizer(plain, docs):
    encode = TokenIds(default_path()).encode
    for _, text in docs + ODD:
        assert np.frombuffer(encode(text), "<u4").tolist() == ids_of(plain, text)


def test_other_tokenizers_are_used_whole(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, other = TokenIds(path).encode, tokenizers.Tokenizer.from_file(path)
    for _, text in docs[:40]:
        assert np.frombuffer(encode(text), "<u4").tolist() == ids_of(other, text)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_packing(plain, rows, got, capacity=2048, most_padding=None):
    """Every id in one piece, sequences gapless and no longer than the capacity."""
    whole = Counter()
    for key, text in rows:
        ids = [*ids_of(plain, text), 1]
        whole[key, len(ids), crc(ids)] += 1
    texts = defaultdict(list)
    for key, text in rows:
        ids = [*ids_of(plain, text), 1]
        texts[key, len(ids)].append(ids)
    pieces = Counter()
    sequences = defaultdict(list)
    for p in got:
        assert any(crc(ids[p.start : p.start + p.length]) == p.ids_crc32 for ids in texts[p.doc_id, p.doc_tokens])
        pieces[p.doc_id, p.doc_tokens] += p.length
        sequences[p.sequence_id].append((p.offset, p.length))
        if "ids" in p:
            assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
    assert pieces == Counter({k: k[1] * len(v) for k, v in texts.items()})
    padding = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
        padding += 0 if end & (end - 1) == 0 else capacity - end
    if most_padding is not None:
        assert padding <= most_padding * sum(pieces.values())


def test_op4_against_the_tokenizer(spark, plain, docs):
    got = queries.QUERIES["op4_harmonic_packing"](spark, SF).collect()
    check_packing(plain, docs, got, most_padding=0.03)
    assert Counter(r.doc_id for r in got).keys() == {d for d, _ in docs}


def test_packing_edge_cases(spark, plain):
    df = spark.createDataFrame(
        [(i, t, 7, "x") for i, t in ODD], "doc_id long, text string, start int, ids string"
    ).repartition(40)
    for capacity in (2048, 64):
        check_packing(plain, ODD, packing.pack(df, capacity=capacity, classes=8).collect(), capacity)
    assert packing.pack(df.filter("false")).count() == 0


@pytest.mark.parametrize("capacity", [2048, 1000, 7])
def test_cut_pieces_fill_their_class(capacity):
    for n in [*range(1, 3 * capacity + 2)][:: max(1, capacity // 300)]:
        pieces = packing.cut(n, capacity, 64, 0.01)
        assert [p[0] for p in pieces] == [sum(p[1] for p in pieces[:i]) for i in range(len(pieces))]
        assert sum(p[1] for p in pieces) == n
        for _, length, k in pieces:
            assert k == capacity // length and k * length <= capacity < (k + 1) * length


def check_order(spark, plain, rows, index, path, per_record):
    got = index.collect()
    texts = defaultdict(list)
    for key, text in rows:
        texts[key].append([*ids_of(plain, text), 1])
    slots = {r.slot for r in got}
    n = len(slots)
    assert slots == set(range(n))
    read = list(training_order.read_slots(spark, path, 0, n + 5))
    assert len(read) == n and all(0 < len(x) <= per_record for x in read)
    back, held = Counter(), Counter()
    for r in got:
        ids = read[r.slot][r.offset : r.offset + r.length].tolist()
        assert len(ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(ids, "<u2").tobytes())
        assert any(x[r.start : r.start + r.length] == ids for x in texts[r.doc_id])
        back[r.doc_id] += r.length
        held[r.slot] += r.length
    assert back == Counter({k: sum(map(len, v)) for k, v in texts.items()})
    assert held == Counter({i: len(x) for i, x in enumerate(read)})
    middle = n // 3
    again = [x.tolist() for x in training_order.read_slots(spark, path, middle, 9)]
    assert again == [x.tolist() for x in read[middle : middle + 9]]
    return n


def test_op3_round_trip(spark, plain, docs, tmp_path):
    path = f"file://{tmp_path}/order"
    df = spark.read.parquet(f"{SF}/documents.parquet")
    index = training_order.materialise(df, path=path, ids_per_record=128, slots_per_shard=100)
    n = check_order(spark, plain, docs, index, path, 128)
    assert len(glob.glob(f"{tmp_path}/order/shard-*.bin")) == -(-n // 100)
    with open(glob.glob(f"{tmp_path}/order/shard-000000.bin")[0], "rb") as f:
        data = f.read()
    for r in index.filter("shard = 0").collect():
        assert zlib.crc32(data[r.byte_offset : r.byte_offset + 2 * r.length]) == r.ids_crc32
    rows = queries.QUERIES["op3_training_order"](spark, SF)
    names = ["doc_id", "start", "length", "slot", "offset", "shard", "byte_offset", "ids_crc32"]
    assert rows.columns == names and rows.agg({"length": "sum"}).first()[0] == index.agg({"length": "sum"}).first()[0]


def test_training_order_edge_cases(spark, plain, tmp_path):
    df = spark.createDataFrame([(i, t, 3, "x") for i, t in ODD], "doc_id long, text string, slot int, ids string")
    path = f"file://{tmp_path}/order"
    index = training_order.materialise(df, path=path, ids_per_record=50, slots_per_shard=64)
    check_order(spark, plain, ODD, index, path, 50)
    empty = f"file://{tmp_path}/empty"
    assert training_order.materialise(df.filter("false"), path=empty).count() == 0
    assert list(training_order.read_slots(spark, empty, 0, 5)) == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 64, 1000, 4097])
def test_permutation_is_a_keyed_bijection(n):
    order = training_order.Permutation(n, 5)
    index = np.arange(n)
    slots = order.slot(index)
    assert sorted(slots.tolist()) == list(range(n))
    assert (order.index(slots) == index).all()
    if n >= 64:
        assert (training_order.Permutation(n, 6).slot(index) != slots).any()
        assert abs(np.corrcoef(index, slots)[0, 1]) < 0.2
