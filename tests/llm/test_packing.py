import random
import zlib

import numpy as np
import pytest
from helpers import AWKWARD, LONG, documents, write_tables

from emberline.llm import packing as P


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TEXTS = [None, "", " ", "a", "Hello world", "double  space", "tail ", "\n\nlines\n and\ttabs", "naïve ≠ ASCII 😀 ünï", "it's they'll 123 4567", "x<|endoftext|>y z", "\x00\x0b nul", "a b  c", LONG[:5000]]


def test_ids_equal_the_library(library):
    ids_of = P.DocumentIds(P.vocabulary_path())
    for text in [*TEXTS, *TEXTS]:
        got = np.frombuffer(ids_of(text or ""), "<u4").tolist()
        assert got == [*library.encode(text or "", add_special_tokens=False).ids, 0], text


def check_packing(rows, texts, library, capacity=2048):
    expected = []
    for i, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or min(len(ids), capacity)
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        expected += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=str) == sorted(expected, key=str)
    check_sequences(rows, capacity)


def check_sequences(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_query_packs_awkward_and_long_documents(spark, tmp_path, library):
    texts = [(r[0], r[1]) for r in AWKWARD] + [(100 + k, t) for k, t in enumerate(TEXTS)] + [(200 + k, LONG[: 97 * k]) for k in range(60)]
    sf = write_tables(spark, tmp_path, documents=documents(spark, texts))
    check_packing(P.op5_best_fit_packing(spark, sf).collect(), texts, library)
    assert P.pack_documents(documents(spark, [])).count() == 0


@pytest.mark.parametrize(("kind", "per_task", "worse"), [("mixed", 200, 1.03), ("mixed", 800, 1.02), ("over_half", 200, 1.02)])
def test_rounds_of_the_tree(spark, kind, per_task, worse):
    """Bins that move whole pack a little worse than all pieces in one go; the less so, the more a leaf holds."""
    rng = random.Random(2)
    lengths = [rng.randint(1, 100) if kind == "mixed" else rng.randint(60, 100) for _ in range(3000)]
    pieces = spark.createDataFrame([(k, v) for k, v in enumerate(lengths)], "id long, length long")
    rows = P.pack(pieces, capacity=100, per_task=per_task).collect()
    assert sorted(r.id for r in rows) == list(range(3000))
    n = check_sequences(rows, 100)
    in_one_go = len(P.best_fit(np.array(lengths), 100)[2])
    assert n <= in_one_go * worse


def test_best_fit_offsets():
    bins, offsets, room = P.best_fit(np.array([5, 6, 4, 5, 10]), 10)
    assert sorted(room.tolist()) == [0, 0, 0] and len(set(bins.tolist())) == 3
    assert sorted(zip(bins.tolist(), offsets.tolist())) == sorted(set(zip(bins.tolist(), offsets.tolist())))


def test_bins_go_up_whole_and_little_goes_up(spark, monkeypatch):
    rng = random.Random(4)
    pieces = spark.createDataFrame([(k, rng.randint(1, 60) if k % 4 else rng.randint(60, 100)) for k in range(4000)], "c1 long, length long")
    seen, pack = [], P.packed_node

    def counted(number, last, least, capacity, hand_up, names, length):
        seen.append((number, last, hand_up))
        return pack(number, last, least, capacity, hand_up, names, length)

    monkeypatch.setattr(P, "packed_node", counted)
    rows = P.pack(pieces, capacity=100, per_task=200).withColumnRenamed("c1", "id").collect()
    assert seen == [(0, False, 25), (1, False, 25), (2, True, 25)] and sorted(r.id for r in rows) == list(range(4000))
    in_one_go = len(P.best_fit(np.array([r.length for r in rows]), 100)[2])
    assert check_sequences(rows, 100) <= in_one_go * 1.02
    none = P.packed_node(1, False, 30, 100, 1, ["c0", "c1"], "c1")
    import pyarrow as pa

    table = pa.table({"c0": [1, 2, 3, 4], "c1": [10, 20, 60, 75], "h": [1, 2, 3, 4], "node": [9] * 4, "bin": [5, 5, 6, 7], "offset": [0, 10, 0, 0], "filled": [30, 30, 60, 75]})
    out = none(table).to_pylist()
    assert [(r["c0"], r["offset"], r["filled"], r["done"], r["node"]) for r in sorted(out, key=lambda r: r["c0"])] == [(1, 60, 90, True, 1), (2, 70, 90, True, 1), (3, 0, 90, True, 1), (4, 0, 75, True, 1)]


def test_ids_equal_the_library_on_random_unicode(library):
    rng, ids_of = random.Random(11), P.DocumentIds(P.vocabulary_path())
    planes = [(32, 126), (9, 13), (160, 591), (880, 1400), (1424, 1791), (2304, 3000), (0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x1F300, 0x1FAFF), (0x300, 0x36F), (0x2000, 0x206F)]
    for _ in range(400):
        text = "".join(chr(rng.randint(*rng.choice(planes[: rng.choice([2, 5, 12])]))) for _ in range(rng.choice([3, 40, 300])))
        assert np.frombuffer(ids_of(text), "<u4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 0], text
