"""Bounded-space packing against the tokenizers library, and its windows against a plain search."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("bidloom.llm")

from bidloom.llm import online_packing, token_ids  # noqa: E402

BYTE = token_ids.vocabulary_path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start long, part int, ids string"


def padding(lengths, capacity):
    return sum(capacity - n for n in lengths if n & (n - 1))


def frame(spark, texts, parts):
    return spark.createDataFrame([(None if i == 3 else i // 2, t, 1, 2, "x") for i, t in enumerate(texts)], SCHEMA).repartition(parts)


@pytest.mark.parametrize(("parts", "windows", "capacity", "end_id"), [(1, 1, 64, 1), (5, 4, 64, 1), (3, 64, 2048, 1), (7, 3, 100, 1), (2, 2, 64, None)])
def test_every_id_lies_in_one_piece(spark, parts, windows, capacity, end_id):
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(BYTE), random.Random(windows)
    texts = [" ".join(rng.choice(["the", "Zürich", "foo", "日本", "12"]) for _ in range(rng.choice([0, 3, 20, 150]))) for _ in range(60)]
    texts += [None, "", " ", "a<|endoftext|>b", "word " * 3000, texts[0], texts[0]]
    rows = online_packing.pack_online(frame(spark, texts, parts), BYTE, capacity, end_id, windows, with_ids=True).collect()
    sequences = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] > 0 and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"], tuple(ids.tolist())))
    lengths = []
    for pieces in sequences.values():
        at = 0
        for offset, n, _ in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
        lengths.append(at)
    assert sum(n < capacity for n in lengths) == bin(sum(lengths) % capacity).count("1")
    assert padding([n for n in lengths if n < capacity], capacity) == 0
    # Pieces of a document lie one after another; repeated ids are told apart by what they hold.
    want = sorted(tuple(library.encode(t or "", add_special_tokens=False).ids) + (() if end_id is None else (end_id,)) for t in texts)
    found, by_doc = [], defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()))
    for (_, n), pieces in by_doc.items():
        firsts = sorted(p for p in pieces if p[0] == 0)
        rest = sorted(p for p in pieces if p[0] > 0)
        if len(firsts) == 1:
            ids = []
            for start, own in firsts + rest:
                assert start == len(ids)
                ids += own
            assert len(ids) == n
            found.append(tuple(ids))
        else:  # equal ids and lengths: all starts are covered as often
            covered = np.zeros(n, int)
            for start, own in pieces:
                covered[start : start + len(own)] += 1
            assert (covered == len(firsts)).all()
            found += [None] * len(firsts)
    assert len(found) == len([w for w in want if w])
    assert all(f in want for f in found if f is not None)
    whole = online_packing.sequences(online_packing.pack_online(frame(spark, texts, parts), BYTE, capacity, end_id, windows, with_ids=True))
    assert sorted(r["length"] for r in whole.collect()) == sorted(lengths)


def test_windows_are_best_fit():
    """Against looking at every open window; at most ``most`` are open, and emitted ones are full."""
    rng = random.Random(2)
    for most in (1, 3, 8):
        own, rooms, full, last = online_packing.OpenWindows(50, most), {}, 0, 0
        for _ in range(400):
            n = rng.randint(1, 120)
            pieces, at = list(own.place(n)), 0
            for window, offset, start, end in pieces:
                assert start == at
                rest = n - at
                if rest >= 50:
                    assert window == last and (offset, end - start) == (0, 50)
                    last, full, at = last + 1, full + 1, end
                    continue
                fitting = [r for r in rooms.values() if r >= rest]
                if fitting:
                    assert rooms[window] == min(fitting) and end == n
                elif len(rooms) < most:
                    assert window == last and offset == 0
                    rooms[window], last = 50, last + 1
                else:
                    assert rooms[window] == min(rooms.values())
                assert offset == 50 - rooms[window]
                rooms[window] -= end - start
                if not rooms[window]:
                    del rooms[window]
                    full += 1
                assert len(rooms) <= most
                at = end
            assert at == n
        assert sorted(own.left()) == sorted(rooms)


def test_edges(spark):
    assert online_packing.pack_online(spark.createDataFrame([], SCHEMA), BYTE).count() == 0
    one = online_packing.pack_online(spark.createDataFrame([(1, None, 1, 2, "x")], SCHEMA), BYTE).collect()
    assert [tuple(r)[:3] + tuple(r)[4:5] + tuple(r)[6:] for r in one] == [(1, 0, 1, 1, 0)]
    assert online_packing._ends(2048 * 3 + 1027, 2048) == [6144 + 1024, 6144 + 1026, 6144 + 1027]
    assert online_packing._ends(4096, 2048) == []
