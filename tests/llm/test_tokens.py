import random
from zlib import crc32

import numpy as np
import pytest

from strandset.llm.id_planes import pack_ids, read_ids, stored_ids, unpack_ids, write_ids
from strandset.llm.packing import best_fit_decreasing, cut_at_powers, pack
from strandset.llm.token_counts import length_table, token_counts
from strandset.llm.tokens import tokenizer_path

ODD = [
    None, "", "  \n\t ", "a\x0bb\x0cc\rd\te", "f\x1cg \x1fh\x85i", "j ́k ΣΑΣ İ ﬁ", "<|endoftext|>x <|startoftext|> <|end oftext|>",
    "It's we'll 12,345 中文 \U0001f600!!", "x" * 5000, "word " * 9000, "same text", "same text",
]


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "clash", i * 2) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, start long")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def whole(spark, sf, tokenizer):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()] + ODD
    return texts, [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_counts_equal_library(spark, whole):
    texts, ids = whole
    got = {r.doc_id: r for r in token_counts(rows(spark, texts)).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == [len(x) for x in ids]
    assert all(got[i].n_bytes == len((t or "").encode()) and got[i].over_limit == (len(ids[i]) > 2048) for i, t in enumerate(texts))


def test_frequent_table_holds_frequent_pieces(spark):
    table = length_table(rows(spark, ["the cat the dog"] * 5), "text", tokenizer_path("word_bpe_49k.json"))
    assert table == {b"the": 1, b"cat": 1, b"dog": 1}


def test_packing_covers_each_id_once(spark, whole):
    texts, ids = whole
    pieces = pack(rows(spark, texts), ids=True).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
        assert p.ids_crc32 == crc32(p.ids) and p.length * 4 == len(p.ids) > 0
    for i, want in enumerate(ids):
        own = sorted(by_doc[i], key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in own) == np.array(want + [2], "<u4").tobytes()
        assert all(p.doc_tokens == len(want) + 1 for p in own)
    used = padded = 0
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
        used, padded = used + at, padded + (at if at & (at - 1) == 0 else 4096)
    assert used / padded > 0.97


def test_best_fit_against_brute_force():
    r = random.Random(5)
    for _ in range(50):
        lengths = [r.randint(1, 64) for _ in range(r.randint(0, 60))]
        rooms, want = [], []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [x for x in rooms if x >= lengths[i]]
            room = min(fits, default=64)
            if fits:
                rooms.remove(room)
            rooms.append(room - lengths[i])
            want.append(room - lengths[i])
        got = best_fit_decreasing(lengths, 64)
        assert sorted(i for w in got for i in w) == list(range(len(lengths)))
        assert sorted(64 - sum(lengths[i] for i in w) for w in got) == sorted(rooms)


def test_cut_at_powers():
    cut = cut_at_powers([5, 3, 3])
    assert [sum(n for *_, n in s) for s in cut] == [8, 2, 1]
    assert [x for s in cut for x in s] == [(0, 0, 5), (1, 0, 3), (2, 0, 2), (2, 2, 1)]


@pytest.mark.parametrize("kind", [0, 1])
def test_planes_round_trip(kind):
    r = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (7, 2**32), (200_000, 50_000), (65_536, 3)):
        ids = r.integers(0, top, n, dtype=np.uint32)
        assert (unpack_ids(pack_ids(ids, kind=kind)) == ids).all()


def test_stored_ids(spark, whole):
    texts, ids = whole
    got = stored_ids(rows(spark, texts)).orderBy("doc_id").collect()
    at = 0
    for row, want in zip(got, ids, strict=True):
        data = np.array(want + [1], "<u4").tobytes()
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(want) + 1, crc32(data))
        at += len(want) + 1


def test_files_are_in_order(spark, whole, tmp_path):
    write_ids(rows(spark, whole[0]).orderBy("text"), str(tmp_path / "x"))
    chunks = spark.read.parquet(str(tmp_path / "x")).orderBy("shard", "chunk").collect()
    assert [i for c in chunks for i in c.doc_ids] == list(range(len(whole[0])))
    assert read_ids(spark, str(tmp_path / "x"), ids=True).count() == len(whole[0])


def test_empty_and_null_keys(spark):
    none = rows(spark, [])
    assert token_counts(none).count() == pack(none).count() == stored_ids(none).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, None), (1, "a")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in token_counts(odd).collect()) == [0, 1, 2]
    assert {r.doc_tokens for r in pack(odd).collect()} == {1, 2, 3}
    assert sorted((r.start, r.n_tokens) for r in stored_ids(odd).collect())[-1] == (4, 2)


def test_slices_give_what_the_whole_gives(tokenizer):
    import pyarrow as pa

    from strandset.llm.near_dup import shingle_sets
    from strandset.llm.tokens import encoder, text_slices

    texts = [" ".join(f"W{i * j % 97}é" for i in range(5 + j)) for j in range(200)] + [None, ""]
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    column, own, whole = pa.array(texts), encoder(tokenizer_path("word_bpe_49k.json")), []
    sets = []
    for _, part in text_slices(column, 3000):
        ids, ends = own.ids(part)
        whole += [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
        sets += [s.tolist() for s in shingle_sets(part)]
    assert whole == want
    assert sets == [s.tolist() for s in shingle_sets(column)]
