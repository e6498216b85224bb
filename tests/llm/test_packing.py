import random

import numpy as np
import pytest

from graniteseek.llm.packing import best_fit_decreasing, pack_documents, unpack, write_packed
from graniteseek.llm.tokenizer import encode, encoding, read_vocabulary


def naive(lengths, length):
    rows = []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [(length - sum(lengths[j] for j in r), i) for i, r in enumerate(rows) if length - sum(lengths[j] for j in r) >= lengths[k]]
        if fits:
            free = min(f for f, _ in fits)
            rows[max(i for f, i in fits if f == free)].append(k)
        else:
            rows.append([k])
    return rows


@pytest.mark.parametrize("seed", range(12))
def test_the_tree_finds_the_tightest_fit(seed):
    rng = random.Random(seed)
    length = rng.choice([1, 2, 7, 64, 100])
    lengths = [rng.randint(1, length) for _ in range(rng.randint(0, 150))]
    rows = best_fit_decreasing(lengths, length)
    assert sorted(k for r in rows for k in r) == list(range(len(lengths)))
    assert all(sum(lengths[k] for k in r) <= length for r in rows)
    assert len(rows) == len(naive(lengths, length))


@pytest.mark.parametrize("block_tokens", [1 << 20, 150])
def test_round_trip(spark, docs_of, tmp_path, block_tokens):
    rng = random.Random(6)
    texts = [None, "", " ", "Ünïcode — 日本語 🎉", "word " * 900] + ["".join(rng.choices("abc de\n,.é", k=rng.randint(1, 400))) for _ in range(60)]
    packed = pack_documents(docs_of(texts, clashing=True).repartition(3), length=64, block_tokens=block_tokens)
    path = str(tmp_path / "packed")
    write_packed(packed, path)
    rows = spark.read.parquet(path)
    got = unpack(rows)
    assert got == {k: t for k, t in enumerate(texts) if t}
    for r in rows.collect():
        ids = np.frombuffer(r.input_ids, "<u2")
        assert len(ids) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 64
        assert r.position_resets == r.cu_seqlens[:-1] and len(r.doc_ids) == len(r.token_starts) == len(r.position_resets)
        assert (ids[r.n_tokens :] == 50256).all() and (ids[: r.n_tokens] < 50256).all()
    assert rows.select("shard", "block", "row").distinct().count() == rows.count()


def test_empty_table(spark, docs_of):
    assert pack_documents(docs_of(["a"]).limit(0)).count() == 0


@pytest.mark.parametrize("run", [" ", "\n", "a", "7", "漢", "　", " \n\t"])
def test_runs_of_any_length(spark, docs_of, run):
    texts = ["x" + run * 1_200_000 + "end", run * 400_000, "normal words here"]
    got = unpack(pack_documents(docs_of(texts)))
    assert [got[k] for k in range(3)] == texts


@pytest.mark.parametrize("seed", range(10))
def test_long_blanks_give_the_ids_of_the_whole(seed):
    coder, rng = encoding(read_vocabulary()), random.Random(seed)
    parts = [rng.choice(["word", "!", "12", "é", "'s", "\x85"]) + rng.choice([" ", "\n", "\t", " ", "　"]) * rng.choice([0, 1, 3, 9_999, 10_000, 25_000]) for _ in range(8)]
    text = rng.choice(["", " " * 12_000]) + "".join(parts)
    assert encode(coder, text) == coder.encode_ordinary(text)


def test_repeated_rows_null_ids_and_very_long_texts(spark, docs_of):
    texts = ["same text here"] * 5 + ["w0 " * 300_000, None]
    rows = pack_documents(docs_of(texts, ids=[1, 1, 2, None, None, 3, 4], clashing=True)).collect()
    whose = [d for r in rows for d in r.doc_ids]
    assert whose.count(1) == 2 and whose.count(2) == 1 and whose.count(None) == 2 and 4 not in whose
    assert sum(r.n_tokens for r in rows) > 300_000 and max(r.n_tokens for r in rows) <= 2048
