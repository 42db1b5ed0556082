from array import array

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import wavelet as w
from plumbline.llm.shared import shared_folder


@pytest.mark.parametrize(("n", "most"), [(0, 5), (1, 1), (3000, 7), (1200, 40_000), (900, 70_000)])
def test_matrix(n, most):
    ids = np.random.default_rng(n).integers(0, most, n).astype(np.uint32)
    matrix = w.Shard(w.to_bytes([7], [n], ids)).tokens
    assert (matrix.decode() == ids).all()
    for i in range(0, n, max(1, n // 40)):
        v = int(ids[i])
        assert matrix.access(i) == v
        assert matrix.rank(v, i) == (ids[:i] == v).sum()
        assert matrix.select(v, matrix.rank(v, i)) == i
        assert matrix.places(v) == np.flatnonzero(ids == v).tolist()
    assert matrix.count(99_999) == 0
    with pytest.raises(IndexError):
        matrix.select(99_999, 0)


def test_not_a_shard():
    with pytest.raises(ValueError):
        w.Shard(b"something else")


def test_files(spark, odd):
    docs, rows = odd
    folder = shared_folder(spark, "shards")
    assert w.write(docs, folder, shard_bytes=40_000).count() > 1
    out = w.read(spark, folder).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for d, text in order:
        ids = array("I", [*t.encode(text or "", add_special_tokens=False).ids, 1])
        want.append((d, at, len(ids), ids.tobytes()))
        at += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in out), key=lambda r: r[1]) == want


def test_empty_table(none):
    assert w.token_shards(none).count() == 0
