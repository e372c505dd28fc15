import public_tokenizers
from tokenizers import Tokenizer

from obslab.llm import token_counts as tc


def plain(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(tc.VOCABULARY))
    return len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_counts_equal_the_tokenizer(odd, odd_rows):
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in tc.token_counts(odd).collect())
    want = sorted((i or 0, len((t or "").encode()), n := plain(t), n > 1024) for i, t, *_ in odd_rows)
    assert got == want


def test_many_blocks_and_hot_pretokens(odd, odd_rows):
    rows = tc.token_counts(odd, block_docs=4, hot_docs=2, held=50).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == sorted((r[0] or 0, plain(r[1])) for r in odd_rows)


def test_frequencies_beyond_16_bits():
    import numpy as np

    codes, docs = np.array([1] * 140_000 + [0, 0]), np.array([3] * 140_000 + [2, 2])
    entries, each = tc.to_entries(codes, docs, 2)
    assert each.tolist() == [1, 3] and (entries & 0xFFFF).tolist()[0] == 2 and int((entries[1:] & 0xFFFF).sum()) == 140_000
    assert set((entries[1:] >> 16).tolist()) == {3}


def test_empty_table_and_clashing_columns(none, clashing):
    assert tc.token_counts(none).collect() == []
    assert tc.token_counts(clashing).count() == clashing.count()
