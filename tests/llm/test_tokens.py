import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")

from meridion.llm.bpe import byte_counter, word_ids  # noqa: E402
from meridion.llm.token_counts import count_batch, count_tokens, longest_within, prefix_count  # noqa: E402

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  ", "\n", "\n\n", " \n", "a", "a ", " a", "a  b", "a\n\nb", "a \n b", "don't we'll they're 're'r", "''s", "x" * 300, " " * 150 + "x", "éêü ñ ß", "日本語 テキスト", "😀 👍🏽", "a　b", "  x", "1234 56", "!!'re", "<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>", "<|endof", "foo  <|endoftext|>", "\t\tx\r\n y", "a\x1cb", " x", "zwj‍x", "İI ΣΑΣ ß"]


def texts(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    parts = ["the", "ing", " ", "  ", "\n", "'", "'re", "s", "é", "ö", "12", ".", "***", "日", "😀", "　", "\t", "Hello", "world", "<|endoftext|>", "<|", "aaaa", "_", "-"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(n)]


def test_counts_equal_the_library():
    t = Tokenizer.from_file(BYTES)
    all_texts = ODD + texts(1500, 1)
    got, deltas = count_batch(pa.array(all_texts), BYTES)
    want = [len(t.encode(x, add_special_tokens=False).ids) for x in all_texts]
    assert [x for x, a, b in zip(all_texts, got, want) if a != b] == []
    assert [len(d) for d in deltas] == [len(x.encode()) for x in all_texts]


def test_every_prefix_is_exact():
    t = Tokenizer.from_file(BYTES)
    for x in ODD + texts(400, 2):
        if len(x) > 160:
            x = x[-160:]
        _, (deltas,) = count_batch(pa.array([x]), BYTES)
        for k in range(len(x) + 1):
            p = x[:k]
            assert prefix_count(deltas, len(p.encode())) == len(t.encode(p, add_special_tokens=False).ids), (x, p)


def test_budget():
    t = Tokenizer.from_file(BYTES)
    x = "the quick brown fox jumps over the lazy dog " * 30
    _, (deltas,) = count_batch(pa.array([x]), BYTES)
    for budget in (0, 1, 7, 100):
        n = longest_within(deltas, budget, x.encode())
        assert len(t.encode(x[:n], add_special_tokens=False).ids) <= budget
        assert all(len(t.encode(x[:m], add_special_tokens=False).ids) > budget for m in range(n + 1, min(n + 5, len(x)) + 1))


def test_budget_ends_between_characters():
    t = Tokenizer.from_file(BYTES)
    for x in ("naïve \U0001f600\U0001f44d\U0001f3fd", "日本語のテキスト" * 3, "\U0001f600" * 5):
        _, (deltas,) = count_batch(pa.array([x]), BYTES)
        for budget in range(12):
            n = longest_within(deltas, budget, x.encode())
            fits = [k for k in range(len(x) + 1) if len(t.encode(x[:k], add_special_tokens=False).ids) <= budget]
            assert x.encode()[:n].decode() == x[: max(fits)]


def test_word_ids_equal_the_library():
    t, w = Tokenizer.from_file(WORDS), word_ids(WORDS)
    all_texts = ODD + texts(1500, 3) + ["aaaa aaaaa aaaaaaa", "ab" * 100]
    for x in all_texts:
        got = w.pieces(pa.array(x.replace("\n", " ").split(" ")))[0].tolist()
        assert got == t.encode(x, add_special_tokens=False).ids, x
    flat, sizes = w.pieces(pa.array([p for x in all_texts for p in x.replace("\n", " ").split(" ")]))
    assert flat.tolist() == [i for x in all_texts for i in t.encode(x, add_special_tokens=False).ids] and sizes.sum() == len(flat)
    one = w.words(pa.array(["hello", "ab" * 100, "world"]))
    assert one[1].tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in ("hello", "ab" * 100, "world")]


def test_bounded_tables():
    c = byte_counter(BYTES)
    c.dp.most, kept = 5, c.dp.most
    try:
        assert c.prefix_counts("bounded tables still count")[0] == 4 or c.prefix_counts("bounded tables still count")[0] > 0
    finally:
        c.dp.most = kept


def test_rows_nulls_repeats_and_other_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (3, "", "y")], "doc_id long, text string, n_tokens string")
    rows = sorted(map(tuple, count_tokens(df, BYTES, limit=1, store=False).collect()), key=str)
    assert rows == sorted([(1, 3, 2, True, 1), (1, 3, 2, True, 1), (None, 0, 0, False, 0), (3, 0, 0, False, 0)], key=str)
    assert count_tokens(df.limit(0), BYTES).count() == 0
