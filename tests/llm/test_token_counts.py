import time

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagewright.llm.tokens import count_tokens, prefix_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = st.text(alphabet=st.sampled_from(list("ab lthe'rsdm \n\t\r12é漢\x85\x1c½²!?.́<|> ")), max_size=30)


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(TEXTS, st.just("<|endoftext|>"), st.text(max_size=8)), max_size=4).map("".join))
def test_count_equals_library(text):
    assert prefix_bpe(PATH).count(text) == library(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(TEXTS, st.just("<|endoftext|>")), max_size=3).map("".join))
def test_every_prefix_equals_library(text):
    assert prefix_bpe(PATH).prefix_counts(text).tolist() == [library(text[:i]) for i in range(len(text) + 1)]


@pytest.mark.parametrize("budget", [0, 1, 7, 1000])
def test_cut(budget):
    text = "Some words of a text, and <|endoftext|> more of them."
    n = prefix_bpe(PATH).cut(text, budget)
    assert library(text[:n]) <= budget and (n == len(text) or all(library(text[:i]) > budget for i in range(n + 1, len(text) + 1)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(TEXTS, st.just("<|endoftext|>"), st.just("   \n\n  "), st.just("don't we'll")), max_size=4).map("".join), st.integers(0, 25))
def test_cut_from_few_pieces_equals_all_prefixes(text, budget):
    got = prefix_bpe(PATH).count_and_cut(text, budget)
    assert got == (library(text), max(i for i in range(len(text) + 1) if library(text[:i]) <= budget))


def test_long_runs_take_linear_time():
    bpe = prefix_bpe(PATH)
    start = time.perf_counter()
    for text in (" " * 20_000, "a " * 10_000 + "\n" * 20_000, "x'" * 10_000, "<|endoftext|>" * 1000 + "<|end" * 1000, "Zm9v" * 5000):
        counts = bpe.prefix_counts(text)
        assert counts[-1] == library(text) and counts[len(text) // 2] == library(text[: len(text) // 2])
    assert time.perf_counter() - start < 20
    assert all(len(x) <= 64 for x in bpe.memo)


def test_table(spark, odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    got = count_tokens(odd_docs, PATH, limit=100).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted((str(i), len((t or "").encode()), library(t or ""), library(t or "") > 100) for i, t in rows)
    texts = {str(i): t or "" for i, t in rows if rows.count((i, t)) == 1}
    assert all(library(texts[str(r["doc_id"])][: r["cut_chars"]]) <= 100 for r in got if str(r["doc_id"]) in texts and r["doc_id"] != 3)
    assert count_tokens(no_docs, PATH).count() == 0
