import base64
import hashlib

import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings, strategies as st

from shelfline.llm import bpe

PATH = public_tokenizers.path(bpe.VOCABULARY)
SPLIT = regex.compile(public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tokens():
    return bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def public():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def machine(tokens):
    return bpe.MergeTransducer(tokens)


def encoded(machine, text):
    return [i for run in machine.runs(text, SPLIT) for i in run]


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" aeinrst\n'0,.ü")), max_size=80))
def test_any_text_is_encoded_as_by_the_public_library(text, machine, public, tokens):
    ids = encoded(machine, text)
    assert ids == public.encode_ordinary(text)
    reader = bpe.Utf8Machine(tokens)
    assert reader.feed(ids) + reader.close() == text


@pytest.mark.parametrize("unit", ["a", " ", "ab", "é", "=", "qwzxkj", "漢字", "the"])
def test_long_pieces_go_through_the_single_arcs(unit, machine, public):
    assert encoded(machine, unit * 3000) == public.encode_ordinary(unit * 3000)


def test_arcs_emit_before_the_end(machine):
    state, emitted, undecided = machine.root, 0, 0
    for byte in b"thequickbrownfoxjumpsoverthelazydog" * 40:
        state, out = state.arcs.get(byte) or machine.arc(state, byte)
        emitted += len(out)
        undecided = max(undecided, len(state.data))
    assert emitted > 100 and undecided < 64


def test_full_tables_change_nothing(tokens, public, monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_LIMIT", 5)
    small = bpe.MergeTransducer(tokens)
    text = "the quick brown fox " * 30 + "x" * 300 + "naïve façade"
    assert encoded(small, text) == public.encode_ordinary(text)


def test_unfinished_characters_wait_and_bad_bytes_are_replaced(tokens):
    ids = {t: i for i, t in enumerate(tokens)}
    reader = bpe.Utf8Machine(tokens)
    euro = "€".encode()
    assert [reader.feed([ids[euro[i:i + 1]]]) for i in range(3)] == ["", "", "€"]
    assert reader.feed([ids[b"\xe2"]]) + reader.close() == "�"


def test_rows(odd_docs, no_docs, public, spark):
    got = bpe.digest(odd_docs, PATH, public_tokenizers.PATTERN).collect()
    texts = [r["text"] or "" for r in odd_docs.select("text").collect()]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((len(i := public.encode_ordinary(t)), sha(",".join(map(str, i)).encode()), sha(t.encode())) for t in texts)
    assert sorted(tuple(r)[1:] for r in got) == want
    assert bpe.digest(no_docs, PATH, public_tokenizers.PATTERN).collect() == []
    back = bpe.decode(bpe.encode(odd_docs, PATH, public_tokenizers.PATTERN), PATH)
    assert back.where("decoded <> coalesce(text, '')").isEmpty() and back.count() == len(texts)
    assert set(back.columns) == {*odd_docs.columns, "decoded"}


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" aeinrst\n'0,.ü")), max_size=80))
def test_joined_runs_equal_single_ids(text, machine, tokens):
    reader = bpe.Utf8Machine(tokens)
    for _ in range(2):
        runs = [run for some in machine.joined_runs(text, SPLIT) for run in some]
        assert ",".join(runs) == ",".join(map(str, encoded(machine, text)))
        assert reader.feed_joined(runs) + reader.close() == text


def test_joined_runs_wait_for_unfinished_characters(tokens):
    ids = {t: str(i) for i, t in enumerate(tokens)}
    reader, euro = bpe.Utf8Machine(tokens), "€".encode()
    first, rest = ids[euro[:1]], ",".join(ids[euro[i:i + 1]] for i in (1, 2))
    assert [reader.feed_joined([r]) for r in (first, rest, ids[b"a"], first, rest)] == ["", "€", "a", "", "€"]


def test_full_joined_tables_change_nothing(tokens, public, monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_LIMIT", 5)
    small, reader = bpe.MergeTransducer(tokens), bpe.Utf8Machine(tokens)
    text = "the quick brown fox jumps " * 30 + "x" * 300 + "naïve façade"
    runs = [run for some in small.joined_runs(text, SPLIT) for run in some]
    assert ",".join(runs) == ",".join(map(str, public.encode_ordinary(text)))
    assert reader.feed_joined(runs) == text
