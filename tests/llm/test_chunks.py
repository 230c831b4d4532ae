"""Counts by chunk against the library, on runs of white space of every kind."""
import random
import re

import public_tokenizers

from sourcinglens.llm.chunks import parts
from sourcinglens.llm.common import scratch_folder
from sourcinglens.llm.token_counts import token_counts, tokenizer_version

PATH = public_tokenizers.path("byte_bpe_50k.json")
NBSP = "\u00a0"
TEXTS = [f"a {NBSP} {NBSP} b", "price" + f" {NBSP}" * 4 + " end", f"{NBSP} {NBSP}", f"a{NBSP} b", f"a {NBSP}b", "a \n b", "a\n b",
         "a \tb\t c", "a \r\n  b", " a", "a ", " ", "a b", "x \u2003 \u3000 y", "x \x1c \x85 y", f"<|endoftext|> {NBSP} <|endoftext|>"]


def white_texts():
    rng = random.Random(3)
    units = [" ", " ", " ", NBSP, "\t", "\n", "\r", "\u3000", "\u2003", "\x1f", "a", "end", "7", ".", "\'s", "\u00e9", "\u65e5"]
    return TEXTS + ["".join(rng.choice(units) for _ in range(rng.randrange(1, 25))) for _ in range(3000)]


def test_parts_cut_only_between_two_visible_characters():
    for t in white_texts():
        assert " ".join(parts(t)) == t and parts(f"a{t}b") == re.split(r"(?<=\S) (?=\S)", f"a{t}b"), repr(t)


def test_chunk_counts_against_the_library():
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(PATH)

    def count(text):
        return len(library.encode(text, add_special_tokens=False))
    for t in white_texts():
        head, *rest = parts(t)
        assert count(head) + sum(count(f" {k}") for k in rest) == count(t), repr(t)


def test_token_counts_of_white_texts(spark):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(PATH)
    table = list(enumerate(white_texts()[:400]))
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.over_limit) for r in token_counts(docs, scratch_folder(docs, "test-token-cache"), PATH, limit=5).collect()}
    counts = {i: len(library.encode(t, add_special_tokens=False)) for i, t in table}
    assert got == {i: (n, n > 5) for i, n in counts.items()}


def test_way_of_cutting_is_part_of_the_version(monkeypatch):
    from sourcinglens.llm import token_counts as module
    old = tokenizer_version(PATH)
    monkeypatch.setattr(module, "CUT", "another")
    assert tokenizer_version(PATH) != old
