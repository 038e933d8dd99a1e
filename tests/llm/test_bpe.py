import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from sketchloom.llm import bpe
from sketchloom.llm.queries import tokenizer_path

from .conftest import ODD

POOL = "aAbBzZ ééÉß ςΣσİıK'sS'Tt'LL0189१२ \t\n\x1c\x1f\x85\xa0\u3000\u200b😀👍🏽中文ǅﬁ\u0327\u0301@#$%"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def texts(n=1500):
    rnd = random.Random(1)
    out = ["", "a" * 5000, "<|startoftext|>Hi <|endoftext|>", "don't WE'LL they've"]
    for _ in range(n):
        x = "".join(rnd.choice(POOL) for _ in range(rnd.randint(0, 40)))
        out.append(x + rnd.choice(["", "", "<|startoftext|>", "<|endoftext|>x y", "b" * rnd.randint(1, 60)]))
    out += ["".join(chr(rnd.choice([rnd.randint(0, 0x24F), rnd.randint(0, 0xD7FF), rnd.randint(0xE000, 0x1FFFF)])) for _ in range(30)) for _ in range(n // 3)]
    return out


def test_equals_the_library(library):
    model, xs = bpe.WordBpe(tokenizer_path()), texts()
    for got, x in zip(model.encode_batch(xs), xs, strict=True):
        assert got == library.encode(x, add_special_tokens=False).ids
        assert model.decode(got) == library.decode(got, skip_special_tokens=False)


def test_one_merge_at_a_time_gives_the_same():
    model, slow = bpe.WordBpe(tokenizer_path()), bpe.WordBpe(tokenizer_path())
    assert model.all_at_once
    slow.all_at_once = False
    words = ["a" * n for n in range(1, 40)] + ["banana", "mississippi", "ababababa", "therethere"]
    assert model.merge_words(words) == slow.merge_words(words)


def test_lowest_rank_first():
    model = bpe.WordBpe(tokenizer_path())
    rank = {int(k): int(r) for k, r in zip(model.keys, model.ranks, strict=True)}
    made = {int(k): int(m) for k, m in zip(model.keys, model.made, strict=True)}
    for w in ("unbelievable", "zzzzqx", "café", "internationalization"):
        raw = w.encode()
        sym = [int(model.inner[b]) for b in raw[:-1]] + [int(model.last[raw[-1]])]
        while True:
            found = [(rank.get(a * int(model.size) + b, np.inf), i) for i, (a, b) in enumerate(zip(sym, sym[1:], strict=False))]
            if not found or min(found)[0] == np.inf:
                break
            i = min(found)[1]
            sym[i : i + 2] = [made[sym[i] * int(model.size) + sym[i + 1]]]
        assert model.merge_words([w]) == [tuple(sym)]


def test_operator_on_odd_rows(docs, library):
    frame = docs(ODD).repartition(3)
    rows = bpe.round_trip_digest(frame, tokenizer_path(), with_ids=True, keep=("source",)).collect()
    assert len(rows) == len(ODD)
    want = sorted((str(i), hashlib.sha256(" ".join(map(str, library.encode(t or "", add_special_tokens=False).ids)).encode()).hexdigest()) for i, t in ODD)
    assert sorted((str(r["doc_id"]), r["ids_sha256"]) for r in rows) == want
    assert all(len(r["ids"]) == r["n_tokens"] for r in rows)
    decoded = bpe.decode(bpe.encode(frame, tokenizer_path()), tokenizer_path()).collect()
    assert sorted(hashlib.sha256(r["text"].encode()).hexdigest() for r in decoded) == sorted(r["decoded_sha256"] for r in rows)
    assert bpe.round_trip_digest(frame.where("false"), tokenizer_path()).count() == 0
